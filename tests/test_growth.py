"""Steps whose work grew faster than their input, or by the number of cores."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from microflow import recorder_queries  # noqa: F401  registers dual_book
from microflow.functions import decode
from microflow.operators import book, queue, report
from microflow.plans import convert
from microflow.queries import QUERIES
from microflow.sources.adapters import DEPTH
from microflow.streaming import books, sinks

from .test_pieces import as_events, broken_snapshots, plain_book


def test_grid_has_no_more_partitions_than_one_table(spark):
    axes = {"a": [1, 2], "b": ["x", "y"], "c": [0.5], "d": [3, 3, 4]}
    out = report.grid(spark, **axes)
    assert out.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert [t for _, t in out.dtypes] == ["bigint", "string", "double", "bigint"]
    assert sorted(map(tuple, out.collect())) == sorted((a, b, c, d) for a in axes["a"] for b in axes["b"] for c in axes["c"] for d in axes["d"])


def test_lines_of_one_instrument_stay_in_their_partitions(spark):
    lines = spark.range(1, 4001, 1, 8).select(F.col("id").alias("ln"), F.concat(F.lit('{"t":5,"c":"trade","s":"SYM0","d":{"T":5,"a":1,"p":"100.00","q":"1.0","m":true}}')).alias("value"))
    rows = convert.known_lines(lines, spark.createDataFrame([("SYM0", 0)], "symbol string, symbol_id long"))
    parts = [r["count"] for r in decode.decoded(rows, 0.01, 0.1).where("not broken").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == 4000 and max(parts) <= 500


def test_two_books_over_chunks_and_empty_sides(spark, monkeypatch):
    monkeypatch.setattr(book, "CHUNK", 16)
    rows = broken_snapshots(21, 400)
    md = as_events(spark, rows)
    plain = plain_book(rows)
    got = book.bbo_by_intervals(md, md).collect()
    assert len(got) == 400 and all((r.best_bid, r.best_ask, r.bid_qty, r.ask_qty) == plain[r.idx] for r in got)
    assert any(r.best_bid is None for r in got) and book.compare(book.bbo(md), book.bbo_by_intervals(md, md)).count() == 0


def test_dual_run_holds_every_level(spark, monkeypatch):
    """Levels behind the best are compared too, after each event."""
    monkeypatch.setattr(book, "CHUNK", 2)
    md = as_events(spark, [(DEPTH, 0, 100, 5), (DEPTH, 0, 90, 1), (DEPTH, 1, 101, 2), (DEPTH, 0, 90, 3), (DEPTH, 1, 105, 4), (DEPTH, 0, 90, 0), (DEPTH, 1, 105, 0)]).drop("epoch")
    off = lambda other: sorted((r.idx, r.only_in) for r in book.compare(book.bbo(md, whole=True), book.bbo_by_intervals(other, md, whole=True)).collect())
    both = lambda *idx: [(i, x) for i in idx for x in ("first", "second")]
    assert off(md) == []
    assert off(md.withColumn("qty", F.when(F.col("idx") == 3, 7).otherwise(F.col("qty")))) == both(3, 4)
    assert off(md.where("idx <> 1")) == both(1, 2) and off(md.where("idx <> 4")) == both(4, 5)


def test_whole_books_over_chunks_and_snapshots(spark, monkeypatch):
    monkeypatch.setattr(book, "CHUNK", 16)
    md = as_events(spark, broken_snapshots(22, 400))
    spans = book.levels(md).collect()
    got = book.bbo_by_intervals(md, md, whole=True).collect()
    assert len(got) == 400 and all(r["n_bids n_asks".split()[side]] == sum(x.side == side and x.from_idx <= r.idx < x.to_idx for x in spans) for r in got for side in (0, 1))
    assert book.compare(book.bbo(md, whole=True), book.bbo_by_intervals(md, md, whole=True)).count() == 0


def test_dual_book_compares_whole_books(spark, monkeypatch):
    seen, real = [], book.compare
    monkeypatch.setattr(book, "compare", lambda one, two: seen.append(one.columns) or real(one, two))
    QUERIES["dual_book"](spark, "/root/testdata/sf0.001")
    assert {"n_bids", "n_asks", "bids", "asks"} <= set(seen[0])


def test_second_book_makes_no_row_a_point_and_level(spark):
    md = as_events(spark, [(0, 0, p, 1) for p in range(1, 301)]).drop("epoch")
    plan = book.bbo_by_intervals(md, md)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 1  # of the levels with their instrument's last event


@pytest.mark.parametrize("ours, theirs", [([1, 1, 2, None], [1, 3, None]), ([], [5, 5]), ([4], [4])])
def test_compare_counts_repeats(spark, ours, theirs):
    frame = lambda xs: spark.createDataFrame([(x, random.Random(1).random()) for x in xs], "a long, b double")
    one, two = frame(ours), frame(theirs)
    want = [(r.a, "first") for r in one.exceptAll(two).collect()] + [(r.a, "second") for r in two.exceptAll(one).collect()]
    assert sorted(((r.a, r.only_in) for r in book.compare(one, two).collect()), key=str) == sorted(want, key=str)


class _Kept:
    """Keyed state as a dictionary."""

    def __init__(self):
        self.items = {}

    def iterator(self):
        return iter(self.items.items())

    def updateValue(self, key, value):
        self.items[key] = value

    def removeKey(self, key):
        del self.items[key]

    def exists(self):
        return bool(self.items)

    def get(self):
        return self.items[0]

    def update(self, value):
        self.items[0] = value


def test_live_book_gives_out_batches(monkeypatch):
    monkeypatch.setattr(books, "BATCH", 32)
    one, rows = books._Book(), broken_snapshots(31, 400)
    one.live, one.staged, one.open = _Kept(), _Kept(), _Kept()
    table = pd.DataFrame([(i, i * 1000, *r) for i, r in enumerate(rows)], columns=["idx", "ts_us", "type", "side", "price", "qty"]).astype("Int64")
    got, plain = [], plain_book(rows)
    for trigger in (table[:250], table[250:]):
        mixed = trigger.sample(frac=1, random_state=1)
        got += list(one.handleInputRows(("1",), iter([mixed[:77], mixed[77:]]), None))
    assert max(map(len, got)) == 32
    rows = pd.concat(got).astype(object).where(lambda x: x.notna(), None)
    assert [(r.best_bid, r.best_ask, r.bid_qty, r.ask_qty) for r in rows.itertuples()] == plain


def test_replay_cuts_large_tables_into_more_pieces(spark, monkeypatch):
    sinks.with_state(spark)
    monkeypatch.setattr(sinks, "PIECE_ROWS", 100)
    runs, real = [], sinks.exactly_once
    monkeypatch.setattr(sinks, "exactly_once", lambda *a: runs.append(a[1]) or real(*a))
    rows = spark.range(500).select((F.col("id") % 2).alias("symbol_id"), "id")
    got = sinks.replayed(rows, "id", lambda s: s.select("symbol_id", "id"))
    assert sorted(r.id for r in got.collect()) == list(range(500)) and len(runs) == 5


def test_sweep_follows_an_order_once_for_all_cells(spark, monkeypatch):
    seen, real = [], queue.follow_models
    monkeypatch.setattr(queue, "follow_models", lambda orders, *a: seen.append(orders) or real(orders, *a))
    QUERIES["strategy_sweep"](spark, "/root/testdata/sf0.001")
    keys = ["symbol_id", "side", "price", "idx", "ts_us"]
    assert seen[0].count() == seen[0].select(*keys).distinct().count() > 0
