"""Histories in pieces, held against one plain pass; pieces are made small, so that every carry is used."""

import random

import pytest

from microflow.operators import book, queue, rolling, sync
from microflow.sources.adapters import BEGIN, DEPTH, END, LEVEL, TRADE

MD = "symbol_id long, idx long, ts_us long, type int, side int, price long, qty long, epoch long"


def plain_book(rows):
    """Best prices after each event (type, side, price, qty), one by one."""
    live, staged, is_open, out = ({}, {}), ({}, {}), False, []
    for kind, side, price, qty in rows:
        if kind == BEGIN:
            staged, is_open = ({}, {}), True
        elif kind == END and is_open:
            live, staged, is_open = staged, ({}, {}), False
        elif kind == LEVEL and is_open and qty > 0:
            staged[side][price] = qty
        elif kind == DEPTH or kind == LEVEL and not is_open and qty > 0:
            live[side].pop(price, None)
            if qty > 0:
                live[side][price] = qty
        b, a = max(live[0], default=None), min(live[1], default=None)
        out.append((b, a, live[0].get(b), live[1].get(a)))
    return out


def broken_snapshots(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        kind = rng.choice([DEPTH] * 8 + [LEVEL] * 5 + [BEGIN, END, TRADE])
        side = rng.randrange(2)
        out.append((kind, None, None, None) if kind in (BEGIN, END) else (kind, side, 100 + rng.randrange(6) + 3 * side, rng.choice([0, 1, 2, 5])))
    return out


def as_events(spark, rows, symbol=1):
    return spark.createDataFrame([(symbol, i, i * 1000, k, s, p, q, 0) for i, (k, s, p, q) in enumerate(rows)], MD)


@pytest.mark.parametrize("rows", [
    [(BEGIN, None, None, None), (LEVEL, 0, 100, 5), (BEGIN, None, None, None), (LEVEL, 0, 90, 3), (END, None, None, None)],
    [(LEVEL, 0, 100, 5), (END, None, None, None)],
    [(DEPTH, 0, 90, 1), (LEVEL, 0, 100, 5), (BEGIN, None, None, None), (END, None, None, None), (LEVEL, 1, 101, 2), (END, None, None, None)],
])
def test_broken_snapshots(spark, rows):
    got = [tuple(r)[3:7] for r in book.bbo(as_events(spark, rows)).orderBy("idx").collect()]
    assert got == plain_book(rows)


def test_book_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(book, "CHUNK", 4)
    rows = broken_snapshots(1, 300)
    got = [tuple(r)[3:7] for r in book.bbo(as_events(spark, rows)).orderBy("idx").collect()]
    assert got == plain_book(rows)


def plain_sync(rows):
    """The protocol, message by message: (ln, accepted, gap, dirty, resynced, stale, presync)."""
    synced = dirty = first = False
    last, futures, out = None, None, []
    for ln, kind, u_first, u_final, prev in rows:
        accepted = gap = resynced = stale = presync = False
        if kind == "snapshot":
            resynced, dirty, synced, first, last = dirty, False, True, True, u_final
        elif kind == "depth":
            if not synced:
                presync = True
            elif u_final <= last:
                stale = True
            else:
                accepted = True
                futures = prev is not None if futures is None else futures
                ok = u_first <= last + 1 <= u_final if first else prev == last if futures and prev is not None else u_first == last + 1
                gap, last, first = not ok, u_final, False
                dirty |= gap
        out.append((ln, accepted, gap, dirty, resynced, stale, presync))
    return out


def test_sync_within_long_epochs(spark, monkeypatch):
    monkeypatch.setattr(sync, "STRETCH", 7)
    rng, rows, expect = random.Random(2), [], []
    for symbol in range(4):
        own, at = [], 100
        for ln in range(1, 400):
            kind = rng.choice(["depth"] * 30 + ["trade"] * 4 + ["snapshot"] * (symbol % 2 + 1))
            step = rng.choice([1, 1, 1, 1, 1, 3, -2])
            final = at + 4
            own.append((ln, kind, at + step, final, at + step - 1 if symbol > 1 and rng.random() < 0.9 else None) if kind == "depth" else (ln, kind, None, at if kind == "snapshot" else None, None))
            at = final if kind == "depth" else at
            if rng.random() < 0.05 and own[-1][1] == "depth":
                own[-1] = (ln, "depth", at - 40, at - 36, own[-1][4])
        expect += [(symbol, *x) for x in plain_sync(own)]
        rows += [(symbol, *r) for r in own]
    df = spark.createDataFrame(rows, "symbol_id long, ln long, kind string, first_id long, final_id long, prev_id long")
    got = sync.synchronised(df).select("symbol_id", "ln", "accepted", "gap", "dirty", "resynced", "stale", "presync")
    assert sorted(map(tuple, got.collect())) == sorted(expect)


def test_timers_in_runs(spark, monkeypatch):
    monkeypatch.setattr(sync, "STRETCH", 8)
    df = spark.createDataFrame([(1, 5), (1, 1000), (2, 7), (3, 0), (3, 16)], "symbol_id long, ts_us long")
    got = sorted(map(tuple, sync.timers(df, 16).collect()))
    assert got == sorted([(1, 5 + 16 * k) for k in range(1, 63)] + [(3, 16)])


def test_spacing_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(rolling, "SPACINGS", 4)
    rng, rows, expect = random.Random(5), [], []
    for symbol, gap in ((1, 3), (2, 40), (3, 900)):
        ts, last = 10**6, None
        for idx in range(400):
            ts += rng.randrange(gap) if rng.random() < 0.97 else 25 * gap
            rows.append((symbol, 0, ts, idx, idx))
            if last is None or ts - last >= 50:
                last = ts
                expect.append((symbol, idx))
    df = spark.createDataFrame(rows, "symbol_id long, day long, ts_us long, idx long, mid_x2 long")
    assert sorted((r.symbol_id, r.idx) for r in rolling.spaced(df, 50).collect()) == sorted(expect)


def test_first_passage_by_an_index(spark, monkeypatch):
    monkeypatch.setattr(queue, "LEAF", 4)
    monkeypatch.setattr(queue, "FAN", 2)
    rng = random.Random(8)
    walk, prints = 100, []
    for idx in range(600):
        walk += rng.choice([-1, 0, 1])
        prints.append((1, idx, idx * 10, TRADE, rng.randrange(2), walk, rng.randint(1, 4)))
    orders = [(f"o{i}", 1, rng.randrange(2), prints[k := rng.randrange(590)][5] + rng.randint(-6, 6), 5, k, k * 10) for i in range(80)]
    md = spark.createDataFrame(prints, "symbol_id long, idx long, ts_us long, type int, side int, price long, qty long")
    df = spark.createDataFrame(orders, "order_id string, symbol_id long, side int, price long, qty long, idx long, ts_us long")
    expect, cross = [], {}
    for name, _, side, price, qty, at, ts in orders:
        for _, idx, us, _, tside, p, q in prints:
            if idx > at and us <= ts + 2000:
                if tside == 1 - side and qty > 0 and (p <= price if side == 0 else p >= price):
                    expect.append((name, idx, us, min(q, qty)))
                    qty -= min(q, qty)
                if (p + 1 <= price if side == 0 else p - 1 >= price) and name not in cross:
                    cross[name] = (idx, us)
    got = queue.touch_fills(df, md, 2000).select("order_id", "t_idx", "t_us", "fill")
    assert sorted(map(tuple, got.collect())) == sorted(expect) and expect
    best = md.selectExpr("symbol_id", "idx", "ts_us", "price - 1 as best_bid", "price + 1 as best_ask")
    assert {r.order_id: (r.cross_idx, r.cross_us) for r in queue.cross_fills(df, best, 2000).collect()} == cross
    joined = queue.reached(df.withColumn("need", df.qty), md.selectExpr("symbol_id", "1 - side as side", "idx", "price", "qty as lots", "struct(ts_us) as p"), md, 2000)
    assert joined.count() <= 2 * (len(expect) + len(orders)) * queue.LEAF
