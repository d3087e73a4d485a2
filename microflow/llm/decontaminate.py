"""Benchmark decontamination: a broadcast hash set of normalised n-grams against the windows of training text."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from microflow.llm.common import as_bytes, col, free, mix64, partitions, table, written

#: Benchmarks up to this many characters and words are one broadcast; larger ones are searched for in several passes.
BROADCAST_CHARS, BROADCAST_WINDOWS = 64_000_000, 12_000_000
#: Lower-cases A-Z and turns every byte that is no word character into a space.
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a lower-cased text."""
    return text.translate(_KEEP).split()


class Windows:
    """The windows of some items: by length, sorted hashes with a place in the items' words for the proof, and the items.

    Some twenty bytes a word of the items, besides their vocabulary. Word numbers are exact, and multipliers are drawn
    anew until no two different windows share a hash.
    """

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.items = [k for k, _ in items]
        ids: dict[bytes, int] = {}
        runs = [np.fromiter((ids.setdefault(x, len(ids)) for x in words(text)), np.int32) for _, text in items]
        self.ids, self.words = ids, np.concatenate([np.zeros(0, np.int32), *runs])
        counts = np.array([len(r) for r in runs], np.int64)
        del runs
        first = np.cumsum(counts) - counts
        sizes, self.salt, self.by = np.minimum(counts, n), 0, {}
        for size in np.unique(sizes[sizes > 0]).tolist():
            mine = np.flatnonzero(sizes == size)
            many = counts[mine] - size + 1
            owner = np.repeat(mine, many).astype(np.int32)
            place = np.arange(len(owner)) + np.repeat(first[mine] - (np.cumsum(many) - many), many)
            while True:
                hashes = self.hash(self.words, place, size)
                order = np.argsort(hashes, kind="stable")
                sorted_ = hashes[order]
                twin = np.flatnonzero(sorted_[1:] == sorted_[:-1])
                if self.equal(self.words, place[order[twin]], place[order[twin + 1]], size).all():
                    break
                self.salt += 1
            owner, place = owner[order], place[order]
            new = np.concatenate(([True], (sorted_[1:] != sorted_[:-1]) | (owner[1:] != owner[:-1])))
            self.by[size] = (self.salt, sorted_[new], place[new], owner[new])

    def hash(self, ids: np.ndarray, at: np.ndarray, size: int, salt: int | None = None) -> np.ndarray:
        """Of the `size` ids from each place on: a sum of mixed ids with a multiplier for each position."""
        salt = self.salt if salt is None else salt
        odd = mix64(np.arange(size, dtype=np.uint64) + np.uint64(1 + (salt << 32))) | np.uint64(1)
        out = np.zeros(len(at), np.uint64)
        for k in range(size):
            out += mix64(ids[at + k].astype(np.uint64) + np.uint64(1)) * odd[k]
        return mix64(out)

    def equal(self, ids: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        """Whether the `size` ids from a on are the items' words from b on."""
        out = np.ones(len(a), bool)
        for k in range(size):
            out &= ids[a + k] == self.words[b + k]
        return out

    def search(self, texts: list[bytes]):
        """For each text: its words, a mask of hit words and the items found."""
        tokens = [words(t) for t in texts]
        get = self.ids.get
        # an unknown number ends a text
        ids = np.fromiter((x for t in tokens for x in (*map(get, t, itertools.repeat(-1)), -1)), np.int32)
        hit, found = np.zeros(len(ids), bool), {}
        ends = np.cumsum([len(t) + 1 for t in tokens])
        stop = np.flatnonzero(ids < 0)
        for size, (salt, hashes, places, owners) in self.by.items():
            if len(ids) < size:
                continue
            # a window can only start where `size` known words follow each other
            start = np.arange(len(ids) - size + 1)
            after = np.append(stop, len(ids))[np.searchsorted(stop, start)]
            start = start[after - start >= size]
            h = self.hash(ids, start, size, salt)
            near = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            some = np.flatnonzero(hashes[near] == h)
            some = some[self.equal(ids, start[some], places[near[some]], size)]
            for k in range(size):
                hit[start[some] + k] = True
            pairs = np.unique(np.stack((np.searchsorted(ends, start[some], side="right"), near[some])), axis=1)
            for d, lo, hi in zip(*pairs.tolist(), np.searchsorted(hashes, hashes[pairs[1]], side="right").tolist()):
                found.setdefault(d, set()).update(owners[lo:hi].tolist())
        at = 0
        for d, t in enumerate(tokens):
            yield t, hit[at : at + len(t)], sorted({self.items[i] for i in found.get(d, ())})
            at += len(t) + 1


def _runs(mask: np.ndarray) -> list[int]:
    """start, end, start, end ... of the runs that are set."""
    return np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0])))).tolist()


def hits(docs: DataFrame, items: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep_text: bool = False, row_col: str | None = None) -> DataFrame:
    """id, n_words, hit_runs (word numbers: start, end ...), items (distinct ids as strings, sorted), and the text if asked for.

    row_col: a column that tells the rows of docs apart; it comes back as `row`.
    Null text has no words; an item of no words has no window; a null item id counts as the item "". An empty benchmark hits
    nothing. A benchmark beyond BROADCAST_CHARS or BROADCAST_WINDOWS is cut by item into parts. One after another, each is broadcast to a pass
    of its own over a table in which each row has a key, and its hits are written before the next part is read; every row
    stays its own, whatever its id. An item is in one part, so it must fit into the driver.
    """
    spark = docs.sparkSession
    of_item = F.regexp_count(F.lower(col(item_text)), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    chars, n_words = (x or 0 for x in items.agg(F.sum(F.length(col(item_text))), F.sum(of_item)).first())
    parts = max(1, -(-chars // BROADCAST_CHARS), -(-n_words // BROADCAST_WINDOWS))
    keyed = parts > 1 or row_col is not None
    base = docs.select(col(id_col).alias("id"), col(text_col).alias("text"), *([col(row_col).cast("long").alias("row")] if row_col else []))
    if parts > 1 and not row_col:
        base = written(base.withColumn("row", F.monotonically_increasing_id()), "decontamination-rows")
    in_scan = keep_text and parts == 1
    schema = "id " + base.schema["id"].dataType.simpleString() + ", n_words long, hit_runs array<int>, items array<string>" + (", text string" if in_scan else "") + (", row long" if keyed else "")
    item = items.select(F.coalesce(col(item_col).cast("string"), F.lit("")).alias("item"), col(item_text).alias("text")).where("text is not null")

    def one(part: int) -> DataFrame:
        chosen = item if parts == 1 else item.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        sent = spark.sparkContext.broadcast(Windows([(r.item, r.text.encode()) for r in chosen.collect()], n))

        def scan(batches):
            windows = sent.value
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    piece = b.slice(at, 256)
                    out = [(len(w), _runs(mask), found) for w, mask, found in windows.search(as_bytes(piece.column(1)))]
                    cols = [piece.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int32())), pa.array([x[2] for x in out], pa.list_(pa.string()))]
                    names = ["id", "n_words", "hit_runs", "items"]
                    yield pa.RecordBatch.from_arrays(cols + [piece.column(1)] * in_scan + piece.columns[2:], names + ["text"] * in_scan + piece.schema.names[2:])

        rows = base.mapInArrow(scan, schema)
        if parts == 1:
            return rows
        # the first part's rows stand for all documents
        rows = written(rows if part == 0 else rows.where("size(items) > 0"), "decontamination-hits")
        sent.destroy()
        return rows

    both = one(0)
    if parts == 1:
        return both
    for k in range(1, parts):
        both = both.unionByName(one(k))
    merged = both.groupBy("row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hit_runs")).alias("hit_runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    if keep_text:
        merged = merged.join(base.select("row", "text"), "row")
    merged = merged if row_col else merged.drop("row")
    return merged.repartition(partitions(spark))


def judged(found: DataFrame, share: int = 20) -> DataFrame:
    """hits() with n_hit, n_items, items_sha256 and contaminated: hit words are at least one in `share`."""
    n_hit = F.expr("cast(size(array_distinct(flatten(transform(sequence(0, size(hit_runs) div 2 - 1), i -> sequence(hit_runs[2 * i], hit_runs[2 * i + 1] - 1))))) as bigint)")
    found = found.withColumn("n_hit", F.when(F.size("hit_runs") > 0, n_hit).otherwise(F.lit(0)).cast("long"))
    return found.withColumn("n_items", F.size("items").cast("long")).withColumn("items_sha256", F.sha2(F.array_join("items", ",").cast("binary"), 256)).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 13, share: int = 20, action: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without contaminated documents ("documents"), or with the hit words cut out of all texts ("spans").

    All columns stay, whatever their names. Cutting removes each run of hit words with what stands between them; each
    row is cut by its own text, whatever ids repeat. In dropping, rows that repeat an id go together if one of them is
    contaminated; rows with a null id stay. Null texts stay null.
    """
    if action not in ("documents", "spans"):
        raise ValueError(f"action must be 'documents' or 'spans', not {action!r}")
    names = docs.columns
    if action == "documents":
        bad = free("contaminated_id", docs)
        found = judged(hits(docs, items, n, id_col, text_col), share)
        return docs.join(found.where("contaminated").select(F.col("id").alias(bad)).distinct(), col(id_col) == F.col(bad), "left_anti")
    row, new = free("cut_row", docs), free("cut_text", docs)
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "decontamination-rows")
    found = hits(numbered, items, n, id_col, text_col, row_col=row).where("size(hit_runs) > 0").select(F.col("row").alias(row), F.col("hit_runs").alias(new))
    hit = numbered.select(row, col(text_col).alias("text")).join(found, row).select(row, "text", new)

    def cut(batches):
        for b in batches:
            texts = [cut_words(t, runs) for t, runs in zip(as_bytes(b.column(1)), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.decode() for t in texts], pa.string())], [row, new])

    out = numbered.join(hit.mapInArrow(cut, f"`{row}` long, `{new}` string"), row, "left")
    return out.withColumn(text_col, F.coalesce(F.col(new), col(text_col))).select(*[col(c) for c in names])


def cut_words(text: bytes, runs: list[int]) -> bytes:
    """text without the runs (start, end ... in words) and what stands within them."""
    inside = np.frombuffer(text.translate(_KEEP), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    gone = np.zeros(len(starts) + 1, np.int64)
    np.add.at(gone, runs[::2], 1)
    np.add.at(gone, runs[1::2], -1)
    out, at = [], 0
    whole = _runs(np.cumsum(gone[:-1]) > 0)
    for a, z in zip(whole[::2], whole[1::2]):
        out.append(text[at : starts[a]])
        at = ends[z - 1]
    return b"".join([*out, text[at:]])


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
sized AS (SELECT item, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
items AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
places AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n)),
found AS (SELECT r, i, n, item FROM places JOIN items USING (n, win)),
hit AS (SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS word FROM found) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)"""
