"""Repeated substrings: a cover of sampled positions, names for the text around them, and equal names side by side.

The cover is chosen by content: of the K-byte grams that begin in the first L - K + 1 bytes of an L-byte string, the
one of least hash. Equal strings have their sample at the same place, so every repeat meets at a sample, as it does in
a difference cover, with a third of its samples.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from microflow.llm.common import as_bytes, col, mix64, powers, prefix_hash, span_hash, table, written

#: Length of the strings, and of the sampled grams.
L, K = 100, 32
REACH = L - K  # a string begins so many bytes before its sample at most
#: The distances between a string's start and its sample are looked at as a whole, then in parts, then one by one.
LEVELS = (((0, REACH),), ((0, 16), (17, 33), (34, 50), (51, REACH)), tuple((d, d) for d in range(REACH + 1)))
_CHUNK, _LONGEST = 1 << 21, 1 << 23
_PLACE = np.uint64(0xFFFFFF)


class Samples:
    """The samples of some stretches of text: arrays over samples."""

    def __init__(self, stretches: list[tuple[int, int, bytes]]):
        data = np.frombuffer(b"".join(s[2] for s in stretches), np.uint8)
        sizes = np.fromiter((len(s[2]) for s in stretches), np.int64, len(stretches))
        ends = np.cumsum(sizes)
        begins = ends - sizes
        n = len(data)
        self.prefix = prefix_hash(data)
        up, _ = powers(n + 1)
        gram = mix64((self.prefix[K:] - self.prefix[:-K]) * up[: n - K + 1])
        least = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
        for step in (1, 2, 4, 8, 16, 32):
            least = np.minimum(least[:-step], least[step:])
        rest = REACH + 1 - 64
        least = np.minimum(least[:-rest], least[rest:])
        edge = np.zeros(len(least) + 1, np.int32)
        long = sizes >= L
        np.add.at(edge, begins[long], 1)
        np.add.at(edge, (ends - L + 1)[long], -1)
        start = np.flatnonzero(np.cumsum(edge)[:-1])
        at = (least[start] & _PLACE).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else at
        self.at = at[new]
        self.lo = start[new]
        self.hi = start[np.append(new[1:], len(start)) - 1] if len(at) else at
        which = np.searchsorted(ends, self.at, side="right")
        self.doc = np.fromiter((s[0] for s in stretches), np.int64, len(stretches))[which]
        self.shift = np.fromiter((s[1] for s in stretches), np.int64, len(stretches))[which] - begins[which]
        self.gram = gram[self.at]

    def parts(self, level: int):
        """For each part of a level: the samples that have strings in it, the first and last start of these, and where the part begins."""
        for near, far in LEVELS[level]:
            lo, hi = np.maximum(self.lo, self.at - far), np.minimum(self.hi, self.at - near)
            some = np.flatnonzero(lo <= hi)
            yield some, lo[some], hi[some], near, far

    def names(self, sample, lo, hi, near: int, far: int):
        """Of strings that start from lo to hi: a name of what all strings of the part would share, and of all that they cover."""
        at = self.at[sample]
        if near == far:
            name = span_hash(self.prefix, lo, lo + L)
            return name, name
        shared = mix64(span_hash(self.prefix, at - near, at - far + L) + np.uint64(near + 1))
        return shared, mix64(span_hash(self.prefix, lo, hi + L) + mix64((at - lo + 1).astype(np.uint64)))


def _samples(batch):
    """Samples of a batch (id, text), of about _CHUNK bytes each time."""
    run, size = [], 0
    for key, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
        for base in range(0, max(1, len(text) - L + 1), _LONGEST):
            piece = text[base : base + _LONGEST + L - 1]
            if len(piece) < L:
                continue
            if run and size + len(piece) > _CHUNK:
                yield Samples(run)
                run, size = [], 0
            run.append((key, base, piece))
            size += len(piece)
    if run:
        yield Samples(run)


class Folded:
    """Names of strings of a task. The first place of a name goes out as a name; all later places are repeats."""

    def __init__(self, most: int = 3_000_000):
        self.rows, self.size, self.most = [], 0, most

    def add(self, *columns):
        """group, name, document, first and last string start."""
        self.rows.append([np.asarray(c) for c in columns])
        self.size += len(columns[0])
        if self.size >= self.most:
            yield self.flush()

    def flush(self):
        if not self.rows:
            self.rows = [[np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3]]
        group, name, doc, lo, hi = (np.concatenate(c) for c in zip(*self.rows))
        self.rows, self.size = [], 0
        order = np.lexsort((lo, doc, name))
        group, name, doc, lo, hi = group[order], name[order], doc[order], lo[order], hi[order]
        again = np.concatenate(([False], name[1:] == name[:-1])) if len(name) else np.zeros(0, bool)
        # what is known to be a repeat needs no company, so a hot passage leaves a row a task in its group
        group = np.where(again, mix64(doc.view(np.uint64) * _MIX + lo.astype(np.uint64)), group)
        return pa.RecordBatch.from_arrays([pa.array(group.view(np.int64)), pa.array(name.view(np.int64)), pa.array(doc), pa.array(lo.astype(np.int32)), pa.array((hi - lo).astype(np.int16)), pa.array(again)], _FIELDS)


_FIELDS = ["grp", "name", "doc", "lo", "more", "again"]
_SCHEMA = "grp long, name long, doc long, lo int, more short, again boolean"


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _opened(batch) -> tuple[np.ndarray, np.ndarray]:
    """Of a batch (doc, text, places): its documents in order, and the open places as (number of the document, place) codes."""
    docs = batch.column(0).to_numpy()
    order = np.argsort(docs)
    lists = batch.column(2)
    number = np.empty(len(docs), np.int64)
    number[order] = np.arange(len(docs))
    places = lists.flatten().to_numpy().astype(np.int64)
    return docs[order], np.sort(np.repeat(number, np.diff(lists.offsets.to_numpy())) << 36 | places)


def _is_open(opened: tuple[np.ndarray, np.ndarray], doc: np.ndarray, lo: np.ndarray) -> np.ndarray:
    docs, codes = opened
    code = np.searchsorted(docs, doc) << 36 | lo
    return codes[np.minimum(np.searchsorted(codes, code), len(codes) - 1)] == code if len(codes) else np.zeros(len(doc), bool)


def repeats(docs: DataFrame) -> DataFrame:
    """(doc, lo, more): string starts lo to lo + more of doc whose string also starts earlier; docs: unique long id, text.

    A part of a sample's strings that covers the same bytes as an earlier part is a repeat as a whole. The first of
    its kind is looked at on the next level, if other text shares what all strings of such a part have in common: its
    place goes to its document, and only documents with such places are read again.
    """
    out, source = None, docs
    own = Window.partitionBy("grp").orderBy("name", "doc", "lo")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for level in range(len(LEVELS)):

        def scan(batches, level=level):
            folded = Folded()
            for b in batches:
                opened = _opened(b) if level else None
                for s in _samples(b):
                    outer = None
                    if level:  # the part of the level before that each part lies in
                        outer = [(x[3], x[4], np.isin(np.arange(len(s.at)), x[0][_is_open(opened, s.doc[x[0]], x[1] + s.shift[x[0]])])) for x in s.parts(level - 1)]
                    for sample, lo, hi, near, far in s.parts(level):
                        if level:
                            keep = next(x[2] for x in outer if x[0] <= near and far <= x[1])[sample]
                            sample, lo, hi = sample[keep], lo[keep], hi[keep]
                        shared, name = s.names(sample, lo, hi, near, far)
                        yield from folded.add(shared, name, s.doc[sample], lo + s.shift[sample], hi + s.shift[sample])
            yield folded.flush()

        rows = source.mapInArrow(scan, _SCHEMA)
        # rows that a task has found again have an earlier row of that task and name before them
        met = rows.select("*", F.lag("name").over(own).alias("before"), F.min("name").over(whole).alias("least"), F.max("name").over(whole).alias("most"))
        same = F.coalesce(F.col("before") == F.col("name"), F.lit(False)) | F.col("again")
        met = met.where(same | (F.col("least") < F.col("most"))).select("doc", "lo", "more", same.alias("repeat"))
        if level + 1 < len(LEVELS):
            met = written(met, "samples")
            source = docs.join(met.where(~F.col("repeat")).groupBy("doc").agg(F.collect_list("lo").alias("places")), "doc")
        done = met.where("repeat").select("doc", "lo", "more")
        out = done if out is None else out.unionByName(done)
    return out


def _cuts(spans: list, size: int) -> np.ndarray:
    """Runs of removed bytes (start, end) from string starts."""
    if not spans:
        return np.zeros((0, 2), np.int64)
    a = np.array([(s["lo"], s["lo"] + s["more"] + L) for s in spans], np.int64)
    a = a[np.argsort(a[:, 0], kind="stable")]
    reach = np.maximum.accumulate(a[:, 1])
    new = np.flatnonzero(np.concatenate(([True], a[1:, 0] > reach[:-1])))
    return np.stack((a[new, 0], np.minimum(reach[np.append(new[1:], len(a)) - 1], size)), 1)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, kept (bytes), n_bytes, n_removed, n_spans and kept_sha256 per row.

    Removed is each byte covered by a 100-byte string that also starts earlier: in a smaller id, or earlier in the
    same document; overlaps count, matches don't cross documents and are judged on the input. Null text is empty.
    Texts under 100 bytes stay whole. Null ids come last; of rows that repeat an id, the order is that of their text's
    hash, and equal rows are documents of their own. Other columns are ignored. An empty table gives an empty result.
    Strings are compared by 64-bit hashes.
    """
    base = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    ids = base.agg(F.count("*").alias("n"), F.count("id").alias("known")).first()
    unique = ids.n == ids.known and base.schema["id"].dataType.simpleString() in ("bigint", "int") and not base.groupBy("id").count().where("count > 1").limit(1).count()
    if unique:
        keyed = base.select(F.col("id").cast("long").alias("doc"), "text", "id")
    else:  # numbers in the order of ids
        keyed = written(base.orderBy(F.col("id").asc_nulls_last(), F.xxhash64("text"), "text").select(F.monotonically_increasing_id().alias("doc"), "text", "id"), "numbered")
    spans = repeats(keyed.select("doc", "text")).groupBy("doc").agg(F.collect_list(F.struct("lo", "more")).alias("spans"))
    # a list of a document's own string starts: as long as its text at most
    joined = keyed.join(spans, "doc", "left").select("id", "text", "spans")

    def cut(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                piece = b.slice(at, 500)
                texts, out = as_bytes(piece.column(1)), []
                for text, spans in zip(texts, piece.column(2).to_pylist()):
                    runs = _cuts(spans or [], len(text))
                    edges = [0, *runs.ravel().tolist(), len(text)]
                    kept = b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2]))
                    out.append((kept, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
                cols = [pa.array(list(c), t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()))] if out else []
                if out:
                    yield pa.RecordBatch.from_arrays([piece.column(0), *cols], ["id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = f"id {base.schema['id'].dataType.simpleString()}, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return joined.mapInArrow(cut, schema).withColumnRenamed("id", id_col)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("kept")
