"""Language-model scoring by context-tree weighting over bytes, and a word-unigram base to hold it against."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from microflow.llm.common import _LOWER, as_bytes, col, drop, partitions, table, word_hash, written

#: Bytes of context of the deepest tree node.
DEPTH = 5
#: Bytes of text whose n-grams are looked up together.
BUCKET_BYTES = 40_000_000
#: Grams that a task solves together, about; and depth-2 nodes that are broadcast at most (deeper roots then go together).
PART_GRAMS, TOP_NODES = 200_000, 2_000_000
_WORD_END = 0x0A  # ends the last word of a document; stands before its first
_HALF_LOG_PI = 0.5723649429247001


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov block probability of a zeros and b ones."""
    return _lgamma_half(a) + _lgamma_half(b) - _lgamma_int(a + b) - 2 * _HALF_LOG_PI


def _stirling(x: np.ndarray) -> np.ndarray:
    """log gamma for x of 8 at least."""
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


_SMALL = np.arange(16)
_HALF_TABLE = np.concatenate(([_HALF_LOG_PI], _HALF_LOG_PI + np.cumsum(np.log(_SMALL[:-1] + 0.5))))
_INT_TABLE = np.concatenate(([0.0], np.cumsum(np.log(_SMALL[:-1] + 1.0))))


def _lgamma_half(n: np.ndarray) -> np.ndarray:
    """log gamma(n + 1/2)"""
    return np.where(n < 16, _HALF_TABLE[np.minimum(n, 15)], _stirling(np.maximum(n, 16) + 0.5))


def _lgamma_int(n: np.ndarray) -> np.ndarray:
    """log n!"""
    return np.where(n < 16, _INT_TABLE[np.minimum(n, 15)], _stirling(np.maximum(n, 16) + 1.0))


class Level:
    """The nodes of one depth: key = context << 8 | bits of the byte read so far (with a leading one)."""

    def __init__(self, key, zeros, ones, below):
        self.key, self.zeros, self.ones = key, zeros, ones
        kt = log_kt(zeros, ones)
        # weighting: half the estimate here, half the children's product
        self.weighted = kt if below is None else np.logaddexp(kt, below) - np.log(2)
        self.log_beta = np.full(len(key), np.inf) if below is None else kt - below

    def mix(self, at, bit, deeper):
        """Probability of the bits, from nodes at `at`, given those of the next depth."""
        n1, n = self.ones[at], self.ones[at] + self.zeros[at]
        own = (np.where(bit, n1, n - n1) + 0.5) / (n + 1.0)
        if deeper is None:
            return own
        share = 1 / (1 + np.exp(-np.clip(self.log_beta[at], -700, 700)))
        return share * own + (1 - share) * deeper


def _sum_by(keys: np.ndarray, *values):
    """Distinct keys, and sums of each value by key."""
    order = np.argsort(keys)
    k = keys[order]
    new = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[new], *(np.add.reduceat(v[order], new) if len(k) else v[:0] for v in values)


def _count_by(keys: np.ndarray, counted: np.ndarray):
    """Distinct keys of 63 bits at most, and how many of each are counted: the flags ride along in one sort."""
    both = np.sort((keys << np.uint64(1)) | counted.astype(np.uint64))
    k = both >> np.uint64(1)
    new = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[new], np.add.reduceat((both & np.uint64(1)).astype(np.int64), new) if len(k) else np.zeros(0, np.int64)


class Lookup:
    """Values by distinct 64-bit keys: an open-addressing table that is filled and asked many keys at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, values.dtype)
        used, owner = np.zeros(1 << bits, bool), np.zeros(1 << bits, np.int64)
        left, slot = np.arange(len(keys)), self._home(keys)
        while len(left):
            owner[slot] = left
            won = ~used[slot] & (owner[slot] == left)
            at, own = slot[won], left[won]
            used[at], self.keys[at], self.values[at] = True, keys[own], values[own]
            left, slot = left[~won], (slot[~won] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys that are all in the table."""
        slot = self._home(keys)
        out = self.values[slot]
        miss = np.flatnonzero(self.keys[slot] != keys)
        slot = slot[miss]
        while len(miss):
            slot = (slot + 1) & self.mask
            found = self.keys[slot] == keys[miss]
            out[miss[found]] = self.values[slot[found]]
            miss, slot = miss[~found], slot[~found]
        return out


def decisions(gram: np.ndarray):
    """The eight binary decisions of each gram's last byte: (bits read before, with a leading one; the bit)."""
    symbol = (gram & np.uint64(255)).astype(np.int64)
    for k in range(8):
        yield (1 << k) | (symbol >> (8 - k)), (symbol >> (7 - k)) & 1


def _node(gram: np.ndarray, depth: int, bits: np.ndarray) -> np.ndarray:
    context = (gram >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)
    return (context << np.uint64(8)) | bits.astype(np.uint64)


def levels(gram: np.ndarray, n: np.ndarray, deepest: int, lowest: int) -> dict[int, Level]:
    """The tree nodes of depths `lowest` to `deepest` that these grams touch; n: their counts in training text."""
    key = np.concatenate([_node(gram, deepest, bits) for bits, _ in decisions(gram)])
    bit = np.concatenate([b for _, b in decisions(gram)])
    count = np.tile(n, 8)
    key, zeros, ones = _sum_by(key, np.where(bit, 0, count), np.where(bit, count, 0))
    out = {deepest: Level(key, zeros, ones, None)}
    for depth in range(deepest - 1, lowest - 1, -1):
        deep = out[depth + 1]
        out[depth] = parents(deep.key, deep.zeros, deep.ones, deep.weighted, depth)
    return out


def parents(key, zeros, ones, weighted, depth: int, whole: bool = True):
    """The nodes of `depth` above those of the next depth; not whole: the sums alone, as other parts add to them."""
    up = (((key >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)) << np.uint64(8)) | (key & np.uint64(255))
    sums = _sum_by(up, zeros, ones, weighted)
    return Level(*sums) if whole else sums


def log10_symbols(gram: np.ndarray, tree: dict[int, Level]) -> np.ndarray:
    """log10 of the tree's probability of each gram's last byte after the others."""
    out = np.zeros(len(gram))
    for bits, bit in decisions(gram):
        p = None
        for depth in sorted(tree, reverse=True):
            p = tree[depth].mix(np.searchsorted(tree[depth].key, _node(gram, depth, bits)), bit, p)
        out += np.log10(p)
    return out


def byte_grams(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The grams (depth bytes of context and a byte) of normalised texts, each after `depth` ends; documents' edges."""
    edge = bytes([_WORD_END]) * depth
    data = np.frombuffer(b"".join(edge + t for t in texts), np.uint8)
    out = np.zeros(len(data), np.uint64)
    for k in range(depth + 1):
        out[k:] |= data[: len(data) - k].astype(np.uint64) << np.uint64(8 * k)
    size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    inside = np.ones(len(data), bool)
    starts = np.cumsum(size + depth) - size - depth
    inside[(starts[:, None] + np.arange(depth)).ravel()] = False
    return out[inside], np.concatenate(([0], np.cumsum(size)))


def normalised(text: bytes) -> bytes:
    """Lower-cased words joined by single spaces, then an end: the text as a sequence of tokens."""
    return b" ".join(text.translate(_LOWER).split()) + bytes([_WORD_END])


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the tokens of normalised texts (a document's end is a token too), and documents' edges."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    last = data == _WORD_END
    stop = np.flatnonzero((data == 0x20) | last)
    start = np.concatenate(([0], stop[:-1] + 1))
    key = word_hash(data, start, stop)
    key[stop == start] = 0  # the end of a document without words
    ends = last[stop]
    # words, and after each document's last word its end
    out = np.insert(key, np.flatnonzero(ends) + 1, np.uint64(1)) if len(key) else key
    out = out[out != 0]
    counts = np.fromiter((t.count(b" ") + (len(t) > 1) + 1 for t in texts), np.int64, len(texts))
    return out, np.concatenate(([0], np.cumsum(counts)))


def is_held_out(ids) -> list[bool]:
    return [k is not None and zlib.crc32(str(k).encode()) % 10 == 0 for k in ids]


def _runs_of_bytes(texts: list[bytes], most: int = 2_000_000):
    """Slices of about `most` bytes."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (size == 0 or size + len(texts[to]) <= most):
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


GRAM, TOKEN = 0, 1


def _lookups(batches, depth: int):
    """Of each bucket: its distinct grams and tokens with their counts in training documents."""

    def merged(parts):
        return _sum_by(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

    def emit(bucket, have):
        for kind in (GRAM, TOKEN):
            key, n = merged(have[kind])
            for at in range(0, len(key), 200_000):
                k = key[at : at + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), bucket)), pa.array(np.full(len(k), kind, np.int8)), pa.array(k.view(np.int64)), pa.array(n[at : at + 200_000])], ["bucket", "kind", "key", "n"])

    now, have = None, {}
    for b in batches:
        buckets, out = b.column(0).to_numpy(), np.array(b.column(1).to_pylist(), bool)
        texts = as_bytes(b.column(2))
        for lo, hi in _runs_of_bytes(texts):
            for cut in np.split(np.arange(lo, hi), np.flatnonzero(np.diff(buckets[lo:hi])) + 1):
                if buckets[cut[0]] != now:
                    if now is not None:
                        yield from emit(now, have)
                    now, have = int(buckets[cut[0]]), {GRAM: [], TOKEN: []}
                own = [texts[i] for i in cut]
                for kind, (keys, edges) in ((GRAM, byte_grams(own, depth)), (TOKEN, word_keys(own))):
                    train = np.repeat(~out[cut], np.diff(edges))
                    have[kind].append(_count_by(keys, train) if kind == GRAM and depth < 7 else _sum_by(keys, train.astype(np.int64)))
                    if len(have[kind]) > 8:
                        have[kind] = [merged(have[kind])]
    if now is not None:
        yield from emit(now, have)


def score(docs: DataFrame, depth: int = DEPTH, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score, bytes_coded, bits_per_byte.

    The text is coded as its lower-cased words, joined by single spaces, and an end. Each byte is eight binary
    decisions; each decision has a context tree over the `depth` bytes before it. Its nodes hold counts from all
    documents whose crc32(id) mod 10 isn't 0; a node's Krichevsky-Trofimov estimate and its children's product are
    weighted half and half, which gives the mixture over all depths that scores the text. Nothing is learned while scoring.

    No task sees all statistics: texts are numbered into buckets of bucket_bytes; a bucket asks for its own distinct
    grams and tokens, counts are added up by key, trees are solved in parts that share the last three context bytes,
    and each bucket gets the answers to its own questions. Only the depths above are broadcast, if they have TOP_NODES
    nodes at most; else roots are two bytes and what is broadcast has 65,535 nodes at most.

    Null and empty texts are the end alone. A null id is never held out. Rows repeating an id are rows of their own.
    If no training document exists every probability is that of an empty tree, and base_score is null without tokens.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    base = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))

    def number(batches):
        from pyspark import TaskContext

        context, seen = TaskContext.get(), 0
        task = (context.partitionId() if context else 0) << 24
        for b in batches:
            texts = [normalised(t) for t in as_bytes(b.column(1))]
            ids = b.column(0).to_pylist()
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            bucket = task + (seen + np.cumsum(sizes) - sizes) // bucket_bytes
            seen += int(sizes.sum())
            tokens = [t.count(b" ") + (len(t) > 1) + 1 for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(is_held_out(ids)), pa.array(texts, pa.binary()), b.column(0), pa.array(tokens, pa.int64())], ["bucket", "held_out", "text", "id", "n_tokens"])

    texts = written(base.mapInArrow(number, f"bucket long, held_out boolean, text binary, id {id_type}, n_tokens long"), "lm-texts")
    asked = texts.select("bucket", "held_out", "text").mapInArrow(lambda batches: _lookups(batches, depth), "bucket long, kind byte, key long, n long")
    asked = written(asked, "lm-asked")

    # tokens: an answer goes only where others have counted too, or else the bucket's own count is the whole count
    tokens = asked.where(F.col("kind") == TOKEN)
    totals = tokens.groupBy("key").agg(F.sum("n").alias("total"), F.count("*").alias("asks"))
    train, distinct = totals.agg(F.sum("total"), F.count(F.when(F.col("total") > 0, 1))).first()
    train, distinct = train or 0, distinct or 0
    shared = tokens.select("bucket", "key").join(totals.where("asks > 1"), "key").select("bucket", F.lit(TOKEN).cast("byte").alias("kind"), "key", F.col("total").cast("double").alias("value"))

    grams = written(asked.where(F.col("kind") == GRAM).groupBy("key").agg(F.sum("n").alias("n")), "lm-grams")
    parts = max(4 * partitions(spark), grams.count() // PART_GRAMS)
    top, lowest = _top(grams, depth, parts)
    sent = spark.sparkContext.broadcast(top)

    def solve(t: pa.Table) -> pa.Table:
        gram, n = t["key"].to_numpy().view(np.uint64), t["n"].to_numpy()
        tree = levels(gram, n, depth, lowest) | {d: x for d, x in sent.value.items() if d < lowest}
        return pa.table({"key": t["key"], "value": log10_symbols(gram, tree)})

    solved = _by_root(grams, lowest, parts).applyInArrow(solve, "key long, value double")
    answers = asked.where(F.col("kind") == GRAM).select("bucket", "kind", "key").join(solved, "key").select("bucket", "kind", "key", "value").unionByName(shared)
    answers = written(answers, "lm-answers")
    drop(asked, grams)

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        own = as_bytes(left["text"])
        out = np.array(left["held_out"].to_pylist(), bool)
        kind, key, value = right["kind"].to_numpy(), right["key"].to_numpy().view(np.uint64), right["value"].to_numpy()
        grams = Lookup(key[kind == GRAM], value[kind == GRAM])
        order = np.argsort(key[kind == TOKEN])
        shared_keys, shared_counts = key[kind == TOKEN][order], value[kind == TOKEN][order]
        runs = list(_runs_of_bytes(own))
        mine = []
        for lo, hi in runs:
            keys, edges = word_keys(own[lo:hi])
            mine.append(_sum_by(keys, np.repeat(~out[lo:hi], np.diff(edges)).astype(np.int64)))
        tokens, count = _sum_by(*(np.concatenate(x) for x in zip(*mine)))
        if len(shared_keys):
            at = np.minimum(np.searchsorted(shared_keys, tokens), len(shared_keys) - 1)
            count = np.where(shared_keys[at] == tokens, shared_counts[at].astype(np.int64), count)
        logs = np.log10((count + 0.1) / (train + 0.1 * (distinct + 1)))
        base_score, scores = np.zeros(len(own)), np.zeros(len(own))
        known, sizes = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        for lo, hi in runs:
            keys, edges = word_keys(own[lo:hi])
            at, which = np.searchsorted(tokens, keys), np.repeat(np.arange(hi - lo), np.diff(edges))
            base_score[lo:hi] = np.bincount(which, logs[at], hi - lo)
            known[lo:hi] = np.bincount(which, count[at] > 0, hi - lo)
            gram, edges = byte_grams(own[lo:hi], depth)
            scores[lo:hi] = np.add.reduceat(grams[gram], edges[:-1])  # each text has its end at least
            sizes[lo:hi] = np.diff(edges)
        return pa.table({"id": left["id"], "held_out": left["held_out"], "n_tokens": left["n_tokens"], "n_known": known, "train_tokens": np.full(len(own), train), "base_score": base_score, "score": scores, "bytes_coded": sizes, "bits_per_byte": scores / -np.log10(2) / sizes})

    schema = f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bytes_coded long, bits_per_byte double"
    return texts.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(apply, schema)


def _by_root(grams: DataFrame, root: int, parts: int):
    """grams in groups that hold whole subtrees: what has the last `root` bytes of its context in common."""
    last = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << 8 * root) - 1))
    return grams.groupBy(F.pmod(F.xxhash64(last), F.lit(parts)).alias("part"))


def _top(grams: DataFrame, depth: int, parts: int) -> tuple[dict[int, Level], int]:
    """The depths above the roots, and the roots' depth: 3, or 2 where depth 2 has too many nodes to be sent around."""

    def fold(root: int):
        def run(t: pa.Table) -> pa.Table:
            own = levels(t["key"].to_numpy().view(np.uint64), t["n"].to_numpy(), depth, root)[root]
            up = parents(own.key, own.zeros, own.ones, own.weighted, root - 1, whole=False)
            return pa.table(dict(zip(("node", "zeros", "ones", "weighted"), (up[0].view(np.int64), *up[1:]))))

        nodes = _by_root(grams, root, parts).applyInArrow(run, "node long, zeros long, ones long, weighted double")
        return nodes.groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("weighted"))

    def level(nodes: DataFrame) -> Level:
        got = nodes.orderBy("node").toArrow()
        return Level(got["node"].to_numpy().astype(np.uint64), got["zeros"].to_numpy(), got["ones"].to_numpy(), got["weighted"].to_numpy())

    out, root = {}, min(2, depth)
    if depth >= 3:
        two = written(fold(3), "lm-nodes")
        if two.count() <= TOP_NODES:
            out[2], root = level(two), 3
        drop(two)
    out[1] = parents(out[2].key, out[2].zeros, out[2].ones, out[2].weighted, 1) if root == 3 else level(fold(2))  # 256 contexts of 255 nodes at most
    out[0] = parents(out[1].key, out[1].zeros, out[1].ones, out[1].weighted, 0)
    return out, root


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(table(spark, sf_dir, "documents"))
    return out.withColumnRenamed("id", "doc_id")
