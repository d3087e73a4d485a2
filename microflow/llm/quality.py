"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from microflow.llm.common import _LOWER, as_bytes, col, free, mix64, table, word_hashes, written

#: Hash buckets of each kind of n-gram: words, pairs of neighbouring words, GRAM bytes in a row.
PER_KIND, KINDS, GRAM = 1 << 19, 3, 5
BUCKETS = PER_KIND * KINDS
#: Labelled rows that the target model and the cut are fitted on, at most.
LABELLED = 20_000


def features(texts: list[bytes]):
    """Runs of (first, last, document of each feature, its bucket). A word's third time in a row is one feature for all words."""
    size = np.uint64(PER_KIND)
    for first, last, doc, h, start, end in word_hashes(texts, 1 << 20):
        pair = doc[1:] == doc[:-1]
        same = (h[1:] == h[:-1]) & pair
        third = same & np.concatenate(([False], same[:-1])) if len(same) else same
        two = np.where(third, np.uint64(1), mix64(h[:-1] * np.uint64(31) + mix64(h[1:])))[pair]
        data = np.frombuffer(b" ".join(texts[first:last]).translate(_LOWER), np.uint8)
        grams = np.zeros(max(0, len(data) - GRAM + 1), np.uint64)
        for k in range(GRAM):
            grams = (grams << np.uint64(8)) | data[k : k + len(grams)]
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts[first:last]), np.int64, last - first))
        of = np.repeat(np.arange(last - first), np.diff(ends, prepend=0))[: len(grams)]
        whole = np.arange(GRAM, len(grams) + GRAM) < ends[of]  # grams across two texts belong to none
        yield first, last, np.concatenate((doc, doc[1:][pair], of[whole])), np.concatenate((h % size, two % size + size, mix64(grams[whole]) % size + 2 * size)).astype(np.int64)


#: Kinds of labelled text.
GOOD, POOR, TOXIC = 0, 1, 2


def labelled(labels: DataFrame, id_col: str = "doc_id") -> dict:
    """id to its kind (good: quality 1 and not toxic by all its labels), of LABELLED rows in hash order."""
    one = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return {r.id: TOXIC if r.t else GOOD if r.q == 1 else POOR for r in one.orderBy(F.xxhash64("id"), "id").limit(LABELLED).collect()}


def evidence(counted: np.ndarray, expected: np.ndarray, shrink: float = 0.5, errors: float = 3.0) -> np.ndarray:
    """The log ratio of counted to expected, shrunk by how many standard errors (signed root of the deviance) it is off 0."""
    logs = np.log(np.maximum(counted, 1) / np.where(expected > 0, expected, 1))
    deviance = 2 * (np.where(expected > 0, counted * logs, 0) - (counted - expected))
    return np.log((counted + shrink) / (expected + shrink)) * np.maximum(0, 1 - errors**2 / np.maximum(deviance, 1e-9))


def log_ratio(base: DataFrame, known: dict) -> np.ndarray:
    """log p_target - log p_raw per bucket; raw counts are of all documents, target counts of labelled target text.

    Counts are of documents, so that one text's repeats prove nothing. The target model is the raw one, corrected where
    labelled text has evidence: ratios within three standard errors (given the labelled size) stay neutral, beyond they
    count the more the surer they are. Thus a document's length alone moves nothing. An n-gram that labelled target text
    never holds counts if it would be expected in 4.5 of its documents.
    """
    target = base.sparkSession.sparkContext.broadcast({k for k, kind in known.items() if kind == GOOD})

    def count(batches):
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), as_bytes(b.column(1))
            own = np.array([k in target.value for k in ids], bool)
            for first, _, doc, bucket in features(texts):
                seen = np.sort(doc << 21 | bucket)  # sorting is much faster than np.unique; BUCKETS < 1 << 21
                seen = seen[np.diff(seen, prepend=-1) > 0]
                doc, bucket = seen >> 21, seen & ((1 << 21) - 1)
                raw += np.bincount(bucket, minlength=BUCKETS)
                good += np.bincount(bucket[own[first + doc]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good[at])], ["bucket", "raw", "good"])

    rows = base.mapInArrow(count, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow()
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = rows["bucket"].to_numpy()
    raw[at], good[at] = rows["raw"].to_numpy(), rows["good"].to_numpy()
    if not good.sum():
        return np.zeros(BUCKETS)
    out = np.zeros(BUCKETS)
    for kind in range(KINDS):  # a model each
        part = slice(kind * PER_KIND, (kind + 1) * PER_KIND)
        r, g = raw[part], good[part]
        expected = r * (g.sum() / r.sum()) if r.sum() else r
        out[part] = evidence(g, expected)
    return out


def kth_largest(scored: DataFrame, k: int, column: str = "key", bins: int = 4096) -> float:
    """The exact k-th largest value of a column: histograms of ever narrower ranges, `bins` counts each."""
    lo, hi = scored.agg(F.min(column), F.max(column)).first()
    while lo < hi and (width := (hi - lo) / bins) > 0:
        inside = scored.where(F.col(column).between(lo, hi))
        counts = inside.groupBy(F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1)).alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for r in sorted(counts, key=lambda r: -r.b):
            if r.n >= k:
                lo, hi = r.lo, r.hi
                break
            k -= r.n
    return lo


def score(docs: DataFrame, labels: DataFrame, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", temperature: float = 1.0) -> DataFrame:
    """id, log_weight (of importance), key (with Gumbel noise) and kept.

    log_weight is the sum of the log ratios of target to raw model over a document's n-grams. The cut that parts
    labelled target rows best from the poor and the toxic ones gives k, the number of documents above it; the k
    documents of largest log_weight / temperature plus seeded Gumbel noise stay: a sample without replacement in
    proportion to the importance weights (tempered, if temperature isn't 1).

    Null and empty texts have no features and weight 0. Without labelled target rows nothing can be told apart and
    every document stays. Rows repeating an id share the noise; equal rows stay or go together. Ties at the cut stay.
    """
    spark = docs.sparkSession
    base = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    known = labelled(labels)
    # the models learn from one half of the labelled rows, the cut from the other
    even = {k: kind for k, kind in known.items() if zlib.crc32(str(k).encode()) % 2 == 0}
    odd = {k: kind for k, kind in known.items() if k not in even}
    ratio = log_ratio(base, even)
    sent = spark.sparkContext.broadcast(ratio.astype(np.float32))

    def weigh(batches):
        for b in batches:
            texts = as_bytes(b.column(1))
            total = np.zeros(len(texts))
            for first, last, doc, bucket in features(texts):
                total[first:last] = np.bincount(doc, sent.value[bucket], last - first)[: last - first]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total)], ["id", "log_weight"])

    scored = base.mapInArrow(weigh, f"id {base.schema['id'].dataType.simpleString()}, log_weight double")
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    scored = written(scored.withColumn("key", F.col("log_weight") / temperature - F.log(-F.log(uniform))), "quality-scores")
    if GOOD not in even.values() or GOOD not in odd.values() or all(kind == GOOD for kind in odd.values()):
        return scored.withColumn("kept", F.lit(True))
    marks = spark.createDataFrame(list(odd.items()), f"id {base.schema['id'].dataType.simpleString()}, kind int")
    # one row a label, however often its id repeats
    rows = scored.join(F.broadcast(marks), "id").groupBy("id", "kind").agg(F.min("log_weight").alias("log_weight")).toPandas()
    cut = best_cut(rows.log_weight.to_numpy(), rows.kind.to_numpy())
    k = scored.where(F.col("log_weight") > cut).count()
    if k == 0:
        return scored.withColumn("kept", F.lit(False))
    return scored.withColumn("kept", F.col("key") >= F.lit(kth_largest(scored, k)))


def best_cut(weight: np.ndarray, kind: np.ndarray) -> float:
    """The cut of least error: twice the share of good text below it and, of poor and toxic text, the larger share above it.

    Of equally good cuts the middle one; the one that keeps all if no cut tells anything.
    """
    order = np.argsort(weight, kind="stable")
    w, kind = weight[order], kind[order]
    below = {k: np.concatenate(([0], np.cumsum(kind == k))) / max(1, (kind == k).sum()) for k in (GOOD, POOR, TOXIC)}
    left = np.max([1 - below[k] for k in (POOR, TOXIC) if (kind == k).any()] or [np.ones(len(w) + 1)], axis=0)
    error = np.where(np.concatenate(([True], w[1:] != w[:-1], [True])) if len(w) else True, 2 * below[GOOD] + left, np.inf)  # no cut parts equal weights
    best = np.flatnonzero(error <= error.min() + 1e-12)
    if error.min() >= 1 - 1e-12:  # nothing is told apart
        best = best[:1]
    edge = np.concatenate(([w[0] - 1], (w[1:] + w[:-1]) / 2, [w[-1] + 1])) if len(w) else np.zeros(1)
    return float(edge[best[len(best) // 2]])


def filter_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """docs without the documents that the classifier rejects; all columns stay, whatever their names.

    Rows with a null id stay; rows that repeat an id go together if one of them is rejected. Without labelled target
    rows all stay.
    """
    name = free("rejected", docs)
    gone = score(docs.select(col(id_col).alias("id"), col(text_col).alias("text")), labels, seed, "id", "text").where(~F.col("kept")).select(F.col("id").alias(name)).distinct()
    return docs.join(gone, col(id_col) == F.col(name), "left_anti")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")
