"""N-gram Jaccard join: a blocked sparse product of the document by shingle incidence, with size-derived bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from microflow.llm.common import as_bytes, col, drop, free, mix64, partitions, table, word_hashes, written

#: Shingles whose rank is sent to all tasks, at most; which ones are sent changes the speed only, not the result.
RANKED = 2_000_000
#: Ids of documents to fetch that are broadcast at most; more are fetched by a shuffled join.
BROADCAST_IDS = 1_000_000
#: Lists of so many texts go through leaders before their texts are paired.
LONG_LIST = 24
#: Texts of one least shingle that are compared in blocks instead of pair by pair, and a block's texts.
FAMILY, BLOCK = 16, 256
#: A list's texts that one task of the sparse product takes of either side.
LIST_PART = 512
#: Longs of a set's parity sketch; sets of WIDE_FROM shingles have another one of WIDE longs.
SKETCH, WIDE, WIDE_FROM = 8, 128, 1000
#: Longs that a sketch is folded to in the sparse product; with fewer, sets of some hundred shingles that share one by accident pass.
FOLDED = 4
#: Entries of lists that one task of the sparse product takes, about.
UNIT = 20_000
_SCALE = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes], words: int = 4):
    """(number of the text, its distinct shingles' 64-bit hashes in order) for texts that have words."""
    for first, _, doc, h, _, _ in word_hashes(texts):
        n = len(h)
        if not n:
            continue
        s = np.zeros(max(0, n - words + 1), np.uint64)
        for k in range(words):
            s = mix64(s * _SCALE + h[k : k + len(s)])
        edges = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1], [True])))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if b - a >= words:
                yield first + int(doc[a]), np.unique(s[a : b - words + 1])
            else:
                x = np.full(1, b - a, np.uint64)
                for y in h[a:b]:
                    x = mix64(x * _SCALE + y)
                yield first + int(doc[a]), x


def set_class(u: np.ndarray) -> int:
    """A 64-bit name for a set of shingles; equal sets have equal names."""
    with np.errstate(over="ignore"):
        return int(mix64(np.array([u.sum(dtype=np.uint64) * _SCALE + mix64(u ^ _SCALE).sum(dtype=np.uint64)], np.uint64)).view(np.int64)[0])


def parities(u: np.ndarray, longs: int = SKETCH) -> np.ndarray:
    """A sketch of a power of two of longs: bit i is the parity of the shingles that fall to i.

    Sets differ in as many shingles as their sketches in bits at least, also once several longs are folded into one.
    """
    bits = 64 * longs
    return np.packbits(np.bincount((u >> np.uint64(65 - bits.bit_length())).astype(np.int64), minlength=bits).astype(np.uint8) & 1).view(np.int64)


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the component's smallest node) of the graph of edges (a, b), by alternating large and small stars."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        seen = tuple(now)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")


class Join:
    """The join of one table of documents with itself."""

    def __init__(self, docs: DataFrame, percent: int, words: int, id_col: str, text_col: str):
        self.docs = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
        self.percent, self.words = percent, words
        self.id_type = self.docs.schema["id"].dataType.simpleString()
        self.spark = docs.sparkSession
        self.folds = [f"x{i}" for i in range(FOLDED)]

    def classes(self) -> tuple[DataFrame, DataFrame]:
        """Per document its set's size and name; and the shingles that some part of the input holds several times.

        self.sets is made beside: (cls, n, sketch, wide) of every set.
        """
        words = self.words

        def scan(batches):
            held, size = [], 0
            names, long_list = ["id", "n", "key", "shingle", "sketch", "wide"], pa.list_(pa.int64())

            def frequent():
                s, n = np.unique(np.concatenate(held), return_counts=True)
                s, n = s[n >= 4], n[n >= 4]
                return pa.RecordBatch.from_arrays([pa.nulls(len(s), id_type), pa.array(n), pa.array(s.view(np.int64)), pa.array(np.ones(len(s), bool)), pa.nulls(len(s), long_list), pa.nulls(len(s), long_list)], names)

            id_type = pa.int64()
            for b in batches:
                id_type = b.schema.field(0).type
                n, key, sketch = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, SKETCH), np.int64)
                wide = [None] * b.num_rows
                for i, u in shingle_sets(as_bytes(b.column(1)), words):
                    n[i], key[i], sketch[i] = len(u), set_class(u), parities(u)
                    if len(u) >= WIDE_FROM:
                        wide[i] = parities(u, WIDE)
                    held.append(u)
                    size += len(u)
                    if size > 4_000_000:
                        yield frequent()
                        held, size = [], 0
                lists = pa.ListArray.from_arrays(np.arange(0, sketch.size + 1, SKETCH, dtype=np.int32), sketch.ravel())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(key), pa.array(np.zeros(b.num_rows, bool)), lists, pa.array(wide, long_list)], names)
            if held:
                yield frequent()

        rows = written(self.docs.mapInArrow(scan, f"id {self.id_type}, n long, key long, shingle boolean, sketch array<long>, wide array<long>"), "shingle-classes")
        found = rows.where(~F.col("shingle"))
        self.sets = written(found.where("n > 0").groupBy(F.col("key").alias("cls")).agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide")), "shingle-sets")
        return found.select("id", "n", F.col("key").alias("cls")), rows.where("shingle").select("key", "n")

    def postings(self, frequent: DataFrame) -> DataFrame:
        """Incidence of the rows' prefixes: (s, cls, n, pos, m). Frequent shingles come last in every row's order.

        A set of n shingles needs ceil(percent n / 100) of them in common with any partner, so one of its first
        n - ceil(...) + 1 is common to both. Columns with one set only can't join and are left out; m: entries of s.
        """
        often = frequent.groupBy(F.col("key").alias("s")).agg(F.sum("n").alias("df")).orderBy(F.desc("df"), "s").limit(RANKED).toArrow()
        s = often["s"].to_numpy().view(np.uint64)
        order = np.argsort(s)
        sent = self.spark.sparkContext.broadcast((s[order], (len(s) - order).astype(np.int64)))
        words, percent = self.words, self.percent

        def scan(batches):
            hot, rank = sent.value
            seen: set[int] = set()
            for b in batches:
                parts = []
                for _, u in shingle_sets(as_bytes(b.column(1)), words):
                    key, n = set_class(u), len(u)
                    if key in seen:
                        continue
                    if len(seen) < 1_000_000:  # beyond it, repeats go out and meet at the shingle
                        seen.add(key)
                    p = n + (-percent * n // 100) + 1
                    if len(hot):
                        at = np.minimum(np.searchsorted(hot, u), len(hot) - 1)
                        is_hot = hot[at] == u
                        if is_hot.any():
                            late = u[is_hot][np.argsort(rank[at[is_hot]], kind="stable")]
                            u = np.concatenate((u[~is_hot], late))
                    parts.append((u[:p], key, n, p))
                if parts:
                    many = [x[3] for x in parts]
                    pos = np.arange(sum(many)) - np.repeat(np.cumsum(many) - many, many)
                    cols = [np.concatenate([x[0] for x in parts]).view(np.int64), np.repeat(np.array([x[1] for x in parts]), many), np.repeat(np.array([x[2] for x in parts], np.int32), many), pos.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["s", "cls", "n", "pos"])

        own = Window.partitionBy("s").orderBy("cls")
        whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = self.docs.mapInArrow(scan, "s long, cls long, n int, pos int")
        rows = rows.select("*", F.lag("cls").over(own).alias("before"), F.min("cls").over(whole).alias("lo"), F.max("cls").over(whole).alias("hi"), F.count("*").over(whole).alias("m"))
        return written(rows.where("lo <> hi and (before is null or before <> cls)").select("s", "cls", "n", "pos", "m"), "postings")

    def sized(self, a: str, b: str):
        """Whether two sizes allow the similarity at all."""
        return 100 * F.least(a, b) >= self.percent * F.greatest(a, b)

    def ranges(self, la: str, ha: str, lb: str, hb: str):
        """Whether sizes of la to ha and of lb to hb allow the similarity at all."""
        return (100 * F.col(ha) >= self.percent * F.col(lb)) & (100 * F.col(hb) >= self.percent * F.col(la))

    def texts(self, nodes: DataFrame, classes: DataFrame) -> DataFrame:
        """(cls, text) of one document of each class; a repeated id may bring other texts along."""
        reps = written(classes.join(nodes.distinct(), "cls", "left_semi").groupBy("cls").agg(F.min(F.xxhash64("id")).alias("k")), "representatives")
        return self.docs.withColumn("k", F.xxhash64("id")).join(F.broadcast(reps) if reps.count() <= BROADCAST_IDS else reps, "k").select("cls", "text")

    def linked(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are similar enough, by the overlap of their whole sets.

        Sets whose parity sketches differ in more bits than the sets may differ in shingles aren't looked at.
        """
        left, right = (self.sets.select(F.col("cls").alias(c), F.col("n").alias("n" + c), F.col("sketch").alias("k" + c), F.col("wide").alias("w" + c)) for c in "ab")
        differ = lambda x, y: (100 + self.percent) * F.expr(f"aggregate(zip_with({x}, {y}, (x, y) -> bit_count(x ^ y)), 0, (s, n) -> s + n)") <= (100 - self.percent) * (F.col("na") + F.col("nb"))
        pairs = pairs.join(left, "a").join(right, "b").where(differ("ka", "kb") & F.coalesce(differ("wa", "wb"), F.lit(True))).select("a", "b")
        pairs = written(pairs, "close-pairs")
        nodes = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
        # texts are a fraction of their sets' size, so they travel and the sets are made where a pair meets
        texts = written(self.texts(nodes, classes), "pair-texts")
        both = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("cls").alias("b"), F.col("text").alias("y")), "b")
        words, percent = self.words, self.percent

        def compare(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 200):
                    b = batch.slice(at, 200)
                    left, right = (dict(shingle_sets(as_bytes(b.column(c)), words)) for c in (2, 3))
                    keep = []
                    for i, (one, two) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                        x, y = left.get(i), right.get(i)
                        # a repeated id may have brought another row's text
                        if x is not None and y is not None and set_class(x) == one and set_class(y) == two:
                            common = len(np.intersect1d(x, y, assume_unique=True))
                            if 100 * common >= percent * (len(x) + len(y) - common):
                                keep.append(i)
                    if keep:
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), b.column(1).take(pa.array(keep))], ["a", "b"])

        return both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")

    def blocks(self, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Of the open lists: (cls, big, x0, x1, ...) of all sets, with their folded sketches; (unit, part, cls, n, comp), sets in parts; (ua, pa, ub, pb), parts to compare.

        Sets with one least shingle are a family, a unit of its own, if there are many of them. The sets outside of
        families that share a list with one are its guests, another unit. Units are cut into parts of BLOCK sets in the
        order of component and size. A family meets itself, its guests and the families it shares a list with; of
        their parts, those don't meet that belong to one component or whose sizes differ too much.
        """
        sets = rows.groupBy("cls").agg(F.min(F.struct("pos", "s"))["s"].alias("least"), F.first("n").alias("n"), F.first("comp").alias("comp"))
        size = SKETCH // FOLDED
        folded = [F.expr(f"aggregate(slice(sketch, {i * size + 1}, {size}), 0L, (s, x) -> s ^ x)").alias(x) for i, x in enumerate(self.folds)]
        sizes = sets.groupBy("least").agg(F.count("*").alias("m")).where(F.col("m") >= FAMILY)
        sets = written(sets.join(sizes, "least", "left").select("cls", "least", "n", "comp", F.col("m").isNotNull().alias("big")).join(self.sets.select("cls", *folded), "cls"), "families")
        known = rows.select("s", "cls", "n").join(sets.select("cls", F.when(F.col("big"), F.col("least")).alias("family")), "cls")
        # similar sets meet in a list in which their sizes allow it
        hosts = known.where("family is not null").groupBy("s", F.col("family").alias("ua")).agg(F.min("n").alias("la"), F.max("n").alias("ha"))
        families = hosts.join(hosts.select("s", F.col("ua").alias("ub"), F.col("la").alias("lb"), F.col("ha").alias("hb")), "s").where((F.col("ua") <= F.col("ub")) & self.ranges("la", "ha", "lb", "hb")).select("ua", "ub").distinct()
        guests = hosts.join(known.where("family is null").select("s", "cls", "n"), "s").where(self.ranges("la", "ha", "n", "n")).select("ua", "cls").distinct()
        guest_unit = F.xxhash64(F.lit("guests"), F.col("ua"))
        order = Window.partitionBy("unit").orderBy("comp", "n", "cls")
        members = sets.where("big").select(F.col("least").alias("unit"), "cls", "n", "comp").unionByName(guests.join(sets, "cls").select(guest_unit.alias("unit"), "cls", "n", "comp"))
        members = written(members.withColumn("part", F.floor((F.row_number().over(order) - 1) / BLOCK).cast("int")), "parts")
        meet = families.unionByName(guests.select("ua", guest_unit.alias("ub")).distinct())
        parts = members.groupBy("unit", "part").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
        left = parts.select(*[F.col(c).alias(c + "a") for c in ("unit", "part", "lo", "hi", "c0", "c1")])
        right = parts.select(*[F.col(c).alias(c + "b") for c in ("unit", "part", "lo", "hi", "c0", "c1")])
        both = meet.join(left, meet.ua == left.unita).join(right, meet.ub == right.unitb).where("ua <> ub or parta <= partb")
        one = (F.col("c0a") == F.col("c1a")) & (F.col("c0b") == F.col("c1b")) & (F.col("c0a") == F.col("c0b"))
        return sets.select("cls", "big", *self.folds), members, both.where(~one & self.ranges("loa", "hia", "lob", "hib")).select("ua", F.col("parta").alias("pa"), "ub", F.col("partb").alias("pb"))

    def product(self, members: DataFrame, tasks: DataFrame, classes: DataFrame) -> DataFrame:
        """Links (a, b) between components within pairs of parts, by the product of their incidence matrices.

        Parts meet as parity sketches first. Texts go only to the tasks in which their set may have a partner: sets that
        share a common shingle by accident are many, and meet as many others as the square of the input.
        """
        tasks = written(tasks.withColumn("task", F.xxhash64("ua", "pa", "ub", "pb")), "part-pairs")
        used = tasks.select(F.col("ua").alias("unit"), F.col("pa").alias("part"), "task", F.lit(0).alias("side")).unionByName(tasks.select(F.col("ub").alias("unit"), F.col("pb").alias("part"), "task", F.lit(1).alias("side")))
        words, percent = self.words, self.percent

        def meeting(t: pa.Table) -> pa.Table:
            side, n, comp = t["side"].to_numpy(), t["n"].to_numpy().astype(np.int64), t["comp"].to_numpy()
            sketch = t["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH)
            wide = {i: np.array(x, np.int64).view(np.uint64) for i, x in enumerate(t["wide"].to_pylist()) if x is not None}
            keep = np.zeros(len(side), bool)
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            for i in left.tolist():
                differ = np.bitwise_count(sketch[i] ^ sketch[right]).sum(axis=1, dtype=np.int64)
                low, high = np.minimum(n[i], n[right]), np.maximum(n[i], n[right])
                ok = right[(comp[i] != comp[right]) & (100 * low >= percent * high) & ((100 + percent) * differ <= (100 - percent) * (low + high))]
                if i in wide:
                    ok = ok[[j not in wide or (100 + percent) * int(np.bitwise_count(wide[i] ^ wide[j]).sum(dtype=np.int64)) <= (100 - percent) * (n[i] + n[j]) for j in ok.tolist()]] if len(ok) else ok
                if len(ok):
                    keep[i] = keep[ok] = True
            return t.select(["task", "side", "cls", "comp"]).filter(pa.array(keep))

        sketches = members.select("unit", "part", "cls", "n", "comp").join(self.sets.select("cls", "sketch", "wide"), "cls")
        met = sketches.join(used, ["unit", "part"]).select("task", "side", "cls", "n", "comp", "sketch", "wide")
        met = written(met.groupBy("task").applyInArrow(meeting, "task long, side int, cls long, comp long"), "part-sets")
        texts = written(self.texts(met.select("cls"), classes), "part-texts")

        def multiply(t: pa.Table) -> pa.Table:
            side = t["side"].to_numpy()
            names, comps = t["cls"].to_numpy(), t["comp"].to_numpy()
            made = dict(shingle_sets(as_bytes(t["text"]), words))
            rows = [[i for i in np.flatnonzero(side == k) if i in made and set_class(made[i]) == names[i]] for k in (0, 1)]
            if not rows[0] or not rows[1]:
                return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
            shared = np.intersect1d(*[np.unique(np.concatenate([made[i] for i in r])) for r in rows])
            n = [np.array([len(made[i]) for i in r]) for r in rows]
            common = np.zeros((len(rows[0]), len(rows[1])), np.float32)
            for at in range(0, len(shared), 20_000):  # a slice of the columns at a time
                cols = shared[at : at + 20_000]
                m = []
                for r in rows:
                    x = np.zeros((len(r), len(cols)), np.float32)
                    for j, i in enumerate(r):
                        k = np.minimum(np.searchsorted(cols, made[i]), len(cols) - 1)
                        x[j, k[cols[k] == made[i]]] = 1
                    m.append(x)
                common += m[0] @ m[1].T
            similar = 100 * common.astype(np.int64) >= percent * (n[0][:, None] + n[1][None, :] - common.astype(np.int64))
            x, y = np.array(rows[0]), np.array(rows[1])
            similar &= comps[x][:, None] != comps[y][None, :]
            # a link a pair of components is enough: their sets hang together anyway
            out = set()
            for i, j in zip(*np.nonzero(similar)):
                out.add((comps[x[i]], comps[y[j]]))
            return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

        placed = met.join(texts, "cls").select("task", "side", "cls", "comp", "text")
        return placed.groupBy("task").applyInArrow(multiply, "a long, b long")

    def overlaps(self, rows: DataFrame) -> DataFrame:
        """(a, b, na, nb, c, pa, pb): the sparse product of open lists; c: prefix shingles in common, the last at pa and pb.

        The incidence matrix is cut into blocks of columns, the lists with one first text, which near copies share; a
        task multiplies some blocks and adds up a pair's overlap over their lists. Lists of more than LIST_PART texts are
        cut into parts and their block into a task for each two parts. Pairs of one component, and pairs that their
        sizes, their places in the order or their folded sketches don't allow, aren't made.
        """
        percent, folds = self.percent, self.folds
        whole = Window.partitionBy("s")
        # written, as it is read three times, and the shuffles that made it go before the next ones are made
        rows = written(rows.withColumn("block", F.min("cls").over(whole)).withColumn("m", F.count("*").over(whole)).where("m > 1"), "block-lists")
        units = max(4 * partitions(self.spark), rows.count() // UNIT)
        many = rows.where(F.col("m") > LIST_PART).groupBy("block").agg(F.ceil(F.max("m") / LIST_PART).cast("int").alias("parts"))
        rows = rows.join(many, "block", "left").withColumn("unit", F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("block"), F.lit(units))).otherwise(F.col("block")))
        rows = rows.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("cls"), "parts").cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = rows.select("s", "cls", "n", "pos", "comp", *folds, "part", "unit", F.least("part", "other").alias("pi"), F.greatest("part", "other").alias("pj"))

        def multiply(t: pa.Table) -> pa.Table:
            s, cls, n, pos, comp, part = (t[c].to_numpy() for c in ("s", "cls", "n", "pos", "comp", "part"))
            order = np.lexsort((cls, s))
            s, n, pos, part, comp = s[order], n[order].astype(np.int64), pos[order].astype(np.int64), part[order], comp[order]
            sketches = [t[c].to_numpy()[order].view(np.uint64) for c in folds]
            sets, at = np.unique(cls[order], return_inverse=True)
            two = bool(t["pi"][0].as_py() != t["pj"][0].as_py())
            edges = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True])))
            starts, sizes = edges[:-1], np.diff(edges)
            found, size = [], 0

            def add():
                key, c, p, q = (np.concatenate(x) for x in zip(*found))
                by = np.argsort(key, kind="stable")
                key = key[by]
                new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                return [(key[new], np.add.reduceat(c[by], new), np.maximum.reduceat(p[by], new), np.maximum.reduceat(q[by], new))]

            for m in np.unique(sizes[sizes > 1]).tolist():  # all lists of one length at once
                own, (i0, j0) = starts[sizes == m], np.triu_indices(m, 1)
                step = max(1, 500_000 // len(i0))
                for k in range(0, len(own), step):
                    i, j = (own[k : k + step, None] + i0).ravel(), (own[k : k + step, None] + j0).ravel()
                    ok = comp[i] != comp[j]
                    if two:
                        ok &= part[i] != part[j]
                    i, j = i[ok], j[ok]
                    low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
                    most = np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j])
                    differ = sum(np.bitwise_count(x[i] ^ x[j]).astype(np.int64) for x in sketches)
                    ok = (100 * low >= percent * high) & ((100 + percent) * most >= percent * (low + high)) & ((100 + percent) * differ <= (100 - percent) * (low + high))
                    i, j = i[ok], j[ok]
                    if len(i):
                        found.append((at[i] * len(sets) + at[j], np.ones(len(i), np.int64), pos[i], pos[j]))
                        size += len(i)
                    if size > 2_000_000:
                        found = add()
                        size = len(found[0][0])
            names = ["a", "b", "na", "nb", "c", "pa", "pb"]
            if not found:
                return pa.table({x: pa.array([], pa.int64()) for x in names})
            key, c, p, q = add()[0]
            counts = np.zeros(len(sets), np.int64)
            counts[at] = n
            x, y = key // len(sets), key % len(sets)
            return pa.table(dict(zip(names, (sets[x], sets[y], counts[x], counts[y], c, p, q))))

        made = rows.groupBy("unit", "pi", "pj").applyInArrow(multiply, ", ".join(f"{x} long" for x in ("a", "b", "na", "nb", "c", "pa", "pb")))
        return made.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))


def jaccard_components(docs: DataFrame, percent: int = 85, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_shingles and component_id, the smallest id that links reach.

    Two documents link when their sets of distinct word shingles have a Jaccard similarity of percent/100 at least.
    Words are split at ASCII white space, A-Z lowered; with fewer words than a shingle has, the whole sequence is the
    one shingle. Null and wordless texts have no shingles and link with nothing. Null ids come last. Other columns are
    ignored. An empty table gives an empty result. Shingles are compared by 64-bit hashes.

    1. Equal sets are one class: any number of copies is one row of the incidence matrix.
    2. The prefixes of the rows, rarest shingles first, are grouped by shingle; only sets of compatible sizes can meet.
    3. Long lists: each set is checked against leaders of its lists, which joins large groups of near copies
       without pairing them all.
    4. What is left of large families, sets with one least shingle, is multiplied block by block: rows of one part of
       a family by those of another that it shares a list with.
    5. The overlap of every other pair of different components is accumulated by a sparse product over blocks of
       lists; pairs whose bound (overlap so far plus what the sizes still allow) is too small are dropped, the others
       compared set by set.
    """
    join = Join(docs, percent, words, id_col, text_col)
    classes, frequent = join.classes()
    lists = join.postings(frequent)
    edges = None
    comp = None

    def with_comp(rows: DataFrame) -> DataFrame:
        if comp is None:
            return rows.withColumn("comp", F.col("cls"))
        return rows.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))

    long_lists = lists.where(F.col("m") >= LONG_LIST)
    for turn in range(4):
        rows = with_comp(long_lists)
        lead = rows.groupBy("s").agg(F.min(F.struct(F.xxhash64("cls", F.lit(turn)).alias("h"), F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))).alias("l"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("s", "l.b", "l.nb", "l.cb")
        pairs = rows.join(lead, "s").where((F.col("comp") != F.col("cb")) & join.sized("n", "nb")).select(F.col("cls").alias("a"), "b").distinct()
        pairs = written(pairs, "leader-pairs")
        if not pairs.limit(1).count():
            break
        found = written(join.linked(pairs, classes), "links")
        n = found.count()
        edges = found if edges is None else edges.unionByName(found)
        comp = written(components(edges), "components") if n else comp
        if n * 10 < pairs.count():  # what is left is not one group of near copies
            break

    rows = with_comp(lists)
    whole = Window.partitionBy("s")
    rows = written(rows.withColumn("lo", F.min("comp").over(whole)).withColumn("hi", F.max("comp").over(whole)).where("lo <> hi").select("s", "cls", "n", "pos", "comp"), "open-lists")
    drop(lists)
    sets, members, tasks = join.blocks(rows)
    across = written(join.product(members, tasks, classes), "part-links")
    # sets outside of large families
    overlap = join.overlaps(rows.join(sets.where("not big").select("cls", *join.folds), "cls"))
    bound = F.col("c") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) - 1
    pairs = written(overlap.where((100 + percent) * bound >= percent * (F.col("na") + F.col("nb"))).select("a", "b"), "pairs")
    found = join.linked(pairs, classes).unionByName(across)
    comp = components(found if edges is None else edges.unionByName(found))

    named = classes.where("n > 0").join(comp.withColumnRenamed("node", "cls"), "cls", "left").select("id", "n", F.coalesce("comp", "cls").alias("comp"))
    least = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    out = named.join(least, "comp").select("id", "n", "component_id").unionByName(classes.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.withColumnRenamed("id", id_col).withColumnRenamed("n", "n_shingles")


def drop_near_copies(docs: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the smallest id of each component only; all columns stay, whatever their names.

    Documents without words stay. Rows that repeat an id stay or go together, rows with a null id likewise.
    """
    name = free("keep", docs)
    keep = jaccard_components(docs.select(col(id_col).alias("id"), col(text_col).alias("text")), percent, words, "id", "text").where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias(name)).distinct()
    return docs.join(keep, docs[id_col].eqNullSafe(keep[name]), "left_semi")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sets AS (SELECT DISTINCT r, array_to_string(w[i:i + 3], ' ') AS shingle FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM sets GROUP BY r),
common AS (SELECT x.r AS a, y.r AS b, count(*) AS k FROM sets x JOIN sets y USING (shingle) WHERE x.r <> y.r GROUP BY x.r, y.r),
links AS (SELECT a, b FROM common JOIN sizes s ON s.r = a JOIN sizes t ON t.r = b WHERE 100 * k >= 85 * (s.n + t.n - k)),
reached AS (SELECT r, r AS other FROM d UNION SELECT reached.r, links.b FROM reached JOIN links ON links.a = reached.other)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM d JOIN reached USING (r) JOIN d o ON o.r = reached.other LEFT JOIN sizes ON sizes.r = d.r GROUP BY d.r, d.doc_id"""
