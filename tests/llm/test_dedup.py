import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from microflow.llm import exact_dedup, jaccard, line_dedup, substrings

from .conftest import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def exact(rows):
    groups = {}
    for k, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((k, t or ""))
    out = {}
    for norm, own in groups.items():
        keep = min(own, key=lambda x: (-len(x[1]), x[0]))[0]
        for k, _ in own:
            out[k] = (keep, len(own), k == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


def test_exact_dedup(spark, corpus):
    for capacity in (200_000, 3):  # a directory of one bucket, and one that doubles
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(table(spark, corpus), capacity=capacity).collect()}
        assert got == exact(corpus)


def test_exact_dedup_edges(spark):
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0
    got = exact_dedup.exact_dedup(table(spark, [(None, "x"), (4, "x"), (-3, "x "), (4, "x")])).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {(None, -3, 4, False), (4, -3, 4, False), (-3, -3, 4, True)} and len(got) == 4
    assert [r.keep_id for r in exact_dedup.exact_dedup(table(spark, [(None, "x")])).collect()] == [None]


def test_directory_splits_full_buckets(spark):
    keys = spark.range(4000).select(F.when(F.col("id") < 3000, F.col("id")).otherwise(F.xxhash64("id")).alias("key"))
    cells, depth = exact_dedup.directory(keys, 100)
    found = {r.cell: r.bucket for r in cells.collect()}
    assert len(set(found.values())) > 8 and depth >= 6
    # a deep cell keeps a bucket of its own, thin neighbours share
    assert found[0] >= 2**depth or 3000 > 100


def bytes_removed(rows):
    seen, out = set(), {}
    for k, t, *_ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        mark = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 99):
            if (h := b[p : p + 100]) in seen:
                mark[p] += 1
                mark[p + 100] -= 1
            seen.add(h)
        gone = np.cumsum(mark)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[k] = (len(b), len(b) - len(kept), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept)
    return out


def test_substrings(spark, corpus, rng):
    periodic = [(1000, "abc" * 200), (1001, "bca" * 150), (1002, "x" * 99), (1003, "x" * 99), (1004, "y" * 100), (1005, "y" * 100), (1006, "y" * 101)]
    shared = "".join(rng.choice("abcdefgh") for _ in range(140))
    edges = [(2000 + i, "".join(rng.choice("mnop") for _ in range(rng.randint(0, 60))) + shared[rng.randint(0, 45) : rng.randint(95, 140)] + "".join(rng.choice("qrst") for _ in range(60))) for i in range(40)]
    rows = corpus + periodic + edges
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in substrings.dedup_substrings(table(spark, rows).repartition(5)).collect()}
    assert got == bytes_removed(rows)


def test_substrings_edges(spark):
    assert substrings.dedup_substrings(table(spark, [])).count() == 0
    long = "".join(hashlib.sha256(bytes([i])).hexdigest() for i in range(3))[:150]
    got = substrings.dedup_substrings(table(spark, [(None, long), (7, long), (7, long), (7, "z" + long)])).collect()
    assert sorted(r.n_removed for r in got) == [0, 150, 150, 150]


def test_long_text_in_pieces(spark, rng, monkeypatch):
    monkeypatch.setattr(substrings, "_LONGEST", 700)
    text = "".join(rng.choice("abcdef") for _ in range(2500))
    batch = __import__("pyarrow").RecordBatch.from_pydict({"id": [1], "text": [text]})
    found = [(s.lo + s.shift, s.hi + s.shift) for s in substrings._samples(batch)]
    starts = sorted(p for lo, hi in found for a, z in zip(lo, hi) for p in range(a, z + 1))
    assert starts == list(range(2401))


def sets(rows, n):
    out = {}
    for k, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return out


def linked(rows, percent, n):
    s = sets(rows, n)
    parent = {k: k for k in s}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(s)
    for i in keys:
        for j in keys:
            if i < j and s[i] and s[j]:
                both = len(s[i] & s[j])
                if 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
    return {k: (len(s[k]), root(k)) for k in keys}


def test_jaccard(spark, corpus, rng):
    base = ["b%d" % i for i in range(80)]
    near = []
    for i in range(60):  # a large group of near copies: some pairs link only through others
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(80)] = "v%d" % i
        near.append((3000 + i, " ".join(w)))
    rows = corpus + near
    for percent, n in ((85, 4), (80, 5)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(table(spark, rows), percent, n).collect()}
        assert got == linked(rows, percent, n)


def test_jaccard_keeps_one(spark):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (2, "x"), (9, None), (10, None), (None, "a b c d e f")]
    kept = jaccard.drop_near_copies(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, 9, 10}
    assert jaccard.jaccard_components(table(spark, [])).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.range(199).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = jaccard.components(edges).collect()
    assert len(got) == 200 and {r.comp for r in got} == {0}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def lines_dropped(rows, errors=2, least=20):
    seen, out = [], {}
    for k, t, *_ in sorted(rows, key=lambda r: r[0]):
        gone, exact_ = [], 0
        for no, line in enumerate((t or "").split("\n")):
            if re.sub(r"[\x20\x09-\x0D]", "", line):
                same = line in seen
                near = len(line) >= least and any(len(x) >= least and abs(len(x) - len(line)) <= errors and distance(x, line) <= errors for x in set(seen))
                exact_ += same
                if same or near:
                    gone.append(no)
            seen.append(line)
        out[k] = (len((t or "").split("\n")), exact_, len(gone) - exact_, gone)
    return out


def test_lines(spark, rng):
    base = ["".join(rng.choice("abcd é") for _ in range(rng.randint(12, 60))).strip() + "." for _ in range(30)]

    def edit(x):
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(x))
            x = rng.choice((x[:i] + x[i + 1 :], x[:i] + "q" + x[i:], x[:i] + "q" + x[i + 1 :]))
        return x

    rows = [(i, "\n".join(edit(rng.choice(base)) for _ in range(rng.randint(0, 6)))) for i in range(60)] + [(100, None), (101, " \n \n"), (102, "\n\n")]
    got = {r.doc_id: (r.n_lines, r.n_exact, r.n_near, r.dropped) for r in line_dedup.dropped_lines(table(spark, rows)).collect()}
    assert got == lines_dropped(rows)
    cut = {r.doc_id: r.text for r in line_dedup.dedup_lines(table(spark, rows)).collect()}
    for k, t in rows:
        assert cut[k] == ("\n".join(x for i, x in enumerate(t.split("\n")) if i not in got[k][3]) if t is not None else None)


def test_line_distance(spark, rng):
    pairs = [("".join(rng.choice("ab") for _ in range(rng.randint(0, 7))), "".join(rng.choice("ab") for _ in range(rng.randint(0, 7)))) for _ in range(300)]
    pairs = [(a, b) for a, b in pairs if abs(len(a) - len(b)) <= 2]
    named = spark.createDataFrame([(i, i, a, b) for i, (a, b) in enumerate(pairs)], "a long, b long, x string, y string")
    for test in (line_dedup.within, line_dedup.similar):  # with and without cutting what both ends share
        assert {r.a for r in test(named, 2).collect()} == {i for i, (a, b) in enumerate(pairs) if distance(a, b) <= 2}


def test_lines_edges(spark):
    assert line_dedup.dropped_lines(table(spark, [])).count() == 0
    line = "the same line of words, long enough"
    got = line_dedup.dropped_lines(table(spark, [(None, line), (2, line), (1, line + "!"), (1, line + "!")])).collect()
    assert sorted((r.doc_id or 0, r.dropped) for r in got) == [(0, [0]), (1, []), (1, []), (2, [0])]


def line_tables(monkeypatch):
    """The tables that line_dedup writes from now on, by name."""
    out, write = {}, line_dedup.written

    def written(df, name):
        out[name] = (df, table := write(df, name))
        return table

    monkeypatch.setattr(line_dedup, "written", written)
    monkeypatch.setattr(line_dedup, "drop", lambda *_: None)
    return out


def test_lines_in_methods_that_the_jvm_compiles(spark, monkeypatch):
    found = line_tables(monkeypatch)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan isn't known before it runs
    try:
        line_dedup.dropped_lines(table(spark, [(1, "a line of more than twenty characters"), (2, "a line of more than 20 characters")])).collect()
        for name, (df, _) in found.items():
            stages = spark.sparkContext._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(df._jdf.queryExecution().executedPlan())
            for i in range(stages.size()):
                assert stages.apply(i)._3().maxMethodCodeSize() <= 8000, name
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_only_meeting_lines_are_sketched(spark, rng, monkeypatch):
    found = line_tables(monkeypatch)
    alone = ["".join(rng.choice("abcdefgh ") for _ in range(40)) + "." for _ in range(200)]
    rows = [(i, line) for i, line in enumerate(alone)] + [(300, "one line here, of some thirty letters"), (301, "one line here; of some thirty letters")]
    got = {r.doc_id: r.n_near for r in line_dedup.dropped_lines(table(spark, rows)).collect()}
    assert {k for k, n in got.items() if n} == {301}
    assert sum(t.count() for _, t in found.values() if "sketch" in t.columns) == 2


def test_lines_that_share_a_segment_meet_in_a_row_each(spark, rng, monkeypatch):
    found = line_tables(monkeypatch)
    rows = [(i, "é" * 20 + "".join(rng.choice("abcdefgh ") for _ in range(39)) + ".") for i in range(400)]
    got = {r.doc_id: (r.n_lines, r.n_exact, r.n_near, r.dropped) for r in line_dedup.dropped_lines(table(spark, [*rows, (500, rows[7][1][:-2] + "z.")])).collect()}
    assert {k for k, r in got.items() if r[2]} == {500}
    assert 400 <= found["line-probed"][1].count() <= 12 * 401 and 400 <= found["line-indexed"][1].count() <= 3 * 401


def test_words_of_one_polynomial_hash_stay_apart(spark):
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(table(spark, [(1, one), (2, two), (3, one)])).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_clashing_names(spark):
    rows = [(1, "the same line of twenty characters\nother"), (2, "the same line of twenty characters\nelse"), (None, None)]
    docs = table(spark, rows)
    for name in ("found_id", "found_text", "found_lines", "keep", "_id", "_th", "_keep", "_dropped"):
        docs = docs.withColumn(name, F.lit(1))
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and {r.doc_id: r.text for r in out.collect()} == {1: rows[0][1], 2: "else", None: None}
    left = jaccard.drop_near_copies(docs)
    assert left.columns == docs.columns and left.count() == 3


def test_texts_go_only_where_sketches_leave_a_partner(spark, monkeypatch):
    """Many sets that share one shingle only are a family, and so far apart that none of their texts needs to travel."""
    rng = random.Random(41)
    fresh = lambda n: [f"w{rng.getrandbits(60)}" for _ in range(n)]
    apart = [" ".join(["in", "the", "same", "words", *fresh(2 + k % 9)]) for k in range(120)]
    text = fresh(30)
    near = [" ".join([*text[:k], f"n{k}", *text[k + 1 :]]) for k in (0, 29)]
    seen, real = [], jaccard.written
    monkeypatch.setattr(jaccard, "FAMILY", 4)
    monkeypatch.setattr(jaccard, "LONG_LIST", 1000)
    monkeypatch.setattr(jaccard, "RANKED", 0)  # else the shared shingle comes last in every set
    monkeypatch.setattr(jaccard, "written", lambda df, name: seen.append((name, out := real(df, name))) or out)
    docs = spark.createDataFrame(list(enumerate([*apart, *near])), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs, percent=80).collect()}
    assert got == {k: 120 if k == 121 else k for k in range(122)}
    sets, texts = ([df for n, df in seen if n == name][-1] for name in ("parts", "part-texts"))
    assert sets.count() >= 4 and texts.count() == 0
