import re

import pytest

import corpus_pipeline
from microflow.llm import decontaminate

from .conftest import prose
from .test_dedup import linked

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def tables(spark, rng, tmp_path):
    texts = [prose(rng, rng.randint(15, 90)) for _ in range(40)]
    item = " ".join("item%d" % i for i in range(20))
    texts += [texts[0], texts[1] + " more", item + " " + texts[2], None, ""]
    docs = [(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), docs


def test_stages_against_brute_force(spark, tables):
    sf, docs = tables
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    df = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    first = stages["quality classifier"](spark, df, sf)
    assert first.count() == len(docs)  # all labelled rows are clean: nothing can be told apart
    second = stages["n-gram Jaccard join"](spark, first, sf)
    groups = linked([(k, t) for k, t, *_ in docs], 80, 5)
    assert {r.doc_id for r in second.collect()} == {k for k, (_, c) in groups.items() if k == c}
    third = stages["benchmark decontamination"](spark, second, sf)
    left = {r.doc_id for r in third.collect()}
    assert left == {r.doc_id for r in second.collect()} - {42}
    for x in (first, second, third):
        assert x.columns == df.columns
    fourth = stages["mixing sources"](spark, third, sf)
    words = lambda rows: sum(len(re.findall(r"\S+", r.text or "")) for r in rows)
    assert fourth.columns == df.columns and abs(words(fourth.collect()) - 1.5 * words(third.collect())) <= 2
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {k for r in packed for k in r.doc_ids} == {r.doc_id for r in fourth.collect()}
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontaminate.judged(decontaminate.hits(third, bench)).where("contaminated").count() == 0


def test_queries_run_on_the_smallest_tables(spark):
    from microflow.llm.queries import QUERIES, SQL

    assert {int(k[2:].split("_")[0]) for k in QUERIES} == set(range(1, 14)) and set(SQL) <= set(QUERIES)
    for name in ("op1_exact_dedup", "op2_pii", "op5_quality", "op8_mixing"):
        assert QUERIES[name](spark, SF).count() == 200
