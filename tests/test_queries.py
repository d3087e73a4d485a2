import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
NAMES = [k for k in __spark_entry__.queries() if k != "pipeline" and not k.startswith("op")]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(rows):
    def show(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "-"
        return f"{x:.5f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(show(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, db, name):
    got = __spark_entry__.queries()[name](spark, SF)
    cols = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*cols).collect()]
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    other = db.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
    assert plain(rows) == plain(other)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_all_events_have_results(spark, db):
    rows = lambda name: __spark_entry__.queries()[name](spark, SF)
    n = db.execute("SELECT count(*) FROM events").fetchone()[0]
    assert rows("as_quotes").count() == rows("glft_quotes").count() == n
    assert rows("depth_within_5").count() == rows("bbo").count()
    seen = {tuple(x) for x in db.execute("SELECT DISTINCT user_id % 4, epoch_us(ts) // 3600000000 FROM events").fetchall()}
    assert not seen & {tuple(r) for r in rows("missing_hours").select("symbol_id", "hour").collect()}


def test_sweep_pays_what_it_earns(spark):
    rows = __spark_entry__.queries()["strategy_sweep"](spark, SF).toPandas()
    assert (rows.pnl_x2 == rows.markout_x2 * 100_000 - rows.fees_x2).all() and rows.n_orders.sum() > 0
    by = rows[rows.fee_tenths == 0].groupby("model").lots.sum()
    assert by["PESS"] <= by["PROP"] <= by["OPT"]


def test_base_imports_without_the_optional_part():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['microflow.llm'] = None; import __spark_entry__ as e; assert e.llm is None and len(e.queries()) > 30 and e.oracle_sql()"
    root = str(Path(__file__).resolve().parent.parent)
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, env=os.environ | {"PYTHONPATH": root})
