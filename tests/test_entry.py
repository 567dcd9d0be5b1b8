import os
import re
import subprocess
import sys
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from docframe.functions import text as X
from docframe.operators import chunking
from docframe.streaming import ingest

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_registry():
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 60


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", [k for k in e.queries() if not re.match(r"p\d_", k)])
def test_query_runs(spark, name):
    df = e.queries()[name](spark, DATA)
    assert df.columns and df.count() >= 0


def plain(value):
    """A value of either engine in one form."""
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return bytes(value) if isinstance(value, bytearray) else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(e.oracle_sql()))
def test_matches_sql(spark, name):
    """Every value of every row, not only their number."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    want = con.execute(e.oracle_sql()[name])
    names = [c[0] for c in want.description]
    df = e.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, want.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_plans(spark):
    """Columns are pruned at the scan, and the narrow operators neither shuffle nor leave the JVM."""
    for name in ("search_context", "token_estimate", "chunk_plain", "clean_all", "extract_links", "read_lines"):
        plan = e.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan, name
        assert "doc_type" not in plan and "source" not in plan.replace("Source", ""), name


def test_core_imports_without_text_package():
    code = "import sys; sys.modules['docframe.llm'] = None; import __spark_entry__ as e; assert not any(k.startswith('p1_') for k in e.queries()); assert 'p2_found' in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_streaming(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a\nb\nc", "2024-01-01 00:00:00"), (1, "a\nb\nc", "2024-01-01 00:00:00"), (2, "d", "2024-01-01 00:01:00")], "id int, text string, at string").withColumn("at", F.col("at").cast("timestamp"))
    docs.write.parquet(str(tmp_path / "in"))
    stream = ingest.documents(spark, str(tmp_path / "in"), "id int, text string, at timestamp")
    stream = ingest.distinct_documents(stream, "id", "at")
    out = chunking.chunks(stream, "id", "text", 2).withColumn("n", X.tokens(F.col("text")))
    ingest.to_parquet(out, str(tmp_path / "out"), str(tmp_path / "cp")).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.filter("id = 2").count() == 1 and got.filter("id = 1").count() == chunking.chunks(docs.filter("id = 1").limit(1), "id", "text", 2).count()
