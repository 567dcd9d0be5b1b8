import csv
import datetime as dt
import io

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from docframe.operators import bad_rows as b

SCHEMA = "schema_name string, col_pos int, col_name string, value_type string, nullable boolean"
RULES = [("s", 1, "a", "text", False), ("s", 2, "b", "integer", True), ("s", 3, "c", "date", False)]
TABLES = "result_id bigint, schema_name string, delimiter string, tables array<struct<table_index:int, rows:array<string>>>, record string, reason string"


def parse(record, d):
    """RFC 4180 by hand: fields, or None where quoting is broken."""
    out, i = [], 0
    while True:
        if record[i : i + 1] == '"':
            buf, i = "", i + 1
            while True:
                k = record.find('"', i)
                if k < 0:
                    return None
                buf += record[i:k]
                if record[k + 1 : k + 2] == '"':
                    buf, i = buf + '"', k + 2
                else:
                    i = k + 1
                    break
            if record[i : i + 1] not in ("", d):
                return None
            out.append(buf)
        else:
            k = record.find(d, i)
            k = len(record) if k < 0 else k
            if any(c in record[i:k] for c in '"\r\n'):
                return None
            out.append(record[i:k])
            i = k
        if i >= len(record):
            return out
        i += 1


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet='ab,;|"\n\r\x01 ', min_size=1, max_size=14), st.sampled_from(",;|")), min_size=1, max_size=40))
def test_split_against_parser(spark, cases):
    df = spark.createDataFrame([(i, r, d) for i, (r, d) in enumerate(cases)], "i int, r string, d string")
    got = {x["i"]: x["f"] for x in df.select("i", b.split_record(F.col("r"), F.col("d")).alias("f")).collect()}
    assert got == {i: parse(r, d) for i, (r, d) in enumerate(cases)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='xy,"\n é', max_size=8), min_size=1, max_size=5), min_size=1, max_size=10))
def test_split_reads_what_csv_writes(spark, rows):
    out = []
    for row in rows:
        s = io.StringIO()
        csv.writer(s, quoting=csv.QUOTE_ALL, lineterminator="").writerow(row)
        out.append(s.getvalue())
    df = spark.createDataFrame(list(enumerate(out)), "i int, r string")
    assert {x["i"]: x["f"] for x in df.select("i", b.split_record(F.col("r"), F.lit(",")).alias("f")).collect()} == dict(enumerate(rows))


@pytest.fixture
def rules(spark):
    return spark.createDataFrame(RULES, SCHEMA)


def frame(spark, *rows):
    return spark.createDataFrame([(i, s, d, [(0, ["h", *r])] if r is not None else None, "x", "y") for i, (s, d, r) in enumerate(rows)], TABLES)


def test_reasons(spark, rules):
    good = ["x,1,2024-02-29", " x , -7 , 2024-01-01 ", '"a,""b""",,2024-01-01', '"line\nbreak",+9223372036854775807,2024-01-01', "", None]
    bad = {'"open,1,2024-01-01': "quoting", 'a"b,1,2024-01-01': "quoting", '"a"b,1': "quoting", "a,1": "columns", "a,1,2024-01-01,": "columns", " ,1,2024-01-01": "value", "a,1.0,2024-01-01": "value", "a,9223372036854775808,2024-01-01": "value", "a,1,2023-02-29": "value", "a,1,": "value", "a,٣,2024-01-01": "value"}
    t = frame(spark, ("s", ",", good + list(bad)))
    got = {(r["row_number"], r["reason"]) for r in b.failures(t, rules).collect()}
    assert got == {(len(good) + 2 + k, r) for k, r in enumerate(bad.values())}
    cells = b.clean_records(t, rules)
    assert cells.select("row_number").distinct().count() == 4
    wide = {r["row_number"]: r for r in b.typed_table(t, rules, "s").collect()}
    assert wide[2]["b"] == 1 and wide[2]["c"] == dt.date(2024, 2, 29) and wide[4]["a"] == 'a,"b"' and wide[4]["b"] is None


def test_defined_cases(spark, rules):
    t = frame(spark, ("s", None, ["x,1,2024-01-01"]), ("none", ",", ["a,b", 'q"q']), (None, ",", ["a"]), ("s", "\t", None), ("s", ",", []), ("s", "::", ["x::1::2024-01-01", "x::1"]))
    got = sorted((r["result_id"], r["row_number"], r["reason"]) for r in b.failures(t, rules).collect())
    assert got == [(1, 3, "quoting"), (5, 3, "columns")]
    assert b.failures(t.limit(0), rules).count() == 0
    assert b.failures(t.union(t), rules).count() == 2
    assert b.failures(t, rules.limit(0)).select("reason").distinct().collect()[0]["reason"] == "quoting"
    long = frame(spark, ("s", ",", ['"' + "x" * 300_000 + '",1,2024-01-01', "," * 50_000]))
    assert [r["reason"] for r in b.failures(long, rules).collect()] == ["columns"]


def test_separators_in_records(spark):
    """Control characters of any kind in a record, or as the delimiter, are ordinary characters."""
    rows = [("a\x01b\x02\x03\uffff,c", ","), ('"x,\x01y",\x01b', ","), ("p\x01q", "\x01"), ("\x01a,\x01b,\x01", ","), ('"\x01""",z', ",")]
    df = spark.createDataFrame(rows, "r string, d string")
    got = [r["f"] for r in df.select(b.split_record(df["r"], df["d"]).alias("f")).collect()]
    assert got == [["a\x01b\x02\x03\uffff", "c"], ["x,\x01y", "\x01b"], ["p", "q"], ["\x01a", "\x01b", "\x01"], ['\x01"', "z"]]
