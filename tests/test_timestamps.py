import datetime as dt
import zoneinfo

import pytest
from pyspark.sql import functions as F

from docframe.operators import timestamps as t

ROOTS = [(1, "/srv/a", "Europe/Berlin", "dmy"), (2, "/srv/a/deep", "America/New_York", "mdy"), (3, "/data", None, "mdy"), (4, "/data", None, "mdy")]
ROOT_SCHEMA = "root_id int, root_path string, zone_name string, date_order string"


@pytest.fixture
def roots(spark):
    return spark.createDataFrame(ROOTS, ROOT_SCHEMA)


def utc(spark, roots, stamps, path="/srv/a/f"):
    files = spark.createDataFrame([(i, 1, path, s, None, "?") for i, s in enumerate(stamps)], "entry_id bigint, root_id int, path string, mod_time string, scanned_at timestamp, zone_name string")
    meta = spark.createDataFrame([], "meta_id bigint, file_path string, mod_time string")
    links = spark.createDataFrame([], "links_id bigint, file_path string, dates array<string>")
    got = {r["row_id"]: r["normal_form"] for r in t.normalised(files, meta, links, roots.filter("zone_name is not null")).collect()}
    return [got.get(i) for i in range(len(stamps))]


CASES = [
    ("2021-07-01 12:00:00", "2021-07-01 10:00:00"), ("2021-01-01T12:00:00", "2021-01-01 11:00:00"), ("2021-07-01 12:00", "2021-07-01 10:00:00"), ("2021-07-01 12:00:00,999", "2021-07-01 10:00:00"),
    ("2021-10-31 02:30:00", "2021-10-31 00:30:00"), ("2021-03-28 02:30:00", "2021-03-28 01:30:00"),  # twice: the earlier; skipped: moved on
    ("2021-10-31 02:30:00 CET", "2021-10-31 01:30:00"), ("2021-10-31 02:30:00 CEST", "2021-10-31 00:30:00"), ("2021-07-01 12:00:00 XYZ", None),
    ("2021-07-01T12:00:00Z", "2021-07-01 12:00:00"), ("2021-07-01T12:00:00.123456789Z", "2021-07-01 12:00:00"), ("20210701T120000Z", "2021-07-01 12:00:00"), ("2021-07-01 12:00:00 UTC", "2021-07-01 12:00:00"),
    ("2021-07-01T12:00:00+05:45", "2021-07-01 06:15:00"), ("2021-07-01 12:00:00-0330", "2021-07-01 15:30:00"), ("2021-07-01T12:00:00+02:00[Europe/Berlin]", "2021-07-01 10:00:00"), ("2021-07-01 12:00:00 America/New_York", "2021-07-01 16:00:00"), ("2021-07-01 12:00:00 No/Where", None),
    ("01/07/2021 12:00:00", "2021-07-01 10:00:00"), ("07/25/2021 12:00:00", "2021-07-25 10:00:00"), ("01/07/2021 1:00:00 PM", "2021-07-01 11:00:00"), ("01/07/2021 12:00:00 AM", "2021-06-30 22:00:00"), ("01/07/2021 13:00:00 PM", None),
    ("01.07.2021 12:00:00", "2021-07-01 10:00:00"), ("Thu, 01 Jul 2021 12:00:00 GMT", "2021-07-01 12:00:00"), ("Thu, 1 Jul 2021 12:00:00 +0200", "2021-07-01 10:00:00"), ("Thu Jul  1 12:00:00 +0200 2021", "2021-07-01 10:00:00"), ("Jul 1, 2021 12:00:00 PM", "2021-07-01 10:00:00"),
    ("1625140800", "2021-07-01 12:00:00"), ("1625140800123", "2021-07-01 12:00:00"), ("1625140800123456", "2021-07-01 12:00:00"), ("1625140800.999", "2021-07-01 12:00:00"), ("1625140800123456789", "2021-07-01 12:00:00"),
    (None, None), ("", None), ("unknown", None), ("2021-02-30 10:00:00", None), ("0000-00-00 00:00:00", None), ("2021-07-01 24:00:00", None), ("2021-07-01", None), ("9" * 5000, None), ("2021-07-01 12:00:00+99:00", None),
]


def test_instants(spark, roots):
    assert utc(spark, roots, [c[0] for c in CASES]) == [c[1] for c in CASES]


def test_roots(spark, roots):
    assert utc(spark, roots, ["2021-07-01 12:00:00", "02/03/2021 12:00:00"], "/srv/a/deep/x") == ["2021-07-01 16:00:00", "2021-02-03 17:00:00"]
    assert utc(spark, roots, ["2021-07-01 12:00:00", "2021-07-01T12:00:00Z"], "/srv/ab/x") == [None, "2021-07-01 12:00:00"]
    assert utc(spark, roots, ["2021-07-01T12:00:00Z"], None) == ["2021-07-01 12:00:00"]


DATES = [("2021-07-01", "2021-07-01"), ("2021/7/1", "2021-07-01"), ("20210701", "2021-07-01"), ("3/4/21", "2021-04-03"), ("4/25/2021", "2021-04-25"), ("01.02.2021", "2021-02-01"), ("3 de mayo de 2021", "2021-05-03"), ("22. April 2018", "2018-04-22"), ("26 juin 2019", "2019-06-26"), ("Sept. 5, 2021", "2021-09-05"), ("August 5 2021", "2021-08-05"), ("Feb 30, 2021", None), ("13/32/2021", None), ("x", None), ("", None)]


def test_days(spark):
    df = spark.createDataFrame(list(enumerate(d for d, _ in DATES)), "i int, d string")
    got = {r["i"]: r["v"] for r in df.select("i", t.iso_day(F.col("d"), F.lit("dmy")).alias("v")).collect()}
    assert [got[i] for i in range(len(DATES))] == [w for _, w in DATES]


def test_estimated_zone(spark, roots):
    zone = dt.timezone(dt.timedelta(hours=9))
    rows, meta = [], []
    for i in range(40):
        at = dt.datetime(2021, 1 + i % 12, 3, i % 24, 7, tzinfo=dt.timezone.utc)
        rows.append((i, f"/data/f{i}", at.astimezone(zone).strftime("%Y-%m-%d %H:%M:%S"), None))
        meta.append((i, f"/data/f{i}", at.strftime("%Y-%m-%dT%H:%M:%SZ")))
    rows += [(100, "/data/hot", "2021-01-01 00:00:00", None)] * 30
    files = spark.createDataFrame(rows, "entry_id bigint, path string, mod_time string, scanned_at timestamp")
    meta = spark.createDataFrame(meta, "meta_id bigint, file_path string, mod_time string")
    known = roots.union(spark.createDataFrame([(9, "/z", "Asia/Tokyo", "mdy")], ROOT_SCHEMA))
    got = {r["root_path"]: r["zone_name"] for r in t.root_zones(files, meta, known).collect()}
    assert got["/data"] == "Asia/Tokyo" and got["/srv/a"] is None
    full = {r["root_path"]: r["zone_name"] for r in t.complete_roots(files, meta, known).collect()}
    assert full["/data"] == "Asia/Tokyo" and full["/srv/a"] == "Europe/Berlin"


def test_missing_zone_decides_rows(spark):
    """Of a root without a zone every candidate of the time zone database is weighed; daylight saving and abbreviations included."""
    zone = zoneinfo.ZoneInfo("America/Halifax")
    instants = [dt.datetime(2021, 1 + i % 12, 5 + i % 20, i % 24, 7 + i % 40, 11, tzinfo=dt.timezone.utc) for i in range(48)]
    rows = [(i, f"/x/f{i}", at.astimezone(zone).strftime("%Y-%m-%d %H:%M:%S")) for i, at in enumerate(instants)]
    rows.append((99, "/x/g", "2021-07-01 12:00:00 ADT"))
    files = spark.createDataFrame([(*r, None) for r in rows], "entry_id bigint, path string, mod_time string, scanned_at timestamp")
    meta = spark.createDataFrame([(i, f"/x/f{i}", at.strftime("%Y-%m-%dT%H:%M:%SZ")) for i, at in enumerate(instants)], "meta_id bigint, file_path string, mod_time string")
    links = spark.createDataFrame([], "links_id bigint, file_path string, dates array<string>")
    roots = spark.createDataFrame([(1, "/x/", None, "dmy"), (2, "/y", None, None), (3, None, "UTC", None)], ROOT_SCHEMA)
    got = {r["row_id"]: r["normal_form"] for r in t.normalised(files, meta, links, roots).filter("source_table = 'file_entries'").collect()}
    assert got == {i: at.strftime("%Y-%m-%d %H:%M:%S") for i, at in enumerate(instants)} | {99: "2021-07-01 15:00:00"}


def test_empty(spark, roots):
    assert utc(spark, roots, []) == [] and utc(spark, roots.limit(0), ["2021-07-01T12:00:00Z", "2021-07-01 12:00:00"]) == ["2021-07-01 12:00:00", None]


@pytest.mark.parametrize("zone", ["Asia/Kathmandu", "America/New_York"])
def test_session_zone_does_not_matter(spark, roots, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert utc(spark, roots, [c[0] for c in CASES]) == [c[1] for c in CASES]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
