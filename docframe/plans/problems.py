"""Registered queries of the general data-preparation operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docframe.operators import bad_rows, timestamps
from docframe.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    bad = bad_rows.failures(table(spark, d, "tables_results"), table(spark, d, "table_schemas"))
    return bad.select("result_id", "table_index", "row_number", "reason")


def p2_cells(spark: SparkSession, d: str) -> DataFrame:
    return bad_rows.clean_records(table(spark, d, "tables_results"), table(spark, d, "table_schemas"))


def p2_summary(spark: SparkSession, d: str) -> DataFrame:
    """How many records of each schema fail for each reason."""
    bad = bad_rows.failures(table(spark, d, "tables_results"), table(spark, d, "table_schemas"))
    names = table(spark, d, "tables_results", "result_id", "schema_name")
    return bad.join(names, "result_id").groupBy("schema_name", "reason").agg(F.count("*").alias("records"))


def _four(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in ("file_entries", "metadata_results", "links_results", "scan_roots")]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.normalised(*_four(spark, d))


def p4_zones(spark: SparkSession, d: str) -> DataFrame:
    """Zone of every root estimated from the stamps alone, beside the declared one."""
    files, meta, _, roots = _four(spark, d)
    return timestamps.root_zones(files, meta, roots)


def p4_estimated(spark: SparkSession, d: str) -> DataFrame:
    """The same stamps with no root declaring its zone: every local time is decided by the estimate."""
    files, meta, links, roots = _four(spark, d)
    return timestamps.normalised(files, meta, links, roots.withColumn("zone_name", F.lit(None).cast("string")))


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_cells, p2_summary, p4_found, p4_zones, p4_estimated)}


# A record as RFC 4180 has it, for one delimiter D; the four delimiters' patterns are joined by CASE.
_FIELD = r"(?:\"(?:[^\"]|\"\")*\"|[^\"\r\nD]*)"
_CUT = r"D(\"(?:[^\"]|\"\")*\"|[^\"\r\nD]*)"


def _by_delimiter(expr: str) -> str:
    cases = "".join(f" WHEN '{d}' THEN {expr.replace('@', p)}" for d, p in (("|", r"\|"), (",", ","), (";", ";")))
    return f"CASE delimiter{cases} ELSE {expr.replace('@', chr(9))} END"


def _failures_sql() -> str:
    whole = _by_delimiter("regexp_full_match(record, '" + f"{_FIELD}(?:D{_FIELD})*".replace("D", "@") + "')")
    cells = _by_delimiter("regexp_extract_all(delimiter || record, '" + _CUT.replace("D", "@") + "', 1)")
    return f"""
      tab AS (SELECT result_id, schema_name, delimiter, unnest(tables) AS t, generate_subscripts(tables, 1) - 1 AS table_pos FROM tables_results),
      raw AS (SELECT result_id, schema_name, delimiter, table_pos, t.table_index AS table_index, unnest(t.rows) AS record, generate_subscripts(t.rows, 1) AS row_number FROM tab),
      rec AS (SELECT *, {whole} AS quoted FROM raw WHERE row_number > 1 AND record IS NOT NULL AND record <> ''),
      parsed AS (SELECT *, CASE WHEN quoted THEN {cells} END AS fields FROM rec),
      width AS (SELECT schema_name, count(*) AS n FROM table_schemas GROUP BY schema_name),
      cell AS (SELECT result_id, table_pos, table_index, row_number, schema_name, generate_subscripts(fields, 1) AS col_pos, unnest(fields) AS f FROM parsed),
      bare AS (SELECT *, CASE WHEN f LIKE '"%' THEN replace(substr(f, 2, length(f) - 2), '""', '"') ELSE f END AS value FROM cell),
      clean AS (SELECT *, trim(value, ' ') AS v FROM bare),
      bad AS (SELECT DISTINCT c.result_id, c.table_index, c.row_number FROM clean c JOIN table_schemas s ON c.schema_name = s.schema_name AND c.col_pos = s.col_pos
        WHERE CASE WHEN v = '' THEN NOT s.nullable
          WHEN s.value_type = 'integer' THEN NOT (regexp_full_match(v, '[+-]?[0-9]+') AND TRY_CAST(v AS BIGINT) IS NOT NULL)
          WHEN s.value_type = 'decimal' THEN NOT regexp_full_match(v, '[+-]?[0-9]+(\\.[0-9]+)?')
          WHEN s.value_type = 'boolean' THEN lower(v) NOT IN ('true', 'false')
          WHEN s.value_type = 'date' THEN NOT (regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND TRY_CAST(v AS DATE) IS NOT NULL)
          ELSE false END),
      failed AS (SELECT p.result_id, p.table_index, p.row_number::INTEGER AS row_number,
        CASE WHEN NOT p.quoted THEN 'quoting' WHEN len(p.fields) <> w.n THEN 'columns' WHEN b.result_id IS NOT NULL THEN 'value' END AS reason
        FROM parsed p LEFT JOIN width w ON p.schema_name = w.schema_name LEFT JOIN bad b ON p.result_id = b.result_id AND p.table_index = b.table_index AND p.row_number = b.row_number)"""


# Offsets in hours of the abbreviations that the zones of scan_roots use.
_ABBREVIATIONS = (
    ("Europe/Berlin", "CET", 1), ("Europe/Berlin", "CEST", 2), ("Europe/London", "GMT", 0), ("Europe/London", "BST", 1), ("Europe/Helsinki", "EET", 2), ("Europe/Helsinki", "EEST", 3),
    ("America/New_York", "EST", -5), ("America/New_York", "EDT", -4), ("America/Los_Angeles", "PST", -8), ("America/Los_Angeles", "PDT", -7), ("America/Phoenix", "MST", -7),
    ("Australia/Sydney", "AEST", 10), ("Australia/Sydney", "AEDT", 11), ("Asia/Kolkata", "IST", 5.5), ("Asia/Tokyo", "JST", 9),
)


def _stamps_sql() -> str:
    """p4_found for the forms that the given tables hold, in plain SQL."""
    months = ", ".join(f"('{n}', {i})" for i, names in enumerate(timestamps.MONTHS, 1) for n in names)
    abbr = ", ".join(f"('{z}', '{a}', {int(h * 3600)})" for z, a, h in _ABBREVIATIONS)

    def real(y: str, m: str, d: str) -> str:
        return f"(TRY_CAST(printf('%04d-%02d-%02d', {y}, {m}, {d}) AS DATE) IS NOT NULL)"

    # (name, pattern, year, month, day, rest): groups of the pattern
    forms = (
        ("year", r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})([^0-9].*)?$", 1, 2, 3, 4),
        ("compact", r"^([0-9]{4})([0-9]{2})([0-9]{2})([T ].*)?$", 1, 2, 3, 4),
        ("slash", r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}|[0-9]{2})([^0-9].*)?$", 3, 1, 2, 4),
        ("dot", r"^([0-9]{1,2})[.]([0-9]{1,2})[.]([0-9]{4}|[0-9]{2})([^0-9].*)?$", 3, 2, 1, 4),
        ("ctime", r"^\pL{3} (\pL{3}) +([0-9]{1,2}) ([0-9:]+ [+-][0-9]{4}) ([0-9]{4})$", 4, 1, 2, 3),
        ("dayname", r"^(?:\pL+[.]?,? +)?([0-9]{1,2})[.]?[ -]+(?:de )?(\pL+)[.]?[ -]+(?:de )?([0-9]{4})([^0-9].*)?$", 3, 2, 1, 4),
        ("nameday", r"^(\pL+)[.]? ([0-9]{1,2}),? ([0-9]{4})([^0-9].*)?$", 3, 1, 2, 4),
    )

    def part(k: int) -> str:
        return "CASE form " + " ".join(f"WHEN '{f[0]}' THEN regexp_extract(s, '{f[1]}', {f[k]})" for f in forms) + " END"

    which = "CASE " + " ".join(f"WHEN regexp_matches(s, '{f[1]}') THEN '{f[0]}'" for f in forms) + " END"
    clock = r"^(?:T|,? +)?([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,][0-9]+)?)?(?: ?([AaPp])[Mm]\b)?(?:[^0-9A-Za-z:.,+Z[-](.*)|([A-Za-z+[-].*))?$"
    offset = r"^[+-][0-9]{2}:?[0-9]{2}$"
    return f"""
      root AS (SELECT rtrim(root_path, '/') AS root, zone_name AS zone, date_order FROM scan_roots WHERE root_path IS NOT NULL),
      raw AS (SELECT 'file_entries' AS source_table, entry_id AS row_id, 0 AS item_no, path AS p, trim(mod_time, ' ') AS s FROM file_entries
        UNION ALL SELECT 'metadata_results', meta_id, 0, file_path, trim(mod_time, ' ') FROM metadata_results
        UNION ALL SELECT 'links_results', links_id, unnest(range(1, len(dates) + 1))::INTEGER, file_path, trim(unnest(dates), ' ') FROM links_results),
      rooted AS (SELECT raw.*, zone, date_order FROM raw LEFT JOIN root ON p = root OR starts_with(p, root || '/')
        QUALIFY row_number() OVER (PARTITION BY source_table, row_id, item_no ORDER BY length(root) DESC) = 1),
      epoch AS (SELECT *, CASE WHEN source_table = 'links_results' THEN NULL WHEN regexp_matches(s, '^-?[0-9]{{9,10}}([.,][0-9]+)?$') THEN regexp_extract(s, '^-?[0-9]+')::BIGINT
        WHEN regexp_matches(s, '^[0-9]{{12,13}}$') THEN s::BIGINT // 1000 WHEN regexp_matches(s, '^[0-9]{{15,16}}$') THEN s::BIGINT // 1000000 WHEN regexp_matches(s, '^[0-9]{{18,19}}$') THEN s::BIGINT // 1000000000 END AS e,
        {which} AS form FROM rooted WHERE s IS NOT NULL),
      month_names(word, n) AS (VALUES {months}),
      cut AS (SELECT *, {part(2)} AS ys, {part(3)} AS ms, {part(4)} AS ds, {part(5)} AS rest FROM epoch),
      num AS (SELECT cut.*, CASE WHEN length(ys) = 2 THEN 2000 ELSE 0 END + TRY_CAST(ys AS INTEGER) AS y, coalesce(TRY_CAST(ms AS INTEGER), n) AS m0, TRY_CAST(ds AS INTEGER) AS d0 FROM cut LEFT JOIN month_names ON lower(ms) = word),
      day AS (SELECT *, CASE WHEN form = 'slash' AND NOT (CASE WHEN date_order = 'mdy' THEN {real('y', 'm0', 'd0')} OR NOT {real('y', 'd0', 'm0')} ELSE {real('y', 'm0', 'd0')} AND NOT {real('y', 'd0', 'm0')} END) THEN d0 ELSE m0 END AS m,
        CASE WHEN form = 'slash' AND NOT (CASE WHEN date_order = 'mdy' THEN {real('y', 'm0', 'd0')} OR NOT {real('y', 'd0', 'm0')} ELSE {real('y', 'm0', 'd0')} AND NOT {real('y', 'd0', 'm0')} END) THEN m0 ELSE d0 END AS d,
        CASE WHEN form = 'compact' THEN regexp_replace(rest, '^[T ]([0-9]{{2}})([0-9]{{2}})([0-9]{{2}})', ' \\1:\\2:\\3') ELSE coalesce(rest, '') END AS clock FROM num),
      hand AS (SELECT *, TRY_CAST(regexp_extract(clock, '{clock}', 1) AS INTEGER) AS h, TRY_CAST(regexp_extract(clock, '{clock}', 2) AS INTEGER) AS mi, coalesce(TRY_CAST(regexp_extract(clock, '{clock}', 3) AS INTEGER), 0) AS sec,
        lower(regexp_extract(clock, '{clock}', 4)) AS half, trim(regexp_extract(clock, '{clock}', 5) || regexp_extract(clock, '{clock}', 6), ' ') AS z FROM day),
      wall AS (SELECT *, TRY_CAST(printf('%04d-%02d-%02d %02d:%02d:%02d', y, m, d, CASE WHEN half = '' THEN h WHEN h BETWEEN 1 AND 12 THEN h % 12 + CASE half WHEN 'p' THEN 12 ELSE 0 END ELSE 99 END, mi, sec) AS TIMESTAMP) AS local,
        regexp_replace(z, '[[][^]]*[]]$', '') AS bare FROM hand),
      abbreviation(az, aa, secs) AS (VALUES {abbr}),
      timed AS (SELECT wall.*, CASE WHEN regexp_matches(bare, '{offset}') THEN local - to_seconds(CASE WHEN bare[1] = '-' THEN -1 ELSE 1 END * (bare[2:3]::INTEGER * 3600 + right(bare, 2)::INTEGER * 60))
          WHEN z IN ('Z', 'z', 'UTC', 'GMT') THEN local WHEN contains(z, '/') OR z = '' THEN NULL ELSE local - to_seconds(secs) END AS fixed,
        CASE WHEN z = '' THEN zone WHEN contains(z, '/') AND bare = z THEN z END AS place FROM wall LEFT JOIN abbreviation ON zone = az AND z = aa),
      placed AS (SELECT *, CASE WHEN fixed IS NULL AND place IS NOT NULL THEN timezone(place, local) END AS later FROM timed),
      done AS (SELECT *, CASE WHEN timezone(place, later - INTERVAL 1 HOUR) = local THEN later - INTERVAL 1 HOUR ELSE later END AS earliest FROM placed),
      stamped AS (SELECT source_table, row_id, item_no::INTEGER AS item_no, CASE WHEN source_table = 'links_results' THEN CASE WHEN (coalesce(rest, '') = '' OR mi IS NOT NULL) AND {real('y', 'm', 'd')} THEN printf('%04d-%02d-%02d', y, m, d) END
        WHEN e IS NOT NULL THEN strftime(make_timestamp(e * 1000000), '%Y-%m-%d %H:%M:%S') ELSE strftime(coalesce(fixed, timezone('UTC', earliest)), '%Y-%m-%d %H:%M:%S') END AS normal_form FROM done)"""


def oracle_sql() -> dict[str, str]:
    stamps = f"WITH {_stamps_sql()} SELECT source_table, row_id, item_no, normal_form FROM stamped WHERE normal_form IS NOT NULL"
    return {
        "p4_found": stamps,
        "p2_found": f"WITH {_failures_sql()} SELECT result_id, table_index, row_number, reason FROM failed WHERE reason IS NOT NULL",
        "p2_cells": f"""WITH {_failures_sql()}
          SELECT c.result_id, c.table_pos::INTEGER AS table_pos, c.row_number::INTEGER AS row_number, c.table_index, c.schema_name, c.col_pos::INTEGER AS col_pos, s.col_name, s.value_type, c.value,
            CASE WHEN s.value_type = 'integer' THEN TRY_CAST(nullif(v, '') AS BIGINT) END AS as_integer, CASE WHEN s.value_type = 'decimal' THEN ltrim(nullif(v, ''), '+') END AS as_decimal,
            CASE WHEN s.value_type = 'boolean' THEN lower(nullif(v, '')) = 'true' END AS as_boolean, CASE WHEN s.value_type = 'date' THEN TRY_CAST(nullif(v, '') AS DATE) END AS as_date
          FROM clean c JOIN table_schemas s ON c.schema_name = s.schema_name AND c.col_pos = s.col_pos
            JOIN failed x ON c.result_id = x.result_id AND c.table_index = x.table_index AND c.row_number = x.row_number WHERE x.reason IS NULL""",
        "p2_summary": f"""WITH {_failures_sql()}
          SELECT r.schema_name, f.reason, count(*) AS records FROM failed f JOIN tables_results r ON f.result_id = r.result_id WHERE f.reason IS NOT NULL GROUP BY r.schema_name, f.reason""",
    }
