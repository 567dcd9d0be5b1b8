"""Separate raw delimited records that do not fit their schema, and load the others typed.

A record is split by RFC 4180 (quotes doubled inside quotes, line breaks only inside quotes) with
the delimiter of its own row; everything is a JVM expression. The parsed cells are exploded to
(record, column, value), joined with the rule table, evaluated, and the failures aggregated per
record; clean records are what an anti-join with the failures leaves.

Reasons, the first that holds: ``quoting``, ``columns``, ``value``.

Defined cases: a null or empty record is no record. The first record of a table is its header and
is not judged. Without a known schema only ``quoting`` can fail. A null or empty delimiter counts
as a comma; of a longer one the whole string separates. Null tables, null rows arrays and empty
tables give no rows. Two tables of a result that share a table_index are told apart internally by
position. Spaces around a value do not count. Repeated input rows are judged each on its own and
reported once per distinct (result_id, table_index, row_number).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docframe.session import BROADCAST_ROWS, checkpoint

KEYS = ["result_id", "table_pos", "row_number"]
#: Stand-in for a field separator. In a record that holds it, it is doubled to ``_HELD`` and ``_CUT`` separates instead.
_MARK, _HELD, _CUT = "\u0001", "\u0001a", "\u0001b"

# Patterns of the value types.
INTEGER = r"^[+-]?[0-9]+$"
DECIMAL = r"^[+-]?[0-9]+(\.[0-9]+)?$"
BOOLEAN = r"^(?i)(true|false)$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def split_record(record: Column, delimiter: Column) -> Column:
    """Array of fields of an RFC 4180 record, null where its quoting is broken."""
    held = record.contains(_MARK)
    mark = F.when(held, _CUT).otherwise(_MARK)
    delimiter = F.when(held, F.replace(delimiter, F.lit(_MARK), F.lit(_HELD))).otherwise(delimiter)
    record = F.when(held, F.replace(record, F.lit(_MARK), F.lit(_HELD))).otherwise(record)
    parts = F.split(record, '"', -1)
    n = F.size(parts)

    def outside(x: Column, i: Column) -> Column:
        """Is the text between two quoted stretches, or before the first or after the last, legal?"""
        first, last = i == 0, i == n - 1
        edge = F.when(first & last, F.lit(True)).when(first, (x == "") | x.endswith(delimiter)).when(last, (x == "") | x.startswith(delimiter))
        inner = (x == "") | (x.startswith(delimiter) & x.endswith(delimiter))
        return F.coalesce(edge, inner) & ~x.rlike(r"[\r\n]")

    legal = F.forall(F.transform(parts, lambda x, i: (i % 2 == 1) | outside(x, i)), lambda ok: ok)
    glued = F.transform(
        parts,
        lambda x, i: F.when(i % 2 == 1, x).when((x == "") & (i > 0) & (i < n - 1), F.lit('"')).otherwise(F.replace(x, delimiter, mark)),
    )
    simple = F.when(~record.rlike(r"[\r\n]"), F.split(F.replace(record, delimiter, mark), mark, -1))
    quoted = F.when((n % 2 == 1) & legal, F.split(F.array_join(glued, ""), mark, -1))
    fields = F.when(record.contains('"'), quoted).otherwise(simple)
    return F.when(held, F.transform(fields, lambda x: F.replace(x, F.lit(_HELD), F.lit(_MARK)))).otherwise(fields)


def records(tables_results: DataFrame) -> DataFrame:
    """One row per judged raw record: KEYS, table_index, schema_name, record, fields."""
    base = tables_results.select("result_id", "schema_name", F.when(F.length("delimiter") > 0, F.col("delimiter")).otherwise(",").alias("delimiter"), F.posexplode("tables").alias("table_pos", "tab"))
    rows = base.select("result_id", "schema_name", "delimiter", "table_pos", F.col("tab.table_index").alias("table_index"), F.posexplode("tab.rows").alias("at", "record"))
    rows = rows.filter("at > 0 and record is not null and record <> ''")
    return rows.select(
        "result_id", "table_pos", (F.col("at") + 1).alias("row_number"), "table_index", "schema_name", "record",
        split_record(F.col("record"), F.col("delimiter")).alias("fields"),
    )


def is_valid(value: Column, value_type: Column, nullable: Column) -> Column:
    """Does a cell satisfy its rule?"""
    v = F.trim(value)
    typed = (
        F.when(value_type == "integer", v.rlike(INTEGER) & v.try_cast("decimal(38,0)").between(F.lit("-9223372036854775808").cast("decimal(38,0)"), F.lit("9223372036854775807").cast("decimal(38,0)")))
        .when(value_type == "decimal", v.rlike(DECIMAL))
        .when(value_type == "boolean", v.rlike(BOOLEAN))
        .when(value_type == "date", v.rlike(DATE) & v.try_cast("date").isNotNull())
        .otherwise(True)
    )
    return F.when(v == "", F.coalesce(nullable, F.lit(False))).otherwise(F.coalesce(typed, F.lit(False)))


def rules(table_schemas: DataFrame) -> DataFrame:
    """The rule table; a repeated rule counts once."""
    own = table_schemas.select("schema_name", F.col("col_pos").cast("int").alias("col_pos"), "col_name", "value_type", "nullable")
    return own.filter("schema_name is not null and col_pos is not null").dropDuplicates(["schema_name", "col_pos"])


def failures(tables_results: DataFrame, table_schemas: DataFrame) -> DataFrame:
    """Failed records: KEYS, table_index, reason, bad_columns (array of int, empty unless ``value``).

    One pass: a record of the wrong shape becomes one marker, the others their cells; only what fails is shuffled.
    """
    spec = rules(table_schemas)
    widths = spec.groupBy("schema_name").agg(F.count("*").cast("int").alias("width"))
    judged = records(tables_results).join(widths, "schema_name", "left")
    shape = F.when(F.col("fields").isNull(), "quoting").when(F.size("fields") != F.col("width"), "columns")
    judged = judged.select(*KEYS, "table_index", "schema_name", shape.alias("shape"), "fields")
    cell = F.transform("fields", lambda v, i: F.struct((i + 1).alias("col_pos"), v.alias("value")))
    marker = F.array(F.struct(F.lit(0).alias("col_pos"), F.lit(None).cast("string").alias("value")))
    cells = judged.select(*KEYS, "table_index", "schema_name", "shape", F.explode(F.when(F.col("shape").isNotNull(), marker).otherwise(cell)).alias("c"))
    cells = cells.select(*KEYS, "table_index", "schema_name", "shape", "c.col_pos", "c.value").join(spec, ["schema_name", "col_pos"], "left")
    wrong = F.col("value_type").isNotNull() & ~is_valid(F.col("value"), F.col("value_type"), F.col("nullable"))
    bad = cells.filter(F.col("shape").isNotNull() | wrong)
    found = bad.groupBy(*KEYS, "table_index").agg(F.max("shape").alias("shape"), F.array_sort(F.collect_set(F.when(F.col("col_pos") > 0, F.col("col_pos")))).alias("bad_columns"))
    return found.select(*KEYS, "table_index", F.coalesce("shape", F.lit("value")).alias("reason"), "bad_columns")


def _without_failures(recs: DataFrame, tables_results: DataFrame, table_schemas: DataFrame) -> DataFrame:
    """Records that did not fail. The keys of failures are few as a rule; then the records are not moved for the anti-join."""
    bad = checkpoint(failures(tables_results, table_schemas).select(*KEYS))
    small = bad.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return recs.join(F.broadcast(bad) if small else bad, KEYS, "left_anti")


def clean_records(tables_results: DataFrame, table_schemas: DataFrame) -> DataFrame:
    """Valid records in long typed form: KEYS, table_index, schema_name, col_name, and the value as text and typed.

    ``as_integer``, ``as_decimal`` (text of the exact number), ``as_boolean``, ``as_date`` hold the value
    where the rule has that type, null for an empty nullable value.
    """
    recs = records(tables_results)
    good = _without_failures(recs, tables_results, table_schemas)
    cells = good.select(*KEYS, "table_index", "schema_name", F.posexplode("fields").alias("c", "raw"))
    cells = cells.withColumn("col_pos", F.col("c") + 1).join(rules(table_schemas), ["schema_name", "col_pos"])
    v = F.when(F.trim("raw") != "", F.trim("raw"))

    def typed(name: str, value: Column) -> Column:
        return F.when(F.col("value_type") == name, value)

    return cells.select(
        *KEYS, "table_index", "schema_name", "col_pos", "col_name", "value_type", F.col("raw").alias("value"),
        typed("integer", v.try_cast("bigint")).alias("as_integer"),
        typed("decimal", F.regexp_replace(v, r"^\+", "")).alias("as_decimal"),
        typed("boolean", F.lower(v) == "true").alias("as_boolean"),
        typed("date", v.try_cast("date")).alias("as_date"),
    )


def typed_table(tables_results: DataFrame, table_schemas: DataFrame, schema_name: str) -> DataFrame:
    """Valid records of one schema as a wide table with typed columns."""
    spec = rules(table_schemas).filter(F.col("schema_name") == schema_name).orderBy("col_pos").collect()  # the columns of one schema
    kinds = {"integer": "bigint", "decimal": "decimal(38,9)", "boolean": "boolean", "date": "date", "text": "string"}
    mine = tables_results.filter(F.col("schema_name") == schema_name)
    good = _without_failures(records(mine), mine, table_schemas)
    cols = []
    for r in spec:
        raw = F.try_element_at("fields", F.lit(r["col_pos"]))
        cell = raw if r["value_type"] == "text" else F.when(F.trim(raw) != "", F.trim(raw)).try_cast(kinds.get(r["value_type"], "string"))
        cols.append(cell.alias(r["col_name"]))
    return good.select("result_id", "table_index", "row_number", *cols)
