"""A small icon catalogue with search and lookup. The drawings are our own, made from simple shapes.

Remote collections are reached only through a fetcher the caller passes in; without one, and when it fails or
finds nothing, the catalogue answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

MAX_LIMIT, DEFAULT_LIMIT = 64, 10

_SHAPES = {
    "sun": '<circle cx="12" cy="12" r="5"/><path d="M12 2V4M12 20V22M2 12H4M20 12H22"/>',
    "moon": '<path d="M16 4A9 9 0 1 0 20 15A7 7 0 0 1 16 4Z"/>',
    "drop": '<path d="M12 3Q19 12 12 20Q5 12 12 3Z"/>',
    "flake": '<path d="M12 3V21M4 8 20 16M20 8 4 16"/>',
    "peak": '<path d="M2 20 9 7 13 14 16 10 22 20Z"/>',
    "wave": '<path d="M2 12Q6 7 10 12T18 12T24 12"/>',
    "leaf": '<path d="M4 20Q4 6 20 4Q19 19 6 18"/>',
    "tree": '<path d="M12 2 19 14H5ZM12 14V22"/>',
    "fish": '<path d="M3 12Q10 5 17 12Q10 19 3 12ZM17 12 22 8V16Z"/>',
    "bowl": '<path d="M3 11H21Q20 20 12 20Q4 20 3 11Z"/>',
    "spoon": '<ellipse cx="12" cy="6" rx="3" ry="4"/><path d="M12 10V22"/>',
    "wheel": '<circle cx="12" cy="12" r="9"/><circle cx="12" cy="12" r="2"/><path d="M12 3V10M12 14V21M3 12H10M14 12H21"/>',
    "sail": '<path d="M11 3V16H4ZM13 6 20 16H13ZM3 18H21L18 22H6Z"/>',
    "tent": '<path d="M12 4 22 20H2ZM12 12 16 20H8Z"/>',
    "lamp": '<path d="M8 3H16L19 12H5ZM12 12V20M8 21H16"/>',
    "drum": '<ellipse cx="12" cy="7" rx="8" ry="3"/><path d="M4 7V17Q12 22 20 17V7"/>',
}
# (name, category, keywords, shape); the collection is "basic" or "marks"
_CATALOGUE = (
    ("noon", "Sky", "bright daytime", "sun"), ("night", "Sky", "crescent dark", "moon"), ("rain", "Sky", "water wet", "drop"), ("frost", "Sky", "snow cold winter", "flake"),
    ("summit", "Land", "mountain climb", "peak"), ("shore", "Land", "sea tide beach", "wave"), ("meadow", "Land", "green grass", "leaf"), ("forest", "Land", "wood pine", "tree"),
    ("trout", "Kitchen", "river swim", "fish"), ("soup", "Kitchen", "meal hot dish", "bowl"), ("porridge", "Kitchen", "breakfast oats", "spoon"), ("cart", "Travel", "wagon roll", "wheel"),
    ("regatta", "Travel", "boat wind", "sail"), ("camp", "Travel", "outdoors sleep", "tent"), ("evening", "Room", "reading glow", "lamp"), ("parade", "Room", "beat march", "drum"),
)
_MARKS = tuple(f"mark-{n}" for n in _SHAPES)


def rows() -> list[tuple]:
    """(ordinal, id, collection, name, category, keywords, svg) of the catalogue."""

    def svg(shape: str) -> str:
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="24" height="24" viewBox="0 0 24 24" fill="none" stroke="currentColor" stroke-width="2">{_SHAPES[shape]}</svg>'

    out = [("basic", n, c, k.split(), s) for n, c, k, s in _CATALOGUE] + [("marks", m, "Marks", [m[5:]], m[5:]) for m in _MARKS]
    return [(i, f"{col}:{n}", col, n, c, k, svg(s)) for i, (col, n, c, k, s) in enumerate(out)]


SCHEMA = "ordinal int, id string, collection string, name string, category string, keywords array<string>, svg string"


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), SCHEMA)


def collections(spark: SparkSession) -> DataFrame:
    return catalogue(spark).groupBy("collection").agg(F.count("*").cast("int").alias("total"), F.min("category").alias("category")).orderBy("collection")


def bounded(limit: int) -> int:
    return DEFAULT_LIMIT if limit <= 0 else min(limit, MAX_LIMIT)


def search(icons: DataFrame, query: str, collection: str = "", limit: int = 0) -> DataFrame:
    """Icons of which any query word is part of the name, id, category or a keyword, in catalogue order."""
    out = icons.filter(F.lower("collection") == collection.lower()) if collection else icons
    tokens = query.lower().split()
    if tokens:
        hay = F.concat(F.array(F.lower("name"), F.lower("id"), F.lower("category")), F.transform("keywords", lambda k: F.lower(k)))
        wanted = F.array(*[F.lit(t) for t in tokens])
        out = out.filter(F.exists(wanted, lambda t: F.exists(hay, lambda h: F.contains(h, t))))
    return out.orderBy("ordinal").limit(bounded(limit)).select("ordinal", "id", "collection", "name", "category")


def resolve(icons: DataFrame, inputs: DataFrame, input_col: str) -> DataFrame:
    """(collection, name) of every input: ``a:b`` and ``a/b`` are split, else exact id or name, else exact keyword, else ``basic:<input>``.

    The catalogue is small and fixed, so its side of the join is broadcast.
    """
    keys = icons.select(F.explode(F.concat(F.array(F.struct(F.lit(0).alias("rank"), F.lower("name").alias("key"))), F.transform("keywords", lambda k: F.struct(F.lit(1).alias("rank"), F.lower(k).alias("key"))))).alias("k"), "ordinal", "collection", "name")
    keys = keys.groupBy("k.key").agg(F.min_by(F.struct("collection", "name"), F.struct("k.rank", "ordinal")).alias("hit"))
    src = inputs.select(F.col(input_col)).distinct()
    split = F.when(F.col(input_col).contains(":"), F.split(input_col, ":", 2)).when(F.col(input_col).contains("/"), F.split(input_col, "/", 2))
    out = src.withColumn("_s", split).join(F.broadcast(keys), F.lower(input_col) == F.col("key"), "left")
    return out.select(input_col, F.coalesce(F.col("_s")[0], "hit.collection", F.lit("basic")).alias("collection"), F.coalesce(F.col("_s")[1], "hit.name", F.col(input_col)).alias("name"))


def get(icons: DataFrame, name: str, fetch: Callable[[str, str], str | None] | None = None) -> tuple[str, str, str] | None:
    """(collection, name, svg) of one icon, from the fetcher where given, else the catalogue."""
    spark = icons.sparkSession
    hit = resolve(icons, spark.createDataFrame([(name,)], "q string"), "q").first()
    if fetch:
        try:
            if svg := fetch(hit["collection"], hit["name"]):
                return hit["collection"], hit["name"], svg
        except OSError:
            pass
    row = icons.filter((F.col("collection") == hit["collection"]) & (F.col("name") == hit["name"])).orderBy("ordinal").limit(1).collect()
    return (hit["collection"], hit["name"], row[0]["svg"]) if row else None
