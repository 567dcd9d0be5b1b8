"""Inline SVG: scraping from markup, naming, adjusting, JSX and data URIs, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# What is looked for in markup, and attribute names JSX spells differently.
SVG = r"((?is)<svg[\s>].*?</svg>)"
ID = r"""(?i)(?<![A-Za-z0-9_])id=["']([^"']+)["']"""
CLASS = r"""(?i)(?<![A-Za-z0-9_])class=["']([^"']+)["']"""
VIEW_BOX = r"""(?i)(?<![A-Za-z0-9_])viewBox=["']([^"']+)["']"""
JSX_NAMES = (("class", "className"), ("stroke-width", "strokeWidth"), ("stroke-linecap", "strokeLinecap"), ("stroke-linejoin", "strokeLinejoin"), ("fill-rule", "fillRule"), ("clip-rule", "clipRule"), ("stroke-miterlimit", "strokeMiterlimit"), ("stop-color", "stopColor"), ("stop-opacity", "stopOpacity"))


def load(source: str, fetch: Callable[[str], str] | None = None) -> str:
    """Markup of a local file, or of an address through the fetcher passed in; there is none by default."""
    if source.lower().startswith(("http://", "https://")):
        if fetch is None:
            raise ValueError("an address needs a fetcher")
        return fetch(source)
    with open(source, encoding="utf-8", errors="replace") as f:
        return f.read()


def scrape(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Inline SVG elements: id, index (from 1), svg_id, svg_class, view_box ("" where missing), svg. A nested svg ends the match at its own end."""
    found = df.filter(F.col(html_col).isNotNull()).select(id_col, F.posexplode(F.regexp_extract_all(F.col(html_col), F.lit(SVG), F.lit(1))).alias("_p", "svg"))
    return found.select(id_col, (F.col("_p") + 1).alias("index"), F.regexp_extract("svg", ID, 1).alias("svg_id"), F.regexp_extract("svg", CLASS, 1).alias("svg_class"), F.regexp_extract("svg", VIEW_BOX, 1).alias("view_box"), "svg")


def named(scraped: DataFrame, id_col: str) -> DataFrame:
    """File name of every scraped SVG: sanitised id, else first class, else ``icon_<n>``; repeats in a document get _2, _3 ..."""
    cls = F.regexp_extract("svg_class", r"^\s*(\S+)", 1)
    base = F.when(F.col("svg_id") != "", F.col("svg_id")).when(cls != "", cls).otherwise(F.concat(F.lit("icon_"), F.col("index").cast("string")))
    out = scraped.withColumn("_base", F.regexp_replace(base, "[^a-zA-Z0-9_-]", "_"))
    n = F.row_number().over(W.partitionBy(id_col, "_base").orderBy("index"))  # within one document
    return out.withColumn("_n", n).withColumn("file_name", F.concat("_base", F.when(F.col("_n") > 1, F.concat(F.lit("_"), F.col("_n").cast("string"))).otherwise(F.lit("")), F.lit(".svg"))).drop("_base", "_n")


def _attribute(svg: Column, name: str, value: str) -> Column:
    """Every ``name="..."`` set to the value; put into the first tag where there is none."""
    pattern = rf'(\s){name}="[^"]*"'
    safe = value.replace("\\", r"\\").replace("$", r"\$")
    first = F.regexp_replace(svg, r"(?s)^(.*?)<svg", f'$1<svg {name}="{safe}"')
    return F.when(svg.rlike(pattern), F.regexp_replace(svg, pattern, f'$1{name}="{safe}"')).otherwise(first)


def adjust(svg: Column, size: int = 0, width: int = 0, height: int = 0, stroke_width: str = "", color: str = "") -> Column:
    """Size (which beats width and height), stroke width, and a colour for ``currentColor`` fills and strokes."""
    for name, value in (("width", size or width), ("height", size or height)):
        if value > 0:
            svg = _attribute(svg, name, str(value))
    if stroke_width:
        svg = _attribute(svg, "stroke-width", stroke_width)
    if color:
        for name in ("fill", "stroke"):
            svg = F.replace(svg, F.lit(f'{name}="currentColor"'), F.lit(f'{name}="{color}"'))
    return svg


def pascal_case(name: Column) -> Column:
    parts = F.filter(F.split(name, r"[-_ .]+"), lambda p: p != "")
    joined = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))), "")
    return F.when(joined == "", "App").otherwise(joined)


def to_jsx(svg: Column, name: Column) -> Column:
    """A React component of an SVG."""
    for a, b in JSX_NAMES:
        svg = F.replace(svg, F.lit(a + "="), F.lit(b + "="))
    body = F.regexp_replace(svg, r"(?s)^(.*?)<svg", "$1<svg {...props}")
    comp = F.concat(pascal_case(name), F.lit("Icon"))
    return F.concat(F.lit('import React from "react";\n\nexport function '), comp, F.lit("(props: React.SVGProps<SVGSVGElement>) {\n  return (\n    "), body, F.lit("\n  );\n}\n\nexport default "), comp, F.lit(";\n"))


def data_uri(svg: Column) -> Column:
    """Base64 data URI without line breaks."""
    return F.concat(F.lit("data:image/svg+xml;base64,"), F.translate(F.base64(svg.cast("binary")), "\r\n", ""))
