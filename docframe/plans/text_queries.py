"""Registered queries of the line, text, chunk, extraction, SVG and icon operators, with their SQL.

Texts are decorated alike in Spark and SQL where the tables lack what an operator acts on (ANSI colours, CRLF,
trailing blanks, links, SVG). Every query reads its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docframe.functions import text as X
from docframe.operators import chunking, concat, extract, icons, search, svg
from docframe.session import table

SPACES = r"\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
NL, CR, ESC, TAB = "chr(10)", "chr(13)", "chr(27)", "chr(9)"
QUERY = "small Robot"
VERSION = r"\bv?\d+\.\d+(\.\d+)?\b"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").filter("text is not null")


def _rough(text: Column) -> Column:
    """ANSI colours around the text, CRLF, trailing blanks and blank lines between its lines."""
    return F.concat(F.lit("\x1b[31m"), F.replace(text, F.lit("\n"), F.lit("  \t\r\n\r\n")), F.lit("\x1b[0m"))


ROUGH = f"concat({ESC}, '[31m', replace(text, {NL}, concat('  ', {TAB}, {CR}, {NL}, {CR}, {NL})), {ESC}, '[0m')"


def _linked(doc: DataFrame) -> Column:
    n = F.col("doc_id")
    return F.concat("text", F.lit(" see https://example.com/"), n.cast("string"), F.lit(", (http://a.example/b?c=1) mail a.b+"), n.cast("string"), F.lit("@mail.example.org; on 2024-01-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit(". Mar 3, 2021; 4/5/21,"))


LINKED = "concat(text, ' see https://example.com/', doc_id::VARCHAR, ', (http://a.example/b?c=1) mail a.b+', doc_id::VARCHAR, '@mail.example.org; on 2024-01-', lpad((doc_id % 28 + 1)::VARCHAR, 2, '0'), '. Mar 3, 2021; 4/5/21,')"


def _svg(spark: SparkSession, d: str) -> DataFrame:
    """A page of the whole text and four inline SVG."""
    n = F.col("doc_id").cast("string")
    html = F.concat(F.lit('<p class="x">'), F.col("text"), F.lit('</p><svg id="i'), n, F.lit(' a" class="k z" viewBox="0 0 24 24" stroke="currentColor">\n<g/></svg><svg class="dot m" width="8"><path/></svg><SVG data-id="q" fill="currentColor"><b/></SVG><svg class="dot"></svg>'))
    return _docs(spark, d).select("doc_id", html.alias("html"))


HTML = """concat('<p class="x">', text, '</p><svg id="i', doc_id::VARCHAR, ' a" class="k z" viewBox="0 0 24 24" stroke="currentColor">', chr(10), '<g/></svg><svg class="dot m" width="8"><path/></svg><SVG data-id="q" fill="currentColor"><b/></SVG><svg class="dot"></svg>')"""


# --- queries -------------------------------------------------------------------------------------------------


def search_literal_ci(spark, d):
    return search.search_lines(_docs(spark, d), "doc_id", "text", QUERY).select("doc_id", "line_number", "column_number", "matched_text")


def search_context(spark, d):
    return search.search_lines(_docs(spark, d), "doc_id", "text", QUERY, before=2, after=2)


def search_regex_cs(spark, d):
    return search.search_lines(_docs(spark, d), "doc_id", "text", VERSION, regex=True, case_sensitive=True, scan=True).select("doc_id", "line_number", "column_number", "line_text", "matched_text")


def search_capped(spark, d):
    found = search.search_lines(_docs(spark, d), "doc_id", "text", QUERY)
    return search.capped(found, "doc_id", 100).select("doc_id", "line_number", "line_text")


def search_summary(spark, d):
    docs = _docs(spark, d)
    return search.summary(docs, search.search_lines(docs, "doc_id", "text", QUERY), "doc_id")


def read_lines(spark, d):
    return search.read_lines(_docs(spark, d), "doc_id", "text", 3, 5, 1)


def read_lines_to_end(spark, d):
    return search.read_lines(_docs(spark, d), "doc_id", "text", 2).select("doc_id", "line_number", "byte_length")


def line_stats(spark, d):
    lines = search.line_table(_docs(spark, d), "doc_id", "text")
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum("byte_length").alias("bytes"), F.max("byte_length").alias("longest"))


def _edit(spark, d, value):
    return _docs(spark, d).select("doc_id", value.alias("e")).select("doc_id", "e.text", "e.lines_affected", "e.total_lines", "e.bytes_written")


def replace_lines(spark, d):
    return _edit(spark, d, X.replace_lines(F.col("text"), 2, 3, "new one\nnew two"))


def insert_before(spark, d):
    return _edit(spark, d, X.insert_lines(F.col("text"), 2, "inserted"))


def insert_after(spark, d):
    return _edit(spark, d, X.insert_lines(F.col("text"), 4, "inserted\r\ntwice", before=False))


def delete_lines(spark, d):
    return _edit(spark, d, X.delete_lines(F.col("text"), 2, 4))


def line_endings(spark, d):
    return _docs(spark, d).select("doc_id", (X.line_ending(F.col("text")) == "\r\n").alias("crlf"))


def _cleaned(spark, d, **o):
    return _docs(spark, d).select("doc_id", X.clean(_rough(F.col("text")), X.Clean(**o)).alias("c")).select("doc_id", "c.*")


def clean_all(spark, d):
    return _cleaned(spark, d, strip_ansi=True, remove_chars="xyz", ascii_only=True, trim_lines=True, drop_blank=True)


def clean_regex(spark, d):
    return _cleaned(spark, d, pattern=r"(\d+)", replace_with="#${1}#", crlf=True)


def clean_ascii(spark, d):
    return _cleaned(spark, d, ascii_only=True).select("doc_id", "chars_removed", "text")


def token_estimate(spark, d):
    return _docs(spark, d).select("doc_id", X.token_estimate(F.col("text")).alias("e")).select("doc_id", "e.characters", "e.words", "e.tokens")


def sentence_split(spark, d):
    lines = _docs(spark, d).select("doc_id", F.posexplode(X.split_lines(F.col("text"))).alias("line", "t"))
    return lines.select("doc_id", "line", F.posexplode(X.sentences(F.col("t"))).alias("n", "sentence"))


def chunk_plain(spark, d):
    return chunking.chunks(_docs(spark, d), "doc_id", "text", 64)


def chunk_overlap(spark, d):
    return chunking.chunks(_docs(spark, d), "doc_id", "text", 64, 40)


def chunk_sentence(spark, d):
    return chunking.chunks(_docs(spark, d), "doc_id", "text", 64, 0, by_sentence=True)


def chunk_summary(spark, d):
    return chunking.chunk_summary(chunk_plain(spark, d), "doc_id")


def _types(spark, d):
    return table(spark, d, "documents", "doc_id", "doc_type", "text")


def concat_by_type(spark, d):
    return concat.concat_lines(_types(spark, d), "doc_id", "text", header="=== %f (%n) ===", delimiter="---", group_col="doc_type")


def concat_totals(spark, d):
    return concat.totals(concat.concat_lines(_types(spark, d), "doc_id", "text", numbered=True, group_col="doc_type"), "doc_id", "doc_type")


def concat_all(spark, d):
    """All documents as one ordered output: sorted by a range shuffle, written part by part."""
    return concat.concat_lines(_docs(spark, d), "doc_id", "text", header="# %b", delimiter="--").orderBy("doc_id", "position")


def concat_text(spark, d):
    """The chunks of each result joined into its text: one row, or of a hot result several rows in order, each with its own bytes."""
    chunks = table(spark, d, "chunks", "result_id", "chunk_id", "text")
    lines = concat.concat_lines(chunks, "chunk_id", "text", delimiter="--", group_col="result_id")
    return concat.parts(lines, "chunk_id", "result_id").orderBy("result_id", "part").drop("part")


def _links(spark, d):
    docs = _docs(spark, d)
    return extract.links(docs.select("doc_id", _linked(docs).alias("t")), "doc_id", "t")


def extract_links(spark, d):
    return _links(spark, d)


def extract_link_totals(spark, d):
    return extract.link_totals(_links(spark, d))


def doc_metadata(spark, d):
    return extract.metadata(_docs(spark, d), "doc_id", "text")


def supported_paths(spark, d):
    files = table(spark, d, "file_entries", "entry_id", "path").filter("path is not null")
    return files.select("entry_id", extract.extension(F.col("path")).alias("extension"), extract.is_supported(F.col("path")).alias("supported"))


def csv_table(spark, d):
    rows = table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey")
    line = F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string"))
    doc = rows.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))), lambda x: x["l"]), "\r\n\n").alias("t"))
    return extract.csv_tables(doc, "n_regionkey", "t")


def html_escaped(spark, d):
    return _docs(spark, d).select("doc_id", X.html_escape(F.col("text")).alias("escaped"))


def sheet_names(spark, d):
    """Spreadsheet names of column numbers: here those of the documents' ids up to ZZZ."""
    return _docs(spark, d).select("doc_id", X.column_name((F.col("doc_id") % 18278 + 1).cast("int")).alias("name"))


def image_fit(spark, d):
    src = table(spark, d, "part", "p_partkey", "p_size")
    f = X.fit(F.col("p_size").cast("double"), F.col("p_partkey").cast("double"), 190.0, 277.0)
    return src.select("p_partkey", f["width"].alias("width"), f["height"].alias("height"))


def svg_scrape(spark, d):
    return svg.scrape(_svg(spark, d), "doc_id", "html")


def svg_names(spark, d):
    return svg.named(svg.scrape(_svg(spark, d), "doc_id", "html"), "doc_id").select("doc_id", "index", "file_name")


def svg_adjust(spark, d):
    s = svg.scrape(_svg(spark, d), "doc_id", "html")
    return s.select("doc_id", "index", svg.adjust(F.col("svg"), size=32, stroke_width="1.5", color="#a0b1c2").alias("svg"))


def svg_jsx(spark, d):
    s = svg.scrape(_svg(spark, d), "doc_id", "html")
    return s.select("doc_id", "index", svg.to_jsx(F.col("svg"), F.col("svg_class")).alias("jsx"))


def svg_data_uri(spark, d):
    s = svg.scrape(_svg(spark, d), "doc_id", "html")
    return s.select("doc_id", "index", svg.data_uri(F.col("svg")).alias("uri"))


def icon_search(spark, d):
    return icons.search(icons.catalogue(spark), "Travel mark-d", limit=20)


def icon_collections(spark, d):
    return icons.collections(spark)


def icon_resolve(spark, d):
    asked = spark.createDataFrame([(x,) for x in ("noon", "WAGON", "basic:camp", "marks/mark-drop", "nothing", "mark-leaf", "tide")], "q string")
    return icons.resolve(icons.catalogue(spark), asked, "q")


def queries() -> dict:
    named = (
        search_literal_ci, search_context, search_regex_cs, search_capped, search_summary, read_lines, read_lines_to_end, line_stats, replace_lines, insert_before, insert_after, delete_lines, line_endings,
        clean_all, clean_regex, clean_ascii, token_estimate, sentence_split, chunk_plain, chunk_overlap, chunk_sentence, chunk_summary, concat_by_type, concat_totals, concat_all, concat_text, extract_links, extract_link_totals,
        doc_metadata, supported_paths, csv_table, html_escaped, sheet_names, image_fit, svg_scrape, svg_names, svg_adjust, svg_jsx, svg_data_uri, icon_search, icon_collections, icon_resolve,
    )
    return {f.__name__: f for f in named}


# --- SQL -------------------------------------------------------------------------------------------------------

_SPLIT = f"string_split(replace(text, {CR} || {NL}, {NL}), {NL})"
_SCAN = f"""CASE WHEN text = '' THEN []::VARCHAR[] ELSE list_transform(
    CASE WHEN suffix(text, {NL}) THEN list_slice(string_split(text, {NL}), 1, len(string_split(text, {NL})) - 1) ELSE string_split(text, {NL}) END,
    lambda x: CASE WHEN suffix(x, {CR}) THEN substr(x, 1, length(x) - 1) ELSE x END) END"""


def _words(e: str) -> str:
    return f"len(regexp_extract_all({e}, '[^{SPACES}]+'))"


def _tokens(e: str) -> str:
    return f"(CASE WHEN length({e}) = 0 THEN 0 ELSE greatest(1, floor((length({e}) / 4.0::DOUBLE + {_words(e)} * 1.3::DOUBLE) / 2.0::DOUBLE)) END)::INTEGER"


def _trim(e: str) -> str:
    return f"regexp_replace({e}, '^[{SPACES}]+|[{SPACES}]+$', '', 'g')"


def _lines(kind: str, source: str = "documents") -> str:
    return f"l AS (SELECT doc_id, {kind} AS ls FROM {source} WHERE text IS NOT NULL), u AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l)"


def _found(kind: str, pattern: str) -> str:
    return f"""WITH {_lines(kind)}, m AS (SELECT doc_id, ls, i, ls[i] AS line, regexp_extract(ls[i], '{pattern}', 0) AS hit FROM u WHERE regexp_matches(ls[i], '{pattern}')),
      r AS (SELECT doc_id, i::INTEGER AS line_number, (strlen(substr(line, 1, instr(line, hit) - 1)) + 1)::INTEGER AS column_number, line AS line_text, hit AS matched_text,
        list_slice(ls, greatest(i - 2, 1), i - 1) AS before_context, list_slice(ls, i + 1, i + 2) AS after_context FROM m)"""


def _edit_sql(new: str, affected: int) -> str:
    ending = f"CASE WHEN instr(text, {CR} || {NL}) > 0 AND strlen(substr(text, 1, instr(text, {CR} || {NL}) - 1)) + 2 <= 4096 THEN {CR} || {NL} ELSE {NL} END"
    return f"""WITH l AS (SELECT doc_id, {_SCAN} AS ls, {ending} AS e FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, e, {new} AS ls FROM l),
      o AS (SELECT doc_id, ls, CASE WHEN len(ls) = 0 THEN '' ELSE replace(array_to_string(ls, {NL}) || {NL}, {NL}, e) END AS text FROM n)
      SELECT doc_id, text, {affected} AS lines_affected, len(ls)::INTEGER AS total_lines, strlen(text)::INTEGER AS bytes_written FROM o"""


def _clean_sql(steps: list[tuple[str, str]], final: str, glue: str, removed: str, matched: str = "0") -> str:
    ctes, last = [f"t0 AS (SELECT doc_id, {ROUGH} AS text FROM documents WHERE text IS NOT NULL)"], "t0"
    for k, (name, e) in enumerate(steps):
        ctes.append(f"{name} AS (SELECT *, text AS before_{name}, {e} AS after_{name} FROM (SELECT * REPLACE ({'after_' + steps[k - 1][0] if k else 'text'} AS text) FROM {last}))")
        last = name
    text = f"after_{last}" if steps else "text"
    return f"""WITH {', '.join(ctes)}, s AS (SELECT *, string_split(replace({text}, {CR} || {NL}, {NL}), {NL}) AS ls FROM {last}), f AS (SELECT *, {final} AS shown FROM s)
      SELECT doc_id, array_to_string(shown, {glue}) AS text, len(ls)::INTEGER AS original_lines, len(shown)::INTEGER AS resulting_lines, ({removed})::INTEGER AS chars_removed, ({matched})::INTEGER AS patterns_matched FROM f"""


def _chunk_sql(units: str, glue: str, most: int, lap: int) -> str:
    """Chunk boundaries as recurrences over running token sums."""
    step = "s.j" if not lap else f"greatest(c.i + 1, 1 + coalesce((SELECT max(k.i) FROM c_sum k WHERE k.doc_id = c.doc_id AND k.i > c.i AND k.i < s.j AND s.upto - k.before >= {lap}), c.i))"
    return f"""WITH RECURSIVE {units},
      c_sum AS MATERIALIZED (SELECT doc_id, i, line, u, sum(tok) OVER w AS upto, sum(tok) OVER w - tok AS before, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT *, {_tokens('u')} AS tok FROM units) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
      far AS MATERIALIZED (SELECT a.doc_id, a.i, coalesce(min(b.i), any_value(a.n) + 1) AS j FROM c_sum a LEFT JOIN c_sum b ON b.doc_id = a.doc_id AND b.i > a.i AND b.upto > a.before + {most} AND b.before > a.before GROUP BY a.doc_id, a.i),
      succ AS MATERIALIZED (SELECT f.doc_id, f.i, f.j, e.upto, e.n FROM far f JOIN c_sum e ON e.doc_id = f.doc_id AND e.i = f.j - 1),
      nexts AS MATERIALIZED (SELECT c.doc_id, c.i, s.j, CASE WHEN s.j <= s.n THEN {step} END AS nxt FROM c_sum c JOIN succ s ON s.doc_id = c.doc_id AND s.i = c.i),
      walk AS (SELECT doc_id, i, j, nxt, 0 AS idx FROM nexts WHERE i = 1 UNION ALL SELECT n.doc_id, n.i, n.j, n.nxt, w.idx + 1 FROM walk w JOIN nexts n ON n.doc_id = w.doc_id AND n.i = w.nxt),
      txt AS (SELECT w.doc_id, w.idx, min(c.line) AS start_line, max(c.line) AS end_line, regexp_replace(string_agg(c.u, {glue} ORDER BY c.i), '^\\n+', '') AS text
        FROM walk w JOIN c_sum c ON c.doc_id = w.doc_id AND c.i >= w.i AND c.i < w.j GROUP BY w.doc_id, w.idx),
      res AS (SELECT doc_id, idx::INTEGER AS "index", text, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line, length(text)::INTEGER AS characters, {_tokens('text')} AS tokens FROM txt)"""


_LINE_UNITS = f"{_lines(_SPLIT)}, units AS (SELECT doc_id, i, i AS line, ls[i] AS u FROM u)"
_SENTENCES = f"list_filter(list_transform(string_split(regexp_replace(ls[i], '([.!?])([{SPACES}])', '\\1' || chr(57344) || '\\2', 'g'), chr(57344)), lambda x: {_trim('x')}), lambda x: x <> '')"
_SENTENCE_UNITS = f"""{_lines(_SPLIT)}, s AS (SELECT doc_id, i AS line, {_SENTENCES} AS ss FROM u), s2 AS (SELECT doc_id, line, unnest(ss) AS u, unnest(range(1, len(ss) + 1)) AS p FROM s),
      units AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line, p) AS i, line, u FROM s2)"""


def _concat_sql(head: str, cut: str, line: str, group: str = "doc_type", name: str = "doc_id", source: str = "documents") -> str:
    return f"""WITH l AS (SELECT {group}, {name}, {_SCAN} AS ls, min({name}) OVER (PARTITION BY {group}) AS first FROM {source} WHERE text IS NOT NULL),
      p AS (SELECT {group}, {name}, list_concat(list_concat({cut}, {head}), list_transform(ls, lambda x, i: {line})) AS part FROM l),
      r AS (SELECT {group}, {name}, unnest(range(0, len(part)))::INTEGER AS position, unnest(part) AS line FROM p)"""


def _unique(pattern: str) -> str:
    return f"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(t, '{pattern}', 0), lambda x: rtrim(x, '.,;:)')), lambda x: x <> '')))"


def _quoted(text: str) -> str:
    return text.replace("'", "''")


_LINKS = f"WITH d AS (SELECT doc_id, {LINKED} AS t FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, {_unique(_quoted(X.URL))} AS urls, {_unique(_quoted(X.EMAIL))} AS emails, {_unique(_quoted(X.DATE))} AS dates FROM d)"
_SVGS = f"""h AS (SELECT doc_id, regexp_extract_all({HTML}, '(?is)<svg[\\s>].*?</svg>', 0) AS ss FROM documents WHERE text IS NOT NULL),
      v AS (SELECT doc_id, unnest(range(1, len(ss) + 1))::INTEGER AS "index", unnest(ss) AS svg FROM h),
      sv AS (SELECT doc_id, "index", svg, regexp_extract(svg, '(?i)\\bid=["'']([^"'']+)["'']', 1) AS svg_id, regexp_extract(svg, '(?i)\\bclass=["'']([^"'']+)["'']', 1) AS svg_class, regexp_extract(svg, '(?i)\\bviewBox=["'']([^"'']+)["'']', 1) AS view_box FROM v)"""


def _set_attr(e: str, name: str, value: str) -> str:
    return f"""CASE WHEN regexp_matches({e}, '\\s{name}="[^"]*"') THEN regexp_replace({e}, '(\\s){name}="[^"]*"', '\\1{name}="{value}"', 'g') ELSE regexp_replace({e}, '<svg', '<svg {name}="{value}"') END"""


def _catalogue_sql() -> str:
    values = ", ".join(f"({i}, '{a}', '{c}', '{n}', '{k}', [{', '.join(repr(w) for w in kw)}])" for i, a, c, n, k, kw, _ in icons.rows())
    return f"cat(ordinal, id, collection, name, category, keywords) AS (VALUES {values})"


def oracle_sql() -> dict[str, str]:
    literal = "(?i)small robot"
    version = _quoted(VERSION)
    adjusted = f"""SELECT doc_id, "index", replace(replace(c, 'fill="currentColor"', 'fill="#a0b1c2"'), 'stroke="currentColor"', 'stroke="#a0b1c2"') AS svg FROM
        (SELECT doc_id, "index", {_set_attr('b', 'stroke-width', '1.5')} AS c FROM (SELECT doc_id, "index", {_set_attr('a', 'height', '32')} AS b FROM (SELECT doc_id, "index", {_set_attr('svg', 'width', '32')} AS a FROM sv)))"""
    jsx = "svg"
    for a, b in svg.JSX_NAMES:
        jsx = f"replace({jsx}, '{a}=', '{b}=')"
    pascal = "array_to_string(list_transform(list_filter(regexp_split_to_array(svg_class, '[-_ .]+'), lambda p: p <> ''), lambda p: upper(p[1]) || lower(substr(p, 2))), '')"
    comp = f"(CASE WHEN {pascal} = '' THEN 'App' ELSE {pascal} END) || 'Icon'"
    ends = f"instr(text, {CR} || {NL})"
    chunk = _chunk_sql(_LINE_UNITS, NL, 64, 0)
    trimmed = f"list_filter(list_transform(ls, lambda x: regexp_replace(x, '[ \\t]+$', '')), lambda x: {_trim('x')} <> '')"
    return {
        "search_literal_ci": f"{_found(_SPLIT, literal)} SELECT doc_id, line_number, column_number, matched_text FROM r",
        "search_context": f"{_found(_SPLIT, literal)} SELECT doc_id, line_number, column_number, line_text, matched_text, before_context, after_context FROM r",
        "search_regex_cs": f"{_found(_SCAN, version)} SELECT doc_id, line_number, column_number, line_text, matched_text FROM r",
        "search_capped": f"{_found(_SPLIT, literal)} SELECT doc_id, line_number, line_text FROM r ORDER BY doc_id, line_number LIMIT 100",
        "search_summary": f"{_found(_SPLIT, literal)} SELECT count(*) AS total_matches, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS files_scanned, count(DISTINCT doc_id) AS files_matched FROM r",
        "read_lines": f"""WITH {_lines(_SCAN)} SELECT doc_id, 3 AS start_line, least(5, len(ls))::INTEGER AS end_line, len(ls)::INTEGER AS total_lines, i::INTEGER AS line_number, ls[i] AS content, strlen(ls[i])::INTEGER AS byte_length FROM u WHERE i BETWEEN 2 AND 6""",
        "read_lines_to_end": f"WITH {_lines(_SCAN)} SELECT doc_id, i::INTEGER AS line_number, strlen(ls[i])::INTEGER AS byte_length FROM u WHERE i >= 2",
        "line_stats": f"WITH {_lines(_SCAN)} SELECT doc_id, count(*) AS lines, sum(strlen(ls[i]))::BIGINT AS bytes, max(strlen(ls[i]))::INTEGER AS longest FROM u GROUP BY doc_id",
        "replace_lines": _edit_sql("list_concat(list_concat(list_slice(ls, 1, 1), ['new one', 'new two']), list_slice(ls, 4, len(ls)))", 2),
        "insert_before": _edit_sql("list_concat(list_concat(list_slice(ls, 1, 1), ['inserted']), list_slice(ls, 2, len(ls)))", 1),
        "insert_after": _edit_sql("list_concat(list_concat(list_slice(ls, 1, 4), ['inserted', 'twice']), list_slice(ls, 5, len(ls)))", 1),
        "delete_lines": _edit_sql("list_concat(list_slice(ls, 1, 1), list_slice(ls, 5, len(ls)))", 3),
        "line_endings": f"SELECT doc_id, ({ends} > 0 AND strlen(substr(text, 1, {ends} - 1)) + 2 <= 4096) AS crlf FROM documents WHERE text IS NOT NULL",
        "clean_all": _clean_sql(
            [("a", "regexp_replace(text, '\\x1b\\[[0-9;]*[a-zA-Z]', '', 'g')"), ("r", "translate(text, 'xyz', '')"), ("p", "regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')")],
            trimmed, NL, "strlen(before_a) - strlen(after_a) + length(before_r) - length(after_r) + length(before_p) - length(after_p)",
        ),
        "clean_regex": _clean_sql([("g", "regexp_replace(text, '([0-9]+)', '#\\1#', 'g')")], "ls", f"{CR} || {NL}", "0", "len(regexp_extract_all(before_g, '[0-9]+'))"),
        "clean_ascii": "SELECT doc_id, chars_removed, text FROM (" + _clean_sql([("p", "regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')")], "ls", NL, "length(before_p) - length(after_p)") + ")",
        "token_estimate": f"SELECT doc_id, length(text)::INTEGER AS characters, {_words('text')}::INTEGER AS words, {_tokens('text')} AS tokens FROM documents WHERE text IS NOT NULL",
        "sentence_split": f"WITH {_lines(_SPLIT)}, s AS (SELECT doc_id, i, {_SENTENCES} AS ss FROM u) SELECT doc_id, (i - 1)::INTEGER AS line, unnest(range(0, len(ss)))::INTEGER AS n, unnest(ss) AS sentence FROM s",
        "chunk_plain": f"{chunk} SELECT * FROM res",
        "chunk_overlap": f"{_chunk_sql(_LINE_UNITS, NL, 64, 40)} SELECT * FROM res",
        "chunk_sentence": f"{_chunk_sql(_SENTENCE_UNITS, repr(' '), 64, 0)} SELECT * FROM res",
        "chunk_summary": f"{chunk} SELECT doc_id, count(*)::INTEGER AS total_chunks, sum(tokens)::BIGINT AS total_tokens FROM res GROUP BY doc_id",
        "concat_by_type": _concat_sql("['=== ' || doc_id::VARCHAR || ' (' || len(ls)::VARCHAR || ') ===']", "CASE WHEN doc_id > first THEN ['---'] ELSE []::VARCHAR[] END", "x") + " SELECT doc_type, doc_id, position, line FROM r",
        "concat_totals": _concat_sql("[]::VARCHAR[]", "[]::VARCHAR[]", "CASE WHEN i < 1000 THEN lpad(i::VARCHAR, 4, ' ') ELSE i::VARCHAR END || ' | ' || x") + " SELECT doc_type, count(DISTINCT doc_id) AS files_processed, count(*) AS total_lines, sum(strlen(line) + 1)::BIGINT AS total_bytes FROM r GROUP BY doc_type",
        "concat_all": _concat_sql("['# ' || doc_id::VARCHAR]", "CASE WHEN doc_id > first THEN ['--'] ELSE []::VARCHAR[] END", "x", "1 AS g", "doc_id").replace("PARTITION BY 1 AS g", "").replace("SELECT 1 AS g, doc_id, list", "SELECT doc_id, list").replace("SELECT 1 AS g, doc_id, unnest", "SELECT doc_id, unnest") + " SELECT doc_id, position, line FROM r",
        "concat_text": _concat_sql("[]::VARCHAR[]", "CASE WHEN chunk_id > first THEN ['--'] ELSE []::VARCHAR[] END", "x", "result_id", "chunk_id", "chunks") + f" SELECT result_id, string_agg(line, {NL} ORDER BY chunk_id, position) || {NL} AS text, sum(strlen(line) + 1)::BIGINT AS total_bytes FROM r GROUP BY result_id",
        "extract_links": f"{_LINKS} SELECT * FROM r",
        "extract_link_totals": f"{_LINKS} SELECT sum(len(urls))::BIGINT AS urls, sum(len(emails))::BIGINT AS emails, sum(len(dates))::BIGINT AS dates, (sum(len(urls)) + sum(len(emails)))::BIGINT AS total FROM r",
        "doc_metadata": f"SELECT doc_id, strlen(text)::INTEGER AS size_bytes, {_words('text')}::INTEGER AS words, strlen(text)::INTEGER AS characters, len({_SPLIT})::INTEGER AS lines FROM documents WHERE text IS NOT NULL",
        "supported_paths": "SELECT entry_id, lower(regexp_extract(path, '\\.([^./\\\\]+)$', 1)) AS extension, lower(regexp_extract(path, '\\.([^./\\\\]+)$', 1)) IN ('pdf', 'docx', 'xlsx', 'csv', 'md', 'txt', 'text', 'log') AS supported FROM file_entries WHERE path IS NOT NULL",
        "csv_table": """WITH o AS (SELECT n_regionkey, [n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR] AS c, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INTEGER AS "row" FROM nation)
          SELECT n_regionkey, "row", unnest(range(0, 3))::INTEGER AS col, unnest(c) AS value FROM o""",
        "html_escaped": """SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&#34;'), '''', '&#39;') AS escaped FROM documents WHERE text IS NOT NULL""",
        "sheet_names": """WITH n AS (SELECT doc_id, (doc_id % 18278 + 1)::INTEGER AS n FROM documents WHERE text IS NOT NULL)
          SELECT doc_id, CASE WHEN n > 702 THEN chr((65 + (n - 703) // 676)::INTEGER) ELSE '' END || CASE WHEN n > 26 THEN chr((65 + ((n - 27) // 26) % 26)::INTEGER) ELSE '' END || chr((65 + (n - 1) % 26)::INTEGER) AS name FROM n""",
        "image_fit": "SELECT p_partkey, p_size::DOUBLE * s AS width, p_partkey::DOUBLE * s AS height FROM (SELECT *, CASE WHEN p_size > 0 AND p_partkey > 0 THEN least(190.0::DOUBLE / p_size, 277.0::DOUBLE / p_partkey) END AS s FROM part)",
        "svg_scrape": f'WITH {_SVGS} SELECT doc_id, "index", svg_id, svg_class, view_box, svg FROM sv',
        "svg_names": f"""WITH {_SVGS}, b AS (SELECT doc_id, "index", regexp_replace(CASE WHEN svg_id <> '' THEN svg_id WHEN svg_class <> '' THEN string_split(svg_class, ' ')[1] ELSE 'icon_' || "index"::VARCHAR END, '[^a-zA-Z0-9_-]', '_', 'g') AS base FROM sv),
          n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY "index") AS k FROM b) SELECT doc_id, "index", base || CASE WHEN k > 1 THEN '_' || k::VARCHAR ELSE '' END || '.svg' AS file_name FROM n""",
        "svg_adjust": f"WITH {_SVGS} {adjusted}",
        "svg_jsx": f"""WITH {_SVGS} SELECT doc_id, "index", concat('import React from "react";', {NL}, {NL}, 'export function ', {comp}, '(props: React.SVGProps<SVGSVGElement>) {{', {NL}, '  return (', {NL}, '    ', regexp_replace({jsx}, '<svg', '<svg {{...props}}'), {NL}, '  );', {NL}, '}}', {NL}, {NL}, 'export default ', {comp}, ';', {NL}) AS jsx FROM sv""",
        "svg_data_uri": f"""WITH {_SVGS} SELECT doc_id, "index", 'data:image/svg+xml;base64,' || to_base64(encode(svg)) AS uri FROM sv""",
        "icon_search": f"WITH {_catalogue_sql()} SELECT ordinal, id, collection, name, category FROM cat WHERE len(list_filter(['travel', 'mark-d'], lambda t: contains(name, t) OR contains(id, t) OR contains(lower(category), t) OR len(list_filter(keywords, lambda k: contains(k, t))) > 0)) > 0 ORDER BY ordinal LIMIT 20",
        "icon_collections": f"WITH {_catalogue_sql()} SELECT collection, count(*)::INTEGER AS total, min(category) AS category FROM cat GROUP BY collection",
        "icon_resolve": f"""WITH {_catalogue_sql()}, q(q) AS (VALUES ('noon'), ('WAGON'), ('basic:camp'), ('marks/mark-drop'), ('nothing'), ('mark-leaf'), ('tide')),
          k AS (SELECT collection, name, ordinal, 0 AS rank, name AS key FROM cat UNION ALL SELECT collection, name, ordinal, 1, unnest(keywords) FROM cat),
          b AS (SELECT key, arg_min(collection, rank * 1000 + ordinal) AS collection, arg_min(name, rank * 1000 + ordinal) AS name FROM k GROUP BY key)
          SELECT q.q, CASE WHEN contains(q.q, ':') THEN split_part(q.q, ':', 1) WHEN contains(q.q, '/') THEN split_part(q.q, '/', 1) ELSE coalesce(b.collection, 'basic') END AS collection,
            CASE WHEN contains(q.q, ':') THEN split_part(q.q, ':', 2) WHEN contains(q.q, '/') THEN split_part(q.q, '/', 2) ELSE coalesce(b.name, q.q) END AS name FROM q LEFT JOIN b ON lower(q.q) = b.key""",
    }
