import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from docframe.functions import regex, text as X
from docframe.operators import chunking, concat, extract, search
from docframe.plans import text_queries

SPACE = chunking._SPACES


def scan(t):
    parts = t.split("\n")
    if parts[-1] == "":
        parts.pop()
    return [p[:-1] if p.endswith("\r") else p for p in parts]


def one(spark, text, value):
    return spark.createDataFrame([(text,)], "text string").select(value.alias("v")).first()["v"]


@pytest.mark.parametrize("t", ["", "a", "a\n", "a\r\nb\r\n", "\n", "\n\n", "a\rb\n", "x\n\ny", "é z"])
def test_line_models(spark, t):
    assert one(spark, t, X.scan_lines(F.col("text"))) == scan(t)
    assert one(spark, t, X.split_lines(F.col("text"))) == t.replace("\r\n", "\n").split("\n")


def test_null_text(spark):
    for value in (X.scan_lines(F.col("text")), X.split_lines(F.col("text")), X.tokens(F.col("text")), X.words(F.col("text"))):
        assert one(spark, None, value) is None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab .!?\n\r\t 　é😀\x1b[m", max_size=60), min_size=1, max_size=20))
def test_estimate_and_chunks_against_python(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["t"] for r in df.select("id", X.tokens(F.col("text")).alias("t")).collect()}
    assert got == {i: chunking.estimate(t) for i, t in enumerate(texts)}
    chunks = chunking.chunks(df, "id", "text", 3).collect()
    for i, t in enumerate(texts):
        mine = [(c["text"], c["start_line"], c["end_line"]) for c in sorted(chunks, key=lambda c: c["index"]) if c["id"] == i]
        assert mine == chunking.chunk_text(t, 3)


def test_chunk_rules():
    assert chunking.chunk_text("", 10) == [("", 1, 1)]
    assert chunking.chunk_text("", 10, by_sentence=True) == []
    long = "word " * 100
    assert len(chunking.chunk_text(long, 5)) == 1  # one large unit is never cut
    text = "\n".join(f"line {i} with words" for i in range(12))
    plain, lap = chunking.chunk_text(text, 20), chunking.chunk_text(text, 20, 8)
    assert len(lap) >= len(plain) > 1 and all(b[1] > a[1] for a, b in zip(lap, lap[1:]))
    assert chunking.limits(0, -1) == (512, 0) and chunking.limits(100, 100) == (100, 25)


def test_sentences(spark):
    assert one(spark, "One. Two!  Three? four.five  end", X.sentences(F.col("text"))) == ["One.", "Two!", "Three?", "four.five  end"]


def test_clean(spark):
    t = "\x1b[31mred 12\x1b[0m  \r\n\r\n  keep\t \nlast"
    got = one(spark, t, X.clean(F.col("text"), X.Clean(strip_ansi=True, pattern=r"(\d+)", replace_with="L#$1", trim_lines=True, drop_blank=True)))
    assert got["text"] == "red L#12\n  keep\nlast" and (got["original_lines"], got["resulting_lines"], got["chars_removed"], got["patterns_matched"]) == (4, 3, 9, 1)
    assert one(spark, "a(b", X.clean(F.col("text"), X.Clean(pattern="(")))["text"] == "a(b"


@pytest.mark.parametrize("start,end,new,want", [(2, 3, "new", "1\nnew\n4\n"), (2, 0, "", "1\n3\n4\n"), (9, 9, "z", "1\n2\n3\n4\nz\n"), (1, 9, "a\nb\n", "a\nb\n\n")])
def test_replace_lines(spark, start, end, new, want):
    assert one(spark, "1\n2\n3\n4", X.replace_lines(F.col("text"), start, end, new))["text"] == want


def test_edits(spark):
    c = F.col("text")
    assert one(spark, "1\r\n2\r\n", X.insert_lines(c, 2, "x"))["text"] == "1\r\nx\r\n2\r\n"
    assert one(spark, "1\n2\n", X.insert_lines(c, 1, "x", before=False))["text"] == "1\nx\n2\n"
    assert one(spark, "1\n", X.insert_lines(c, 7, "x"))["text"] == "1\nx\n"
    assert one(spark, "1\n2\n3\n", X.delete_lines(c, 1, 2))["text"] == "3\n"
    assert one(spark, "1", X.delete_lines(c, 1))["text"] == ""
    for bad in ((0, 1), (3, 2)):
        with pytest.raises(ValueError):
            X.replace_lines(c, *bad, "x")


def test_search(spark):
    docs = spark.createDataFrame([("a", "one\nTwo é foo\nthree foo"), ("b", "nothing"), ("c", None), ("d", "")], "id string, text string")
    got = search.search_lines(docs, "id", "text", "FOO", before=1, after=1).orderBy("line_number").collect()
    assert [(r["line_number"], r["column_number"], r["matched_text"], r["before_context"], r["after_context"]) for r in got] == [(2, 8, "foo", ["one"], ["three foo"]), (3, 7, "foo", ["Two é foo"], [])]
    assert search.search_lines(docs, "id", "text", "^$", regex=True).count() == 1
    assert search.search_lines(docs, "id", "text", "^$", regex=True, scan=True).count() == 0
    s = search.summary(docs, search.search_lines(docs, "id", "text", "foo"), "id").first()
    assert (s["total_matches"], s["files_scanned"], s["files_matched"]) == (2, 4, 1)
    assert search.search_lines(docs.limit(0), "id", "text", "x").count() == 0


def test_read_lines(spark):
    docs = spark.createDataFrame([("a", "1\n2\n3\n4\n5\n")], "id string, text string")
    got = search.read_lines(docs, "id", "text", 2, 4).orderBy("line_number").collect()
    assert [r["content"] for r in got] == ["2", "3", "4"] and got[0]["total_lines"] == 5
    wide = search.read_lines(docs, "id", "text", 2, 99, 1).collect()
    assert (len(wide), wide[0]["start_line"], wide[0]["end_line"]) == (5, 2, 5)
    assert search.read_lines(docs, "id", "text", 9).count() == 0


@pytest.mark.parametrize("pattern,ok", [(r"a+b?", True), (r"(?P<n>x)\d", True), (r"(?=x)", False), (r"(a)\1", False), (r"a++", False), (r"(", False), (r"[a&&b]", True), (r"(?U)a", False), (r"\pL[^\s]", True)])
def test_regex_translation(pattern, ok):
    if ok:
        regex.to_java(pattern)
    else:
        with pytest.raises(regex.PatternError):
            regex.to_java(pattern)


@pytest.mark.parametrize("pattern,text,hit", [(r"\b\d{4}", "é2026", True), (r"a$", "a\n", False), (r"É", "é", True), (r".", "\r", True), (r"\s", "\x0b", False), (r"[[:digit:]]+x", "12X", True), (r"\Qa.b\E", "axb", False), (r"[]x]", "]", True)])
def test_regex_semantics(spark, pattern, text, hit):
    assert one(spark, text, F.col("text").rlike(regex.to_java(pattern, True))) is hit


def test_replacement():
    assert regex.replacement("$1x-${1}x $$ \\") == "-$1x \\$ \\\\"


def test_concat(spark):
    df = spark.createDataFrame([(1, "a/x.txt", "1\n2"), (1, "a/y.txt", "3\n"), (2, "z", None), (2, "zz", "q"), (None, "n", "s")], "g int, name string, text string")
    lines = concat.concat_lines(df, "name", "text", header="[%b %n]", delimiter="--", group_col="g")
    got = {r["g"]: r for r in concat.text(lines, "name", "g").collect()}
    assert got[1]["text"] == "[x.txt 2]\n1\n2\n--\n[y.txt 1]\n3\n" and got[2]["text"] == "[zz 1]\nq\n" and got[None]["text"] == "[n 1]\ns\n"
    assert {r["g"]: (r["files_processed"], r["total_lines"], r["total_bytes"]) for r in concat.totals(lines, "name", "g").collect()}[1] == (2, 6, 29)
    assert {r["g"]: r["text"] for r in concat.text(lines, "name", "g", max_bytes=10).collect()}[1] is None
    assert [r["line"] for r in concat.concat_lines(df, "name", "text", numbered=True).orderBy("name", "position").collect()] == ["   1 | 1", "   2 | 2", "   1 | 3", "   1 | s", "   1 | q"]
    assert concat.concat_lines(df.limit(0), "name", "text").count() == 0


def test_links(spark):
    df = spark.createDataFrame([(1, "see https://a.example/x, (http://b.example). mail m@x.org; on 2024-01-02. https://a.example/x"), (2, None), (3, "")], "id int, text string")
    got = {r["id"]: r for r in extract.links(df, "id", "text").collect()}
    assert got[1]["urls"] == ["http://b.example", "https://a.example/x"] and got[1]["emails"] == ["m@x.org"] and got[1]["dates"] == ["2024-01-02"]
    assert got[3]["urls"] == [] and 2 not in got


def test_csv_and_names(spark):
    df = spark.createDataFrame([(1, 'a,"b,c"\n\nd')], "id int, text string")
    assert [(r["row"], r["col"], r["value"]) for r in extract.csv_tables(df, "id", "text").orderBy("row", "col").collect()] == [(0, 0, "a"), (0, 1, '"b'), (0, 2, 'c"'), (1, 0, "d")]
    names = [r["n"] for r in spark.range(1, 731).select(X.column_name(F.col("id")).alias("n")).collect()]
    from docframe.formats.xlsx import column_name

    assert names == [column_name(i) for i in range(1, 731)]


def test_svg_behind_long_text(spark, tmp_path):
    """The SVG queries scrape the whole text, not its beginning."""
    text = "word " * 2000 + '<svg id="late"><g/></svg>\nend'
    spark.createDataFrame([(7, text)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    names = [r["file_name"] for r in text_queries.svg_names(spark, str(tmp_path)).orderBy("index").collect()]
    assert names[0] == "late.svg" and len(names) == 5
    for q in (text_queries.svg_scrape, text_queries.svg_adjust, text_queries.svg_jsx, text_queries.svg_data_uri):
        assert q(spark, str(tmp_path)).count() == 5


def test_concat_parts(spark):
    """Groups beyond the bound come in ordered parts instead of no text, and no line is missing."""
    df = spark.createDataFrame([(1, i, f"a{i}\nbb\n\nc") for i in range(30)] + [(2, 0, "x"), (None, 5, "n" * 50), (None, 6, "m")], "g int, name int, text string")
    lines = concat.concat_lines(df, "name", "text", delimiter="--", group_col="g")
    whole = {r["g"]: r["text"] for r in concat.text(lines, "name", "g").collect()}
    rows = concat.parts(lines, "name", "g", max_bytes=40).orderBy("g", "part").collect()
    assert {g: "".join(r["text"] for r in rows if r["g"] == g) for g in whole} == whole and len([r for r in rows if r["g"] == 1]) > 5
    assert all(len(r["text"]) == r["total_bytes"] <= 40 + 51 for r in rows) and [r["part"] for r in rows if r["g"] == 2] == [1]
