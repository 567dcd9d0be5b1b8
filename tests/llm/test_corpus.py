import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from docframe.llm import encode, leakage, reading


@pytest.fixture(scope="module")
def enc():
    return encode.load(encode.rank_file("byte_bpe_50k"))


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=400))
def test_pieces_do_not_change_ids(text):
    enc = encode.load(encode.rank_file("byte_bpe_50k"))
    assert [i for p in encode.pieces(text, 20) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
    assert "".join(encode.pieces(text, 20)) == text


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab1 2\n\t\r '.,(sé日本、。-\x1c\u3000"), max_size=200))
def test_safe_cuts(text):
    enc = encode.load(encode.rank_file("byte_bpe_50k"))
    cut = encode.pieces(text, 1)
    assert [i for p in cut for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text) and "".join(cut) == text


def test_long_texts_without_blanks_are_cut(enc):
    """Japanese sentences, line-separated fields and digits between letters give pieces of bounded size, and the same ids."""
    for text in ("文書を保存してください。表の列、" * 5000, "field_a\nfield_b\n" * 10000, "x1y22" * 20000, "a,b;c|d" * 10000):
        cut = encode.pieces(text, 5000)
        assert len(cut) >= len(text) // 5100 and [i for p in cut for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_encode_and_decode(spark, enc):
    texts = ["Hello world", "", None, "é 日本 😀\n\t x", "word " * 30_000, "<|endoftext|>", "a" * 20_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in encode.encode(df).collect()}
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    back = {r["doc_id"]: r["t"] for r in encode.encode(df).select("doc_id", encode.decode(F.col("ids")).alias("t")).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert encode.encode(df.limit(0)).count() == 0


def test_against_reference_tokenizer(enc):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{encode.VOCABULARIES}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for text in ("It's 3.14, they're  here\n\n", "naïve façade — ok", "x\r\ny\t z"):
        assert t.encode(text, add_special_tokens=False).ids == encode.encode_text(enc, text)


WORDS = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)]
ITEM = " ".join(WORDS[:40])


def test_passages():
    f = leakage.Finder([(7, ITEM), (8, " ".join(WORDS[60:100])), (9, "too short"), (10, None)])

    def ids(text):
        return [x[0] for x in f.leaks(text)]

    part = WORDS[5:23]
    assert ids(" ".join(part)) == [7] and ids(" ".join(part[:-1])) == [] and ids(None) == [] and ids("") == []
    assert ids("Intro. " + ", ".join(w.upper() for w in part) + "!") == [7]
    assert ids("<b>" + "</b> *".join(part)) == [7]
    assert ids("".join(w if i % 5 else w[:2] + "-\n" + w[2:] for i, w in enumerate(" ".join(part).split(" ") and [x + " " for x in part]))) == [7]
    changed = part[:9] + ["odd"] + part[10:]
    assert ids(" ".join(changed)) == [7]
    assert ids(" ".join(part[:9] + ["two", "words"] + part[10:])) == [7]
    assert ids(" ".join(w if i % 3 else "odd" for i, w in enumerate(WORDS[:40]))) == []  # too many altered
    assert ids('{"p": "' + "\\n".join(part) + '"}') == [7]
    assert ids(" ".join(WORDS[:20]) + " and " + " ".join(WORDS[70:95])) == [7, 8]


def test_find_and_strip(spark):
    docs = spark.createDataFrame([(1, "Start. " + ITEM + " End.", "z"), (2, "nothing", "z"), (3, None, "z"), (4, "", "z"), (5, "Start. " + ITEM + " End.", "z")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(7, ITEM, "s"), (17, ITEM, "s")], "item_id bigint, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.find(docs, items).collect()}
    assert got == {(d, i) for d in (1, 5) for i in (7, 17)}
    assert {(r["doc_id"], r["item_id"]) for r in leakage.find(docs, items, max_grams=1).collect()} == got  # several passes
    out = {r["doc_id"]: r["text"] for r in leakage.strip(docs, items).collect()}
    assert out == {1: "Start.  End.", 2: "nothing", 3: None, 4: "", 5: "Start.  End."}
    assert leakage.find(docs.limit(0), items).count() == 0 and leakage.find(docs, items.limit(0)).count() == 0


EASY, HARD = "The cat sat on the mat and then it ran home.", "Epistemic formalisation presupposes jurisdictional heterogeneity of normative vocabularies."


def test_prose():
    text = f"# Head of it all\n\n{EASY}\n\n```\nx = {{1}}\nThe code is not prose at all here.\n```\n\n| a | b |\n\nPresent: Ann, Bob\n"
    assert [x for x, _ in reading.prose(text)] == [EASY]
    assert reading.words(None) == [] and reading.prose("") == [] and reading.prose("x = 1;\ny = f(2);\n") == []
    assert reading.words("文書を保存してください。")[:2] == ["文書", "書を"]


def test_levels(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join([HARD if i % 2 else EASY] * int(rng.integers(2, 6))), "en", 9) for i in range(60)]
    rows += [(100, None, None, 9), (101, "", None, 9), (102, "int x;\n", None, 9), (103, EASY, None, 9), (104, HARD, None, 9), (105, HARD + "\n\n" + HARD * 1 + "\n\nLe chat est là.", None, 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, level int")
    labels = spark.createDataFrame([(i, i, 5 if i % 2 else 1, "r1", "t") for i in range(40)] + [(90, 1, 4, "r2", "t"), (91, 1, 5, "R1 ", "t"), (92, 2, None, "r1", "t"), (93, 999, 3, "r1", "t"), (94, None, 3, None, "t")], "label_id bigint, doc_id bigint, level int, rater string, text string")
    got = {r["doc_id"]: r["level"] for r in reading.levels(docs, labels).collect()}
    assert len(got) == len(rows) and all((got[i] >= 4) == bool(i % 2) for i in range(60))
    assert got[100] is got[101] is got[102] is None and got[103] <= 2 and got[104] >= 4 and got[105] >= 4
    none = reading.levels(docs, labels.limit(0)).collect()
    assert all(r["level"] is None for r in none) and reading.levels(docs.limit(0), labels).count() == 0


def test_true_levels(spark):
    labels = spark.createDataFrame([(1, 2, "a"), (1, 2, "A "), (1, 4, "b"), (1, 4, "c")], "doc_id bigint, level int, rater string")
    assert reading.true_levels(labels).first()["level"] == 4.0


def test_every_passage_is_found_and_stripped(spark):
    """Two copies of an item and two separate parts of one are all reported and all cut, on both paths."""
    one, two = " ".join(WORDS[:25]), " ".join(WORDS[30:55])
    item = " ".join(WORDS[:60])
    texts = {1: f"start {one} middle {one} end", 2: f"a {one} xx yy zz {two} b", 3: "nothing here", 4: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    items = spark.createDataFrame([(7, item, "x"), (8, None, None)], "item_id bigint, text string, answer string")
    for most in (400_000, 1):
        rows = sorted(tuple(r) for r in leakage.find(docs, items, max_grams=most).collect())
        assert [(r[0], r[1], r[2], r[3]) for r in rows] == [(1, 7, 1, 25), (1, 7, 2, 25), (2, 7, 1, 25), (2, 7, 2, 25)]
        assert [texts[r[0]][r[5] : r[6]] for r in rows] == [one, one, one, two]
        out = {r["doc_id"]: r["text"] for r in leakage.strip(docs, items, max_grams=most).collect()}
        assert out == {1: "start  middle  end", 2: "a  xx yy zz  b", 3: "nothing here", 4: None}
