from hypothesis import given, settings, strategies as st

from docframe.llm import splitting as s


def size(t):
    return int((len(t) / 4 + len(t.split()) * 1.3) / 2)


def check(text, most, lap, cut):
    assert cut[0][0] == 0 and cut[-1][1] == len(text)
    for k, (a, b) in enumerate(cut):
        assert b > a and (size(text[a:b]) <= most or b - a == 1)
        if k:
            before = cut[k - 1]
            assert before[0] < a <= before[1] and size(text[a : before[1]]) <= max(lap, 0)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n!。é😀", min_size=1, max_size=300), st.integers(2, 20), st.integers(0, 6))
def test_pieces(text, most, lap):
    lap = most // 4 if lap >= most else lap
    check(text, most, lap, s.split_texts([text], [most], [lap])[0])


def test_doubling_equals_walking():
    texts = ["word " * n + "\n\n" + "x" * n * 3 + ". End.\nline " * n for n in (1, 7, 40)]
    for text, cut in zip(texts, s.split_texts(texts, [16] * 3, [5] * 3)):
        c = s.Cuts(text, 16, 5)
        c.starts = s.np.arange(c.n + 1)
        c.to, c.end = c._successors(c.starts)
        p, walked = 0, []
        while p < c.n:
            walked.append((p, int(c.end[p])))
            p = int(c.to[p])
        assert walked == cut


def test_natural_boundaries():
    text = ("one two three four five six.\n\n" + "seven eight nine ten eleven twelve.\n\n") * 4
    for a, b in s.split_texts([text], [20], [0])[0]:
        assert text[:b].endswith("\n\n")


def test_operator(spark):
    text = "First line here.\nSecond line here.\n" * 40
    chunks = spark.createDataFrame([(1, 1, text, 5, None, "x"), (2, 1, None, 1, 1, "x"), (3, 1, "", 1, 1, "x"), (4, 99, "short", 1, 1, "x"), (5, 2, text, None, 85, "x"), (6, 1, text, 5, None, "x"), (7, 3, "y" * 9000, None, None, "x")], "chunk_id bigint, result_id bigint, text string, start_line int, end_line int, max_tokens string")
    results = spark.createDataFrame([(1, 64, 8, None, "t"), (2, 0, -3, None, "t"), (3, None, None, None, "t"), (None, 1, 1, None, "t")], "result_id bigint, max_tokens int, overlap_tokens int, run_at timestamp, text string")
    got = s.pieces(chunks, results).collect()
    assert {r["chunk_id"] for r in got} == {1, 6, 7}
    one = sorted((r for r in got if r["chunk_id"] == 1), key=lambda r: r["piece_index"])
    assert one[0]["start_line"] == 5 and one[-1]["end_line"] == 5 + 79 and all(r["tokens"] <= 64 for r in one) and all(r["overlap_characters"] > 0 for r in one[1:])
    seven = sorted((r for r in got if r["chunk_id"] == 7), key=lambda r: r["piece_index"])
    assert "".join(r["text"] for r in seven) == "y" * 9000 and seven[0]["start_line"] is None
    assert s.pieces(chunks.limit(0), results).count() == 0 and s.pieces(chunks, results.limit(0)).count() > 0
