from docframe.llm import mojibake as m

CLEAN = ["Résumé élaboré après la réunion", "Größe der Schriftart geändert", "Straße, Maße und Öffnungszeiten", "La señal llegó más tarde", "Übersicht über fällige Prüfungen", "Таблица содержит ошибки", "Новый раздел добавлен вчера", "文書を保存してください", "21 °C in the vault", "half price ½ only", "Révision générale du modèle", "Café crème für das Büro", "Список строк пуст"]
HARMLESS = ["São João dos Índices", "Â = matrix A hat", "SÃO PAULO NÃO RESPONDE", "╔══ report ══╗", "└── docs", "π ≈ 3.14, √2", "plain ascii", "", None, "РСФСР РС-42", "£40 «brut»"]


def garble(text, written, read):
    raw = text.encode(written)
    return "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in raw)


def frame(spark, texts):
    return m.records(("t", spark.createDataFrame(list(enumerate(texts)), "id bigint, text string"), "id", "text"))


def test_learned_and_restored(spark):
    bad = [(c, garble(c, "utf-8", r)) for c in CLEAN for r in ("cp1252", "cp437", "mac-roman", "latin-1") if not all(ord(x) < 128 for x in c)]
    bad += [(c, garble(garble(c, "utf-8", "cp1252"), "utf-8", "cp1252")) for c in CLEAN[:3]]
    bad += [(c, garble(c, "cp1251", "latin-1")) for c in ("Таблица содержит ошибки", "Новый раздел добавлен вчера", "Список строк пуст")]
    texts = [f"{c} ({k})" for k in range(3) for c in CLEAN] + HARMLESS + [b for _, b in bad]
    rec = frame(spark, texts)
    got = {r["row_id"]: r for r in m.restore(rec).collect()}
    first = len(CLEAN) * 3 + len(HARMLESS)
    assert set(got) == set(range(first, len(texts)))
    wrong = [(texts[i], got[i]["restored"]) for i in got if got[i]["restored"] != bad[i - first][0]]
    assert len(wrong) <= len(bad) // 20, wrong


def test_replacement_characters(spark):
    rec = frame(spark, ["La señal llegó tarde"] * 2 + ["La se�al lleg� tarde", "xq�zw", "wait� then"])
    got = {r["row_id"]: r for r in m.restore(rec).collect()}
    assert got[2]["restored"] == "La señal llegó tarde" and got[2]["complete"]
    assert got[3]["restored"] == "xq�zw" and not got[3]["complete"] and set(got) == {2, 3, 4}


def test_empty_clashing_and_long(spark):
    assert m.affected(frame(spark, ["a"]).limit(0)).count() == 0
    assert m.affected(frame(spark, [None, "", "ascii only"])).count() == 0
    df = spark.createDataFrame([(1, "Größe " * 20000 + "GrÃ¶Ã\x9fe", "x", "y", 2)], "id bigint, text string, word string, key string, source_table int")
    assert [r["row_id"] for r in m.affected(m.records(("a", df, "id", "text"))).collect()] == [1]
    assert m.context_words("a\\Eé�b q") == {("a\\Eé�b", "\1aEb\1q")}


def test_repeated_rows(spark):
    rec = frame(spark, ["Größe der Dinge"] * 3 + ["GrÃ¶Ã\x9fe der Dinge"] * 50)
    assert m.affected(rec).count() == 50


def test_one_byte_words_without_a_twin(spark):
    """A learned one-byte mapping restores words whose clean form occurs nowhere; well-formed words stay."""
    cyrillic = ("Таблица содержит ошибки", "Новый раздел добавлен вчера", "Список строк пуст")
    bad = [garble(c, "cp1251", "latin-1") for c in cyrillic]
    texts = [f"{c} ({k})" for k in range(3) for c in CLEAN] + HARMLESS + bad + [garble("столица", "cp1251", "latin-1")]
    got = {r["row_id"]: r["restored"] for r in m.restore(frame(spark, texts)).collect()}
    first = len(CLEAN) * 3 + len(HARMLESS)
    assert set(got) == set(range(first, len(texts))) and got[len(texts) - 1] == "столица"
    assert not any(m.stands_alone(w, t) for w in ("naïve", "Übermaß", "привет", "cost–benefit", "Foo™") for _, _, t in m.legacy_guesses(w))


def test_unlisted_decoding(spark):
    """UTF-8 read through a page that is on no list: twins teach its letters, words without a twin are restored by them."""
    assert "cp775" not in m.READ_AS
    words = ("Größe der Schrift", "Löschen große Datei", "Möbel und Stühle", "Flügel der Tür", "Süße Übung macht müde")
    texts = [w + f" ({k})" for w in words for k in range(2)] + [garble(w, "utf-8", "cp775") for w in words]
    alone = garble("Hügelkönig", "utf-8", "cp775")
    rec = frame(spark, [*texts, alone])
    got = {r["row_id"]: r["restored"] for r in m.restore(rec).collect()}
    assert {i: got.get(i) for i in range(10, 16)} == {10 + i: w for i, w in enumerate((*words, "Hügelkönig"))} and set(got) == set(range(10, 16))
    by = {r["route"]: r["words"] for r in m.routes(rec).collect()}
    assert set(by) == {"mapping"}


def test_any_number_of_layers(spark):
    bad = "Größe"
    for _ in range(4):
        bad = garble(bad, "utf-8", "cp1252")
    texts = ["die Größe der Dinge"] * 2 + [f"die {garble('Größe', 'utf-8', 'cp1252')} der Dinge", f"die {bad} der Dinge", bad]
    got = {r["row_id"]: r["restored"] for r in m.restore(frame(spark, texts)).collect()}
    assert got == {2: "die Größe der Dinge", 3: "die Größe der Dinge", 4: "Größe"}


def test_alignment():
    assert m.aligned("GrÃ¶Ã\x9fe", "Größe") == [("Ã¶Ã\x9f"[:2], "ö"), ("Ã\x9f", "ß")]
    assert m.aligned("señal", "señal") == [] and m.aligned("xÃ¶y", "xöy") == [("Ã¶", "ö")]
    assert m.learned_mappings([("Ã¶", "ö", 1), ("zz––", "—", 2), ("ab", "c", 5), ("ab", "d", 5)]) == {"Ã¶": "ö"}
