import pytest

from tidewright.llm import mojibake as M

TEXTS = {
    "ru": "Почему отменили заказ? Помогите, пожалуйста.", "el": "Πού είναι το δέμα μου; Παρακαλώ βοηθήστε με σήμερα.", "he": "איפה החבילה שלי? אני מחכה כבר שלושה ימים לתשובה",
    "ar": "أين الطرد الخاص بي؟ ما زلت أنتظر الرد منذ ثلاثة أيام", "th": "พัสดุยังไม่มาถึงเลยครับ", "zh": "我的包裹昨天就该到了，请告诉我怎么退货", "zt": "我的包裹昨天就該到了請告訴我怎麼退貨",
    "ja": "照明はどこにありますか？返品の方法を教えてください。", "de": "Größe: 5 €, äöü", "pl": "zażółć gęślą jaźń",
}


def read_as(raw, codec):
    chars = M._table(codec)[1]
    return "".join(chars[b - 128] if b > 127 else chr(b) for b in raw)


@pytest.mark.parametrize(("lang", "written"), [("ru", "cp1251"), ("ru", "cp866"), ("ru", "koi8_r"), ("el", "cp1253"), ("he", "cp1255"), ("ar", "cp1256"), ("th", "cp874"), ("zh", "gbk"), ("zt", "big5"), ("ja", "cp932"), ("ja", "euc_jp")])
def test_written_in_another_encoding(lang, written):
    assert M.restore("ok " + read_as(TEXTS[lang].encode(written), "cp1252"))[0] == "ok " + TEXTS[lang]


@pytest.mark.parametrize("codec", M.READ_AS)
@pytest.mark.parametrize("lang", ["ru", "he", "ar", "th", "zh", "ja"])
def test_utf8_read_in_another_encoding(lang, codec):
    assert M.restore("ok " + read_as(TEXTS[lang].encode(), codec)) == ("ok " + TEXTS[lang], [f"utf_8>{codec}"]) or codec in ("iso8859_15", "cp1254", "cp1250")
    assert M.restore("ok " + read_as(TEXTS[lang].encode(), codec))[0] == "ok " + TEXTS[lang]


@pytest.mark.parametrize("word", ["¿³¹", "za¿ó³æ"])
def test_central_european_words(word):
    assert "cp1250>cp1252" in M.restore("ok za¿ó³æ")[1] and M.restore("ok za¿ó³æ")[0] == "ok zażółć"


@pytest.mark.parametrize("times", [1, 2, 4, 6, 9])
def test_garbled_many_times(times):
    text = "déjà vu"
    for _ in range(times):
        text = read_as(text.encode(), "cp1252")
    assert M.restore(text)[0] == "déjà vu"


@pytest.mark.parametrize("text", [*TEXTS.values(), "всё ещё жду…—Моя сумка", "упаковка была открыта", "МЫ ЖДЁМ ОТВЕТА", "ЖДЁМ, ЖДЁМ, ЖДЁМ", "NÃO É ACEITÁVEL", "“é…” twice", "¿eh? ½ (¥43½)", "x" * 30_000 + " é"])
def test_clean_texts_with_and_without_a_model(text):
    model = M.fit([*TEXTS.values()] * 5 + ["МЫ ЖДЁМ ОТВЕТА", "всё ещё жду", "so “é…” ½", "¿eh?", "NÃO É", "GrÃ¶ÃŸe"])
    assert M.restore(text) == (text, []) and M.restore(text, model) == (text, [])


def test_a_run_that_no_pair_explains_best_stays_as_it_is():
    for seq in ("제소", "도착"):
        bad = "ok " + read_as(seq.encode("euc_kr"), "cp1252")
        assert M.restore(bad)[0] in (bad, "ok " + seq)


def test_fit_finds_what_looks_unsure():
    clean = ["We're here to help, please wait", "the café «so» is 5° warm", "«yes» or «no» at 20°", "Мы ждём ответа"] * 40
    model = M.fit(clean + ["GrÃ¶ÃŸe", "dÃ©jÃ  vu"])
    assert M.restore("yes В«pleaseВ» at 20В°")[0] == "yes В«pleaseВ» at 20В°"
    assert M.restore("yes В«pleaseВ» at 20В°", model)[0] == "yes «please» at 20°"
    assert M.fit([]) is None and M.fit([None, ""]) is None


def test_sample_is_bounded(spark):
    df = spark.createDataFrame([(i, f"é{i}") for i in range(30)] + [(99, None), (98, "plain"), (97, "é" * 5_000)], "id int, t string")
    assert len(M.sample_of(df, "t", 10)) == 10 and len(M.sample_of(df, "t")) == 30


CLEAN = ["We're here to help, please wait", "the café «so» is 5° warm", "«yes» or «no» at 20°", "Мы ждём ответа"] * 40


@pytest.mark.parametrize(("text", "restored"), [("“é…” twice", None), ("at 20В° today", "at 20° today"), ("GrÃ¶ÃŸe", "Größe")])
def test_model_is_fitted_on_long_texts_too(spark, text, restored):
    rows = [(1, "\n".join(CLEAN * 2)), (2, text), (3, None), (4, ""), (5, "plain")]
    assert len(rows[0][1]) > M.SAMPLE_LENGTH
    got = [tuple(r) for r in M.find_garbled(spark.createDataFrame(rows, "id int, t string"), "id", "t").select("id", "restored").collect()]
    assert got == ([(2, restored)] if restored else [])


def test_model_is_fitted_on_all_texts(spark):
    texts = [*CLEAN, "GrÃ¶ÃŸe", read_as("déjà vu".encode(), "cp1252"), "yes В«pleaseВ» at 20В°", None, "", "plain", "plain"] + [f"é{i}" for i in range(M.SAMPLE + 50)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    every, one = M.fit_all(df.where("length(t) > 0"), df.where(M.gate(df["t"]))), M.fit(texts)
    assert every.single["é"] > M.SAMPLE and every.single["p"] == sum(t.count("p") for t in texts if t)
    assert {k: n for k, n in every.pairs.items() if n} == dict(one.pairs) and every.total == one.total
    assert (every.enter, every.leave, every.swap) == (one.enter, one.leave, one.swap)
    assert M.fit_all(df.limit(0), df.limit(0)) is None


def test_characters_are_counted_across_pieces(monkeypatch):
    text = "Größe 5 €, 漢字\n" * 30
    whole = M.count_chars([text, None, "", "é"])
    monkeypatch.setattr(M, "_PIECE", 7)
    assert M.count_chars([text, None, "", "é"]) == whole and sum(whole.values()) == len(text) + 1
    assert whole[" ", ord("é")] == 1 and whole["a", ord("ö")] == 30 and whole[" ", ord("漢")] == 30


@pytest.mark.parametrize(("text", "case"), [("a¿", True), ("ok za¿ó³æ", True), ("x" * 50 + " Ã¶", True), ("abc\n日本 Ã¶", True), ("café", False), ("a ¿b", False), ("plain", False), ("", False), (None, False)])
def test_gate(spark, text, case):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.where(M.gate(df["t"])).count() == int(case)
