import pytest

from tidewright.llm import pii


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("The parcel was left with Peter Miller next door", "Peter Miller"), ("Anna Schmidt called me yesterday", "Anna Schmidt"), ("please ask for Laura Jones at the desk", "Laura Jones"),
        ("Regards\nLaura Jones", "Laura Jones"), ("send it to Laura Jones, 12 High Street", "Laura Jones"), ("My name is Maria del Carmen Lopez", "Maria del Carmen Lopez"), ("我叫王小明", "王小明"),
        ("my wife Ewa Brand was at home", "Ewa Brand"), ("it was signed for by brand, ewa, no idea who that is", "brand, ewa"), ("THIS IS EWA BRAND AGAIN", "EWA BRAND"), ("soy ewa brand.", "ewa brand"), ("it's ewa brand here, still waiting", "ewa brand"),
    ],
)
def test_names(text, name):
    assert [text[s.start : s.end] for s in pii.find_spans(text) if s.kind == "NAME"] == [name]


@pytest.mark.parametrize(
    "text",
    ["I AM QUITE WORRIED SINCE MONDAY", "I'm losing patience and I want out", "my neighbour waited outside", "我叫客服处理", "thanks, it works now", "who is responsible and why did it fail", "left with nothing at the depot", "The Basil & Marrow juicer", "send it to New Hexley, thanks", "name is wrong on it", ""],
)
def test_no_names(text):
    assert not [s for s in pii.find_spans(text) if s.kind == "NAME"]


@pytest.mark.parametrize(("text", "number"), [("My passport number is 12AB34567", "12AB34567"), ("Mein Reisepass C01X00T47 ist weg", "C01X00T47"), ("passport 12 months old", None), ("my reisepass is gone", None)])
def test_passports_without_six_digits_in_a_row(spark, text, number):
    assert [text[s.start : s.end] for s in pii.find_spans(text)] == ([number] if number else [])
    got = pii.find_pii(spark.createDataFrame([("1", text)], "id string, t string"), "id", {"f": "t"}).count()
    assert got == (1 if number else 0)


def test_gate_lets_all_spans_through(spark):
    texts = ["Anna Schmidt called me yesterday", "Regards\nLaura Jones", "send it to Laura Jones, 12 High Street", "我叫王小明", "姓名：李雷", "ewa brand here, still waiting", "thanks,\nEwa Brand", "mail a@b.example", "ring ０１ ９９ ００ １２ ３４"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    found = {int(r["record_id"]) for r in pii.find_pii(df, "id", {"f": "t"}).collect()}
    assert found == set(range(len(texts)))


def test_redacted_column_in_place_and_beside(spark):
    data = [(1, "ring 07700 900 123", "x"), (1, "ring 07700 900 123", "x"), (2, None, "y"), (3, "", None), (4, "nothing", "z" * 100_000)]
    df = spark.createDataFrame(data, "l int, `a.t` string, _pii_open string")
    got = sorted(tuple(r) for r in pii.redact_column(df, "a.t", "l2").select("l", "`a.t`", "_pii_open", "l2").fillna("").collect())
    assert got == sorted((a, b or "", c or "", "ring [PHONE]" if b and "ring" in b else b or "") for a, b, c in data)
    assert {r[0] for r in pii.redact_column(df, "a.t", "a.t").select("`a.t`").collect()} == {"ring [PHONE]", None, "", "nothing"}
    assert pii.redact_column(df.limit(0), "a.t", "o").count() == 0
