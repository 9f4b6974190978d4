import pytest
from pyspark.sql import functions as F

from tidewright.operators.packed import account, delimiter_scores, split_packed

SCHEMA = "tweet_id string, author_id string, cell string, source string, pos int"


def rows(spark, cells):
    return spark.createDataFrame([(str(i), "Acme", c, "clash", 9) for i, c in enumerate(cells)], SCHEMA)


def split(spark, cells):
    out = split_packed(rows(spark, cells), "tweet_id", "cell", account(F.col("author_id")))
    assert out.columns == ["tweet_id", "pos", "linked_id"]
    found = {}
    for r in sorted(out.collect(), key=lambda r: (int(r[0]), r[1])):
        assert r[1] == len(found.setdefault(int(r[0]), [])) + 1
        found[int(r[0])].append(r[2])
    return [found.get(i, []) for i in range(len(cells))]


@pytest.mark.parametrize(
    ("cell", "ids"),
    [
        ("12", ["12"]), (" 12 ", ["12"]), ("12.0", ["12"]), ("12.0,13.0", ["12", "13"]), ('"12,345"', ["12345"]), ('"1,234,567"', ["1234567"]), ('"12,345","12,346"', ["12345", "12346"]),
        ("12,345", ["12", "345"]), ("1;2", ["1", "2"]), ("'1;2'", ["1", "2"]), ("['1', '2']", ["1", "2"]), ('["1","2"]', ["1", "2"]), ("{1,2}", ["1", "2"]), ("1 | 2", ["1", "2"]), ("1、2", ["1", "2"]), ("1；2", ["1", "2"]),
        ("1 and 2", ["1", "2"]), ("1 & 2", ["1", "2"]), ("1 + 2", ["1", "2"]), ("1\n2", ["1", "2"]), ("1\t2", ["1", "2"]), ("1/2", ["1", "2"]), ("1,,2,", ["1", "2"]), ('1;"2"|3', ["1", "2", "3"]), ("7,7", ["7", "7"]),
        (None, []), ("", []), ("  ", []), ("nan", []), ("None", []), ("[]", []), (",", []), ('""', []), ("1,nan,2", ["1", "2"]),
    ],
)
def test_notations(spark, cell, ids):
    # the other cells let the source's delimiters be inferred
    context = ["1,2", "1;2", "1|2", "1/2", "1 2", "1 and 2", "1、2", "1\n2", "1\t2", "1,2,3"]
    assert split(spark, [*context, cell])[-1] == ids


def test_delimiters_differ_by_source(spark):
    data = [("1", "Acme", "1;2"), ("2", "Acme", "3;4"), ("3", "Beta", "5-6"), ("4", "Beta", "7-8")]
    df = spark.createDataFrame(data, "tweet_id string, author_id string, cell string")
    s = {(r["source"], r["delimiter"]) for r in delimiter_scores(df, F.col("cell"), account(F.col("author_id"))).where("accepted").collect()}
    assert s == {("acme", "semicolon"), ("beta", "hyphen")}
    got = {tuple(r) for r in split_packed(df, "tweet_id", "cell", account(F.col("author_id"))).collect()}
    assert ("3", 1, "5") in got and ("4", 2, "8") in got


def test_long_repeated_and_empty(spark):
    long = ";".join(map(str, range(3000)))
    got = split(spark, [long, long, "1;2"])
    assert got[0] == got[1] == list(map(str, range(3000)))
    assert split_packed(rows(spark, []), "tweet_id", "cell", account(F.col("author_id"))).count() == 0
