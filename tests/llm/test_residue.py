import pytest
from pyspark.sql import functions as F

from tidewright.llm import residue

NONE = [
    "In our tutorial, type {{ name }} in the template and it shows your customer's name.",
    "We use cookies in our bakery every day.",
    "Your model number is XXXX on the back.",
    "Write `" + "x = 1; " * 40 + "{{name}}` and press enter, then the page shows the value of the field in its place, as the form did before.",
    'The screen reads "' + "please wait " * 10 + 'Internal Server Error" for a while and then works again, which we know about and are looking into with our hosts right now, so there is nothing you have to do about it.',
    "Set the variable ${HOME} first. Then press start.",
    "", None,
]
SOME = [
    ("Our agent Tom says: please enable JavaScript to continue.", "scripts:enable"), ("We use cookies. Accept all to continue.", "scripts:cookies"), ("Your order number is XXXX and it is late.", "placeholder:crosses"),
    ("Dear {{ template }}, we are sorry.", "placeholder:double_braces"), ("{{variable}} {{template}}", "placeholder:double_braces"), ('"Hello [CUSTOMER NAME], your refund is on its way"', "placeholder:squares"),
    ("```\nDear {{name}}, {{greeting}} {{closing}}\n```", "placeholder:double_braces"), ("Your refund is undefined.", "empty:value"), ("word " * 20_000 + "{{ name }}", "placeholder:double_braces"),
]


def kinds(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return {r["i"]: r["k"] for r in df.select("i", residue.residue_kinds(F.col("t")).alias("k")).collect()}


def test_context_frees_what_talks_about_residue(spark):
    assert {i: k for i, k in kinds(spark, NONE).items() if k} == {}


def test_context_does_not_free_residue(spark):
    got = kinds(spark, [t for t, _ in SOME])
    assert [k for i, (_, k) in enumerate(SOME) if k not in got[i]] == []


@pytest.mark.parametrize(("text", "share"), [("{{a}}{{b}}", 1.0), ("ab{{a}}xyz", 0.5), ("none", 0.0), (None, 0.0), ("", 0.0)])
def test_density(spark, text, share):
    assert abs(spark.createDataFrame([(text,)], "t string").select(residue.density(F.col("t"))).first()[0] - share) < 1e-9
