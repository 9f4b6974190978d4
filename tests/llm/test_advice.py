import pytest

from tests.llm.test_llm import found, tweets
from tidewright.llm import conversations, residue, sentences


def test_inferred_links_are_chosen_by_score(spark):
    rows = [
        ("1", "77", 0, "my router smells burnt", None, None),  # an opening without @
        ("2", "Acme", 1, "@77 which router smells", None, None),
        ("3", "Acme", 2, "@77 your lamp comes tomorrow", "900", None),
        ("4", "77", 3, "thanks, the router smells burnt @Acme", None, None),  # shares its words with 2, not with the latest one
        ("20", "88", 5, "nothing came", None, None), ("21", "Acme", 6, "@88 sorry", None, None), ("22", "88", 7, "sorry won't help", None, None),  # answers without @
        ("30", "55", 3, "nothing in common", None, None),
    ]
    msgs = conversations.messages(tweets(spark, rows), mentions=True)
    links = {tuple(r) for r in conversations.inferred_links(msgs).collect()}
    assert links == {("2", "1"), ("4", "2"), ("21", "20"), ("22", "21")}
    got = {(r[0], r[2]) for r in found(conversations.rebuild(tweets(spark, rows), infer=True))}
    assert got == {("1", "1"), ("1", "2"), ("1", "4"), ("20", "20"), ("20", "21"), ("20", "22")}


TUTORIAL = "Open the settings of the help desk and choose the mail you want to change. " * 5 + "In a template {{name}} stands for the name of the customer. Save it when you are done."


@pytest.mark.parametrize(
    ("text", "case"),
    [
        ("```Dear {{name}}, your refund is on its way```", True), ('"Hello [CUSTOMER NAME], your refund is on its way"', True), (TUTORIAL, False),
        (TUTORIAL + " Dear {{first_name}}, your order {{order_number}} and refund {{refund_amount}} are here.", True),
        ("Dear {{name}}, " + "your parcel left the depot and comes tomorrow before noon. " * 8, True),
        ("To greet a customer by name in the mails of your shop, write `{{name}}` where the name belongs.", False),
    ],
)
def test_residue_density(spark, text, case):
    df = spark.createDataFrame([("a", text)], "id string, t string")
    assert residue.find_residue(df, "id", "t").count() == int(case)


def test_cascade_counts_the_whole_block():
    spanish = "El paquete no llegó y las cajas se han roto por una caída del camión que es viejo. " * 15
    english = "The parcel was not in the box and it is with you for the day that was set. " * 40
    assert len(spanish) < 2000
    rules = sentences.cascade(spanish + spanish[:700] + english, None)
    assert rules is sentences.cascade(english + spanish, None) and rules is not sentences.cascade(spanish, None)


def test_sentences_with_wide_space_between():
    for space in (" " * 40, " " * 400, "\n" + " " * 60, "\t" * 50):
        t = f"It came.{space}It was torn.{space}"
        assert [t[a - 1 : b] for a, b in sentences.sentences(t)] == ["It came.", "It was torn."]


def test_score_chooses_among_stated_links(spark):
    rows = [
        ("1", "77", 0, "my router smells burnt", None, None), ("2", "88", 1, "nothing came", None, None), ("3", "99", 9, "is the shop open", None, None), ("4", "99", 2, "lamp", None, None),
        ("10", "Acme", 5, "@77 which router smells", "2", None), ("10", "Acme", 5, "@77 which router smells", "1", None),  # 1 is mentioned and shares words
        ("11", "Acme", 5, "sorry", "3", None), ("11", "Acme", 5, "sorry", "4", None),  # 3 came later
        ("12", "Acme", 6, "sorry", "12", None), ("12", "Acme", 6, "sorry", "2", None),  # itself
        ("13", "Acme", 7, "bye", "900", None), ("13", "Acme", 7, "bye", "2.0", None), ("13", "Acme", 7, "bye", None, None),  # 900 is missing
    ]
    for given in (rows, rows[::-1]):
        got = found(conversations.rebuild(tweets(spark, given)))
        assert got == {("1", 1, "1", "CUSTOMER"), ("1", 2, "10", "SUPPORT"), ("4", 1, "4", "CUSTOMER"), ("4", 2, "11", "SUPPORT"), ("2", 1, "2", "CUSTOMER"), ("2", 2, "12", "SUPPORT"), ("2", 3, "13", "SUPPORT")}
        assert {(r[0], r[2]) for r in got} == {(r[0], r[2]) for r in found(conversations.rebuild(tweets(spark, given), infer=True)) if r[0] != "3"}


def test_no_inferred_link_outweighs_a_stated_one():
    w = conversations.WEIGHTS
    assert w["stated"] > sum(v for k, v in w.items() if k != "stated")
