"""Queries of fitted models; rows only, as no SQL fits them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import metrics, models, tfidf
from ..session import table

# The English stop words of the reference's vectorizer.
STOP_WORDS = """a about above across after afterwards again against all almost alone along already also although always am among
amongst amoungst amount an and another any anyhow anyone anything anyway anywhere are around as at back be became because become
becomes becoming been before beforehand behind being below beside besides between beyond bill both bottom but by call can cannot
cant co con could couldnt cry de describe detail do done down due during each eg eight either eleven else elsewhere empty enough
etc even ever every everyone everything everywhere except few fifteen fifty fill find fire first five for former formerly forty
found four from front full further get give go had has hasnt have he hence her here hereafter hereby herein hereupon hers herself
him himself his how however hundred i ie if in inc indeed interest into is it its itself keep last latter latterly least less ltd
made many may me meanwhile might mill mine more moreover most mostly move much must my myself name namely neither never
nevertheless next nine no nobody none noone nor not nothing now nowhere of off often on once one only onto or other others
otherwise our ours ourselves out over own part per perhaps please put rather re same see seem seemed seeming seems serious several
she should show side since sincere six sixty so some somehow someone something sometime sometimes somewhere still such system take
ten than that the their them themselves then thence there thereafter thereby therefore therein thereupon these they thick thin
third this those though three through throughout thru thus to together too top toward towards twelve twenty two un under until up
upon us very via was we well were what whatever when whence whenever where whereafter whereas whereby wherein whereupon wherever
whether which while whither who whoever whole whom whose why will with within without would yet you your yours yourself
yourselves""".split()


def q_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out scores of the linear intent classifier: fitted on the silver set, tried on the golden one."""
    d = table(spark, sf_dir, "dev_silver").select("customer_text", "reference_intent").distinct()
    g = table(spark, sf_dir, "golden_set").where("human_label_complete and human_intent is not null and human_intent <> ''").select("example_id", "customer_message", "human_intent")
    predicted = models.fit_text_classifier(d, "customer_text", "reference_intent")(g, "customer_message")
    labels = g.select(F.col("human_intent").alias("label")).distinct()
    return metrics.overall_scores(predicted, labels, "human_intent", "predicted")


def q_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts per topic of the silver set: up to 12 topics over words and pairs of words without English stop words.

    Updates end at 300 or once the error settles. A thread that keeps no term has no weight in any topic and counts
    for the first one, 0, which is the largest of equal weights.
    """
    d = table(spark, sf_dir, "dev_silver").groupBy("thread_id").agg(F.min("customer_text").alias("t"))
    said = d.where("t is not null").select("thread_id", text.strip_accents(F.lower(text.topic_text(F.col("t")))).alias("t"))
    w = tfidf.weights(said, "thread_id", tfidf.word_terms(F.col("t"), stop=STOP_WORDS), min_df=5, max_df=0.92)
    found = models.topics(w, "thread_id", min(12, max(2, said.count() // 20)), iterations=300, tol=1e-4)[0]
    return d.select("thread_id").join(found, "thread_id", "left").groupBy(F.coalesce("topic", F.lit(0)).alias("topic")).agg(F.count("*").alias("texts"))


QUERIES = {"q_classifier": q_classifier, "q_topics": q_topics}
ORACLE: dict[str, str] = {}
