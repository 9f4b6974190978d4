"""Several values packed in one field (problem 7): infer the delimiters of each source, split, explode with position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Candidate delimiters: a name and a Java regular expression. The order breaks equal scores.
DELIMITERS = [
    ("comma", r"[,，]"),
    ("semicolon", r"[;；]"),
    ("pipe", r"[|｜]"),
    ("ideographic", r"[、]"),
    ("slash", r"[/]"),
    ("newline", r"[\r\n]+"),
    ("tab", r"[\t]"),
    ("blank", r"[  ]"),
    ("word", r"\b(?:and|und|et|y|e|&)\b|[&+]"),
    ("dot", r"[.]"),
    ("hyphen", r"[-]"),
    ("colon", r"[:]"),
]

#: Words that stand for "nothing".
NOTHING = ["nan", "none", "null", "na", "n/a", "nil", "nat", "undefined", "-", "<na>"]

_PIECE_TRIM = r"^[\s ﻿​\[\](){}\"'“”‘’]+|[\s ﻿​\[\](){}\"'“”‘’]+$"


def bare(cell: Column) -> Column:
    """The cell with digit groups inside double quotes joined and the fraction that float columns add to ids removed."""
    c = F.coalesce(cell, F.lit(""))
    # "12,345" -> "12345": all commas of a digit group that a pair of double quotes holds, any number of them; \\G goes
    # on from the last comma of the same group
    c = F.regexp_replace(c, r'(?:("\s*\d++)(?=(?:,\d{3})+\s*")|(?<!^)\G(\d{3})(?=,)),', "$1$2")
    return F.regexp_replace(c, r"(?<![\d.])(\d+)\.0+(?![\d.])", "$1")


def _piece(p: Column) -> Column:
    return F.regexp_replace(p, _PIECE_TRIM, "")


def delimiter_scores(df: DataFrame, cell: Column, source: Column, id_pattern: str = r"^[0-9]+$") -> DataFrame:
    """(source, delimiter, cells, regular, consistent, accepted) of every candidate.

    A candidate is scored on the cells it splits: `regular` is the share of its non-empty pieces that, once the other
    candidates have split them further, are well-formed ids, so that mixed notations count for both of their
    delimiters; `consistent` the share of cells whose pieces all have that type. Sources are counted over all rows;
    one row a source and candidate comes out, so a hot source costs one partial aggregate a task.
    """
    exprs = []
    base = df.select(source.alias("source"), bare(cell).alias("_c")).where(~F.col("_c").rlike(r"^\s*\d*\s*$"))
    def well_formed(name: str):
        rest = "|".join(f"(?:{p})" for n, p in DELIMITERS if n not in (name, "dot", "hyphen", "colon"))
        ok = lambda y: (_piece(y) == "") | (_piece(y).rlike(id_pattern) & (F.length(_piece(y)) < 30))
        return lambda x: F.forall(F.split(x, rest), ok)

    for name, pattern in DELIMITERS:
        pieces = F.filter(F.transform(F.split(F.col("_c"), pattern), _piece), lambda x: x != "")
        well = well_formed(name)
        hit = F.col("_c").rlike(pattern)
        exprs.append(
            F.when(
                hit,
                F.struct(
                    F.lit(name).alias("delimiter"),
                    F.size(pieces).cast("long").alias("n"),
                    F.size(F.filter(pieces, well)).cast("long").alias("good"),
                ),
            )
        )
    tall = base.select("source", F.explode(F.array_compact(F.array(*exprs))).alias("d")).select("source", "d.*").where("n > 0")
    return (
        tall.groupBy("source", "delimiter")
        .agg(
            F.count("*").alias("cells"),
            (F.sum("good") / F.sum("n")).alias("regular"),
            F.avg((F.col("good") == F.col("n")).cast("double")).alias("consistent"),
        )
        .withColumn("accepted", (F.col("regular") >= 0.5) & (F.col("consistent") >= 0.5))
    )


def split_packed(
    df: DataFrame,
    key: str,
    cell: str,
    source: Column,
    out: str = "linked_id",
    id_pattern: str = r"^[0-9]+$",
) -> DataFrame:
    """(key, pos, out): one row for every value packed in `cell`.

    Delimiters are inferred for each source (see delimiter_scores); a cell is split at every delimiter its source
    accepts, or, where its source accepts none of those it holds, at those that most sources accept. pos counts the
    values alone from 1 in written order and repeats are kept. Null, blank and empty slots and words for "nothing"
    give no row; brackets and quotes around values are dropped; a comma between digit groups inside double quotes
    belongs to the value. Other columns of df, whatever their names, play no part; an empty table gives no rows.
    """
    rows = df.select(F.col(key).alias("_k"), F.col(cell).alias("_raw"), source.alias("_s")).where(F.col("_raw").rlike("[0-9]"))
    plain = F.col("_raw").rlike(r"^\s*[0-9]+(?:\.0+)?\s*$")
    single = rows.where(plain).select(
        "_k", F.lit(1).alias("pos"), F.when(F.col("_raw").rlike("^[0-9]+$"), F.col("_raw")).otherwise(F.regexp_replace(F.trim(F.col("_raw")), r"\.0+$|\s+", "")).alias(out)
    )
    packed = rows.where(~plain)
    scores = delimiter_scores(packed, F.col("_raw"), F.col("_s"), id_pattern)
    pattern = F.create_map(*[F.lit(x) for d in DELIMITERS for x in d])
    spell = lambda names: F.array_join(F.transform(F.array_sort(names), lambda n: F.concat(F.lit("(?:"), pattern[n], F.lit(")"))), "|")
    own = scores.where("accepted").groupBy("source").agg(spell(F.collect_set("delimiter")).alias("_own"))
    general = (  # one row, of at most as many names as there are candidates
        scores.groupBy("delimiter")
        .agg((F.sum(F.col("cells") * F.col("regular")) / F.sum("cells")).alias("r"))
        .agg(F.collect_set(F.when(F.col("r") >= 0.5, F.col("delimiter"))).alias("_n"))
        .select(F.when(F.size("_n") > 0, spell(F.col("_n"))).otherwise(F.lit("(?!)")).alias("_all"))
    )
    # the table of sources is small against the rows but not bounded: the planner picks the join by its size
    joined = packed.join(own, packed["_s"].eqNullSafe(own["source"]), "left").crossJoin(F.broadcast(general))

    def values(by: Column) -> Column:
        pieces = F.transform(F.split(F.regexp_replace(F.col("_c"), by, "\u0001"), "\u0001"), _piece)
        return F.filter(pieces, lambda x: (x != "") & ~F.lower(x).isin(NOTHING))

    mine = joined.select("_k", "_all", bare(F.col("_raw")).alias("_c"), F.coalesce("_own", "_all").alias("_own"))
    split = mine.withColumn("_v", values(F.col("_own"))).withColumn(
        "_v",
        F.when(F.forall("_v", lambda x: x.rlike(id_pattern)), F.col("_v")).otherwise(
            values(F.concat_ws("|", F.col("_own"), F.col("_all")))
        ),
    )
    many = split.select("_k", F.filter("_v", lambda x: x.rlike(id_pattern)).alias("_v")).select(
        "_k", F.posexplode("_v").alias("_p", out)
    ).select("_k", (F.col("_p") + 1).alias("pos"), out)
    return single.unionByName(many).withColumnRenamed("_k", key)


def account(author: Column) -> Column:
    """The source of a message: its handle without case and blanks; customers are one source."""
    a = F.lower(F.trim(F.coalesce(author, F.lit(""))))
    return F.when(a.rlike(r"^[0-9]*$"), F.lit("customers")).otherwise(a)
