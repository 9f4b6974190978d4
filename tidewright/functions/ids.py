"""Ids and times as message tables write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = r"[\s\p{Z}\p{Cf}\p{Cc}ᅟᅠ⠀ㅤﾠ]"


def clean_id(c: Column) -> Column:
    """An id in bare digits: blanks, quotes, leading zeros and the ".0" of float columns left out.

    Null, blank and words for "nothing" give null; an id that isn't a number stays as it is, trimmed.
    """
    x = F.regexp_replace(c, r"^[\s\"'\[\](){}#]+|[\s\"'\[\](){}]+$", "")
    number = F.regexp_extract(x, r"^0*([0-9]+?)(?:\.0+)?$", 1)
    word = F.lower(x).isin("", "nan", "none", "null", "na", "n/a", "nil", "nat", "-", "<na>", "undefined")
    # most ids are bare digits already and cost one match
    return F.when(c.rlike("^[1-9][0-9]*$"), c).when(c.isNull(), None).when(number != "", number).when(~word, x)


def id_order(c: Column) -> Column:
    """Numeric order of ids of any length; ids that aren't numbers come after all numbers."""
    return F.struct((~c.rlike(r"^[0-9]+$")).alias("word"), F.length(c).alias("digits"), c.alias("id"))


def has_text(c: Column) -> Column:
    """Whether anything is left without white space and invisible characters; null counts as no text."""
    # a letter or digit settles most texts at once
    return F.coalesce(c.rlike("[A-Za-z0-9]") | (F.length(F.regexp_replace(c, _BLANKS, "")) > 0), F.lit(False))


def parse_time(c: Column) -> Column:
    """UTC timestamp of "Mon Jan 01 04:17:44 +0000 2024", ISO 8601 with zone, epoch seconds or milliseconds; null if unreadable."""
    x = F.trim(c)
    short = F.try_to_timestamp(F.substring(x, 5, 40), F.lit("MMM dd HH:mm:ss Z yyyy"))
    iso = x.try_cast("timestamp")
    number = x.try_cast("double")
    return (
        F.when(x.rlike(r"^[A-Za-z]{3} [A-Za-z]{3} "), short)
        .when(x.rlike(r"^\d{9,10}(\.\d+)?$"), F.timestamp_seconds(number))
        .when(x.rlike(r"^\d{12,13}$"), F.timestamp_millis(number.cast("long")))
        .when(x.rlike(r"^\d{4}-\d\d"), iso)
    )


def speaker_role(author: Column, customer: str = "CUSTOMER", support: str = "SUPPORT") -> Column:
    """SUPPORT has a handle, CUSTOMER a number; null for a missing author."""
    a = F.trim(author)
    return F.when(F.length(a) == 0, None).when(a.rlike(r"^\d+(\.0+)?$"), customer).when(a.isNotNull(), support)
