"""Text functions, Column to Column; all stay in the JVM but for the two that Spark has no expression for."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import patterns as P


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html.unescape(x))


@F.pandas_udf(StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    """NFKD without the combining marks."""
    return s.map(lambda x: None if x is None else "".join(ch for ch in unicodedata.normalize("NFKD", x) if not unicodedata.combining(ch)))


def collapse(c: Column) -> Column:
    """Runs of white space become one blank, none at the ends; null gives the empty text."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), P.SPACES, " "), "^ | $", "")


def normalize(c: Column) -> Column:
    """NFKC, then collapsed white space. Pure ASCII texts don't leave the JVM."""
    c = F.coalesce(c, F.lit(""))
    ascii_only = c.rlike(r"^[\x00-\x7f]*$")
    return collapse(F.when(ascii_only, c).otherwise(_nfkc(F.when(~ascii_only, c))))


def mask(c: Column) -> Column:
    """Contacts and numbers of a normalized text as placeholders, in fixed order: mail, phone, payment, order.

    The order matters: the phone pattern has no upper length and takes card numbers and order ids that it can reach.
    """
    for pattern, name in P.MASKS:
        c = F.regexp_replace(c, pattern, name)
    return c


def word_count(c: Column) -> Column:
    t = F.trim(collapse(c))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def text_metadata(c: Column) -> dict[str, Column]:
    """Counts and flags of a normalized text."""
    masked = mask(c)
    return {
        "url_count": F.regexp_count(c, F.lit(P.URL)),
        "mention_count": F.regexp_count(c, F.lit(P.MENTION)),
        "has_possible_pii": masked != c,
        "character_count": F.length(c),
        "token_count": word_count(c),
        "emoji_present": c.rlike(P.EMOJI),
        "question_present": c.contains("?"),
    }


def letters(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"\p{L}"))


def language(c: Column, detector=None, least_letters: int = 8) -> Column:  # noqa: ANN001
    """'und' for fewer than `least_letters` letters, else what the plugged-in detector (a Column function) says."""
    guess = detector(c) if detector else F.lit("und")
    return F.when(letters(c) < least_letters, "und").otherwise(F.coalesce(guess, F.lit("und")))


def script_language(c: Column) -> Column:
    """A deterministic detector by script, for use where no language library is: Latin texts give null."""
    n = lambda p: F.regexp_count(c, F.lit(p))
    return (
        F.when(n(r"[\p{IsHiragana}\p{IsKatakana}]") > 0, "ja").when(n(r"\p{IsHan}") > 0, "zh").when(n(r"\p{IsHangul}") > 0, "ko")
        .when(n(r"\p{IsCyrillic}") > n(r"\p{IsLatin}"), "ru").when(n(r"\p{IsArabic}") > n(r"\p{IsLatin}"), "ar")
        .when(n(r"\p{IsThai}") > 0, "th").when(n(r"\p{IsDevanagari}") > 0, "hi")
    )


def topic_text(c: Column) -> Column:
    """HTML entities resolved, links and @-names as the words URL and MENTION, white space collapsed."""
    c = F.coalesce(c, F.lit(""))
    plain = F.when(c.contains("&"), _unescape(F.when(c.contains("&"), c))).otherwise(c)
    return collapse(F.regexp_replace(F.regexp_replace(plain, r"(?i)https?://\S+|www\.\S+", " URL "), r"@\w+", " MENTION "))


def duplicate_key(c: Column) -> Column:
    """Small letters without links and @-names, white space collapsed."""
    return collapse(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)https?://\S+|www\.\S+|@\w+", " ")))


def audit_key(c: Column) -> Column:
    """The key of the near-duplicate audit: case folded, without http links and @-names, white space collapsed."""
    folded = F.lower(F.upper(F.coalesce(c, F.lit(""))))
    return collapse(F.regexp_replace(folded, r"(?U)https?://\S+|@\w+", " "))


def response_key(c: Column) -> Column:
    return F.lower(collapse(c))


def id_list(c: Column) -> Column:
    """A comma list as an array: trimmed, without blanks and 'nan'; null gives an empty array."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: (x != "") & (F.lower(x) != "nan"))


def first_id(c: Column) -> Column:
    """The first element of a comma list as it stands, '' for none."""
    return F.split(F.coalesce(c, F.lit("")), ",")[0]


def parse_bool(c: Column) -> Column:
    """Strictly 'true' or 'false' in any case, else null."""
    x = F.lower(F.trim(c))
    return F.when(x == "true", True).when(x == "false", False)


def loose_bool(c: Column) -> Column:
    """'', 'false', '0', 'no' and 'true', '1', 'yes'; anything else is null; null counts as ''."""
    x = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(x.isin("true", "1", "yes"), True).when(x.isin("", "false", "0", "no"), False)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\D", "")


def composite_key(*cols: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def namespaced_hash(namespace: str, c: Column) -> Column:
    """sha256 of the namespace, a colon and the id, in hexadecimal digits."""
    return F.sha2(F.concat(F.lit(namespace + ":"), c.cast("string")), 256)


def evidence_block(items: Column, n: int = 3) -> Column:
    """The first n texts of an array, joined by blank lines."""
    return F.array_join(F.slice(items, 1, n), "\n\n")


def case_by_terms(c: Column, cases: list[tuple[str, list[str]]], default: str) -> Column:
    """The name of the first case of which a term occurs in the small letters of a text."""
    low, out = F.lower(F.coalesce(c, F.lit(""))), None
    for name, terms in cases:
        hit = F.lit(False)
        for t in terms:
            hit = hit | low.contains(t)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(default)


def rule_labels(c: Column, rules: list[tuple[str, str]], suppress: dict[str, str] | None = None) -> Column:
    """Names of the ordered rules (name, Java pattern) that a text matches, in rule order.

    `suppress` names the label that a label drives out. Null matches what the empty text matches.
    """
    text = F.coalesce(c, F.lit(""))
    out = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in rules]))
    for by, what in (suppress or {}).items():
        out = F.when(F.array_contains(out, by), F.array_remove(out, what)).otherwise(out)
    return out


def flag_list(flags: list[tuple[str, Column]]) -> Column:
    """Names of the conditions that hold, in order, each once; a null condition doesn't hold."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(cond, F.lit(n)) for n, cond in flags])))


def iso_time(c: Column) -> Column:
    """A timestamp as ISO 8601 in UTC with seconds; null stays null."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")


def titled(c: Column) -> Column:
    """A name with underscores as words with capitals."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def zero_padded(c: Column, width: int) -> Column:
    """A whole number with leading zeros; longer ones stay whole."""
    t = c.cast("string")
    return F.when(F.length(t) >= width, t).otherwise(F.lpad(t, width, "0"))


def percent(c: Column, digits: int = 1) -> Column:
    """A share as a percentage; a half goes to the even digit."""
    return F.format_string(f"%.{digits}f%%", F.bround(c.cast("double") * 100, digits))


def has_style(c: Column, markers: list[str]) -> Column:
    """Whether a text holds one of the style markers (Java patterns); null holds none."""
    return F.coalesce(c.rlike("|".join(f"(?:{m})" for m in markers)), F.lit(False)) if markers else F.lit(False)
