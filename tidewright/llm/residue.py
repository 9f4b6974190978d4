"""Problem 6: template residue, filler and error pages instead of content.

Each delimiter style has a grammar of its own (what may stand between the delimiters of an unfilled placeholder),
whole-text and in-text patterns find printed empty values, filler, drafting notes, error output and notices about
scripts. A find is discounted where the context shows that the text talks about such things: quoted, inside a code
block, or in a sentence that explains or teaches. Density decides against the discount: in a text that is mostly quote
or code, and in a sentence that is mostly placeholders. Every rule is a column expression, so the operator is one
projection without Python; the shuffle that makes rows distinct spreads them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What may stand in a placeholder: a name in one of the usual spellings, or words.
_SLOT = r"[A-Za-zÀ-ÿ][\wÀ-ÿ]*(?:[ ._:/|-][\wÀ-ÿ]+){0,4}"
_FIELD = r"(?:(?:first|last|full|user|customer|client|company|agent|your|their|order|product|ticket|case|tracking|refund|store|shop|team|city|date|name|link|url|id|email|phone|address|amount|number|greeting|signature|subject|title|insert|enter|add|fill|placeholder|recipient|sender|nombre|vorname|nachname|kunde|kundenname|prénom|nom|name|datum|fecha|apellido|adresse|lien|enlace|your|my|the|here)(?:[ ._-]|\b))"

#: Name, Java pattern: one grammar for each delimiter style.
PLACEHOLDERS = [
    ("double_braces", rf"\{{\{{[#/^&>!]?\s*(?:{_SLOT})?\s*\}}\}}"),
    ("dollar_braces", rf"[$#@]\{{\s*(?:{_SLOT})?\s*\}}"),
    ("braces", r"(?<![$#@{\w])\{\s*(?:[A-Za-zÀ-ÿ][\wÀ-ÿ.]*(?:[ _-][\wÀ-ÿ]+){0,3}|\d{0,2})\s*\}(?!\})"),
    ("template_tag", r"<%[=-]?\s*[^%<>]{0,60}%>|\{%\s*[^%{}]{1,60}%\}"),
    ("double_angles", rf"<{{2,3}}\s*(?:{_SLOT})?\s*>{{2,3}}"),
    ("guillemets", r"«[A-Za-zÀ-ÿ][\wÀ-ÿ]*(?:[._ -][\wÀ-ÿ]+){0,2}»"),
    ("angles", rf"<(?:[A-Z][A-Z_ ]{{2,30}}|(?i:{_FIELD})[\wÀ-ÿ ._-]{{0,40}}|[A-Z][a-z]+ [A-Z][a-z]+|[a-z]+_[a-z_]+|[a-z]+\.[a-z]+|(?:draft|answer|reply|response|text|content|agent|customer|city|store|link|date|product)(?: [a-z]+){{0,3}})>"),
    ("double_squares", rf"\[\[\s*(?:{_SLOT})?\s*\]\]"),
    ("squares", rf"(?i)\[(?:{_FIELD}[\wÀ-ÿ ._'-]{{0,40}}|[A-Z][A-Z_ ]{{2,30}}_?NAME|[a-z]+_[a-z_]+|[a-z]+\.[a-z]+|(?:reply|answer|response|text|greeting|closing|content|message|agent|city|store|product|link|date|draft|todo|tbd|xxx+)(?: [a-z]+){{0,3}})\](?!\()"),
    ("percents", rf"%%\s*{_SLOT}\s*%%|%[A-Z][A-Z_]{{2,30}}%"),
    ("format", r"%\([A-Za-zÀ-ÿ_][\wÀ-ÿ .-]*\)[sdifr]|(?<![\w%])%[sd](?![\w%])"),
    ("underscores", r"(?<![\w])__[A-Za-zÀ-ÿ][\wÀ-ÿ. -]*__(?![\w])|(?<![\w_])_{4,}(?![\w_])"),
    ("dollars", rf"(?<![\w$])\$[A-Za-zÀ-ÿ][\wÀ-ÿ]*(?:[ ._-][\wÀ-ÿ]+){{0,3}}\$(?![\w$])|(?<![\w$])\$[a-z]+_[a-z_]+\b"),
    ("queries", r"\?{3}[A-Z_ ]{2,30}\?{3}"),
    ("crosses", r"(?<![\w])[Xx]{4,}(?![\w])"),
    ("hashes", r"##\s*[A-Z][A-Z_ ]{2,30}\s*##|@@\s*\w{2,30}\s*@@|~~\s*[A-Z_]{3,30}\s*~~"),
]

# Printed empty values in a place where a value belongs.
EMPTY = [
    ("whole", r"(?i)^[\s\"'(\[]*(?:null|none|nil|nan|undefined|n/?a|void|empty|tbd|todo|fixme|-+|\.+|\?+|\[object object\]|\(?null\)?|<null>|\{\}|\[\])(?:[\s.,!;]+(?:null|none|nan|undefined)){0,20}[\s\"')\].!]*(?:\([^)]{0,20}\)\s*)?$"),
    ("object", r"\[object [A-Z]\w+\]"),
    ("greeting", r"(?i)\b(?:dear|hi|hello|hallo|hola|bonjour|hey|olá|liebe[r]?|sehr geehrte[r]?|estimad[oa]|cher|chère)\s+(?:undefined|null|none|nan|nil|n/a)\b"),
    ("value", r"\b(?:is|was|are|of|by|in|for|to|at|on|with|order|number|your)\s+(?:NaN|undefined|null|None)\b(?=[\s.,;!?]|$)(?!\s+(?:pointer|colou?rs?|values?|of|and|or))|\bundefined undefined\b|\bNaN\s+(?:days?|hours?|minutes?|euros?|%)"),
]

# Filler and drafting notes.
FILLER = [
    ("lorem", r"(?i)\blorem ipsum\b|\bdolor sit amet\b|\bconsectetur adipiscing\b"),
    ("note", r"(?-i)\b(?:TODO|FIXME|TBD|TBC|XXX)\b(?!\s+(?:list|app|board)\b)|(?i:^\s*(?:todo|fixme)\s*:)"),
    ("goes_here", r"(?i)\b(?:text|message|answer|reply|response|content|draft|greeting|name|comment)s?\s+goes? here\b|\b(?:put|insert|add|enter|write|type|paste)\s+(?:the |your |an? )?(?:\w+ ){0,2}here\b"),
    ("replace", r"(?i)\breplace this (?:text|message|paragraph|line)\b|\b(?:this is )?an? (?:placeholder|sample|dummy|example) (?:answer|text|reply|message|response)\b|\bfor testing purposes only\b|\btexte de remplacement\b|\btexto de (?:ejemplo|relleno)\b|\btexto de exemplo\b"),
    ("whole", r"(?i)^[\s\[(<]*(?:(?:sample|placeholder|dummy|example|test|answer|reply|response|draft|blank|filler|your)\s+){0,9}(?:text|answer|reply|response|draft|sample|placeholder|message|test|content|write answer|write reply)[\s.\])>!]*(?:(?:number |no\.? ?|#)?\d+[\s.]*)?(?:here[\s.]*)?$"),
    ("blind", r"(?i)\b(?:blindtext|mustertext|platzhaltertext|fülltext)\b"),
    ("prompt", r"(?m)^[ \t]*#{2,}[ \t]*(?:Response|Answer|Instruction|Assistant|Reply|Input|Output)\s*:?\s*$|<\|(?:im_start|im_end|endoftext|assistant|user|system)\|>|\[/?INST\]"),
    ("model", r"(?i)\bas an ai (?:language )?model\b|\bthis model is currently overloaded\b"),
]

# Words that nothing but hammering on the keys gives.
HAMMERED = "asdf asdfg asdfgh qwer qwerty qwertz hjkl jkl test foo bar baz blah bla xyz abc".split()

# Output of failing programs and servers.
ERRORS = [
    ("traceback", r"Traceback \(most recent call last\)|(?m)^[ \t]*File \"[^\"]+\", line \d+|^[ \t]*at [\w$.]+\([\w.]+:\d+\)|\b(?:Key|Value|Type|Attribute|Index|Runtime|Name|Import|Reference|Syntax|Range|Null\w*)(?:Error|Exception)\s*:"),
    ("json", r"(?s)^\s*\{\s*\"(?:error|errors|status|code|message|detail)\"\s*:.*\}\s*$"),
    ("markup", r"(?is)<(?:!doctype html|html|head|title|body|h1|center|noscript)\b[^>]*>"),
    ("status", r"(?i)^\s*+(?:http(?:/\d(?:\.\d)?)?[ \t]{0,3})?(?:error|fehler|erreur|status|code)?[ \t]{0,3}[:#]?[ \t]{0,3}[45]\d\d\b[\s:,.-]*(?:[A-Z][\w -]{2,40})?[\s.!]*$|\[error [45]\d\d\]|\bHTTP Error [45]\d\d: [A-Z]|(?i)\b(?:not found|internal server error|bad gateway|service unavailable|forbidden|gateway time-?out|too many requests)\s*\([45]\d\d\)|\((?:Fehler|error|erreur|código|codice) [45]\d\d\)"),
    ("server", r"(?i)^\s*(?:internal server error|bad gateway|service unavailable|gateway time-?out|forbidden|not found|too many requests|access denied|erreur interne du serveur|interner serverfehler|error interno del servidor|erro interno do servidor)\b[\s.!]*(?:\([^)]{0,40}\))?"),
    ("backend", r"(?i)\bupstream connect error\b|\bdisconnect/reset before headers\b|\b(?:request|connection|query) timed out after \d+|\bno response from backend\b|\binternal error while\b|\bunexpected token .{1,3} in json\b|\bnull pointer\b|\bsegmentation fault\b|\bstack overflow at\b|\bECONN(?:REFUSED|RESET)\b|\bconnection refused\b|\bout of memory\b"),
    ("page", r"(?i)\bthe (?:page|resource|url|document) you (?:requested|are looking for|tried)\b.{0,30}\b(?:not|could|cannot|can't|does)\b|\bdie angeforderte seite\b|\bp[áa]gina no encontrada\b|\bpage (?:introuvable|non trouvée)\b|\bpágina não encontrada\b|\byou don'?t have permission to (?:view|access)\b|\bthe site is down for maintenance\b|\bsomething went wrong on our (?:end|side)\b"),
    ("session", r"(?i)^\s*(?:your )?session (?:has )?expired\b|^\s*oops[!.,]"),
]

# Notices that scripts or cookies are needed or that the browser is unfit.
SCRIPTS = [
    ("enable", r"(?i)\b(?:please |you need to |you must )?\s*(?:enable|activate|turn on|switch on|allow)\s+(?:javascript|java script|scripting|scripts|cookies)\b.{0,60}\b(?:to (?:continue|run|view|use|see|proceed|access)|in your browser to|and (?:cookies|refresh|reload))|\bjavascript (?:is )?(?:required|disabled|must be enabled|needs to be)"),
    ("off", r"(?i)\byour browser (?:has (?:scripts|javascript|cookies) (?:turned off|disabled|switched off)|is not supported|is unsupported|is (?:out of date|outdated)|does(?:n'?t| not) support)|\bscripts? (?:are|is) disabled\b|\bthis (?:page|site) (?:needs|requires|works best with) (?:scripts|javascript|cookies)|\bscripting seems to be blocked\b|\bscripts switched on\b"),
    ("cookies", r"(?i)\bwe use cookies(?:\s*(?:[.!;:]|$)|\s+(?:to|on (?:this|our) (?:web)?(?:site|page)|and (?:similar|other))\b)|\baccept (?:all )?cookies to\b|\bcookies (?:are|must be) (?:required|enabled|disabled)\b|\baccept all to continue\b"),
    ("checking", r"(?i)\bchecking your browser before\b|\bverify(?:ing)? (?:that )?you are (?:a )?human\b|\bcomplete the captcha\b"),
    ("other", r"(?i)\b(?:activez|activer) (?:java ?script|les cookies)\b|\b(?:aktivieren sie|bitte) (?:java ?script|cookies)\b.{0,30}|\bjavascript (?:aktivieren|zu aktivieren)\b|\b(?:habilite|active|activa) (?:java ?script|las cookies|os cookies)\b|\bative o javascript\b"),
]

# A sentence that gives an example or says what something means talks about such things.
_EXPLAINS = r"(?i)\b(?:for example|for instance|e\.g\.|such as|means (?:that|the|your)|zum beispiel|z\. ?b\.|par exemple|por ejemplo|por exemplo)|\[sic\]"

# A sentence that teaches about placeholders, and one that describes where or how a number is written.
_TEACHES = r"(?i)\b(?:placeholders?|templates?|variables?|merge (?:fields?|tags?)|syntax|tutorials?|snippets?|(?:curly |square )?(?:braces|brackets)|platzhalter|vorlagen?|plantillas?|modèles?)\b"
_DESCRIBES = r"(?i)\b(?:on|at|under) the (?:back|bottom|side|top|front|inside|label|box|card|lid|plate|receipt|invoice|sticker|package|parcel)\b|\blooks? like\b|\bin the form(?:at)?\b|\b(?:starts?|begins?|ends?) (?:with|in)\b|\b(?:digits?|characters?) (?:long|after|before)\b"
_TELLS = r"(?i)\b(?:type|write|use|put|insert|enter|replace|set|add|copy|paste|fill|shows?|called|named|stands? for|schreiben|verwenden|escrib\w+|usa|écri\w+|utilis\w+)\b"
#: Share of a sentence that its placeholders may take where it teaches about them.
MOST = 0.5
#: Share of a text that must stand outside code and quotes for these to be discounted.
REST = 0.2


def _without_code(text: Column) -> Column:
    """The text without fenced and inline code and without quoted pieces, which only mention what they hold."""
    x = F.regexp_replace(text, r"(?s)```.*?```|~~~.*?~~~", " ")
    x = F.regexp_replace(x, r"`[^`\n]++`", " ")
    return F.regexp_replace(x, r"\"[^\"{}<>\n]++\"(?!\s*:)|“[^”\n]++”|(?<!\w)'[^'\n]{3,}+'(?!\w)", " ")


def _sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s) != "")


def _hammered(text: Column) -> Column:
    """One word over and over, one letter over and over, or nothing but hammered words. No regular expression repeats
    a group here, as the JVM's would recurse once a word of a long text."""
    words = F.filter(F.split(F.lower(text), r"[\s,.!]+"), lambda w: w != "")
    kinds = F.array_distinct(words)
    again = (F.size(kinds) == 1) & (F.size(words) >= 3) & F.forall(kinds, lambda w: w.rlike(r"^\p{L}{2,12}$")) & ((F.size(words) >= 4) | F.forall(kinds, lambda w: w.rlike("^[a-z]{3,5}$")))
    letter = (F.size(words) == 1) & F.forall(kinds, lambda w: (F.length(w) >= 5) & w.rlike("^[a-z]") & (F.replace(w, F.substring(w, 1, 1), F.lit("")) == ""))
    keys = (F.size(words) >= 2) & F.forall(kinds, lambda w: w.isin(HAMMERED) | w.rlike("^[0-9]{1,6}$")) & F.exists(kinds, lambda w: w.isin(HAMMERED))
    return again | letter | keys


def _stripped(text: Column) -> Column:
    return reduce(lambda acc, p: F.regexp_replace(acc, p[1], ""), PLACEHOLDERS, text)


def _taught(sentence: Column) -> Column:
    """Whether a sentence teaches about placeholders and isn't mostly made of them, or describes a number."""
    rest = _stripped(sentence)
    teaches = sentence.rlike(_TEACHES) & sentence.rlike(_TELLS) & rest.rlike(_TEACHES) & (F.length(rest) >= (1 - MOST) * F.length(sentence))
    return teaches | (sentence.rlike(_DESCRIBES) & ~sentence.rlike(_DELIMITED))


# a placeholder with delimiters, other than a row of crosses or lines
_DELIMITED = "|".join(f"(?:{p})" for n, p in PLACEHOLDERS if n not in ("crosses", "underscores"))


def _let(value: Column, use) -> Column:  # noqa: ANN001
    """use(value), with the value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _forms(text: Column) -> Column:
    """A text as the rules read it: trimmed; without code and quotes, unless little else is there; of that, the
    sentences that explain nothing; and where unfilled places are looked for, without those that teach about them."""

    def read(whole: Column, loose: Column) -> Column:
        plain = F.array_join(F.filter(_sentences(loose), lambda s: ~s.rlike(_EXPLAINS)), "\n")
        untaught = F.array_join(F.filter(_sentences(loose), lambda s: _let(s, lambda x: ~_taught(x))), "\n")
        slots = F.when(loose.rlike(_TEACHES) | loose.rlike(_DESCRIBES), untaught).otherwise(loose)
        return F.struct(whole.alias("whole"), loose.alias("loose"), plain.alias("plain"), slots.alias("slots"))

    def cut(whole: Column, kept: Column) -> Column:
        # code and quotes with little around them are the content, unless they show little but a placeholder
        return F.when((F.length(F.trim(kept)) < REST * F.length(whole)) & ((density(whole) < MOST) | ~kept.rlike(r"\p{L}")), whole).otherwise(kept)

    return _let(F.trim(F.coalesce(text, F.lit(""))), lambda w: _let(_let(_without_code(w), lambda k: cut(w, k)), lambda x: read(w, x)))


def residue_kinds(text: Column) -> Column:
    """Sorted names of all kinds found in a text, empty for none; null and empty texts have none."""
    return _let(_forms(text), _kinds)


def _kinds(forms: Column) -> Column:
    whole, loose, plain = forms["whole"], forms["loose"], forms["plain"]
    found = []
    for name, p in PLACEHOLDERS:
        found.append(F.when(forms["slots"].rlike(p), F.lit(f"placeholder:{name}")))
    for name, p in EMPTY:
        found.append(F.when((whole if name == "whole" else loose).rlike(p), F.lit(f"empty:{name}")))
    for name, p in FILLER:
        found.append(F.when((whole if name in ("whole", "prompt") else plain).rlike(p), F.lit(f"filler:{name}")))
    found.append(F.when(_hammered(whole), F.lit("filler:keys")))
    for name, p in ERRORS:
        found.append(F.when((plain if name not in ("json", "markup", "traceback", "status", "server") else whole).rlike(p), F.lit(f"error:{name}")))
    for name, p in SCRIPTS:
        found.append(F.when(plain.rlike(p), F.lit(f"scripts:{name}")))
    return F.when(F.length(whole) > 0, F.array_sort(F.array_compact(F.array(*found)))).otherwise(F.array().cast("array<string>"))


def density(text: Column) -> Column:
    """Share of the text's characters that placeholders take."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.length(whole) > 0, 1 - F.length(_stripped(whole)) / F.length(whole)).otherwise(0.0)


def find_residue(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kinds) of every distinct (key, text) whose text is or contains residue.

    Null and empty texts are no case. A tutorial that shows placeholders in code blocks or quotes them is none
    either. Repeated rows count once; other columns play no part; an empty table gives no rows.
    """
    rows = df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where(F.length(F.trim("_t")) > 0)
    # a shuffle of a stated width isn't joined into few tasks by its size, which says little about the work
    spark = df.sparkSession
    width = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.distinct().repartition(width, "_k", "_t")
    # a generator over one element keeps what is below it from being worked out once a use
    forms = rows.select("_k", F.explode(F.array(_forms(F.col("_t")))).alias("f"))
    return forms.select(F.col("_k").alias(key), F.explode(F.array(_kinds(F.col("f")))).alias("kinds")).where("size(kinds) > 0")


def exclude_residue(df: DataFrame, text: str) -> DataFrame:
    """The rows of df whose text holds no residue, all columns as they were; null and empty texts stay."""
    return df.where(F.size(residue_kinds(F.col(text))) == 0)
