"""Problem 10: sentence boundaries by cascading tables of ordered break and no-break rules.

A text is cut into blocks at blank lines and before list items. In a block every final mark is a candidate, and in Thai
every blank. The tables of rules are asked in order: quotations and brackets that close at the mark, marks of other
scripts, the block's language, the others of its script, the general one. The first rule decides whose conditions hold
at the candidate and whose two regular expressions match before and behind it. Expressions for what stands before are
matched backwards from the candidate, and quotations and links are walked along with the candidates, so that the time
goes with the length of the text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

# Abbreviations after which a point ends no sentence, by language.
ABBREVIATIONS = {
    "en": "Dr Mr Mrs Ms Messrs Prof Rev Sgt Capt Lt Col Gov Sen Hon Pres St Mt Ft Nos Vols Mk cf vs viz approx incl excl dept e.g i.e eg ie".split(),
    "de": "Nr Nrn Hr Hrn Fr Fa Dr Prof Dipl Ing Str Abb Kap Bd Bde Tel bzw ggf evtl inkl exkl zzgl usf vgl sog bspw gem z.B d.h u.a i.d.R o.ä u.U z.T v.a".split(),
    "fr": "M MM Mme Mmes Mlle Mlles Dr Pr Me Ste Sté éd env réf chap pp cf tél av bd p.ex c.-à-d v".split(),
    "es": "Sr Sra Sres Sras Srta Dª Dra Dr Prof Lic Ing Ud Uds uds Vd Vds pág págs núm núms vols cía cond grales aprox tel avda p.ej".split(),
    "pt": "Sr Sra Sres Srs Dr Dra Prof Profa Eng Exmo Exma pág págs núm cf incl aprox tel p.ex i.e".split(),
    "ru": "ул д стр рис табл гл п пп см ср напр проф акад им т тыс млн млрд кв кор корп обл р-н пер пр просп ок тел т.е т.к т.н и.о".split(),
    "hi": "डॉ श्री सुश्री प्रो पं कृ रु सं".split(),
    "ar": "د أ م ص ت هـ ق".split(),
}
# Abbreviations that stand before a number; only then their point ends no sentence.
NUMBERED = {
    "en": "no nos fig figs sec secs vol ch eq ed pp p max min ca est jan feb mar apr jun jul aug sep sept oct nov dec mon tue tues wed thu thurs fri sat sun".split(),
    "de": "nr s abs art ca max min mind st jan feb mär apr jun jul aug sep sept okt nov dez".split(),
    "fr": "n no art fig vol p av max min janv févr avr juil sept oct nov déc".split(),
    "es": "n art arts cap fig vol p c máx mín ene feb mar abr may jun jul ago sept oct nov dic".split(),
    "pt": "n art arts cap fig vol p c máx mín jan fev mar abr mai jun jul ago set out nov dez".split(),
    "ru": "г с стр ст ч кг".split(),
}
# Abbreviations that may end a sentence; the next word decides.
CLOSING = {
    "en": "etc a.m p.m am pm Inc Ltd Co Corp Bros Jr Sr U.S U.K U.N Ave Rd Blvd ft oz lbs lb hrs".split(),
    "de": "usw etc e.V Co GmbH AG Std Min Uhr".split(),
    "fr": "etc Cie cie S.A env h".split(),
    "es": "etc S.A S.L Cía EE.UU".split(),
    "pt": "etc Ltda S.A Lda Cia".split(),
    "ru": "руб коп г гг др т.д т.п".split(),
}
# Frequent function words by which the language of a block is told.
FUNCTION_WORDS = {
    "en": "the and my was to of is in for with that you it on at not i".split(),
    "de": "der die das und ist nicht ich wir wurde mir für mit den dem am schon".split(),
    "fr": "le la les et est pas je une des du nous pour que a hier".split(),
    "es": "el los las y es no por una del que se ha he llegó".split(),
    "pt": "o os as e não uma do da em que foi há já".split(),
}
# Words that start a sentence when capitalised behind an abbreviation that may end one.
STARTERS = "The This That These Those There It He She We You They I My Our Your His Her Its A An And But So Or If When While Because Since After Before Please Can Could Would Will Who What Where When Why How Is Are Was Were Do Does Did Has Have Had Not No Yes Now Then Inside Chat Never Each Every Two Call Open Wipe Parcels Item Order Version Step See Everything Der Die Das Ein Eine Wir Ich Es Für Leider Warum Wo Ist Können Am Le La Les Un Une Je Nous Ce C’est C'est Où Est-ce Pouvez-vous Ça Mon Ma Être El Los Las Ya No ¿ ¡ Según O Os As Já Ainda Onde".split()
# Thai particles that end a statement, and words that continue one.
THAI_FINAL = "ครับ ค่ะ คะ ครับผม นะ จ้ะ จ้า จ๊ะ ฮะ".split()
THAI_GOES_ON = "แต่ และ หรือ ที่ ซึ่ง เพราะ แล้วก็ ก็ จึง ว่า ของ กับ โดย เมื่อ".split()
# Verbs of saying behind a quotation that opens its sentence.
SAYING = "asked said wrote replied answered shouted thought told wondered repeated fragte sagte schrieb demandai répondit dijo preguntó pregunté disse perguntou perguntei".split()

_OPEN = "(\\[{（［｛「『《〈【«“‘„‚‹"
_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "｛": "｝", "「": "」", "『": "』", "《": "》", "〈": "〉", "【": "】", "«": "»", "“": "”", "‘": "’", "„": "“”", "‚": "‘’", "‹": "›"}
_CLOSE = ")\\]}）］｝」』》〉】»”’“›\"'"
_EMOJI = r"(?:(?:\p{Extended_Pictographic}|[\U0001F1E6-\U0001F1FF])(?:[️‍\U0001F3FB-\U0001F3FF]|\p{Extended_Pictographic})*)"
_MARKS = ".!?…。！？．｡؟۔।॥‼⁇⁈⁉"
_NL = r"(?>\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])"
_BLANK = regex.compile(rf"{_NL}(?:[^\S\n\r\x0b\x0c\x85  ]|[​﻿])*{_NL}[\s​﻿]*")
_ITEM = regex.compile(rf"(?<=[{_MARKS}:：]|^)[^\S\n\r]*{_NL}(?=[^\S\n\r]*(?:[-*•–·‣▪●○]\s+\S|\(?(?:\d{{1,3}}|[A-Za-z])[.)]\s+\S))|{_NL}(?=[^\S\n\r]*(?:[•‣▪●○]\s*\S|[-*]\s+\p{{Lu}}|\d{{1,3}}\)\s))", regex.M)
_CANDIDATE = regex.compile(
    rf"(?P<m>[{_MARKS}]+)(?P<c>(?:[ \u00a0\u202f]?[»›](?!\w)|(?<=[»›])[ \u00a0\u202f][?!]+|[{_CLOSE}]|{_EMOJI}|[{_MARKS}])*)|(?P<t>(?<=[\u0e00-\u0e7f])[ \u00a0]+(?=[\u0e00-\u0e7f]))"
)
_URL = regex.compile(r"(?:https?://|www\.)\S+|(?<![\p{L}\p{N}_.+@-])(?:[\w+-]+(?:\.[\w+-]+)*+@[\w-]+(?:\.[\w-]+)++|\p{Ll}[\p{L}\p{N}-]*+(?:\.\p{Ll}[\p{L}\p{N}-]*+)*+/\S*|\p{Ll}[\p{Ll}\p{N}-]*+(?:\.\p{Ll}[\p{Ll}\p{N}-]++)*?\.(?:com|org|net|example|de|fr|es|io|invalid|test|html?|pdf|txt|js|py|png|jpe?g|csv)\b)", regex.I)
# each link holds one of these
_MAY_LINK = regex.compile(r"[/@]|\w\.\w|www\.", regex.I)
_WORD = regex.compile(r"[\p{L}']+")
_SPACES = regex.compile(r"\s*+")


def _alt(words: list[str]) -> str:
    words = sorted({f for w in words for f in (w, unicodedata.normalize("NFD", w))}, key=lambda w: (-len(w), w))
    spaced = [regex.escape(w).replace(r"\.", r"\.[  ]?") for w in words]
    return "|".join(spaced)


# Conditions at a candidate that a rule may need.
CLOSED, BRACKET, QUOTE, START, INNER, SAID, KANA, NO_KANA, MIXED, EMOJI, EAST, INDIC, ELLIPSIS, DOTS, STRONG, POINT = (1 << i for i in range(16))
# White space follows or doesn't; the word before a lone point is short or named by the languages' rules; emoji or the like close.
SPACED, TIGHT, LISTED, CLOSERS = (1 << i for i in range(16, 20))


class Rule:
    """Decides `break_` where the conditions `needs` hold, `before` matches what ends at the candidate and `after` what follows."""

    __slots__ = ("break_", "before", "after", "needs")

    def __init__(self, break_: bool, before: str, after: str, flags: int = 0, needs: int = 0):
        self.break_ = break_
        self.before = regex.compile(rf"(?r)(?:{before})", flags) if before else None
        self.after = regex.compile(after, flags) if after else None
        self.needs = needs

    def holds(self, text: str, begin: int, end: int, on: int) -> bool:
        """For a sentence that began at `begin`, a candidate that ends at `end` and text that goes on at `on`."""
        if self.after is not None and self.after.match(text, on) is None:
            return False
        if self.before is None:
            return True
        # the start of the sentence is the edge of a word, whatever stands before it
        return (self.before.match(text[begin:end]) if end - begin <= 64 else self.before.match(text, begin, end)) is not None


_SP = r"[\s  ]+"
_STOP = rf"[.](?:[{_CLOSE}])*"


def _language_table(lang: str) -> list[Rule]:
    """Rules of one language; the flag I makes them hold in texts written in capitals or small letters only."""
    rules = []
    edge = r"(?<![\p{L}\p{N}ऀ-ॿ.])"
    if lang == "en":
        rules.append(Rule(True, rf"{edge}no\.", rf"{_SP}\p{{Lu}}"))
    if lang == "de":
        rules.append(Rule(False, r"(?:\b(?:am|der|die|das|dem|den|des|vom|zum|beim|im|bis|seit|ab)\s+|\b)(?<!\d)\d{1,2}\.", rf"{_SP}(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)", regex.I))
        rules.append(Rule(False, r"\b(?:am|der|die|das|dem|den|des|vom|zum|beim|im|bis|seit|ab)\s+\d{1,2}\.", rf"{_SP}\p{{L}}", regex.I))
    if lang in NUMBERED:
        rules.append(Rule(False, rf"{edge}(?:{_alt(NUMBERED[lang])})\.", rf"(?:{_SP})?[№#]?\d", regex.I))
    words = ABBREVIATIONS.get(lang, [])
    closing = CLOSING.get(lang, [])
    if closing:
        starts = "|".join(regex.escape(w) for w in STARTERS)
        close = rf"{edge}(?:{_alt(closing)})\."
        rules.append(Rule(False, close, rf"{_SP}(?:{_alt(closing)})\."))
        rules.append(Rule(False, rf"{edge}(?:co|inc|ltd|corp|bros|cie|s\.[  ]?a|e\.[  ]?v)\.", rf"{_SP}\p{{Ll}}", regex.I))
        rules.append(Rule(False, close, rf"{_SP}[\p{{Ll}}\p{{N}}&(,;:–—-]"))
        rules.append(Rule(True, close, rf"{_SP}(?:(?:{starts})\b|[¿¡\"“«„‘(]?\p{{Lu}})"))
    if words:
        rules.append(Rule(False, rf"{edge}(?:{_alt(words)})\.", rf"(?:{_SP})?\S", regex.I))
    return rules


#: Rules of all scripts, asked last. `before` ends with the mark and what closes behind it.
_GENERAL = [
    # initials and letters with points
    Rule(False, r"(?<![\p{L}\p{N}'’])\p{Lu}\.", rf"(?:{_SP})?\p{{L}}", needs=LISTED),
    # a mark that more letters or digits follow at once
    Rule(True, rf"(?:\p{{Ll}}\p{{Ll}}|\p{{N}}|\p{{Lu}}\p{{Lu}}|[)\]»”\"])[.!?…]+(?:[{_CLOSE}]|{_EMOJI})*", r"[¿¡\"“«„(]?\p{Lu}[\p{Ll}\p{M}'’ ]", needs=TIGHT),
    Rule(True, rf"[!?…]+(?:[{_CLOSE}]|{_EMOJI})*", r"[¿¡]?\p{Lu}", needs=TIGHT),
    Rule(True, rf"(?:{_EMOJI})", r"[^\s\p{P}]", needs=TIGHT | CLOSERS),
    Rule(False, "", "", needs=TIGHT),
    # dots of omission go on with a small letter, and in scripts without case
    Rule(False, r"(?:\.{2,}|…)", rf"{_SP}(?:\p{{Ll}}|[؀-ۿऀ-ॿ฀-๿])"),
    # a final mark with what closes behind it
    Rule(False, r"\.", rf"{_SP}[,;:)]", needs=POINT),
    Rule(False, rf"[^{_CLOSE}\s]\.", rf"{_SP}\p{{Ll}}", needs=POINT),
    Rule(True, "", ""),
]

#: Asked before all others of a language: a letter with a point that another one follows (z. B., p. ex., U.S.).
_FIRST = [Rule(False, r"(?<![\p{L}\p{N}'’])\p{L}\.", rf"(?:{_SP})?\p{{L}}{{1,2}}\.")]

_OPENING = r"[¿¡\"“«„‘(\[]*"
_HAN = r"[\p{Han}\p{Hiragana}\p{Katakana}ー、，,；;：:。]"
_KANA_ON = r"(?:[とってはがをにのでもや、，,。．.；;：:]|という|だけ)"
_HAN_ON = r"(?:[，,、；;：:。]|然后|她|他|我|就|但|而|却|不过|只|的|是)"

#: A quotation or bracket closes at the mark, and no other mark follows it.
_CLOSED = [
    Rule(False, "", rf"\s+{_OPENING}\p{{Ll}}", needs=CLOSED | MIXED),
    Rule(False, "", rf"\s+I (?:{'|'.join(SAYING)})\b", needs=CLOSED | MIXED | START | QUOTE),
    Rule(True, "", rf"\s+{_OPENING}\p{{Lu}}", needs=CLOSED | MIXED),
    Rule(False, "", r"\p{Ll}", needs=CLOSED | MIXED),
    # scripts without spaces: what goes on with a particle belongs to the sentence around
    Rule(True, "", rf"\s*{_HAN}", needs=CLOSED | BRACKET | START),
    Rule(False, "", rf"\s*{_HAN}", needs=CLOSED | BRACKET),
    Rule(False, "", rf"\s*(?={_HAN}){_KANA_ON}", needs=CLOSED | KANA),
    Rule(False, "", rf"\s*(?={_HAN}){_HAN_ON}", needs=CLOSED | NO_KANA),
    Rule(False, "", rf"\s*{_HAN}", needs=CLOSED | START),
    Rule(True, "", rf"\s*{_HAN}", needs=CLOSED),
    Rule(True, "", r"\s+[\p{L}\p{N}]", needs=CLOSED | BRACKET | START),
    Rule(True, "", r"[\p{L}\p{N}]", needs=CLOSED | BRACKET | START | EMOJI),
    Rule(True, "", r"\s+[\p{L}\p{N}]", needs=CLOSED | QUOTE | SAID | INNER),
    Rule(True, "", r"[\p{L}\p{N}]", needs=CLOSED | QUOTE | SAID | INNER | EMOJI),
    Rule(False, "", r"\s*[\p{L}\p{N}]", needs=CLOSED),
    Rule(False, "", r"\s*[,;:،؛–—-]", needs=CLOSED),
]
#: Marks that leave little to decide: those of scripts with marks of their own, and the dots of omission.
_MARK = [
    Rule(True, "", "", needs=EAST),
    Rule(True, "", r"[^\p{L}\p{N}]", needs=INDIC),
    Rule(False, "", rf"(?!\p{{Lu}}|{_EMOJI})\S", needs=ELLIPSIS),
]
#: Texts without capitals, where white space follows: before and behind the language's rules against a break.
_SMALL_FIRST = [Rule(False, "", rf"{_SP}(?:and|or|but|for|no|not|just|then|et|y|e|und|le|la|les|el|и|а|но)\b", regex.I, DOTS)]
_SMALL_LAST = [
    Rule(False, r"(?<![\p{L}\p{N}'’])\p{L}\.", "", needs=POINT),
    Rule(False, "", r"\s+[؀-ۿऀ-ॿ฀-๿]", needs=DOTS),
    Rule(True, "", ""),
]
#: Small letters behind ! and ?.
_STRONG = [Rule(True, "", r"\s+\p{Ll}", needs=STRONG)]
#: Blanks between Thai letters.
_THAI = [
    Rule(False, "", "|".join(THAI_GOES_ON)),
    Rule(True, "|".join(THAI_FINAL), ""),
    Rule(True, r"[^\d\"“”']{14}", r"[฀-๿]{14}"),
    Rule(False, "", ""),
]


def _tables() -> dict[str, list[Rule]]:
    return {k: _language_table(k) for k in ABBREVIATIONS}


_TABLES = _tables()
_LATIN = ["en", "de", "fr", "es", "pt"]


_FW: dict[str, list[int]] = {}
for _k, _name in enumerate(_LATIN):
    for _w in FUNCTION_WORDS[_name]:
        _FW.setdefault(_w, []).append(_k)


def cascade(block: str, hint: str | None) -> tuple[str, ...]:
    """The languages whose tables a block meets, in order: its own, then the others of its script."""
    names: list[str] = []
    if _HAS_LATIN.search(block):
        counts = [0] * len(_LATIN)
        for w in _WORD.findall(block.lower()):
            for k in _FW.get(w, ()):
                counts[k] += 1
        names += [_LATIN[k] for k in sorted(range(len(_LATIN)), key=lambda k: (-counts[k], _LATIN[k] != hint, k))]
    if not block.isascii():
        for script, name in _SCRIPTS:
            if script.search(block):
                names.insert(0, name)
    names_ = tuple(names)
    return _CASCADES.setdefault(names_, names_)


_CASCADES: dict[tuple[str, ...], tuple[str, ...]] = {}
_HAS_LATIN = regex.compile(r"\p{Latin}{2}")
_SCRIPTS = [(regex.compile(r"\p{Cyrillic}"), "ru"), (regex.compile(r"\p{Devanagari}"), "hi"), (regex.compile(r"\p{Arabic}"), "ar")]


@lru_cache(maxsize=None)
def _rules(names: tuple[str, ...], have: int, small: bool) -> list[Rule]:
    """The rules that can hold under the conditions `have`, in order, each once. Those of the languages need LISTED."""
    lang = _FIRST + [r for n in names for r in _TABLES[n]] if have & LISTED else []
    every = _CLOSED + _MARK + (_SMALL_FIRST + [r for r in lang if not r.break_] + _SMALL_LAST if small else lang + _STRONG + _GENERAL)
    pattern = lambda rx: rx and (rx.pattern, rx.flags)
    once: dict[tuple, Rule] = {}
    for r in every:
        if not r.needs & ~have:
            once.setdefault((r.break_, pattern(r.before), pattern(r.after), r.needs), r)
    return list(once.values())


def _last_words() -> frozenset[str]:
    """The last words of all that the languages' rules name, in small letters."""
    named = [w for table in (ABBREVIATIONS, NUMBERED, CLOSING) for ws in table.values() for w in ws]
    named += ["no", "co", "inc", "ltd", "corp", "bros", "cie", "a", "v"]
    forms = {f.lower() for w in named for f in (w, unicodedata.normalize("NFD", w))}
    return frozenset(regex.split(r"[^\p{L}\p{M}\p{N}]", w)[-1] for w in forms)


_LAST = _last_words()


_TAIL = regex.compile(r"(?r)[\p{L}\p{M}\p{N}]*+")


def _listed(block: str, begin: int, mark: int) -> bool:
    """Whether the word before the mark is the last word of one that the languages' rules name, a short one or a number."""
    word = _TAIL.match(block, begin, mark)[0]
    return len(word) <= 2 or word.lower() in _LAST


_TOKEN, _TOKEN_BACK = regex.compile(r"\S*+"), regex.compile(r"(?r)\S*+")


def _links(block: str) -> list[tuple[int, int]]:
    """(start, end) of links, addresses and file names, without marks behind them. None holds white space."""
    out, at = [], 0
    while m := _MAY_LINK.search(block, at):
        a, at = _TOKEN_BACK.match(block, at, m.start()).start(), _TOKEN.match(block, m.end()).end()
        out += [(u.start(), u.start() + len(u[0].rstrip(".,!?;:)\"'"))) for u in _URL.finditer(block, a, at)]
    return out


_PAIRED = regex.compile(r"[()\[\]{}（）［］｛｝「」『』《》〈〉【】«»“”‘’„‚‹›\"']")


def _spans(block: str) -> list[tuple[int, int]]:
    """(open, close) positions of quotations and brackets that are closed in the block, by their opening; they nest."""
    out: list[tuple[int, int]] = []
    stack: list[tuple[int, str]] = []
    at: dict[str, list[int]] = {}  # places in the stack of those that a sign closes

    def drop(k: int) -> None:
        out.append((stack[k][0], i))
        while len(stack) > k:
            for c in stack.pop()[1]:
                at[c].pop()

    def push(closers: str) -> None:
        for c in closers:
            at.setdefault(c, []).append(len(stack))
        stack.append((i, closers))

    for m in _PAIRED.finditer(block):
        i, ch = m.start(), m[0]
        before = block[i - 1] if i else " "
        behind = block[i + 1] if i + 1 < len(block) else " "
        if ch in "'’" and before.isalnum() and behind.isalnum():
            continue
        # an opening straight quote may stand inside another one
        if stack and ch in stack[-1][1] and not (ch in "\"'" and (before.isspace() or before in "([") and not behind.isspace()):
            drop(len(stack) - 1)
            continue
        deeper = at[ch][-1] if at.get(ch) else None
        if ch in "\"'":
            if (before.isspace() or before in "([{-–—:（") and not behind.isspace():
                push(ch)
            elif ch == '"' and deeper is not None:
                drop(deeper)
            elif ch == '"' and not before.isalnum() and behind.isalnum() and before not in _MARKS:
                push(ch)
            continue
        if ch in _PAIRS and not (ch == "“" and deeper is not None):
            if ch == "‘" and before.isalnum():
                continue
            push(_PAIRS[ch])
        elif deeper is not None and ch != "’":
            drop(deeper)
    return sorted(out)


_HAS_KANA = regex.compile(r"[\p{Hiragana}\p{Katakana}]")
_HAS_BIG, _HAS_SMALL = regex.compile(r"\p{Lu}"), regex.compile(r"\p{Ll}{2}")
_FIRST_ITEM = regex.compile(r"\s*\(?(?:\d{1,3}|[A-Za-z])[.)]\s")
_UP_QUOTE = regex.compile("[“‘]")
_IS_EMOJI = regex.compile(_EMOJI)


def _block(block: str, hint: str | None) -> Iterator[int]:
    """Ends of the sentences of a block, but for its own end."""
    if not _CANDIDATE.search(block):
        return
    names = cascade(block, hint)
    small = not _HAS_BIG.search(block)
    mixed = MIXED if not small and _HAS_SMALL.search(block) else 0
    kana = None
    urls = _links(block)
    spans = _spans(block)
    item = _FIRST_ITEM.match(block)
    low_quotes = "„" in block or "‚" in block  # only then “ and ‘ close a quotation
    begin, first = 0, _SPACES.match(block).end()  # the sentence, and its first sign
    url = span = 0
    around: list[tuple[int, int]] = []  # the spans around the candidate, the outermost first
    for m in _CANDIDATE.finditer(block):
        end, mark = m.end(), m.start()
        while span < len(spans) and spans[span][0] < mark:
            while around and around[-1][1] < spans[span][0]:
                around.pop()
            around.append(spans[span])
            span += 1
        while around and around[-1][1] <= mark:
            around.pop()
        if m["t"] is not None:
            if not around and next(r for r in _THAI if r.holds(block, begin, mark, end)).break_:
                yield mark
                begin = first = end
            continue
        closers = m["c"]
        if closers and not low_quotes and (up := _UP_QUOTE.search(closers)):
            end = m.start("c") + up.start()
        if item and mark < item.end():
            continue
        while url < len(urls) and urls[url][1] <= mark:
            url += 1
        if url < len(urls) and urls[url][0] <= mark:
            continue
        if around and around[0][1] >= end:
            continue  # the sentence around goes on
        if _SPACES.match(block, end).end() == len(block):
            continue  # the block's end
        ch = m["m"][-1]
        have = EAST if ch in "。！？｡．" else INDIC if ch in "।॥؟۔" else STRONG if ch in "!?" and not closers else POINT if ch == "." else ELLIPSIS if ch == "…" else 0
        if not closers and m["m"] in ("…", "..", "...", "....", "……"):
            have |= DOTS
        if around and not (block[end - 1] in _MARKS and block[end - 1] != "…" and end - 1 > around[0][1]):
            a = around[0][0]
            have |= CLOSED | mixed | (BRACKET if block[a] in "([{（［｛【" else QUOTE)
            if first >= a:
                have |= START
            else:
                k = a
                while k > begin and block[k - 1].isspace():
                    k -= 1
                have |= INNER | (SAID if block[k - 1] in ":：,،，" else 0)
            if kana is None:
                kana = KANA if _HAS_KANA.search(block) else NO_KANA
            have |= kana | (EMOJI if closers and _IS_EMOJI.search(closers) else 0)
        spaced = block[end].isspace()
        have |= (SPACED if spaced else TIGHT) | (CLOSERS if closers else 0)
        if ch == "." and m["m"] == "." and end == mark + 1 and _listed(block, begin, mark):
            have |= LISTED
        rules = _rules(names, have, small and spaced)
        if next(r for r in rules if r.holds(block, begin, end, end)).break_:
            yield end
            begin, first = end, _SPACES.match(block, end).end()


def sentences(text: str | None, hint: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of every sentence, counted in code points from 1, both included; white space around left out."""
    if not text or not text.strip():
        return []
    cuts, at = [], 0
    for m in _BLANK.finditer(text):
        cuts.append((at, m.start()))
        at = m.end()
    cuts.append((at, len(text)))
    out = []
    for a, b in cuts:
        lines, last = [], a
        for m in _ITEM.finditer(text, a, b):
            lines.append((last, m.start()))
            last = m.end()
        lines.append((last, b))
        for x, y in lines:
            block = text[x:y]
            if not block.strip():
                continue
            begin = 0
            for e in [*_block(block, hint), len(block)]:
                piece = block[begin:e]
                left = len(piece) - len(piece.lstrip())
                core = piece.strip()
                if core:
                    out.append((x + begin + left + 1, x + begin + left + len(core)))
                begin = e
    return out


def split_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """(key, start_pos, end_pos): one row a sentence of every document, over the whole text.

    Null, empty and blank texts have no sentences. lang is only a hint and may be wrong or null. Repeated rows give
    repeated sentences; other columns play no part; an empty table gives no rows. One pass without a shuffle.
    """
    cols = [F.col(key).alias("_k"), F.col(text).alias("_t"), (F.col(lang) if lang and lang in docs.columns else F.lit(None).cast("string")).alias("_l")]
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, s, e, n = [], [], [], []
            for i, (t, l) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for a, b in sentences(t, l):
                    n.append(i)
                    s.append(a)
                    e.append(b)
            k = batch.column(0).take(pa.array(n, pa.int32()))
            yield pa.RecordBatch.from_arrays([k, pa.array(s, pa.int32()), pa.array(e, pa.int32())], names=[key, "start_pos", "end_pos"])

    return spread(docs.select(*cols), "_k").mapInArrow(run, f"`{key}` {kind}, start_pos int, end_pos int")
