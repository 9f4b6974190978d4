"""Problem 3: text that was decoded with a wrong character encoding.

A hidden Markov model labels the characters of a text with one clean state and one state for each pair of encodings
(the one the bytes were written in and the one they were read in). A state emits what its pair may have written: byte
sequences that are valid in it and give plausible characters; how likely they are follows from what they were. The
clean state's emissions are those of clean text. The likeliest path is found by the Viterbi recursion over the
non-ASCII characters, and each labelled span gets the inverse transform of its state, again until nothing is labelled,
so that text garbled several times is restored as well. Where no pair explains a span better than another, it is named
but stays as it is. Emissions and transitions start from fixed values and are fitted by expectation and maximisation on
all texts (`fit_all`): every character is counted, and the rounds label every text that a state may have written. A gate
of JVM patterns, necessary conditions of every state, tells which these are.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..session import cut, scratch, spread

#: Read in: for UTF-8 that was read in a single-byte encoding.
READ_AS = ["cp1252", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "iso8859_15", "cp1254", "cp852", "cp866", "iso8859_2", "koi8_r", "mac_cyrillic"]
#: Of these, sequences of letters alone are parts of words as well; they say little by themselves.
_BY_CHANCE = ("cp866", "mac_cyrillic", "koi8_r")
LOST, UNSURE = "lost", "unsure"
#: Rounds of fitting.
ROUNDS = 3
#: Texts and characters a text of `sample_of`, which no query uses.
SAMPLE, SAMPLE_LENGTH = 4_000, 4_096

# Log probabilities the model starts from.
ENTER, LEAVE, SWAP = -4.0, -1.0, -5.0
CLEAN_PART, CLEAN_UNSURE, CLEAN_CHANCE, CLEAN_LOST, NEUTRAL, FOREIGN = -3.2, -0.9, -0.3, -9.0, -0.15, -6.0

_TYPOGRAPHIC = "“”„‘’‚…–—«»‹›°·•™®©§¶†‡€£¥¿¡ºª№ёЁ ¼½¾²³¹÷×"


@lru_cache
def _table(codec: str) -> tuple[dict[str, int], list[str]]:
    """char -> byte and byte -> char of the upper half; bytes the encoding leaves free pass as control characters."""
    chars = []
    for b in range(128, 256):
        try:
            chars.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            chars.append(chr(b))
    back = {c: 128 + i for i, c in enumerate(chars)}
    if codec == "cp1252":  # Latin-1 is read the same but for its control characters
        back |= {chr(b): b for b in range(128, 160)}
    return back, chars


def _class(codec: str, a: int, b: int) -> str:
    back, _ = _table(codec)
    return "[" + "".join(regex.escape(c) for c, v in back.items() if a <= v <= b) + "]"


@lru_cache
def _utf8(codec: str) -> regex.Pattern:
    c = lambda a, b: _class(codec, a, b)
    t = c(0x80, 0xBF)
    return regex.compile(
        f"{c(0xF0, 0xF0)}{c(0x90, 0xBF)}{t}{t}|{c(0xF1, 0xF3)}{t}{t}{t}|{c(0xE0, 0xE0)}{c(0xA0, 0xBF)}{t}|{c(0xE1, 0xEF)}{t}{t}|{c(0xC2, 0xDF)}{t}"
    )


def _plausible(ch: str) -> bool:
    """Characters that texts hold; scripts and marks that nobody types don't confirm a pair."""
    o = ord(ch)
    if o < 0x250:
        return o >= 0xA0 and (o < 0x180 or o in (0x192, 0x1A0, 0x1A1, 0x1AF, 0x1B0, 0x218, 0x219, 0x21A, 0x21B))
    if 0x370 <= o < 0x400:
        return 0x386 <= o <= 0x3CE
    if 0x400 <= o < 0x530:
        return 0x410 <= o <= 0x44F or o in (0x401, 0x451, 0x404, 0x454, 0x406, 0x456, 0x407, 0x457, 0x490, 0x491)
    if 0x600 <= o < 0x700:
        return 0x621 <= o <= 0x652 or o in (0x60C, 0x61B, 0x61F) or 0x660 <= o <= 0x669 or o in (0x67E, 0x686, 0x698, 0x6A9, 0x6AF, 0x6CC)
    if 0x590 <= o < 0x600:
        return 0x5D0 <= o <= 0x5EA
    if 0x900 <= o < 0x980 or 0xE00 <= o < 0xE80 or 0x1E00 <= o < 0x2000:
        return unicodedata.category(ch) != "Cn"
    if 0x2000 <= o < 0x2C00:
        return unicodedata.category(ch) not in ("Cn", "Co")
    if 0x3000 <= o < 0xA000 or 0xAC00 <= o < 0xD7A4 or 0xF900 <= o < 0xFB00 or 0xFE00 <= o < 0xFE10 or 0xFF00 <= o < 0xFFF0 or o == 0xFEFF:
        return unicodedata.category(ch) != "Cn"
    if 0x1F000 <= o < 0x1FB00 or 0xE0020 <= o < 0xE0080:
        return True
    return 0x300 <= o < 0x370


@lru_cache(maxsize=20_000)
def _decode_utf8(seq: str, codec: str) -> str | None:
    back, _ = _table(codec)
    try:
        ch = bytes(back[c] for c in seq).decode("utf-8")
    except UnicodeDecodeError:
        return None
    # text garbled twice holds control characters after the first inverse
    return ch if _plausible(ch) or (codec == "cp1252" and 0x80 <= ord(ch) < 0xA0) else None


_SEP = r"[ ,.!?«»…–—:;()0-9\-]{1,8}"
_DOUBLE = f"(?:{_class('cp1252', 0xA1, 0xF7)}{_class('cp1252', 0xA1, 0xFE)})"
_WEST = "[\xa0-\xffŠŽšžŒœŸƒ\x80-\x9f‚„…†‡ˆ‰‹‘’“”•–—˜™›€]"
#: Written in, read in: where such a pair's runs may be.
_RUNS = {
    # units of two bytes, of which the second may be ASCII
    ("cp932", "cp1252"): regex.compile(f"(?:{_class('cp1252', 0x81, 0x9F)}(?:[@-~]|{_class('cp1252', 0x80, 0xFC)})|{_class('cp1252', 0xE0, 0xEA)}(?:[@-~]|{_class('cp1252', 0x80, 0xFC)})){{2,}}"),
    ("euc_jp", "cp1252"): regex.compile(f"{_DOUBLE}{{2,}}"),
    ("gbk", "cp1252"): regex.compile(f"{_DOUBLE}{{2,}}"),
    ("euc_kr", "cp1252"): regex.compile(f"{_DOUBLE}{{2,}}"),
    ("big5", "cp1252"): regex.compile(f"(?:{_class('cp1252', 0xA1, 0xF9)}(?:[@-~]|{_class('cp1252', 0xA1, 0xFE)})){{2,}}"),
    ("cp1251", "cp1252"): regex.compile(rf"(?<!\p{{L}})[À-ÿ¨¸]{{3,}}(?:{_SEP}[À-ÿ¨¸]+)*(?!\p{{L}})|(?<!\p{{L}})[À-ÿ¨¸]{{1,2}}(?:{_SEP}[À-ÿ¨¸]+)+(?!\p{{L}})"),
    ("koi8_r", "cp1252"): regex.compile(rf"(?<!\p{{L}})[À-ÿ³£]{{3,}}(?:{_SEP}[À-ÿ³£]+)*(?!\p{{L}})|(?<!\p{{L}})[À-ÿ³£]{{1,2}}(?:{_SEP}[À-ÿ³£]+)+(?!\p{{L}})"),
    ("cp866", "cp1252"): regex.compile(rf"(?<![\p{{L}}]){_WEST}{{3,}}(?:{_SEP}{_WEST}+)*(?!\p{{L}})"),
    ("cp1253", "cp1252"): regex.compile(rf"(?<!\p{{L}})[À-þ¢¸-º¼¾¿]{{3,}}(?:{_SEP}[À-þ¢¸-º¼¾¿]+)*(?!\p{{L}})"),
    ("cp1255", "cp1252"): regex.compile(rf"(?<!\p{{L}})[à-ú]{{2,}}(?:{_SEP}[à-ú]+)*(?!\p{{L}})"),
    ("cp1256", "cp1252"): regex.compile(rf"[À-íðñòóõöøúŠŽœžŒ\x81\x8d\x8e\x8f\x90\x98\x9a]{{3,}}(?:[ ¿¡º.!0-9]{{1,6}}[À-íðñòóõöøúŠŽœžŒ\x81\x8d\x8e\x8f\x90\x98\x9a]{{2,}})*"),
    ("cp874", "cp1252"): regex.compile(r"[¡-ÚÜ-û]{5,}"),
    ("cp1250", "cp1252"): regex.compile(r"(?<![\p{L}¿³¹¶¼])[a-zA-ZÀ-ÿ]*[a-zà-ÿ][¿³¹¶¼¾][a-zA-ZÀ-ÿ¿³¹¶¼¾]*(?![\p{L}\d])"),
    ("iso8859_2", "cp1252"): regex.compile(r"(?<![\p{L}¿³±¶¼])[a-zA-ZÀ-ÿ]*[a-zà-ÿ][¿³±¶¼¾][a-zA-ZÀ-ÿ¿³±¶¼¾]*(?![\p{L}\d])"),
    ("koi8_r", "cp1251"): regex.compile(rf"(?<!\p{{L}})[а-яё][А-ЯЁ]{{2,}}(?:{_SEP}[А-Яа-яЁё]+)*(?!\p{{L}})|(?<!\p{{L}})[а-яЈё]{{4,}}(?:{_SEP}[а-яЈё]+)+(?!\p{{L}})"),
}
# Letters of the languages, from frequent to rare.
_LETTERS = {
    "Cyrillic": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфёъ", "Greek": "αοιετσνηυρπκμλςωγδχθάίόέήφβύώξζψϊϋΐΰ", "Hebrew": "יוהלאתרמבשנכדחעפקצסגטזםןךףץ",
    "Arabic": "اليمنوتربةعدسفهكقحجشطصخأضذءىثزغظئإؤآ", "Thai": "านรอกเงมยลวดทสตะปบคหแจพชขใไโผซถฟธณศษฐญภฉฎฏฑฒฌฆฬฮ",
}


@lru_cache
def _frequency(script: str) -> dict[str, float]:
    letters = _LETTERS[script]
    weight = [1.0 / (k + 3) for k in range(len(letters))]
    return {c: log(w / sum(weight)) for c, w in zip(letters, weight, strict=True)}


def _like(out: str, script: str) -> float | None:
    """Mean log frequency of the letters of a text in one script; nothing if others are among them."""
    table = _frequency(script)
    letters = [c for c in out.lower() if c.isalpha()]
    if not letters or any(c not in table and not 0xE30 <= ord(c) < 0xE5C for c in letters):
        return None
    return sum(table.get(c, -5.0) for c in letters) / len(letters)


_KANA = range(0x3041, 0x3100)


# Thai vowels and marks stand at consonants
_THAI = regex.compile(r"(?:[เแโใไ]?[ก-ฮ][\u0e30-\u0e3a\u0e45\u0e47-\u0e4e]*|[ฯๆ๐-๙฿])+")


def _invert(seq: str, written: str, read: str) -> tuple[str, bool] | None:
    """(what the run was, whether that is unsure), or nothing if the pair can't have written it."""
    if read == "cp1252" and not _utf8(read).sub("", seq):
        return None  # UTF-8 explains all of it
    back, _ = _table(read)
    try:
        raw = bytes(back[c] if c in back else ord(c) for c in seq)
        out = raw.decode(written)
    except (UnicodeDecodeError, ValueError):
        return None
    letters = [c for c in out if not c.isascii()]
    n = len(letters)
    if not n:
        return None
    east = all(0x3000 <= ord(c) < 0xA000 or 0xFF00 <= ord(c) < 0xFFA0 or c in "…“”‘’" for c in letters)
    kana = sum(ord(c) in _KANA for c in letters)
    if written in ("cp932", "euc_jp"):
        return (out, False) if east and kana >= 0.2 * n and n >= 2 else None
    if written == "gbk":
        common = sum(0xB0 <= b <= 0xD7 for b in raw[::2])
        marks = sum(c in "，。！？：；、“”" for c in letters)
        return (out, n < 3) if east and not kana and common + marks >= 0.9 * n and n >= 2 else None
    if written == "euc_kr":
        return (out, n < 4) if all(0xAC00 <= ord(c) < 0xD7A4 or 0x3000 <= ord(c) < 0x3020 for c in letters) and n >= 2 else None
    if written == "big5":
        common = sum(0xA4 <= b <= 0xC6 for b in raw[::2])
        return (out, True) if east and not kana and common >= 0.9 * n and n >= 4 else None
    if written in ("cp1250", "iso8859_2"):
        polish = sum(c in "ąćęłńóśźżĄĆĘŁŃÓŚŹŻčďěňřšťůžľ" for c in out)
        return (out, False) if out.isalpha() and polish and all(c in "ąćęłńóśźżĄĆĘŁŃÓŚŹŻčďěňřšťůžľáéíýúôäöü" for c in letters) else None
    script = {"cp874": "Thai", "cp1256": "Arabic", "cp1253": "Greek", "cp1255": "Hebrew"}.get(written, "Cyrillic")
    if script == "Arabic":
        arabic = sum(0x621 <= ord(c) <= 0x652 for c in letters)
        if arabic + sum(c in "؟،؛" for c in letters) != n:
            return None
    elif script == "Thai" and not _THAI.fullmatch("".join(letters)):
        return None
    words = regex.findall(r"[\p{L}\p{M}]+", out)
    n = sum(map(len, words))
    if script == "Hebrew":
        finals = any(c in "ךםןףץ" for w in words for c in w[:-1])
        if finals or any(not 0x5D0 <= ord(c) <= 0x5EA for w in words for c in w) or n < 4:
            return None
    if script in ("Cyrillic", "Greek"):
        if any(not (c.lower() in _frequency(script) or c in "«»“”„—–…№’") for c in letters):
            return None
        shaped = all(w[1:].islower() or w.isupper() or len(w) == 1 for w in words)
        vowels = sum(c in "аеёиоуыэюяαεηιουωάέήίόύώϊϋ" for w in words for c in w.lower())
        if not shaped or n < 4 or not 0.25 <= vowels / n <= 0.7 or any("ς" in w[:-1] for w in words):
            return None
    like = _like(out, script)
    if like is None:
        return (out, n < 5) if script == "Arabic" else None
    # text of another encoding gives letters without regard to how frequent they are
    if script in ("Cyrillic", "Greek", "Hebrew") and like < sum(_frequency(script).values()) / len(_frequency(script)) + 0.25:
        return None
    if read == "cp1251" and seq.islower():
        plain = _like(seq, "Cyrillic")
        return (out, False) if plain is not None and n >= 8 and like > plain + 0.4 else None
    return out, script == "Arabic" and n < 5


class Unit:
    """A stretch that a state may have written: its place, its state, what it was, and how sure that is."""

    __slots__ = ("start", "end", "state", "was", "unsure", "chance")

    def __init__(self, start: int, end: int, state: str, was: str, unsure: bool, chance: bool = False):
        self.start, self.end, self.state, self.was, self.unsure, self.chance = start, end, state, was, unsure, chance


def _drawn(text: str, a: int, b: int) -> bool:
    """Whether the characters are lines of a drawing: box characters that touch no letter."""
    if not all(0x2500 <= ord(c) < 0x2580 for c in text[a:b]):
        return False
    around = text[max(0, a - 1) : a] + text[b : b + 1]
    return not any(c.isalpha() for c in around)


@lru_cache
def _leads(codec: str) -> frozenset[str]:
    return frozenset(c for c, b in _table(codec)[0].items() if 0xC2 <= b <= 0xF4)


def _units(text: str) -> Iterator[Unit]:
    signs = set(text)
    for codec in READ_AS:
        if signs.isdisjoint(_leads(codec)):
            continue
        for m in _utf8(codec).finditer(text):
            was = _decode_utf8(m[0], codec)
            if was is not None:
                unsure = all(c in _TYPOGRAPHIC for c in m[0][1:]) and (m[0][0].isalpha() or m[0][0] in _TYPOGRAPHIC) and not (m[0][0] in "ÃÂâ" and codec in ("cp1252", "cp1250", "iso8859_15", "cp1254"))
                unsure = unsure or m[0][0] in "–—“”‘’«»…„" or _drawn(text, m.start(), m.end())
                yield Unit(m.start(), m.end(), f"utf_8>{codec}", was, unsure, unsure and m[0].isalpha() or codec in _BY_CHANCE and (unsure or m[0].isalpha()))
    runs = [Unit(m.start(), m.end(), f"{written}>{read}", *was) for (written, read), rx in _RUNS.items() for m in rx.finditer(text) if (was := _invert(m[0], written, read)) is not None]
    for u in runs:
        rivals = [v for v in runs if v.start < u.end and u.start < v.end and v.was != u.was]
        # of several explanations of single bytes the longest or, of about one length, the one of the more frequent
        # letters by a margin; none where there is no such margin
        size, mine = u.end - u.start, _evidence(u)
        long = [v for v in rivals if 2 * (v.end - v.start) > 3 * size]
        like = [v for v in rivals if 3 * (v.end - v.start) >= 2 * size and v not in long]
        if long or any(_evidence(v) > mine or (_evidence(v) == mine and v.state < u.state) for v in like):
            continue
        if any(_evidence(v) > mine - 2.0 / size for v in like):
            u.state, u.was = UNSURE, text[u.start : u.end]
        yield u
    for m in regex.finditer("�+", text):
        yield Unit(m.start(), m.end(), LOST, m[0], False)


def _evidence(u: Unit) -> float:
    """How well what a run was fits its script: by frequencies of letters, beside the best that a script allows."""
    script = next((x for x in _LETTERS if (like := _like(u.was, x)) is not None), None)
    if script:
        return like - max(_frequency(script).values())
    return -2.0 if regex.search(r"\p{Arabic}", u.was) else -0.5 - 0.5 * u.unsure


@lru_cache(maxsize=50_000)
def _kind(c: str) -> str:
    """The class of a character: its kind and, of letters, its script and case."""
    if c.isascii():
        return "a" if c.isalpha() else " " if c.isspace() else "."
    o, kind = ord(c), unicodedata.category(c)
    block = "w" if o < 0x250 else "g" if 0x370 <= o < 0x400 else "c" if 0x400 <= o < 0x530 else "h" if 0x590 <= o < 0x600 else "r" if 0x600 <= o < 0x780 else "d" if 0x900 <= o < 0x980 else "t" if 0xE00 <= o < 0xE80 else "j" if 0x3041 <= o < 0x3100 else "e" if 0x3400 <= o < 0xA000 else "k" if 0xAC00 <= o < 0xD7A4 else "p" if o < 0x2C00 else "o"
    return block + (kind if kind[0] == "L" else kind[0])


class Model:
    """Emissions of clean text, each character by the class of the one before it, and transitions between states."""

    def __init__(self) -> None:
        self.pairs: Counter = Counter()
        self.before: Counter = Counter()
        self.single: Counter = Counter()
        self.kinds: Counter = Counter()
        self.total = 0
        self.enter, self.leave, self.swap = ENTER, LEAVE, SWAP

    def add(self, last: str, c: str, n: int = 1) -> None:
        """Count n characters behind characters of the class `last`."""
        self.pairs[last, c] += n
        self.before[last] += n
        self.single[c] += n
        self.kinds[_kind(c)] += n
        self.total += n

    def move(self, steps: Counter, places: int) -> None:
        """Take the transitions over from the steps of paths through so many non-ASCII characters.

        They stay within a factor of e^3 of the fixed values, so that texts without garbled ones don't rule them out.
        """
        bound = lambda x, at: min(at + 3.0, max(at - 3.0, log(x)))
        apart, inside = 1.0 + steps["apart"], 2.0 + steps["units"]
        self.enter, self.leave, self.swap = bound(apart / (2.0 + places), ENTER), bound(min(1.0, apart / inside), LEAVE), bound((1.0 + steps["swap"]) / inside, SWAP)

    def score(self, text: str, last: str) -> float:
        """Log probability of a text behind a character of the class `last`; rarer ones fall back on their class."""
        out = 0.0
        for c in text:
            kind = _kind(c)
            size = 20_000 if kind[0] in "ek" else 100
            alone = 0.9 * self.single[c] / self.total + 0.1 * (self.kinds[kind] + 0.5) / (self.total + 100) / size
            out += log((self.pairs[last, c] + 5 * alone) / (self.before[last] + 5))
            last = kind
        return out

    def gain(self, text: str, u: Unit) -> float:
        """How much likelier a unit is as what it was than as it stands."""
        last = _kind(text[u.start - 1]) if u.start else " "
        return self.score(u.was, last) - self.score(text[u.start : u.end], last)


#: Characters that are counted at once.
_PIECE = 1 << 20
_NO_KIND = 255
#: The classes of characters met so far by number, and the number of every character's class once it is asked for.
_NAMES: list[str] = []
_NUMBERS: dict[str, int] = {}
_KIND_OF = np.full(0x110000, _NO_KIND, np.uint8)


def _numbers(cps: np.ndarray) -> np.ndarray:
    """The numbers of the classes of characters."""
    out = _KIND_OF[cps]
    if (out == _NO_KIND).any():
        for c in np.unique(cps[out == _NO_KIND]).tolist():
            name = _kind(chr(c))
            if name not in _NUMBERS:
                _NUMBERS[name] = len(_NAMES)
                _NAMES.append(name)
            _KIND_OF[c] = _NUMBERS[name]
        out = _KIND_OF[cps]
    return out


def _pieces(texts: Iterable[str | None]) -> Iterator[tuple[str, list[int]]]:
    """(joined pieces, where their contexts are): a character before each piece is context, a break at a text's start."""
    parts, at, size = [], [], 0
    for t in texts:
        for i in range(0, len(t or ""), _PIECE):
            at.append(size)
            parts += [t[i - 1] if i else "\n", t[i : i + _PIECE]]
            size += 1 + len(parts[-1])
            if size >= _PIECE:
                yield "".join(parts), at
                parts, at, size = [], [], 0
    if parts:
        yield "".join(parts), at


def count_chars(texts: Iterable[str | None], into: Counter | None = None) -> Counter:
    """How often each character stands behind each class of characters, (class, code point): all characters of all texts."""
    out = Counter() if into is None else into
    for joined, at in _pieces(texts):
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        counted = np.ones(len(cps), bool)
        counted[at] = False
        last, cps = _numbers(cps)[:-1][counted[1:]], cps[counted]
        low = cps < 128
        n = np.bincount(last[low].astype(np.int64) << 7 | cps[low])
        here = [(k >> 7, k & 127, n[k]) for k in np.flatnonzero(n).tolist()]
        keys, n = np.unique(last[~low].astype(np.int64) << 21 | cps[~low], return_counts=True)
        here += [(k >> 21, k & 0x1FFFFF, m) for k, m in zip(keys.tolist(), n.tolist(), strict=True)]
        for kind, c, m in here:
            out[_NAMES[kind], c] += int(m)
    return out


def follow(text: str, model: Model | None, steps: Counter) -> str:
    """The text restored; the units of its path, those apart from the one before and those that swap states are counted."""
    units: list[Unit] = []
    out = restore(text, model, units)[0]
    last: Unit | None = None
    for u in units:
        touching = last is not None and u.start - last.end <= 3
        steps["units"] += 1
        steps["apart"] += not touching
        steps["swap"] += touching and u.state != last.state
        last = u
    return out


def _model(counts: Counter, steps: Counter, places: int) -> Model:
    new = Model()
    for (last, c), n in counts.items():
        if n:
            new.add(last, chr(c), n)
    new.move(steps, places)
    return new


def fit(sample: Iterable[str | None], rounds: int = ROUNDS) -> Model | None:
    """A model fitted to texts at hand, garbled ones among them; nothing if they have no characters.

    Each round labels the texts by the model of the round before, first by the fixed values, and counts the characters
    of the restored texts and the transitions of the paths.
    """
    texts = [t for t in sample if t]
    places = sum(not c.isascii() for t in texts for c in t)
    model: Model | None = None
    for _ in range(rounds if texts else 0):
        steps: Counter = Counter()
        model = _model(count_chars([follow(t, model, steps) for t in texts]), steps, places)
    return model


def label(text: str | None, model: Model | None = None) -> list[Unit]:
    """The units on the likeliest path that isn't clean, in order.

    The path is followed over units and the characters between them: a state emits its own units at no cost and other
    characters at NEUTRAL each. Clean text emits the characters of a unit at CLEAN_PART or, where they may well stand
    together in clean text, at CLEAN_UNSURE; with a model, at what they are less likely than what the unit was.
    """
    if not text or text.isascii():
        return []
    units = sorted(_units(text), key=lambda u: (u.start, u.end))
    if not units:
        return []
    enter, leave, swap = (model.enter, model.leave, model.swap) if model else (ENTER, LEAVE, SWAP)
    part = [0.0] * len(text)
    for u in units:
        cost = CLEAN_LOST if u.state == LOST else CLEAN_CHANCE if u.chance else CLEAN_UNSURE if u.unsure else CLEAN_PART
        if model and u.state not in (LOST, UNSURE) and not u.chance:
            gain = model.gain(text, u) / (u.end - u.start)
            # strong evidence settles what looks unsure; where the text as it stands is likelier, nothing is sure
            cost = min(cost, -gain) if not u.unsure or gain > 2.5 else cost
            if gain < -1.0:
                cost = max(cost, CLEAN_UNSURE)
        for i in range(u.start, u.end):
            part[i] = min(part[i], cost)
    total = [0.0]
    for x in part:
        total.append(total[-1] + x)
    n = len(text)
    bounds = sorted({0, n, *(u.start for u in units), *(u.end for u in units)})
    starts: dict[int, list[Unit]] = {}
    for u in units:
        starts.setdefault(u.start, []).append(u)
    # score and path (a linked list) of each state at each bound
    table: dict[int, dict[str, tuple[float, tuple | None]]] = {b: {} for b in bounds}
    table[0]["clean"] = (0.0, None)

    def offer(at: int, state: str, score: float, path: tuple | None) -> None:
        old = table[at].get(state)
        if old is None or score > old[0]:
            table[at][state] = (score, path)

    for k, b in enumerate(bounds):
        for s, (score, path) in list(table[b].items()):
            if s != "clean":
                offer(b, "clean", score + leave, path)
        here = table[b]
        for u in starts.get(b, ()):
            for s, (score, path) in here.items():
                offer(u.end, u.state, score + (0.0 if s == u.state else enter if s == "clean" else swap), (path, u))
        if k + 1 < len(bounds):
            c = bounds[k + 1]
            plain = sum(NEUTRAL if ch.isascii() else FOREIGN for ch in text[b:c])
            for s, (score, path) in here.items():
                offer(c, s, score + (total[c] - total[b] if s == "clean" else plain), path)
    path, out = table[n]["clean"][1], []
    while path is not None:
        path, u = path
        out.append(u)
    return out[::-1]


def restore(text: str | None, model: Model | None = None, path: list[Unit] | None = None) -> tuple[str | None, list[str]]:
    """(text as first written where the characters allow it, states seen in order of the rounds).

    The units of the first round are added to `path`.

    Rounds go on until nothing new is labelled. Inverse transforms of UTF-8 make the text shorter, and each other
    state is followed once, so that there is an end.
    """
    seen: list[str] = []
    while True:
        units = label(text, model)
        if path is not None and not seen:
            path += units
        states = list(dict.fromkeys(u.state for u in units))
        again = any(s not in seen or s.startswith("utf_8") for s in states)
        seen += [s for s in states if s not in seen]
        if not again or all(u.state in (LOST, UNSURE) for u in units):
            return text, seen
        out, at = [], 0
        for u in units:
            out += [text[at : u.start], u.was]
            at = u.end
        text = "".join([*out, text[at:]])


def _java(chars: str) -> str:
    """The characters as the inside of a class, neighbours as ranges."""
    out: list[list[int]] = []
    for o in sorted({ord(c) for c in chars}):
        if out and out[-1][1] == o - 1:
            out[-1][1] = o
        else:
            out.append([o, o])
    return "".join(f"\\x{{{a:x}}}" + (f"-\\x{{{b:x}}}" if b > a else "") for a, b in out)


def gate(text: Column) -> Column:
    """Whether a text can hold garbled characters: some first byte with a second, a run, or a replacement character."""
    pairs = []
    for codec in READ_AS:
        back, _ = _table(codec)
        lead = "".join(c for c, b in back.items() if 0xC2 <= b <= 0xF4)
        trail = "".join(c for c, b in back.items() if 0x80 <= b <= 0xBF)
        pairs.append(f"[{_java(lead)}][{_java(trail)}]")
    sjis = "".join(c for c, b in _table("cp1252")[0].items() if 0x81 <= b <= 0x9F or 0xE0 <= b <= 0xEA)
    sjis_units = f"(?:[{_java(sjis)}][\\x{{40}}-\\x{{7e}}\\x{{80}}-\\x{{ff}}{_java(''.join(_table('cp1252')[1]))}]){{2}}"
    # single-byte runs: western letters without an ASCII letter beside them, or Cyrillic with the case turned round
    runs = f"[À-ÿ¨¸]{{3}}|[\\x{{80}}-\\x{{ff}}{_java(''.join(_table('cp1252')[1]))}]{{3}}|[à-ú]{{2}}|(?<=[a-zà-ÿ])[¿³¹±¶¼¾]|[а-яё]{{4}}.*[\\x{{462}}-\\x{{fff}}ъфцщ]|(?<!\\p{{L}})[À-ÿ¨¸]{{1,2}}[^\\p{{L}}]{{1,8}}[À-ÿ¨¸]|[а-яё][А-ЯЁ]{{2}}|[А-ЯЁ]{{3}}|[\\x{{a1}}-\\x{{ff}}]{{3}}|\\x{{fffd}}|{sjis_units}"
    # all of them begin with a character that isn't ASCII
    return text.rlike("[^\\x00-\\x7f]") & text.rlike(f"(?=[^\\x00-\\x7f])(?:{'|'.join([*pairs, runs])})")


def sample_of(df: DataFrame, text: str, size: int = SAMPLE) -> list[str]:
    """At most `size` texts with other than ASCII characters, of SAMPLE_LENGTH characters at most, by the least hashes.

    For a look at texts, or `fit` by hand: `find_garbled` fits its model on all texts.
    """
    t = df.select(F.col(text).alias("_t")).where(F.col("_t").rlike(r"[^\x00-\x7f]") & (F.length("_t") <= SAMPLE_LENGTH))
    return [r["_t"] for r in t.orderBy(F.xxhash64("_t"), "_t").limit(size).collect()]


_COUNTS = "kind string, c int, n bigint"


def _totals(df: DataFrame) -> list[Row]:
    """The sums of partial counts: at most one row for each class and character that there are, whatever the input."""
    return df.groupBy("kind", "c").agg(F.sum("n").alias("n")).collect()


def _batch(counts: Counter, steps: Counter) -> pa.RecordBatch:
    """Counts of characters and, without a character, of steps."""
    rows = [(k, c, n) for (k, c), n in counts.items()] + [(k, None, n) for k, n in steps.items()]
    kinds, cs, ns = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(cs, pa.int32()), pa.array(ns, pa.int64())], names=["kind", "c", "n"])


def count_all(texts: DataFrame) -> Counter:
    """`count_chars` over all rows of a table of one column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            count_chars(batch.column(0).to_pylist(), counts)
        yield _batch(counts, Counter())

    return Counter({(r["kind"], r["c"]): r["n"] for r in _totals(texts.mapInArrow(run, _COUNTS))})


def fit_all(every: DataFrame, gated: DataFrame, rounds: int = ROUNDS) -> Model | None:
    """The model that `fit` gives for all texts of `every`, one column each; `gated` holds those of them that pass the gate.

    The others are clean in each round, so their characters are counted once. Each round is a pass over `gated`, and
    sums of whole numbers come back, the same however the rows are spread. An empty table gives no model.
    """
    session = every.sparkSession
    counts = count_all(every)
    if not counts:
        return None
    places = sum(n for (_, c), n in counts.items() if c > 127)
    counts.subtract(count_all(gated))
    model: Model | None = None
    for _ in range(rounds):
        shared = session.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            found: Counter = Counter()
            steps: Counter = Counter()
            for batch in batches:
                count_chars((follow(t, shared.value, steps) for t in batch.column(0).to_pylist()), found)
            yield _batch(found, steps)

        found, steps = Counter(counts), Counter()
        for r in _totals(gated.mapInArrow(run, _COUNTS)):
            if r["c"] is None:
                steps[r["kind"]] += r["n"]
            else:
                found[r["kind"], r["c"]] += r["n"]
        shared.unpersist()
        model = _model(found, steps, places)
    return model


def find_garbled(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, restored, states) of every row whose text was, or holds a piece that was, decoded with a wrong encoding.

    Null, empty and pure ASCII texts are no case. What can't be restored stays as it is in `restored`. Repeated rows
    come out as often as given; other columns play no part; an empty table gives no rows. The model is fitted on the
    texts of all rows (`fit_all`). The rows that pass the gate are written once and read by its rounds and the last
    pass; counts alone are shuffled.
    """
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key), F.col(text).alias("_t"))
    with scratch(df.sparkSession) as kept:
        gated = cut(spread(rows.where(gate(F.col("_t"))), key))
        kept.append(gated)
    gated = spread(gated, key)
    model = fit_all(rows.where(F.length("_t") > 0).select("_t"), gated.select("_t"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # counts of characters by class: bounded by the alphabet

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts, states = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                fixed, seen = restore(t, shared.value)
                if seen:
                    at.append(i)
                    texts.append(fixed)
                    states.append(seen)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(texts, pa.string()), pa.array(states, pa.list_(pa.string()))], names=[key, "restored", "states"])

    return gated.mapInArrow(run, f"`{key}` {kind}, restored string, states array<string>")
