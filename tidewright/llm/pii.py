"""Problem 2: personal data inside free text, found and replaced by typed placeholders.

Regular expressions propose spans, checksum validators (Luhn, mod 97, Verhoeff, mod 23) confirm or refute them, and
words nearby move the score of a span up or down; spans of score 1 or more are kept, and where spans overlap the one
of the higher score, then the longer one. Names are scored by classes of words before and behind them, by their shape
and by whether their parts are common words. A gate of JVM regular expressions, each a necessary condition of a kind of
span, keeps texts that can't hold any out of Python; the rest is worked on in Arrow batches in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import spread

# Words of streets, of which the first group is also common in other uses.
_COMMON_STREET = "drive dr close court ct crescent cres way place pl square sq terrace gardens grove hill row walk mews parade lane ln".split()
_STREET = "street st road rd avenue ave boulevard blvd".split()
_ROMANCE = "rue avenue av\\.? boulevard chemin allée impasse quai calle avenida avda\\.? plaza paseo rua travessa largo via viale piazza corso c/".split()
_GERMAN = "straße strasse str\\. weg platz allee gasse ring ufer damm".split()
# Words that are no part of a street's or a person's name.
_NO_NAME = frozenset(
    "a an the this that these those my our your his her its their me you he she it we they i i'm am is are was were be been not no yes do does did done has have had will would can could should may might must shall to of in on at by for from with without into over under past along across away before after during until since while when where why what who which how and or but so if then than as more most less any some all both each every other another same only just still again also too very please thanks thank help hello hi dear days day hours hour weeks week months month minutes minute years year euros euro pounds dollars percent pieces tries times people photos screws kilos grams stops items orders order parcel customer support team agent desk works working work waiting fed up close lost sorry sad sure glad afraid here there now today tomorrow yesterday tonight monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december will let one two three four five six seven eight nine ten first last next new old good great nice bad happy angry more going getting having being tired unhappy disappointed about ok okay und der die das ein eine nicht ist ich sie wir et le la les un une pas est je vous nous y el los las una no es que o os um uma não é de du des del do da courier driver parcel shop depot hub firm office locker company night shift partner carrier local freight delivery counter pickup van item voucher model tracking version card account open claims".split()
)

_TOK = r"\p{L}(?:[\p{L}\p{M}]|['’\-](?=\p{L}))*[\p{L}\p{M}]"
# Small words inside names.
_PARTICLE = r"(?:de|del|de la|de los|da|das|do|dos|di|van|van der|van den|von|von der|zu|ter|ten|bin|ibn|al|el|la|le|y|e)"
_PAIR = rf"(?:{_TOK},\s{{1,2}}{_TOK}|{_TOK}\s{{1,2}}(?:\p{{L}}\.\s?)?(?:{_PARTICLE}\s)?{_TOK})(?![\p{{L}}\p{{N}}@_])"
_MORE = regex.compile(rf"\s(?:(?i:{_PARTICLE})\s)?(?P<w>\p{{Lu}}(?:[\p{{L}}\p{{M}}]|['’\-](?=\p{{L}}))*[\p{{L}}\p{{M}}])(?![\p{{L}}\p{{N}}@_])")

# What stands before a name, in small letters, by class. The first names a person by itself.
_SAYS_NAME = (
    "my name is|the name is|name's|name’s|names|name|account is under|in the name of|under the name|under the name of|registered to|made out to|belong to|belongs to|addressed to|label say|label says|label reads|attn|attention of"
    "|mein name ist|ich heiße|ich heisse|je m'appelle|je m’appelle|mon nom est|me llamo|mi nombre es|meu nome é|meu nome e|chamo-me|mi chiamo|mijn naam is"
    "|mr|mrs|ms|miss|herr|herrn|frau|sr|sra|monsieur|madame|mme|dona"
).split("|")
# what a person did with something, and who a person is to somebody
_OF_PERSON = (
    "signed by|signed for by|taken by|accepted by|received by|collected by|picked up by|handed to|given to|left with|left it with|ask for|asked for|spoke to|spoke with|speak to|speak with|talked to|talked with|met"
    "|colleague|neighbour|neighbor|husband|wife|mother|father|sister|brother|son|daughter|friend|flatmate|roommate|landlord|manager|supervisor|boss|assistant|kollege|kollegin|nachbar|nachbarin|voisin|voisine|collègue|vecino|vecina|vizinho|vizinha"
).split("|")
_SELF = "i'm|i’m|im|i am|this is|ich bin|hier ist|je suis|soy|sou".split("|")
_MAY_BE = "who is|dear|call|called".split("|")
_BEFORE_OTHER = "меня зовут|私は|اسمي|मेरा नाम|ชื่อ".split("|")
_SIGN_OFF = "thanks|thank you|regards|best|cheers|sincerely|cordialement|saludos|grüße|grüsse|gruss|gruß".split("|")
# Frequent Chinese family names, and what a name is given with.
_HAN_FAMILY = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文欧阳"
_HAN_LEAD = "我叫|名字是|名字叫|姓名"
# Endings that words have and names seldom; names in small letters may not have them.
_WORDY = regex.compile(r"(?:ing|ed|ly|ous|ful|able|ible|ive|tion|sion|ness|ment|less|ish|est|ity)$")


def _trie(phrases: list[str]) -> str:
    """A regular expression of the phrases in which common beginnings are tried once; any white space matches a blank."""
    heads: dict[str, list[str]] = {}
    for p in phrases:
        heads.setdefault(p[:1], []).append(p[1:])
    parts = []
    for c in sorted(heads, reverse=True):
        if c:
            parts.append((r"\s" if c == " " else regex.escape(c, literal_spaces=True)) + _trie(heads[c]))
    if "" in heads:
        parts.append("")
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


# How a sentence goes on behind a name: of somebody who introduces oneself, and of somebody else.
_SELF_ON = r"(?:and (?:i|we|my)\b|again\b|here\b|hier\b|ici\b|aquí\b|speaking\b|writing\b|is my name)"
_DOES = "said says told tells promised called calls wrote writes signed answered asked refused took accepted confirmed claimed claims explained replied insisted lives works sagte fragte schrieb versprach dijo disse".split()
_OTHER_ON = rf"(?:and (?:why|how|what|who|where|when|did|does|said|told)\b|instead\b|next door\b|at (?:the|your|our|number)\b|(?:from|in) (?:the|your|our)\b|,? (?:no idea|whoever|who)\b|(?:{'|'.join(_DOES)})\b)"
_LEFT = r"(?<![\p{L}\p{N}])"
_NAME_STRONG = regex.compile(rf"(?:{_LEFT}{_trie(_SAYS_NAME)}|{'|'.join(_BEFORE_OTHER)})\.?[\s:]{{1,3}}(?P<n>{_PAIR})", regex.I)
_NAME_WEAK = regex.compile(rf"{_LEFT}(?:(?P<off>{_trie(_SIGN_OFF)}(?:,|(?=\s*\n)))|(?P<of>{_trie(_OF_PERSON)})|(?P<self>{_trie(_SELF)})|{_trie(_MAY_BE)})[\s:]{{1,3}}(?:(?:mr|mrs|ms|miss|dr)\.?\s)?(?P<n>{_PAIR})", regex.I)
# somebody who gives the name first, and a name that a sentence begins with or that an address follows
_HERE = r"(?:here,? (?:still|again|and)|speaking|is my name)"
_NAME_AFTER = regex.compile(rf"(?<![\p{{L}}\p{{N}}@#_.'’\-])(?P<n>{_PAIR})(?=\s*{_HERE}(?![\p{{L}}\p{{N}}]))", regex.I)
_TITLED = r"\p{Lu}[\p{L}\p{M}'’\-]+"
_NAME_DOES = regex.compile(rf"(?:^|[.!?…\n]\s*+)(?P<n>{_TITLED}\s{_TITLED})\s(?:{'|'.join(_DOES)})\b")
_NAME_TO = regex.compile(rf"{_LEFT}(?:to|for|c/o)\s(?P<n>{_TITLED}\s{_TITLED}),\s\d{{1,4}}\p{{L}}?,?\s\p{{L}}")
_NAME_HAN = regex.compile(rf"(?:{_HAN_LEAD})[:： ]?(?P<n>[{_HAN_FAMILY}]\p{{Han}}{{1,2}})(?!\p{{Han}})")
_HAS_BEFORE = regex.compile(rf"{_LEFT}(?:{_trie(_SAYS_NAME + _OF_PERSON + _SELF + _MAY_BE)}\.?[\s:]|{_trie(_SIGN_OFF)}[\s,])")
_HAS_OTHER = regex.compile("|".join([*_BEFORE_OTHER, _HAN_LEAD]))
_HAS_HERE = regex.compile(rf"\s{_HERE}(?![\p{{L}}\p{{N}}])")
_HAS_TITLED = regex.compile(rf"{_TITLED}\s{_TITLED}(?:\s{_trie(_DOES)}\b|,\s\d)")
_SIX = regex.compile(r"(?<![@\d])\d(?:[ ().\-/]{0,3}\d){5}")
_ADDRESS_HINT = regex.compile(rf"\d[A-Za-z]?,?\s+(?:\p{{L}}[\p{{L}}\p{{M}}'’\-]*\.?\s+){{1,3}}{_trie(_STREET + _COMMON_STREET)}\b|\d\s?(?:bis|ter|[a-z])?,?\s+{_trie('rue avenue boulevard chemin allée impasse quai cours'.split())}\s|\s(?=\s?\d)(?<=(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|ufer|damm)\s)|{_LEFT}{_trie('calle avenida avda. plaza paseo rua travessa largo via viale piazza corso'.split())}\s")
_AT_HINT = regex.compile(r"[^\s]@|@\s|[(\[{<]\s?(?:at|@|arroba|ät|chez)\s?[)\]}>]|\s(?:at|arroba|ät)\s\S+(?:\s(?:dot|punkt|punto|point|ponto)\s|\.[a-z])")
_SELF_RE, _OTHER_RE = regex.compile(rf"\s*{_SELF_ON}", regex.I), regex.compile(rf"\s*{_OTHER_ON}|,? {_OTHER_ON}", regex.I)
_STOP_END = regex.compile(r"[.!]|\s*$|\n|\s{2}")
_END = regex.compile(r"\s*(?:[.!?,;:)\n]|$|\p{So}|\s{2}|\p{Lu})")

_HOST = r"[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"
_LOCAL = r"[\p{L}\p{N}](?:[\p{L}\p{N}_.+%'\-]*[\p{L}\p{N}_+\-])?"
_AT = r"(?:\s?[\(\[\{<]\s?(?:at|@|arroba|ät|chez)\s?[\)\]\}>]\s?)"
_DOT = r"(?:\s?[\(\[\{<]\s?(?:dot|punkt|punto|point|ponto|\.)\s?[\)\]\}>]\s?|\.)"
EMAILS = [
    regex.compile(rf"(?<![\p{{L}}\p{{N}}_.+%\-/@]){_LOCAL}@{_HOST}", regex.I),
    regex.compile(rf"(?<![\p{{L}}\p{{N}}_.+%\-/@]){_LOCAL}\s{{1,2}}@\s{{1,2}}{_HOST}", regex.I),
    regex.compile(rf"(?<![\p{{L}}\p{{N}}_.+%\-/@]){_LOCAL}{_AT}[\p{{L}}\p{{N}}-]+(?:{_DOT}[\p{{L}}\p{{N}}-]+)+", regex.I),
    regex.compile(rf"(?<![\p{{L}}\p{{N}}_.+%\-/@])[\p{{L}}\p{{N}}_+\-]+(?:\s(?:dot|punkt|punto|point|ponto)\s[\p{{L}}\p{{N}}_+\-]+)*\s(?:at|arroba|ät)\s[\p{{L}}\p{{N}}-]+(?:\s(?:dot|punkt|punto|point|ponto)\s[\p{{L}}\p{{N}}-]+)+", regex.I),
    regex.compile(rf"(?<![\p{{L}}\p{{N}}_.+%\-/@]){_LOCAL}\s(?:at|arroba)\s[\p{{L}}\p{{N}}-]+\.(?:com|org|net|info|example|invalid|test|[a-z]{{2}})\b", regex.I),
]

_S = r"[ .\-/ ]"
_EDGE = r"(?<![\p{L}\p{N}_#+.,:/\-]|[.,]\d)"
_FAR = r"(?![\p{L}\p{N}_]|[-.,/:]\d)"
#: Shape, score by itself. A shape of score 0 needs a phone word nearby.
PHONES = [
    (regex.compile(rf"(?<![\p{{L}}\p{{N}}_#+.,:/\-])(?:\+|00)\d{{1,3}}(?:{_S}?\(0\))?(?:{_S}?\(?\d{{1,6}}\)?){{1,6}}{_FAR}"), 1.5),
    (regex.compile(rf"(?<![\p{{L}}\p{{N}}_#+.,:/])\(0\d{{1,4}}\){_S}?\d{{3,4}}(?:{_S}?\d{{2,4}}){{1,2}}{_FAR}"), 1.5),
    (regex.compile(rf"{_EDGE}0\d(?:{_S}\d\d){{4}}{_FAR}"), 1.5),
    (regex.compile(rf"{_EDGE}0\d{{2,4}}{_S}\d{{3,8}}(?:{_S}?\d{{2,4}}){{0,2}}{_FAR}"), 1.0),
    (regex.compile(rf"{_EDGE}0[1-9]\d{{8,9}}{_FAR}"), 1.0),
    (regex.compile(rf"{_EDGE}(?:1[-. ])?(?:\(\d{{3}}\)|\d{{3}})[-. ]\d{{3}}[-. ]\d{{4}}{_FAR}"), 1.2),
    (regex.compile(rf"(?<![\p{{L}}\p{{N}}_#+.,:/])\(\d{{3}}\)\s?\d{{3}}[-. ]\d{{4}}{_FAR}"), 1.2),
    (regex.compile(rf"{_EDGE}\d{{3}}[-. ]\d{{4}}{_FAR}"), 0.0),
    (regex.compile(rf"{_EDGE}[1-9]\d{{8,10}}{_FAR}"), 0.0),
]
_PHONE_WORD = regex.compile(r"\b(?:phone|mobile|cell|tel|telephone|call|ring|rang|text|sms|whatsapp|number|reach|dial|handy|telefon|rufen|nummer|téléphone|numéro|appelez|teléfono|llam\w*|telefone|ligu\w*|waits at|free until|телефон|电话|電話|โทร|هاتف|फ़ोन)\b", regex.I)
_NO_PHONE = regex.compile(r"(?:\b(?:order|orders|case|ticket|tracking|item|ref|reference|voucher|model|invoice|version|parcel|serial|isbn|bestellung|commande|pedido)\b\W{0,3}(?:no\.?|number|nr\.?|#)?\W{0,3})\Z", regex.I)

_ID_WORD = regex.compile(r"passport|pass no|passeport|pasaporte|reisepass|passaporte|паспорт|护照|パスポート|\bssn\b|social security|national insurance|\bnino\b|\bni (?:number|no)\b|aadhaar|aadhar|आधार|\bdni\b|\bnie\b|documento|ausweis|personalausweis|licen[cs]e|f(?:ü|u)hrerschein|permis|carnet|identity|\bid card\b|\bcpf\b|\bbsn\b|pesel", regex.I)
_PASS_WORD = regex.compile(r"passport|pass no|passeport|pasaporte|reisepass|passaporte|паспорт|护照|パスポート|ausweis|identity|\bid (?:card|no|number)\b|documento|\bdni\b|carnet", regex.I)
_SSN_WORD = regex.compile(r"\bssn\b|social security", regex.I)
_AADHAAR_WORD = regex.compile(r"aadhaa?r|आधार", regex.I)

_V_D = [[0, 1, 2, 3, 4, 5, 6, 7, 8, 9], [1, 2, 3, 4, 0, 6, 7, 8, 9, 5], [2, 3, 4, 0, 1, 7, 8, 9, 5, 6], [3, 4, 0, 1, 2, 8, 9, 5, 6, 7], [4, 0, 1, 2, 3, 9, 5, 6, 7, 8], [5, 9, 8, 7, 6, 0, 4, 3, 2, 1], [6, 5, 9, 8, 7, 1, 0, 4, 3, 2], [7, 6, 5, 9, 8, 2, 1, 0, 4, 3], [8, 7, 6, 5, 9, 3, 2, 1, 0, 4], [9, 8, 7, 6, 5, 4, 3, 2, 1, 0]]
_V_P = [[0, 1, 2, 3, 4, 5, 6, 7, 8, 9], [1, 5, 7, 6, 2, 8, 3, 0, 9, 4], [5, 8, 0, 3, 7, 9, 6, 1, 4, 2], [8, 9, 1, 6, 0, 4, 3, 5, 2, 7], [9, 4, 5, 3, 1, 2, 6, 8, 7, 0], [4, 2, 8, 6, 5, 7, 3, 9, 0, 1], [2, 7, 9, 3, 8, 0, 6, 4, 1, 5], [7, 0, 4, 6, 9, 1, 3, 2, 5, 8]]


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return len(digits) >= 12 and total % 10 == 0


def mod97(iban: str) -> bool:
    s = regex.sub(r"\s", "", iban).upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def verhoeff(digits: str) -> bool:
    c = 0
    for i, ch in enumerate(reversed(digits)):
        c = _V_D[c][_V_P[i % 8][int(ch)]]
    return c == 0


def mod23(dni: str) -> bool:
    d = regex.sub(r"\D", "", dni)
    return len(d) == 8 and "TRWAGMYFPDXBNJZSQVHLCKE"[int(d) % 23] == dni[-1].upper()


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


_WIDE = {0xFF10 + i: 0x30 + i for i in range(10)} | {0xFF20: 0x40, 0xFF0E: 0x2E, 0xFF0D: 0x2D, 0xFF0B: 0x2B, 0xFF08: 0x28, 0xFF09: 0x29, 0x3000: 0x20, 0x00A0: 0x20, 0x202F: 0x20, 0x2011: 0x2D, 0x2010: 0x2D, 0x2013: 0x2D}
_URL = regex.compile(r"https?://\S+|\bwww\.\S+", regex.I)
_NINO = regex.compile(rf"{_EDGE}[A-Z]{{2}}\s?\d\d\s?\d\d\s?\d\d\s?[A-D]{_FAR}", regex.I)
_SSN = regex.compile(rf"{_EDGE}\d{{3}}(?P<s>[-. ]?)\d\d(?P=s)\d{{4}}{_FAR}")
_AADHAAR = regex.compile(rf"{_EDGE}\d{{4}}(?P<s>[- ]?)\d{{4}}(?P=s)\d{{4}}{_FAR}")
_DNI = regex.compile(rf"{_EDGE}(?:\d{{8}}|\d{{2}}\.\d{{3}}\.\d{{3}})[-\s]?[A-Z]{_FAR}", regex.I)
_LICENCE = regex.compile(rf"{_EDGE}[A-ZÀ-Þ9]{{5}}\d{{6}}[A-Z9]{{2}}\d[A-Z]{{2}}{_FAR}", regex.I)
_PASSPORT = regex.compile(rf"{_EDGE}(?:[A-Z]{{1,2}}\s?\d{{6,9}}|[A-Z0-9](?=[A-Z0-9]*\d[A-Z0-9]*\d)[A-Z0-9]{{7,9}}|\d{{2}}[A-Z]{{2}}\d{{5}}|\d{{9}}){_FAR}", regex.I)
_CARD = regex.compile(rf"{_EDGE}\d(?:[ -]?\d){{12,18}}{_FAR}")
_IBAN = regex.compile(rf"{_EDGE}[A-Z]{{2}}\d\d(?:\s?[A-Z0-9]{{4}}){{2,7}}(?:\s?[A-Z0-9]{{1,4}})?{_FAR}", regex.I)

_MID = r"(?:\p{L}[\p{L}\p{M}'’\-]*\.?\s+)"
_ADDRESS_EN = regex.compile(rf"(?<![\p{{L}}\p{{N}}_.,:/#\-€$£]|\d\s)(?P<a>\d{{1,4}}\s?[A-Za-z]?,?\s+(?P<mid>{_MID}{{1,3}}?)(?P<t>{'|'.join(_STREET + _COMMON_STREET)})\b)", regex.I)
_ADDRESS_FR = regex.compile(r"(?<![\p{L}\p{N}_.,:/#\-])(?P<a>\d{1,4}\s?(?:bis|ter|[A-Z])?,?\s+(?:rue|avenue|boulevard|chemin|allée|impasse|quai|cours)\s+(?:de\s+la\s+|de\s+l['’]|des\s+|du\s+|de\s+)?\p{L}[\p{L}'’\-]+)", regex.I)
_ADDRESS_DE = regex.compile(rf"(?<![\p{{L}}\p{{N}}_])(?P<a>(?:\p{{L}}[\p{{L}}\-]{{2,}}(?:{'|'.join(_GERMAN)})|\p{{L}}[\p{{L}}\-]+\s(?:straße|strasse|str\.|platz|allee|weg))\s+\d{{1,4}}\s?[a-z]?)(?![\p{{L}}\p{{N}}])", regex.I)
_ADDRESS_ES = regex.compile(r"(?<![\p{L}\p{N}_])(?P<a>(?:calle|avenida|avda\.|plaza|paseo|rua|travessa|largo|via|viale|piazza|corso)\s+(?:(?:del?|de\s+la|de\s+los|de\s+las|das?|dos?|della|delle)\s+)?\p{L}[\p{L}'’\-]+(?:\s+\p{L}[\p{L}'’\-]+){0,2},?\s+(?:n[º°.]?\s*)?\d{1,4})(?![\p{L}\p{N}]|[.,]\d)", regex.I)
_HOME_WORD = regex.compile(r"live|address|adresse|dirección|direccion|morada|endereço|deliver|ship|moved|vivo|habite|wohne|came to|went past|should go|house|outside your|send it|bring it|anschrift|дом|адрес|地址|住所", regex.I)


def _word_near(rx: regex.Pattern, text: str, a: int, b: int, left: int = 40, right: int = 34) -> bool:
    return bool(rx.search(text, max(0, a - left), a) or rx.search(text, b, min(len(text), b + right)))


def _emails(t: str) -> Iterator[Span]:
    for rx, score in zip(EMAILS, (3.0, 2.5, 2.5, 2.2, 1.5), strict=True):
        if "@" not in t and rx in EMAILS[:2]:
            continue
        for m in rx.finditer(t):
            yield Span(m.start(), m.end(), "EMAIL", score)


def _identities(t: str) -> Iterator[Span]:
    for m in _NINO.finditer(t):
        yield Span(m.start(), m.end(), "IDENTITY_NUMBER", 2.0 + _word_near(_ID_WORD, t, *m.span()))
    for m in _LICENCE.finditer(t):
        if not m[0].isdigit():
            yield Span(m.start(), m.end(), "IDENTITY_NUMBER", 2.0 + _word_near(_ID_WORD, t, *m.span()))
    for m in _SSN.finditer(t):
        near = _word_near(_SSN_WORD, t, *m.span())
        if near or m["s"] == "-":
            yield Span(m.start(), m.end(), "IDENTITY_NUMBER", 1.0 + 1.6 * near)
    for m in _AADHAAR.finditer(t):
        digits = regex.sub(r"\D", "", m[0])
        score = 1.6 * _word_near(_AADHAAR_WORD, t, *m.span()) + 0.7 * verhoeff(digits) + 0.2 * (m["s"] != "")
        yield Span(m.start(), m.end(), "IDENTITY_NUMBER", score)
    for m in _DNI.finditer(t):
        near = _word_near(_ID_WORD, t, *m.span())
        yield Span(m.start(), m.end(), "IDENTITY_NUMBER", 1.1 * mod23(m[0]) + 1.3 * near)
    for m in _PASSPORT.finditer(t):
        if any(c.isdigit() for c in m[0]) and _PASS_WORD.search(t, max(0, m.start() - 40), m.start()):
            yield Span(m.start(), m.end(), "IDENTITY_NUMBER", 1.8)
    for m in _CARD.finditer(t):
        if luhn(regex.sub(r"\D", "", m[0])) and not _NO_PHONE.search(t[max(0, m.start() - 24) : m.start()]):
            yield Span(m.start(), m.end(), "CARD", 1.4)
    for m in _IBAN.finditer(t):
        if mod97(m[0]):
            yield Span(m.start(), m.end(), "IBAN", 3.0)


def _phones(t: str) -> Iterator[Span]:
    for rx, base in PHONES:
        for m in rx.finditer(t):
            n = sum(c.isdigit() for c in m[0])
            if not (7 <= n <= 15) or regex.fullmatch(r"(?:19|20)\d\d[-./ ]\d\d[-./ ]\d\d", m[0]):
                continue
            score = base + 1.2 * _word_near(_PHONE_WORD, t, *m.span(), 30, 24)
            if _NO_PHONE.search(t[max(0, m.start() - 24) : m.start()]):
                score -= 2.5
            yield Span(m.start(), m.end(), "PHONE", score)


def _addresses(t: str) -> Iterator[Span]:
    for m in _ADDRESS_EN.finditer(t):
        mid = regex.findall(r"[\p{L}\p{M}'’\-]+", m["mid"])
        home = _word_near(_HOME_WORD, t, *m.span("a"))
        upper = all(w[0].isupper() for w in mid)
        if any(w.lower() in _NO_NAME and w.lower() not in ("old", "new") for w in mid):
            continue
        if m["t"].lower() in _COMMON_STREET and not (home or (upper and m["t"][0].isupper())):
            continue
        yield Span(*m.span("a"), "ADDRESS", 1.2 + 0.6 * home + 0.5 * upper)
    for rx in (_ADDRESS_FR, _ADDRESS_DE, _ADDRESS_ES):
        for m in rx.finditer(t):
            yield Span(*m.span("a"), "ADDRESS", 1.5 + 0.6 * _word_near(_HOME_WORD, t, *m.span("a")))


def _parts(n: str) -> list[str]:
    return [w for w in regex.findall(r"[\p{L}\p{M}'’\-]+", n) if len(w) > 1 and not _IS_PARTICLE.fullmatch(w)]


_IS_PARTICLE = regex.compile(_PARTICLE)


def _is_name(n: str) -> bool:
    """A given and a family name, neither of them a common word nor, in small letters, of a word's shape."""
    ws = _parts(n)
    return len(ws) == 2 and not any(w.lower().replace("’", "'") in _NO_NAME or (w.islower() and _WORDY.search(w)) for w in ws)


def _to_the_end(t: str, end: int) -> int:
    """The end of a name with the capitalised parts that follow its first two."""
    for _ in range(3):
        m = _MORE.match(t, end)
        if not m or m["w"].lower() in _NO_NAME:
            break
        end = m.end("w")
    return end


def _names(t: str, low: str) -> Iterator[Span]:
    """Names by what stands before and behind them, their shape, and what their words are."""
    before = _HAS_BEFORE.search(low) or _HAS_OTHER.search(low)
    shout = not any(c.islower() for c in t)  # then capitals tell nothing

    def span(m: regex.Match, score: float) -> Span:
        more = not shout and all(w[0].isupper() for w in _parts(m["n"]))
        return Span(m.start("n"), _to_the_end(t, m.end("n")) if more else m.end("n"), "NAME", score)

    if before:
        for m in _NAME_STRONG.finditer(t):
            if _is_name(m["n"]):
                yield span(m, 2.0)
        for m in _NAME_WEAK.finditer(t, overlapped=True):
            n = m["n"]
            if not _is_name(n):
                continue
            big = not shout and all(w[0].isupper() for w in _parts(n))
            on = (_SELF_RE if m["self"] else _OTHER_RE).match(t, m.end("n")) or (not m["of"] and (_SELF_RE.match(t, m.end("n")) or _OTHER_RE.match(t, m.end("n"))))
            s = 0.6 * big + 1.0 * bool(on) + 0.5 * bool(_END.match(t, m.end("n"))) + 0.5 * (m["off"] is not None or m["of"] is not None) + (0.4 if "," in n and big else 0.0)
            # sentences that introduce and end with the name
            if m["self"] and not big and m["self"].lower() not in ("i'm", "i’m", "im", "i am", "this is") and _STOP_END.match(t, m.end("n")):
                s += 0.5
            yield span(m, s)
        for m in _NAME_HAN.finditer(t):
            yield Span(*m.span("n"), "NAME", 1.5)
    if _HAS_HERE.search(low):
        for m in _NAME_AFTER.finditer(t, overlapped=True):
            if _is_name(m["n"]):
                yield span(m, 1.5)
    if not shout and _HAS_TITLED.search(t):
        for rx in (_NAME_DOES, _NAME_TO):
            for m in rx.finditer(t):
                if _is_name(m["n"]):
                    yield span(m, 1.1)


def find_spans(text: str | None) -> list[Span]:
    """Spans of personal data in order; start and end count code points from 0."""
    if not text:
        return []
    t = text.translate(_WIDE)
    low = t.lower()
    found: list[Span] = []
    if _AT_HINT.search(low):
        found += _emails(t)
    six = _SIX.search(t)
    if six or _PASS_WORD.search(low):
        found += _identities(t)
    if six:
        found += _phones(t)
    if _ADDRESS_HINT.search(low):
        found += _addresses(t)
    found += _names(t, low)
    urls = [m.span() for m in _URL.finditer(t)] if "://" in t or "www." in t.lower() else []
    out: list[Span] = []
    for s in sorted((s for s in found if s.score >= 1.0), key=lambda s: (-s.score, s.start - s.end, s.start)):
        if any(s.start < o.end and o.start < s.end for o in out) or any(s.start < b and a < s.end for a, b in urls):
            continue
        out.append(s)
    return sorted(out)


def redact(text: str | None) -> str | None:
    """The text with each span replaced by its type in square brackets; null stays null."""
    if not text:
        return text
    out, at = [], 0
    for s in find_spans(text):
        out += [text[at : s.start], f"[{s.kind}]"]
        at = s.end
    return "".join([*out, text[at:]])


def plain(text: Column) -> Column:
    """The text as find_spans reads it: wide digits and signs as ASCII ones, in small letters."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.lower(F.when(ascii_only, text).otherwise(F.translate(text, "".join(map(chr, _WIDE)), "".join(map(chr, _WIDE.values())))))


def gate(text: Column, low: Column) -> Column:
    """Whether a text, `low` as read by `plain`, can hold a span: the hints of the kinds, each a necessary condition."""
    java = lambda rx: rx.pattern.replace("(?<![@\\d])", "(?<![@0-9])")
    wide = F.length(low) != F.octet_length(low)
    hints = low.rlike(java(_SIX)) | low.rlike(java(_HAS_BEFORE)) | low.rlike(java(_AT_HINT)) | low.rlike(java(_HAS_HERE)) | low.rlike(java(_ADDRESS_HINT)) | low.rlike(java(_PASS_WORD))
    return hints | text.rlike(java(_HAS_TITLED)) | (wide & low.rlike(java(_HAS_OTHER)))


def find_pii(df: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """(field_name, record_id, pii_type, start_pos, end_pos) of every span in the columns `fields` (name: column).

    start_pos and end_pos count code points from 1. Null and empty texts hold none; a null key is kept; repeated rows
    count once; other columns play no part; an empty table gives no rows. No shuffle but that of the finds.
    """
    # the plain form is made once a text, below the generator, where the filter can't be pushed
    parts = [F.struct(F.lit(name).alias("f"), F.col(col).alias("t"), plain(F.col(col)).alias("l")) for name, col in fields.items()]
    rows = df.select(F.col(key).cast("string").alias("k"), F.explode(F.array(*parts)).alias("p")).where(gate(F.col("p.t"), F.col("p.l"))).select("k", "p.f", "p.t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names, at, kinds, starts, ends = batch.column(0), batch.column(1), [], [], [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                for s in find_spans(t):
                    at.append(i)
                    kinds.append(s.kind)
                    starts.append(s.start + 1)
                    ends.append(s.end)
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [names.take(take), ids.take(take), pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
                names=["field_name", "record_id", "pii_type", "start_pos", "end_pos"],
            )

    schema = "field_name string, record_id string, pii_type string, start_pos int, end_pos int"
    return spread(rows, "k").mapInArrow(run, schema).distinct()


def redact_column(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the redacted text in `out`; texts that the gate keeps out are passed on as they are.

    Rows and their other columns come out as given, in one pass over Arrow batches; null and empty texts stay.
    """
    at, schema = df.columns.index(text), df.withColumn(out, F.col(f"`{text}`")).schema
    place = schema.fieldNames().index(out)
    rows = spread(df.toDF(*[f"c{i}" for i in range(len(df.columns))]), f"c{at}")
    # a generator over one element keeps the plain form from being worked out once a use
    lowered = rows.select("*", F.explode(F.array(F.struct(plain(F.col(f"c{at}")).alias("l")))).alias("low"))
    gated = lowered.select(*rows.columns, F.coalesce(gate(F.col(f"c{at}"), F.col("low.l")), F.lit(False)).alias("open"))
    inner = StructType([StructField(f"c{i}", f.dataType, True) for i, f in enumerate(schema.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shown = [redact(t) if o else t for t, o in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            columns = list(batch.columns[:-1])
            columns[place:place + 1] = [pa.array(shown, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=inner.fieldNames())

    return gated.mapInArrow(run, inner).toDF(*schema.fieldNames())
