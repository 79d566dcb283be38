"""Column functions over text: folding, tokens, figures, sentence ends, header dates."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that search ignores, in natural order.
STOP_WORDS = (
    "the a an and or but if of to in on for is are was were be been it that this with as at by from we i you they he "
    "she not so do does did have has had will would can could should there their them what which who"
).split()
#: Figures of a list while they are gathered.
STRIDE = 256
# What a token is.
TOKEN = r"[A-Za-zÀ-ÿ0-9][A-Za-zÀ-ÿ0-9_\-.%]*"
# The kinds of figures, in order of preference.
FIGURE = (
    r"(?i)("
    r"\d{1,3}(?:[.,]\d+)?\s?%"
    r"|(?:EUR|€|\$|£)\s?\d[\d.,]*\s?(?:k|m|bn|million|thousand)?"
    r"|\d[\d.,]*\s?(?:k|m|bn)\b"
    r"|\b\d{1,3}(?:[.,]\d{3})+\b"
    r"|\b(?:zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|"
    r"twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand)"
    r"(?:[ -](?:one|two|three|four|five|six|seven|eight|nine|ten|hundred|thousand|"
    r"percent|per cent))*\s*(?:percent|per cent)\b"
    r"|\b\d{1,4}\s*(?:articles|items|stores|SKUs|skus|days|weeks|months|users|"
    r"incidents|defects|rows|files|people)\b"
    r")"
)
# Remarks that fill a pause.
BACKCHANNEL = (
    r"(?iU)^(mm+|mm-hm+|uh+|um+|hmm+|yeah|yep|yes|no|ok|okay|right|sure|exactly|true|got it|i see|of course|indeed|sorry)[.,!?…]*$"
)
SENTENCE_END, TRAILS_OFF = r"[.!?…\"')\]]\s*$", r"(\.\.\.|…)\s*$"
# What an address is.
EMAIL = r"(?U)[\w.\-]+@[\w.\-]+\.[A-Za-z]{2,}"
# Names of months in English, German and Swedish.
MONTHS = (
    "January February March April May June July August September October November December",
    "Januar Februar März April Mai Juni Juli August September Oktober November Dezember",
    "januari februari mars april maj juni juli augusti september oktober november december",
)


@lru_cache(maxsize=1)
def plain_letters() -> tuple[str, str]:
    """Accented letters and the letters left of them without their marks, where that is one letter."""
    pairs = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        left = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(left) == 1 and left != chr(code):
            pairs[chr(code)] = left
    pairs |= {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L"}
    return "".join(pairs), "".join(pairs.values())


def plain(text: Column) -> Column:
    """Text without diacritics; ø, æ and ß, which have no decomposition, become o, ae and ss."""
    source, target = plain_letters()
    out = F.translate(F.regexp_replace(text, r"\p{M}", ""), source, target)
    for a, b in (("æ", "ae"), ("Æ", "AE"), ("ß", "ss"), ("œ", "oe"), ("Œ", "OE")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def norm(text: Column) -> Column:
    """White space to single spaces, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def capitals(text: Column) -> Column:
    """Text in capitals letter by letter, so as long as before: ß becomes ẞ, and a letter whose capital form is several stays."""
    each = lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(F.translate(c, "ß", "ẞ"))
    return F.array_join(F.transform(F.split(text, ""), each), "")


def fold(text: Column) -> Column:
    """Key for comparing names whatever their case, marks and white space."""
    return norm(plain(text))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def initials(text: Column) -> Column:
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    return F.upper(F.substring(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""), 1, 3))


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


@lru_cache(maxsize=1)
def token_letters() -> tuple[str, str]:
    """The capitals that a token may hold, and their small letters."""
    capitals = [chr(c) for c in [*range(0x41, 0x5B), *range(0xC0, 0xDF)] if chr(c).lower() != chr(c)]
    return "".join(capitals), "".join(c.lower() for c in capitals)


#: A stop word or single character as a whole token, or else a token as the only group.
TOKEN_PATTERN = "(?:(?:{}|[a-zà-ÿß0-9×])(?![a-zà-ÿß0-9_.%×-])|([a-zà-ÿß0-9×][a-zà-ÿß0-9_.%×-]*))".format("|".join(sorted({w.lower() for w in STOP_WORDS if len(w) > 1 and w == w.lower()})))


def tokenize(text: Column, trimmed: bool = False) -> Column:
    """Lower-case search tokens in order, without stop words and single characters.

    A token keeps its last dot or hyphen, unless ``trimmed``.  Stop words and single
    characters leave an empty group of the one pattern, so nothing is called for each token.
    """
    small = F.translate(text, *token_letters())
    if not trimmed:
        return F.array_remove(F.regexp_extract_all(small, F.lit(TOKEN_PATTERN), F.lit(1)), "")
    found = F.transform(F.regexp_extract_all(small, F.lit(TOKEN), F.lit(0)), lambda t: F.regexp_replace(t, "[_.-]+$", ""))
    stop, longest = F.array(*[F.lit(w) for w in STOP_WORDS]), max(map(len, STOP_WORDS))
    return F.filter(found, lambda t: (F.length(t) > longest) | (F.length(t) > 1) & ~F.array_contains(stop, t))


_TOKEN, _STOP, _END = re.compile(TOKEN), frozenset(STOP_WORDS), re.compile("[_.-]+$")
_SMALL = str.maketrans(*token_letters())
_IN_TOKEN = r"A-Za-zÀ-ÿ0-9_\-.%"


def tokens_of(text: str, trimmed: bool = False) -> list[str]:
    """The tokens of :func:`tokenize`, of a Python string."""
    found = _TOKEN.findall(text.lower() if text.isascii() else text.translate(_SMALL))
    if trimmed:
        found = [_END.sub("", t) for t in found]
    return [t for t in found if len(t) > 1 and t not in _STOP]


def shares_token(text: Column, topic: str) -> Column:
    """Whether a text has a token of a topic: a run of token characters that, from its first letter or digit on, is one."""
    words = sorted(set(tokens_of(topic)))
    if not words:
        return F.lit(False)
    run = f"(?:^|[^{_IN_TOKEN}])[_.%-]*(?:{'|'.join(map(re.escape, words))})(?![{_IN_TOKEN}])"
    return F.rlike(F.translate(text, *token_letters()), F.lit(run))


def figures(text: Column) -> Column:
    """Figures in order as structs (figure, start, stop); places count from 0.

    They are gathered in lists of STRIDE and these in one list, as appending copies
    a list: the work is that of the text's length even if it is full of figures.
    """
    gaps_, raw_ = F.split(text, FIGURE, -1), F.regexp_extract_all(text, F.lit(FIGURE), F.lit(0))
    one = "struct<figure:string,start:int,stop:int>"
    none, no_lists = F.array().cast(f"array<{one}>"), F.array().cast(f"array<array<{one}>>")

    def of(both: Column) -> Column:
        gaps, raw = both["gaps"], both["raw"]

        def step(acc: Column, k: Column) -> Column:
            start = acc["at"] + F.length(F.get(gaps, k))
            stop = start + F.length(F.get(raw, k))
            found = F.struct(F.trim(F.get(raw, k)).alias("figure"), start.alias("start"), stop.alias("stop"))
            return F.struct(stop.alias("at"), F.array_append(acc["out"], found).alias("out"))

        def stride(acc: Column, first: Column) -> Column:
            places = F.sequence(first, F.least(first + STRIDE, F.size(raw)) - 1)
            found = F.aggregate(places, F.struct(acc["at"].alias("at"), none.alias("out")), step)
            return F.transform(F.array(found), lambda x: F.struct(x["at"].alias("at"), F.array_append(acc["out"], x["out"]).alias("out")))[0]

        zero = F.struct(F.lit(0).alias("at"), no_lists.alias("out"))
        found = F.aggregate(F.sequence(F.lit(0), F.size(raw) - 1, F.lit(STRIDE)), zero, stride, lambda acc: F.flatten(acc["out"]))
        return F.when(F.size(raw) > 0, found).otherwise(none)

    # both arrays are made once and read by name
    return F.transform(F.array(F.struct(gaps_.alias("gaps"), raw_.alias("raw"))), of)[0]


def clock(seconds: Column) -> Column:
    """Seconds as m:ss, minutes without bound; null stays null."""
    return F.format_string("%d:%02d", F.floor(seconds / 60), seconds % 60)


def is_backchannel(text: Column) -> Column:
    return F.rlike(F.trim(text), F.lit(BACKCHANNEL)) & (n_words(text) <= 3)


def is_open(text: Column) -> Column:
    """Whether a statement stops in the middle of a sentence."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return (t != "") & (F.rlike(t, F.lit(TRAILS_OFF)) | ~F.rlike(t, F.lit(SENTENCE_END)))


def header_date(text: Column) -> Column:
    """Timestamp without zone of an English, German or Swedish mail header; null if it is none of these."""
    table: dict[str, int] = {}
    for names in MONTHS:
        for k, name in enumerate(names.split(), 1):
            table.setdefault(name.lower(), k)
    months = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    # The three kinds of dates in mail headers.
    word = "[A-Za-zÄÖÜÅäöüåß]+"
    part = lambda p, k: F.regexp_extract(text, p, k)
    english = rf"(?i){word},\s*({word})\s+(\d{{1,2}}),\s*(\d{{4}})\s+(\d{{1,2}}):(\d{{2}})\s*(AM|PM)?"
    german = rf"{word},\s*(\d{{1,2}})\.\s*({word})\s+(\d{{4}})\s+(\d{{1,2}}):(\d{{2}})"
    swedish = rf"(?i)den\s+(\d{{1,2}})\s+({word})\s+(\d{{4}})\s+(\d{{1,2}}):(\d{{2}})"

    def stamp(pattern: str, day: int, month: int, hour: Column) -> Column:
        number = lambda k: part(pattern, k).try_cast("int")
        return F.when(
            F.rlike(text, F.lit(pattern)),
            F.try_make_timestamp_ntz(
                number(3), F.element_at(months, F.lower(part(pattern, month))), number(day), hour, number(5), F.lit(0)
            ),
        )

    hour = lambda p: part(p, 4).try_cast("int")
    half = F.upper(part(english, 6))
    clocked = (
        F.when((half == "PM") & (hour(english) != 12), hour(english) + 12)
        .when((half == "AM") & (hour(english) == 12), F.lit(0))
        .otherwise(hour(english))
    )
    return F.coalesce(stamp(english, 2, 1, clocked), stamp(german, 1, 2, hour(german)), stamp(swedish, 1, 2, hour(swedish)))
