"""Text normalisation and text predicates as native Column expressions."""

from __future__ import annotations

import sys
from collections.abc import Callable
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Typographic characters and what they count as.
TYPOGRAPHY = {"’": "'", "‘": "'", "ʼ": "'", "“": '"', "”": '"', "–": "-", "—": "-", " ": " "}
# Vowels of the prose test; debris that stands for text in a document without a usable encoding.
VOWELS = "aeiouyàâäéèêëïîôöùûüœæ"
GLYPH = r"/(?:UNIC|uni|[A-Za-z]{0,3})[0-9A-Fa-f]{2,6}\b|\bcid:\d+"
# Shares at which the prose test decides.
GLYPH_SHARE, SPACED_TOKENS, SPACED_SHARE, SPRAYED_SHARE, PLAUSIBLE_SHARE = 0.3, 8, 0.5, 0.4, 0.6

#: What counts as white space in a text: Unicode's, and the four separators that Python counts too.
WS = r"[\s\x1c-\x1f]"


def norm_python(s: str) -> str:
    """The definition: composed, typography folded, case folded, marks dropped, white space collapsed."""
    s = unicodedata.normalize("NFC", s).translate(str.maketrans(TYPOGRAPHY)).casefold()
    s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
    return " ".join(s.split())


#: Characters that become several and that texts have often, replaced one by one.
OFTEN = "ßẞ"
#: The block of composed Hangul, whose parts are numbers of a letter, a vowel and an end.
HANGUL = (0xAC00, 0xD7A3)


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str, dict[str, str]]:
    """(characters, their single replacements with deletions last, replacements of several characters but for Hangul)."""
    single, dropped, several = {}, [], {}
    for code in range(1, 0x110000):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or HANGUL[0] <= code <= HANGUL[1] or c.isspace():
            continue
        if c not in TYPOGRAPHY and c.casefold() == c and not unicodedata.decomposition(c) and not unicodedata.combining(c):
            continue
        to = norm_python(f"a{c}a")[1:-1]
        if to == c:
            continue
        if len(to) == 1:
            single[c] = to
        elif not to:
            dropped.append(c)
        else:
            several[c] = to
    single[" "] = " "
    return "".join(single) + "".join(dropped), "".join(single.values()), several


def _spelled_out(text: Column) -> Column:
    """A text whose ligatures, Hangul and the like are replaced by the characters that they fold to."""
    several = {c: to for c, to in fold_table()[2].items() if c not in OFTEN}
    table = F.create_map(*(F.lit(x) for pair in several.items() for x in pair))
    first, last = (chr(c) for c in HANGUL)
    jamo = [F.array(*(F.lit(chr(c)) for c in range(at, at + n))) for at, n in ((0x1100, 19), (0x1161, 21))]
    ends = F.array(F.lit(""), *(F.lit(chr(c)) for c in range(0x11A8, 0x11A8 + 27)))

    def one(c: Column) -> Column:
        place = F.ascii(c) - HANGUL[0]
        parts = F.concat(F.get(jamo[0], (place / 588).cast("int")), F.get(jamo[1], (place % 588 / 28).cast("int")), F.get(ends, place % 28))
        return F.when((c >= first) & (c <= last), parts).otherwise(F.coalesce(F.try_element_at(table, c), c))

    # A few spans that hold them all; what else lies in a span costs time, no more.
    spans: list[list[int]] = []
    for code in sorted([*map(ord, several), *HANGUL]):
        if spans and (code - spans[-1][1] < 64 or code == HANGUL[1]):
            spans[-1][1] = code
        else:
            spans.append([code, code])
    held = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in spans) + "]"
    beyond = f"[{chr(spans[0][0])}-\U0010ffff]"
    return F.when(text.rlike(beyond) & text.rlike(held), F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(text)


def norm(text: Column) -> Column:
    """The normal form by built-in functions; texts with characters that fold to several others take one step more."""
    matching, replace, several = fold_table()
    out = text
    for c in OFTEN:
        out = F.replace(out, F.lit(c), F.lit(several[c]))
    out = _spelled_out(F.translate(out, matching, replace))
    return F.trim(F.regexp_replace(out, rf"(?U){WS}+", " "))


@F.pandas_udf(T.StringType())
def norm_exact(s: pd.Series) -> pd.Series:
    """The definition itself, for texts outside what ``norm`` states."""
    return s.map(lambda x: None if x is None else norm_python(x))


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no built-in. Used on paths only."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def flatten(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"(?U){WS}+", " "))


def clean(text: Column) -> Column:
    """Blank lines go, other runs of white space become one space; newlines stay."""
    lines = F.regexp_replace(text, r"\n{2,}", "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"(?U)(?:(?!\n)[\s\x1c-\x1f])+", " "), rf"(?U)^{WS}+|{WS}+$", "")


def glued(normal: Column) -> Column:
    """A normal form without its spaces: extraction may have lost any of them."""
    return F.replace(normal, F.lit(" "), F.lit(""))


def says(normal: Column, glue: Column, needle: str) -> Column:
    """Whether a text, given its normal form and that without spaces, has a phrase in either."""
    n = norm_python(str(needle))
    return F.contains(normal, F.lit(n)) | F.contains(glue, F.lit(n.replace(" ", "")))


def deglue(text: Column) -> Column:
    """A space where a small letter runs into a capital."""
    return F.regexp_replace(text, "(?<=[a-zà-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ])", " ")


def tokens(text: Column) -> Column:
    """Distinct words of more than two letters or digits of the normal form."""
    return F.array_distinct(F.filter(F.split(norm(text), "[^a-z0-9]+"), lambda x: F.length(x) > 2))


def ngrams(text: Column, low: int = 2, high: int = 5) -> Column:
    """Distinct runs of ``low`` to ``high`` words."""
    words = F.regexp_extract_all(text, F.lit(r"(?U)[\w'’-]+"), F.lit(0))

    def longer(w: Column, runs: Column, n: int) -> Column:
        """Runs of ``n`` words, from those of one word less."""
        left = F.greatest(F.size(w) - n + 1, F.lit(0))
        return F.slice(F.zip_with(runs, F.slice(w, n, left), lambda a, b: F.concat(a, F.lit(" "), b)), F.lit(1), left)

    def from_(w: Column, runs: Column, n: int) -> Column:
        more = [] if n == high else [named(longer(w, runs, n + 1), lambda r: from_(w, r, n + 1))]
        return F.concat(*([runs] if n >= low else []), *more)

    return F.array_distinct(named(words, lambda w: from_(w, w, 1)))


# A letter, or a mark or joiner within a word; most are told by the first part of the class, which is the quick one.
_LETTER = r"[a-zA-Z[^\W\d_]]"
# Vowels of either case; the last one is a dotted capital, whose small form has an i.
_VOWEL = f"[{VOWELS}{VOWELS.upper()}\u0130]"
_OTHER = rf"(?:(?!{_VOWEL}){_LETTER})"
_WORD = rf"(?U){_LETTER}{{3,}}"
# A word with a vowel and without five other letters in a row: up to four of them before each vowel and at the end.
_SPOKEN = rf"(?U)(?<!{_LETTER})(?={_LETTER}{{3}})(?:{_OTHER}{{0,4}}+{_VOWEL})++{_OTHER}{{0,4}}+(?!{_LETTER})"


def _sprayed(word: Column) -> Column:
    body = F.substring(word, 2, sys.maxsize >> 33)
    capitals = F.length(F.regexp_replace(body, r"(?U)\P{Lu}", ""))
    return (word != F.upper(word)) & (capitals > F.length(body) * SPRAYED_SHARE)


def _plausible(joined: Column) -> Column:
    """How many words of a text look like a language's: spoken, and without capitals sprayed over them."""
    inside = rf"(?U)(?<={_LETTER})\p{{Lu}}"
    # Most texts have no capital within a word, and their words are not looked at one by one.
    sprayed = F.size(F.filter(F.regexp_extract_all(joined, F.lit(_SPOKEN), F.lit(0)), lambda w: w.rlike(r"(?U).\p{Lu}") & _sprayed(w)))
    return F.regexp_count(joined, F.lit(_SPOKEN)) - F.when(joined.rlike(inside), sprayed).otherwise(0)


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, as the variable of a lambda; null stays null."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _by_expressions(text: Column) -> Column:
    """The prose test by expressions alone, for texts with characters that ``_kinds`` does not tell."""

    def by_joined(joined: Column) -> Column:
        return named(F.regexp_count(joined, F.lit(_WORD)), lambda n: (n > 0) & (_plausible(joined) >= n * PLAUSIBLE_SHARE))

    def by_rest(rest: Column) -> Column:
        without = F.replace(rest, F.lit(" "), F.lit(""))
        parts = F.length(rest) - F.length(without) + 1
        single = F.regexp_count(rest, F.lit(r"(?<![^ ])[^ ](?![^ ])"))
        spaced = (parts >= SPACED_TOKENS) & (single > parts * SPACED_SHARE)
        return named(F.when(spaced, without).otherwise(rest), by_joined)

    return F.coalesce(named(_without_marks(text), by_rest), F.lit(False))


def _without_marks(text: Column) -> Column:
    """The flat text with a space for each mark; null where it is empty or marks are too many."""

    def by_flat(flat: Column) -> Column:
        # Every mark has one of the two.
        marked = F.contains(flat, F.lit("/")) | F.contains(flat, F.lit("cid:"))
        marks = F.when(marked, F.length(flat) - F.length(F.regexp_replace(flat, GLYPH, ""))).otherwise(0)
        rest = F.when(marked, F.regexp_replace(flat, GLYPH, " ")).otherwise(flat)
        return F.when((F.length(flat) > 0) & (marks <= F.length(flat) * GLYPH_SHARE), rest)

    return named(flatten(F.coalesce(text, F.lit(""))), by_flat)


# What a character is to the prose test, and the characters whose kind is told.
LETTER_KIND, VOWEL_KIND, CAPITAL_KIND, SMALL_KIND, OTHER_KIND = 1, 2, 4, 8, 16
KNOWN_UP_TO, MARKS_FROM, MARKS_TO = 0x17F, 0x2010, 0x203E
#: Characters that are judged at once.
AT_ONCE = 1_000_000


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """By code: whether it is a letter as ``_LETTER`` says, a vowel, a capital, or has another upper case; or not known."""
    kinds = np.full(MARKS_TO + 2, OTHER_KIND, np.uint8)
    for code in (*range(KNOWN_UP_TO + 1), *range(MARKS_FROM, MARKS_TO + 1)):
        c = chr(code)
        letter = unicodedata.category(c)[0] == "L"
        kinds[code] = letter * LETTER_KIND + (c in VOWELS + VOWELS.upper() + "\u0130") * VOWEL_KIND + (unicodedata.category(c) == "Lu") * CAPITAL_KIND + (c.upper() != c) * SMALL_KIND
    return kinds


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of texts, each with a line end, which flat texts have none of; where each begins."""
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), "<u4")
    return codes, np.r_[0, np.flatnonzero(codes == 10)[:-1] + 1]


def prose_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Whether each flat text is prose as ``_by_expressions`` says, and whether its characters are all known."""
    codes, starts = _codes(texts)
    edge = (codes == 32) | (codes == 10)
    parts = np.add.reduceat(codes == 32, starts, dtype=np.int64) + 1
    single = np.add.reduceat(~edge & np.r_[True, edge[:-1]] & np.r_[edge[1:], True], starts, dtype=np.int64)
    spaced = (parts >= SPACED_TOKENS) & (single > parts * SPACED_SHARE)
    if spaced.any():
        codes, starts = _codes([t.replace(" ", "") if s else t for t, s in zip(texts, spaced, strict=True)])
    kinds = _kinds()[np.minimum(codes, MARKS_TO + 1)]
    upto = lambda flags: np.r_[0, np.cumsum(flags, dtype=np.int32)]
    change = np.diff(np.r_[np.int8(0), (kinds & LETTER_KIND).view(np.int8), np.int8(0)])
    first, last = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    long = last - first >= 3
    first, last = first[long], last[long]
    # Five other letters from here on.
    five = (kinds & (LETTER_KIND | VOWEL_KIND)) == LETTER_KIND
    for step in (1, 2, 1):
        five = five & np.r_[five[step:], np.zeros(min(step, len(five)), bool)]
    vowels, fives = upto(kinds & VOWEL_KIND > 0), upto(five)
    good = (vowels[last] > vowels[first]) & (fives[last] == fives[first])
    capitals, small = upto(kinds & CAPITAL_KIND > 0), upto(kinds & SMALL_KIND > 0)
    sprayed = (small[last] > small[first]) & (capitals[last] - capitals[first + 1] > (last - first - 1) * SPRAYED_SHARE)
    words, plausible = (np.bincount(np.searchsorted(starts, at, "right") - 1, minlength=len(texts)) for at in (first, first[good & ~sprayed]))
    return (words > 0) & (plausible >= words * PLAUSIBLE_SHARE), ~np.logical_or.reduceat(kinds == OTHER_KIND, starts)


@F.pandas_udf(T.BooleanType())
def _prose(flat: pd.Series) -> pd.Series:
    """``prose_of``; null where a text has characters that it does not know, false for null."""
    out, held, size = [None] * len(flat), [], 0
    rows = [*enumerate(flat), (len(out), None)]
    for i, t in rows:
        if t is not None:
            held.append((i, t))
            size += len(t)
        elif i < len(out):
            out[i] = False
        if held and (size >= AT_ONCE or i == len(out)):
            for (k, _), prose, known in zip(held, *prose_of([t for _, t in held]), strict=True):
                out[k] = bool(prose) if known else None
            held, size = [], 0
    return pd.Series(out, dtype=object)


def is_prose(text: Column) -> Column:
    """Whether a text is language and not an extractor's debris; null and empty texts are not.

    Characters are judged in arrays, many texts at a time; texts with ones beyond Latin letters and common
    punctuation by expressions.
    """
    return F.coalesce(_prose(_without_marks(text)), _by_expressions(text))
