"""Fixed values of the Korean script and the column expressions that every function is made of.

A syllable's code point is 44032 + onset * 588 + vowel * 28 + final, so taking one apart is arithmetic and putting
one together is decoding a code point; all of it stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Onsets, vowels, finals (the first final is none) by index.
ONSETS = list("ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ")
VOWELS = list("ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ")
FINALS = ["", *"ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"]
# Compound vowels and finals, and the pairs that they are made of.
VOWEL_PAIRS = {"ㅘ": "ㅗㅏ", "ㅙ": "ㅗㅐ", "ㅚ": "ㅗㅣ", "ㅝ": "ㅜㅓ", "ㅞ": "ㅜㅔ", "ㅟ": "ㅜㅣ", "ㅢ": "ㅡㅣ"}
FINAL_PAIRS = {"ㄳ": "ㄱㅅ", "ㄵ": "ㄴㅈ", "ㄶ": "ㄴㅎ", "ㄺ": "ㄹㄱ", "ㄻ": "ㄹㅁ", "ㄼ": "ㄹㅂ", "ㄽ": "ㄹㅅ", "ㄾ": "ㄹㅌ", "ㄿ": "ㄹㅍ", "ㅀ": "ㄹㅎ", "ㅄ": "ㅂㅅ"}

FIRST, LAST = 0xAC00, 0xD7A3
SYLLABLES = "".join(map(chr, range(FIRST, LAST + 1)))
#: All consonants that stand alone, as onsets or finals.
CONSONANTS = "".join(sorted(set(ONSETS) | set(FINALS[1:])))
#: Unicode white space as a Java character class.
SPACE = r"\p{IsWhite_Space}"


def strings(values: list[str]) -> Column:
    return F.lit(values)


def numbers(values: list[int]) -> Column:
    """A constant int array. Written as text, as thousands of literals would be slow to analyse."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def table(values: dict[str, object]) -> Column:
    """A constant map from strings."""
    return F.create_map(*(F.lit(x) for item in values.items() for x in item))


def chars(s: Column) -> Column:
    """Code points of a string as strings; none for an empty one."""
    return F.filter(F.split(s, ""), lambda c: c != "")


def is_syllable(c: Column) -> Column:
    return F.ascii(c).between(FIRST, LAST)


def offset(c: Column) -> Column:
    return F.ascii(c) - FIRST


def onset(c: Column) -> Column:
    return F.floor(offset(c) / 588).cast("int")


def vowel(c: Column) -> Column:
    return F.floor(offset(c) % 588 / 28).cast("int")


def final(c: Column) -> Column:
    return (offset(c) % 28).cast("int")


def compose(l: Column, v: Column, t: Column) -> Column:  # noqa: E741
    """The syllable of three indexes; null if one is out of range."""
    code = F.lit(FIRST) + l * 588 + v * 28 + t
    fits = l.between(0, 18) & v.between(0, 20) & t.between(0, 27)
    return F.when(fits, F.decode(F.unhex(F.hex(code.cast("long"))), "UTF-16BE"))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used: as the variable of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim_space(s: Column) -> Column:
    return F.regexp_replace(s, f"^{SPACE}+|{SPACE}+$", "")
