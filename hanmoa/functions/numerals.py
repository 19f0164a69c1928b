"""Numbers in Korean words. Amounts are digit strings, so numbers of any length are exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hanmoa.functions.jamo import bind, chars, strings, trim_space

# Digits, units within four digits and of each four digits, native numbers, days, ordinals.
DIGITS = list("영일이삼사오육칠팔구")
SMALL = ["", "십", "백", "천"]
LARGE = ["", "만", "억", "조", "경", "해", "자", "양", "구", "간", "정", "재", "극", "항하사", "아승기", "나유타", "불가사의", "무량대수", "겁", "업"]
ONES = ["", "하나", "둘", "셋", "넷", "다섯", "여섯", "일곱", "여덟", "아홉"]
TENS = ["", "열", "스물", "서른", "마흔", "쉰", "예순", "일흔", "여든", "아흔", "백"]
MODIFIERS = ["", "한", "두", "세", "네", *ONES[5:]]
ORDINALS = ["", "한", "두", *ONES[3:]]
DAYS = ["", "하루", "이틀", "사흘", "나흘", "닷새", "엿새", "이레", "여드레", "아흐레"]
DAY_TENS, WHOLE_DAY_TENS = ["", "열", "스무", ""], {10: "열흘", 20: "스무날", 30: "서른날"}
INFINITE = "무한대"
#: Text that is read without looking for signs, points or white space.
_PLAIN = r"^[0-9]+\z"


def _word(number: Column, tens: list[str], ones: list[str], special: dict[int, str]) -> Column:
    n = number.cast("int")
    whole = F.concat(F.get(strings(tens), F.floor(n / 10).cast("int")), F.get(strings(ones), n % 10))
    for k, w in special.items():
        whole = F.when(n == k, F.lit(w)).otherwise(whole)
    return whole


def susa(number: Column, modifier: bool = False) -> Column:
    """Native number of 1 to 100, or its form before a noun; others in digits."""
    word = _word(number, TENS, MODIFIERS if modifier else ONES, {20: "스무"} if modifier else {})
    return F.when(number.between(1, 100), word).otherwise(number.cast("string"))


def seosusa(number: Column) -> Column:
    """Ordinal: native up to 99, Sino-Korean beyond; numbers under 1 in digits."""
    native = F.concat(_word(number, TENS, ORDINALS, {1: "첫", 2: "둘", 20: "스무"}), F.lit("째"))
    return (
        F.when(number < 1, number.cast("string")).when(number <= 99, native).otherwise(F.concat(number_to_hangul(number), F.lit("째")))
    )


def days(number: Column) -> Column:
    """Native name of 1 to 30 days; others in digits."""
    return F.when(number.between(1, 30), _word(number, DAY_TENS, DAYS, WHOLE_DAY_TENS)).otherwise(
        F.concat(number.cast("string"), F.lit("일"))
    )


def parse_decimal(s: Column) -> Column:
    """struct<negative, whole, fraction> of a trimmed number, commas and underscores passed over; null if it is none."""
    plain = F.regexp_replace(s, "[,_]", "")
    whole = F.regexp_extract(plain, r"^[+-]?([0-9]*)", 1)
    fraction = F.regexp_extract(plain, r"\.([0-9]*)$", 1)
    fits = plain.rlike(r"^[+-]?[0-9]*\.?[0-9]*\z") & plain.rlike("[0-9]")
    return F.when(
        fits,
        F.struct(
            plain.startswith("-").alias("negative"),
            F.when(whole == "", "0").otherwise(whole).alias("whole"),
            fraction.alias("fraction"),
        ),
    )


def infinity(s: Column, mixed: bool, spacing: bool) -> Column:
    """The word for an infinite number in letters, else null."""
    minus = "-무한대" if mixed else "마이너스 무한대" if spacing else "마이너스무한대"
    return F.when(s.rlike("^(?i)[+]?inf(inity)?\\z"), INFINITE).when(s.rlike("^(?i)-inf(inity)?\\z"), minus)


def large_unit(index: Column) -> Column:
    """The unit of the four digits with this index; powers of ten beyond those that have a name."""
    return F.when(index < len(LARGE), F.get(strings(LARGE), index)).otherwise(F.concat(F.lit("10^"), (index * 4).cast("string")))


def _fours(digits: Column) -> Column:
    """array<struct<four, index>>: the digits in fours, from the highest; four is padded with zeros."""
    plain = F.ltrim(digits, F.lit("0"))
    n = F.ceil(F.length(plain) / 4).cast("int")
    padded = F.lpad(plain, n * 4, "0")
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.lit([]).cast("array<int>"))
    return F.transform(index, lambda i: F.struct(F.substring(padded, i * 4 + 1, F.lit(4)).alias("four"), (n - 1 - i).alias("index")))


def _four_spoken(n: int) -> str:
    """Four digits in words: a one is silent before a unit, and nothing is said of a zero."""
    out = ""
    for place, unit in zip((1000, 100, 10, 1), reversed(SMALL), strict=True):
        d = n // place % 10
        out += (DIGITS[d] if d > 1 or d and not unit else "") + (unit if d else "")
    return out


#: The words of 0 to 9,999, made once; one lookup says a group of four digits.
_SPOKEN = ",".join(map(_four_spoken, range(10_000)))


def _spoken(digits: Column, spacing: bool) -> Column:
    """A digit string in words."""
    words = F.split(F.lit(_SPOKEN), ",")  # folded to a constant array by the optimiser
    said = F.transform(_fours(digits), lambda g: F.when(g["four"] != "0000", F.concat(F.get(words, g["four"].cast("int")), large_unit(g["index"]))))
    joined = F.array_join(said, " " if spacing else "")  # passes over nulls
    return F.when(joined == "", DIGITS[0]).otherwise(joined)


def _as_text(number: Column, double: bool) -> Column:
    """The decimal text of a number; of a double the shortest, written out below 2^53 and above 10^-5."""
    if not double:
        return number.cast("string")
    plain = F.regexp_replace(F.regexp_replace(F.call_function("format_number", number, F.lit("0.####################")), "^-?$", "0"), "^(-?[0-9]+)$", "$1.0")
    near = (F.abs(number) < 2**53) & ((F.abs(number) >= 1e-4) | (number == 0))
    return F.when(near, plain).otherwise(number.cast("string"))


def number_to_hangul(number: Column, spacing: bool = False, double: bool = False) -> Column:
    """A number (text, integer, decimal, or a double if so marked) in words.

    Text that is no number is zero and empty text is empty. Fraction digits are read one by one.
    """
    def of_text(text: Column) -> Column:
        any_number = bind(trim_space(text), lambda s: bind(parse_decimal(s), lambda p: _in_words(s, p, spacing)))
        return F.when(text.rlike(_PLAIN), _spoken(text, spacing)).otherwise(any_number)

    return F.when(number.isNotNull(), bind(_as_text(number, double), of_text))


def _in_words(s: Column, p: Column, spacing: bool) -> Column:
    gap = " " if spacing else ""
    nonzero = F.concat(p["whole"], p["fraction"]).rlike("[1-9]")
    sign = F.when(p["negative"] & nonzero, f"마이너스{gap}").otherwise("")
    fraction = F.array_join(F.transform(chars(p["fraction"]), lambda d: F.get(strings(DIGITS), d.cast("int"))), "")
    point = F.when(p["fraction"] == "", "").otherwise(F.concat(F.lit(f"점{gap}"), fraction))
    words = F.concat(sign, _spoken(p["whole"], spacing), point)
    return F.when(s == "", "").otherwise(F.coalesce(infinity(s, False, spacing), words, F.lit(DIGITS[0])))


def number_to_hangul_mixed(number: Column, spacing: bool = False, double: bool = False) -> Column:
    """A number in digits with commas and a unit for each four."""
    zero = F.when(F.isnan(number), "0") if double else F.lit(None).cast("string")
    def of_text(text: Column) -> Column:
        any_number = bind(trim_space(text), lambda s: bind(parse_decimal(s), lambda p: _in_digits(s, p, spacing, zero)))
        return F.when(text.rlike(_PLAIN), _grouped(text, spacing)).otherwise(any_number)

    return F.when(number.isNotNull(), bind(_as_text(number, double), of_text))


def _grouped(digits: Column, spacing: bool) -> Column:
    """A digit string with commas and a unit for each four."""
    groups = F.transform(_fours(digits), lambda g: F.when(g["four"] != "0000", F.concat(F.format_number(g["four"].cast("int"), 0), large_unit(g["index"]))))
    joined = F.array_join(groups, " " if spacing else "")
    return F.when(joined == "", "0").otherwise(joined)


def _in_digits(s: Column, p: Column, spacing: bool, zero: Column) -> Column:
    nonzero = F.concat(p["whole"], p["fraction"]).rlike("[1-9]")
    words = F.concat(
        F.when(p["negative"] & nonzero, "-").otherwise(""),
        _grouped(p["whole"], spacing),
        F.when(p["fraction"] == "", "").otherwise(F.concat(F.lit("."), p["fraction"])),
    )
    return F.when(s == "", "").otherwise(F.coalesce(zero, infinity(s, True, spacing), words, F.lit(DIGITS[0])))


def amount_to_hangul(amount: Column) -> Column:
    """The digits and points of a text in words; a sign is passed over and zeros at a fraction's end are dropped."""
    return F.when(amount.isNotNull(), bind(F.regexp_replace(amount.cast("string"), "[^0-9.]", ""), _amount))


def _amount(compact: Column) -> Column:
    parts = F.split(F.regexp_replace(compact, "^[.]+", ""), "[.]", 2)
    whole = F.get(parts, F.lit(0))
    whole = F.when(F.coalesce(whole, F.lit("")) == "", F.when(compact == "", "").otherwise("0")).otherwise(F.when(whole == "0", whole).otherwise(F.regexp_replace(whole, "^0+", "")))
    fraction = F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), "0+$", "")
    text = F.when(fraction == "", whole).otherwise(F.concat(whole, F.lit("."), fraction))
    return F.when(compact == "", DIGITS[0]).otherwise(number_to_hangul(text))
