"""Particles that depend on how a word ends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hanmoa.functions.jamo import FINALS, VOWELS, final, is_syllable, strings, table

# The built-in pairs, first part after a consonant but for the one listed as the other way round.
PAIRS = ["이/가", "을/를", "은/는", "으로/로", "와/과", "이나/나", "이란/란", "아/야", "이랑/랑", "이에요/예요", "으로서/로서", "으로써/로써", "으로부터/로부터", "이라/라"]
INVERTED = "와/과"
#: Pairs whose second part follows a final ㄹ too.
AFTER_RIEUL = {"으로/로", "으로서/로서", "으로써/로써", "으로부터/로부터"}
# How digits, letter names and letters at a word's end sound: with ㄹ, or with another consonant.
DIGIT_RIEUL, DIGIT_OTHER = "178", "36"
CAPITAL_RIEUL, CAPITAL_OTHER = "LR", "FMN"
LETTER_NAMES = ["에이", "비", "씨", "디", "이", "에프", "지", "에이치", "아이", "제이", "케이", "엘", "엠", "엔", "오", "피", "큐", "알", "에스", "티", "유", "브이", "더블유", "엑스", "와이", "지"]

_TAIL = r"[\p{IsWhite_Space}\p{P}\p{S}]+$"


def ending_sound(word: Column) -> Column:
    """struct<has_batchim, is_rieul> of a word's end, white space, punctuation and symbols at its end passed over."""
    body = F.regexp_replace(word, _TAIL, "")
    last = F.right(body, F.lit(1))
    jamo = F.when(is_syllable(last), F.get(strings(FINALS), final(last))).when(last.isin(*FINALS[1:], *VOWELS), last)
    latin = F.regexp_extract(body, "[A-Za-z]+$", 0)
    lower = F.lower(latin)
    capital = (latin != "") & (latin == F.upper(latin))
    rieul = (
        F.when(jamo.isNotNull(), jamo == "ㄹ")
        .when(last.rlike("^[0-9]$"), last.rlike(f"[{DIGIT_RIEUL}]"))
        .when(capital, last.rlike(f"[{CAPITAL_RIEUL}]"))
        .otherwise(lower.rlike("[lr]$"))
    )
    other = (
        F.when(jamo.isNotNull(), jamo.isin(*[t for t in FINALS[1:] if t != "ㄹ"]))
        .when(last.rlike("^[0-9]$"), last.rlike(f"[{DIGIT_OTHER}]"))
        .when(capital, last.rlike(f"[{CAPITAL_OTHER}]"))
        .otherwise(lower.rlike("(ng|[mn])$"))
    )
    return F.when(word.isNotNull(), F.struct((rieul | other).alias("has_batchim"), rieul.alias("is_rieul")))


def pick_josa(word: Column, pair: Column | str) -> Column:
    """The part of a pair ``after consonant/after vowel`` that suits the word; the first part after an empty word.

    A pair without two parts is taken as it is.
    """
    pair = F.lit(pair) if isinstance(pair, str) else pair
    sound = ending_sound(word)
    cut = F.instr(pair, "/")
    first, second = F.substring(pair, F.lit(1), cut - 1), F.substring(pair, cut + 1, F.length(pair))
    after = F.when(pair == INVERTED, ~sound["has_batchim"]).otherwise(sound["has_batchim"])
    after = after & ~(pair.isin(*AFTER_RIEUL) & sound["is_rieul"])
    picked = F.when(F.regexp_replace(word, "", "") == "", first).when(after, first).otherwise(second)
    return F.when((cut <= 1) | (cut == F.length(pair)), pair).otherwise(picked)


def josa(word: Column, pair: Column | str) -> Column:
    """The word with its particle. A word of capitals A to Z is judged by the Korean name of its last letter."""
    names = {chr(65 + i): n for i, n in enumerate(LETTER_NAMES)}
    spoken = F.when(word.rlike("^[A-Z]+$"), F.element_at(table(names), F.right(word, F.lit(1)))).otherwise(word)
    return F.when(word == "", word).otherwise(F.concat(word, pick_josa(spoken, pair)))
