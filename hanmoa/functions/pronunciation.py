"""Standard pronunciation and romanisation.

Every rule looks at one boundary, the final of a syllable and the onset of the next, and changes no more than these
two. Boundaries are therefore independent: what comes of one is a table over (final, next onset, class of the
vowel before, class of the vowel after), worked out once from the rules and looked up for all boundaries of a text
within the JVM. Finals are neutralised afterwards, where no vowel follows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from hanmoa.functions.jamo import FINAL_PAIRS, FINALS, ONSETS, VOWELS, chars, compose, final, is_syllable, numbers, onset, strings, table, vowel
from hanmoa.functions.syllables import nfc_hangul

# Fixed values of the rules.
EXCEPTIONS = {"베갯잇": "베갠닏", "깻잎": "깬닙", "나뭇잎": "나문닙", "도리깻열": "도리깬녈", "뒷윷": "뒨뉻", "전역": "저녁"}
TENSE = dict(zip("ㄱㄷㅂㅅㅈ", "ㄲㄸㅃㅆㅉ", strict=True))
TENSING = set("ㄱㄲㅋㄳㄺㄷㅅㅆㅈㅊㅌㅂㅍㄼㄿㅄ")
PALATAL = {("ㄷ", "ㅇ"): ("", "ㅈ"), ("ㅌ", "ㅇ"): ("", "ㅊ"), ("ㄾ", "ㅇ"): ("ㄹ", "ㅊ"), ("ㄷ", "ㅎ"): ("", "ㅊ")}
NASAL = {**dict.fromkeys("ㄱㄲㅋㄳㄺ", "ㅇ"), **dict.fromkeys("ㄷㅅㅆㅈㅊㅌㅎ", "ㄴ"), **dict.fromkeys("ㅂㅍㅄㄼㄿ", "ㅁ")}
RIEUL_TO_NIEUN = set("ㅁㅇㄱㅂ")
ASPIRATED_AFTER_HIEUT = dict(zip("ㄱㄷㅈㅅ", "ㅋㅌㅊㅆ", strict=True))
ASPIRATED_BEFORE_HIEUT = dict(zip("ㄱㄷㅂㅈ", "ㅋㅌㅍㅊ", strict=True))
INSERTING_VOWELS, PLAIN_VOWELS = set("ㅑㅕㅛㅠㅣㅒㅖ"), set("ㅏㅐㅓㅔㅗㅜㅟ")
INSERTING_NIEUN = set("ㄱㄴㄷㅁㅂㅇ")
SIMPLIFIED = dict(zip("ㄳㄵㄶㄺㄻㄼㄽㄾㄿㅀㅄ", "ㄱㄴㄴㄱㅁㄹㄹㄹㄹㄹㅂ", strict=True))
NEUTRAL = {**dict.fromkeys("ㄲㅋㄳㄺ", "ㄱ"), **dict.fromkeys("ㅅㅆㅈㅊㅌㅎ", "ㄷ"), **dict.fromkeys("ㄵㄶ", "ㄴ"), "ㄻ": "ㅁ", **dict.fromkeys("ㄼㄿㅄㅍ", "ㅂ"), **dict.fromkeys("ㄽㄾㅀ", "ㄹ")}
ROMAN_ONSETS = ["g", "kk", "n", "d", "tt", "r", "m", "b", "pp", "s", "ss", "", "j", "jj", "ch", "k", "t", "p", "h"]
ROMAN_VOWELS = ["a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo", "u", "wo", "we", "wi", "yu", "eu", "ui", "i"]
ROMAN_FINALS = ["", "k", "k", "k", "n", "n", "n", "t", "l", "k", "m", "p", "l", "l", "p", "l", "m", "p", "p", "t", "t", "ng", "t", "t", "k", "t", "p", "t"]


@dataclass(frozen=True)
class PronunciationOptions:
    """Which rules apply. Insertion of ㄴ and ㄹ always does."""

    tensification: bool = True
    palatalization: bool = True
    nasalization: bool = True
    lateralization: bool = True
    hieut: bool = True
    obstruent_before_hieut: bool = True
    liaison: bool = True
    neutralization: bool = True


#: Classes of the vowel after a boundary: ㅣ without and with a final, another that inserts, any other.
_AFTER = [("ㅣ", True), ("ㅣ", False), ("ㅑ", False), ("ㅏ", False)]


def _insert(t: str, l: str, plain: bool, after: str, open_end: bool) -> tuple[str, str]:  # noqa: E741
    """ㄴ or ㄹ before a y-vowel or ㅣ; otherwise a compound final gets simpler, or the final moves on."""
    if not t or l != "ㅇ" or after not in INSERTING_VOWELS or (after == "ㅣ" and open_end and t not in FINAL_PAIRS):
        return t, l
    if plain:
        if t in INSERTING_NIEUN:
            return ("ㅇ" if t == "ㄱ" else t), "ㄴ"
        return t, "ㄹ" if t == "ㄹ" else l
    if t in SIMPLIFIED:
        return SIMPLIFIED[t], l
    return t, t if t in ONSETS else l


def _after_hieut(t: str, l: str) -> tuple[str, str]:  # noqa: E741
    kept = "" if t == "ㅎ" else FINAL_PAIRS[t][0] if t in ("ㄶ", "ㅀ") else None
    if kept is None:
        return t, l
    if l in ASPIRATED_AFTER_HIEUT:
        return kept, ASPIRATED_AFTER_HIEUT[l]
    return (kept or "ㄴ", l) if l == "ㄴ" else (t, l)


def _move(t: str, l: str) -> tuple[str, str]:  # noqa: E741
    """The final, or the second half of a compound one, goes to a silent onset."""
    if not t or l != "ㅇ" or t == "ㅇ":
        return t, l
    if t in FINAL_PAIRS:
        stays, moves = FINAL_PAIRS[t]
        return stays, "ㅆ" if moves == "ㅅ" else moves
    return "", t


def boundary(t: str, l: str, plain: bool, after: str, open_end: bool, o: PronunciationOptions) -> tuple[str, str]:  # noqa: E741
    """Final and next onset after all rules, in their order."""
    if o.tensification and t in TENSING:
        l = TENSE.get(l, l)  # noqa: E741
    if o.palatalization and after == "ㅣ":
        t, l = PALATAL.get((t, l), (t, l))  # noqa: E741
    t, l = _insert(t, l, plain, after, open_end)  # noqa: E741
    if o.nasalization:
        if l == "ㄹ" and t in RIEUL_TO_NIEUN:
            l = "ㄴ"  # noqa: E741
        if l in ("ㄴ", "ㅁ"):
            t = NASAL.get(t, t)
    if o.lateralization and (t, l) in (("ㄴ", "ㄹ"), ("ㄹ", "ㄴ")):
        t = l = "ㄹ"  # noqa: E741
    if o.hieut:
        t, l = _after_hieut(t, l)  # noqa: E741
    if o.obstruent_before_hieut and l == "ㅎ" and t in ASPIRATED_BEFORE_HIEUT:
        t, l = "", ASPIRATED_BEFORE_HIEUT[t]  # noqa: E741
    return _move(t, l) if o.liaison else (t, l)


@lru_cache
def _boundaries(o: PronunciationOptions) -> list[int]:
    """Final * 19 + onset for each (final, onset, plain, class after)."""
    out = []
    for t in FINALS:
        for l in ONSETS:  # noqa: E741
            for plain in (False, True):
                for after, open_end in _AFTER:
                    t2, l2 = boundary(t, l, plain, after, open_end, o)
                    out.append(FINALS.index(t2) * 19 + ONSETS.index(l2))
    return out


def standardize_pronunciation(s: Column, options: PronunciationOptions | None = None) -> Column:
    """Korean text as it is pronounced. Conjoining letters are composed first; a single character stays as it is."""
    o = options or PronunciationOptions()
    plain = [int(v in PLAIN_VOWELS) for v in VOWELS]
    kind = [0 if v == "ㅣ" else 2 if v in INSERTING_VOWELS else 3 for v in VOWELS]
    whole = nfc_hangul(s)
    cs = chars(whole)
    # arrays of each code point's parts; -1 where it is no syllable
    parts = F.transform(cs, lambda c: F.when(is_syllable(c), F.ascii(c) - 0xAC00).otherwise(-1))

    def met(i: Column, codes: Column) -> Column:
        """What the boundary behind i becomes, or null."""
        a, b = F.get(codes, i), F.get(codes, i + 1)
        after = F.get(F.lit(kind), F.floor(b % 588 / 28).cast("int"))
        after = F.when((after == 0) & (b % 28 != 0), 1).otherwise(after)
        key = ((a % 28 * 19 + F.floor(b / 588)) * 2 + F.get(F.lit(plain), F.floor(a % 588 / 28).cast("int"))) * 4 + after
        return F.when((a >= 0) & (b >= 0), F.get(numbers(_boundaries(o)), key.cast("int")))

    every = F.sequence(F.lit(-1), F.size(cs) - 1)
    met_all = F.transform(every, lambda i: met(i, parts))  # met_all[i] is the boundary before i
    neutral = [FINALS.index(NEUTRAL.get(t, t)) for t in FINALS]
    silent = ONSETS.index("ㅇ")

    def spell(data: Column, i: Column) -> Column:
        code, before, behind = F.get(data["parts"], i), F.get(data["met"], i), F.get(data["met"], i + 1)
        l = F.coalesce(before % 19, F.floor(code / 588)).cast("int")  # noqa: E741
        t = F.coalesce(F.floor(behind / 19), code % 28).cast("int")
        following = F.coalesce(behind % 19, F.lit(-1))
        if o.neutralization:
            t = F.when(following == silent, t).otherwise(F.get(F.lit(neutral), t))
        return F.when(code >= 0, compose(l, F.floor(code % 588 / 28).cast("int"), t)).otherwise(F.get(data["chars"], i))

    data = F.struct(cs.alias("chars"), parts.alias("parts"), met_all.alias("met"))
    # the struct is bound once, as the only element of an array, so that no part is worked out again for each character
    spelled = F.get(
        F.transform(F.array(data), lambda d: F.array_join(F.transform(F.sequence(F.lit(0), F.size(d["chars"]) - 1), lambda i: spell(d, i)), "")), F.lit(0)
    )
    out = F.when(F.length(whole) > 1, spelled).otherwise(whole)
    return F.coalesce(F.element_at(table(EXCEPTIONS), s), out)


def romanize(s: Column, literal: bool = False, upper: bool = False) -> Column:
    """Korean text in Latin letters, by its pronunciation without tensed onsets or letter by letter."""
    source = nfc_hangul(s) if literal else standardize_pronunciation(s, PronunciationOptions(tensification=False))
    alone = dict(zip(ONSETS, ROMAN_ONSETS, strict=True)) | dict(zip(VOWELS, ROMAN_VOWELS, strict=True))

    def one(cs: Column, i: Column) -> Column:
        c, before = F.get(cs, i), F.get(cs, i - 1)
        after_rieul = F.coalesce(is_syllable(before) & (final(before) == FINALS.index("ㄹ")), F.lit(False))
        l = F.when((onset(c) == ONSETS.index("ㄹ")) & after_rieul, "l").otherwise(F.get(strings(ROMAN_ONSETS), onset(c)))  # noqa: E741
        syllable = F.concat(l, F.get(strings(ROMAN_VOWELS), vowel(c)), F.get(strings(ROMAN_FINALS), final(c)))
        return F.when(is_syllable(c), syllable).otherwise(F.coalesce(F.element_at(table(alone), c), c))

    spelled = F.get(
        F.transform(F.array(chars(source)), lambda cs: F.array_join(F.transform(F.sequence(F.lit(0), F.size(cs) - 1), lambda i: one(cs, i)), "")), F.lit(0)
    )
    out = F.when(source == "", source).otherwise(spelled)
    return F.upper(out) if upper else out
