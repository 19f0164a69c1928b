"""Taking Korean text apart and putting it together again. A null argument gives a null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hanmoa.functions.jamo import (
    CONSONANTS, FINAL_PAIRS, FINALS, ONSETS, SPACE, SYLLABLES, VOWEL_PAIRS, VOWELS,
    chars, compose, final, is_syllable, onset, strings, table, trim_space, vowel,
)

_ONSET_OF = "".join(ONSETS[i // 588] for i in range(len(SYLLABLES)))
#: Conjoining onsets of the Unicode block Hangul Jamo.
_CONJOINING = "".join(map(chr, range(0x1100, 0x1113)))


def is_modern_syllable(c: Column) -> Column:
    """Whether the first code point is a composed syllable."""
    return is_syllable(c)


def decompose(c: Column) -> Column:
    """struct<l, v, t> of the first code point; null if it is no composed syllable."""
    return F.when(is_syllable(c), F.struct(onset(c).alias("l"), vowel(c).alias("v"), final(c).alias("t")))


def compose_syllable(l: Column, v: Column, t: Column) -> Column:  # noqa: E741
    """The syllable of onset, vowel and final index; null if one is out of range."""
    return compose(l, v, t)


def choseongs() -> Column:
    """The 19 onsets."""
    return strings(ONSETS)


def jungseongs() -> Column:
    """The 21 vowels."""
    return strings(VOWELS)


def jongseongs() -> Column:
    """The 28 finals, of which the first is empty."""
    return strings(FINALS)


def _parts(split_vowels: bool, split_finals: bool) -> tuple[list[str], list[str]]:
    return (
        [VOWEL_PAIRS.get(v, v) if split_vowels else v for v in VOWELS],
        [FINAL_PAIRS.get(t, t) if split_finals else t for t in FINALS],
    )


def _alone(split_vowels: bool, split_finals: bool) -> dict[str, str]:
    return (VOWEL_PAIRS if split_vowels else {}) | (FINAL_PAIRS if split_finals else {})


def disassemble(s: Column, split_vowels: bool = True, split_finals: bool = True, keep_other: bool = True) -> Column:
    """Letters of all syllables. Without ``keep_other`` only syllables and compound letters that are split remain."""
    vowels, finals = _parts(split_vowels, split_finals)
    alone = _alone(split_vowels, split_finals)

    def one(c: Column) -> Column:
        letters = F.concat(F.get(strings(ONSETS), onset(c)), F.get(strings(vowels), vowel(c)), F.get(strings(finals), final(c)))
        pair = F.element_at(table(alone), c) if alone else F.lit(None).cast("string")
        return F.when(is_syllable(c), letters).otherwise(F.coalesce(pair, c if keep_other else F.lit("")))

    return F.array_join(F.transform(chars(s), one), "")


def disassemble_to_groups(s: Column, split_vowels: bool = True, split_finals: bool = True, keep_other: bool = True) -> Column:
    """array<array<string>>: the letters of each code point; others are a group of one, or left out."""
    vowels, finals = _parts(split_vowels, split_finals)
    alone = _alone(split_vowels, split_finals)

    def one(c: Column) -> Column:
        letters = chars(F.concat(F.get(strings(ONSETS), onset(c)), F.get(strings(vowels), vowel(c)), F.get(strings(finals), final(c))))
        pair = F.element_at(table(alone), c) if alone else F.lit(None).cast("string")
        other = F.array(c) if keep_other else F.lit([]).cast("array<string>")
        return F.when(is_syllable(c), letters).when(pair.isNotNull(), chars(pair)).otherwise(other)

    return F.filter(F.transform(chars(s), one), lambda g: F.size(g) > 0)


_V = "".join(VOWELS)
_VOWEL = "(?:" + "|".join([*VOWEL_PAIRS.values(), f"[{_V}]"]) + ")"
_PAIR = "(?:" + "|".join(FINAL_PAIRS.values()) + ")"
_DOUBLE = "".join(FINAL_PAIRS)
_L = "".join(ONSETS)
_SYLLABLE = f"[{_L}]{_VOWEL}(?:(?:{_PAIR}|[{''.join(FINALS)}])(?![{_V}]))?"
_VOWEL_INDEX = {v: i for i, v in enumerate(VOWELS)} | {p: VOWELS.index(v) for v, p in VOWEL_PAIRS.items()}
_FINAL_INDEX = {t: i for i, t in enumerate(FINALS)} | {p: FINALS.index(t) for t, p in FINAL_PAIRS.items()}


def assemble(s: Column) -> Column:
    """Letters typed one after another as syllables; what forms none, composed syllables among it, stays as it is.

    A consonant before a vowel begins a syllable; a compound final before a vowel gives its second half to it.
    """
    parted = s
    for double, pair in FINAL_PAIRS.items():
        parted = F.regexp_replace(parted, f"(?<=[{_L}]{_VOWEL}){double}(?=[{_V}])", pair)
    parted = F.when(s.rlike(f"[{_DOUBLE}][{_V}]"), parted).otherwise(s)  # seldom
    found = F.regexp_extract_all(parted, F.lit(f"(?s){_SYLLABLE}|."), F.lit(0))

    def one(token: Column) -> Column:
        inner = F.regexp_extract(token, f"^.({_VOWEL})", 1)
        tail = F.substring(token, F.length(inner) + 2, F.lit(2))
        whole = compose(
            F.array_position(strings(ONSETS), F.substring(token, 1, 1)).cast("int") - 1,
            F.element_at(table(_VOWEL_INDEX), inner),
            F.element_at(table(_FINAL_INDEX), tail),
        )
        return F.when(F.length(token) > 1, whole).otherwise(token)

    return F.array_join(F.transform(found, one), "")


def assemble_parts(parts: Column) -> Column:
    """As ``assemble``, of an array of fragments."""
    return assemble(F.array_join(parts, ""))


def combine_character(cho: Column, jung: Column, jong: Column | None = None) -> Column:
    """The syllable of an onset, a vowel (or pair) and a final (or pair); joined as they are if onset or vowel is none.

    What is no final counts as none.
    """
    jong = F.lit("") if jong is None else jong
    whole = compose(_onset_index(cho), _lookup(_VOWEL_INDEX, jung), F.coalesce(_lookup(_FINAL_INDEX, jong), F.lit(0)))
    return F.coalesce(whole, F.concat(cho, jung, jong))


def combine_character_strict(cho: Column, jung: Column, jong: Column | None = None) -> Column:
    """As ``combine_character``, but an onset or vowel that is none is an error."""
    tried = try_combine_character(cho, jung, jong)
    wrong = F.raise_error(F.concat(F.lit("no syllable: "), cho, F.lit(" + "), jung))
    return F.when(cho.isNull() | jung.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(tried, wrong.cast("string")))


def try_combine_character(cho: Column, jung: Column, jong: Column | None = None) -> Column:
    """As ``combine_character``, but null where an onset or vowel is none."""
    jong = F.lit("") if jong is None else jong
    return compose(_onset_index(cho), _lookup(_VOWEL_INDEX, jung), F.coalesce(_lookup(_FINAL_INDEX, jong), F.lit(0)))


def _onset_index(c: Column) -> Column:
    return _lookup({x: i for i, x in enumerate(ONSETS)}, c)


def _lookup(values: dict[str, int], key: Column) -> Column:
    return F.element_at(table(values), key)


def combine_vowels(a: Column, b: Column) -> Column:
    """The compound vowel of two, else both joined."""
    both = F.concat(a, b)
    return F.coalesce(F.element_at(table({p: v for v, p in VOWEL_PAIRS.items()}), both), both)


def can_be_choseong(s: Column) -> Column:
    return s.isin(*ONSETS)


def can_be_jungseong(s: Column) -> Column:
    """Whether it is a vowel or a pair that makes one."""
    return s.isin(*_VOWEL_INDEX)


def can_be_jongseong(s: Column) -> Column:
    """Whether it is a final, none included, or a pair that makes one."""
    return s.isin(*_FINAL_INDEX)


def disassemble_complete_character(c: Column) -> Column:
    """struct<choseong, jungseong, jongseong> of a single syllable, compounds split; else null."""
    vowels, finals = _parts(True, True)
    return F.when(
        (F.length(c) == 1) & is_syllable(c),
        F.struct(
            F.get(strings(ONSETS), onset(c)).alias("choseong"),
            F.get(strings(vowels), vowel(c)).alias("jungseong"),
            F.get(strings(finals), final(c)).alias("jongseong"),
        ),
    )


def get_choseong(s: Column, keep_other: bool = True, whitespace: str = "keep") -> Column:
    """Onsets of all syllables; single consonants stay, others if ``keep_other``.

    whitespace: ``keep``; ``normalize`` to one blank between words and none in front; ``remove``. Without
    ``keep_other`` white space goes in any case.
    """
    if whitespace not in ("keep", "normalize", "remove"):
        raise ValueError(whitespace)
    out = F.translate(s, SYLLABLES, _ONSET_OF)
    if not keep_other:
        return F.regexp_replace(out, f"[^{CONSONANTS}]", "")
    if whitespace == "remove":
        return F.regexp_replace(out, f"{SPACE}+", "")
    if whitespace == "normalize":
        return F.regexp_replace(F.regexp_replace(out, f"{SPACE}+", " "), "^ ", "")
    return out


def get_choseong_strict(s: Column) -> Column:
    """Onsets of syllables and of conjoining letters, single consonants and white space; nothing else."""
    out = F.translate(s, SYLLABLES + _CONJOINING, _ONSET_OF + "".join(ONSETS))
    return F.regexp_replace(out, f"[^{CONSONANTS}\\p{{IsWhite_Space}}]", "")


def has_batchim(word: Column, only: str | None = None, syllables_only: bool = False) -> Column:
    """Whether the last code point that isn't white space ends in a consonant; ``only`` single or double ones."""
    if only not in (None, "single", "double"):
        raise ValueError(only)
    last = F.right(F.regexp_replace(word, f"{SPACE}+$", ""), F.lit(1))
    token = F.when(is_syllable(last), F.get(strings(FINALS), final(last)))
    if not syllables_only:
        token = token.otherwise(last)
    accepted = [t for t in FINALS[1:] if only is None or (t in FINAL_PAIRS) == (only == "double")]
    return F.when(word.isNotNull(), F.coalesce(token.isin(*accepted), F.lit(False)))


def remove_last_character(s: Column) -> Column:
    """Takes back one keystroke: half a compound final, a final, half a compound vowel, a vowel, or a character."""
    last, head = F.right(s, F.lit(1)), F.left(s, F.length(s) - 1)
    fewer_t = [FINALS.index(FINAL_PAIRS[t][0]) if t in FINAL_PAIRS else 0 for t in FINALS]
    fewer_v = [VOWELS.index(VOWEL_PAIRS[v][0]) if v in VOWEL_PAIRS else -1 for v in VOWELS]
    v = F.get(F.lit(fewer_v), vowel(last))
    peeled = (
        F.when(final(last) > 0, compose(onset(last), vowel(last), F.get(F.lit(fewer_t), final(last))))
        .when(v >= 0, compose(onset(last), v, F.lit(0)))
        .otherwise(F.get(strings(ONSETS), onset(last)))
    )
    return F.when(s == "", s).when(is_syllable(last), F.concat(head, peeled)).otherwise(head)


def normalize(s: Column) -> Column:
    """Without white space and line ends at both ends."""
    return trim_space(s)


def nfc_hangul(s: Column) -> Column:
    """Composes conjoining letters to syllables, as NFC does; other characters stay."""
    token = "(?s)[ᄀ-ᄒ][ᅡ-ᅵ][ᆨ-ᇂ]?|[가-힣][ᆨ-ᇂ]|."

    def one(c: Column) -> Column:
        first, second = F.substring(c, 1, 1), F.substring(c, 2, 1)
        late = F.when(F.length(c) == 3, F.ascii(F.substring(c, 3, 1)) - 0x11A7).otherwise(0)
        fresh = compose(F.ascii(first) - 0x1100, F.ascii(second) - 0x1161, late)
        more = F.when(final(first) == 0, compose(onset(first), vowel(first), F.ascii(second) - 0x11A7)).otherwise(c)
        return F.when(F.length(c) == 1, c).when(is_syllable(first), more).otherwise(fresh)

    composed = F.array_join(F.transform(F.regexp_extract_all(s, F.lit(token), F.lit(0)), one), "")
    return F.when(s.rlike("[ᅡ-ᇂ]"), composed).otherwise(s)
