"""What the queries' SQL knows of the script: from Unicode's own names, and number words and keys written out apart from the implementation."""

from __future__ import annotations

from unicodedata import lookup, name


def _letters(kind: str, first: int, n: int) -> list[str]:
    """Letters that stand alone, by the names of the conjoining ones."""
    return [name(chr(first + i)).removeprefix(f"HANGUL {kind} ") for i in range(n)]


def _letter(named: str) -> str:
    return lookup(f"HANGUL LETTER {named}")


_FINAL_NAMES = _letters("JONGSEONG", 0x11A8, 27)
ONSETS = list(map(_letter, _letters("CHOSEONG", 0x1100, 19)))
VOWELS = list(map(_letter, _letters("JUNGSEONG", 0x1161, 21)))
FINALS = ["", *map(_letter, _FINAL_NAMES)]
FINAL_PAIRS = {_letter(n): "".join(map(_letter, n.split("-"))) for n in _FINAL_NAMES if "-" in n}
# The names of compound vowels' halves.
_HALVES = {"WA": "O A", "WAE": "O AE", "OE": "O I", "WEO": "U EO", "WE": "U E", "WI": "U I", "YI": "EU I"}
VOWEL_PAIRS = {_letter(n): "".join(map(_letter, h.split())) for n, h in _HALVES.items()}

# The rows of the standard layout, and the keys that differ under shift.
_ROWS = zip("qwertyuiopasdfghjklzxcvbnm", "ㅂㅈㄷㄱㅅㅛㅕㅑㅐㅔㅁㄴㅇㄹㅎㅗㅓㅏㅣㅋㅌㅊㅍㅠㅜㅡ", strict=True)
_SHIFTED = dict(zip("QWERTOP", "ㅃㅉㄸㄲㅆㅒㅖ", strict=True))
_PLAIN = dict(_ROWS)
TYPED = _PLAIN | {k.upper(): j for k, j in _PLAIN.items()} | _SHIFTED
KEY_OF = {j: k for k, j in (_PLAIN | _SHIFTED).items()}

# Digits, native numbers, their forms before a noun and in ordinals, and days.
DIGITS = "영 일 이 삼 사 오 육 칠 팔 구".split()
ONES = ["", *"하나 둘 셋 넷 다섯 여섯 일곱 여덟 아홉".split()]
TENS = ["", *"열 스물 서른 마흔 쉰 예순 일흔 여든 아흔 백".split()]
MODIFIERS = ["", *"한 두 세 네 다섯 여섯 일곱 여덟 아홉".split()]
ORDINALS = ["", *"한 두 셋 넷 다섯 여섯 일곱 여덟 아홉".split()]
DAYS = ["", *"하루 이틀 사흘 나흘 닷새 엿새 이레 여드레 아흐레".split()]
