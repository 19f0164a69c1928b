"""Queries over cases whose results are written out by hand, in SQL too: nothing of the implementation is in the expected values.

Every part of the table takes one case by its key, so each query runs over the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hanmoa.functions import keyboard as K
from hanmoa.functions import numerals as N
from hanmoa.functions import particles as J
from hanmoa.functions import pronunciation as P
from hanmoa.functions import syllables as S
from hanmoa.operators import similarity

Value = str | int | bool | None
Query = Callable[[SparkSession, str], DataFrame]


def _quoted(v: Value) -> str:
    if v is None:
        return "NULL"
    return f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else str(v)


def _of_cases(make: Callable[..., Column], cases: list[tuple[tuple, Value]]) -> tuple[Query, str]:
    """The query that applies ``make`` to the arguments of a part's case, and its SQL, which only has what is expected."""
    columns = list(zip(*(args for args, _ in cases), strict=True))

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"))
        turn = (F.col("id") % len(cases)).cast("int")
        given = parts.select("id", *(F.get(F.array(*map(F.lit, c)), turn).alias(f"a{k}") for k, c in enumerate(columns)))
        return given.select("id", make(*(F.col(f"a{k}") for k in range(len(columns)))).alias("out"))

    kind = {str: "VARCHAR", bool: "BOOLEAN", int: "INT"}[next(type(e) for _, e in cases if e is not None)]
    expected = ", ".join(_quoted(e) for _, e in cases)
    return query, f"SELECT p_partkey AS id, ([{expected}]::{kind}[])[p_partkey % {len(cases)} + 1] AS out FROM part"


def _text(*columns: Column) -> Column:
    """Several values as one text, nulls as ``-``."""
    return F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("-")) for c in columns))


def _decomposed(c: Column) -> Column:
    d = S.decompose(c)
    return _text(d["l"], d["v"], d["t"])


def _component(c: Column) -> Column:
    d = S.disassemble_complete_character(c)
    return _text(d["choseong"], d["jungseong"], d["jongseong"])


def _sound(c: Column) -> Column:
    d = J.ending_sound(c)
    return _text(d["has_batchim"], d["is_rieul"])


def _decimal(c: Column) -> Column:
    d = N.parse_decimal(c)
    return _text(d["negative"], d["whole"], d["fraction"])


_one = lambda *values: [((a,), b) for a, b in values]

CASES: dict[str, tuple[Callable[..., Column], list[tuple[tuple, Value]]]] = {
    "is_modern_syllable": (S.is_modern_syllable, _one(("가", True), ("힣", True), ("ㄱ", False), ("a", False), ("ᄀ", False), ("1", False), (" ", False))),
    "decompose_all": (_decomposed, _one(("가", "0|0|0"), ("값", "0|0|18"), ("힣", "18|20|27"), ("뷁", "7|15|9"), ("ㄱ", "-|-|-"), ("A", "-|-|-"))),
    "disassemble_mixed": (S.disassemble, _one(("값", "ㄱㅏㅂㅅ"), ("ㅘ", "ㅗㅏ"), ("", ""), ("까", "ㄲㅏ"), ("😀a값", "😀aㄱㅏㅂㅅ"), (None, None), ("꽉 ㄳ!", "ㄲㅗㅏㄱ ㄱㅅ!"))),
    "disassemble_only_hangul": (lambda c: S.disassemble(c, keep_other=False), _one(("A값!", "ㄱㅏㅂㅅ"), ("ㄱ", ""), ("ㄳ", "ㄱㅅ"), ("한 글", "ㅎㅏㄴㄱㅡㄹ"))),
    "disassemble_whole_letters": (lambda c: S.disassemble(c, split_vowels=False, split_finals=False), _one(("꽉값", "ㄲㅘㄱㄱㅏㅄ"), ("ㄳ", "ㄳ"), ("의", "ㅇㅢ"))),
    "assemble_mixed": (
        S.assemble,
        _one(("ㄱㅏㅂㅅ", "값"), ("아버지가 방ㅇㅔ", "아버지가 방에"), ("ㄱㅗㅏㅣ", "과ㅣ"), ("ㄱㅏㅂㅅㅏ", "갑사"), ("ㄱㅏㅄㅏ", "갑사"), ("ㅏㄱ", "ㅏㄱ"), ("ㄱㅏㄸㅏ", "가따"), ("ㄷㅏㄹㄱ", "닭"), ("ㄷㅏㄹㄱㅣ", "달기"), ("ㄱㄱㅏ", "ㄱ가"), ("", ""), ("a\nㄱㅏ", "a\n가"), (None, None)),
    ),
    "combine_character_mixed": (S.combine_character, [(("ㄱ", "ㅏ", "ㅂㅅ"), "값"), (("x", "ㅏ", ""), "xㅏ"), (("ㄱ", "ㅗㅏ", "q"), "과"), (("ㅎ", "ㅣ", "ㅎ"), "힣"), ((None, "ㅏ", ""), None)]),
    "combine_character_tried": (S.try_combine_character, [(("x", "ㅏ", ""), None), (("ㄱ", "ㅏ", ""), "가"), (("ㅇ", "ㅗㅣ", "ㄴㅈ"), "왽"), (("ㄱ", "ㄱ", ""), None)]),
    "combine_character_strict": (S.combine_character_strict, [(("ㄱ", "ㅏ", ""), "가"), (("ㅂ", "ㅞ", "ㄹㄱ"), "뷁"), ((None, "ㅏ", ""), None)]),
    "combine_vowels": (S.combine_vowels, [(("ㅗ", "ㅏ"), "ㅘ"), (("ㅜ", "ㅣ"), "ㅟ"), (("ㅡ", "ㅣ"), "ㅢ"), (("ㅏ", "ㅏ"), "ㅏㅏ"), (("ㅗ", "ㅐ"), "ㅙ"), (("ㅜ", "ㅔ"), "ㅞ")]),
    "can_be_choseong": (S.can_be_choseong, _one(("ㄱ", True), ("ㄳ", False), ("ㄲ", True), ("ㅏ", False), ("가", False), ("ㄱㅅ", False), ("", False))),
    "can_be_jungseong": (S.can_be_jungseong, _one(("ㅏ", True), ("ㅗㅏ", True), ("ㅘ", True), ("ㅏㅏ", False), ("ㄱ", False), ("", False))),
    "can_be_jongseong_mixed": (S.can_be_jongseong, _one(("ㄱㅅ", True), ("ㄳ", True), ("", True), ("ㄸ", False), ("ㅃ", False), ("ㅉ", False), ("ㅆ", True), ("ㅏ", False), ("ㅅㄱ", False))),
    "complete_character": (_component, _one(("값", "ㄱ|ㅏ|ㅂㅅ"), ("과", "ㄱ|ㅗㅏ|"), ("리", "ㄹ|ㅣ|"), ("값값", "-|-|-"), ("ㄱ", "-|-|-"), ("a", "-|-|-"), ("", "-|-|-"))),
    "choseong_spaces_normalized": (lambda c: S.get_choseong(c, whitespace="normalize"), _one(("가   나\t다\n라", "ㄱ ㄴ ㄷ ㄹ"), (" 가 ", "ㄱ "), ("가나", "ㄱㄴ"))),
    "choseong_spaces_removed": (lambda c: S.get_choseong(c, whitespace="remove"), _one(("Swift 한글", "Swiftㅎㄱ"), ("가   나\t다\n라", "ㄱㄴㄷㄹ"), ("", ""))),
    "choseong_only_hangul": (lambda c: S.get_choseong(c, keep_other=False), _one(("Swift 한글 123!", "ㅎㄱ"), ("ㅏㄳ", "ㄳ"), ("프론트엔드", "ㅍㄹㅌㅇㄷ"), (None, None))),
    "has_batchim_double": (lambda c: S.has_batchim(c, only="double"), _one(("값", True), ("각", False), ("사과", False), ("닭", True), ("있", False))),
    "has_batchim_single": (lambda c: S.has_batchim(c, only="single"), _one(("값", False), ("각", True), ("사과", False), ("값 ", False), ("강 ", True))),
    "has_batchim_strict": (lambda c: S.has_batchim(c, syllables_only=True), _one(("ㄱ", False), ("각", True), ("", False), ("a", False), (None, None))),
    "remove_last_mixed": (S.remove_last_character, _one(("값", "갑"), ("과", "고"), ("가", "ㄱ"), ("A", ""), ("", ""), ("안녕", "안녀"), ("안녕하세요 ", "안녕하세요"), ("의", "으"), ("닭", "달"))),
    "keyboard_alphabet": (K.qwerty_to_alphabet, _one(("ABC", "ㅁㅠㅊ"), ("rk R", "ㄱㅏ ㄲ"), ("1!", "1!"), ("OP", "ㅒㅖ"))),
    "keyboard_to_hangul": (K.qwerty_to_hangul, _one(("ABC", "뮻"), ("vmfhsxm", "프론트"), ("dkssud gktpdy", "안녕 하세요"), ("", ""), ("tjqltm!", "서비스!"))),
    "keyboard_to_qwerty": (K.hangul_to_qwerty, _one(("프론트", "vmfhsxm"), ("까ㅘ값!", "Rkhkrkqt!"), ("네이버", "spdlqj"), ("search", "search"), ("ㄴㄷㅁㄱ초", "search"))),
    "josa_words": (
        J.josa,
        [(("사과", "을/를"), "사과를"), (("값", "을/를"), "값을"), (("서울", "으로/로"), "서울로"), (("부산", "으로/로"), "부산으로"), (("사과", "와/과"), "사과와"), (("값", "와/과"), "값과"), (("값...", "은/는"), "값...은"), (("PDF", "을/를"), "PDF를"), (("", "을/를"), ""), (("3", "이/가"), "3이"), (("1", "으로/로"), "1로"), (("HTML", "으로/로"), "HTML로"), (("집", "이나/나"), "집이나"), (("나", "이란/란"), "나란"), (("하늘", "아/야"), "하늘아"), (("친구", "이랑/랑"), "친구랑"), (("책", "이에요/예요"), "책이에요"), (("칼", "으로써/로써"), "칼로써"), (("학생", "으로서/로서"), "학생으로서"), (("오늘", "으로부터/로부터"), "오늘로부터"), (("소", "이라/라"), "소라")],
    ),
    "josa_picked": (J.pick_josa, [(("PDF", "을/를"), "을"), (("값", "A/B"), "A"), (("사과", "A/B"), "B"), (("x", "/가"), "/가"), (("", "이/가"), "이"), (("서울", "으로/로"), "로"), (("밥", "와/과"), "과")]),
    "ending_sound": (_sound, _one(("값", "true|false"), ("서울", "true|true"), ("사과", "false|false"), ("ㄹ", "true|true"), ("ㅏ", "false|false"), ("3", "true|false"), ("8", "true|true"), ("2", "false|false"), ("HTML", "true|true"), ("king", "true|false"), ("값!?", "true|false"))),
    "number_text": (
        N.number_to_hangul,
        _one(("1234", "천이백삼십사"), ("0001", "일"), ("0.05", "영점영오"), ("1,203.405", "천이백삼점사영오"), ("-0", "영"), ("abc", "영"), ("-inf", "마이너스무한대"), ("Infinity", "무한대"), ("", ""), ("10000", "일만"), ("-1.50", "마이너스일점오영"), ("100000000", "일억"), ("1000000000000", "일조"), ("20000000000000000", "이경"), ("100010001", "일억일만일"), (None, None), (" 42 ", "사십이")),
    ),
    "number_spaced": (lambda c: N.number_to_hangul(c, spacing=True), _one(("12345", "일만 이천삼백사십오"), ("-5", "마이너스 오"), ("100000001", "일억 일"), ("7", "칠"))),
    "number_of_doubles": (lambda c: N.number_to_hangul(c.cast("double"), double=True), _one(("3.0", "삼점영"), ("0.25", "영점이오"), ("-2.5", "마이너스이점오"), ("100.5", "백점오"))),
    "number_mixed_text": (N.number_to_hangul_mixed, _one(("123456789", "1억2,345만6,789"), ("-0.5", "-0.5"), ("0", "0"), ("10000", "1만"), ("-1234567", "-123만4,567"), ("1000000000000", "1조"), ("12.50", "12.50"))),
    "number_mixed_spaced": (lambda c: N.number_to_hangul_mixed(c, spacing=True), _one(("123456789", "1억 2,345만 6,789"), ("20001", "2만 1"))),
    "amount_text": (N.amount_to_hangul, _one(("1,200원", "천이백"), (".5", "오"), ("x", "영"), ("-12.50", "십이점오"), ("KRW 10,000", "일만"))),
    "parse_decimal": (_decimal, _one(("12", "false|12|"), ("-1,203.405", "true|1203|405"), ("+.5", "false|0|5"), ("1_000", "false|1000|"), ("abc", "-|-|-"), ("", "-|-|-"), ("1.2.3", "-|-|-"), (".", "-|-|-"))),
    "large_unit": (N.large_unit, [((i,), u) for i, u in enumerate("|만|억|조|경|해|자|양|구|간|정|재|극|항하사|아승기|나유타|불가사의|무량대수|겁|업|10^80|10^84".split("|"))]),
    "infinite_number": (lambda c: N.infinity(c, False, True), _one(("inf", "무한대"), ("+Infinity", "무한대"), ("-INF", "마이너스 무한대"), ("1", None), ("infinite", None))),
    "ordinals": (N.seosusa, [((i,), w) for i, w in ((1, "첫째"), (2, "둘째"), (3, "셋째"), (11, "열한째"), (20, "스무째"), (22, "스물두째"), (99, "아흔아홉째"), (100, "백째"), (0, "0"))]),
    "native_numbers": (N.susa, [((i,), w) for i, w in ((1, "하나"), (20, "스물"), (23, "스물셋"), (55, "쉰다섯"), (99, "아흔아홉"), (100, "백"), (101, "101"), (0, "0"))]),
    "native_modifiers": (lambda c: N.susa(c, modifier=True), [((i,), w) for i, w in ((1, "한"), (2, "두"), (3, "세"), (4, "네"), (20, "스무"), (21, "스물한"), (100, "백"))]),
    "native_days": (N.days, [((i,), w) for i, w in ((1, "하루"), (2, "이틀"), (11, "열하루"), (15, "열닷새"), (20, "스무날"), (21, "스무하루"), (30, "서른날"), (31, "31일"))]),
    "pronunciation_words": (
        P.standardize_pronunciation,
        _one(("국물", "궁물"), ("신라", "실라"), ("같이", "가치"), ("좋다", "조타"), ("깻잎", "깬닙"), ("값", "값"), ("a", "a"), ("", ""), ("넋이 a", "넉씨 a"), ("학교", "학꾜"), ("많다", "만타"), ("축하", "추카"), ("담요", "담뇨"), ("굳이", "구지"), ("칼날", "칼랄"), ("독립", "동닙"), ("놓는", "논는"), ("옷이", "오시"), ("국밥", "국빱"), ("밥물", "밤물"), (None, None)),
    ),
    "romanized_words": (P.romanize, _one(("한글", "hangeul"), ("값", "gap"), ("신라", "silla"), ("ㄱ", "g"), ("", ""), ("A 국물", "A gungmul"), ("부산", "busan"), ("독립", "dongnip"), ("가", "ga"), ("울산", "ulsan"))),
    "romanized_letters": (lambda c: P.romanize(c, literal=True), _one(("국물", "gukmul"), ("가", "ga"), ("한글", "hangeul"))),
    "romanized_capitals": (lambda c: P.romanize(c, upper=True), _one(("한글a", "HANGEULA"), ("신라", "SILLA"))),
    "composed_keys": (similarity.canonical, _one(("ABC", "abc"), ("한", "한"), ("가", "가"), ("한글!", "한글!"), (None, None))),
    "typed_keys": (similarity.key_string, _one(("프론트!", "vmfhsxm"), ("검색 1", "rjator1"), ("Search", "search"), ("값", "rkqt"), ("", ""), ("네", "sp"))),
}

MADE = {name: _of_cases(*case) for name, case in CASES.items()}
QUERIES: dict[str, Query] = {name: query for name, (query, _) in MADE.items()}
ORACLES: dict[str, str] = {name: sql for name, (_, sql) in MADE.items()}
