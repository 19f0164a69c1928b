import pytest
from pyspark.sql import functions as F

from hanmoa.functions import keyboard as K
from hanmoa.functions import numerals as N
from hanmoa.functions import particles as J
from hanmoa.functions import pronunciation as P
from hanmoa.functions import syllables as S


def check(spark, fn, cases):
    """cases: (arguments, expected); one job for all."""
    width = len(cases[0][0])
    rows = [(i, *args) for i, (args, _) in enumerate(cases)]
    kinds = ["long" if isinstance(a, int) else "double" if isinstance(a, float) else "string" for a in cases[0][0]]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"a{k} {kinds[k]}" for k in range(width)))
    got = {r["i"]: r["o"] for r in df.select("i", fn(*(F.col(f"a{k}") for k in range(width))).alias("o")).collect()}
    assert [got[i] for i in range(len(cases))] == [e for _, e in cases]


def test_disassemble(spark):
    check(spark, S.disassemble, [(("값",), "ㄱㅏㅂㅅ"), (("ㅘ",), "ㅗㅏ"), (("",), ""), (("까",), "ㄲㅏ"), ((None,), None), (("😀a값",), "😀aㄱㅏㅂㅅ")])
    check(spark, lambda c: S.disassemble(c, keep_other=False), [(("A값!",), "ㄱㅏㅂㅅ"), (("ㄱ",), ""), (("ㄳ",), "ㄱㅅ")])
    check(spark, lambda c: S.disassemble(c, split_vowels=False, split_finals=False), [(("꽉값",), "ㄲㅘㄱㄱㅏㅄ")])
    check(spark, S.disassemble_to_groups, [(("값a",), [["ㄱ", "ㅏ", "ㅂ", "ㅅ"], ["a"]]), (("",), [])])


def test_assemble(spark):
    check(
        spark,
        S.assemble,
        [
            (("ㄱㅏㅂㅅ",), "값"), (("아버지가 방ㅇㅔ",), "아버지가 방에"), (("가ㄱ",), "가ㄱ"), (("ㅇㅏㅂㅓㅈㅣ",), "아버지"),
            (("ㄱㅗㅏㅣ",), "과ㅣ"), (("ㄱㅏㅂㅅㅏ",), "갑사"), (("ㄱㅏㅄㅏ",), "갑사"), (("ㄳㅏ",), "ㄳㅏ"), (("ㅏㄱ",), "ㅏㄱ"),
            (("ㄱㅏㄸㅏ",), "가따"), (("ㄷㅏㄹㄱㅣ",), "달기"), (("ㄷㅏㄹㄱ",), "닭"), (("ㄱㄱㅏ",), "ㄱ가"), (("",), ""), (("a\nㄱㅏ",), "a\n가"),
            (("ㄱㅏㄱㄱㅅ",), "각ㄱㅅ"), (("ㅡㅣㅡ",), "ㅡㅣㅡ"),
        ],
    )


def test_every_syllable_comes_back(spark):
    df = spark.range(0xAC00, 0xD7A4).select(F.decode(F.unhex(F.hex("id")), "UTF-16BE").alias("s"))
    d = S.decompose(F.col("s"))
    bad = df.where((S.assemble(S.disassemble(F.col("s"))) != F.col("s")) | (S.compose_syllable(d["l"], d["v"], d["t"]) != F.col("s")))
    assert bad.count() == 0
    assert df.where(K.qwerty_to_hangul(K.hangul_to_qwerty(F.col("s"))) != F.col("s")).count() == 0


def test_choseong(spark):
    check(spark, S.get_choseong, [(("프론트엔드",), "ㅍㄹㅌㅇㄷ"), (("ㄱㄴabc값",), "ㄱㄴabcㄱ"), (("가   나\t다\n라",), "ㄱ   ㄴ\tㄷ\nㄹ")])
    check(spark, lambda c: S.get_choseong(c, whitespace="normalize"), [(("가   나\t다\n라",), "ㄱ ㄴ ㄷ ㄹ"), ((" 가 ",), "ㄱ ")])
    check(spark, lambda c: S.get_choseong(c, whitespace="remove"), [(("Swift 한글",), "Swiftㅎㄱ")])
    check(spark, lambda c: S.get_choseong(c, keep_other=False), [(("Swift 한글 123!",), "ㅎㄱ"), (("ㅏㄳ",), "ㄳ")])
    check(spark, S.get_choseong_strict, [(("띄어 쓰기 ABC",), "ㄸㅇ ㅆㄱ "), (("ᄀ",), "ㄱ")])


def test_single_letters(spark):
    check(spark, S.has_batchim, [(("값",), True), (("사과",), False), (("ㄱ",), True), (("",), False), (("값 ",), True), (("a",), False)])
    check(spark, lambda c: S.has_batchim(c, only="double"), [(("값",), True), (("각",), False)])
    check(spark, lambda c: S.has_batchim(c, only="single"), [(("각",), True), (("값",), False)])
    check(spark, lambda c: S.has_batchim(c, syllables_only=True), [(("ㄱ",), False)])
    check(spark, S.remove_last_character, [(("값",), "갑"), (("과",), "고"), (("가",), "ㄱ"), (("A",), ""), (("",), ""), (("안녕",), "안녀")])
    check(spark, S.combine_character, [(("ㄱ", "ㅏ", "ㅂㅅ"), "값"), (("x", "ㅏ", ""), "xㅏ"), (("ㄱ", "ㅗㅏ", "q"), "과")])
    check(spark, S.try_combine_character, [(("x", "ㅏ"), None), (("ㄱ", "ㅏ"), "가")])
    check(spark, S.combine_vowels, [(("ㅗ", "ㅏ"), "ㅘ"), (("ㅏ", "ㅏ"), "ㅏㅏ")])
    check(spark, S.can_be_choseong, [(("ㄱ",), True), (("ㄳ",), False)])
    check(spark, S.can_be_jungseong, [(("ㅗㅏ",), True), (("ㅏㅏ",), False)])
    check(spark, S.can_be_jongseong, [(("ㄱㅅ",), True), (("",), True), (("ㄸ",), False)])
    check(spark, lambda c: S.disassemble_complete_character(c)["jongseong"], [(("값",), "ㅂㅅ"), (("값값",), None)])
    check(spark, S.nfc_hangul, [(("한글!",), "한글!"), (("각",), "각"), (("각ᆨ",), "각ᆨ")])
    with pytest.raises(Exception, match="no syllable"):
        check(spark, S.combine_character_strict, [(("x", "ㅏ"), None)])


def test_keyboard(spark):
    check(spark, K.qwerty_to_alphabet, [(("ABC",), "ㅁㅠㅊ")])
    check(spark, K.qwerty_to_hangul, [(("ABC",), "뮻"), (("vmfhsxm",), "프론트"), (("",), "")])
    check(spark, K.hangul_to_qwerty, [(("프론트",), "vmfhsxm"), (("까ㅘ값!",), "Rkhkrkqt!")])


def test_particles(spark):
    check(
        spark,
        J.josa,
        [
            (("사과", "을/를"), "사과를"), (("값", "을/를"), "값을"), (("서울", "으로/로"), "서울로"), (("부산", "으로/로"), "부산으로"),
            (("사과", "와/과"), "사과와"), (("값", "와/과"), "값과"), (("값...", "은/는"), "값...은"), (("PDF", "을/를"), "PDF를"), (("", "을/를"), ""),
            (("3", "이/가"), "3이"), (("1", "으로/로"), "1로"), (("sing", "이/가"), "sing이"), (("HTML", "으로/로"), "HTML로"),
        ],
    )
    check(spark, J.pick_josa, [(("PDF", "을/를"), "을"), (("값", "A/B"), "A"), (("서울", "A/B"), "A"), (("x", "/가"), "/가"), (("", "이/가"), "이"), (("car", "으로/로"), "로")])


def test_numerals(spark):
    check(
        spark,
        N.number_to_hangul,
        [
            (("1234",), "천이백삼십사"), (("0001",), "일"), (("0.05",), "영점영오"), (("1,203.405",), "천이백삼점사영오"), (("-0",), "영"), (("abc",), "영"),
            (("-inf",), "마이너스무한대"), (("Infinity",), "무한대"), (("",), ""), (("10000",), "일만"), (("-1.50",), "마이너스일점오영"), ((".5",), "영점오"), (("1 2",), "영"),
        ],
    )
    check(spark, lambda c: N.number_to_hangul(c, spacing=True), [((12345,), "일만 이천삼백사십오"), ((-5,), "마이너스 오")])
    check(spark, lambda c: N.number_to_hangul(c, double=True), [((3.0,), "삼점영"), ((0.25,), "영점이오"), ((-2.5,), "마이너스이점오")])
    check(spark, N.number_to_hangul_mixed, [(("123456789",), "1억2,345만6,789"), (("-0.5",), "-0.5"), (("0",), "0")])
    check(spark, N.amount_to_hangul, [(("1,200원",), "천이백"), ((".5",), "오"), (("000",), ""), (("1.2.3",), "영"), (("x",), "영"), (("-12.50",), "십이점오")])
    check(spark, N.seosusa, [((1,), "첫째"), ((2,), "둘째"), ((20,), "스무째"), ((22,), "스물두째"), ((100,), "백째"), ((0,), "0")])
    check(spark, N.susa, [((1,), "하나"), ((23,), "스물셋"), ((100,), "백"), ((101,), "101")])
    check(spark, lambda c: N.susa(c, modifier=True), [((1,), "한"), ((20,), "스무"), ((21,), "스물한"), ((100,), "백")])
    check(spark, N.days, [((1,), "하루"), ((11,), "열하루"), ((20,), "스무날"), ((21,), "스무하루"), ((31,), "31일")])
    big = "9" * 84
    got = spark.range(1).select(N.number_to_hangul(F.lit(big)).alias("x")).first()["x"]
    assert got.startswith("구천구백구십구10^80구천구백구십구업")


def test_pronunciation(spark):
    check(
        spark,
        P.standardize_pronunciation,
        [
            (("국물",), "궁물"), (("신라",), "실라"), (("같이",), "가치"), (("좋다",), "조타"), (("깻잎",), "깬닙"), (("값",), "값"), (("a",), "a"), (("",), ""),
            (("넋이 a",), "넉씨 a"), (("학교",), "학꾜"), (("많다",), "만타"), (("축하",), "추카"), (("꽃",), "꽃"), (("꽃 밭",), "꼳 받"), (("담요",), "담뇨"),
        ],
    )
    check(spark, P.romanize, [(("한글",), "hangeul"), (("값",), "gap"), (("신라",), "silla"), (("ㄱ",), "g"), (("",), ""), (("A 국물",), "A gungmul")])
    check(spark, lambda c: P.romanize(c, literal=True), [(("국물",), "gukmul")])
    check(spark, lambda c: P.romanize(c, upper=True), [(("한글a",), "HANGEULA")])
