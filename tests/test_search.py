import pytest
from pyspark.sql import functions as F

from hanmoa.operators.search import HangulIndex, SearchPolicy
from hanmoa.operators.similarity import SimilarityOptions, search_similar, search_with_fallback, typing_distances


def items(spark, names):
    return spark.createDataFrame(list(enumerate(names)), "id long, name string")


def ids(df):
    return [r["id"] for r in df.collect()]


@pytest.mark.parametrize("policy", [SearchPolicy(), SearchPolicy("ngram", 2)])
def test_search(spark, policy):
    index = HangulIndex(items(spark, ["프론트", "프론트엔드", "백엔드", None]), "name", "id", policy)
    assert ids(index.search("ㅍㄹㅌ", "prefix")) == [0, 1]
    assert ids(index.search("ㅍㄹㅌ", "exact")) == [0]
    assert ids(index.search("ㅇㄷ")) == [1, 2]
    assert ids(index.search("ㄷ")) == [1, 2]
    assert ids(index.search("")) == []
    assert ids(index.search("없음")) == []
    q = spark.createDataFrame([(1, "ㅇㄷ"), (2, "프론"), (3, "")], "qid int, query string")
    assert sorted((r["qid"], r["idx"]) for r in index.search_all(q).collect()) == [(1, 1), (1, 2), (2, 0), (2, 1)]


def test_limits_and_cache(spark):
    index = HangulIndex(items(spark, ["가", "나", "가나"]), "name", "id", SearchPolicy(max_candidate_scan=2, max_query_length=1, cache_size=1))
    assert ids(index.search("ㄱ")) == [0]
    assert ids(index.search("ㄱㄴ")) == [0] and index.cache_hits == 1
    assert ids(index.search("ㄴ")) == [1] and len(index._cache) == 1
    with pytest.raises(ValueError):
        index.search("ㄱ", "like")


NAMES = ["검색", "결제", "프론트엔드", "데이터베이스", "네이버", "search", "로그인", "회원가입", "서비스"]
TYPOS = ["검삭", "결재", "vmfhsxmdpsem", "데이터베스", "spdlqj", "ㄴㄷㅁㄱ초", "로근인", "회언가입", "서비스"]


def test_similar(spark):
    index = HangulIndex(items(spark, NAMES), "name", "id")
    q = spark.createDataFrame(list(enumerate(TYPOS)), "qid long, query string")
    got = search_similar(index, q, SimilarityOptions(limit=5), explain=True).collect()
    first = {r["qid"]: r for r in got if r["rank"] == 1}
    assert sum(first[i]["idx"] == i for i in range(9)) >= 7
    assert first[5]["matched_query"] == "search" and first[8]["score"] == 1.0 and first[0]["score"] > 0.5
    assert first[0]["detail"]["edit_distance"] == 1
    again = search_similar(HangulIndex(items(spark, NAMES), "name", "id"), q, SimilarityOptions(limit=5, candidates=1)).collect()
    assert {(r["qid"], r["rank"], r["idx"]) for r in again} == {(r["qid"], r["rank"], r["idx"]) for r in got}


def test_prefilter_keeps_strong(spark):
    df = spark.range(3000).select("id", F.concat(F.lit("데이터플랫폼-"), F.col("id").cast("string")).alias("name"))
    df = df.unionAll(items(spark, ["프론트엔드"]).withColumn("id", F.lit(99999).cast("long")))
    q = spark.createDataFrame([(0, "vmfhsxmdpsem")], "qid long, query string")
    got = search_similar(HangulIndex(df, "name", "id"), q, SimilarityOptions(limit=5, candidates=50)).collect()
    assert got[0]["idx"] == 99999


def test_fallback(spark):
    index = HangulIndex(items(spark, NAMES), "name", "id")
    q = spark.createDataFrame([(0, " ㅇㄷ"), (1, "vmfhsxmdpsem"), (2, " ")], "qid long, query string")
    got = {(r["qid"], r["idx"]): r["similar"] for r in search_with_fallback(index, q).where("place = 1").collect()}
    assert got == {(0, 2): False, (1, 2): True}


def test_typing_distance():
    assert typing_distances(["", "a", "ab", "we"], ["abc", "a", "an", "ee"]).tolist() == [3.0, 0.0, 0.35, 0.65]
