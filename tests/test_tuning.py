from hanmoa.operators import tuning
from hanmoa.operators.search import HangulIndex, SearchPolicy
from hanmoa.operators.similarity import SimilarityOptions, Weights, score_pairs

NAMES, TYPOS = ["가나", "가다", "나나", "다나"], ["가라", "나나", "가나다"]
WEIGHTS = [Weights(), Weights(0.01, 1.0, 0.01, 0.01, 0.0, 0.0)]


def brute_force(items, samples, scores, limit):
    """(top1, top3, mrr, hit_rate): every sample against every item that shares a syllable with it, here the same as an onset."""
    ranks = []
    for query, expected in samples:
        order = sorted((-scores[query, name], i, name) for i, name in items if set(query or "") & set(name))[:limit]
        ranks.append(next((r for r, x in enumerate(order, 1) if x[2] == expected), None))
    share = lambda rows: sum(rows) / len(ranks)
    return share(r == 1 for r in ranks), share(r is not None and r <= 3 for r in ranks), share(1 / r for r in ranks if r), share(r is not None for r in ranks)


def test_copies_are_scored_once(spark, monkeypatch):
    items = [(i * 7 % 200, NAMES[i % 7 % 4]) for i in range(200)] + [(500, "라라")]
    samples = [(q, e) for q in TYPOS for e in NAMES[:3]] * 20 + [(None, "가나"), ("가라", None), ("가라", "없음")]
    pairs = []

    def counted(*a, f=tuning.candidates):
        pairs.append((out := f(*a)).count())
        return out

    monkeypatch.setattr(tuning, "candidates", counted)
    index = HangulIndex(spark.createDataFrame(items, "id long, name string"), "name", "id", SearchPolicy("lazy"))
    asked = spark.createDataFrame(samples, "query string, expected_key string")
    crossed = spark.createDataFrame([(q, n) for q in TYPOS for n in {n for _, n in items}], "q string, n string")
    scores = [
        {(r["q"], r["n"]): r["score"] for r in score_pairs(crossed, "q", "n", SimilarityOptions(weights=w)).select("q", "n", "score").collect()} for w in WEIGHTS
    ]
    for limit in (2, 60):  # one name's copies fill all places, and then not
        got = tuning.evaluate(index, asked, WEIGHTS, SimilarityOptions(limit=limit, layouts=False, candidates=1 << 30, minimum=0.0))
        for m, by_pair in zip(got, scores, strict=True):
            expect = brute_force(items, samples, by_pair, limit)
            assert m.samples == len(samples) and all(abs(a - b) < 1e-12 for a, b in zip((m.top1, m.top3, m.mrr, m.hit_rate), expect, strict=True))
    assert max(pairs) <= len(TYPOS) * (len(NAMES) + 1)
