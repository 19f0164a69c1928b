"""Queries over similarity, search policies, tuning and feedback, and SQL that works their results out from the definitions.

The SQL takes nothing from the implementation: words are made of twenty syllables whose keys and onsets are written out
here, and distances, shares of grams and scores are worked out in DuckDB by their definitions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import astuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hanmoa.operators import feedback, tuning
from hanmoa.operators.search import HangulIndex, SearchPolicy
from hanmoa.operators.similarity import SimilarityOptions, Weights, score_pairs, search_similar, search_with_fallback
from hanmoa.plans.registry import _events, _table, korean
from hanmoa.sources.deployment import Config, Environment, Policy, resolve_or_default

# Four onsets with one vowel and five finals; their keys, and where the keys are.
SYLLABLES = "가각간갈감나낙난날남다닥단달담라락란랄람"
_ONSET_KEYS, _FINAL_KEYS = "['r', 's', 'e', 'f']", "['', 'r', 's', 'f', 'a']"
_KEYS = "rsefak"
_X = "[3 + 0.2::DOUBLE, 1 + 0.6::DOUBLE, 2 + 0.2::DOUBLE, 3 + 0.6::DOUBLE, 0 + 0.6::DOUBLE, 7 + 0.6::DOUBLE]"
_Y = "[1::DOUBLE, 2::DOUBLE, 1::DOUBLE, 2::DOUBLE, 2::DOUBLE, 2::DOUBLE]"


def _places(key: str, typo: bool) -> list[str]:
    """Which syllables a key's word has, and a mistyped one; arithmetic for either engine."""
    div = f"cast(floor({key} / 20) as bigint)"
    if not typo:
        return [f"({key} % 20)", f"({div} % 20)", f"(({key} * 7) % 20)"]
    return [f"(({key} + {key} % 3) % 20)", f"(({div} + {key} % 2) % 20)", f"(({key} * 7) % 20)"]


def word(key: str, typo: bool = False) -> Column:
    """Three syllables; a mistyped word of every fifth key lacks the last, that of every eleventh is right."""
    pick = lambda at: F.concat(*(F.expr(f"substring('{SYLLABLES}', cast({p} as int) + 1, 1)") for p in at))
    right, wrong = _places(key, False), _places(key, True)
    if not typo:
        return pick(right)
    return F.when(F.expr(f"{key} % 11 = 0"), pick(right)).when(F.expr(f"{key} % 5 = 0"), pick(wrong[:2])).otherwise(pick(wrong))


def _word_sql(key: str, typo: bool = False) -> str:
    """The list of the word's syllables by number."""
    pick = lambda at: f"[{', '.join(at)}]"
    right, wrong = _places(key, False), _places(key, True)
    return f"CASE WHEN {key} % 11 = 0 THEN {pick(right)} WHEN {key} % 5 = 0 THEN {pick(wrong[:2])} ELSE {pick(wrong)} END" if typo else pick(right)


def _cost(a: str, b: str) -> str:
    at = lambda c, axis: f"{axis}[instr('{_KEYS}', {c})]"
    far = f"abs({at(a, _X)} - {at(b, _X)}) + abs({at(a, _Y)} - {at(b, _Y)})"
    return f"CASE WHEN {a} = {b} THEN 0 WHEN {far} <= 1 THEN 0.35 WHEN {far} <= 2 THEN 0.65 ELSE 1 END"


def _scored_sql(pairs: str, weights: str = "(SELECT 0 AS wid, 0.35::DOUBLE AS we, 0.25::DOUBLE AS wj, 0.15::DOUBLE AS wk, 0.25::DOUBLE AS wm, 0.08::DOUBLE AS wp, 0.12::DOUBLE AS wx)") -> str:
    """All components and the score of ``pairs``, which has a and b, lists of syllables by number."""
    text = lambda w: f"array_to_string(list_transform({w}, lambda i: chr((97 + i)::INT)), '')"
    keys = lambda w: f"array_to_string(list_transform({w}, lambda i: {_ONSET_KEYS}[i // 5 + 1] || 'k' || {_FINAL_KEYS}[i % 5 + 1]), '')"
    onsets = lambda w: f"array_to_string(list_transform({w}, lambda i: {_ONSET_KEYS}[i // 5 + 1]), '')"
    grams = lambda o: f"CASE WHEN length({o}) < 2 THEN [{o}] ELSE list_distinct(list_transform(range(1, length({o})), lambda i: substr({o}, i::INT, 2))) END"
    inner = f"list_reduce(list_prepend([x[1]], list_transform(range(1, length(kb) + 1), lambda j: [j::DOUBLE])), lambda acc, y: list_append(acc, least(acc[-1] + 1, before[y[1]::INT + 1] + 1, before[y[1]::INT] + ({_cost('substr(ka, x[1]::INT, 1)', 'substr(kb, y[1]::INT, 1)')})::DOUBLE)))"
    typing = f"list_reduce(list_prepend(list_transform(range(0, length(kb) + 1), lambda j: j::DOUBLE), list_transform(range(1, length(ka) + 1), lambda i: [i::DOUBLE])), lambda before, x: {inner})[-1]"
    return f"""
WITH words AS (SELECT *, {text('a')} AS ta, {text('b')} AS tb, {keys('a')} AS ka, {keys('b')} AS kb, {onsets('a')} AS oa, {onsets('b')} AS ob FROM ({pairs})),
parts AS (SELECT *, levenshtein(ta, tb) AS edit_distance, levenshtein(ka, kb) AS jamo_distance, {typing} AS keyboard_distance,
  len(list_intersect({grams('oa')}, {grams('ob')})) AS "both", len(list_distinct(list_concat({grams('oa')}, {grams('ob')}))) AS either FROM words),
shares AS (SELECT *, greatest(0, 1 - edit_distance::DOUBLE / greatest(length(ta), length(tb))) AS sim_edit, "both"::DOUBLE / either AS sim_jaccard,
  greatest(0, 1 - keyboard_distance / greatest(length(ka), length(kb))) AS sim_keyboard, greatest(0, 1 - jamo_distance::DOUBLE / greatest(length(ka), length(kb))) AS sim_jamo,
  ta = tb AS same, starts_with(tb, ta) OR starts_with(ob, oa) AS prefix FROM parts),
cores AS (SELECT *, (sim_edit * we + sim_jaccard * wj + sim_keyboard * wk + sim_jamo * wm) / (we + wj + wk + wm) AS core_score,
  CASE WHEN same THEN wx ELSE 0 END AS exact_bonus, CASE WHEN NOT same AND prefix THEN wp ELSE 0 END AS prefix_bonus FROM shares, {weights}),
scored AS (SELECT *, least(1, greatest(0, core_score + exact_bonus + prefix_bonus)) AS score FROM cores)"""


_ROUNDED = ["keyboard_distance", "sim_edit", "sim_jaccard", "sim_keyboard", "sim_jamo", "core_score", "prefix_bonus", "exact_bonus", "score"]
_COUNTED = ["edit_distance", "jamo_distance", "both", "either"]


def similarity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every measure of each part's word and a mistyped form of it."""
    pairs = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), word("p_partkey", True).alias("typed"), word("p_partkey").alias("right"))
    out = score_pairs(pairs, "typed", "right")
    return out.select("id", *(F.col(c).cast("long").alias(c) for c in _COUNTED), *(F.round(c, 9).alias(c) for c in _ROUNDED))


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), word("s_suppkey").alias("name"))


def _typed(spark: SparkSession, sf_dir: str, every: int) -> DataFrame:
    return _table(spark, sf_dir, "supplier").where(F.col("s_suppkey") % every == 0).select(F.col("s_suppkey").alias("qid"), word("s_suppkey", True).alias("query"), word("s_suppkey").alias("name"))


#: More than there are items, so that all are scored.
ALL = 1 << 30


def ranked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three suppliers most like the mistyped name of every fiftieth, with the evidence."""
    options = SimilarityOptions(limit=3, layouts=False, candidates=ALL)
    out = search_similar(HangulIndex(_suppliers(spark, sf_dir), "name", "id", SearchPolicy("lazy")), _typed(spark, sf_dir, 50), options, explain=True)
    return out.select("qid", F.col("rank").cast("long").alias("rank"), "idx", F.round("score", 9).alias("score"), F.col("detail.jamo_distance").cast("long").alias("jamo_distance"), F.col("detail.both").cast("long").alias("both"))


def tuning_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well four weightings find the suppliers whose names were mistyped."""
    samples = _typed(spark, sf_dir, 10).select("query", F.col("name").alias("expected_key"))
    options = SimilarityOptions(limit=5, layouts=False, candidates=ALL, minimum=0.0)
    found = tuning.evaluate(HangulIndex(_suppliers(spark, sf_dir), "name", "id", SearchPolicy("lazy")), samples, [Weights(*w) for w in WEIGHTINGS], options)
    rows = [(i, m.samples, round(m.top1, 9), round(m.top3, 9), round(m.mrr, 9), round(m.hit_rate, 9), round(m.objective, 9)) for i, m in enumerate(found)]
    return spark.createDataFrame(rows, "wid int, samples long, top1 double, top3 double, mrr double, hit_rate double, objective double")


WEIGHTINGS = [(0.35, 0.25, 0.15, 0.25, 0.08, 0.12), (1.0, 0.01, 0.01, 0.01, 0.0, 0.0), (0.01, 1.0, 0.01, 0.01, 0.3, 0.0), (0.01, 0.01, 1.5, 0.5, 0.0, 0.4)]


def fallback_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers whose onsets begin with those of a query, or the most similar where there are none; at most five."""
    queries = spark.createDataFrame([(1, "가나"), (2, "ㅋ"), (3, "람람람람"), (4, " "), (5, "라")], "qid long, query string")
    options = SimilarityOptions(limit=5, layouts=False, candidates=ALL, minimum=0.0)
    index = HangulIndex(_suppliers(spark, sf_dir), "name", "id", SearchPolicy("lazy"))
    out = search_with_fallback(index, queries.where("qid != 2"), "prefix", max_results=5, options=options)
    return out.select("qid", "idx", F.col("place").cast("long").alias("place"), "similar")


def _customers(spark: SparkSession, sf_dir: str, **policy: object) -> HangulIndex:
    items = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), korean(F.col("c_custkey")).alias("name"))
    return HangulIndex(items, "name", "id", SearchPolicy(**({"strategy": "lazy"} | policy)))


def search_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items an index has, and how often its cache of results is hit."""
    index = _customers(spark, sf_dir, cache_size=2)
    for query in ("ㄱ", "ㄴ", "ㄱ", "ㄷ", "ㄴ", "ㄷ"):  # the fifth finds its result gone
        index.search(query)
    for held in index._cache.values():
        held.unpersist()
    return spark.createDataFrame([(index.count(), index.cache_hits)], "n long, hits long")


def index_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with their keys: lower-cased and composed, and onsets."""
    items = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(korean(F.col("c_custkey")), F.lit(" "), F.col("c_name"), F.lit(" \u1100\u1161\u11a8")).alias("name"))
    return HangulIndex(items, "name", "id", SearchPolicy("lazy", whitespace="remove")).table.select("id", "norm_key", "choseong_key", "idx")


def top_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary's ten most frequent pairs in order."""
    found = feedback.summary(_events(spark, sf_dir), 10).select(F.posexplode("top_pairs").alias("place", "p"))
    return found.select(F.col("place").cast("long").alias("place"), "p.occurrences", "p.last_seen", "p.query", "p.selected_key")


def uniform_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thousand numbers that tuning draws."""
    return spark.createDataFrame([(i, u) for i, u in zip(range(1000), tuning.uniforms(tuning.SEED), strict=False)], "i int, u double")


def weight_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All weights that tuning tries, in order."""
    rows = [(i, *astuple(w)) for i, w in enumerate(tuning.weight_candidates(Weights(), 80))]
    return spark.createDataFrame(rows, "i int, edit double, jaccard double, keyboard double, jamo double, prefix double, exact double")


def sanitized_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights within their limits, made from suppliers' balances."""
    balances = _table(spark, sf_dir, "supplier").orderBy("s_suppkey").select("s_suppkey", "s_acctbal").collect()  # suppliers are few by the scale
    rows = [(r["s_suppkey"], *astuple(Weights(*[r["s_acctbal"] / 1000 - k for k in range(6)]).sanitized())) for r in balances]
    return spark.createDataFrame(rows, "id long, edit double, jaccard double, keyboard double, jamo double, prefix double, exact double")


def resolved_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which environment, bucket and edit weight users get under several configurations."""
    control, treatment = Weights(0.1), Weights(9.0)
    plain = {"development": Environment(control, treatment, Policy(True, 1.0, "d")), "production": Environment(control, None, Policy(True, 4.2, " ")), "staging": Environment(control, treatment, Policy(False, 1.0, "s"))}
    asked = [("development", "u", None), ("development", None, "control"), ("production", "u", "treatment"), ("staging", "u", None), ("staging", "u", "treatment"), ("nowhere", "u", None)]
    rows = []
    for i, (environment, user, forced) in enumerate(asked):
        name, bucket, w = resolve_or_default(Config(environments=plain), environment, user, forced)
        rows.append((i, name, bucket, w.edit))
    return spark.createDataFrame(rows, "i int, environment string, bucket string, edit double")


_ONSETS19 = "['ㄱ', 'ㄲ', 'ㄴ', 'ㄷ', 'ㄸ', 'ㄹ', 'ㅁ', 'ㅂ', 'ㅃ', 'ㅅ', 'ㅆ', 'ㅇ', 'ㅈ', 'ㅉ', 'ㅊ', 'ㅋ', 'ㅌ', 'ㅍ', 'ㅎ']"
_STEPS = [(37, 11), (7919, 5), (613, 101)]
_CUSTOMER = "(SELECT c_custkey AS id, c_name, " + " || ".join(f"chr((44032 + (c_custkey * {a} + {b}) % 11172)::INT)" for a, b in _STEPS) + " AS name, " + " || ".join(f"{_ONSETS19}[((c_custkey * {a} + {b}) % 11172) // 588 + 1]" for a, b in _STEPS) + " AS onsets FROM customer)"
_PAIRS = f"SELECT q.s_suppkey AS qid, i.s_suppkey AS idx, {_word_sql('q.s_suppkey', True)} AS a, {_word_sql('i.s_suppkey')} AS b FROM supplier q, supplier i WHERE q.s_suppkey % {{}} = 0"
_TABLE = "(SELECT * FROM (VALUES " + ", ".join(f"({i}, " + ", ".join(f"{x}::DOUBLE" for x in w) + ")" for i, w in enumerate(WEIGHTINGS)) + ") t(wid, we, wj, wk, wm, wp, wx))"
_STATE = "WITH RECURSIVE s(i, state) AS (SELECT 0, ((15042058103033495553::HUGEINT * 6364136223846793005 + 1) % 18446744073709551616) UNION ALL SELECT i + 1, (state * 6364136223846793005 + 1) % 18446744073709551616 FROM s WHERE i < {n}), u AS (SELECT i, (state >> 11)::DOUBLE / 9007199254740992 AS u FROM s)"
_NAMES = ["edit", "jaccard", "keyboard", "jamo", "prefix", "exact"]
_BASE = [0.35, 0.25, 0.15, 0.25, 0.08, 0.12]


def _tuning_sql() -> str:
    """Scaled weights by position, then random ones of six draws each; the first of those that agree to four decimals stays."""
    scaled = []
    for i, factor in enumerate((0.65, 0.8, 1.0, 1.2, 1.35)):
        for j in range(5):
            scaled.append((1 + 5 * i + j, [factor if (j == 4 and k < 4) or (j < 4 and j == k) else 1.0 for k in range(6)]))
    for i, factor in enumerate((0.5, 0.8, 1.0, 1.2, 1.5)):
        scaled.append((26 + i, [1.0] * 4 + [factor] * 2))
    rows = ["SELECT 0 AS pos, " + ", ".join(f"{b}::DOUBLE AS {n}" for b, n in zip(_BASE, _NAMES, strict=True))]
    rows += [f"SELECT {pos}, " + ", ".join(f"{b}::DOUBLE * {f}::DOUBLE" for b, f in zip(_BASE, fs, strict=True)) for pos, fs in scaled]
    drawn = ", ".join(f"max({b}::DOUBLE * ({low}::DOUBLE + ({high}::DOUBLE - {low}::DOUBLE) * u)) FILTER (i % 6 = {k})" for k, (b, low, high) in enumerate((b, *((0.5, 1.5) if k < 4 else (0.2, 2.0))) for k, b in enumerate(_BASE)))
    rows.append(f"SELECT 31 + i // 6, {drawn} FROM u GROUP BY i // 6")
    clamped = ", ".join(f"least({0.5 if k > 3 else 2.0}::DOUBLE, greatest({0.0 if k > 3 else 0.01}::DOUBLE, {n})) AS {n}" for k, n in enumerate(_NAMES))
    same = ", ".join(f"round({n}, 4)" for n in _NAMES)
    return f"{_STATE.format(n=359)}, proposed AS ({' UNION ALL '.join(rows)}), held AS (SELECT pos, {clamped} FROM proposed), first AS (SELECT *, row_number() OVER (PARTITION BY {same} ORDER BY pos) AS r FROM held) SELECT (row_number() OVER (ORDER BY pos) - 1)::INT AS i, {', '.join(_NAMES)} FROM first WHERE r = 1 ORDER BY pos LIMIT 80"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "similarity_components": similarity_components,
    "ranked_names": ranked_names,
    "tuning_metrics": tuning_metrics,
    "fallback_results": fallback_results,
    "search_exact": lambda s, d: _customers(s, d).search("ㄱㄴㄷ", "exact").select("id", "name"),
    "search_capped": lambda s, d: _customers(s, d, max_candidate_scan=700).search("ㅂ").select("id", "name"),
    "search_bounded": lambda s, d: _customers(s, d, max_query_length=2).search("ㄱㄴㅋㅋㅋ", "prefix").select("id", "name"),
    "search_precomputed": lambda s, d: _customers(s, d, strategy="precompute").search("나", "prefix").select("id", "name"),
    "search_trigrams": lambda s, d: _customers(s, d, strategy="ngram", ngram=3).search("ㅅㅇㅎ").select("id", "name"),
    "search_filtered": lambda s, d: _customers(s, d).search("ㄱㅅ").where("id % 2 = 0").select("id", "name"),
    "search_counted": search_counted,
    "index_keys": index_keys,
    "top_pairs": top_pairs,
    "retention_drops": lambda s, d: feedback.dropped(_events(s, d), F.lit("2024-01-20 00:00:00").cast("timestamp"), 10 * 86400, 1000),
    "uniform_numbers": uniform_numbers,
    "weight_candidates": weight_candidates,
    "sanitized_weights": sanitized_weights,
    "resolved_weights": resolved_weights,
}
ORACLES: dict[str, str] = {
    "similarity_components": _scored_sql(f"SELECT p_partkey AS id, {_word_sql('p_partkey', True)} AS a, {_word_sql('p_partkey')} AS b FROM part")
    + " SELECT id, " + ", ".join(f'"{c}"::BIGINT AS "{c}"' for c in _COUNTED) + ", " + ", ".join(f"round({c}::DOUBLE, 9) AS {c}" for c in _ROUNDED) + " FROM scored",
    "ranked_names": _scored_sql(_PAIRS.format(50)) + " SELECT qid, rank, idx, round(score, 9) AS score, jamo_distance::BIGINT AS jamo_distance, \"both\"::BIGINT AS \"both\" FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) AS rank FROM scored WHERE score >= 0.2) WHERE rank <= 3",
    "tuning_metrics": _scored_sql(_PAIRS.format(10), _TABLE)
    + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY wid, qid ORDER BY score DESC, idx) AS rank FROM scored), hit AS (SELECT wid, qid, min(rank) AS rank FROM ranked JOIN (SELECT s_suppkey AS qid, " + _word_sql("s_suppkey") + " AS expected FROM supplier) USING (qid) WHERE rank <= 5 AND b = expected GROUP BY ALL),"
    " sums AS (SELECT wid::INT AS wid, n AS samples, count(*) FILTER (rank = 1) / n AS top1, count(*) FILTER (rank <= 3) / n AS top3, sum(1 / rank) / n AS mrr, count(*) / n AS hit_rate FROM hit, (SELECT count(*) AS n FROM supplier WHERE s_suppkey % 10 = 0) GROUP BY wid, n)"
    " SELECT wid, samples, round(top1, 9) AS top1, round(top3, 9) AS top3, round(mrr, 9) AS mrr, round(hit_rate, 9) AS hit_rate, round(mrr * 0.5 + top1 * 0.35 + top3 * 0.15, 9) AS objective FROM sums",
    "fallback_results": _scored_sql(f"SELECT qid, s_suppkey AS idx, q AS a, {_word_sql('s_suppkey')} AS b FROM supplier, (VALUES (1, [0, 5]::BIGINT[]), (3, [19, 19, 19, 19]::BIGINT[]), (5, [15]::BIGINT[])) t(qid, q)")
    + ", exact AS (SELECT qid, idx, row_number() OVER (PARTITION BY qid ORDER BY idx) AS place FROM scored WHERE starts_with(ob, oa)), likely AS (SELECT qid, idx, row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx) AS place FROM scored WHERE qid NOT IN (SELECT qid FROM exact))"
    " SELECT qid::BIGINT AS qid, idx, place, false AS \"similar\" FROM exact WHERE place <= 5 UNION ALL SELECT qid::BIGINT, idx, place, true FROM likely WHERE place <= 5",
    "search_exact": f"SELECT id, name FROM {_CUSTOMER} WHERE onsets = 'ㄱㄴㄷ'",
    "search_capped": f"SELECT id, name FROM (SELECT * FROM {_CUSTOMER} ORDER BY id LIMIT 700) WHERE contains(onsets, 'ㅂ')",
    "search_bounded": f"SELECT id, name FROM {_CUSTOMER} WHERE starts_with(onsets, 'ㄱㄴ')",
    "search_precomputed": f"SELECT id, name FROM {_CUSTOMER} WHERE starts_with(onsets, 'ㄴ')",
    "search_trigrams": f"SELECT id, name FROM {_CUSTOMER} WHERE contains(onsets, 'ㅅㅇㅎ')",
    "search_filtered": f"SELECT id, name FROM {_CUSTOMER} WHERE contains(onsets, 'ㄱㅅ') AND id % 2 = 0",
    "search_counted": "SELECT count(*) AS n, 2::BIGINT AS hits FROM customer",
    "index_keys": f"SELECT id, name || ' ' || lower(c_name) || ' ' || chr(44033) AS norm_key, onsets || replace(c_name, ' ', '') || chr(4352) || chr(4449) || chr(4520) AS choseong_key, id AS idx FROM {_CUSTOMER}",
    "top_pairs": "SELECT row_number() OVER (ORDER BY occurrences DESC, last_seen DESC, query, selected_key) - 1 AS place, * FROM (SELECT count(*) AS occurrences, max(ts) AS last_seen, (user_id % 50)::VARCHAR AS query, event_type AS selected_key FROM events GROUP BY 3, 4) ORDER BY 1 LIMIT 10",
    "retention_drops": "SELECT count(*) FILTER (ts < TIMESTAMP '2024-01-10 00:00:00') AS dropped_by_ttl, greatest(0, count(*) FILTER (ts >= TIMESTAMP '2024-01-10 00:00:00') - 1000) AS dropped_by_size FROM events",
    "uniform_numbers": _STATE.format(n=999) + " SELECT i::INT AS i, u FROM u",
    "weight_candidates": _tuning_sql(),
    "sanitized_weights": "SELECT s_suppkey AS id, " + ", ".join(f"least({0.5 if k > 3 else 2.0}, greatest({0.0 if k > 3 else 0.01}, s_acctbal / 1000 - {k}))::DOUBLE AS {n}" for k, n in enumerate(_NAMES)) + " FROM supplier",
    "resolved_weights": "SELECT * FROM (VALUES (0, 'development', 'treatment', 2.0::DOUBLE), (1, 'development', 'control', 0.1), (2, 'production', 'control', 0.1), (3, 'staging', 'control', 0.1), (4, 'staging', 'treatment', 2.0), (5, 'production', 'control', 0.1)) t(i, environment, bucket, edit)",
}
