"""The registered queries over the engine's own operators, and their SQL.

The tables hold no Korean, so words are made from keys: three syllables by arithmetic on the key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hanmoa.functions import keyboard, numerals, particles, pronunciation, syllables
from hanmoa.operators import feedback
from hanmoa.operators.search import HangulIndex, SearchPolicy
from hanmoa.operators.similarity import SimilarityOptions, search_similar
from hanmoa.plans import script
from hanmoa.plans.script import FINAL_PAIRS, FINALS, ONSETS, VOWEL_PAIRS, VOWELS

_STEPS = [(37, 11), (7919, 5), (613, 101)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def korean(key: Column) -> Column:
    return F.concat(*(F.decode(F.unhex(F.hex(F.lit(44032) + (key.cast("long") * a + b) % 11172)), "UTF-16BE") for a, b in _STEPS))


def _code(key: str, i: int) -> str:
    a, b = _STEPS[i]
    return f"(({key} * {a} + {b}) % 11172)"


def _syllable(key: str, i: int) -> str:
    return f"chr((44032 + {_code(key, i)})::INT)"


def _word(key: str) -> str:
    return " || ".join(_syllable(key, i) for i in range(3))


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _pick(values: list[str], index: str) -> str:
    return f"{_list(values)}[{index} + 1]"


def _letters(key: str, onsets: list[str], vowels: list[str], finals: list[str]) -> str:
    return " || ".join(
        f"{_pick(onsets, f'({c} // 588)')} || {_pick(vowels, f'(({c} % 588) // 28)')} || {_pick(finals, f'({c} % 28)')}" for c in (_code(key, i) for i in range(3))
    )


def _onsets(key: str) -> str:
    return " || ".join(_pick(ONSETS, f"({_code(key, i)} // 588)") for i in range(3))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), korean(F.col("p_partkey")).alias("word"), "p_name", F.col("p_size").alias("n"))


def _scalar(make: Callable[[], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _parts(spark, sf_dir).select("id", make().alias("out"))


def _sql(expression: str) -> str:
    return f"SELECT p_partkey AS id, {expression} AS out FROM part"


_K = "p_partkey"
_LAST = _code(_K, 2)
_HEAD = f"{_syllable(_K, 0)} || {_syllable(_K, 1)}"
_SPLIT_V, _SPLIT_T = [VOWEL_PAIRS.get(v, v) for v in VOWELS], [FINAL_PAIRS.get(t, t) for t in FINALS]
_KEY = script.KEY_OF
_KEYS = lambda kind: ["".join(_KEY[x] for x in (VOWEL_PAIRS | FINAL_PAIRS).get(j, j)) for j in kind]
_FEWER_T = [FINALS.index(FINAL_PAIRS[t][0]) if t in FINAL_PAIRS else 0 for t in FINALS]
_FEWER_V = [VOWELS.index(VOWEL_PAIRS[v][0]) if v in VOWEL_PAIRS else -1 for v in VOWELS]
_numbers = lambda v: "[" + ", ".join(map(str, v)) + "]"
_PEELED = (
    f"CASE WHEN {_LAST} % 28 > 0 THEN chr((44032 + {_LAST} - {_LAST} % 28 + {_numbers(_FEWER_T)}[{_LAST} % 28 + 1])::INT) "
    f"WHEN {_numbers(_FEWER_V)}[({_LAST} % 588) // 28 + 1] >= 0 THEN chr((44032 + ({_LAST} // 588) * 588 + {_numbers(_FEWER_V)}[({_LAST} % 588) // 28 + 1] * 28)::INT) "
    f"ELSE {_pick(ONSETS, f'({_LAST} // 588)')} END"
)
_MIXED = "(CASE WHEN k >= 100000000 THEN format('{:,}', k // 100000000) || '억' ELSE '' END || CASE WHEN k // 10000 % 10000 > 0 THEN format('{:,}', k // 10000 % 10000) || '만' ELSE '' END || CASE WHEN k % 10000 > 0 THEN format('{:,}', k % 10000) ELSE '' END)"


def _four(x: str) -> str:
    out = []
    for unit, place in (("천", 1000), ("백", 100), ("십", 10), ("", 1)):
        d = f"({x} // {place} % 10)"
        one = unit or "일"
        out.append(f"CASE {d} WHEN 0 THEN '' WHEN 1 THEN '{one}' ELSE {_pick(script.DIGITS, d)} || '{unit}' END")
    return "(" + " || ".join(out) + ")"


_WORDS = (
    f"(CASE WHEN k >= 100000000 THEN {_four('(k // 100000000)')} || '억' ELSE '' END || CASE WHEN k // 10000 % 10000 > 0 THEN {_four('(k // 10000 % 10000)')} || '만' ELSE '' END || {_four('(k % 10000)')})"
)


def _amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 104729 + 1).alias("k"))


_AMOUNTS = "(SELECT o_orderkey AS id, o_orderkey * 104729 + 1 AS k FROM orders)"


def search_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose name's onsets contain two given ones, by the n-gram index."""
    items = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), korean(F.col("c_custkey")).alias("name"))
    return HangulIndex(items, "name", "id", SearchPolicy("ngram", 2)).search("ㄱㄴ").select("id", "name")


def search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose name's onsets begin with those of any of three queries."""
    items = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), korean(F.col("c_custkey")).alias("name"))
    queries = spark.createDataFrame([(1, "ㅎ"), (2, "가"), (3, "ㅁㅂ")], "qid int, query string")
    return HangulIndex(items, "name", "id", SearchPolicy("lazy")).search_all(queries, "prefix").select("qid", "id")


def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers most like the mistyped name of every fiftieth."""
    items = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), korean(F.col("s_suppkey")).alias("name"))
    typed = items.where("id % 50 = 0").select(F.col("id").alias("qid"), keyboard.hangul_to_qwerty(F.col("name")).alias("query"))
    return search_similar(HangulIndex(items, "name", "id", SearchPolicy("lazy")), typed, SimilarityOptions(limit=3)).select("qid", "rank", "idx", "matched_query", F.round("score", 9).alias("score"))


def pair_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and event types as queries and selected keys: how often and how late."""
    e = _table(spark, sf_dir, "events").select(F.concat(F.lit(" "), F.col("user_id").cast("string")).alias("query"), F.col("event_type").alias("selected_key"), "ts")
    return feedback.pair_stats(e)


def ab_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by bucket."""
    user = F.concat(F.lit("user-"), F.col("c_custkey").cast("string"))
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), feedback.ab_bucket(user, "prod-salt", 0.5).alias("bucket"))


def debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events after which their user is quiet for an hour."""
    e = _table(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.min("event_id").alias("event_id"))
    return feedback.debounced(e, "user_id", "ts", 3_600_000).select("event_id", "user_id")


def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of calls, made of events."""
    e = _table(spark, sf_dir, "events")
    kind = F.element_at(F.lit(["search", "similar", "explain"]), (F.col("event_id") % 3 + 1).cast("int"))
    outcome = F.element_at(F.lit(["success", "cancelled", "failure", "success"]), (F.col("event_id") % 4 + 1).cast("int"))
    calls = e.select(kind.alias("kind"), (F.col("event_id") % 2 == 0).alias("is_async"), outcome.alias("outcome"), (F.col("event_id") % 5 == 0).alias("cache_hit"), F.col("user_id").alias("returned"), F.lit(2.0).alias("latency_ms"))
    return feedback.telemetry(calls)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit(" "), (F.col("user_id") % 50).cast("string")).alias("query"), F.col("event_type").alias("selected_key"), "ts", F.col("event_id").alias("seq"))


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs seen twice at least."""
    return feedback.training_samples(_events(spark, sf_dir), 100_000, 2)


def feedback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of events and distinct queries."""
    return feedback.summary(_events(spark, sf_dir), 5).select("total_events", "distinct_queries", F.size("top_pairs").cast("long").alias("n_top"))


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 1000 events to come in of those that are fresh."""
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return feedback.retained(_events(spark, sf_dir), now, 400 * 86400, 1000).select("seq")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of another type than the one before of their user."""
    e = _table(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.min("event_type").alias("event_type"))
    return feedback.without_repeats(e, "user_id", "ts", "event_type").select("user_id", "event_type", "ts")


_CALLS = "(SELECT ['search', 'similar', 'explain'][event_id % 3 + 1] AS kind, event_id % 2 = 0 AS is_async, ['success', 'cancelled', 'failure', 'success'][event_id % 4 + 1] AS outcome, event_id % 5 = 0 AS cache_hit, user_id AS returned FROM events)"
_CALL_SQL = ", ".join(
    [f"count(*) FILTER (kind = '{k}' AND NOT is_async) AS sync_{k}_count" for k in ("search", "similar", "explain")]
    + [f"count(*) FILTER (kind = '{k}' AND is_async AND outcome = '{o}') AS async_{k}_{o}_count" for k in ("search", "similar", "explain") for o in ("success", "cancelled", "failure")]
    + [f"CASE WHEN count(*) FILTER (kind = '{k}' AND {'' if m == 'async' else 'NOT '}is_async) > 0 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS mean_{m}_{k}_ms" for k in ("search", "similar", "explain") for m in ("sync", "async")]
    + ["count(*) FILTER (cache_hit) AS cache_hit_count", "sum(returned)::BIGINT AS returned_item_count"]
)
_HASH = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(0, length(u)), lambda i: ascii(substr(u, (i + 1)::INT, 1))::HUGEINT)), lambda h, b: (xor(h::UBIGINT, b::UBIGINT)::HUGEINT * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
_CONTAINS = f"SELECT c_custkey AS id, {_word('c_custkey')} AS name FROM customer WHERE contains({_onsets('c_custkey')}, 'ㄱㄴ')"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "decompose": _scalar(lambda: syllables.decompose(F.left("word", F.lit(1)))["l"] * 100 + syllables.decompose(F.left("word", F.lit(1)))["t"]),
    "disassemble": _scalar(lambda: syllables.disassemble(F.col("word"))),
    "assemble": _scalar(lambda: syllables.assemble(syllables.disassemble(F.col("word")))),
    "choseong": _scalar(lambda: syllables.get_choseong(F.col("word"))),
    "has_batchim": _scalar(lambda: syllables.has_batchim(F.col("word"))),
    "remove_last_character": _scalar(lambda: syllables.remove_last_character(F.col("word"))),
    "qwerty_to_alphabet": _scalar(lambda: keyboard.qwerty_to_alphabet(F.col("p_name"))),
    "hangul_to_qwerty": _scalar(lambda: keyboard.hangul_to_qwerty(F.col("word"))),
    "josa_object": _scalar(lambda: particles.josa(F.col("word"), "을/를")),
    "josa_instrument": _scalar(lambda: particles.josa(F.col("word"), "으로/로")),
    "susa": _scalar(lambda: numerals.susa(F.col("n"))),
    "seosusa": _scalar(lambda: numerals.seosusa(F.col("n"))),
    "days": _scalar(lambda: numerals.days(F.col("n"))),
    "standardize_pronunciation": _scalar(lambda: pronunciation.standardize_pronunciation(F.col("word"))),
    "romanize": _scalar(lambda: pronunciation.romanize(F.col("word"))),
    "compose": _scalar(lambda: syllables.compose_syllable((F.col("id") % 19).cast("int"), (F.col("id") % 21).cast("int"), (F.col("id") % 28).cast("int"))),
    "disassemble_to_groups": _scalar(lambda: F.array_join(F.transform(syllables.disassemble_to_groups(F.col("word")), lambda g: F.array_join(g, "")), "|")),
    "combine_character": _scalar(lambda: syllables.combine_character(F.get(syllables.choseongs(), (F.col("id") % 19).cast("int")), F.get(syllables.jungseongs(), (F.col("id") % 21).cast("int")), F.get(syllables.jongseongs(), (F.col("id") % 28).cast("int")))),
    "choseong_strict": _scalar(lambda: syllables.get_choseong_strict(F.concat(F.col("word"), F.lit(" "), F.col("p_name")))),
    "can_be_jongseong": _scalar(lambda: syllables.can_be_jongseong(F.get(syllables.choseongs(), (F.col("id") % 19).cast("int")))),
    "qwerty_to_hangul": _scalar(lambda: keyboard.qwerty_to_hangul(keyboard.hangul_to_qwerty(F.col("word")))),
    "normalize": _scalar(lambda: syllables.normalize(F.concat(F.lit(" \t"), F.col("word"), F.lit("\n ")))),
    "susa_modifier": _scalar(lambda: numerals.susa(F.col("n"), modifier=True)),
    "josa_and": _scalar(lambda: particles.josa(F.col("word"), "와/과")),
    "amount_to_hangul": lambda s, d: _amounts(s, d).select("id", numerals.amount_to_hangul(F.concat(F.lit("KRW "), F.format_number("k", 0), F.lit(".00"))).alias("out")),
    "training_samples": training,
    "feedback_summary": feedback_summary,
    "retention": retention,
    "changes": changes,
    "number_to_hangul": lambda s, d: _amounts(s, d).select("id", numerals.number_to_hangul(F.col("k")).alias("out")),
    "number_to_hangul_mixed": lambda s, d: _amounts(s, d).select("id", numerals.number_to_hangul_mixed(F.col("k")).alias("out")),
    "search_onsets": search_onsets,
    "search_prefix": search_prefix,
    "similar_names": similar_names,
    "pair_statistics": pair_statistics,
    "ab_assignment": ab_assignment,
    "debounce": debounce,
    "call_log": call_log,
}
ORACLES: dict[str, str] = {
    "decompose": _sql(f"(({_code(_K, 0)} // 588) * 100 + {_code(_K, 0)} % 28)::INT"),
    "disassemble": _sql(_letters(_K, ONSETS, _SPLIT_V, _SPLIT_T)),
    "assemble": _sql(_word(_K)),
    "choseong": _sql(_onsets(_K)),
    "has_batchim": _sql(f"{_LAST} % 28 > 0"),
    "remove_last_character": _sql(f"{_HEAD} || {_PEELED}"),
    "qwerty_to_alphabet": _sql(f"translate(p_name, '{''.join(script.TYPED)}', '{''.join(script.TYPED.values())}')"),
    "hangul_to_qwerty": _sql(_letters(_K, _KEYS(ONSETS), _KEYS(VOWELS), [""] + _KEYS(FINALS[1:]))),
    "josa_object": _sql(f"{_word(_K)} || CASE WHEN {_LAST} % 28 > 0 THEN '을' ELSE '를' END"),
    "josa_instrument": _sql(f"{_word(_K)} || CASE WHEN {_LAST} % 28 IN (0, 8) THEN '로' ELSE '으로' END"),
    "susa": _sql(f"CASE WHEN p_size BETWEEN 1 AND 100 THEN {_pick(script.TENS, '(p_size // 10)')} || {_pick(script.ONES, '(p_size % 10)')} ELSE p_size::VARCHAR END"),
    "seosusa": _sql(f"CASE p_size WHEN 1 THEN '첫' WHEN 2 THEN '둘' WHEN 20 THEN '스무' ELSE {_pick(script.TENS, '(p_size // 10)')} || {_pick(script.ORDINALS, '(p_size % 10)')} END || '째'"),
    "days": _sql(f"CASE WHEN p_size > 30 THEN p_size::VARCHAR || '일' WHEN p_size = 10 THEN '열흘' WHEN p_size = 20 THEN '스무날' WHEN p_size = 30 THEN '서른날' ELSE {_pick(['', '열', '스무'], '(p_size // 10)')} || {_pick(script.DAYS, '(p_size % 10)')} END"),
    "compose": _sql("chr((44032 + (p_partkey % 19) * 588 + (p_partkey % 21) * 28 + p_partkey % 28)::INT)"),
    "disassemble_to_groups": _sql(" || '|' || ".join(f"{_pick(ONSETS, f'({c} // 588)')} || {_pick(_SPLIT_V, f'(({c} % 588) // 28)')} || {_pick(_SPLIT_T, f'({c} % 28)')}" for c in (_code(_K, i) for i in range(3)))),
    "combine_character": _sql("chr((44032 + (p_partkey % 19) * 588 + (p_partkey % 21) * 28 + p_partkey % 28)::INT)"),
    "choseong_strict": _sql(f"{_onsets(_K)} || ' ' || regexp_replace(p_name, '[^ ]', '', 'g')"),
    "can_be_jongseong": _sql(f"list_contains({_list(FINALS)}, {_pick(ONSETS, '(p_partkey % 19)')})"),
    "qwerty_to_hangul": _sql(_word(_K)),
    "normalize": _sql(_word(_K)),
    "susa_modifier": _sql(f"CASE WHEN p_size = 20 THEN '스무' WHEN p_size BETWEEN 1 AND 100 THEN {_pick(script.TENS, '(p_size // 10)')} || {_pick(script.MODIFIERS, '(p_size % 10)')} ELSE p_size::VARCHAR END"),
    "josa_and": _sql(f"{_word(_K)} || CASE WHEN {_LAST} % 28 > 0 THEN '과' ELSE '와' END"),
    "amount_to_hangul": f"SELECT id, {_WORDS} AS out FROM {_AMOUNTS}",
    "training_samples": "SELECT (user_id % 50)::VARCHAR AS query, event_type AS expected_key FROM events GROUP BY 1, 2 HAVING count(*) >= 2",
    "feedback_summary": "SELECT count(*) AS total_events, count(DISTINCT user_id % 50) AS distinct_queries, 5::BIGINT AS n_top FROM events",
    "retention": "SELECT event_id AS seq FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 400 DAY ORDER BY event_id DESC LIMIT 1000",
    "changes": "SELECT user_id, event_type, ts FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM (SELECT user_id, ts, min(event_type) AS event_type FROM events GROUP BY 1, 2)) WHERE before IS DISTINCT FROM event_type",
    "number_to_hangul": f"SELECT id, {_WORDS} AS out FROM {_AMOUNTS}",
    "number_to_hangul_mixed": f"SELECT id, {_MIXED} AS out FROM {_AMOUNTS}",
    "search_onsets": _CONTAINS,
    "search_prefix": "SELECT qid::INT AS qid, id FROM (VALUES (1, 'ㅎ'), (2, 'ㄱ'), (3, 'ㅁㅂ')) q(qid, o), " + f"(SELECT c_custkey AS id, {_onsets('c_custkey')} AS onsets FROM customer) WHERE starts_with(onsets, o)",
    "pair_statistics": "SELECT user_id::VARCHAR AS query, event_type AS selected_key, count(*) AS occurrences, max(ts) AS last_seen FROM events GROUP BY 1, 2",
    "ab_assignment": f"SELECT id, CASE WHEN ({_HASH} % 10000)::DOUBLE / 10000 < 0.5 THEN 'treatment' ELSE 'control' END AS bucket FROM (SELECT c_custkey AS id, 'prod-salt|user-' || c_custkey AS u FROM customer)",
    "debounce": "SELECT event_id, user_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS after FROM (SELECT user_id, ts, min(event_id) AS event_id FROM events GROUP BY 1, 2)) WHERE after IS NULL OR epoch_us(after) - epoch_us(ts) >= 3600000000",
    "call_log": f"SELECT {_CALL_SQL} FROM {_CALLS}",
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search by onsets over all customers."""
    return search_onsets(spark, sf_dir)
