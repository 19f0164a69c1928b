"""The pipeline's stages on tables whose doc_ids repeat or are null."""

import random

from pyspark.sql import functions as F

import corpus_pipeline


def words(seed, n=60):
    return " ".join(f"w{random.Random(seed * 1000 + i).randrange(10**6)}" for i in range(n))


def test_stages_decide_by_row(spark, tmp_path):
    spark.createDataFrame([(1, words(9, 20))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [
        (1, words(1)), (1, words(1)),  # an exact repeat of a kept row
        (2, words(2)), (3, words(2) + " end"), (3, words(3)),  # a near copy shares its doc_id with a clean row
        (4, words(9, 20)), (4, words(4)),  # so does a contaminated row
        (None, words(2) + " close"), (None, words(5)),
        (6, words(6)), (6, words(6, 30) + " " + words(7, 30)),  # a passage of a row with the same doc_id
        (8, None), (8, ""),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")

    def got(df):
        return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)

    kept = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    stay = [rows[i] for i in (0, 2, 4, 5, 6, 8, 9, 10, 11, 12)]
    assert got(kept) == sorted(stay, key=str) and kept.columns == docs.columns
    clean = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert got(clean) == sorted((r for r in rows if r != rows[5]), key=str)
    cut = corpus_pipeline.passages(spark, docs, str(tmp_path))
    six = sorted((r["text"] or "" for r in cut.where("doc_id = 6").collect()), key=len)
    assert len(six) == 2 and len(six[0]) + len(words(6, 30)) <= len(rows[10][1]) + 60 and cut.columns == docs.columns
    assert cut.where("doc_id = 1").count() == 1


def tables(spark, path, labels):
    item = " ".join(f"leak{i}" for i in range(15))
    spark.createDataFrame([(1, item), (2, "common phrase"), (3, None)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return item


CLASHING = ("row", "kept", "n_bytes", "n_removed", "band", "component", "part", "count", "score", "contaminated", "items", "own")


def clashing(spark, rows):
    df = spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING})


def test_every_stage_takes_any_rows(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeats and clashing columns: clean rows stay as they are."""
    item = tables(spark, tmp_path, [(i, None, int(i % 2 == 0)) for i in range(100, 140)] + [(None, 1, None)])
    toxic = [(i, words(i, 20) + (" vilestemer grubbing" if i % 2 == 0 else "")) for i in range(100, 140)]
    clean = [(1, None), (2, ""), (3, " \n"), (4, words(4000, 30_000)), (5, "x" * 200_000), (6, words(6)), (7, "한글 " + words(7))]
    bad = {
        "toxicity": [(50, words(50, 20) + " vilestemer grubbing"), (50, words(50, 20) + " vilestemer grubbing")],
        "near_dedup": [(51, words(6) + " end"), (51, words(6) + " end"), (None, words(6))],
        "decontaminate": [(52, item), (53, words(53, 2000) + " " + item), (54, "common phrase"), (None, item)],
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = clashing(spark, clean + bad.get(name, []) + (toxic if name == "toxicity" else []))
        got = stage(spark, docs, str(tmp_path)).collect()
        kept = {(r["doc_id"], r["text"] or "") for r in got}
        assert {(i, t or "") for i, t in clean} <= kept and not kept & set(bad.get(name, [])), name
        assert got[0].asDict().keys() == set(docs.columns), name
        assert all(r["n_chars"] == len(r["text"] or "") and all(r[c] == (f"{c}{r['doc_id']}" if r["doc_id"] else None) for c in CLASHING) for r in got), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    packed = corpus_pipeline.pack(spark, clashing(spark, [*clean, (6, words(6)), (None, "a")]), str(tmp_path)).collect()
    ends = [r["doc_id"] for r in packed if r["start"] + r["length"] == r["doc_tokens"]]
    assert sorted(ends, key=str) == sorted([*range(1, 8), 6, None], key=str)
    assert corpus_pipeline.pack(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_long_documents_with_a_short_common_phrase_stay(spark, tmp_path):
    tables(spark, tmp_path, [])
    docs = clashing(spark, [(1, words(1, 200) + " common phrase"), (2, words(2, 20) + " common phrase")])
    assert [r["doc_id"] for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()] == [1]


def test_passages_that_repeat_go_from_later_rows(spark, tmp_path):
    shared = words(8, 30)
    docs = clashing(spark, [(2, "second " + shared + " tail"), (1, "first " + shared), (3, shared)])
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.passages(spark, docs, str(tmp_path)).collect()}
    assert got[1] == "first " + shared and got[2].startswith("second") and shared[:60] not in got[2] and 3 not in got


def test_run_applies_all_stages(spark, tmp_path):
    item = tables(spark, tmp_path, [(i, 1, 0) for i in range(9)])
    shared = words(8, 30)
    rows = [(1, words(1)), (2, words(1) + " end"), (3, words(3) + " " + shared), (4, words(4) + " " + shared), (5, words(5) + " " + item)]
    clashing(spark, rows).drop(*CLASHING).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = {r["doc_id"]: r["doc_tokens"] for r in got}
    assert set(tokens) == {1, 3, 4} and tokens[4] < tokens[3]
