from hanmoa.plans import registry


def test_similar_names_takes_every_fiftieth(spark, tmp_path):
    spark.range(120).withColumnRenamed("id", "s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    got = registry.similar_names(spark, str(tmp_path)).where("rank = 1").collect()
    assert {r["qid"] for r in got} == {0, 50, 100}
