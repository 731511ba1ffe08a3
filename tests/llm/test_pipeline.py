import corpus_pipeline
from pyspark.sql import functions as F

from shiftloom.llm import decontamination
from shiftloom.llm.common import stored

SF = "/root/testdata/sf0.001"
ODD = [(9000, None, None, None, None), (9001, "", "en", "s", 0), (9001, "", "en", "s", 0), (9002, "12 !!", "en", None, 5), (None, "some words here", "en", None, 3), (9003, "word " * 9000, "en", "s", 45000)]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(ODD, docs.schema))
    seen = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stored(stage(spark, now, SF))
        seen[name] = now
        if name != "sharding":
            assert now.columns == docs.columns
    ids = lambda n: {r.doc_id for r in seen[n].select("doc_id").collect()}
    assert not {9000, 9001, 9002} & ids("language_id") and {None, 9003} <= ids("language_id")
    assert seen["language_id"].count() == docs.where(F.col("text").rlike(r"\p{L}")).count()
    dedup = seen["near_dedup"]
    assert dedup.count() == dedup.select(F.sha2("text", 256)).distinct().count() < seen["language_id"].count()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontamination.find_leaks(seen["decontamination"], bench).count() == 0
    assert 0 < seen["decontamination"].count() <= dedup.count()
    assert ids("mixing") <= ids("decontamination") and seen["mixing"].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    sizes = [r["count"] for r in seen["sharding"].groupBy("shard").count().collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 1


def test_empty_tables_pass_all_stages(spark):
    now = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stored(stage(spark, now, SF))
    assert now.count() == 0
