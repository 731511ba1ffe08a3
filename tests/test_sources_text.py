import pytest
from pyspark.sql import functions as F

from shiftloom.operators import report, textgen
from shiftloom.plans.features import shift_features
from shiftloom.schema import feature_schema
from shiftloom.sources import tables

WIDE = "Tag de PI,2024-10-01 00:00:00,2024-10-01 00:10:00\na,1.5,\n\"b, x\",,-2\n"


def test_wide_text(spark, tmp_path):
    (tmp_path / "wide.csv").write_text(WIDE)
    rows = sorted((r[0], str(r[1]), r[2]) for r in tables.read_wide_text(spark, str(tmp_path / "wide.csv")).collect())
    assert rows == [("a", "2024-10-01 00:00:00", 1.5), ("a", "2024-10-01 00:10:00", None), ("b, x", "2024-10-01 00:00:00", None), ("b, x", "2024-10-01 00:10:00", -2.0)]


def test_wide_headers(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("Tag de PI,2024-10-01,zz\na,1,2\n")
    with pytest.raises(ValueError, match="zz"):
        tables.read_wide_text(spark, str(tmp_path / "bad.csv"))
    assert tables.read_wide_text(spark, str(tmp_path / "bad.csv"), strict=False).count() == 1
    (tmp_path / "none.csv").write_text("x,2024-10-01\na,1\n")
    with pytest.raises(ValueError, match="Tag de PI"):
        tables.read_wide_text(spark, str(tmp_path / "none.csv"))


def test_unpivot(spark):
    wide = spark.createDataFrame([("a", 1.0, None), ("b", None, float("nan"))], "`Tag de PI` string, `2024-10-01 00:00:00` double, `2024-10-01 00:10:00` double")
    out = tables.unpivot_wide(wide)
    assert out.count() == 4 and out.where("value IS NULL").count() == 3
    with pytest.raises(ValueError):
        tables.unpivot_wide(wide.withColumnRenamed("Tag de PI", "t"))
    odd = wide.withColumn("zz", F.lit(1.0))
    assert tables.unpivot_wide(odd, strict=False).count() == 4
    with pytest.raises(Exception, match="zz"):
        tables.unpivot_wide(odd).collect()


def test_round_trips(spark, long, tmp_path):
    f = shift_features(long(a=[(i * 5, i % 9) for i in range(600)]))
    for form in ("parquet", "csv"):
        tables.write_features(f, str(tmp_path / form), form)
        back = tables.read_features(spark, str(tmp_path / form), form)
        assert back.count() == f.count() and dict(back.dtypes)["fecha"] == "string"
    assert [x.name for x in feature_schema()] == f.columns


def test_prompts_render_nulls_and_fallbacks(spark):
    df = spark.sql("SELECT 'a' tag, CAST(NULL AS STRING) fecha, 5 value, 'bar' unit")
    text = df.select(textgen.report_prompt(df)).first()[0]
    assert "* variable: a" in text and "* fecha: N/A" in text and "* valor: 5 bar" in text and "* turno: N/A" in text
    bare = spark.sql("SELECT 1 x")
    text = bare.select(textgen.report_prompt(bare)).first()[0]
    assert "* variable: variable" in text and "* valor: N/A" in text


def test_generation(spark, long):
    f = shift_features(long(a=[(i * 5, i % 9) for i in range(600)], b=[(i, 1) for i in range(50)]))
    seen = textgen.shift_reports(f, lambda: lambda prompts, **o: [f"{p}\n text {o['max_new_tokens']} \n" for p in prompts], "2024-10-01", "T1_00_08", ["a"], max_new_tokens=7, workers=2)
    rows = seen.collect()
    assert [(r.variable, r.reporte_llm) for r in rows] == [("a", "text 7")]
    wrapped = textgen.generate(spark.sql("SELECT 'p' prompt"), lambda: lambda ps, **o: [p + " out" for p in ps], formatter=lambda p: f"<{p}>")
    assert wrapped.first().reporte_llm == "out"
    assert textgen.generate(spark.sql("SELECT 'p' prompt").limit(0), lambda: lambda ps, **o: ps).count() == 0


def test_filters(spark, long):
    f = shift_features(long(a=[(0, 1)], b=[(500, 1)]))
    assert report.filter_shift(f, "2024-10-01", "T2_08_16").count() == 1
    assert report.filter_shift(f.drop("turno"), shift="nowhere").count() == 2
    assert report.filter_shift(f, tags=["a"]).count() == 1 and report.filter_shift(f, tags=[]).count() == 0


def test_stream(spark, long, tmp_path):
    from shiftloom.schema import Columns
    from shiftloom.streaming.shifts import streaming_shift_stats

    df = long(a=[(0, 1), (1, 3), (500, 5)]).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    limits = spark.createDataFrame([("a", 2.0, 4.0)], "`Tag de PI` string, lim_inf double, lim_sup double")
    q = streaming_shift_stats(source, Columns(), limits=limits).writeStream.format("memory").queryName("shifts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    rows = {r.turno: (r.n_muestras, r.mean_turno, r.n_bajo, r.n_alto) for r in spark.table("shifts").collect()}
    assert rows == {"T1_00_08": (2, 2.0, 1, 0), "T2_08_16": (1, 5.0, 0, 1)}
