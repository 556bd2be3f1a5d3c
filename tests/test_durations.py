"""A7: render times measured per document, in buckets and mergeable sketches."""

import random

from pyspark.sql import functions as F

from pliego.operators.render import duration_histogram, duration_quantiles, duration_sketch, rendered


def test_each_body_has_its_time(spark):
    rows = [("txt", "a.txt", None, '{"a": 1}'), ("html", "a.html", "{{a}}" * 5000, '{"a": 1}'), ("html", "b.html", "{{#a}}", "{}"), ("pdf", "c", None, "{}")]
    df = spark.createDataFrame(rows, "format string, path string, content string, data string").withColumn("images", F.create_map().cast("map<string,string>"))
    got = df.select("format", rendered("format", "path", "content", "data", "images").alias("r")).select("format", "r.*").collect()
    assert [r.micros is None for r in got] == [False, False, True, True] and got[1].micros > got[0].micros >= 0
    assert got[2].error and got[1].body == "1" * 5000


def test_buckets_and_quantiles(spark):
    rng = random.Random(3)
    times = [int(rng.lognormvariate(5, 1.5)) for _ in range(20_000)]
    df = spark.createDataFrame([(i % 5, t) for i, t in enumerate(times)] + [(0, None)] * 7, "batch int, render_us long")
    got = {r.le: r.documents for r in duration_histogram(df, bounds=(50, 500)).collect()}
    assert got == {"50": sum(t <= 50 for t in times), "500": sum(t <= 500 for t in times), "+Inf": len(times)}
    ordered = sorted(times)
    for r in duration_quantiles(duration_sketch(df, ["batch"])).collect():
        below, upto = sum(t < r.micros for t in ordered) / len(times), sum(t <= r.micros for t in ordered) / len(times)
        assert below - 0.02 <= r["quantile"] <= upto + 0.02
    assert {r.documents for r in duration_histogram(df.where("false")).collect()} == {0}
