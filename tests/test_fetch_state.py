"""ST2/ST3: fetch state by stretches, with state, nulls and hot URIs, and as a stream of batches."""

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pliego.streaming import cache_state
from pliego.streaming.cache_state import fetch_state, run_fetch_state

BASE = datetime.datetime(2024, 1, 1)
DDL = "uri string, ts timestamp"


def fold(rows, state=None):
    out, entry = [], dict(state or {})
    for u, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        f = u not in entry or (t - entry[u]).total_seconds() >= 7200
        if f:
            entry[u] = t
        out.append((u, t, f, entry[u]))
    return Counter(out)


def got(df):
    return Counter(tuple(r) for r in df.select("uri", "ts", "fetched", "entry_at").collect())


@pytest.mark.parametrize("seed,days,step", [(2, 40, 1), (3, 100, 60), (4, 3, 1800)])
def test_by_stretches_against_the_fold(spark, seed, days, step):
    """Dense and sparse stretches, equal times, times a TTL apart to the second."""
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "hot", "hot", None]), BASE + datetime.timedelta(seconds=step * rng.randrange(0, days * 86400 // step))) for _ in range(1500)]
    rows += [("regular", BASE + datetime.timedelta(seconds=7200 * i + (i % 3 == 2))) for i in range(50)] + [("once", BASE)] * 3
    df = spark.createDataFrame(rows, DDL).repartition(5)
    assert got(fetch_state(df, fold_rows=0)) == got(fetch_state(df)) == fold(rows)


def test_state_from_before(spark):
    rng = random.Random(5)
    rows = [(u, BASE + datetime.timedelta(seconds=rng.randrange(0, 5 * 86400))) for u in ("a", "b", None) for _ in range(200)]
    state = {"a": BASE - datetime.timedelta(seconds=10), None: BASE - datetime.timedelta(days=9), "gone": BASE}
    known = spark.createDataFrame(list(state.items()), "uri string, entry_at timestamp")
    for fold_rows in (0, 1000):
        assert got(fetch_state(spark.createDataFrame(rows, DDL), state=known, fold_rows=fold_rows)) == fold(rows, state)


def test_nulls_and_nothing(spark):
    rows = [(None, BASE), (None, BASE), ("", BASE), ("a", None), (None, None), ("a", BASE)]
    want = fold([r for r in rows if r[1]]) + Counter({("a", None, None, None): 1, (None, None, None, None): 1})
    for fold_rows in (0, 1000):
        assert got(fetch_state(spark.createDataFrame(rows, DDL), fold_rows=fold_rows)) == want
        assert fetch_state(spark.createDataFrame([], DDL), fold_rows=fold_rows).count() == 0


def test_a_hot_uri_is_many_groups(spark, monkeypatch):
    """A third of a million requests of one URI, half of them at one time: no group
    of more than a range's rows, the copies made in pieces."""
    monkeypatch.setattr(cache_state, "REPEATS", 10_000)
    micros = lambda c: F.timestamp_micros(F.lit(1_704_067_200_000_000) + c)
    spread = spark.range(170_000).select(F.lit("hot").alias("uri"), micros(F.col("id") * 999_983).alias("ts"))
    same = spark.range(165_000).select(F.lit("hot").alias("uri"), micros(F.lit(7_200_000_000)).alias("ts"))
    df = spread.unionByName(same)
    a, b = fetch_state(df, fold_rows=50_000), fetch_state(df)
    cols = [F.xxhash64("uri", "ts", "fetched", "entry_at").alias("h")]
    total = lambda d: d.select(*cols).agg(F.count("h"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
    assert total(a) == total(b) and a.count() == 335_000
    assert a.where("fetched").count() == len([1 for c in fold([("hot", BASE + datetime.timedelta(microseconds=999_983 * i)) for i in range(170_000)] + [("hot", BASE + datetime.timedelta(seconds=7200))]) if c[2]])


def test_stream_of_batches(spark, tmp_path):
    """Decisions as the fold gives them; late requests are kept, not decided; the state is bounded by the TTL."""
    from pliego.streaming.cache_state import fetch_state_batch

    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), BASE + datetime.timedelta(seconds=60 * i + rng.randrange(0, 500))) for i in range(400)]
    end = [("end", BASE + datetime.timedelta(days=30))]
    late = [("a", BASE), ("never", BASE + datetime.timedelta(hours=1))]
    parts = [rows[:150], [], rows[150:300] + [("a", None)], rows[300:] + late, end]
    root = str(tmp_path)
    for i, part in enumerate(parts):
        for _ in range(2 if i == 2 else 1):  # a replay writes the same
            fetch_state_batch(spark.createDataFrame(part, DDL), i, root)
    read = lambda name: spark.read.parquet(f"{root}/{name}")
    assert got(read("decisions")) == fold(rows) + Counter({("a", None, None, None): 1})
    assert Counter((r.uri, r.ts) for r in read("late").collect()) == Counter(late)
    states = {r.batch: r["count"] for r in read("state").groupBy("batch").count().collect()}
    assert max(states.values()) <= 3 and 4 not in states  # all are a TTL behind the watermark
    assert [(r.uri, r.ts) for r in read("waiting").where("batch = 4").collect()] == end


def test_stream_query_restarts(spark, tmp_path):
    rng = random.Random(11)
    rows = [(rng.choice("ab"), BASE + datetime.timedelta(seconds=60 * i)) for i in range(200)]
    src = str(tmp_path / "in")
    for i in range(2):
        spark.createDataFrame(rows[100 * i : 100 * (i + 1)], DDL).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(src)
        run_fetch_state(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(120)
    decided = got(spark.read.parquet(str(tmp_path / "out" / "decisions")))
    mark = rows[-1][1] - datetime.timedelta(seconds=600)
    assert decided == Counter({k: n for k, n in fold(rows).items() if k[1] <= mark})
