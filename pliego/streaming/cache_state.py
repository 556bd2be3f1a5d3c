"""ST2 template fetch state and ST3 eviction, in batch and stream form.

Per template URI, a request *fetches* when there is no cache entry or the
entry is at least the TTL old (the TTL runs from the fetch, it is not
sliding); otherwise it is a *hit*. The only state is the time of the last
fetch per URI; decisions depend on the distinct request times alone.

* batch (``fetch_state``): a URI of few distinct times is folded by one task. For
  the others every time gets its successor, the first request a TTL later or
  more, by an as-of search over ranges of rows. A stretch of one TTL holds one
  fetch at most, so the successor is the state's way through a stretch; ways
  through two neighbouring stretches are joined into the way through both, which
  halves the ways to keep each time. The state is then handed down and every
  stretch knows its fetch. A group is a range of rows, however hot a URI is.
* stream in batches (``run_fetch_state``): ``foreachBatch`` over the batch form, in
  event time. Last fetches and waiting requests are tables, a version a batch; a
  URI's entry leaves (ST3) once it is a TTL behind the watermark, and requests
  later than the watermark are kept in a table of their own.
* stream (``fetch_state_stream``): ``applyInPandasWithState`` keyed by URI, the same
  decisions; Spark drops what is later than the watermark.
"""

from __future__ import annotations

import os
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import configure, ensure_checkpoint_dir

NONE = -(1 << 60)  # no fetch yet
TTL_SECONDS = 2 * 3600
# Distinct times of a URI that one task folds; copies of a request made by one task.
FOLD_ROWS = 100_000
REPEATS = 65_536
OUT_DDL = "uri string, ts timestamp, fetched boolean, entry_at timestamp"


def _fold(t: np.ndarray, ttl_us: int, entry: int | None) -> tuple[np.ndarray, np.ndarray, int | None]:
    """Sequential decision over sorted microsecond times; jumps from fetch to
    fetch with a binary search, so the loop runs once per fetch."""
    n = len(t)
    fetched = np.zeros(n, dtype=bool)
    entry_at = np.empty(n, dtype=np.int64)
    i = 0
    if entry is not None:
        i = int(np.searchsorted(t, entry + ttl_us, side="left"))
        entry_at[:i] = entry
    while i < n:
        f = t[i]
        fetched[i] = True
        j = int(np.searchsorted(t, f + ttl_us, side="left"))
        entry_at[i:j] = f
        entry = int(f)
        i = j
    return fetched, entry_at, entry


def _to_us(s: pd.Series) -> np.ndarray:
    return s.astype("datetime64[us]").astype("int64").to_numpy()


def _from_us(a: np.ndarray) -> pd.Series:
    return pd.Series(a.astype("datetime64[us]"))


def fetch_state_stream(requests: DataFrame, key: str = "uri", ts: str = "ts", ttl_seconds: int = TTL_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """ST2 (stream): a decision per request, given once the watermark (``delay``
    behind the latest request) has passed it; what comes later than that is
    dropped. State: the last fetch, and the times that still wait."""
    ttl_us = ttl_seconds * 1_000_000

    def fn(k, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entry, waiting = (state.get if state.exists else (NONE, []))
        times = [np.array(waiting, dtype=np.int64)]
        if not state.hasTimedOut:
            times += [_to_us(pdf[ts]) for pdf in pdfs]
        mark = state.getCurrentWatermarkMs() * 1000
        t = np.sort(np.concatenate(times))
        due, rest = t[t <= mark], t[t > mark]
        if len(due):
            fetched, entry_at, last = _fold(due, ttl_us, None if entry == NONE else entry)
            entry = last
            yield pd.DataFrame({key: [k[0]] * len(due), ts: _from_us(due), "fetched": fetched, "entry_at": _from_us(entry_at)})
        if not len(rest) and entry + ttl_us <= mark:
            if state.exists:
                state.remove()
            return
        state.update((int(entry), [int(x) for x in rest]))
        wake = int(rest[0]) if len(rest) else int(entry) + ttl_us
        state.setTimeoutTimestamp(max(wake, mark) // 1000 + 1)

    return requests.select(key, ts).withWatermark(ts, delay).groupBy(key).applyInPandasWithState(
        fn, f"{key} string, {ts} timestamp, fetched boolean, entry_at timestamp", "entry long, waiting array<long>", "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def _successors(times: DataFrame, ttl_us: int) -> DataFrame:
    """(k, t, n): ``n`` the URI's first time at or after t + TTL, or null. Times and
    the searches for them are dealt out by ranges of (k, time); a search finds
    its time within its range or is told the first one of a later range."""
    entry = times.select("k", F.col("t").alias("at"), F.col("t").alias("entry"), F.lit(None).cast("long").alias("t"))
    search = times.select("k", (F.col("t") + ttl_us).alias("at"), F.lit(None).cast("long").alias("entry"), "t")
    dealt = entry.unionByName(search).repartitionByRange("k", "at").withColumn("part", F.spark_partition_id()).checkpoint()
    inside = Window.partitionBy("part", "k").orderBy(F.col("at").desc())  # rows of the same time included
    found = dealt.withColumn("here", F.min("entry").over(inside)).where(F.col("t").isNotNull())
    firsts = dealt.groupBy("k", "part").agg(F.min("entry").alias("first"))
    later = Window.partitionBy("k").orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    firsts = firsts.select("k", "part", F.min("first").over(later).alias("later"))
    return found.join(firsts, ["k", "part"]).select("k", "t", F.coalesce("here", "later").alias("n")).checkpoint()


def _by_stretches(times: DataFrame, state: DataFrame, ttl_us: int) -> DataFrame:
    """(k, t, fetched, entry) for ``times`` (k, t distinct) and ``state`` (k, e)."""
    succ = _successors(times, ttl_us)
    lo, hi = succ.agg(F.min("t"), F.max("t")).first()
    if lo is None:
        return times.select("k", "t", F.lit(True).alias("fetched"), F.col("t").alias("entry"))
    stretch = lambda c: F.expr(f"({c} - {lo}) div {ttl_us}")
    # A way through block b of 2^j stretches: entered at t, the last fetch is e and n is next.
    # Kept are the entries of a block's first stretch, and of the rest the very first:
    # a fetch before the block has expired by then.
    ways = [succ.select("k", stretch("t").alias("b"), "t", F.col("t").alias("e"), "n")]
    width = 1
    while width <= (hi - lo) // ttl_us:
        now = ways[-1]
        left, right = now.where("b % 2 = 0"), now.where("b % 2 = 1")
        on = right.select("k", (F.col("b") - 1).alias("b"), F.col("t").alias("n"), F.col("e").alias("e2"), F.col("n").alias("n2"))
        through = left.join(on, ["k", "b", "n"], "left")
        through = through.select("k", "b", "t", F.coalesce("e2", "e").alias("e"), F.when(F.col("e2").isNotNull(), F.col("n2")).otherwise(F.col("n")).alias("n"))
        later = left.where(stretch("t") > F.col("b") * width).select("k", "b").distinct()
        first = right.groupBy("k", "b").agg(F.min_by(F.struct("t", "e", "n"), "t").alias("x")).select("k", (F.col("b") - 1).alias("b"), "x.*")
        both = through.unionByName(first.join(later, ["k", "b"], "left_anti"))
        ways.append(both.withColumn("b", F.expr("b div 2")).checkpoint())
        width *= 2
    # What the state before the first time leaves: its first fetch.
    started = times.join(state, "k", "left").where(F.col("e").isNull() | (F.col("t") >= F.col("e") + ttl_us))
    started = started.groupBy("k").agg(F.min("t").alias("n"))
    coming = times.select("k").distinct().join(state, "k", "left").join(started, "k", "left").select("k", F.lit(0).cast("long").alias("b"), "e", "n")
    for way in reversed(ways[:-1]):
        coming = coming.withColumn("b", F.col("b") * 2)
        out = way.select("k", "b", F.col("t").alias("n"), F.col("e").alias("e2"), F.col("n").alias("n2"))
        passed = coming.join(out, ["k", "b", "n"], "left")
        passed = passed.select("k", (F.col("b") + 1).alias("b"), F.coalesce("e2", "e").alias("e"), F.when(F.col("e2").isNotNull(), F.col("n2")).otherwise(F.col("n")).alias("n"))
        coming = coming.select("k", "b", "e", "n").unionByName(passed).checkpoint()
    known = times.withColumn("b", stretch("t")).join(coming, ["k", "b"])
    hit = F.col("n").isNull() | (F.col("t") < F.col("n"))
    return known.select("k", "t", (~hit & (F.col("t") == F.col("n"))).alias("fetched"), F.when(hit, F.col("e")).otherwise(F.col("n")).alias("entry"))


def fetch_state(requests: DataFrame, key: str = "uri", ts: str = "ts", ttl_seconds: int = TTL_SECONDS,
                state: DataFrame | None = None, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """ST2 (batch): a row per request: key, ts, fetched, entry_at. ``state`` (key,
    entry_at) are last fetches from before the requests. Of requests at the very time of a
    fetch one fetches. A null URI is a URI like any other; a request without a
    time is neither fetch nor hit (both null)."""
    ttl_us = ttl_seconds * 1_000_000
    ensure_checkpoint_dir(requests.sparkSession)
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    rows = requests.select(name(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    timed = rows.where("t IS NOT NULL").groupBy("k", "t").agg(F.count(F.lit(1)).alias("c")).checkpoint()
    if state is None:
        before = requests.sparkSession.createDataFrame([], "k string, e long")
    else:
        before = state.select(name(key).alias("k"), F.unix_micros(F.col("entry_at").cast("timestamp")).alias("e")).groupBy("k").agg(F.max("e").alias("e"))
    big = timed.groupBy("k").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > fold_rows).select("k").checkpoint()
    hot = not big.isEmpty()
    small = (timed.join(big, "k", "left_anti") if hot else timed).join(before, "k", "left")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        e = pdf["e"].iloc[0]
        fetched, entry, _ = _fold(pdf["t"].to_numpy(), ttl_us, None if pd.isna(e) else int(e))
        return pd.DataFrame({"k": pdf["k"], "t": pdf["t"], "fetched": fetched, "entry": entry, "c": pdf["c"]})

    each = small.groupBy("k").applyInPandas(fold, "k string, t long, fetched boolean, entry long, c long")
    if hot:
        large = timed.join(big, "k", "left_semi")
        each = each.unionByName(_by_stretches(large.select("k", "t"), before, ttl_us).join(large, ["k", "t"]))
    # Requests of the same time, made again from their number; the first of them may fetch.
    few = each.where(F.col("c") <= REPEATS).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)))
    many = each.where(F.col("c") > REPEATS).withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(c - 1) div {REPEATS}")))).repartition("k", "t", "p")
    many = many.withColumn("i", F.explode(F.sequence(F.col("p") * REPEATS, F.least(F.col("p") * REPEATS + REPEATS, F.col("c")) - 1))).drop("p")
    out = few.unionByName(many).select("k", F.timestamp_micros("t").alias(ts), (F.col("fetched") & (F.col("i") == 0)).alias("fetched"), F.timestamp_micros("entry").alias("entry_at"))
    none = rows.where("t IS NULL").select("k", F.lit(None).cast("timestamp").alias(ts), F.lit(None).cast("boolean").alias("fetched"), F.lit(None).cast("timestamp").alias("entry_at"))
    return out.unionByName(none).select(F.when(F.col("k") != "", F.substr("k", F.lit(2))).alias(key), ts, "fetched", "entry_at")


# Tables of the stream form below its root, a partition a batch.
DECISIONS, LATE, STATE, WAITING, MARKS = "decisions", "late", "state", "waiting", "marks"
TABLES = {
    DECISIONS: OUT_DDL, LATE: "uri string, ts timestamp", STATE: "uri string, entry_at timestamp",
    WAITING: "uri string, ts timestamp", MARKS: "mark bigint",
}


def state_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of ``run_fetch_state`` with all its versions, told apart by ``batch``."""
    return spark.read.schema(f"{TABLES[name]}, batch bigint").parquet(os.path.join(root, name))


def _version(spark: SparkSession, root: str, name: str, batch_id: int) -> DataFrame:
    if batch_id < 0:
        return spark.createDataFrame([], TABLES[name])
    return state_table(spark, root, name).where(F.col("batch") == batch_id).drop("batch")


def fetch_state_batch(batch: DataFrame, batch_id: int, root: str, ttl_seconds: int = TTL_SECONDS, delay_seconds: int = 600) -> None:
    """One micro-batch (uri, ts) of ``run_fetch_state``: decide what the watermark
    has passed, keep the rest. Everything it reads is the version of the batch
    before and everything it writes is its own, so a replay writes the same."""
    spark = configure(batch.sparkSession)

    def write(df: DataFrame, name: str) -> None:
        df = df.withColumn("batch", F.lit(batch_id).cast("long"))
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(os.path.join(root, name))

    before = _version(spark, root, MARKS, batch_id - 1).first()
    mark = before.mark if before else None
    us = F.unix_micros("ts")
    rows = batch.select(F.col("uri").cast("string").alias("uri"), F.col("ts").cast("timestamp").alias("ts"))
    is_late = F.coalesce(us <= F.lit(mark), F.lit(False))
    late, timely = rows.where(is_late), rows.where(~is_late)
    pool = timely.unionByName(_version(spark, root, WAITING, batch_id - 1))
    last = pool.agg(F.max(us)).first()[0]
    now = max((x for x in (mark, None if last is None else last - delay_seconds * 1_000_000) if x is not None), default=None)
    due = pool.where(F.col("ts").isNull() | (us <= F.lit(now))) if now is not None else pool.where("ts IS NULL")
    state = _version(spark, root, STATE, batch_id - 1)
    write(fetch_state(due, "uri", "ts", ttl_seconds, state), DECISIONS)
    write(late, LATE)
    write(pool.where(us > F.lit(now)) if now is not None else pool.where("false"), WAITING)
    decided = _version(spark, root, DECISIONS, batch_id).where("entry_at IS NOT NULL").select("uri", "entry_at")
    entries = state.unionByName(decided).groupBy("uri").agg(F.max("entry_at").alias("entry_at"))
    alive = entries.where(F.unix_micros("entry_at") + ttl_seconds * 1_000_000 > F.lit(now)) if now is not None else entries
    write(alive, STATE)
    write(spark.range(1).select(F.lit(now).cast("long").alias("mark")), MARKS)


def run_fetch_state(requests: DataFrame, root: str, checkpoint: str, ttl_seconds: int = TTL_SECONDS, delay_seconds: int = 600):
    """ST2 as a stream of batches: start a query over ``requests`` (uri, ts) that
    keeps decisions, late requests, waiting requests and last fetches below ``root``."""
    w = requests.select("uri", "ts").writeStream.option("checkpointLocation", checkpoint)
    return w.foreachBatch(lambda df, i: fetch_state_batch(df, i, root, ttl_seconds, delay_seconds)).trigger(availableNow=True).start()
