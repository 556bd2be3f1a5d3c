"""Mixing sources to target weights by soft membership.

A classifier fitted on the labelled table gives each document posteriors over
the domains. Document rates r >= 0 then minimise the squared distance of the
expected domain tokens, sum of r * tokens * posterior, from their targets, by
projected gradient steps whose sums over the corpus Spark computes.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pliego.llm.common import KEY, cut, row_key, whole_row
from pliego.llm.features import FEATURES, labelled_sample, learn_lexicons, with_features

DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.85, "low": 0.10, "toxic": 0.05}
TRAIN_ROWS = 24_000  # labelled rows that the classifier is fitted on, about, at most
ROUNDS = 60
TOLERANCE = 1e-4  # of the total, that a domain's tokens may be off


def domain(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Number of the labelled row's domain; toxic before low quality before clean."""
    return F.when(F.col(toxic) == 1, 2).when(F.col(quality) == 0, 1).when(F.col(quality).isNotNull() & F.col(toxic).isNotNull(), 0)


def posteriors(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, keep: list[str], bound: int = TRAIN_ROWS) -> DataFrame:
    """``keep``, tokens (white-space words) and p (array over DOMAINS). Without labels
    of two domains, all documents are what the labels say, or clean."""
    some = labels.select(doc_id, domain().alias("d"))
    sample = cut(labelled_sample(docs, some, ["d"], text, doc_id, bound), "labelled")
    seen = {r["d"]: r["count"] for r in sample.groupBy("d").count().collect()}
    if len(seen) < 2:
        sure = F.array(*[F.lit(float(k == next(iter(seen), 0))) for k in range(len(DOMAINS))])
        return with_features(docs, text, keep, {}).select(*keep, F.col("n_words").alias("tokens"), sure.alias("p"))
    # Each half of the sample is seen under the other's lexicon, the corpus under that of both.
    sample = sample.withColumn("half", F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(2)).cast("int")).withColumn("y", (F.col("d") == 2).cast("int"))
    lexicons = learn_lexicons(sample, "y", "half")
    lexicon = lexicons[None]
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep")
    halves = [with_features(sample.filter(F.col("half") == k), "_text", ["d"], lexicons.get(1 - k, lexicon)) for k in (0, 1)]
    known = assemble.transform(cut(halves[0].unionByName(halves[1]), "features").repartition(6))
    forest = RandomForestClassifier(featuresCol="features", labelCol="d", numTrees=24, maxDepth=7, minInstancesPerNode=3, seed=1).fit(known)
    scored = forest.transform(assemble.transform(with_features(docs, text, keep, lexicon)))
    p = vector_to_array("probability")
    p = F.array(*[p[k] if k < forest.numClasses else F.lit(0.0) for k in range(len(DOMAINS))])
    return scored.select(*keep, F.col("n_words").alias("tokens"), p.alias("p"))


def fit_rates(rows: DataFrame, targets: list[float], lower: Column | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``rows`` (tokens, p; read from files) with ``rate``.

    Rates start at 1 and stay at or above ``lower`` (0 unless given). In the
    metric that weighs a document by its tokens, a step subtracts p . g from
    every rate and projects; g is the residual of the domain totals behind the
    inverse of M, the sum of tokens * p * p', which bounds the curvature by 1, so
    no step overshoots. The driver holds one number a domain and round. Residuals
    are relative to M, so targets out of reach are missed in that measure.
    """
    k = len(targets)
    p = [F.col("p")[i] for i in range(k)]
    t = F.col("tokens").cast("double")
    sums = rows.agg(*[F.sum(t * p[i] * p[j]).alias(f"m{i}{j}") for i in range(k) for j in range(i, k)]).first()
    m = np.array([[sums[f"m{min(i, j)}{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    inverse = np.linalg.pinv(m, hermitian=True)
    low = F.lit(0.0) if lower is None else lower
    now = rows.withColumn("_low", low.cast("double")).withColumn("rate", F.greatest(F.lit(1.0), F.col("_low")))
    want, best = np.array(targets), None
    for i in range(rounds):
        have = np.array([v or 0.0 for v in now.agg(*[F.sum(t * F.col("rate") * x) for x in p]).first()])
        off = have - want
        error = float(off @ inverse @ off)
        if np.abs(off).max() <= tolerance * want.sum() or best is not None and error > best * (1 - 1e-6):
            break
        best = error
        g = inverse @ off
        step = sum((x * F.lit(float(v)) for x, v in zip(p, g, strict=True)), F.lit(0.0))
        now = now.withColumn("rate", F.greatest(F.col("_low"), F.col("rate") - step))
        if i % 12 == 11:
            now = cut(now, "rates")
    return now.drop("_low")


def mix(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", targets: dict[str, float] | None = None, protect: str | None = None, total: float | None = None) -> DataFrame:
    """doc_id, tokens, p, rate, copies, _k1, _k2, one row per row of ``docs``.

    ``targets`` are weights over DOMAINS of ``total`` tokens (the corpus's own
    unless given). ``protect`` names a domain none of whose documents is sampled
    away: where it is a document's most likely one, the rate is at least 1, and
    ``total`` is chosen so that the domain keeps its tokens. ``copies`` is the
    rate rounded up or down by a hash of the row, right on average. Null and
    empty texts have no tokens and rate 1 or what their posteriors give;
    repeated rows get equal rates; an empty table gives none.
    """
    targets = targets or TARGETS
    keyed = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), *row_key(doc_id, text))
    rows = cut(posteriors(keyed, labels.withColumnRenamed(doc_id, "_id"), "_text", "_id", ["_id", *KEY]), "posteriors")
    have = [v or 0.0 for v in rows.agg(*[F.sum(F.col("tokens") * F.col("p")[k]) for k in range(len(DOMAINS))]).first()]
    weights = [targets.get(d, 0.0) / sum(targets.values()) for d in DOMAINS]
    lower = None
    if protect:
        k = DOMAINS.index(protect)
        lower = (F.col("p")[k] >= F.array_max("p")).cast("double")
        total = total or have[k] / weights[k]
    total = sum(have) if total is None else total
    fitted = fit_rates(rows, [w * total for w in weights], lower)
    chance = F.pmod(F.xxhash64(*KEY), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return fitted.select(F.col("_id").alias(doc_id), "tokens", "p", "rate", F.floor(F.col("rate") + chance).cast("int").alias("copies"), *KEY)


def mixed_documents(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", targets: dict[str, float] | None = None, protect: str | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as its copies say."""
    found = mix(docs, labels, text, doc_id, targets, protect)
    copies = cut(found.groupBy(*KEY).agg(F.max("copies").alias("_copies")).filter("_copies > 0"), "copies")
    rows = docs.select(whole_row(), *row_key(doc_id, text)).join(copies, KEY)
    return rows.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")
