"""Toxicity: gradient-boosted trees over dense features, calibrated.

Lexicon, trees and calibration are learned from parts of a bounded sample of
labelled rows; all documents are scored in one narrow pass.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pliego.llm.common import cut
from pliego.llm.features import FEATURES, labelled_sample, learn_lexicons, with_features

TRAIN_ROWS = 24_000  # labelled rows that the model is fitted on, about, at most
HELD_OUT = 2  # remainder of crc32(doc_id) by 4 whose labels are never seen
AT = 0.3  # score from which a document counts as toxic
TREES, DEPTH = 20, 4


def fold(doc_id: str) -> Column:
    return F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")), F.lit(4)).cast("int")


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", bound: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``.

    Scores follow from the text alone. Rows of remainders 0 and 1 teach the
    lexicon and the trees, each seen by the trees under the other's lexicon, so
    that no word is judged by the rows it was learned from; those of 3 teach the
    isotonic calibration. A hair of the uncalibrated score orders documents
    within a calibration step. Null and empty texts are scored
    as empty. Where the labelled rows of a part lack one of the classes, the
    score is the share of positive labels seen (0 without labels). A null doc_id
    is not held out; an empty table gives none; repeated rows score alike.
    """
    some = labels.filter(fold(doc_id) != HELD_OUT).select(doc_id, F.col(label).cast("int").alias("y"))
    sample = cut(labelled_sample(docs, some, ["y"], text, doc_id, bound).withColumn("fold", fold("_id")), "labelled")
    seen = {(r["fold"], r["y"]): r["count"] for r in sample.groupBy("fold", "y").count().collect()}  # 6 rows
    held = F.coalesce(fold(doc_id) == HELD_OUT, F.lit(False)).alias("held_out")
    if all(seen.get((k, y), 0) for k in (0, 1, 3) for y in (0, 1)):
        lexicons = learn_lexicons(sample.filter("fold <> 3"), "y", "fold")
        lexicon = lexicons[None]
        assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep")
        parts = [with_features(sample.filter(F.col("fold") == k), "_text", ["fold", "y"], words) for k, words in ((0, lexicons[1]), (1, lexicons[0]), (3, lexicon))]
        known = cut(parts[0].unionByName(parts[1]).unionByName(parts[2]), "features")
        known = assemble.transform(known.repartition(6))
        trees = GBTClassifier(featuresCol="features", labelCol="y", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, minInstancesPerNode=5, seed=1).fit(known.filter("fold <> 3"))
        raw = vector_to_array("probability")[1]
        steps = IsotonicRegression(featuresCol="raw", labelCol="y").fit(trees.transform(known.filter("fold = 3")).select(raw.alias("raw"), "y"))
        scored = trees.transform(assemble.transform(with_features(docs.select(doc_id, text), text, [doc_id], lexicon)))
        scored = steps.transform(scored.select(doc_id, raw.alias("raw")))
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.999 * F.col("prediction") + 0.001 * F.col("raw")))
    else:
        total = sum(seen.values())
        scored, score = docs, F.lit(sum(n for (_, y), n in seen.items() if y) / total if total else 0.0)
    return scored.select(doc_id, held, score.alias("score")).withColumn("predicted", (F.col("score") >= AT).cast("int"))
