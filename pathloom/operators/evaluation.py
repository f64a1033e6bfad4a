"""Rank measures over scored rows with 0/1 labels.

Curves and areas come from the distinct scores with their counts, so ties
collapse and the cumulative frame runs over thresholds, in two levels: ranges of
scores first, thresholds within a range next. Rows with a NULL or NaN score or a
NULL label take no part; one class only gives NULL areas.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.columns import hi, lo, valid
from pathloom.storage import Scratch


def _ranges(df: DataFrame) -> int:
    """Ranges of scores: as many as the tasks of a shuffle, 64 at least."""
    return max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def cumulative(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """Add running sums ``c_<value>`` per ``keys`` in descending ``order``, inclusive.

    Rows are cut into ranges of ``order`` by its percentiles, so no task orders a whole key.
    """
    ranges = _ranges(df)
    cuts = df.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10_000).alias("cuts"))
    d = df.crossJoin(cuts).withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col(order)))).drop("cuts")  # one row of cuts
    sums = d.groupBy(*keys, "range").agg(*(F.sum(v).alias(f"s_{v}") for v in values))
    w = Window.partitionBy(*keys).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, "range", *(F.coalesce(F.sum(f"s_{v}").over(w), F.lit(0)).alias(f"b_{v}") for v in values))
    win = Window.partitionBy(*keys, "range").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(before, [*keys, "range"])
    return d.select(*df.columns, *((F.sum(v).over(win) + F.col(f"b_{v}")).alias(f"c_{v}") for v in values))


def medians(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, median): exact, from the counts of the distinct values. NULL is a key like any other; NULL and NaN values don't count."""
    n = df.where(valid(value)).select(F.struct(*keys).alias("k"), F.col(value).cast("double").alias("v")).groupBy("k", "v").agg(F.count("*").alias("n"))
    c = cumulative(Scratch(df.sparkSession, "medians").cut(n, "counts"), ["k"], "v", ["n"])
    total = c.groupBy("k").agg(F.sum("n").alias("total"))
    at = lambda p: F.max(F.when((F.col("c_n") >= p) & (F.col("c_n") - F.col("n") < p), F.col("v")))
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    return c.join(total, "k").groupBy("k").agg((at(low) / 2 + at(high) / 2).alias("median")).select("k.*", "median")


def thresholds(scored: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label") -> DataFrame:
    """(keys, score, tp, fp, c_tp, c_fp): counts at and above each distinct score."""
    ok = scored.where(valid(score) & F.col(label).isNotNull())
    g = ok.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(F.sum(F.col(label).cast("bigint")).alias("tp"), F.sum(1 - F.col(label).cast("bigint")).alias("fp"))
    return cumulative(Scratch(scored.sparkSession, "curve").cut(g, "thresholds"), keys, "score", ["tp", "fp"])


def areas(scored: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label") -> DataFrame:
    """(keys, n, n_positive, auc_roc, auc_pr); auc_pr is the average precision as a step sum."""
    t = thresholds(scored, keys, score, label)
    g = t.groupBy(*keys).agg(
        F.sum(F.col("tp") + F.col("fp")).alias("n"),
        F.sum("tp").alias("n_positive"),
        F.sum("fp").alias("n_negative"),
        F.sum(F.col("fp") * (F.col("c_tp") - F.col("tp") / 2.0)).alias("wins"),
        F.sum(F.col("tp") * F.col("c_tp") / (F.col("c_tp") + F.col("c_fp"))).alias("ap"),
    )
    both = (F.col("n_positive") > 0) & (F.col("n_negative") > 0)
    return g.select(*keys, "n", "n_positive", F.when(both, F.try_divide("wins", F.col("n_positive").cast("double") * F.col("n_negative"))).alias("auc_roc"), F.when(both, F.try_divide("ap", F.col("n_positive").cast("double"))).alias("auc_pr"))


def _corners(t: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Thresholds at which a ROC curve turns, and the last ones: the counts of the next lower threshold differ.

    The next threshold of the last one in a range of scores is the first of the next range,
    so no task orders a whole key.
    """
    ranges = _ranges(t)
    cuts = t.agg(F.percentile_approx("score", [i / ranges for i in range(1, ranges)], 10_000).alias("cuts"))
    d = t.crossJoin(cuts).withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("score")))).drop("cuts")  # one row of cuts
    step = F.struct("tp", "fp")
    firsts = d.groupBy(*keys, "range").agg(F.max_by(step, "score").alias("first"))
    down = Window.partitionBy(*keys).orderBy(F.desc("range"))
    firsts = firsts.select(*keys, "range", F.lead("first").over(down).alias("after"))
    within = Window.partitionBy(*keys, "range").orderBy(F.desc("score"))
    d = d.withColumn("next", F.lead(step).over(within)).join(firsts, [*keys, "range"])
    return d.where(~F.coalesce(F.coalesce("next", "after") == step, F.lit(False))).drop("range", "next", "after")


def roc_curve(scored: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """(keys, threshold, fpr, tpr) from (0, 0) at threshold infinity; points on a straight line between others are left out."""
    t = Scratch(scored.sparkSession, "roc").cut(thresholds(scored, keys, score, label), "thresholds")
    n = t.groupBy(*keys).agg(F.sum("tp").alias("p"), F.sum("fp").alias("q"))
    c = _corners(t, keys)
    j = c.join(n, list(keys)) if keys else c.crossJoin(n)  # one row of totals
    out = j.select(*keys, F.col("score").alias("threshold"), F.try_divide("c_fp", "q").alias("fpr"), F.try_divide("c_tp", "p").alias("tpr"))
    zero = F.lit(0.0)
    start = n.select(*keys, F.lit(float("inf")).alias("threshold"), F.when(F.col("q") > 0, zero).alias("fpr"), F.when(F.col("p") > 0, zero).alias("tpr"))
    return out.unionByName(start)


def pr_curve(scored: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """(keys, threshold, precision, recall) for each distinct score, and (1, 0) without a threshold."""
    t = thresholds(scored, keys, score, label)
    n = t.groupBy(*keys).agg(F.sum("tp").alias("p"))
    j = t.join(n, list(keys)) if keys else t.crossJoin(n)  # one row of totals
    out = j.select(*keys, F.col("score").alias("threshold"), (F.col("c_tp") / (F.col("c_tp") + F.col("c_fp"))).alias("precision"), F.try_divide("c_tp", "p").alias("recall"))
    end = n.select(*keys, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.when(F.col("p") > 0, 0.0).alias("recall"))
    return out.unionByName(end)


def label_pairs(predictions: DataFrame, known: DataFrame) -> DataFrame:
    """Predictions with ``label`` 1 where the unordered pair is in ``known(drug_lo, drug_hi)``."""
    k = known.select("drug_lo", "drug_hi").distinct().withColumn("_k", F.lit(1))
    p = predictions.withColumn("drug_lo", lo("drug_a", "drug_b")).withColumn("drug_hi", hi("drug_a", "drug_b"))
    return p.join(k, ["drug_lo", "drug_hi"], "left").withColumn("label", F.coalesce("_k", F.lit(0))).drop("_k")


def evaluate(predictions: DataFrame, known: DataFrame, score: str = "prediction_score") -> DataFrame:
    """(disease, n_predictions, n_positive, n_known_synergies, auc_roc, auc_pr); all known pairs count, matched or not."""
    scored = label_pairs(predictions, known).where("disease is not null")
    a = areas(scored, ["disease"], score)
    n_known = known.select("drug_lo", "drug_hi").distinct().agg(F.count("*").alias("n_known_synergies"))
    return a.withColumnRenamed("n", "n_predictions").crossJoin(n_known)  # one row


def report(evaluation: DataFrame) -> DataFrame:
    """Best first; diseases without an area last."""
    return evaluation.orderBy(F.desc_nulls_last("auc_roc"), "disease")
