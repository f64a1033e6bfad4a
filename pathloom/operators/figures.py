"""Tables behind the figures: histograms, stacked components, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.columns import valid

COMPONENTS = ("tqab", "pqab", "cqab")


def require_columns(df: DataFrame, columns: Sequence[str], what: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise KeyError(f"{what} lacks {missing}; it has {df.columns}")


def histogram(df: DataFrame, value: str, bins: int, log: bool = False, keys: Sequence[str] = (), least: float | None = None) -> DataFrame:
    """(keys, bin, lo, hi, n): equal bins (in log10 with ``log``) from least to largest value, the last one closed.

    ``least`` takes the place of the least value, and must not be above it. A single distinct value v gives bins over [v - 0.5, v + 0.5]. NULL, NaN and, with
    ``log``, values below or at 0 are left out. Empty bins are not listed.
    """
    ok = df.where(valid(value)).select(*keys, F.col(value).cast("double").alias("v"))
    if log:
        ok = ok.where("v > 0").withColumn("v", F.log10("v"))
    span = ok.groupBy(*keys).agg(F.min("v").alias("a"), F.max("v").alias("b"))
    if least is not None:
        span = span.withColumn("a", F.log10(F.lit(least)) if log else F.lit(least))
    flat = F.col("a") == F.col("b")
    span = span.select(*keys, F.when(flat, F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(flat, F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    j = ok.join(span, list(keys)) if keys else ok.crossJoin(span)  # one row of bounds
    width = (F.col("b") - F.col("a")) / bins
    k = F.least(F.floor((F.col("v") - F.col("a")) / width).cast("int"), F.lit(bins - 1))
    g = j.groupBy(*keys, "a", "b", k.alias("bin")).agg(F.count("*").alias("n"))
    edge = lambda i: F.pow(F.lit(10.0), F.col("a") + i * width) if log else F.col("a") + i * width
    return g.select(*keys, "bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"), "n")


def degree_histogram(degrees: DataFrame, log: bool = True) -> DataFrame:
    """(bin, lo, hi, n) of ``degrees(gene, degree)``: 49 bins in log10 from degree 1, or 50 equal ones, isolated nodes included.

    No nodes at all are refused, and with ``log`` none but isolated ones, too.
    """
    r = degrees.agg(F.count("*").alias("n"), F.max("degree").alias("top")).first()
    if not r["n"]:
        raise ValueError("a graph without nodes has no degrees")
    if log and not r["top"]:
        raise ValueError("isolated nodes only: nothing can stand on a logarithmic axis")
    return histogram(degrees, "degree", 49, log=True, least=1.0) if log else histogram(degrees, "degree", 50)


def score_histograms(predictions: DataFrame, bins: int = 30) -> DataFrame:
    """Histograms of T, P and C; a missing component is tolerated, all three missing are not."""
    have = [c for c in COMPONENTS if c in predictions.columns]
    if not have:
        raise KeyError(f"none of {COMPONENTS} in {predictions.columns}")
    return histogram(predictions.unpivot([], have, "component", "v"), "v", bins, keys=["component"])


def stacked_top(predictions: DataFrame, k: int = 20) -> DataFrame:
    """(rank, label, component, base, width, total): signed stacks of the ``k`` best rows, each sign from 0."""
    require_columns(predictions, ["drug_a", "drug_b", "prediction_score", *COMPONENTS], "predictions")
    order = [F.desc("prediction_score"), F.asc("disease"), F.asc("drug_a"), F.asc("drug_b"), F.asc("prediction_id")]
    order = [o for o, c in zip(order, ("prediction_score", "disease", "drug_a", "drug_b", "prediction_id")) if c in predictions.columns]
    top = predictions.where(valid("prediction_score")).orderBy(*order).limit(k)
    ranked = top.withColumn("o", F.struct((-F.col("prediction_score")).alias("s"), *(c for c in ("disease", "drug_a", "drug_b", "prediction_id") if c in predictions.columns)))
    rows = ranked.agg(F.array_sort(F.collect_list(F.struct("o", "drug_a", "drug_b", "prediction_score", *COMPONENTS))).alias("r"))  # k rows
    r = rows.select(F.posexplode("r").alias("rank", "r"))
    parts, pos, neg = [], F.lit(0.0), F.lit(0.0)
    for c in COMPONENTS:
        v = F.coalesce(F.col(f"r.{c}"), F.lit(0.0))
        parts.append(F.struct(F.lit(c).alias("component"), F.when(v >= 0, pos).otherwise(neg).alias("base"), v.alias("width")))
        pos, neg = pos + F.greatest(v, F.lit(0.0)), neg + F.least(v, F.lit(0.0))
    out = r.select((F.col("rank") + 1).alias("rank"), F.concat_ws("-", "r.drug_a", "r.drug_b").alias("label"), F.col("r.prediction_score").alias("total"), F.explode(F.array(*parts)).alias("p"))
    return out.select("rank", "label", "p.component", "p.base", "p.width", "total")


def auc_comparison(evaluation: DataFrame) -> DataFrame:
    """(disease, metric, value) of both areas; diseases without one keep a NULL. No rows and missing metrics are refused."""
    if missing := [m for m in ("auc_roc", "auc_pr") if m not in evaluation.columns]:
        some = [r[0] for r in evaluation.select("disease").orderBy("disease").limit(5).collect()]
        raise KeyError(f"no {missing} for {some}")
    if evaluation.isEmpty():
        raise ValueError("no results to compare")
    return evaluation.select("disease", "auc_roc", "auc_pr").unpivot(["disease"], ["auc_roc", "auc_pr"], "metric", "value")
