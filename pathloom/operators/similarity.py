"""Set and vector similarities as labelled pair tables (i < j); diagonals are 1.0 by definition.

A search takes a stated set of rows (``asked``) against all rows, in blocks; without one
the full matrix is the result. Common elements are counted by a join on them, and pairs
that share nothing are 0.0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.operators.pairs import against

#: metric name -> Column over inter, n_i, n_j
SET_METRICS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "jaccard": lambda k, a, b: F.when(a + b == 0, 1.0).otherwise(F.try_divide(k.cast("double"), a + b - k)),
    "overlap": lambda k, a, b: F.when(a + b == 0, 1.0).when((a == 0) | (b == 0), 0.0).otherwise(F.try_divide(k.cast("double"), F.least(a, b))),
}


def set_metric(name: str) -> Callable[[Column, Column, Column], Column]:
    if name not in SET_METRICS:
        raise ValueError(f"unknown set metric {name!r}; one of {sorted(SET_METRICS)}")
    return SET_METRICS[name]


def _search(items: DataFrame, ident: str, asked: DataFrame | None, values: list[str]) -> DataFrame:
    """(a, b, a_<value>, b_<value>): unordered pairs once, of the items ``asked(ident)`` with all, or of all (a < b)."""
    side = lambda p: items.select(F.col(ident).alias(p), *(F.col(v).alias(f"{p}_{v}") for v in values))
    if asked is None:
        return side("a").join(side("b"), F.col("a") < F.col("b"))
    q = asked.select(F.col(ident).alias("a")).distinct()
    others = side("b").join(q.select(F.col("a").alias("b"), F.lit(True).alias("_hit")), "b", "left")
    p = against(side("a").join(q, "a", "left_semi"), others)
    return p.where((F.col("a") < F.col("b")) | ((F.col("a") > F.col("b")) & F.col("_hit").isNull())).drop("_hit")


def set_similarity(modules: DataFrame, method: str = "jaccard", asked: DataFrame | None = None, full: bool = True) -> DataFrame:
    """(module_i, module_j, sim) for module_i < module_j over ``modules(module, gene)``; a NULL gene marks an empty module.

    With ``asked(module)`` only pairs that hold one of these. ``full=False`` leaves out pairs
    without a common gene.
    """
    metric = set_metric(method)
    m = modules.select("module", "gene").where("module is not null").distinct()
    n = m.groupBy("module").agg(F.count("gene").alias("n"))
    g = m.where("gene is not null")
    mine = g if asked is None else g.join(asked.select("module").distinct(), "module", "left_semi")
    shared = mine.withColumnRenamed("module", "a").join(g.withColumnRenamed("module", "b"), "gene").where("a < b" if asked is None else "a <> b")
    shared = shared.groupBy("a", "b").agg(F.count("*").alias("k"))
    if full:
        pairs = _search(n, "module", asked, ["n"]).join(shared, ["a", "b"], "left")
    else:
        sizes = lambda p: n.select(F.col("module").alias(p), F.col("n").alias(f"{p}_n"))
        pairs = shared.join(sizes("a"), "a").join(sizes("b"), "b")
    sim = metric(F.coalesce("k", F.lit(0)), F.col("a_n"), F.col("b_n"))
    out = pairs.select(F.least("a", "b").alias("module_i"), F.greatest("a", "b").alias("module_j"), sim.alias("sim"))
    return out if full or asked is None else out.distinct()


def check_fingerprints(df: DataFrame, bits: str = "bits") -> None:
    """Refuse vectors of mixed length or with entries other than 0 and 1."""
    r = df.agg(F.min(F.size(bits)).alias("a"), F.max(F.size(bits)).alias("b"), F.min(F.forall(bits, lambda x: x.isin(0, 1))).alias("ok"), F.count("*").alias("n")).first()
    if not r["n"]:
        raise ValueError("no fingerprints")
    if r["a"] != r["b"] or not r["ok"]:
        raise ValueError("fingerprints must be 0/1 vectors of one length")


def tanimoto(fingerprints: DataFrame, ident: str = "mol", bits: str = "bits", asked: DataFrame | None = None) -> DataFrame:
    """(i, j, sim), i < j: shared bits over united bits from packed words; two empty ones give 0.0."""
    words = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(bits) - 1) / 32).cast("int")),
        lambda w: F.aggregate(F.slice(bits, w * 32 + 1, 32), F.lit(0).cast("bigint"), lambda a, x: a * 2 + x.cast("bigint")),
    )
    ones = lambda c: F.aggregate(F.transform(c, F.bit_count), F.lit(0), lambda a, x: a + x)
    p = fingerprints.select(ident, words.alias("w")).withColumn("n", ones("w"))
    j = _search(p, ident, asked, ["w", "n"])
    both = ones(F.zip_with("a_w", "b_w", lambda x, y: x.bitwiseAND(y)))
    union = F.col("a_n") + F.col("b_n") - both
    sim = F.when(union == 0, 0.0).otherwise(F.try_divide(both.cast("double"), union))
    return j.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), sim.alias("sim"))


def cosine(vectors: DataFrame, ident: str = "mol", vector: str = "bits", asked: DataFrame | None = None) -> DataFrame:
    """(i, j, sim), i < j; a zero vector gives 0.0."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    v = vectors.select(ident, F.transform(vector, lambda x: x.cast("double")).alias("v")).withColumn("n", F.sqrt(dot("v", "v")))
    j = _search(v, ident, asked, ["v", "n"])
    norm = F.col("a_n") * F.col("b_n")
    sim = F.when(norm == 0, 0.0).otherwise(F.try_divide(dot("a_v", "b_v"), norm))
    return j.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), sim.alias("sim"))


def drug_similarity(fingerprints: DataFrame, method: str = "tanimoto", ident: str = "mol", bits: str = "bits", asked: DataFrame | None = None) -> DataFrame:
    """(i, j, sim) of unordered pairs: of the rows ``asked(ident)`` with all, or of all."""
    if method not in ("tanimoto", "cosine"):
        raise ValueError(f"unknown method {method!r}")
    check_fingerprints(fingerprints, bits)
    return (tanimoto if method == "tanimoto" else cosine)(fingerprints, ident, bits, asked)


def pair_matrix(entities: DataFrame, ident: str, similarity: Callable[[Column, Column], Column], value: str, asked: DataFrame | None = None) -> DataFrame:
    """(i, j, sim) of any symmetric Column builder or pandas UDF, called once per unordered pair."""
    j = _search(entities, ident, asked, [value])
    return j.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), similarity(F.col(f"a_{value}"), F.col(f"b_{value}")).alias("sim"))


def with_diagonal(pairs: DataFrame, entities: DataFrame, ident: str) -> DataFrame:
    """The whole symmetric matrix of a pair table (i, j, sim)."""
    back = pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "sim")
    own = entities.select(F.col(ident).alias("i"), F.col(ident).alias("j"), F.lit(1.0).alias("sim"))
    return pairs.unionByName(back).unionByName(own)
