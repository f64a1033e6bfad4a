"""Connected components: peel what the highest-degree vertex reaches, then alternating minimum propagation.

A hub may hold a third of all edges. The search splits each vertex's edges by a
salt of their far end and hands a large frontier to all splits of its vertices;
a frontier whose counted rows are few is broadcast instead. Peeling first takes
the hub away, so the propagation sees small components only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.storage import BROADCAST_ROWS, Scratch, measured, rows, sized

SALTS = 8

#: Levels of the search; a first component deeper than that is contracted and left to the propagation.
MAX_LEVELS = 24


def _salt(far_end: str) -> Column:
    return F.pmod(F.xxhash64(far_end), F.lit(SALTS)).cast("int")


def reach_from_hub(edges: DataFrame, scratch: Scratch, max_levels: int | None = None) -> tuple[DataFrame, bool]:
    """Vertices (node) reached from the highest-degree one of ``edges(lo, hi)``, and whether all are.

    Of several highest-degree vertices the smallest starts. A level is compared with the
    two before it, which suffices in an undirected graph; each is a table in the shared
    folder. No edges give no vertices; after ``max_levels`` levels the search stops short.
    """
    ends = F.array(
        F.struct(F.col("lo").alias("src"), F.col("hi").alias("dst")),
        F.struct(F.col("hi").alias("src"), F.col("lo").alias("dst")),
    )
    adjacent = scratch.cut(edges.select(F.explode(ends).alias("e")).select("e.*"), "adjacent")
    degree = adjacent.groupBy("src").count()
    seed = degree.orderBy(F.desc("count"), "src").limit(1).select(F.col("src").alias("node"))
    levels = [scratch.cut(seed, "level")]
    complete = rows(levels[0]) == 0
    while not complete and (max_levels is None or len(levels) <= max_levels):
        last = levels[-1]
        if rows(last) <= BROADCAST_ROWS:
            near = adjacent.join(F.broadcast(last), F.col("src") == F.col("node"), "left_semi")
        else:
            split = last.select(F.col("node").alias("src"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
            near = adjacent.withColumn("salt", _salt("dst")).join(split.hint("merge"), ["src", "salt"])
        step = near.select(F.col("dst").alias("node")).distinct()
        for before in levels[-2:]:
            step = step.join(sized(before), "node", "left_anti")
        step = scratch.cut(step, "level")
        complete = rows(step) == 0
        if not complete:
            levels.append(step)
    scratch.drop(adjacent)
    reached = levels[0]
    for level in levels[1:]:
        reached = reached.unionByName(level)
    reached = scratch.cut(reached, "reached", least=F.min("node"))
    scratch.drop(*levels)
    return reached, complete


def connected(edges: DataFrame, scratch: Scratch, max_levels: int = MAX_LEVELS) -> DataFrame:
    """(group, member) over the distinct ``edges(lo, hi)`` with lo < hi; group is the smallest member.

    The component of the hub is found by breadth-first joins and taken away by an
    anti-join; the rest is left to ``min_label_components``. If it is deeper than
    ``max_levels`` levels, what was reached is contracted into its smallest member.
    """
    peeled, complete = reach_from_hub(edges, scratch, max_levels)
    root = F.lit(measured(peeled).get("least"))
    giant = peeled.select(root.alias("group"), F.col("node").alias("member"))
    if complete:
        rest = edges.join(_side(peeled, "lo"), "lo", "left_anti")
        return giant.unionByName(min_label_components(rest, scratch))
    rest = edges
    for end in ("lo", "hi"):
        rest = rest.join(_side(peeled, end).withColumn(f"{end}_in", F.lit(True)), end, "left")
    x = F.when(F.col("lo_in"), root).otherwise(F.col("lo"))
    y = F.when(F.col("hi_in"), root).otherwise(F.col("hi"))
    rest = rest.where("lo_in is null or hi_in is null").select(F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi"))
    small = scratch.cut(min_label_components(rest.distinct(), scratch), "small")
    home = small.where(F.col("member") == root).select(F.col("group").alias("home"))  # at most one row
    giant = giant.join(home, how="left").select(F.coalesce("home", "group").alias("group"), "member")
    return giant.unionByName(small.where(F.col("member") != root))


def _side(table: DataFrame, name: str) -> DataFrame:
    """The single column of a table of ``cut`` as ``name``, broadcast only if its counted rows are few."""
    out = table.select(F.col(table.columns[0]).alias(name))
    return F.broadcast(out) if rows(table) <= BROADCAST_ROWS else out.hint("merge")


def min_label_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(group, member) over ``edges(lo, hi)`` with lo < hi; group is the smallest member.

    In each round every vertex hands the minimum of its neighbourhood to its
    larger neighbours, then to its smaller ones; chains shorten geometrically, so
    a chain of n vertices takes about log n rounds. Minima are pre-aggregated.
    """
    state = {"x": F.bit_xor(F.xxhash64("u", "m")), "y": F.bit_xor(F.xxhash64("m", F.lit(1), "u"))}  # the edges are distinct
    now = scratch.cut(edges.select(F.col("hi").alias("u"), F.col("lo").alias("m")), "round", **state)
    while rows(now):
        both = now.select("u", F.col("m").alias("v")).unionByName(now.select(F.col("m").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v0")).select("u", F.least("u", "v0").alias("m"))
        up = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), "m").distinct()
        least = up.groupBy("u").agg(F.min("m").alias("m0"))
        to_root = F.struct("u", F.col("m0").alias("m"))
        down = up.join(least, "u").select(F.explode(F.array(to_root, F.struct(F.col("m").alias("u"), F.col("m0").alias("m")))).alias("e"))
        new = scratch.cut(down.select("e.*").where("u > m").distinct(), "round", **state)
        same = measured(new) == measured(now)
        scratch.drop(now)
        now = new
        if same:
            break
    tops = now.select(F.col("m").alias("group"), F.col("m").alias("member")).distinct()
    return now.select(F.col("m").alias("group"), F.col("u").alias("member")).unionByName(tops)
