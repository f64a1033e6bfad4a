"""Connected groups over pairwise matches: peel the giant component, then propagate minima.

The giant component is found by breadth-first joins from the vertex of highest
degree; a level is compared with the two levels before it only, which is all an
undirected search needs. Its edges are taken away by an anti-join. What is left
are small components, perhaps long chains: these are labelled by propagating the
minimum of each neighbourhood, in alternating rounds to the larger neighbours
and to the smaller ones, so that a chain of n links takes about log n rounds.
If the first component is too deep for ``max_levels`` levels, the part reached
is contracted into one vertex and the minimum propagation joins the rest to it.

Each level and round is a table in the shared folder; nothing but counts reaches
the driver. Degrees and minima are pre-aggregated, and a hub's links are split by
salt. Links with a NULL or empty end join nothing; a link of an item with
itself makes that item a group of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.components import MAX_LEVELS, connected
from pathloom.storage import Scratch


def connected_groups(links: DataFrame, a: str, b: str, max_levels: int = MAX_LEVELS) -> DataFrame:
    """(group, member), one row per item, ``group`` being the smallest item of the group."""
    scratch = Scratch(links.sparkSession, "groups")
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> '' and b <> ''")
    pairs = scratch.cut(ends.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "pairs")
    known = connected(pairs.where("lo < hi"), scratch, max_levels)
    lone = pairs.where("lo = hi").select(F.col("lo").alias("group"), F.col("lo").alias("member"))
    return known.unionByName(lone.join(known, "member", "left_anti").select("group", "member"))


def protein_key(column: str):
    """A protein written with its letters in upper case and its digits, without anything else."""
    return F.regexp_replace(F.upper(F.col(column)), r"[^\p{L}\p{Nd}]+", "")


def protein_groups(interactions: DataFrame) -> DataFrame:
    """(group_protein, protein) over the links of an interaction table."""
    links = interactions.select(protein_key("protein_a").alias("a"), protein_key("protein_b").alias("b"))
    return connected_groups(links, "a", "b").select(F.col("group").alias("group_protein"), F.col("member").alias("protein"))
