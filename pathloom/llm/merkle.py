"""Collapsing records that differ in formatting only, by bottom-up hashing.

A record is a small tree: leaves are columns, inner nodes are ordered or
unordered. Leaves are normalised and hashed, an unordered node hashes its
children's digests in sorted order, and rows group by the root digest. Within a
digest the normalised values themselves are compared, so a hash collision never
merges two records. Groups are pre-aggregated before the shuffle. Where copies
are listed, the repeated groups are a table of their own, so that the join with
the rows is one that AQE splits, however large a group is.

Rows whose required leaves are NULL, or empty once normalised, belong to no
record. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.storage import Scratch


@dataclass(frozen=True)
class Node:
    """A leaf (``column``) or an inner node over ``children``."""

    column: str | None = None
    children: tuple["Node", ...] = ()
    unordered: bool = False


def leaf(column: str) -> Node:
    return Node(column=column)


def unordered(*children: Node) -> Node:
    return Node(children=children, unordered=True)


def ordered(*children: Node) -> Node:
    return Node(children=children)


def normalised(column: str) -> Column:
    """Letters and digits in lower case; everything else goes."""
    return F.regexp_replace(F.lower(F.col(column)), r"[^\p{L}\p{Nd}]+", "")


def leaves(node: Node) -> list[str]:
    return [node.column] if node.column else [c for n in node.children for c in leaves(n)]


def digest(node: Node) -> Column:
    """Digest of a node over normalised columns of the same names."""
    if node.column:
        return F.xxhash64(F.lit("leaf"), F.col(node.column))
    parts = [digest(c) for c in node.children]
    if not node.unordered:
        return F.xxhash64(F.lit("list"), *parts)
    if len(parts) == 2:
        return F.xxhash64(F.lit("bag"), F.least(*parts), F.greatest(*parts))
    return F.xxhash64(F.lit("bag"), F.array_sort(F.array(*parts)))


def structure(node: Node) -> Column:
    """The normalised record itself as text, the children of unordered nodes in order, whatever their kinds.

    Leaves hold letters and digits only, so brackets and commas can't be part of one.
    """
    if node.column:
        return F.col(node.column)
    parts = [structure(c) for c in node.children]
    if not node.unordered:
        return F.concat(F.lit("("), F.concat_ws(",", *parts), F.lit(")"))
    inner = F.concat_ws(",", F.array_sort(F.array(*parts))) if len(parts) != 2 else F.concat_ws(",", F.least(*parts), F.greatest(*parts))
    return F.concat(F.lit("{"), inner, F.lit("}"))


def fingerprints(df: DataFrame, tree: Node, record_id: str) -> DataFrame:
    """(record_id, digest, record) for rows whose leaves all have content."""
    cols = leaves(tree)
    out = df.select(F.col(record_id).alias("record_id"), *(normalised(c).alias(c) for c in cols))
    full = out.where(" and ".join(f"`{c}` <> ''" for c in cols)).where("record_id is not null")
    return full.select("record_id", digest(tree).alias("digest"), structure(tree).alias("record"))


def collapse(df: DataFrame, tree: Node, record_id: str) -> DataFrame:
    """One row per record: (kept_id, record, n_copies), n_copies counting the kept row too."""
    g = fingerprints(df, tree, record_id).groupBy("digest", "record")
    return g.agg(F.min("record_id").alias("kept_id"), F.count("*").alias("n_copies")).select("kept_id", "record", "n_copies")


def copies(df: DataFrame, tree: Node, record_id: str) -> DataFrame:
    """(kept_id, copy_id) for each row that repeats a record with a smaller id."""
    rows = fingerprints(df, tree, record_id)
    groups = rows.groupBy("digest", "record").agg(F.min("record_id").alias("kept_id"), F.max("record_id").alias("last_id"))
    repeated = Scratch(df.sparkSession, "copies").cut(groups.where("kept_id < last_id").select("digest", "record", "kept_id"), "repeated")
    pairs = rows.join(repeated, ["digest", "record"])
    return pairs.where("record_id > kept_id").select("kept_id", F.col("record_id").alias("copy_id"))


def interaction_tree(ends: Sequence[str] = ("protein_a", "protein_b"), source: str = "source") -> Node:
    """An interaction: its two ends in either order, and its source."""
    return ordered(unordered(*(leaf(e) for e in ends)), leaf(source))
