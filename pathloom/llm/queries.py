"""Registered queries of the numbered problems 2 to 9, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import abuse, canonical, components, contamination, merkle, mixing, quantiles, top_n
from pathloom.sources.tables import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.copies(table(spark, sf, "interactions"), merkle.interaction_tree(), "interaction_id")


def p2_records(spark: SparkSession, sf: str) -> DataFrame:
    """One row per record with the number of its copies."""
    out = merkle.collapse(table(spark, sf, "interactions"), merkle.interaction_tree(), "interaction_id")
    part = F.split(F.translate("record", "(){}", ""), ",")
    return out.select("kept_id", part[0].alias("protein_lo"), part[1].alias("protein_hi"), part[2].alias("source_key"), "n_copies")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return top_n.top_pairs(table(spark, sf, "predictions")).select("run_id", "disease", "drug_lo", "drug_hi")


def p3_skips(spark: SparkSession, sf: str) -> DataFrame:
    """How many row groups of the clustered table were skipped and read for ``p3_found``."""
    return top_n.top_pairs_skips(table(spark, sf, "predictions"))


def p4_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return quantiles.compound_percentiles(table(spark, sf, "lincs_values"), table(spark, sf, "lincs_metadata"))


def p4_daily(spark: SparkSession, sf: str) -> DataFrame:
    """The same percentiles for each day alone."""
    s = quantiles.compound_sketches(table(spark, sf, "lincs_values"), table(spark, sf, "lincs_metadata"))
    return quantiles.percentiles(s, ["pert_iname", "day"], quantiles.PERCENTILES).withColumn("day", F.col("day").cast("string"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return components.protein_groups(table(spark, sf, "interactions")).where("group_protein < protein")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    d = canonical.map_column(table(spark, sf, "creeds_signatures"), "record_id", "disease_name", table(spark, sf, "disease_ref"), "disease_id", "disease")
    c = canonical.map_column(table(spark, sf, "lincs_metadata"), "row_id", "pert_iname", table(spark, sf, "compound_ref"), "compound_id", "compound")
    return d.unionByName(c)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_passages(spark, sf).select("doc_id", "item_id").distinct()


def p7_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Where in the original text each leaked passage stands."""
    return contamination.leaked_passages(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The mixed set: a row for each use of a document."""
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of each source of the mix."""
    return mixing.mix_report(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_scores(spark, sf).where(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p9_scores(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.score_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))


def p9_rates(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.source_rates(p9_scores(spark, sf))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_records, p3_found, p3_skips, p4_percentiles, p4_daily, p5_found, p6_found, p7_found, p7_passages, p8_mix, p8_shares, p9_found, p9_scores, p9_rates)}

_KEY = "lower(regexp_replace({}, '[^\\p{{L}}\\p{{Nd}}]+', '', 'g'))"
_PROTEIN = "upper(regexp_replace({}, '[^\\p{{L}}\\p{{Nd}}]+', '', 'g'))"

_RECORDS = f"""
select interaction_id id, least(a, b) lo, greatest(a, b) hi, s from (
  select interaction_id, {_KEY.format('protein_a')} a, {_KEY.format('protein_b')} b, {_KEY.format('source')} s from interactions)
where a <> '' and b <> '' and s <> ''"""

_TOP = """
select run_id, disease, drug_lo, drug_hi from (
  select *, row_number() over (partition by run_id, disease order by score desc, drug_lo, drug_hi) rk from (
    select run_id, disease, least(drug_a, drug_b) drug_lo, greatest(drug_a, drug_b) drug_hi, max(prediction_score) score
    from predictions where run_id is not null and disease is not null and prediction_score is not null and not isnan(prediction_score)
    and drug_a is not null and drug_b is not null and drug_a <> drug_b group by all))
where rk <= 10"""

_VALUES = """latest as (select sig_id, max(row_id) row_id from lincs_metadata where sig_id is not null group by sig_id),
names as (select m.sig_id, m.pert_iname from lincs_metadata m join latest l on l.sig_id = m.sig_id and l.row_id = m.row_id where m.pert_iname is not null),
v as (select n.pert_iname, l.measured_at::date as day, l.fold_change x from lincs_values l join names n on n.sig_id = l.sig_id where l.fold_change is not null and not isnan(l.fold_change))"""

_PERCENTILES = ", ".join(f"quantile_disc(x, {p}) as {c}" for c, p in quantiles.PERCENTILES.items())

_GROUPS = f"""with recursive ends as materialized (select {_PROTEIN.format('protein_a')} a, {_PROTEIN.format('protein_b')} b from interactions),
adj as materialized (select distinct a src, b dst from ends where a <> '' and b <> '' and a <> b union select distinct b, a from ends where a <> '' and b <> '' and a <> b),
comp(node, label) using key (node) as (
 select src, min(src) from adj group by src union
 select a.dst, min(c.label) from comp c join adj a on a.src = c.node join recurring.comp r on r.node = a.dst where c.label < r.label group by a.dst)
select label as group_protein, node as protein from comp where label < node"""

_LEAKS = """with items as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from benchmark where item_id is not null and text is not null),
runs as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') g from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) i from (select *, least(12, len(w)) n from items where len(w) > 0))),
words as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from documents where doc_id is not null and text is not null),
grams as (select doc_id, n, array_to_string(w[i:i + n - 1], ' ') g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from words, (select distinct n from runs)))
select distinct doc_id, item_id from grams join runs using (n, g)"""

#: Up to 2,048 values a sketch holds them all, so that at small scales the percentiles are exact and their stated error is 0.
ORACLE: dict[str, str] = {
    "p4_percentiles": f"with {_VALUES} select n.pert_iname, count(v.x) as n_values, {_PERCENTILES}, 0.0::double as rank_error from (select distinct pert_iname from names) n left join v using (pert_iname) group by n.pert_iname",
    "p4_daily": f"with {_VALUES} select pert_iname, day::varchar as day, count(*) as n_values, {_PERCENTILES}, 0.0::double as rank_error from v group by pert_iname, day",
    "p5_found": _GROUPS,
    "p7_found": _LEAKS,
    "p2_found": f"with r as ({_RECORDS}) select kept_id, id as copy_id from (select id, min(id) over (partition by lo, hi, s) kept_id from r) where id > kept_id",
    "p2_records": f"with r as ({_RECORDS}) select min(id) as kept_id, lo as protein_lo, hi as protein_hi, s as source_key, count(*) as n_copies from r group by lo, hi, s",
    "p3_found": _TOP,
}
