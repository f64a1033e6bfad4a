"""Registered queries of sources, sinks and identifiers: a given table is written in a source's format and read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.columns import name_key, symbol_key, tidy
from pathloom.operators import evaluation, graph, idmap, profiles, scoring
from pathloom.plans import domain
from pathloom.plans.reference_queries import _AREAS, DISEASES, DRUGS, ENDS, NAME, NET, SYMBOL, _id_map, _IDS, r6
from pathloom.sources import formats, sinks
from pathloom.sources.tables import table
from pathloom.storage import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _path(spark: SparkSession, suffix: str) -> str:
    return Scratch(spark, "source").path(suffix)


def _write(df: DataFrame, suffix: str, sep: str = "\t") -> str:
    """``df`` as a delimited file with a header."""
    path = _path(df.sparkSession, suffix)
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.options(header=True, sep=sep, **keep).csv(path)
    return path


def _ends(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "interactions")
    return i.select("interaction_id", symbol_key("protein_a").alias("a"), symbol_key("protein_b").alias("b"), "complex_id", "observed_at")


# ---- Interaction files ---------------------------------------------------------


def _huri(spark, sf) -> str:
    return _write(_ends(spark, sf).select(F.col("a").alias("Symbol A"), F.col("b").alias("Symbol B")), "huri.tsv")


@query(f"with {ENDS} select a as protein_a, b as protein_b, 'HuRI' as source, 'PPI' as interaction_type from ends where a is not null and b is not null")
def source_huri(spark, sf):
    return formats.read_huri(spark, _huri(spark, sf))


_SUBUNITS = f"""m as materialized (select distinct complex_id, gene from (select complex_id, {SYMBOL.format('protein_a')} gene from interactions union all
 select complex_id, {SYMBOL.format('protein_b')} from interactions) where complex_id is not null and gene is not null)"""


def _corum(spark, sf) -> str:
    m = _ends(spark, sf).where("complex_id is not null").select("complex_id", F.explode(F.array("a", "b")).alias("gene")).where("gene is not null")
    c = m.groupBy("complex_id").agg(F.array_join(F.array_sort(F.collect_set("gene")), ";").alias("subunits(Gene name)"))
    kind = F.when(F.right("complex_id", F.lit(1)).isin(*"02468"), "Mouse").otherwise("Human")
    return _write(c.select(F.col("complex_id").alias("ComplexID"), kind.alias("Organism"), "subunits(Gene name)"), "corum.tsv")


@query(f"""with {_SUBUNITS} select x.gene as protein_a, y.gene as protein_b, 'CORUM' as source, 'complex' as interaction_type, x.complex_id from m x
 join m y on x.complex_id = y.complex_id and x.gene < y.gene where right(x.complex_id, 1) not in ('0', '2', '4', '6', '8')""")
def source_corum(spark, sf):
    """Complexes whose id ends in an even digit are called mouse."""
    return formats.read_corum(spark, _corum(spark, sf))


def _phosphosite(spark, sf) -> str:
    e = _ends(spark, sf).where("a is not null and b is not null")
    kind = lambda n: F.when(F.col("interaction_id") % n == 0, "mouse").otherwise("human")
    lines = e.select(F.lit(1).alias("o"), F.concat_ws("\t", "a", "b", kind(3), kind(5)).alias("value"))
    head = [(0, "a notice"), (0, "of three"), (0, "lines")]
    notice = spark.createDataFrame([(i - 4, t) for i, (_, t) in enumerate(head)], "o int, value string")
    header = spark.createDataFrame([(0, "KINASE\tSUBSTRATE\tKIN_ORGANISM\tSUB_ORGANISM")], "o int, value string")
    path = _path(spark, "phosphosite.txt")
    notice.unionByName(header).unionByName(lines).orderBy("o").select("value").write.text(path)
    return path


@query(f"""with {ENDS} select distinct a as protein_a, b as protein_b, 'PhosphoSitePlus' as source, 'phosphorylation' as interaction_type from ends
 where a is not null and b is not null and seq % 3 <> 0 and seq % 5 <> 0""")
def source_phosphosite(spark, sf):
    return formats.read_phosphosite(spark, _phosphosite(spark, sf))


@query(
    f"""with {ENDS}, {_SUBUNITS}, u as (select 'HuRI' source from ends where a is not null and b is not null union all
 select 'CORUM' from m x join m y on x.complex_id = y.complex_id and x.gene < y.gene where right(x.complex_id, 1) not in ('0', '2', '4', '6', '8') union all
 select 'PhosphoSitePlus' from (select distinct a, b from ends where a is not null and b is not null and seq % 3 <> 0 and seq % 5 <> 0))
select source, count(*) as n_rows from u group by source"""
)
def source_union(spark, sf):
    """Dispatch by name: an unknown source is skipped, the placeholder is empty."""
    files = {"HuRI": _huri(spark, sf), "CORUM": _corum(spark, sf), "PhosphoSitePlus": _phosphosite(spark, sf)}
    found = formats.read_interactions(spark, {**files, "kegg_rpair": files["HuRI"], "hearsay": files["HuRI"]})
    return graph.per_source_counts(graph.union_sources(found))


@query(f"""with recursive {NET}, {_IDS} select n.gene_a, n.gene_b, count(*) as n_rows from net n
 join ends e on least(e.a, e.b) = n.gene_a and greatest(e.a, e.b) = n.gene_b where e.a <> e.b group by n.gene_a, n.gene_b""")
def build_network(spark, sf):
    """Sources, identifiers as given, the lookup table, merged edges, largest component."""
    i = table(spark, sf, "interactions")
    parts = {"complexes": i.where("complex_id is not null"), "pairs": i.where("complex_id is null")}
    return graph.build_graph(parts, _id_map(spark, sf)).select("gene_a", "gene_b", "n_rows")


@query(f"""with {ENDS} select least(a, b) as gene_a, greatest(a, b) as gene_b, (row_number() over (partition by least(a, b), greatest(a, b)
 order by seq) - 1)::int as pos, source from ends where a is not null and b is not null and a <> b""")
def edge_sources(spark, sf):
    return graph.edge_sources(domain.ends(spark, sf))


@query(f"with recursive {NET}, c as (select count(distinct label) n from comp) select 'all' as part, n = 1 as connected from c union all select 'largest', true")
def connectivity(spark, sf):
    rows = [("all", graph.is_connected(domain.edges(spark, sf))), ("largest", graph.is_connected(domain.network(spark, sf)))]
    return spark.createDataFrame(rows, "part string, connected boolean")


# ---- Graph files -----------------------------------------------------------------


def _graph_file(spark, sf, kind: str) -> DataFrame:
    e = graph.merge_edges(domain.ends(spark, sf))
    path = _path(spark, f"graph.{kind}")
    sinks.write_graph(e, path)
    return formats.read_graph(spark, path)


@query(f"""with {ENDS}, s as (select least(a, b) gene_a, greatest(a, b) gene_b, source, min(seq) seq from ends where a is not null and b is not null and a <> b
 group by all) select gene_a, gene_b, coalesce(string_agg(source, '|' order by seq), '') as sources from s group by gene_a, gene_b""")
def graph_parquet(spark, sf):
    return _graph_file(spark, sf, "parquet").select("gene_a", "gene_b", F.array_join("sources", "|").alias("sources"))


@query(f"with {ENDS} select gene_a, gene_b from edges")
def graph_edgelist(spark, sf):
    return _graph_file(spark, sf, "edgelist")


@query(f"with {ENDS} select gene_a, gene_b from edges")
def graph_graphml(spark, sf):
    return _graph_file(spark, sf, "graphml")


# ---- Signature files -------------------------------------------------------------


@query(f"""select {NAME.format('disease_name')} as disease, {SYMBOL.format('gene_symbol')} as gene, lower(trim(direction)) as direction from creeds_signatures
 where lower(trim(direction)) in ('up', 'down') and {NAME.format('disease_name')} <> '' and {SYMBOL.format('gene_symbol')} is not null""")
def source_creeds(spark, sf):
    c = table(spark, sf, "creeds_signatures")
    name = F.nullif(name_key("disease_name"), F.lit(""))
    path = _write(c.select(name.alias("disease_name"), F.lower(F.trim("direction")).alias("direction"), symbol_key("gene_symbol").alias("gene_symbol")), "creeds.tsv")
    return formats.read_creeds(spark, path)


@query(f"""select sig_id, arg_max(nullif({NAME.format('pert_iname')}, ''), row_id) filter (where true) as pert_iname from (select sig_id, row_id, pert_iname
 from lincs_metadata m where sig_id is not null and row_id = (select max(row_id) from lincs_metadata x where x.sig_id = m.sig_id)) group by sig_id""")
def source_metadata(spark, sf):
    """Columns under other names; of repeated signatures the last row of the file holds."""
    m = table(spark, sf, "lincs_metadata").orderBy("row_id")
    name = F.nullif(name_key("pert_iname"), F.lit(""))
    path = _write(m.select(F.col("sig_id").alias("distil_id"), name.alias("pert_desc")), "metadata.tsv")
    return graph.last_by(formats.read_metadata(spark, path).where("sig_id is not null"), "sig_id", "row_id").select("sig_id", "pert_iname")


_CELLS = f"cells as materialized (select m.cell_id, {SYMBOL.format('v.gene')} gene, max(v.fold_change) fold_change from lincs_values v join (select sig_id, cell_id from (select sig_id, cell_id, row_number() over (partition by sig_id order by row_id desc) k from lincs_metadata where sig_id is not null) where k = 1) m on m.sig_id = v.sig_id where m.cell_id is not null and v.fold_change is not null and not isnan(v.fold_change) group by 1, 2)"


@query(
    f"""with {_CELLS}, c as (select lower(cell_id) compound, gene, fold_change from cells where gene is not null),
rk as (select compound, gene, greatest(1, floor(count(*) over (partition by compound) * 0.05::double)::bigint) n, row_number() over (partition by compound
 order by fold_change desc, gene) t, row_number() over (partition by compound order by fold_change, gene) l from c)
select compound, gene, 'up' as direction from rk where t <= n union all select compound, gene, 'down' from rk where l <= n"""
)
def source_lincs(spark, sf):
    """The signature matrix of genes and cells, each cell a signature of its own, with its metadata."""
    m = graph.last_by(table(spark, sf, "lincs_metadata").where("sig_id is not null"), "sig_id", "row_id").select("sig_id", "cell_id").where("cell_id is not null")
    v = table(spark, sf, "lincs_values").where("fold_change is not null and not isnan(fold_change)")
    wide = v.join(m, "sig_id").groupBy(symbol_key("gene").alias("gene")).pivot("cell_id").agg(F.max("fold_change"))
    matrix = _write(wide.where("gene is not null"), "matrix.tsv")
    meta = _write(m.select("cell_id").distinct().select(F.col("cell_id").alias("sig_id"), F.lower("cell_id").alias("pert_iname")), "cells.tsv")
    return formats.read_lincs(spark, matrix, meta)


# ---- Pairs, modules, predictions, reports ------------------------------------------


def _pairs(spark, sf) -> DataFrame:
    return table(spark, sf, "predictions").where("topology_class = 'complementary_exposure'").select("drug_a", "drug_b", "disease")


@query("""select distinct least(trim(drug_a), trim(drug_b)) as drug_lo, greatest(trim(drug_a), trim(drug_b)) as drug_hi from predictions
 where topology_class = 'complementary_exposure' and drug_a is not null and drug_b is not null""")
def source_known_pairs(spark, sf):
    return formats.read_known_pairs(spark, _write(_pairs(spark, sf), "known.csv", ","))


_FIRST = "(select min(disease) from predictions where topology_class = 'complementary_exposure')"


@query(f"""select distinct least(trim(drug_a), trim(drug_b)) as drug_lo, greatest(trim(drug_a), trim(drug_b)) as drug_hi from predictions
 where topology_class = 'complementary_exposure' and drug_a is not null and drug_b is not null and lower(disease) = lower({_FIRST})""")
def source_known_pairs_of(spark, sf):
    """Of the first disease, whatever the case of its name."""
    first = _pairs(spark, sf).agg(F.min("disease")).first()[0] or ""
    return formats.read_known_pairs(spark, _write(_pairs(spark, sf), "known.csv", ","), first.upper())


@query("""select drug_a, drug_b, disease, prediction_score::varchar::double as synergy_score from predictions
 where prediction_score is not null and not isnan(prediction_score) and drug_a is not null and drug_b is not null""")
def source_drugcombdb(spark, sf):
    p = table(spark, sf, "predictions").where("prediction_score is not null and not isnan(prediction_score) and drug_a is not null and drug_b is not null")
    p = p.select(F.col("drug_a").alias("Drug1"), F.col("drug_b").alias("Drug2"), F.col("disease").alias("Disease"), F.col("prediction_score").alias("Synergy_Score"))
    return formats.read_drugcombdb(spark, _write(p, "comb.csv", ",")).withColumn("synergy_score", F.col("synergy_score").cast("double"))


@query(f"with {DISEASES} select disease as module, gene from dm")
def module_file(spark, sf):
    path = _path(spark, "modules.csv")
    sinks.write_modules(domain.disease_modules(spark, sf).withColumnRenamed("disease", "module"), path)
    return formats.read_modules(spark, path)


@query(f"with {DRUGS} select drug, gene, direction from xg")
def drug_module_file(spark, sf):
    path = _path(spark, "drugs.csv")
    sinks.write_drug_modules(domain.drug_genes(spark, sf), path)
    return formats.read_drug_modules(spark, path)


@query(f"""with recursive {NET}, {DISEASES}, {DRUGS} select 'disease' as kind, disease as module, gene from dm where gene in (select gene from deg) union all
 select 'drug', drug, gene from xm where gene in (select gene from deg)""")
def network_modules(spark, sf):
    """Modules as the scores use them: within the network, empty ones gone, susceptibility genes (none) added."""
    from pathloom.operators.distances import in_network

    net, d = domain.network(spark, sf), domain.disease_modules(spark, sf)
    d = in_network(d.unionByName(profiles.susceptibility_genes(spark)).distinct(), net)
    x = in_network(domain.drug_modules(spark, sf), net)
    return d.select(F.lit("disease").alias("kind"), F.col("disease").alias("module"), "gene").unionByName(x.select(F.lit("drug").alias("kind"), F.col("drug").alias("module"), "gene"))


_COLUMNS = ("drug_a", "drug_b", "tqab", "pqab", "cqab", "prediction_score", "topology_class", "pqa", "pqb", "cqa", "cqb", "disease")


@query(f"select {', '.join(_COLUMNS)} from predictions where disease is not null and prediction_score is not null and not isnan(prediction_score)")
def prediction_file(spark, sf):
    p = table(spark, sf, "predictions").where("disease is not null and prediction_score is not null and not isnan(prediction_score)")
    path = _path(spark, "predictions")
    sinks.write_predictions(p.select(*_COLUMNS), path)
    return formats.read_predictions(spark, path).select(*_COLUMNS)


@query(f"""with {_AREAS}
 select disease, n_predictions::varchar as n_predictions, n_positive::varchar as n_positive, n_known_synergies::varchar as n_known_synergies, {r6('auc_roc')} as auc_roc, {r6('auc_pr')} as auc_pr
 from ar""")
def report_file(spark, sf):
    path = _path(spark, "report.csv")
    sinks.write_report(evaluation.evaluate(domain.predictions(spark, sf), domain.known(spark, sf)), path)
    r = spark.read.option("header", True).csv(path)
    return r.withColumns({c: tidy(F.col(c)) for c in ("auc_roc", "auc_pr")})


@query("""select prediction_id, rank
 from (select prediction_id, row_number() over (order by prediction_score desc, disease nulls first, drug_a nulls first, drug_b nulls first, prediction_id)::int as rank
 from predictions where prediction_score is not null and not isnan(prediction_score)) where rank <= 50""")
def ranked_pairs(spark, sf):
    """The fifty first rows of the ranking."""
    p = table(spark, sf, "predictions").where("prediction_score is not null and not isnan(prediction_score)")
    top = scoring.ranked(p, "prediction_id").limit(50)
    order = F.struct((-F.col("prediction_score")).alias("s"), "disease", "drug_a", "drug_b", "prediction_id")
    rows = top.agg(F.array_sort(F.collect_list(order)).alias("r")).select(F.posexplode("r").alias("rank", "r"))  # fifty rows
    return rows.select("r.prediction_id", (F.col("rank") + 1).alias("rank"))


@query(f"with {DRUGS}, d as (select distinct drug from xm) select a.drug as drug_a, b.drug as drug_b from d a join d b on a.drug < b.drug order by 1, 2 limit 100")
def limited_pairs(spark, sf):
    """The pairs a prediction takes with ``max_pairs`` = 100."""
    return scoring.limit_pairs(scoring.drug_pairs(domain.drug_modules(spark, sf)), 100)


# ---- Identifiers -----------------------------------------------------------------


@query(f"with {_IDS} select id, 'auto' as from_type, symbol from idm")
def symbol_cache_file(spark, sf):
    path = _path(spark, "cache.json")
    sinks.write_symbol_cache(_id_map(spark, sf), path)
    return formats.read_symbol_cache(spark, path)


@query(f"with {_IDS} select id, 'auto' as from_type, symbol from idm")
def id_map_file(spark, sf):
    path = _path(spark, "id_map.parquet")
    sinks.write_id_map(_id_map(spark, sf), path)
    return spark.read.parquet(path)


@query(
    f"""with {_IDS}, ask as (select distinct gene_symbol id from creeds_signatures where gene_symbol is not null and gene_symbol not in (select id from idm)),
hits as (select gene id, min(value_id) hit_rank, {SYMBOL.format('gene')} symbol from lincs_values where gene is not null group by gene)
select id, 'auto' as from_type, symbol from idm union all select a.id, 'auto', h.symbol from ask a left join hits h on h.id = a.id"""
)
def id_resolve(spark, sf):
    """Unknown identifiers go to the lookup in one batch; its first hit with a symbol wins, misses stay as NULL."""
    v = table(spark, sf, "lincs_values").where("gene is not null")
    hits = v.select(F.col("gene").alias("id"), F.col("value_id").alias("hit_rank"), symbol_key("gene").alias("symbol"))
    lookup = lambda missing: missing.join(hits, "id")
    ids = table(spark, sf, "creeds_signatures").select(F.col("gene_symbol").alias("id"))
    return idmap.resolve(ids, _id_map(spark, sf), lookup)


@query(f"""with {_IDS}, hg as (select distinct {SYMBOL.format('gene')} symbol from lincs_values)
 select c.record_id as pos, c.gene_symbol as id, case when m.id is not null then m.symbol else h.symbol end as symbol from creeds_signatures c left
 join idm m on m.id = c.gene_symbol left join hg h on h.symbol = c.gene_symbol""")
def id_shortcut(spark, sf):
    """An identifier that nothing was looked up for but is a symbol of the HGNC table stands for itself."""
    ids = table(spark, sf, "creeds_signatures").select(F.col("record_id").alias("pos"), F.col("gene_symbol").alias("id"))
    hgnc = table(spark, sf, "lincs_values").select(symbol_key("gene").alias("symbol"))
    return idmap.to_symbols(ids, _id_map(spark, sf), hgnc=hgnc)


@query(
    f"""with {ENDS}, h as (select a symbol, max(seq) entrez_id from ends where a is not null
 group by a), w as (select {SYMBOL.format('gene')} symbol, min(value_id) entrez_id from lincs_values group by 1),
s as (select record_id pos, {SYMBOL.format('gene_symbol')} symbol from creeds_signatures)
select s.pos, s.symbol, coalesce(h.entrez_id, w.entrez_id) as entrez_id from s left join h on h.symbol = s.symbol left
 join w on w.symbol = s.symbol and w.symbol is not null"""
)
def to_entrez(spark, sf):
    """Through an HGNC file, of which the last row of a symbol holds; the rest is looked up in one batch."""
    e = _ends(spark, sf).where("a is not null").orderBy("interaction_id")
    hgnc = formats.read_hgnc(spark, _write(e.select(F.col("a").alias("symbol"), F.col("interaction_id").alias("entrez_id")), "hgnc.tsv"))
    v = table(spark, sf, "lincs_values").select(symbol_key("gene").alias("symbol"), F.col("value_id").alias("hit_rank"), F.col("value_id").alias("entrez_id"))
    symbols = table(spark, sf, "creeds_signatures").select(F.col("record_id").alias("pos"), symbol_key("gene_symbol").alias("symbol"))
    return idmap.to_entrez(symbols, hgnc, lambda missing: missing.join(v, "symbol"))
