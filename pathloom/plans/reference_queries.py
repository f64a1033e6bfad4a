"""Registered queries of the network-medicine operators, each over whole tables, with oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.columns import exact_mean, symbol_key, tidy
from pathloom.operators import correlation, distances, evaluation, figures, graph, idmap, nulls, profiles, propagation, scoring, similarity
from pathloom.plans import domain
from pathloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- SQL fragments ---------------------------------------------------------

SYMBOL = "nullif(upper(regexp_replace({}, '[^\\p{{L}}\\p{{Nd}}]+', '', 'g')), '')"
NAME = "lower(trim({}, ' ' || chr(9) || chr(10) || chr(13)))"

ENDS = f"""ends as materialized (select interaction_id seq, {SYMBOL.format('protein_a')} a, {SYMBOL.format('protein_b')} b, source, interaction_type from interactions),
edges as materialized (select distinct least(a, b) gene_a, greatest(a, b) gene_b from ends where a is not null and b is not null and a <> b),
adj as materialized (select gene_a src, gene_b dst from edges union all select gene_b, gene_a from edges)"""
COMP = """comp(node, label) using key (node) as (
 select src, min(src) from adj group by src union
 select a.dst, min(c.label) from comp c join adj a on a.src = c.node join recurring.comp r on r.node = a.dst where c.label < r.label group by a.dst)"""
NET = f"""{ENDS}, {COMP},
top as materialized (select label from comp group by label order by count(*) desc, label limit 1),
net as materialized (select e.* from edges e join comp c on c.node = e.gene_a join top t on t.label = c.label),
nadj as materialized (select gene_a src, gene_b dst from net union all select gene_b, gene_a from net),
deg as materialized (select src gene, count(*) degree from nadj group by src)"""
DISEASES = f"""reports as materialized (select {NAME.format('disease_name')} disease, {SYMBOL.format('gene_symbol')} gene, lower(trim(direction)) direction
 from creeds_signatures where lower(trim(direction)) in ('up', 'down') and {NAME.format('disease_name')} <> ''),
dm as materialized (select distinct disease, gene from reports where gene is not null),
dsig as materialized (select disease, gene, sum(case when direction = 'up' then 1.0::double else -1.0::double end) fold_change from reports
 where gene is not null group by disease, gene having sum(case when direction = 'up' then 1 else -1 end) <> 0)"""
DRUGS = f"""meta as materialized (select sig_id, pert_iname from (select *, row_number() over (partition by sig_id order by row_id desc) rn from lincs_metadata
 where sig_id is not null) where rn = 1 and pert_iname is not null),
vals as materialized (select {NAME.format('m.pert_iname')} compound, {SYMBOL.format('v.gene')} gene, v.fold_change from lincs_values v
 join meta m on m.sig_id = v.sig_id where {NAME.format('m.pert_iname')} <> ''),
prof as materialized (select compound, gene, median(fold_change) fold_change from vals
 where fold_change is not null and not isnan(fold_change) and gene is not null group by compound, gene),
ranks as materialized (select compound drug, gene, greatest(1, (count(*) over (partition by compound) * 0.05::double)::bigint_floor) n,
  row_number() over (partition by compound order by fold_change desc, gene) t, row_number() over (partition by compound order by fold_change, gene) l from prof),
xg as materialized (select drug, gene, 'up' direction from ranks where t <= n union all select drug, gene, 'down' from ranks where l <= n),
xm as materialized (select distinct drug, gene
 from xg)""".replace("(count(*) over (partition by compound) * 0.05::double)::bigint_floor", "floor(count(*) over (partition by compound) * 0.05::double)::bigint")
#: Query rows of searches: names in the rows whose id is divisible by ``domain.EVERY``.
ASKED_DRUGS = f"asked as materialized (select distinct {NAME.format('pert_iname')} drug from lincs_metadata where row_id % {domain.EVERY} = 0 and {NAME.format('pert_iname')} <> '')"
ASKED_DISEASES = f"asked as materialized (select distinct {NAME.format('disease_name')} disease from creeds_signatures where record_id % {domain.EVERY} = 0 and {NAME.format('disease_name')} <> '')"
QG = "q as materialized (select distinct dm.disease, dm.gene from dm semi join deg using (gene))"
XG = "x as materialized (select distinct xm.drug, xm.gene from xm semi join deg using (gene))"


def bfs_sql(name: str, key: str, sources: str) -> str:
    """Recursive search keyed by ``key`` from ``sources(key, gene)``."""
    return f"""{name}({key}, node, hops) using key ({key}, node) as (
 select distinct {key}, gene, 0 from {sources} union
 select b.{key}, a.dst, min(b.hops + 1) from {name} b join nadj a on a.src = b.node left join recurring.{name} r on r.{key} = b.{key} and r.node = a.dst
 where r.hops is null group by b.{key}, a.dst)"""


def r6(expr: str) -> str:
    return f"round({expr}, 6) + 0.0"


# ---- Graph -----------------------------------------------------------------


@query(f"with {ENDS} select gene_a, gene_b from edges")
def scan_edges(spark, sf):
    return domain.edges(spark, sf)


@query(
    f"""with {ENDS}, per as (select least(a, b) gene_a, greatest(a, b) gene_b, source, min(seq) seq, count(*) n, arg_min(interaction_type, seq) t from ends
 where a is not null and b is not null and a <> b group by all)
select gene_a, gene_b, coalesce(string_agg(source, '|' order by seq), '') as sources, sum(n)::bigint as n_rows, arg_min(t, seq) as interaction_type from per
 group by gene_a, gene_b"""
)
def edge_merge(spark, sf):
    e = graph.merge_edges(domain.ends(spark, sf))
    return e.select("gene_a", "gene_b", F.array_join("sources", "|").alias("sources"), "n_rows", "interaction_type")


@query("select source, count(*) as n_rows from interactions group by source")
def source_counts(spark, sf):
    return graph.per_source_counts(table(spark, sf, "interactions"))


@query(f"with {ENDS} select src as gene, count(*) as degree from adj group by src")
def degree(spark, sf):
    return graph.degrees(domain.edges(spark, sf))


@query(f"with recursive {ENDS}, {COMP} select label as component, node as gene from comp")
def components(spark, sf):
    return graph.components(domain.edges(spark, sf))


@query(f"with recursive {ENDS}, {COMP} select label as component, count(*) as n_genes from comp group by label")
def component_sizes(spark, sf):
    return graph.component_sizes(domain.edges(spark, sf))


@query(f"with recursive {NET} select gene_a, gene_b from net")
def largest_component(spark, sf):
    return domain.network(spark, sf)


@query(
    f"""with recursive {ENDS}, {COMP}, d as (select src gene, count(*) k from adj group by src),
tri as (select e.gene_a, e.gene_b, a.dst g from edges e join adj a on a.src = e.gene_a join adj b on b.src = e.gene_b and b.dst = a.dst),
per as (select g gene, count(*) t from tri group by g),
cl as (select d.k, case when d.k < 2 then 0.0::double else 2.0::double * coalesce(per.t, 0) / (d.k * (d.k - 1)) end c from d left join per using (gene)),
b as (select count(*) n, (sum(k) / 2)::bigint m, avg(c) cl from cl)
select n as n_nodes, m as n_edges, {r6('2.0::double * m / (n * (n - 1))')} as density, {r6('2.0::double * m / n')} as avg_degree, (select count(distinct label)
 from comp) as n_components, {r6('cl')} as avg_clustering, null::int as diameter from b"""
)
def graph_stats(spark, sf):
    """Of the whole graph, which falls into several components and so has no diameter."""
    return _tidy_stats(graph.graph_stats(domain.edges(spark, sf)))


def _tidy_stats(s: DataFrame) -> DataFrame:
    return s.withColumns({c: tidy(F.col(c)) for c in ("density", "avg_degree", "avg_clustering")})


_MEMBERS = f"""select distinct complex_id, gene from (select complex_id, {SYMBOL.format('protein_a')} gene from interactions union all
 select complex_id, {SYMBOL.format('protein_b')} from interactions) where complex_id is not null and gene is not null"""


@query(f"""with m as materialized ({_MEMBERS}) select a.complex_id, a.gene as protein_a, b.gene as protein_b from m a
 join m b on a.complex_id = b.complex_id and a.gene < b.gene""")
def complex_pairs(spark, sf):
    i = table(spark, sf, "interactions").where("complex_id is not null")
    m = i.select("complex_id", F.explode(F.array(symbol_key("protein_a"), symbol_key("protein_b"))).alias("gene")).where("gene is not null").distinct()
    return graph.complex_pairs(m.withColumn("pos", F.col("gene")))


# ---- Signatures and modules --------------------------------------------------


@query(f"with {DRUGS.split('vals as')[0].rstrip().rstrip(',')} select v.value_id, m.pert_iname as compound from lincs_values v join meta m on m.sig_id = v.sig_id")
def metadata_join(spark, sf):
    return profiles.join_metadata(table(spark, sf, "lincs_values"), table(spark, sf, "lincs_metadata")).select("value_id", "compound")


@query("""select sig_id, count(*) as n_values from lincs_values where sig_id is null or sig_id not in (select sig_id from lincs_metadata
 where sig_id is not null) group by sig_id""")
def unmatched_signatures(spark, sf):
    return profiles.unmatched(table(spark, sf, "lincs_values"), table(spark, sf, "lincs_metadata"))


@query(f"with {DRUGS} select compound, gene, {r6('fold_change')} as fold_change from prof")
def median_profile(spark, sf):
    return profiles.profiles(domain.compound_values(spark, sf), "median").select("compound", "gene", tidy(F.col("fold_change")).alias("fold_change"))


@query(f"""with {DRUGS} select compound, gene, {r6('avg(fold_change)')} as fold_change from vals
 where fold_change is not null and not isnan(fold_change) and gene is not null group by compound, gene""")
def mean_profile(spark, sf):
    return profiles.profiles(domain.compound_values(spark, sf), "mean").select("compound", "gene", tidy(F.col("fold_change")).alias("fold_change"))


@query(f"with {DRUGS} select drug, gene, direction from xg")
def drug_modules(spark, sf):
    return domain.drug_genes(spark, sf)


@query(f"with {DISEASES} select disease, gene from dm")
def disease_modules(spark, sf):
    return domain.disease_modules(spark, sf)


@query(f"with {DISEASES} select disease, gene, fold_change from dsig")
def disease_signature(spark, sf):
    return domain.disease_signatures(spark, sf)


# ---- Distances -----------------------------------------------------------------


@query(f"with recursive {NET}, {DISEASES}, {QG}, {bfs_sql('b', 'disease', 'q')} select disease as module, node, hops from b")
def bfs_module_dist(spark, sf):
    m = domain.disease_modules(spark, sf).withColumnRenamed("disease", "module")
    return distances.bfs(domain.network(spark, sf), m).select("module", "node", "hops")


_PROX = f"""{NET}, {DISEASES}, {DRUGS}, {QG}, {XG}, {bfs_sql('bx', 'drug', 'x')}, {bfs_sql('bq', 'disease', 'q')},
qx as materialized (select q.disease, b.drug, (sum(b.hops) + 1000.0::double * (any_value(n.n) - count(*))) / any_value(n.n) d from q
 join bx b on b.node = q.gene join (select disease, count(*) n from q group by disease) n on n.disease = q.disease group by q.disease, b.drug)"""


@query(f"with recursive {_PROX} select disease as source, drug as target, {r6('d')} as d from qx")
def avg_shortest_path(spark, sf):
    q, x = domain.disease_modules(spark, sf), domain.drug_modules(spark, sf)
    return distances.module_distances(domain.network(spark, sf), q.withColumnRenamed("disease", "source"), x.withColumnRenamed("drug", "target"), digits=6)


@query(
    f"""with recursive {_PROX}, xq as (select x.drug, b.disease, (sum(b.hops) + 1000.0::double * (any_value(n.n) - count(*))) / any_value(n.n) d from x
 join bq b on b.node = x.gene join (select drug, count(*) n from x group by drug) n on n.drug = x.drug group by x.drug, b.disease)
select disease, drug, {r6('qx.d')} as d_qx, {r6('xq.d')} as d_xq from qx join xq using (disease, drug)"""
)
def module_proximity(spark, sf):
    return distances.both_ways(domain.network(spark, sf), domain.disease_modules(spark, sf), domain.drug_modules(spark, sf), digits=6)


_SEP = f"""{NET}, {DRUGS}, {ASKED_DRUGS}, {XG}, drugs as materialized (select distinct drug from xm), xgenes as materialized (select distinct gene s, gene
 from x), {bfs_sql('bx', 'drug', 'x')}, {bfs_sql('bg', 's', 'xgenes')},
n as materialized (select drug, count(*) n from x group by drug),
ab as materialized (select x.drug a, b.drug b, (sum(b.hops) + 1000.0::double * (any_value(n.n) - count(*))) / any_value(n.n) d from x
 join bx b on b.node = x.gene join n on n.drug = x.drug group by x.drug, b.drug),
own as materialized (select drug, case when count(*) > 1 then avg(d) else 0.0::double end d
 from (select x.drug, x.gene, coalesce(min(g.hops) filter (where y.gene is not null), 1000.0::double) d from x left
 join x y on y.drug = x.drug and y.gene <> x.gene left join bg g on g.s = x.gene and g.node = y.gene group by x.drug, x.gene) group by drug),
sep as materialized (select p.drug drug_a, r.drug drug_b, (coalesce(u.d, 1000.0::double) + coalesce(v.d, 1000.0::double)) / 2 - (coalesce(oa.d, 1000.0::double) + coalesce(ob.d, 1000.0::double)) / 2 s
 from drugs p join drugs r on p.drug < r.drug and (p.drug in (select drug from asked) or r.drug in (select drug from asked)) left
 join ab u on u.a = p.drug and u.b = r.drug left join ab v on v.a = r.drug and v.b = p.drug left join own oa on oa.drug = p.drug left
 join own ob on ob.drug = r.drug)"""


@query(f"with recursive {_SEP} select drug_a as module_a, drug_b as module_b, {r6('s')} as s_ab from sep")
def separation(spark, sf):
    """Drugs named in metadata rows whose id is divisible by 50 against all drugs."""
    x = domain.drug_modules(spark, sf)
    p = scoring.drug_pairs(x, domain.asked_drugs(spark, sf)).withColumnsRenamed({"drug_a": "module_a", "drug_b": "module_b"})
    return distances.separations(domain.network(spark, sf), x.withColumnRenamed("drug", "module"), p).select("module_a", "module_b", tidy(F.col("s_ab")).alias("s_ab"))


@query(f"""with recursive {NET}, {DRUGS}, {XG}, {ASKED_DRUGS}, sgenes as materialized (select distinct gene s, gene from x where drug in (select drug
 from asked)), {bfs_sql('bg', 's', 'sgenes')} select s as gene_a, node as gene_b, hops from bg where node in (select gene from x)""")
def pairwise_dist(spark, sf):
    """Genes of the drugs asked for against the genes of all drugs."""
    x = domain.drug_modules(spark, sf)
    return distances.pairwise_distances(domain.network(spark, sf), x.join(domain.asked_drugs(spark, sf), "drug", "left_semi"), x)


@query(f"""with recursive {NET}, every as materialized (select gene s, gene from deg), {bfs_sql('b', 's', 'every')} select s as gene, max(hops) as eccentricity
 from b group by s""")
def eccentricity(spark, sf):
    return distances.eccentricity(domain.network(spark, sf))


_STATS = """d as (select gene, degree k from deg), tri as (select e.gene_a, e.gene_b, a.dst g from net e join nadj a on a.src = e.gene_a
 join nadj b on b.src = e.gene_b and b.dst = a.dst),
per as (select g gene, count(*) t from tri
 group by g), cl as (select d.k, case when d.k < 2 then 0.0::double else 2.0::double * coalesce(per.t, 0) / (d.k * (d.k - 1)) end c from d left
 join per using (gene)),
st as (select count(*) n, (sum(k) / 2)::bigint m, avg(c) cl from cl)"""


@query(
    f"with recursive {NET}, every as materialized (select gene s, gene from deg), {bfs_sql('b', 's', 'every')}, {_STATS} select n as n_nodes, m as n_edges, {r6('2.0::double * m / (n * (n - 1))')} as density, {r6('2.0::double * m / n')} as avg_degree, 1::bigint as n_components, {r6('cl')} as avg_clustering, (select max(hops) from b) as diameter from st"
)
def network_stats(spark, sf):
    """Of the largest component, which has a diameter."""
    return _tidy_stats(graph.graph_stats(domain.network(spark, sf)))


# ---- Null model ----------------------------------------------------------------

_BINS = """cuts as materialized (select quantile_cont(degree, [i / 20.0::double for i in range(21)]) c from deg),
bins as materialized (select gene, degree, coalesce((select min(i) from range(20) r(i) where degree >= c[i + 1] and degree < c[i + 2]), 19) bin from deg, cuts)"""
_SEEDS = "seeds as materialized (select drug, ('0x' || substr(sha256('42:' || string_agg(gene, '|' order by gene)), 1, 8))::ubigint::bigint module_seed from x group by drug)"
_NULLS = f"""{_BINS}, {_SEEDS}, idx as materialized (select bin, gene pick, row_number() over (partition by bin
 order by gene) - 1 i, count(*) over (partition by bin) size from bins),
nul as materialized (select distinct x.drug, d.draw, p.pick gene from x join seeds s on s.drug = x.drug join bins b on b.gene = x.gene
 join (select bin, any_value(size) size from idx group by bin) z on z.bin = b.bin cross join (select unnest(range({domain.DRAWS})) draw) d
 join idx p on p.bin = b.bin and p.i = ('0x' || substr(sha256(s.module_seed::varchar || ':' || x.gene || ':' || d.draw::varchar), 1, 8))::ubigint::bigint % z.size)"""


@query(f"with recursive {NET}, {_BINS} select gene, degree, bin::int as bin from bins")
def degree_bins(spark, sf):
    return nulls.degree_bins(domain.network(spark, sf))


@query(f"with recursive {NET}, {DRUGS}, {XG}, {_SEEDS} select drug as module, module_seed from seeds")
def module_seed_hash(spark, sf):
    m = distances.in_network(domain.drug_modules(spark, sf), domain.network(spark, sf))
    return nulls.module_seeds(m.withColumnRenamed("drug", "module"), domain.SEED)


@query(f"with recursive {NET}, {DRUGS}, {XG}, {_NULLS} select drug as module, draw::int as draw, gene from nul")
def null_modules(spark, sf):
    return nulls.null_modules(domain.network(spark, sf), domain.drug_modules(spark, sf).withColumnRenamed("drug", "module"), domain.DRAWS, domain.SEED)


_Z = f"""{_PROX}, qgenes as materialized (select distinct gene s, gene from q), {bfs_sql('bg', 's', 'qgenes')}, {_NULLS},
gi as materialized (select s, (row_number() over (order by s) - 1)::int i from qgenes),
far as materialized (select max(hops) h from bg),
lv as materialized (select b.node, bitstring_agg(1024 * l.h + gi.i, 0, 10239) bits from bg b join gi using (s) join (select unnest(range((select h
 from far)))::int h) l on b.hops <= l.h group by b.node),
nb as materialized (select n.drug, n.draw, bit_or(lv.bits) bits from nul n join lv on lv.node = n.gene group by n.drug, n.draw),
qb as materialized (select q.disease, bitstring_agg(1024 * l.h + gi.i, 0, 10239) bits, count(distinct q.gene) n from q
 join gi on gi.s = q.gene, (select unnest(range((select h from far)))::int h) l group by q.disease),
nd as materialized (select q.disease, r.drug, r.draw, (far.h * q.n - bit_count(r.bits & q.bits)) / q.n::double d from nb r cross join qb q cross join far),
z as materialized (select o.disease, o.drug, any_value(o.d) observed, avg(nd.d) null_mean, stddev_pop(nd.d) null_std, avg((round(nd.d, 9) <= round(o.d, 9))::int::double) p_value
 from qx o join nd on nd.disease = o.disease and nd.drug = o.drug group by o.disease, o.drug),
zz as materialized (select *, case when null_std < 1e-9 then 0.0::double else (observed - null_mean) / null_std end z from z)"""


@query(f"""with recursive {_Z}
 select disease, drug, round(observed, 9) + 0.0 as observed, round(null_mean, 9) + 0.0 as null_mean, round(null_std, 9) + 0.0 as null_std, {r6('round(z, 9)')} as z, {r6('p_value')} as p_value
 from zz""")
def null_zscore(spark, sf):
    digits = {c: (9,) for c in ("observed", "null_mean", "null_std")} | {"z": (6,), "p_value": (6,)}  # a mean over 1,000 draws may end in a five at the seventh digit
    return scoring.proximity(domain.network(spark, sf), domain.disease_modules(spark, sf), domain.drug_modules(spark, sf), domain.DRAWS, domain.SEED, digits)


# ---- Correlation -----------------------------------------------------------------


def _corr(x: str, y: str) -> str:
    top = f"(avg({x} * {y}) - avg({x}) * avg({y}))"
    return f"case when count(*) < 3 or var_pop({x}) < 1e-12 or var_pop({y}) < 1e-12 then 0.0::double else {top} / sqrt(var_pop({x}) * var_pop({y})) end"


_PAIRS = "pr as materialized (select d.disease, p.compound, d.gene, d.fold_change a, p.fold_change b from dsig d join prof p using (gene))"
_RANKED = "rk as materialized (select disease, {k}, rank() over (partition by disease, {k} order by a) + (count(*) over (partition by disease, {k}, a) - 1) / 2.0::double x, rank() over (partition by disease, {k} order by b) + (count(*) over (partition by disease, {k}, b) - 1) / 2.0::double y from {t})"


def _correlation(spark, sf, method: str) -> DataFrame:
    p = profiles.profiles(domain.compound_values(spark, sf)).withColumnRenamed("fold_change", "b")
    return correlation.of_profiles(domain.disease_signatures(spark, sf).withColumnRenamed("fold_change", "a"), p, method)


@query(f"""with {DISEASES}, {DRUGS}, {_PAIRS}, {_RANKED.format(k='compound', t='pr')}
 select disease, compound, count(*) as n_common, {r6(_corr('x', 'y'))} as correlation from rk group by disease, compound""")
def spearman(spark, sf):
    return _correlation(spark, sf, "spearman")


@query(f"with {DISEASES}, {DRUGS}, {_PAIRS} select disease, compound, count(*) as n_common, {r6(_corr('a', 'b'))} as correlation from pr group by disease, compound")
def pearson(spark, sf):
    return _correlation(spark, sf, "pearson")


_REV = f"sg as materialized (select drug, gene, min(case when direction = 'down' then -1.0::double else 1.0::double end) b from xg group by drug, gene), ps as materialized (select d.disease, s.drug, d.fold_change a, s.b from dsig d join sg s using (gene)), {_RANKED.format(k='drug', t='ps')}, rv as materialized (select disease, drug, -1.0::double * ({_corr('x', 'y')}) c from rk group by disease, drug)"


@query(f"with {DISEASES}, {DRUGS}, {_REV} select disease, drug, {r6('c')} as c from rv")
def reversal(spark, sf):
    return correlation.reversal(domain.disease_signatures(spark, sf), domain.drug_genes(spark, sf)).select("disease", "drug", tidy(F.col("c")).alias("c"))


# ---- Scoring -------------------------------------------------------------------

_PRED = f"""{_Z}, {ASKED_DRUGS}, drugs as materialized (select distinct drug from xm), xgenes as materialized (select distinct gene s, gene
 from x), {bfs_sql('bs', 's', 'xgenes')},
n as materialized (select drug, count(*) n from x group by drug),
ab as materialized (select x.drug a, b.drug b, (sum(b.hops) + 1000.0::double * (any_value(n.n) - count(*))) / any_value(n.n) d from x
 join bx b on b.node = x.gene join n on n.drug = x.drug group by x.drug, b.drug),
own as materialized (select drug, case when count(*) > 1 then avg(d) else 0.0::double end d
 from (select x.drug, x.gene, coalesce(min(g.hops) filter (where y.gene is not null), 1000.0::double) d from x left
 join x y on y.drug = x.drug and y.gene <> x.gene left join bs g on g.s = x.gene and g.node = y.gene group by x.drug, x.gene) group by drug),
sep as materialized (select p.drug drug_a, r.drug drug_b, (coalesce(u.d, 1000.0::double) + coalesce(v.d, 1000.0::double)) / 2 - (coalesce(oa.d, 1000.0::double) + coalesce(ob.d, 1000.0::double)) / 2 s
 from drugs p join drugs r on p.drug < r.drug and (p.drug in (select drug from asked) or r.drug in (select drug from asked)) left
 join ab u on u.a = p.drug and u.b = r.drug left join ab v on v.a = r.drug and v.b = p.drug left join own oa on oa.drug = p.drug left
 join own ob on ob.drug = r.drug),
{_REV},
parts as materialized (select d.disease, s.drug_a, s.drug_b, round(coalesce(za.z, 0.0), 9) pqa, round(coalesce(zb.z, 0.0), 9) pqb, coalesce(ca.c, 0.0) cqa, coalesce(cb.c, 0.0) cqb, round(s.s, 9) s
 from (select distinct disease from dm) d cross join sep s left join zz za on za.disease = d.disease and za.drug = s.drug_a left
 join zz zb on zb.disease = d.disease and zb.drug = s.drug_b
 left join rv ca on ca.disease = d.disease and ca.drug = s.drug_a left join rv cb on cb.disease = d.disease and cb.drug = s.drug_b),
cls as materialized (select *, case when pqa < 0 and pqb < 0 then (case when s >= 0 then 'complementary_exposure' else 'overlapping_exposure' end) when pqa < 0 or pqb < 0 then (case when s >= 0 then 'single_exposure' else 'indirect_exposure' end) when s >= 0 then 'independent_action' else 'non_exposure' end topology_class
 from parts),
pred as materialized (select disease, drug_a, drug_b, case when topology_class = 'complementary_exposure' then 2.0::double else 0.0::double end tqab, -(pqa + pqb) / 2 pqab, (cqa + cqb) / 2 cqab, topology_class, pqa, pqb, cqa, cqb
 from cls)"""


def _predictor(spark, sf) -> scoring.Predictor:
    p = scoring.Predictor(domain.network(spark, sf), domain.DRAWS, domain.SEED)
    return p.set_disease_modules(domain.disease_modules(spark, sf)).set_drug_modules(domain.drug_genes(spark, sf)).set_disease_signatures(domain.disease_signatures(spark, sf))


def _predicted(spark, sf, asked: DataFrame | None) -> DataFrame:
    return _predictor(spark, sf).predict(asked=asked, digits=4).select("disease", "drug_a", "drug_b", "topology_class", *scoring.SCORES)


@query(f"""with recursive {_PRED}
 select disease, drug_a, drug_b, topology_class, {', '.join(f'round({e}, 4) + 0.0 as {c}' for c, e in (('tqab', 'tqab'), ('pqab', 'pqab'), ('cqab', 'cqab'), ('prediction_score', '(tqab + pqab + cqab)'), ('pqa', 'pqa'), ('pqb', 'pqb'), ('cqa', 'cqa'), ('cqb', 'cqb')))}
 from pred""")
def predict_all(spark, sf):
    """Drugs named in metadata rows whose id is divisible by 50 with every other drug, for every disease."""
    return _predicted(spark, sf, domain.asked_drugs(spark, sf))


def predict_every_pair(spark, sf):
    """Every pair of drugs: for small tables, as the result grows with the square of the drugs."""
    return _predicted(spark, sf, None)


@query(f"with recursive {_PRED} select disease, topology_class, count(*) as n_pairs from pred group by disease, topology_class")
def topology_classes(spark, sf):
    return _predictor(spark, sf).classes(domain.asked_drugs(spark, sf))


@query("""select prediction_id, prediction_score from predictions where prediction_score is not null and not isnan(prediction_score)
 order by prediction_score desc, prediction_id limit 20""")
def predict_topk(spark, sf):
    p = table(spark, sf, "predictions").where("prediction_score is not null and not isnan(prediction_score)")
    return p.orderBy(F.desc("prediction_score"), "prediction_id").limit(20).select("prediction_id", "prediction_score")


#: Mean of ``prediction_score`` to six digits, halves up, from a sum of whole billionths: the same in any order of summation.
_EXACT = "2 * sum(round(prediction_score * 1e9)::hugeint) + 1000 * count(*)"


@query(
    f"""with g as (select disease, {_EXACT} v, 2000::hugeint * count(*) m, median(prediction_score) md, max(prediction_score) mx from predictions
 where prediction_score is not null and not isnan(prediction_score) group by disease)
select disease, ((v - ((v % m) + m) % m) // m)::double / 1e6 as mean_score, {r6('md')} as median_score, {r6('mx')} as max_score from g"""
)
def score_aggregate(spark, sf):
    p = table(spark, sf, "predictions").where("prediction_score is not null and not isnan(prediction_score)")
    rest = p.groupBy("disease").agg(exact_mean(F.col("prediction_score")).alias("mean_score"), tidy(F.max("prediction_score")).alias("max_score"))
    middle = evaluation.medians(p, ["disease"], "prediction_score").withColumnRenamed("disease", "d")
    return rest.join(middle, F.col("disease").eqNullSafe(F.col("d"))).select("disease", "mean_score", tidy(F.col("median")).alias("median_score"), "max_score")


# ---- Evaluation ------------------------------------------------------------------

_EVAL = """pp as materialized (select run_id, disease, least(drug_a, drug_b) drug_a, greatest(drug_a, drug_b) drug_b, max(prediction_score) score
 from predictions where disease is not null and prediction_score is not null and not isnan(prediction_score) group by 1, 2, 3, 4),
kn as materialized (select distinct least(drug_a, drug_b) lo, greatest(drug_a, drug_b) hi from predictions where topology_class = 'complementary_exposure'),
lab as materialized (select pp.*, (kn.lo is not null)::int as y from pp left join kn on kn.lo = pp.drug_a and kn.hi = pp.drug_b),
th as materialized (select disease, score, sum(y)::bigint tp, sum(1 - y)::bigint fp from lab group by disease, score),
cu as materialized (select *, sum(tp) over w ctp, sum(fp) over w cfp, sum(tp) over (partition by disease) p, sum(fp) over (partition by disease) q from th
 window w as (partition by disease order by score desc))"""


@query(f"with {_EVAL} select lo as drug_lo, hi as drug_hi from kn")
def known_synergies(spark, sf):
    return domain.known(spark, sf)


@query(f"with {_EVAL} select run_id, disease, drug_a, drug_b, score as prediction_score, y as label from lab")
def labels_join(spark, sf):
    return evaluation.label_pairs(domain.predictions(spark, sf), domain.known(spark, sf)).select("run_id", "disease", "drug_a", "drug_b", "prediction_score", "label")


_AREAS = f"""{_EVAL}, ar as (select disease, sum(tp + fp)::bigint n_predictions, sum(tp)::bigint n_positive, (select count(*) from kn) n_known_synergies,
 case when any_value(p) > 0 and any_value(q) > 0 then sum(fp * (ctp - tp / 2.0::double)) / (any_value(p)::double * any_value(q)) end auc_roc, case when any_value(p) > 0 and any_value(q) > 0 then sum(tp * ctp / (ctp + cfp)::double) / any_value(p)::double end auc_pr
 from cu group by disease)"""


@query(f"with {_AREAS} select disease, n_predictions, n_positive, n_known_synergies, {r6('auc_roc')} as auc_roc, {r6('auc_pr')} as auc_pr from ar")
def evaluate(spark, sf):
    e = evaluation.evaluate(domain.predictions(spark, sf), domain.known(spark, sf))
    e = e.select("disease", "n_predictions", "n_positive", "n_known_synergies", tidy(F.col("auc_roc")).alias("auc_roc"), tidy(F.col("auc_pr")).alias("auc_pr"))
    return evaluation.report(e)


@query(
    f"""with {_EVAL}, nx as (select *, lead(tp) over w ntp, lead(fp) over w nfp from cu where p > 0 and q > 0 window w as (partition by disease order by score desc))
select disease, score as threshold, {r6('cfp / q::double')} as fpr, {r6('ctp / p::double')} as tpr from nx where ntp is null or ntp <> tp or nfp <> fp
union all select distinct disease, 'inf'::double, 0.0::double, 0.0::double from cu where p > 0 and q > 0"""
)
def roc_curve(spark, sf):
    s = evaluation.label_pairs(domain.predictions(spark, sf), domain.known(spark, sf))
    r = evaluation.roc_curve(s, ["disease"], "prediction_score")
    return r.where("fpr is not null and tpr is not null").select("disease", "threshold", tidy(F.col("fpr")).alias("fpr"), tidy(F.col("tpr")).alias("tpr"))


@query(f"""with {_EVAL} select disease, score as threshold, {r6('ctp / (ctp + cfp)::double')} as precision, {r6('ctp / p::double')} as recall from cu
 where p > 0 union all select distinct disease, null::double, 1.0::double, 0.0::double from cu where p > 0""")
def pr_curve(spark, sf):
    s = evaluation.label_pairs(domain.predictions(spark, sf), domain.known(spark, sf))
    r = evaluation.pr_curve(s, ["disease"], "prediction_score")
    return r.where("recall is not null").select("disease", "threshold", tidy(F.col("precision")).alias("precision"), tidy(F.col("recall")).alias("recall"))


@query(f"with {_AREAS} select disease, 'auc_roc' as metric, {r6('auc_roc')} as value from ar union all select disease, 'auc_pr', {r6('auc_pr')} from ar")
def auc_comparison(spark, sf):
    return figures.auc_comparison(evaluate(spark, sf))


# ---- Similarity --------------------------------------------------------------------


_SETS = f"""{DISEASES}, {ASKED_DISEASES}, n as materialized (select disease, count(*) n, disease in (select disease from asked) as hit from dm group by disease),
pairs as materialized (select a.disease i, b.disease j, a.n x, b.n y from n a join n b on a.disease < b.disease and (a.hit or b.hit))"""


def _set_sql(expr: str) -> str:
    shared = "k as materialized (select a.disease i, b.disease j, count(*) k from dm a join dm b on a.gene = b.gene and a.disease < b.disease group by 1, 2)"
    return f"with {_SETS}, {shared} select p.i as module_i, p.j as module_j, {r6(expr)} as sim from pairs p left join k using (i, j)"


def _set_similarity(spark, sf, method: str) -> DataFrame:
    """Diseases named in rows whose id is divisible by 50 against all diseases."""
    modules = domain.disease_modules(spark, sf).withColumnRenamed("disease", "module")
    s = similarity.set_similarity(modules, method, domain.asked_diseases(spark, sf).withColumnRenamed("disease", "module"))
    return s.select("module_i", "module_j", tidy(F.col("sim")).alias("sim"))


@query(_set_sql("coalesce(k.k, 0) / (p.x + p.y - coalesce(k.k, 0))::double"))
def jaccard(spark, sf):
    return _set_similarity(spark, sf, "jaccard")


@query(_set_sql("coalesce(k.k, 0) / least(p.x, p.y)::double"))
def overlap(spark, sf):
    return _set_similarity(spark, sf, "overlap")


def _fingerprints(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings").where("vec_id is not null and embedding is not null")
    return e.select(F.col("vec_id").alias("mol"), F.transform("embedding", lambda x: (x > 0).cast("int")).alias("bits"))


def _vector_similarity(spark, sf, method: str) -> DataFrame:
    """Vectors whose id is divisible by 50 against all vectors."""
    f = _fingerprints(spark, sf)
    s = similarity.drug_similarity(f, method, asked=f.where(F.col("mol") % domain.EVERY == 0).select("mol"))
    return s.select("i", "j", tidy(F.col("sim")).alias("sim"))


_BITS = f"""f as materialized (select vec_id mol, list_transform(embedding, lambda v: (v > 0)::int) bits from embeddings
 where embedding is not null and vec_id is not null),
m as materialized (select mol, unnest(range(len(bits))) pos, unnest(bits) bit from f), c as materialized (select mol, sum(bit)::bigint n from m
 group by mol), s as materialized (select mol, pos from m where bit = 1),
k as materialized (select a.mol q, b.mol o, count(*) k from s a join s b on a.pos = b.pos and a.mol % {domain.EVERY} = 0 and a.mol <> b.mol group by 1, 2),
pr as materialized (select least(a.mol, b.mol) i, greatest(a.mol, b.mol) j, a.n x, b.n y, coalesce(k.k, 0) k from c a
 join c b on a.mol % {domain.EVERY} = 0 and a.mol <> b.mol and (a.mol < b.mol or b.mol % {domain.EVERY} <> 0) left join k on k.q = a.mol and k.o = b.mol)"""


@query(f"with {_BITS} select i, j, {r6('case when x + y - k = 0 then 0.0::double else k / (x + y - k)::double end')} as sim from pr")
def tanimoto(spark, sf):
    return _vector_similarity(spark, sf, "tanimoto")


@query(f"with {_BITS} select i, j, {r6('case when x = 0 or y = 0 then 0.0::double else k / (sqrt(x::double) * sqrt(y::double)) end')} as sim from pr")
def cosine(spark, sf):
    return _vector_similarity(spark, sf, "cosine")


@query(f"with {_SETS} select i, j, {r6('least(x, y) / greatest(x, y)::double')} as sim from pairs")
def pair_matrix(spark, sf):
    """Any Column builder as the similarity: here the ratio of module sizes."""
    n = domain.disease_modules(spark, sf).groupBy("disease").agg(F.count("*").alias("n"))
    ratio = lambda a, b: F.least(a, b) / F.greatest(a, b)
    p = similarity.pair_matrix(n, "disease", ratio, "n", domain.asked_diseases(spark, sf))
    return p.select("i", "j", tidy(F.col("sim")).alias("sim"))


# ---- Propagation -------------------------------------------------------------------

#: Steps the SQL walks; a module that had not come to rest by then would be missing from its result.
STEPS = 60


def _walk_sql(weight: str) -> str:
    return f"""{NET}, {DISEASES}, {QG}, f0 as materialized (select disease, gene, 1.0::double / count(*) over (partition by disease) s from q),
w as materialized (select a.src, a.dst, {weight} x from nadj a join deg d on d.gene = a.src join deg e on e.gene = a.dst),
it(step, disease, gene, s) as (
 select 0, disease, gene, s from f0 union all
 select step + 1, disease, gene, sum(s) from (
  select p.step, p.disease, w.dst gene, 0.5::double * sum(p.s * w.x) s from it p join w on w.src = p.gene group by p.step, p.disease, w.dst union all
  select t.step, f.disease, f.gene, 0.5::double * f.s from f0 f, (select max(step) step from it) t where t.step is not null)
 where step < {STEPS} group by step, disease, gene),
mv as (select n.step - 1 as step, n.disease, sqrt(sum(pow(n.s - coalesce(o.s, 0.0), 2))) d from it n left
 join it o on o.step = n.step - 1 and o.disease = n.disease and o.gene = n.gene where n.step > 0 group by n.step, n.disease),
rest as (select disease, min(step) step from mv where d < 1e-6 group by disease),
wk as materialized (select it.disease, it.gene, it.s from it join rest using (disease, step))"""


def _walk(spark, sf, mode: str) -> DataFrame:
    seeds = domain.disease_modules(spark, sf).withColumnRenamed("disease", "module")
    return _scores(propagation.walk(domain.network(spark, sf), seeds, mode))


def _scores(df: DataFrame) -> DataFrame:
    return df.select("module", "gene", tidy(F.col("score"), 9).alias("score"))


_OUT = "select disease as module, gene, round(s, 9) + 0.0 as score from wk"


@query(f"with recursive {_walk_sql('1.0::double / d.degree')} {_OUT}")
def rwr_column(spark, sf):
    return _walk(spark, sf, "column")


@query(f"with recursive {_walk_sql('1.0::double / e.degree')} {_OUT}")
def rwr_row(spark, sf):
    return _walk(spark, sf, "row")


@query(f"with recursive {_walk_sql('1.0::double / sqrt(d.degree::double * e.degree)')} {_OUT}")
def rwr_symmetric(spark, sf):
    return _walk(spark, sf, "symmetric")


@query(f"with recursive {_walk_sql('1.0::double / d.degree')} select disease as module, count(*) as n_genes, {r6('sum(s)')} as mass from wk group by disease")
def rwr_converged(spark, sf):
    """Genes that each walk reaches, and the share of its mass they hold at rest."""
    seeds = domain.disease_modules(spark, sf).withColumnRenamed("disease", "module")
    return propagation.walk_mass(domain.network(spark, sf), seeds).select("module", "n_genes", tidy(F.col("mass")).alias("mass"))


@query(f"""with recursive {_walk_sql('1.0::double / d.degree')} select disease as module, gene, rk::int as rank
 from (select disease, gene, row_number() over (partition by disease order by round(s, 9) desc, gene) rk from wk) where rk <= 100""")
def rwr_topk(spark, sf):
    seeds = domain.disease_modules(spark, sf).withColumnRenamed("disease", "module")
    return propagation.top_genes(_scores(propagation.walk_best(domain.network(spark, sf), seeds, 100, 9)), 100).select("module", "gene", "rank")


# ---- Figures -------------------------------------------------------------------------


def _hist_sql(source: str, v: str, bins: int, log: bool) -> str:
    edge = "pow(10.0::double, a + {} * (b - a) / {})" if log else "a + {} * (b - a) / {}"
    return f"""h as (select {f'log10({v})' if log else f'{v}::double'} v from {source}), sp as (select min(v) a, max(v) b from h),
bn as (select least(floor((v - a) / ((b - a) / {bins})), {bins - 1})::int k, any_value(a) a, any_value(b) b, count(*) n from h, sp group by 1)
select k as bin, {r6(edge.format('k', bins))} as lo, {r6(edge.format('(k + 1)', bins))} as hi, n from bn"""


def _tidy_bins(h: DataFrame) -> DataFrame:
    return h.withColumns({"lo": tidy(F.col("lo")), "hi": tidy(F.col("hi"))})


def _all_degrees(spark, sf) -> DataFrame:
    """Degrees of all genes of the interaction table, those without an edge included."""
    ends = table(spark, sf, "interactions").select(F.explode(F.array(symbol_key("protein_a"), symbol_key("protein_b"))).alias("gene"))
    return graph.degrees(domain.edges(spark, sf)).join(ends.where("gene is not null").distinct(), "gene", "right").fillna(0, ["degree"])


_DEGREES = """dg as (select g.gene, count(adj.src) degree from (select a gene from ends where a is not null union select b from ends where b is not null) g left
 join adj on adj.src = g.gene group by g.gene)"""


@query(f"with {ENDS}, {_DEGREES}, lg as (select degree from dg where degree > 0), {_hist_sql('lg', 'degree', 49, True).replace('select min(v) a', 'select 0.0::double a')}")
def degree_hist_log(spark, sf):
    return _tidy_bins(figures.degree_histogram(_all_degrees(spark, sf)))


@query(f"with {ENDS}, {_DEGREES}, {_hist_sql('dg', 'degree', 50, False)}")
def degree_hist_linear(spark, sf):
    return _tidy_bins(figures.degree_histogram(_all_degrees(spark, sf), log=False))


@query(
    f"""with u as (select 'tqab' component, tqab v from predictions union all select 'pqab', pqab from predictions union all select 'cqab', cqab
 from predictions), o as (select * from u where v is not null and not isnan(v)),
s as (select component, case when min(v) = max(v) then min(v) - 0.5 else min(v) end a, case when min(v) = max(v) then max(v) + 0.5 else max(v) end b from o
 group by component),
g as (select component, least(floor((v - a) / ((b - a) / 30)), 29)::int bin, any_value(a) a, any_value(b) b, count(*) n from o join s using (component) group by 1, 2)
select component, bin, {r6('a + bin * (b - a) / 30')} as lo, {r6('a + (bin + 1) * (b - a) / 30')} as hi, n from g"""
)
def score_hist(spark, sf):
    return _tidy_bins(figures.score_histograms(table(spark, sf, "predictions")))


@query(
    f"""with t as (select *, row_number() over (order by prediction_score desc, disease nulls first, drug_a, drug_b, prediction_id) rk from predictions
 where prediction_score is not null and not isnan(prediction_score)), p as (select rk::int "rank", drug_a || '-' || drug_b as label, prediction_score as total, coalesce(tqab, 0.0) t, coalesce(pqab, 0.0) p, coalesce(cqab, 0.0) c
 from t where rk <= 20)
select rank, label, 'tqab' as component, 0.0::double as base, {r6('t')} as width, {r6('total')} as total from p union all
select rank, label, 'pqab', {r6('case when p >= 0 then greatest(t, 0) else least(t, 0) end')}, {r6('p')}, {r6('total')} from p union all
select rank, label, 'cqab', {r6('case when c >= 0 then greatest(t, 0) + greatest(p, 0) else least(t, 0) + least(p, 0) end')}, {r6('c')}, {r6('total')} from p"""
)
def stacked_topk(spark, sf):
    s = figures.stacked_top(table(spark, sf, "predictions"), 20)
    return s.withColumns({c: tidy(F.col(c)) for c in ("base", "width", "total")})


# ---- Identifiers -----------------------------------------------------------------------


def _id_map(spark, sf) -> DataFrame:
    """Spellings of proteins in the interaction table and the symbols they stand for."""
    i = table(spark, sf, "interactions")
    ids = i.select(F.explode(F.array("protein_a", "protein_b")).alias("id")).where("id is not null").distinct()
    return ids.select("id", F.lit("auto").alias("from_type"), symbol_key("id").alias("symbol"))


_IDS = f"""idm as materialized (select id, {SYMBOL.format('id')} symbol from (select distinct protein_a id from interactions union select protein_b
 from interactions) where id is not null)"""


@query(f"with {_IDS} select c.record_id as pos, c.gene_symbol as id, m.symbol from creeds_signatures c left join idm m on m.id = c.gene_symbol")
def id_map_batch(spark, sf):
    ids = table(spark, sf, "creeds_signatures").select(F.col("record_id").alias("pos"), F.col("gene_symbol").alias("id"))
    return idmap.to_symbols(ids, _id_map(spark, sf))


@query(f"with {_IDS} select min(c.record_id) as pos, m.symbol from creeds_signatures c join idm m on m.id = c.gene_symbol where m.symbol is not null group by m.symbol")
def harmonize(spark, sf):
    ids = table(spark, sf, "creeds_signatures").select(F.col("record_id").alias("pos"), F.col("gene_symbol").alias("id"))
    return idmap.harmonize(ids, _id_map(spark, sf))


@query(f"""with {_IDS}, g as (select distinct gene id from lincs_values where gene is not null) select g.id, m.symbol from g join idm m on m.id = g.id
 where m.symbol is not null""")
def id_convert(spark, sf):
    ids = table(spark, sf, "lincs_values").select(F.col("gene").alias("id")).where("id is not null")
    return idmap.batch_convert(ids, _id_map(spark, sf).withColumn("hit_rank", F.lit(0)))
