import pytest

from pathloom.config import Config, load_config, merge_configs, save_config
from pathloom.operators.graph import last_by, simple_edges, union_sources
from pathloom.sources import formats, sinks


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_interaction_files(spark, tmp_path):
    huri = write(tmp_path, "huri.tsv", "# note\nSymbol A\tSymbol B\nA\tB\nC\t\n")
    corum = write(tmp_path, "corum.txt", "ComplexID\tOrganism\tsubunits(Gene name)\n7\tHuman\tA; B;;A\n8\tMouse\tX;Y\n")
    psp = write(tmp_path, "psp.txt", "n1\nn2\n\nKINASE\tSUBSTRATE\tKIN_ORGANISM\tSUB_ORGANISM\nK\tS\thuman\thuman\nK\tS\thuman\thuman\nK\tT\tmouse\thuman\n")
    t = formats.read_interactions(spark, {"huri": huri, "corum": corum, "phosphositeplus": psp, "unheard_of": huri, "kegg_rpair": huri})
    assert {k: v.count() for k, v in t.items()} == {"huri": 1, "corum": 3, "phosphositeplus": 1, "kegg_rpair": 0}
    assert {tuple(r) for r in simple_edges(union_sources(t)).collect()} == {("A", "B"), ("K", "S")}


def test_lincs_files(spark, tmp_path):
    sig = write(tmp_path, "sig.tsv", "gene\tS1\tS2\n" + "".join(f"G{i}\t{9 - i}\t{i}\n" for i in range(10)))
    meta = write(tmp_path, "meta.tsv", "distil_id\tpert_desc\nS1\timatinib\nS2\tdasatinib\n")
    got = {}
    for r in formats.read_lincs(spark, sig, meta, top_pct=0.2).collect():
        got.setdefault((r["compound"], r["direction"]), set()).add(r["gene"])
    assert got["imatinib", "up"] == {"G0", "G1"} and got["dasatinib", "up"] == {"G8", "G9"}
    with pytest.raises(KeyError):
        formats.read_metadata(spark, write(tmp_path, "bad.tsv", "weird_key\tpert_iname\nS1\tx\n"))
    with pytest.raises(ValueError):
        formats.read_lincs(spark, sig, write(tmp_path, "none.tsv", "sig_id\tpert_iname\nZ\tx\n"))
    with pytest.raises(ValueError):
        formats.read_lincs(spark, sig, meta, top_pct=0)


def test_other_files(spark, tmp_path):
    creeds = write(tmp_path, "c.tsv", "disease_name\tdirection\tgene_symbol\nd\tup\tA\nd\tup\tA\nd\tflat\tB\n")
    assert formats.read_creeds(spark, creeds).count() == 2
    known = write(tmp_path, "k.csv", "drug_a,drug_b,disease\n b ,a,Asthma\na,b,asthma\nx,y,other\n")
    assert [tuple(r) for r in formats.read_known_pairs(spark, known, "ASTHMA").collect()] == [("a", "b")]
    assert formats.read_known_pairs(spark, str(tmp_path / "missing.csv")).count() == 0
    assert formats.read_hgnc(spark, str(tmp_path / "missing.tsv")).count() == 0
    comb = write(tmp_path, "comb.csv", "Drug1,Drug2,Disease,Synergy_Score\na,b,d,1\n")
    assert formats.read_drugcombdb(spark, comb).columns == ["drug_a", "drug_b", "disease", "synergy_score"]
    assert formats.read_modules(spark, write(tmp_path, "m.csv", "drug,gene\nx,A\n")).columns == ["module", "gene"]


def test_graph_round_trip(spark, tmp_path):
    e = spark.createDataFrame([("A", "B"), ("B", "C")], "gene_a string, gene_b string")
    for kind in ("parquet", "edgelist", "graphml"):
        sinks.write_graph(e, str(tmp_path / f"g.{kind}"))
        assert sorted(map(tuple, formats.read_graph(spark, str(tmp_path / f"g.{kind}")).collect())) == [("A", "B"), ("B", "C")]
    xml = write(tmp_path, "h.graphml", '<graphml><graph><edge source="B" target="A"/><edge source="B" target="C"><data key="d">1</data></edge></graph></graphml>')
    assert sorted(map(tuple, formats.read_graph(spark, xml).collect())) == [("A", "B"), ("B", "C")]
    for bad in (lambda: formats.read_graph(spark, "g.txt"), lambda: sinks.write_graph(e, "g.txt")):
        with pytest.raises(ValueError):
            bad()


def test_rows_of_files_in_order(spark, tmp_path):
    """The last row holds over the order of files and of rows in them, however many tasks read them."""
    d = tmp_path / "meta.tsv"
    d.mkdir()
    for k in range(6):
        (d / f"part-{k}.tsv").write_text("sig_id\tpert_iname\n" + "".join(f"s{i}\tname{k}\n" for i in range(50 + k)))
    rows = formats.read_metadata(spark, str(d))
    last = {r["sig_id"]: r["pert_iname"] for r in last_by(rows, "sig_id", "row_id").collect()}
    assert all(last[f"s{i}"] == "name5" for i in range(55)) and len(last) == 55


def test_symbol_cache_and_predictions(spark, tmp_path):
    m = spark.createDataFrame([("672", "auto", "BRCA1"), ('a"b', "auto", None), ("[x]", "auto", "X")], "id string, from_type string, symbol string")
    sinks.write_symbol_cache(m, str(tmp_path / "cache.json"))
    assert sorted(map(tuple, formats.read_symbol_cache(spark, str(tmp_path / "cache.json")).collect())) == sorted(map(tuple, m.collect()))
    assert formats.read_symbol_cache(spark, str(tmp_path / "none.json")).count() == 0
    assert formats.read_symbol_cache(spark, write(tmp_path, "bad.json", "{not json")).count() == 0
    assert formats.read_predictions(spark, str(tmp_path / "none")).count() == 0
    assert formats.read_phosphosite(spark, write(tmp_path, "short.txt", "n1\nn2\n")).count() == 0


def test_config(tmp_path):
    pytest.importorskip("yaml")
    with pytest.raises(FileNotFoundError):
        load_config(tmp_path / "none.yaml")
    for text in ("", "- 1\n"):
        with pytest.raises(ValueError):
            load_config(write(tmp_path, "c.yaml", text))
    base = load_config(write(tmp_path, "c.yaml", "a: {b: 1, c: 2}\nd: 3\n"))
    new = merge_configs(base, {"a.b": 5, "x.y": 6, "a": {"c": 7}})
    assert base.a.b == 1 and new.to_dict() == {"a": {"b": 5, "c": 7}, "d": 3, "x": {"y": 6}}
    save_config(new, tmp_path / "out" / "d.yaml")
    assert load_config(tmp_path / "out" / "d.yaml").to_dict() == new.to_dict()
    assert Config({"k": {"z": 1}})["k"].z == 1
