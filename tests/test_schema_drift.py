import datetime as dt
import json

from pathloom.operators.schema_drift import DOSE_UNITS, LINCS_PROMOTED, LINCS_TARGETS, TIME_UNITS, Target, cast_value, field_changes, ingest, rebuild, replay

SCHEMA = "series string, file_no int, record_json string, sig_id string"


def raw(spark, files):
    rows = [(s, n, r if isinstance(r, (str, type(None))) else json.dumps(r), "outer") for s, n, recs in files for r in recs]
    return spark.createDataFrame(rows, SCHEMA)


def test_cast_values():
    dose, time = dict(DOSE_UNITS), dict(TIME_UNITS)
    assert cast_value("10.0 uM", "double", dose) == 10.0 and cast_value("1.11 µM", "double", dose) == 1.11
    assert cast_value("10 mM", "double", dose) == 10_000.0 and cast_value({"value": 10, "unit": "nM"}, "double", dose) == 0.01
    assert cast_value("10 furlong", "double", dose) is None and cast_value("10 uM", "double") is None
    assert cast_value([48], "int", time) == 48 and cast_value("24 h", "int", time) == 24 and cast_value("3 d", "int", time) == 72
    assert cast_value("24.9 h", "int", time) is None
    assert cast_value({"value": "x", "src": "y"}, "string") == "x"
    assert cast_value("Y", "boolean") is True and cast_value(0, "boolean") is False and cast_value("maybe", "boolean") is None
    assert cast_value(19630, "date") == dt.date(2023, 9, 30) and cast_value("2023-05-07T11:30:00", "date") == dt.date(2023, 5, 7)
    for placeholder in ("", "-666", -666, "n/a", None, [1, 2], {"a": 1}):
        assert cast_value(placeholder, "double") is None
    assert cast_value("abc", "int") is None and cast_value("2023-99-07", "date") is None


RECORDS = [
    {"sig_id": "a", "pert_dose": "10 mM", "pert_time": "24.9 h", "run_date": "2023-05-07T11:30:00", "new": [1, {"x": None}]},
    {"Sig ID": "b ", "pert_iname": {"value": "x", "src": "curated"}, "pert_dose": 3, "pert_time": 48, "is_gold": "Y", "run_date": "2023-05-07"},
    {"sig_id": 7, "SIG_ID": "c", "pert_dose": 2.5, "passed_qc": False, "pert_time": [6], "tas": -666, "batch": None, "compound": "n/a"},
    {"dose": {"value": 10, "unit": "nM"}, "time_h": "3 d", "comment": "", "vendor_no": "v1", "qc_score": 1e300},
    {},
]


def test_every_record_can_be_rebuilt(spark):
    """Nothing is lost by a cast, before or after promotion."""
    t = ingest(raw(spark, [("s", 1, RECORDS)]).drop("sig_id"), LINCS_TARGETS)
    names = [x.name for x in LINCS_TARGETS]
    for table in (t, replay(t, LINCS_PROMOTED, LINCS_TARGETS)):
        got = [rebuild([r[n] for n in names], r["_sources"], r["_rescued"]) for r in table.collect()]
        assert json.dumps(got, sort_keys=True) == json.dumps(RECORDS, sort_keys=True)
    r = replay(t, LINCS_PROMOTED, LINCS_TARGETS).collect()
    assert (r[0]["pert_dose"], r[0]["pert_time"], r[0]["run_date"]) == (10_000.0, None, dt.date(2023, 5, 7))
    assert (r[1]["sig_id"], r[1]["pert_iname"], r[1]["pert_dose"], r[1]["pert_time"], r[1]["is_gold"]) == ("b", "x", 3.0, 48, True)
    assert (r[2]["sig_id"], r[2]["pert_time"], r[3]["pert_dose"], r[3]["pert_time"], r[3]["pert_id"]) == ("c", 6, 0.01, 72, "v1")
    assert r[3]["_sources"][names.index("pert_id")] == "vendor_no" and "vendor_no" not in r[3]["_rescued"]


def test_ingest_keeps_what_fits_nothing(spark):
    recs = [{"sig_id": "a", "pert_dose": "x uM?", "new": [1, 2]}, "not json", None, {}, {"SIG ID": "b", "pert_time": None}]
    out = ingest(raw(spark, [("s", 1, recs)]), LINCS_TARGETS).collect()
    assert [r["sig_id_typed"] for r in out] == ["a", None, None, None, "b"]
    assert all(r["sig_id"] == "outer" for r in out)  # an input column with a clashing name keeps it
    assert json.loads(out[0]["_rescued"]) == {"pert_dose": "x uM?", "new": [1, 2]}
    assert out[1]["_rescued"] == "not json" and out[2]["_rescued"] is None and out[3]["_rescued"] is None


def test_replay_promotes_and_keeps_filled_values(spark):
    t = ingest(raw(spark, [("s", 1, [{"compound": "x", "pert_iname": "y"}, {"drug_name": ["z"], "other": 1}])]).drop("sig_id"), LINCS_TARGETS)
    out = replay(t, LINCS_PROMOTED, LINCS_TARGETS).collect()
    assert [r["pert_iname"] for r in out] == ["y", "z"]
    assert json.loads(out[0]["_rescued"]) == {"compound": "x"} and json.loads(out[1]["_rescued"]) == {"drug_name": ["z"], "other": 1}  # the list is lost by the cast


def test_every_field_lands_once(spark):
    recs = [{"sig_id": f"r{i}", "dose": "3.33 uM", "odd": i, "tas": "0.5" if i % 2 else "n/a"} for i in range(20)]
    out = replay(ingest(raw(spark, [("s", 1, recs)]).drop("sig_id"), LINCS_TARGETS), LINCS_PROMOTED, LINCS_TARGETS).collect()
    for r in out:
        rest = json.loads(r["_rescued"])
        assert rest["odd"] == int(r["sig_id"][1:]) and r["pert_dose"] == 3.33
        assert rest["tas"] in ("0.5", "n/a") and (r["tas"] == 0.5) == (rest["tas"] == "0.5") and rest["dose"] == "3.33 uM"


def changes(spark, files):
    rows = field_changes(ingest(raw(spark, files).drop("sig_id"), LINCS_TARGETS), LINCS_TARGETS).collect()
    return sorted(tuple(r) for r in rows)


def test_changes(spark):
    one = [{"sig_id": f"r{i}", "dose": f"{i}.5 uM", "old": i, "flag": "Y" if i % 2 else "N"} for i in range(8)]
    two = [{"Sig ID": f"r{i}", "dose": i + 0.5, "flag": "Y" if i % 2 else "N", "extra": None} for i in range(5, 12)]
    two_again = [dict(reversed(list(r.items()))) for r in two]
    files = [("s", 1, one), ("s", 2, two), ("s", 2, two_again), ("t", 2, one), (None, 1, one), ("s", None, two)]
    assert changes(spark, files) == [
        ("s", 2, "added", "", "extra"),
        ("s", 2, "removed", "old", ""),
        ("s", 2, "renamed", "sig_id", "Sig ID"),
        ("s", 2, "retyped", "dose", "dose"),
    ]


def test_chance_agreement_is_no_rename(spark):
    one = [{"id": f"a{i}", "x": f"v{i}", "n": i, "gone": i % 2} for i in range(6)]
    two = [{"id": f"b{i}", "x": f"w{i}", "n": i + 100, "came": i % 2} for i in range(6)]
    got = changes(spark, [("s", 1, one), ("s", 2, two)])
    assert got == [("s", 2, "added", "", "came"), ("s", 2, "removed", "gone", "")]


def test_empty(spark):
    assert changes(spark, [("s", 1, [])]) == []
    assert ingest(raw(spark, []), [Target("sig_id", "string")]).count() == 0
