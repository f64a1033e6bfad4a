"""Rescue-column ingestion of JSON records whose schema drifts between files.

``ingest`` enforces a target schema row by row: a field lands in its typed
column under one of its approved names, ``_sources`` names the field that filled each
column, and whatever is unknown or cannot be cast stays as JSON in ``_rescued``. A
cast that loses anything (a unit, a wrapper, a time of day, a spelling) fills the
column and leaves the original in ``_rescued`` too, so the typed columns with their
sources and ``_rescued`` always give the record back (``rebuild``). ``replay`` promotes
further approved names later by reading ``_rescued`` only. ``field_changes`` compares
each file with the one before it in its series, from typed columns, sources and
``_rescued``. Everything before the change report is a narrow map over the input, in
Arrow batches (parsing once in Python beat variant expressions, which re-parsed a
record for each use of it); the report shuffles field statistics and value hashes, keyed
by file, field and value, so no single file or series has to fit into one task.

Units are converted by the table a target declares; a number with another unit is
not cast.

Edge cases: a record that is no JSON object yields NULL columns and its whole
text in ``_rescued``; a NULL record yields NULLs; a missing or JSON-null field
is NULL; input columns keep their names, and target columns that clash with one
get the suffix ``_typed``; rows without series or file number are ingested, but
take no part in the change report; an empty table gives empty results.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.storage import Scratch

#: Values that stand for "not given" in metadata files.
PLACEHOLDERS = ("", "-666", "-666.0", "na", "n/a", "nan", "null", "none", "-", "?")


@dataclass(frozen=True)
class Target:
    """A column of the target schema, the names it is approved under, and what its units are worth."""

    name: str
    type: str  # string, double, int, boolean or date
    names: tuple[str, ...] = ()
    units: tuple[tuple[str, float], ...] = ()

    def keys(self) -> list[str]:
        return sorted({fold_name(n) for n in (self.name, *self.names)})


#: Units of doses in micromole per litre, and of times in hours.
DOSE_UNITS = (("um", 1.0), ("µm", 1.0), ("μm", 1.0), ("nm", 0.001), ("mm", 1000.0))
TIME_UNITS = (("h", 1.0), ("hr", 1.0), ("hrs", 1.0), ("hour", 1.0), ("hours", 1.0), ("d", 24.0), ("day", 24.0), ("days", 24.0), ("min", 1 / 60))


def fold_name(name: str) -> str:
    """Field name with case, spaces and punctuation folded away."""
    return "".join(c for c in name.lower() if c.isalnum())


_NUMBER = re.compile(r"([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*([^\W\d_]*)$")
_DATE = re.compile(r"(\d{4})-(\d{2})-(\d{2})(?!\d)")
_TYPES = {"string": (T.StringType(), pa.string()), "double": (T.DoubleType(), pa.float64()), "int": (T.IntegerType(), pa.int32()), "boolean": (T.BooleanType(), pa.bool_()), "date": (T.DateType(), pa.date32())}
_TRUE, _FALSE = {"y", "yes", "true", "t", "1"}, {"n", "no", "false", "f", "0"}
_SOURCES = (T.ArrayType(T.StringType()), pa.list_(pa.string()))
_EPOCH = dt.date(1970, 1, 1)


def _scalar(v: object) -> str | None:
    """Text of a JSON value: a list of one counts as its element, an object's ``value`` with its ``unit`` as that value."""
    if isinstance(v, dict) and "value" in v:
        unit = v.get("unit")
        v = v["value"]
        if isinstance(unit, str) and isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"{json.dumps(v)} {unit}"
    elif isinstance(v, list) and len(v) == 1:
        v = v[0]
    if v is None or isinstance(v, (dict, list)):
        return None
    return json.dumps(v) if isinstance(v, (bool, int, float)) else v


def exact(v: object, kind: str) -> object:
    """``v`` itself where the target type holds it without loss, else None."""
    if kind == "string":
        return v if isinstance(v, str) and v.strip() == v and v.lower() not in PLACEHOLDERS else None
    if kind == "boolean":
        return v if isinstance(v, bool) else None
    if isinstance(v, bool):
        return None
    if kind == "double":
        return v if isinstance(v, float) and v == v and abs(v) != float("inf") and v != -666 else None
    if kind == "int":
        return v if isinstance(v, int) and abs(v) < 2**31 and v != -666 else None
    if isinstance(v, str) and len(v) == 10 and _DATE.match(v):
        try:
            return dt.date.fromisoformat(v)
        except ValueError:
            return None
    return None


def cast_value(v: object, kind: str, units: dict[str, float] | None = None) -> object:
    """``v`` as the target type, or None where it is a placeholder, cannot be cast or has an undeclared unit."""
    text = _scalar(v)
    if text is None or (text := text.strip()).lower() in PLACEHOLDERS:
        return None
    if kind == "string":
        return text
    if kind == "boolean":
        return True if text.lower() in _TRUE else False if text.lower() in _FALSE else None
    if kind == "date" and (m := _DATE.match(text)):
        try:
            return dt.date(*map(int, m.groups()))
        except ValueError:
            return None
    m = _NUMBER.match(text)
    if not m:
        return None
    number = float(m[1])
    if m[2]:
        if (worth := (units or {}).get(m[2].lower())) is None:
            return None
        number *= worth
    if kind == "double":
        return number
    if kind == "int":
        return int(number) if number.is_integer() and abs(number) < 2**31 else None
    return _EPOCH + dt.timedelta(int(number)) if number.is_integer() and 0 <= number < 10**6 else None


_Spec = tuple[str, list[str], dict[str, float]]


def _specs(targets: Sequence[Target]) -> list[_Spec]:
    return [(t.type, t.keys(), dict(t.units)) for t in targets]


_FOLDED: dict[str, str] = {}


def _fold(name: str) -> str:
    if name not in _FOLDED:
        if len(_FOLDED) > 100_000:
            _FOLDED.clear()
        _FOLDED[name] = fold_name(name)
    return _FOLDED[name]


def _place(fields: dict, specs: Sequence[_Spec], values: list, sources: list) -> str | None:
    """Fill what is empty of ``values`` and ``sources`` from ``fields``; what is left of these as JSON."""
    folded: dict[str, list[str]] = {}
    for k in sorted(fields):
        folded.setdefault(_fold(k), []).append(k)
    used = set()
    for i, (kind, names, units) in enumerate(specs):
        if values[i] is not None:
            continue
        for k in (k for n in names for k in folded.get(n, ())):
            v = fields[k]
            value = exact(v, kind)
            if value is not None:
                used.add(k)
            else:
                value = cast_value(v, kind, units)
            if value is not None:
                values[i], sources[i] = value, k
                break
    rest = {k: v for k, v in fields.items() if k not in used}
    return json.dumps(rest, ensure_ascii=False) if rest else None


def _object(text: str | None) -> dict | None:
    try:
        o = json.loads(text) if text is not None else None
    except ValueError:
        return None
    return o if isinstance(o, dict) else None


def rebuild(values: Sequence[object], sources: Sequence[str | None] | None, rescued: str | None) -> dict | None:
    """The record that typed values, the fields that filled them and ``_rescued`` came from; None where it was no JSON object."""
    rest = _object(rescued)
    if rescued is not None and rest is None:
        return None
    out = dict(rest or {})
    for v, k in zip(values, sources or ()):
        if k is not None and k not in out:
            out[k] = v.isoformat() if isinstance(v, dt.date) else v
    return out


def _typed_names(columns: Sequence[str], targets: Sequence[Target]) -> list[str]:
    return [t.name if t.name not in columns else f"{t.name}_typed" for t in targets]


def ingest(raw: DataFrame, targets: Sequence[Target], record: str = "record_json") -> DataFrame:
    """Typed columns for ``targets``, ``_sources`` and ``_rescued``, for each row of ``raw``.

    ``_sources`` names, target by target, the field that filled the column, as written.
    """
    for t in targets:
        if t.type not in _TYPES:
            raise ValueError(f"unknown target type {t.type!r}")
    keep = [f for f in raw.schema.fields if f.name != record]
    names, specs = _typed_names([f.name for f in keep], targets), _specs(targets)
    typed = [T.StructField(n, _TYPES[t.type][0]) for n, t in zip(names, targets)]
    schema = T.StructType([*keep, *typed, T.StructField("_sources", _SOURCES[0]), T.StructField("_rescued", T.StringType())])
    order = [*(f.name for f in keep), record]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, sources, rest = [], [], []
            for text in b.column(len(keep)).to_pylist():
                o, values, names_ = _object(text), [None] * len(specs), [None] * len(specs)
                rest.append(_place(o, specs, values, names_) if o is not None else text)
                rows.append(values)
                sources.append(names_)
            cols = [b.column(i) for i in range(len(keep))]
            cols += [pa.array([r[i] for r in rows], _TYPES[kind][1]) for i, (kind, _, _) in enumerate(specs)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sources, _SOURCES[1]), pa.array(rest, pa.string())], names=schema.names)

    return raw.select(*(F.col(f"`{c}`") for c in order)).mapInArrow(run, schema)


def replay(table: DataFrame, targets: Sequence[Target], schema: Sequence[Target]) -> DataFrame:
    """Promote the names of ``targets`` by replaying ``_rescued`` into the typed columns of ``schema``.

    ``schema`` holds the targets of ``ingest``. A column that is already filled keeps its
    value, and the rescued one stays rescued.
    """
    known = [t.name for t in schema]
    if missing := [t.name for t in targets if t.name not in known or t.name not in table.columns]:
        raise ValueError(f"no such columns to promote into: {missing}")
    specs, at = _specs(targets), [known.index(t.name) for t in targets]
    columns = [table.columns.index(t.name) for t in targets]
    named, rescued = table.columns.index("_sources"), table.columns.index("_rescued")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = zip(*(b.column(i).to_pylist() for i in columns))
            rows, sources, rest = [], [], []
            for text, have, whence in zip(b.column(rescued).to_pylist(), old, b.column(named).to_pylist()):
                o, values = _object(text), list(have)
                mine = [whence[i] for i in at]
                rest.append(_place(o, specs, values, mine) if o is not None else text)
                for i, k in zip(at, mine):
                    whence[i] = k
                rows.append(values)
                sources.append(whence)
            cols = list(b.columns)
            for j, (i, (kind, _, _)) in enumerate(zip(columns, specs)):
                cols[i] = pa.array([r[j] for r in rows], _TYPES[kind][1])
            cols[named], cols[rescued] = pa.array(sources, _SOURCES[1]), pa.array(rest, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return table.mapInArrow(run, table.schema)


def _kind(v: object) -> str | None:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return {str: "string", list: "list", dict: "object"}.get(type(v))


def _hash64(kind: str, v: object) -> int:
    text = v if kind == "string" else repr(float(v)) if kind == "number" else json.dumps(v, sort_keys=True)
    return xxhash.xxh64_intdigest(f"{kind}:{text}".encode("utf-8", "surrogatepass")) - 2**63


def field_values(ingested: DataFrame, targets: Sequence[Target], keys: Sequence[str]) -> DataFrame:
    """(keys, rec, name, kind, hash): the fields of each ingested row, from its typed columns, sources and ``_rescued``.

    ``rec`` is a hash of the record's content, whatever the order of its fields.
    """
    typed = [c if (c := f"{t.name}_typed") in ingested.columns else t.name for t in targets]
    n = len(keys)
    out = T.StructType([*(ingested.schema[k] for k in keys), *T.StructType.fromDDL("rec bigint, name string, kind string, hash bigint").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, recs, names, kinds, hashes = [], [], [], [], []
            values = zip(*(b.column(n + i).to_pylist() for i in range(len(typed))))
            for i, (row, whence, text) in enumerate(zip(values, b.column(n + len(typed)).to_pylist(), b.column(n + len(typed) + 1).to_pylist())):
                own = []
                for k, v in (rebuild(row, whence, text) or {}).items():
                    kind = _kind(v)
                    own.append((k, kind, _hash64(kind, v) if kind else None))
                own.sort(key=lambda f: f[0])
                rec = xxhash.xxh64_intdigest(repr(own).encode("utf-8", "surrogatepass")) - 2**63
                for k, kind, h in own:
                    at.append(i)
                    recs.append(rec)
                    names.append(k)
                    kinds.append(kind)
                    hashes.append(h)
            kept = [b.column(i).take(pa.array(at, pa.int64())) for i in range(n)]
            flat = [pa.array(recs, pa.int64()), pa.array(names, pa.string()), pa.array(kinds, pa.string()), pa.array(hashes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*kept, *flat], names=out.names)

    return ingested.select(*keys, *typed, "_sources", "_rescued").mapInArrow(run, out)


def field_catalog(fields: DataFrame) -> DataFrame:
    """(series, file_no, name, kind): the fields of each file and the kind of most of their non-null values.

    Ties between kinds go to the first in alphabetical order; a field with nulls only has kind NULL.
    """
    kinds = ("boolean", "list", "number", "object", "string")
    g = fields.groupBy("series", "file_no", "name").agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in kinds))
    best = F.array_max(F.array(*(F.struct(F.col(k).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, k in enumerate(kinds))))
    return g.select("series", "file_no", "name", F.when(best["n"] > 0, best["k"]).alias("kind"))


def field_changes(ingested: DataFrame, targets: Sequence[Target], series: str = "series", file_no: str = "file_no") -> DataFrame:
    """(series, file_no, change_kind, old_field, new_field): each file against file_no - 1 of its series.

    ``ingested`` comes from ``ingest`` with the same ``targets``. A field that vanished
    and one that appeared are one ``renamed`` field if the records re-issued in both
    files hold the same values in them. Re-issued records are found by content: a
    value held by one record only in either file links the two, of several links the
    one with most values in common holds, and half of the common fields must agree. Field values are written once, as
    hashes, to the shared folder; the report is computed from that table.
    """
    scratch = Scratch(ingested.sparkSession, "field-changes")
    known = ingested.withColumnsRenamed({series: "series", file_no: "file_no"}).where("series is not null and file_no is not null")
    values = scratch.cut(field_values(known, targets, ["series", "file_no"]), "fields")
    cat = scratch.cut(field_catalog(values), "catalog")
    files = cat.select("series", "file_no").distinct()
    before = cat.select("series", (F.col("file_no") + 1).alias("file_no"), "name", F.col("kind").alias("old_kind")).join(files, ["series", "file_no"], "left_semi")
    after = cat.join(files.select("series", (F.col("file_no") + 1).alias("file_no")), ["series", "file_no"], "left_semi").withColumnRenamed("kind", "new_kind")
    both = before.withColumn("was", F.lit(True)).join(after.withColumn("is", F.lit(True)), ["series", "file_no", "name"], "full_outer")
    state = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("old_kind") != F.col("new_kind"), "retyped")
    diff = scratch.cut(both.select("series", "file_no", "name", state.alias("change")).where("change is not null"), "diff")

    # Files in which something vanished and something appeared may hold renames.
    swaps = diff.groupBy("series", "file_no").agg(F.max(F.col("change") == "removed").alias("r"), F.max(F.col("change") == "added").alias("a")).where("r and a")
    swaps = scratch.cut(swaps.select("series", "file_no"), "swaps")
    values = values.where("hash is not null").select("series", "file_no", "rec", "name", "hash")
    changed = diff.where("change in ('removed','added')").select("series", "file_no", "name", "change")

    def side(shift: int, change: str) -> DataFrame:
        v = values.withColumn("file_no", F.col("file_no") + shift).join(swaps, ["series", "file_no"], "left_semi")
        flag = changed.where(F.col("change") == change).select("series", "file_no", "name", F.lit(True).alias("moved"))
        return v.join(flag, ["series", "file_no", "name"], "left").withColumn("moved", F.col("moved").isNotNull())

    def single(v: DataFrame, rec: str, name: str) -> DataFrame:
        g = v.groupBy("series", "file_no", "name", "hash", "moved").agg(F.min("rec").alias("lo"), F.max("rec").alias("hi")).where("lo = hi")
        return g.select("series", "file_no", "hash", F.col("name").alias(name), F.col("moved").alias(f"{name}_moved"), F.col("lo").alias(rec))

    old, new = scratch.cut(side(1, "removed"), "old"), scratch.cut(side(0, "added"), "new")
    same = (F.col("old_name") == F.col("new_name")) | (F.col("old_name_moved") & F.col("new_name_moved"))
    votes = single(old, "a", "old_name").join(single(new, "b", "new_name"), ["series", "file_no", "hash"]).where(same).groupBy("series", "file_no", "a", "b").agg(F.countDistinct("new_name").alias("n"))
    votes = scratch.cut(votes, "votes")
    keys = ["series", "file_no"]
    top_a = votes.groupBy(*keys, "a").agg(F.max(F.struct("n", "b")).alias("t")).select(*keys, "a", F.col("t.b").alias("b"))
    top_b = votes.groupBy(*keys, "b").agg(F.max(F.struct("n", "a")).alias("t")).select(*keys, F.col("t.a").alias("a"), "b")
    links = scratch.cut(top_a.join(top_b, [*keys, "a", "b"], "left_semi"), "links")
    # One value in common may be chance: a re-issued record agrees in at least half of the fields that kept their name.
    was = old.where("not moved").select(*keys, F.col("rec").alias("a"), "name", F.col("hash").alias("x")).distinct()
    now = new.where("not moved").select(*keys, F.col("rec").alias("b"), "name", F.col("hash").alias("y")).distinct()
    kept = links.join(was, [*keys, "a"]).join(now, [*keys, "b", "name"]).groupBy(*keys, "a", "b").agg(F.avg((F.col("x") == F.col("y")).cast("double")).alias("same"))
    links = links.join(kept, [*keys, "a", "b"], "left").where("same is null or same >= 0.5").drop("same")

    gone = old.where("moved").select(*keys, F.col("rec").alias("a"), F.col("name").alias("old_field"), F.col("hash").alias("x")).distinct()
    come = new.where("moved").select(*keys, F.col("rec").alias("b"), F.col("name").alias("new_field"), F.col("hash").alias("y")).distinct()
    pairs = links.join(gone, [*keys, "a"]).join(come, [*keys, "b"]).groupBy(*keys, "old_field", "new_field").agg(F.count("*").alias("n"), F.sum((F.col("x") == F.col("y")).cast("long")).alias("eq")).where("2 * eq > n")
    pairs = scratch.cut(pairs, "pairs")
    by = F.struct("eq", -F.col("n"))
    best_new = pairs.groupBy(*keys, "old_field").agg(F.max_by("new_field", F.struct("eq", -F.col("n"), "new_field")).alias("new_field"))
    best_old = pairs.groupBy(*keys, "new_field").agg(F.max_by("old_field", F.struct("eq", -F.col("n"), "old_field")).alias("old_field"))
    renamed = scratch.cut(best_new.join(best_old, [*keys, "old_field", "new_field"], "left_semi"), "renamed")

    taken = renamed.select(*keys, F.explode(F.array("old_field", "new_field")).alias("name")).withColumn("taken", F.lit(True))
    rest = diff.join(taken, [*keys, "name"], "left").where("taken is null")
    empty = F.lit("")
    rest = rest.select(
        *keys,
        F.col("change").alias("change_kind"),
        F.when(F.col("change") == "added", empty).otherwise(F.col("name")).alias("old_field"),
        F.when(F.col("change") == "removed", empty).otherwise(F.col("name")).alias("new_field"),
    )
    return rest.unionByName(renamed.select(*keys, F.lit("renamed").alias("change_kind"), "old_field", "new_field"))


#: LINCS signature metadata: the target schema, under its own names.
LINCS_TARGETS = (
    Target("sig_id", "string"),
    Target("pert_iname", "string"),
    Target("pert_id", "string"),
    Target("cell_id", "string"),
    Target("pert_dose", "double", units=DOSE_UNITS),
    Target("pert_time", "int", units=TIME_UNITS),
    Target("is_gold", "boolean"),
    Target("passed_qc", "boolean"),
    Target("run_date", "date"),
    Target("batch", "string"),
    Target("tas", "double"),
    Target("replicate_corr", "double"),
    Target("qc_score", "double"),
    Target("comment", "string"),
)

#: Further names approved for promotion.
LINCS_PROMOTED = (
    Target("sig_id", "string", ("signature_id", "id", "distil_id", "pert_sig_id")),
    Target("pert_iname", "string", ("pert_name", "pert_desc", "drug_name", "compound")),
    Target("pert_id", "string", ("vendor_no", "broad_code")),
    Target("cell_id", "string", ("cell", "cell_line", "cell_iname")),
    Target("pert_dose", "double", ("pert_dose_um", "dose", "doseValue"), DOSE_UNITS),
    Target("pert_time", "int", ("pert_itime", "time_h", "exposure"), TIME_UNITS),
    Target("is_gold", "boolean", ("gold",)),
    Target("run_date", "date", ("assay_day", "created")),
    Target("batch", "string", ("plate", "det_plate")),
    Target("comment", "string", ("remarks", "annot")),
)
