"""Schemas that drift between files (problem 5).

Every record is held against its type's target schema: ``enforce`` parts it into
what fits and what is rescued (unknown fields, values of another type). ``ingest``
keeps the rescued part as JSON in a rescue column beside the typed ones;
``survey`` reduces it to one small row per file and field. ``changes`` reads
from those rows what each file of a producer brings, loses, renames or turns
into another type, ``learned_names`` which rescued names belong to a target
field, and ``promote`` replays approved rescued fields into typed columns.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenfold.session import cut

FILE = ("record_type", "producer_id", "file_no")
#: Files of a producer are compared in blocks of this many numbers; a block's first file is compared with the last one of the block before.
BLOCK = 256
_LEAF = "record_type string, producer_id long, file_no int, name string, type string, rescued boolean, n long, lo double, hi double"
#: Pairs of names that renames may join; they grow with the producers' imagination, not with the data. More are refused.
MAX_RENAMES = 100_000
_UUID = re.compile(r"[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}$")
_TIME = re.compile(r"\d{4}-\d\d-\d\d([T ]\d\d:\d\d.*)?$")
_NUMBER = re.compile(r"([vV]|-)?\d+(\.\d+)?([eE][+-]?\d+)?$")  # v3 is the number of a version


def _no_constant(text: str):
    raise ValueError(text)


def parse(body: str | None) -> dict | None:
    """The JSON object of a body; None for null, for what isn't valid JSON and for what isn't an object."""
    try:
        got = json.loads(body, parse_constant=_no_constant) if body is not None else None
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def leaves(obj: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    """Fields by their path with points; arrays and empty objects are leaves."""
    for name, value in obj.items():
        if isinstance(value, dict) and value:
            yield from leaves(value, f"{prefix}{name}.")
        else:
            yield prefix + name, value


def kind(value: object) -> tuple[str, float | None]:
    """JSON type with the shape of its content (after the colon), and a magnitude."""
    if value is None:
        return "null", None
    if isinstance(value, bool):
        return "boolean", None
    if isinstance(value, int):
        return "integer", math.log10(abs(value) + 1) if abs(value) < 1e300 else 300.0
    if isinstance(value, float):
        return "fractional", math.log10(abs(value) + 1)
    if isinstance(value, list):
        return "array", None
    if isinstance(value, dict):
        return "object", None
    shape = "uuid" if _UUID.match(value) else "time" if _TIME.match(value) else "number" if _NUMBER.match(value) else "path" if "/" in value and " " not in value else "word" if re.fullmatch(r"\w+", value) else "text"
    return f"string:{shape}", float(min(len(value), 10_000)) if shape in ("word", "text") else None


#: What a target type is in JSON; a file's field has changed its type if it is another one.
_JSON = {"string": "string", "long": "integer", "double": "fractional", "boolean": "boolean", "json": ""}
Target = dict[str, tuple[str, str]]


def enforce(obj: dict, target: Target, exact: bool = False) -> tuple[list, dict[str, object]]:
    """(values of the target's columns, rescued fields by path) of a record. A value that doesn't fit its column's type is rescued and the
    column null. exact takes only the type's own JSON type; otherwise a value fits if it can be cast without loss."""
    rest, row = dict(leaves(obj)), []
    for to, path in target.values():
        value, fits = (None, True) if path not in rest else (rest[path], kind(rest[path])[0].partition(":")[0] in (_JSON[to], "null")) if exact else _cast(rest[path], to)
        if fits:
            rest.pop(path, None)
        row.append(value if fits else None)
    return row, rest


def _survey(targets: dict[str, Target]):
    schema = pa.schema([("record_type", pa.string()), ("producer_id", pa.int64()), ("file_no", pa.int32()), ("name", pa.string()), ("type", pa.string()), ("rescued", pa.bool_()), ("n", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, list] = {}
            for rt, producer, file_no, body in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                obj = parse(body)
                if obj is None:
                    continue
                if not obj:
                    found.setdefault((rt, producer, file_no, None, None, False), [0, None, None])[0] += 1
                rest = enforce(obj, targets.get(rt, {}), exact=True)[1]
                for name, value in leaves(obj):
                    what, size = kind(value)
                    f = found.setdefault((rt, producer, file_no, name, what, name in rest), [0, None, None])
                    f[0] += 1
                    if size is not None:
                        f[1], f[2] = size if f[1] is None else min(f[1], size), size if f[2] is None else max(f[2], size)
            rows = [(*k, *v) for k, v in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def survey(records: DataFrame, targets: dict[str, Target] | None = None) -> DataFrame:
    """One row for each file with at least one valid record: fields array<struct<name, kinds array<struct<type, rescued, n, lo, hi>>>>, rescued for what
    the record type's target doesn't take. Rows with a null in the file's key belong to no file. Repeated rows change nothing."""
    targets = TARGETS if targets is None else targets
    rows = records.select("record_type", F.col("producer_id").cast("long"), F.col("file_no").cast("int"), "body").where("record_type is not null and producer_id is not null and file_no is not null and body is not null")
    seen = rows.mapInArrow(_survey(targets), _LEAF).groupBy(*FILE, "name", "type", "rescued").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    by_name = seen.groupBy(*FILE, "name").agg(F.collect_list(F.struct("type", "rescued", "n", "lo", "hi")).alias("kinds"))  # at most one entry per type and shape
    return by_name.groupBy(*FILE).agg(F.filter(F.collect_list(F.struct("name", "kinds")), lambda x: x["name"].isNotNull()).alias("fields"))  # one entry per field name


def pair_files(files: DataFrame) -> DataFrame:
    """Each file's fields with those of the producer's file before (null for its first file). No producer is one group:
    windows run over blocks of file numbers, and over one row per block."""
    w = Window.partitionBy("record_type", "producer_id", "b").orderBy("file_no")
    blocked = files.withColumn("b", F.floor(F.col("file_no") / BLOCK).cast("long"))
    inner = blocked.withColumn("before", F.lag("fields").over(w)).withColumn("first", F.row_number().over(w) == 1)
    ends = blocked.groupBy("record_type", "producer_id", "b").agg(F.max_by("fields", "file_no").alias("end"))
    ends = ends.withColumn("end", F.lag("end").over(Window.partitionBy("record_type", "producer_id").orderBy("b")))
    both = inner.join(ends, ["record_type", "producer_id", "b"])
    return both.select(*FILE, "fields", F.when(F.col("first"), F.col("end")).otherwise(F.col("before")).alias("before"))


def name_words(name: str) -> list[str]:
    """Words of a field's own name (without its path), split at case changes and at what isn't a letter."""
    return re.findall(r"[a-z]+|\d+", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.rpartition(".")[2]).lower())


def _short_for(a: str, b: str) -> bool:
    """One word is the other, its beginning, or its first letter with others of it in order (src, source)."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < 2 or a[0] != b[0]:
        return a == b
    letters = iter(b)
    return b.startswith(a) or all(x in letters for x in a)


def name_likeness(a: str, b: str) -> float:
    """Share of the shorter name's words that stand in the other one, whole or cut short; 1 for names that differ in
    case and joints alone. Fields under different parents have none."""
    if a.rpartition(".")[0] != b.rpartition(".")[0]:
        return 0.0
    x, y = name_words(a), name_words(b)
    if "".join(x) == "".join(y):
        return 2.0
    if not x or not y:
        return 0.0
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    rest, hits = list(large), 0.0
    for word in small:
        best = max(rest, key=lambda r: (r == word, _short_for(word, r)), default=None)
        if best is not None and (best == word or _short_for(word, best)):
            hits += 1.0 if best == word else 0.9
            rest.remove(best)
    return hits / len(small)


def _types(kinds: list) -> set[str]:
    return {k["type"].partition(":")[0] for k in kinds} - {"null", "object"}


def content_likeness(a: list, b: list) -> float:
    """How much the profiles of two fields agree, 0 to 1: types and shapes by their share, then magnitudes. A field of
    nothing but nulls agrees with anything by half."""
    p, q = ({k["type"]: k for k in x if k["type"] != "null"} for x in (a, b))
    if not p or not q:
        return 0.5
    n, m = sum(k["n"] for k in p.values()), sum(k["n"] for k in q.values())
    same = sum(min(p[t]["n"] / n, q[t]["n"] / m) for t in p.keys() & q.keys())
    if not same:
        numbers = {"integer", "fractional", "string:number"}
        return 0.3 if p.keys() <= numbers and q.keys() <= numbers else 0.0  # the same numbers may come in another type
    gaps = [max(abs(p[t][e] - q[t][e]) for e in ("lo", "hi")) / (20 if t.startswith("string") else 1) for t in p.keys() & q.keys() if p[t]["lo"] is not None and q[t]["lo"] is not None]
    return same * (1 / (1 + max(gaps) / 4) if gaps else 1)


def distinctive(kinds: list) -> bool:
    """Whether the content alone tells the field: ids, times, paths, or numbers that are large and lie close together."""
    shapes = [k for k in kinds if k["type"] != "null"]
    return bool(shapes) and all(k["type"] in ("string:uuid", "string:time", "string:path") or k["type"] == "integer" and k["lo"] > 6 and k["hi"] - k["lo"] < 0.1 for k in shapes)


def compare(before: list, now: list) -> list[tuple[str, str, str]]:
    """Changes (change_kind, old_name, new_name) between two files' fields. A field that both files have as the target wants it is left aside; what is
    rescued in either, or missing in one, is a change, or none if both rescue it alike. A lost and a new field are one renamed field
    if their content agrees and their names are related; the best pairs are taken first."""
    old, new = ({f["name"]: f["kinds"] for f in x} for x in (before, now))
    quiet = {n for n in old.keys() & new.keys() if not any(k["rescued"] for k in (*old[n], *new[n]))}
    old, new = ({n: k for n, k in x.items() if n not in quiet} for x in (old, new))
    lost, come = sorted(old.keys() - new.keys()), sorted(new.keys() - old.keys())
    rated = []
    for a in lost:
        for b in come:
            names, content = name_likeness(a, b), content_likeness(old[a], new[b])
            alone = names == 0 and content >= 0.9 and distinctive(old[a]) and distinctive(new[b]) and a.rpartition(".")[0] == b.rpartition(".")[0]
            if (names >= 0.45 and content >= 0.2) or alone:
                rated.append((-names - content, a, b))
    out, used = [], set()
    for _, a, b in sorted(rated):
        if ("-", a) not in used and ("+", b) not in used:
            used |= {("-", a), ("+", b)}
            out.append(("renamed", a, b))
    out += [("removed", a, "") for a in lost if ("-", a) not in used]
    out += [("added", "", b) for b in come if ("+", b) not in used]
    for name in sorted(old.keys() & new.keys()):
        x, y = _types(old[name]), _types(new[name])
        if x and y and x != y:
            out.append(("type_changed", name, name))
    return out


_CHANGE = "record_type string, producer_id long, file_no int, change_kind string, old_name string, new_name string"


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record_type", pa.string()), ("producer_id", pa.int64()), ("file_no", pa.int32()), ("change_kind", pa.string()), ("old_name", pa.string()), ("new_name", pa.string())])
    for batch in batches:
        rows = [(r["record_type"], r["producer_id"], r["file_no"], *c) for r in batch.to_pylist() for c in compare(r["before"], r["fields"])]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(6)], schema=schema)


def changes(records: DataFrame, targets: dict[str, Target] | None = None) -> DataFrame:
    """(record_type, producer_id, file_no, change_kind, old_name, new_name) for each change of a file against the
    producer's file before, from what the two files' records have rescued and what they lack. A file without a valid record isn't there. A type without
    a target rescues all its fields."""
    pairs = pair_files(cut(survey(records, targets))).where("before is not null")  # one small row per file, read twice
    return pairs.select(*FILE, "fields", "before").mapInArrow(_changes, _CHANGE)


def _cast(value: object, to: str) -> tuple[object, bool]:
    """value as to (string, long, double, boolean, json) and whether it fits without loss."""
    if value is None:
        return None, True
    try:
        if to == "json":
            return json.dumps(value, sort_keys=True, ensure_ascii=False), True
        if to == "string":
            return (value, True) if isinstance(value, str) else (None, False)
        if isinstance(value, bool):
            return (value, True) if to == "boolean" else (None, False)
        if to == "long":
            n = int(value) if isinstance(value, int | str) else int(value) if float(value).is_integer() else None
            return (n, True) if n is not None and -(2**63) <= n < 2**63 else (None, False)
        if to == "double" and isinstance(value, int | float | str):
            x = float(value)
            return (x, True) if math.isfinite(x) else (None, False)
    except (ValueError, OverflowError):
        pass
    return None, False


_ARROW = {"string": pa.string(), "json": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def ingest(records: DataFrame, record_type: str, target: Target) -> DataFrame:
    """One typed table: target maps a column to its type and its field's path. Adds the file's key,
    record_no and _rescued (JSON object of unknown fields and of values that don't fit; null if there are none). Bodies that
    aren't valid JSON count for nothing; rows that repeat stay as often as they stand."""
    spark_type = {"json": "string", "long": "long"}
    schema = ", ".join([*("record_type string", "producer_id long", "file_no int", "record_no int"), *(f"`{c}` {spark_type.get(t, t)}" for c, (t, _) in target.items()), "_rescued string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), *(_ARROW[t] for t, _ in target.values()), pa.string()]
        names = ["record_type", "producer_id", "file_no", "record_no", *target, "_rescued"]
        for batch in batches:
            rows = []
            for *key, body in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                obj = parse(body)
                if obj is not None:
                    row, rest = enforce(obj, target)
                    rows.append((*key, *row, _dump(rest)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    own = records.where(F.col("record_type") == record_type)
    return own.select("record_type", F.col("producer_id").cast("long"), F.col("file_no").cast("int"), F.col("record_no").cast("int"), "body").mapInArrow(run, schema)


def _dump(rest: dict) -> str | None:
    return json.dumps(rest, sort_keys=True, ensure_ascii=False) if rest else None


def promote(table: DataFrame, columns: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Replays rescued values: a column (old or new) that is null takes the first of its names that _rescued holds and that fits its type; that field leaves
    _rescued. A column that has a value keeps it, and its other names stay rescued."""
    kinds = {"json": "string"}
    old = [c for c in columns if c in table.columns]
    made = ", ".join(f"c{i} {kinds.get(t, t)}" for i, (t, _) in enumerate(columns.values()))

    @F.pandas_udf(T.StructType.fromDDL(f"{made}, rest string"))
    def split(rescued, taken):
        import pandas as pd

        out = []
        for text, has in zip(rescued, taken, strict=True):
            rest, row = json.loads(text) if text is not None else {}, []
            for i, (to, names) in enumerate(columns.values()):
                value = None
                for n in (n for n in names if n in rest and not has >> i & 1):
                    got, fits = _cast(rest[n], to)
                    if fits:
                        value = got
                        del rest[n]
                        break
                row.append(value)
            out.append((*row, _dump(rest)))
        frame = pd.DataFrame(out, columns=[*(f"c{i}" for i in range(len(columns))), "rest"], dtype=object)
        return frame.astype({f"c{i}": {"long": "Int64", "double": "Float64", "boolean": "boolean"}.get(t, object) for i, (t, _) in enumerate(columns.values())})

    flags = F.lit(0).cast("long")
    for i, c in enumerate(columns):
        if c in old:
            flags = flags + F.when(F.col(c).isNotNull(), 1 << i).otherwise(0)
    got = table.withColumn("_s", split("_rescued", flags))
    values = {c: F.coalesce(F.col(c), F.col(f"_s.c{i}")) if c in old else F.col(f"_s.c{i}") for i, c in enumerate(columns)}
    return got.withColumns(values | {"_rescued": F.col("_s.rest")}).drop("_s")


def learned_names(changed: DataFrame, target: Target) -> dict[str, tuple[str, list[str]]]:
    """By target column: its type and the other names that its field has gone by, as the renames in rows of changes() (of one record type) tell. Names are
    joined by union-find, the most frequent renames first; a rename that would make one of two target fields is passed over."""
    rows = changed.where("change_kind = 'renamed'").groupBy("old_name", "new_name").agg(F.count(F.lit(1)).alias("n")).limit(MAX_RENAMES + 1).collect()
    if len(rows) > MAX_RENAMES:
        raise ValueError(f"more than {MAX_RENAMES} renames between different names")
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.get(x, x) != x:
            x = root[x]
        return x

    fixed = {path for _, path in target.values()}
    for r in sorted(rows, key=lambda r: (-r.n, r.old_name, r.new_name)):
        a, b = find(r.old_name), find(r.new_name)
        if a != b and not (a in fixed and b in fixed):
            a, b = (a, b) if a in fixed else (b, a)
            root[b] = a
    known = {n for r in rows for n in (r.old_name, r.new_name)}
    return {c: (to, sorted(n for n in known if n != path and find(n) == path)) for c, (to, path) in target.items()}


#: The target tables of the three record types: column, type and path.
TARGETS: dict[str, Target] = {
    "ocr_event": {
        "id": ("string", "id"), "schema_version": ("long", "schema_version"), "timestamp": ("long", "timestamp"), "variant": ("string", "source.OcrVariant.variant"),
        "page": ("long", "source.OcrVariant.page"), "line_index": ("long", "source.OcrVariant.line_index"), "text": ("string", "payload.OcrLine.text"),
        "line_confidence": ("double", "payload.OcrLine.confidence"), "confidence": ("double", "confidence"),
    },
    "document_snapshot": {
        "snapshot_id": ("string", "snapshot_id"), "document_id": ("string", "document_id"), "created_at": ("string", "created_at"), "content_hash": ("string", "content_hash"),
        "confidence": ("double", "confidence"), "iterations": ("long", "iterations"), "schema_version": ("long", "schema_version"),
    },
    "reducer_state": {
        "document_id": ("string", "document_id"), "source": ("string", "source"), "pages": ("long", "pages"), "convergence_score_bps": ("double", "convergence_score_bps"),
        "ambiguity_score_bps": ("double", "ambiguity_score_bps"), "collision_rate_bps": ("double", "collision_rate_bps"), "iterations": ("long", "iterations"),
        "semantic_conflicts": ("long", "semantic_conflicts"), "schema_version": ("long", "schema_version"),
    },
}
#: Rescued fields that are approved as columns of their own.
APPROVED = {
    "is_retry": ("boolean", ["is_retry"]), "reviewed": ("boolean", ["reviewed"]), "labels": ("json", ["labels"]), "latency_ms": ("double", ["latency_ms"]), "skew_deg": ("double", ["skew_deg"]),
    "noise_ratio": ("double", ["noise_ratio"]), "dpi": ("long", ["dpi"]), "engine": ("string", ["engine"]), "operator": ("string", ["operator"]), "trace_tag": ("string", ["trace_tag"]),
}


def consistent_table(records: DataFrame, record_type: str, approved: dict[str, tuple[str, list[str]]] | None = None) -> DataFrame:
    """One table of a record type from all files: ingested by the target, then the rescued fields replayed, those under a target field's learned names into
    its column and the approved ones into columns of their own. What fits nowhere stays in _rescued."""
    own = records.where(F.col("record_type") == record_type)
    target = TARGETS[record_type]
    names = {c: v for c, v in learned_names(changes(own), target).items() if v[1]}
    return promote(ingest(own, record_type, target), names | (APPROVED if approved is None else approved))
