"""One consistent table out of record files whose fields drift, and a list of every change.

Lines are loaded as path-value maps with raw types: one entry per dotted path of a line, arrays
of objects being passed through. Path-type statistics are aggregated per file (series and run);
neighbouring runs of a series are compared on these small statistics only, series by series (a
series has a bounded number of runs and fields, however many lines). Values are touched
for one question alone, whether a field that went and a field that came are the same field under
a new name: then the values of just these candidate paths are compared per excerpt, by digest.

Scale: the statistics are one pass without a shuffle of lines: lines of one shape (keys and types) are counted
together within the task, so only paths of files travel. The value comparison reads the lines of runs that have candidates once more;
the candidates of a run, one row a run, are broadcast where their number is measured small, else joined with the lines by (series, run) and a salt, so
that a run that holds a third of all lines spreads over tasks. Digests are keyed by (candidate pair, excerpt) and
combined map-side. The comparison of the statistics is cut off by a checkpoint. Nothing but names of columns is collected to the driver.

Defined results: null, blank and undecodable lines and lines that are no object count for
nothing, lines with an ``error`` key neither; a field that is null or an empty array in all its
lines is carried but has no type, so it is never retyped or renamed; lines that come twice count
once; a run without a countable line has no fields; an excerpt that a run holds with several values has the set of them;
an empty table gives no changes.
"""

from __future__ import annotations

import itertools
import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.sources.checkpoints import cut_lineage

PATH_SCHEMA = "series STRING, run_no INT, path STRING, parent STRING, type STRING, n BIGINT"
VALUE_SCHEMA = "pair BIGINT, excerpt BIGINT, is_old BOOLEAN, digest BIGINT"
_PATHS = pa.schema([("series", pa.string()), ("run_no", pa.int32()), ("path", pa.string()), ("parent", pa.string()), ("type", pa.string()), ("n", pa.int64())])
_VALUES = pa.schema([("pair", pa.int64()), ("excerpt", pa.int64()), ("is_old", pa.bool_()), ("digest", pa.int64())])

#: Runs with candidates up to which these are broadcast; parts that a run is split into beyond.
BROADCAST_RUNS, SALTS = 100_000, 32
#: Entries after which a task passes on what it has counted.
FLUSH = 200_000

#: Share of the excerpts that both runs hold with a value whose values must agree for a rename.
SAME_SHARE = 1.0


def raw_type(value: object) -> str | None:
    """``string``, ``number``, ``boolean``, ``object``, ``array<...>`` of such, or None."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, dict):
        return "object"
    inner = sorted({t for x in value if (t := raw_type(x)) is not None})
    return f"array<{'|'.join(inner)}>" if inner else None


def _plain(value: object) -> object:
    """Numbers that are equal get one spelling."""
    if isinstance(value, float) and math.isfinite(value) and value == int(value):
        return int(value)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value


def canonical(value: object) -> str:
    """Equal values have equal text."""
    return json.dumps(_plain(value), sort_keys=True, ensure_ascii=False)


def walk_paths(record: dict, prefix: str = "", found: dict | None = None) -> dict[str, list]:
    """Dotted path -> the values found there, in order."""
    found = {} if found is None else found
    for name, value in record.items():
        path = f"{prefix}.{name}" if prefix else name
        found.setdefault(path, []).append(value)
        if isinstance(value, dict):
            walk_paths(value, path, found)
        elif isinstance(value, list):
            for item in value:
                if isinstance(item, dict):
                    walk_paths(item, path, found)
    return found


def decode_line(text: object) -> dict | None:
    """The object of a line, or None for blank, undecodable and other lines."""
    if not isinstance(text, str) or not text.strip():
        return None
    try:
        record = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return record if isinstance(record, dict) else None


def _one_type(values: list) -> str | None:
    types = {t for v in values if (t := raw_type(v)) is not None}
    return types.pop() if len(types) == 1 else ("|".join(sorted(types)) or None)


def _countable(text: object) -> dict | None:
    """The record of a line that counts: decodable and without an error."""
    record = decode_line(text)
    return None if record is None or "error" in record else record


def shape_of(value: object) -> object:
    """What a value is made of: equal for values with the same keys and types."""
    kind = type(value)
    if kind is dict:
        return tuple(value), tuple(map(shape_of, value.values()))
    if kind is list:
        return "array", *dict.fromkeys(map(shape_of, value))
    return kind


def _example(shape: object) -> object:
    """The smallest value of a shape."""
    if isinstance(shape, tuple):
        if shape and shape[0] == "array":
            return [_example(x) for x in shape[1:]]
        return dict(zip(shape[0], map(_example, shape[1])))
    return None if shape is type(None) else shape()


def typed_paths(record: dict) -> list[tuple[str, str | None]]:
    """The path-type map of a record."""
    return [(path, _one_type(values)) for path, values in walk_paths(record).items()]


def _path_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shapes: Counter = Counter()
    known: dict[object, list[tuple[str, str | None]]] = {}

    def flush() -> pa.RecordBatch:
        merged: Counter = Counter()
        for (series, run_no, shape), n in shapes.items():
            found = known.get(shape)
            if found is None:
                found = known[shape] = typed_paths(_example(shape))
            for path, kind in found:
                merged[series, run_no, path, kind] += n
        shapes.clear()
        known.clear()
        rows = [(s, r, p, p.rpartition(".")[0], t, n) for (s, r, p, t), n in merged.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, _PATHS)], schema=_PATHS)

    for batch in batches:
        for series, run_no, text in zip(*(batch.column(c).to_pylist() for c in ("series", "run_no", "record_json"))):
            record = _countable(text)
            if record is not None:
                shapes[series, run_no, shape_of(record)] += 1
        if len(shapes) > FLUSH:
            yield flush()
    yield flush()


def values_at(value: object, path: str) -> list:
    """The values that a dotted path finds, arrays of objects being passed through."""
    found = []
    if type(value) is dict:
        for name, inner in value.items():
            if path == name:
                found.append(inner)
            if path.startswith(name) and path[len(name) : len(name) + 1] == ".":
                rest = path[len(name) + 1 :]
                for item in inner if type(inner) is list else (inner,):
                    found += values_at(item, rest)
    return found


def _digest(values: list) -> int:
    plain = "s" + values[0] if len(values) == 1 and type(values[0]) is str else canonical(values)
    return xxhash.xxh3_64_intdigest(plain.encode("utf-8", "surrogatepass")) - (1 << 63)


def _value_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, list[tuple[int, bool, str]]] = {}
    for batch in batches:
        out = []
        for text, asked in zip(*(batch.column(c).to_pylist() for c in ("record_json", "asked"))):
            record = _countable(text)
            excerpt = record.get("excerpt_id") if record is not None else None
            if not isinstance(excerpt, str):
                continue
            pairs = known.get(asked)
            if pairs is None:
                pairs = known[asked] = [(int(x["pair"]), x["is_old"], x["path"]) for x in json.loads(asked)]
            key = _digest([excerpt])
            for pair, is_old, path in pairs:
                values = values_at(record, path)
                if values and _one_type(values) is not None:
                    out.append((pair, key, is_old, _digest(values)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 4, _VALUES)], schema=_VALUES)


def load_paths(lines: DataFrame) -> DataFrame:
    """The path-type maps of the countable lines, lines of one shape counted together (``n``) within a task."""
    return (
        lines.where(F.col("series").isNotNull() & F.col("run_no").isNotNull())
        .select("series", "run_no", "record_json")
        .mapInArrow(_path_batches, PATH_SCHEMA)
    )


def with_run(lines: DataFrame, of_run: DataFrame, how: str, most: int = BROADCAST_RUNS) -> DataFrame:
    """``lines`` with the one row that ``of_run`` has of their series and run.

    Broadcast where ``of_run`` is measured small; else lines meet it by a salt too, so that no run is one task's.
    """
    of_run = cut_lineage(of_run)
    if of_run.count() <= most:
        return lines.join(F.broadcast(of_run), ["series", "run_no"], how)
    salted = of_run.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = lines.withColumn("__salt", F.pmod(F.xxhash64("record_json"), F.lit(SALTS)).cast("int"))
    return own.join(salted, ["series", "run_no", "__salt"], how).drop("__salt")


def load_values(lines: DataFrame, asked: DataFrame) -> DataFrame:
    """``pair, excerpt, is_old, digest`` of the values that countable lines have at the paths asked for of their run.

    ``asked`` has ``series, run_no, pair, is_old, path``. Excerpts come as digests too.
    """
    of_run = asked.groupBy("series", "run_no").agg(
        F.to_json(F.array_sort(F.collect_set(F.struct(F.col("pair").cast("string").alias("pair"), "is_old", "path")))).alias("asked")
    )
    joined = with_run(lines.select("series", "run_no", "record_json"), of_run, "inner")
    return joined.select("record_json", "asked").mapInArrow(_value_batches, VALUE_SCHEMA)


def path_statistics(lines: DataFrame) -> DataFrame:
    """Per series, run and path: lines that carry it, lines with a value, and its raw types."""
    return (
        load_paths(lines)
        .groupBy("series", "run_no", "path", "parent")
        .agg(
            F.sum("n").alias("n_lines"),
            F.coalesce(F.sum(F.when(F.col("type").isNotNull(), F.col("n"))), F.lit(0)).alias("n_values"),
            F.array_join(F.array_sort(F.collect_set("type")), "|").alias("types"),
        )
    )


_STEP_SCHEMA = "series STRING, run_no INT, prev INT, old_path STRING, new_path STRING, change_kind STRING"


def _per_series(df: DataFrame, columns: list[str], work: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """``work`` on the rows of each series; ``columns`` starts with the series.

    One sort within partitions and one pass over Arrow batches: series are many and small.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for frame in frames:
            out: list[tuple] = []
            for row in zip(*(frame[c] for c in columns)):
                if rows and rows[-1][0] != row[0]:
                    out += work(rows)
                    rows = []
                rows.append(row)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(work(rows) if rows else [], columns=names)

    return df.select(*columns).repartition("series").sortWithinPartitions("series").mapInPandas(batches, schema)


def _compare_runs(rows: list[tuple]) -> list[tuple]:
    """Candidate changes of one series; its runs and paths are bounded by its schemas, not by its lines.

    ``maybe_renamed`` rows pair a field that went with one of the same parent and type that came.
    """
    series = rows[0][0]
    fields: dict[int, dict[str, str]] = {}
    for _, run_no, path, types in rows:
        run = fields.setdefault(int(run_no), {})
        if isinstance(path, str):
            run[path] = types if isinstance(types, str) else ""
    out = []
    for prev, run_no in itertools.pairwise(sorted(fields)):
        old, new = fields[prev], fields[run_no]
        gone, came = [p for p in old if p not in new], [p for p in new if p not in old]
        out += [(series, run_no, prev, p, p, "removed") for p in gone]
        out += [(series, run_no, prev, p, p, "added") for p in came]
        out += [
            (series, run_no, prev, p, p, "retyped") for p in old if p in new and old[p] and new[p] and old[p] != new[p]
        ]
        out += [
            (series, run_no, prev, o, n, "maybe_renamed")
            for o in gone for n in came
            if old[o] and old[o] == new[n] and o.rpartition(".")[0] == n.rpartition(".")[0]
        ]
    return out


def _settle(rows: list[tuple]) -> list[tuple]:
    """The changes of one series: renames one to one, best agreement first; nothing below a reported field.

    Rows are ``series, run_no, old_path, new_path, change_kind, same``; pairs that agree have the kind ``agrees``.
    """
    out = []
    for run_no in sorted({r[1] for r in rows}):
        part = [r[2:] for r in rows if r[1] == run_no]
        moved: dict[str, str] = {}
        for _, old, new in sorted((-same, o, n) for o, n, kind, same in part if kind == "agrees"):
            if old not in moved and new not in moved.values():
                moved[old] = new
        taken = {*moved, *moved.values()}
        changes = [(o, "renamed", n) for o, n in moved.items()]
        changes += [(o, kind, n) for o, n, kind, _ in part if kind == "retyped" or kind in ("added", "removed") and o not in taken]
        reported = {p for o, _, n in changes for p in (o, n)}
        above = lambda p: {p[:i] for i, c in enumerate(p) if c == "."}
        out += [(rows[0][0], run_no, o, k, n) for o, k, n in changes if not above(o) & reported]
    return out


def schema_changes(lines: DataFrame, same_share: float = SAME_SHARE, statistics: DataFrame | None = None) -> DataFrame:
    """``series, run_no, field_path, change_kind, new_path`` of each change between neighbouring runs."""
    runs = lines.select("series", "run_no").where("series IS NOT NULL AND run_no IS NOT NULL").distinct()
    statistics = path_statistics(lines) if statistics is None else statistics
    fields = statistics.select("series", "run_no", "path", "types")
    fields = fields.unionByName(runs.select("series", "run_no"), allowMissingColumns=True)
    steps = cut_lineage(_per_series(fields, ["series", "run_no", "path", "types"], _compare_runs, _STEP_SCHEMA))

    maybe = steps.where("change_kind = 'maybe_renamed'").withColumn("pair", F.xxhash64("series", "run_no", "old_path", "new_path"))
    asked = maybe.select("series", F.col("prev").alias("run_no"), "pair", F.lit(True).alias("is_old"), F.col("old_path").alias("path")).unionByName(
        maybe.select("series", "run_no", "pair", F.lit(False).alias("is_old"), F.col("new_path").alias("path"))
    )
    # per excerpt, every value of either side must be one of the other side too
    values = load_values(lines, asked).groupBy("pair", "excerpt", "digest").agg(F.bool_or("is_old").alias("old"), F.bool_or(~F.col("is_old")).alias("new"))
    shared = (
        values.groupBy("pair", "excerpt")
        .agg(F.bool_or("old").alias("in_old"), F.bool_or("new").alias("in_new"), F.bool_and(F.col("old") & F.col("new")).alias("same"))
        .where("in_old AND in_new")
    )
    agreed = (
        shared.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.count_if("same").alias("same"))
        .where(F.col("same") >= same_share * F.col("n"))
        .join(maybe, "pair")
        .select("series", "run_no", "old_path", "new_path", F.lit("agrees").alias("change_kind"), "same")
    )
    known = steps.where("change_kind <> 'maybe_renamed'").select(
        "series", "run_no", "old_path", "new_path", "change_kind", F.lit(0).cast("bigint").alias("same")
    )
    columns = ["series", "run_no", "old_path", "new_path", "change_kind", "same"]
    schema = "series STRING, run_no INT, field_path STRING, change_kind STRING, new_path STRING"
    return _per_series(known.unionByName(agreed), columns, _settle, schema)


#: A field becomes a column if so many lines carry it, as a share of the lines of the most usual field: so the
#: number of columns is bounded by the mean number of fields of a line over this share.
COLUMN_SHARE = 0.01
#: Columns of the table itself; a field of such a name stays among the other fields.
OWN_COLUMNS = ("line_id", "series", "run_no", "other_fields", "failed_casts")
_KINDS = {"string": "string", "number": "double", "boolean": "boolean"}

#: Members that carry the plain value of an object which replaced it.
PLAIN_MEMBERS = ("label", "name", "value")


def cast_value(value: object, kind: str) -> tuple[object, bool]:
    """The value as ``kind`` and whether the cast failed; null is no failure."""
    if value is None:
        return None, False
    if isinstance(value, list) and len(value) == 1 and kind != "json":
        value = value[0]
    if isinstance(value, dict) and kind != "json":
        value = next((value[m] for m in PLAIN_MEMBERS if isinstance(value.get(m), (str, int, float))), value)
    if kind == "json":
        return canonical(value), False
    if isinstance(value, (dict, list)):
        return None, True
    if kind == "string":
        return value if isinstance(value, str) else canonical(value), False
    if kind == "boolean":
        if isinstance(value, (bool, int, float)) and value in (0, 1):
            return bool(value), False
        text = str(value).strip().lower()
        return {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}.get(text), text not in (
            "true", "1", "yes", "false", "0", "no",
        )
    number = re.fullmatch(r"\s*([-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)(?:\s*(?:s|sec|seconds))?\s*", str(value))
    return (float(number[1]), False) if number else (None, True)


def _lineage(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per run of one series: {its top-level name: first name in the series}. Bounded by runs x renames."""
    known: dict[str, str] = {}
    out = []
    for run_no, part in pdf.sort_values("run_no").groupby("run_no", sort=True):
        moves = [(o, n) for o, n in zip(part["field_path"], part["new_path"]) if isinstance(o, str) and "." not in o]
        step = {n: known.get(o, o) for o, n in moves}
        for o, _ in moves:
            known.pop(o, None)
        known |= step
        out.append((pdf["series"].iloc[0], run_no, {k: v for k, v in known.items() if k != v}))
    return pd.DataFrame(out, columns=["series", "run_no", "names"])


def table_columns(statistics: DataFrame, names: DataFrame) -> list[tuple[str, str]]:
    """(name, ``string``, ``double``, ``boolean`` or ``json``) of each consistent column, from the path-type statistics.

    The name is the first that the field has in its series, in its most usual spelling; the type is the one
    that most values have. ``error`` is always a column: lines that carry it have no statistics.
    """
    fields = statistics.where("parent = '' AND path <> ''").join(names, ["series", "run_no"], "left")
    fields = fields.select(F.coalesce(F.col("names")[F.col("path")], "path").alias("name"), "types", "n_lines", "n_values")
    fields = fields.groupBy("name", "types").agg(F.sum("n_lines").alias("n_lines"), F.sum("n_values").alias("n_values"))
    by_name = fields.groupBy("name").agg(F.sum("n_lines").alias("n"), F.max_by("types", F.struct("n_values", "types")).alias("types"))
    spelled = by_name.groupBy(F.lower("name").alias("key")).agg(
        F.max_by(F.struct("name", "types"), F.struct("n", "name")).alias("top"), F.sum("n").alias("n")
    )
    spelled = cut_lineage(spelled.where(~F.col("key").isin(*OWN_COLUMNS, "error")))
    most = spelled.agg(F.max("n").alias("most"))
    kept = spelled.where(F.col("n") >= COLUMN_SHARE * most.scalar()).select("top.*").orderBy("name").collect()
    return [(r["name"], _KINDS.get(r["types"], "json")) for r in kept] + [("error", "string")]


def _project(columns: dict[str, str], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    by_key = {c.lower(): c for c in columns}

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str | None, dict[str, str]] = {None: {}}
        for batch in frames:
            out = []
            for line_id, series, run_no, text, names in zip(*(batch.column(c).to_pylist() for c in ("line_id", "series", "run_no", "record_json", "names"))):
                record = decode_line(text)
                if record is None:
                    continue
                if names not in parsed:
                    parsed[names] = json.loads(names)
                row, other, failed = dict.fromkeys(columns), {}, []
                for name, value in record.items():
                    own = parsed[names].get(name, name)
                    column = by_key.get(own.lower())
                    if column is not None and row[column] is None:
                        row[column], bad = cast_value(value, columns[column])
                        if bad:
                            failed.append(name)
                    elif column is None or value is not None:
                        other[own] = None if value is None else canonical(value)
                out.append((line_id, series, run_no, *row.values(), list(other.items()), failed))
            cells = zip(*out) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, schema)], schema=schema)

    return batches


def consistent_table(lines: DataFrame) -> DataFrame:
    """Every decodable line with one set of typed columns, whatever its run called the fields.

    The columns follow from the path-type statistics (``table_columns``). Fields that have no column, or whose column
    another field of the line has taken, come in ``other_fields`` as JSON text; values that cannot be cast
    to the column's type give null there and their names in ``failed_casts``.
    """
    statistics = cut_lineage(path_statistics(lines))
    runs = lines.select("series", "run_no").where("series IS NOT NULL AND run_no IS NOT NULL").distinct()
    moves = schema_changes(lines, statistics=statistics).where("change_kind = 'renamed'").select("series", "run_no", "field_path", "new_path")
    names = cut_lineage(
        runs.join(moves, ["series", "run_no"], "left")
        .groupBy("series")
        .applyInPandas(_lineage, "series STRING, run_no INT, names MAP<STRING, STRING>")
    )
    columns = table_columns(statistics, names)
    types = {"string": pa.string(), "json": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    schema = pa.schema(
        [("line_id", pa.int64()), ("series", pa.string()), ("run_no", pa.int32()), *((n, types[k]) for n, k in columns)]
        + [("other_fields", pa.map_(pa.string(), pa.string())), ("failed_casts", pa.list_(pa.string()))]
    )
    spark_types = {"string": "STRING", "json": "STRING", "double": "DOUBLE", "boolean": "BOOLEAN"}
    quoted = ", ".join(f"`{n.replace('`', '``')}` {spark_types[k]}" for n, k in columns)
    ddl = f"line_id BIGINT, series STRING, run_no INT, {quoted}, other_fields MAP<STRING, STRING>, failed_casts ARRAY<STRING>"
    of_run = names.where(F.size("names") > 0).select("series", "run_no", F.to_json("names").alias("names"))
    own = with_run(lines.select("line_id", "series", "run_no", "record_json"), of_run, "left")
    return own.select("line_id", "series", "run_no", "record_json", "names").mapInArrow(_project(dict(columns), schema), ddl)
