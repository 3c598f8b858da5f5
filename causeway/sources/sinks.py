"""Sinks: JSON lines, CSV with fixed columns, matrices, metric tables, rankings and append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """SNK-1: one JSON object per line, nulls left out."""
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """SNK-2: CSV with a header of all columns, missing values empty; nothing for no rows."""
    if not df.isEmpty():
        df.write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def append_log(df: DataFrame, path: str) -> None:
    """SNK-11: records appended to a log that later runs resume from."""
    df.write.mode("append").json(path)


def json_line(df: DataFrame, name: str = "record") -> DataFrame:
    """Each row as its JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def matrix_header(labels: list[str], corner: str = "cause \\ effect (label)") -> str:
    """SNK-3: the header line of a matrix CSV."""
    return ",".join([corner, *labels])


def four_decimals(value: Column) -> Column:
    """SNK-7: a number at four decimals, empty for null."""
    return F.coalesce(F.call_function("format_number", value, F.lit("0.0000")), F.lit(""))


def metric_text(df: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-7: whole numbers as they are, fractions at four decimals, nulls empty."""
    kinds = dict(df.dtypes)
    own = [four_decimals(F.col(c)) if kinds[c] in ("double", "float") else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns if c not in keys]
    return df.select(*keys, *[o.alias(c) for o, c in zip(own, [c for c in df.columns if c not in keys])])


def console_lines(df: DataFrame, columns: list[tuple[str, int, int | None]]) -> DataFrame:
    """SNK-12: each row as one ``line`` of a table of fixed widths; ``columns`` are (name, width, decimals).

    Texts (no decimals) stand left, numbers right, a missing number is a dash.
    """
    def cell(name: str, width: int, decimals: int | None) -> Column:
        if decimals is None:
            return F.rpad(F.coalesce(name, F.lit("")), F.greatest(F.length(F.coalesce(name, F.lit(""))), F.lit(width)), F.lit(" "))
        text = F.coalesce(F.format_string(f"%.{decimals}f", F.col(name).cast("double")), F.lit("—"))
        text = F.when(F.col(name).isNull(), "—").otherwise(text)
        return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit(" "))

    return df.select(F.concat_ws(" ", *[cell(*c) for c in columns]).alias("line"))


def stacked_blocks(graphs: DataFrame, edges: DataFrame, key: str, n: int) -> DataFrame:
    """SNK-4: ``key, block``: per graph its marker lines, the rows of its matrix and a blank line.

    ``graphs`` has ``excerpt_id, firm, status``; a block has n short lines.
    """
    cells = edges.groupBy(key, "i").agg(F.array_sort(F.collect_set("j")).alias("js"))
    rows = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "js"))).alias("m"))
    nodes = F.sequence(F.lit(0), F.lit(n - 1))
    line = lambda i: F.array_join(
        F.transform(nodes, lambda j: F.when(F.array_contains(F.coalesce(F.element_at("m", i), F.array().cast("array<int>")), j), "1").otherwise("0")), ","
    )
    joined = graphs.join(rows, key, "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<int,array<int>>")))
    head = F.concat(
        F.lit("excerpt_id: "), F.coalesce("excerpt_id", F.lit("")), F.lit("\nfirm: "), F.coalesce("firm", F.lit("")), F.lit("\nstatus: "),
        F.coalesce("status", F.lit("")), F.lit("\n"),
    )
    return joined.select(key, F.concat(head, F.array_join(F.transform(nodes, line), "\n"), F.lit("\n")).alias("block"))
