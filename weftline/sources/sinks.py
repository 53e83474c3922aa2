"""Writers: JSON lines, documents, checkpoints and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import duration, pretty_json
from ..operators.scoring import rows_between


def append_json(df: DataFrame, path: str, *folders: str) -> None:
    """Appends rows as JSON lines, in folders by the columns that are named; a row is there as a whole or not at all, as files are committed."""
    w = df.write.mode("append")
    (w.partitionBy(*folders) if folders else w).json(path)


def overwrite_document(df: DataFrame, path: str) -> None:
    """One document a row in a single file, indented by 2, keys in the order of the columns and nulls kept; for summaries of a few rows."""
    text = pretty_json(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    df.select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def append_keys(df: DataFrame, key: str, path: str) -> None:
    """Keys of finished rows, one a line, after the rows themselves are written."""
    df.select(F.col(key).cast("string").alias("value")).write.mode("append").text(path)


def truncate(df: DataFrame, path: str) -> None:
    df.limit(0).write.mode("overwrite").json(path)


def stats_text(avg: Column, low: Column, high: Column) -> Column:
    """Three key=value lines, a blank line, three lines for readers; null values are left blank, or - for readers."""
    number = lambda n, c: F.concat(F.lit(f"{n}_seconds_per_sample="), F.when(c.isNull(), "").otherwise(F.format_string("%.6f", c)))
    said = lambda n, c: F.concat(F.lit(f"{n}_human="), F.when(c.isNull(), "-").otherwise(duration(c)))
    # fixed value: the unit of the last line
    mean = F.concat(F.lit("avg_human="), F.when(avg > 0, F.concat(F.format_string("%.2f", avg), F.lit("s/样本"))).otherwise("-"))
    lines = [number("min", low), number("max", high), number("avg", avg), F.lit(""), said("min", low), said("max", high), mean]
    return F.concat_ws("\n", *lines)


def padded_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """Lines of a table for a console: numbers with 4 decimals, columns as wide as their widest cell. For reports of a few rows."""
    kinds = dict(df.dtypes)
    cells = df.select(*(F.format_string("%.4f", F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns))
    wide = {c: F.greatest(F.lit(len(c)), F.max(F.length(c)).over(Window.partitionBy())) for c in columns}
    return cells.select(F.concat_ws("  ", *(F.rpad(c, w, F.lit(" ")) for c, w in wide.items())).alias("line"))


def write_limited(df: DataFrame, path: str, order: str, most: int = 0) -> None:
    """Appends the first most rows by order as JSON lines; 0: all."""
    append_json(rows_between(df, order, 0, most), path)
