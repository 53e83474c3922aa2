"""Readers: JSON lines, text lines, metadata, statistics, vectors. Every line reader gives a stable row_idx."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.json_text import is_object


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their place in their split since its last heading, among all and among those that are not blank, and that heading. A task reads its splits one after the other."""
    split, places, under = None, (0, 0), pa.scalar(None, pa.string())
    for b in batches:
        n, path, start, head = b.num_rows, b.column("path"), b.column("start"), b.column("head")
        if not n:
            continue
        heading = head.is_valid().to_numpy(zero_copy_only=False)
        new = np.ones(n, bool)
        new[0] = split != (path[0].as_py(), start[0].as_py())
        new[1:] = pc.or_(pc.not_equal(start[1:], start[:-1]), pc.not_equal(path[1:], path[:-1])).to_numpy(zero_copy_only=False)
        new |= heading
        out, after = [], []
        for before, each in zip(places, (~heading, b.column("some").to_numpy(zero_copy_only=False) & ~heading), strict=True):
            # counted so far, less what had been counted where the split or the section began
            each = each.astype(np.int64)
            total = np.cumsum(each) - each + before
            out.append(total - np.maximum.accumulate(np.where(new, total, 0)))
            after.append(int(out[-1][-1] + each[-1]))
        since = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        heads = pc.if_else(pa.array(since < 0), under, head.take(pa.array(np.maximum(since, 0))))
        split, places, under = (path[-1].as_py(), start[-1].as_py()), tuple(after), heads[-1]
        yield pa.record_batch([*b.columns, *map(pa.array, out), heads], [*b.schema.names, "place", "some_place", "under"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many lines follow the last heading of each split, and that heading; a split that several batches hold comes several times, at its end with the largest at."""
    done = 0
    for b in _placed(batches):
        path, start, own = b.column("path"), b.column("start"), b.column("head").is_null().to_numpy(zero_copy_only=False)
        last = np.ones(b.num_rows, bool)
        last[:-1] = pc.or_(pc.not_equal(start[1:], start[:-1]), pc.not_equal(path[1:], path[:-1])).to_numpy(zero_copy_only=False)
        last = np.flatnonzero(last)
        n = b.column("place").to_numpy() + own
        n_some = b.column("some_place").to_numpy() + (own & b.column("some").to_numpy(zero_copy_only=False))
        yield pa.record_batch([*(b.column(c).take(pa.array(last)) for c in ("path", "start", "under")), *(pa.array(x[last]) for x in (n, n_some)), pa.array(done + last)], ["path", "start", "under", "n", "n_some", "at"])
        done += b.num_rows


def lines(spark: SparkSession, path: str, blank: bool = False, heading: str | None = None) -> DataFrame:
    """path, row_idx, line_no and value of each line: row_idx counts from 0 in each file, blank lines left out unless blank, line_no is the line's own number, from 1.

    heading: a pattern with one group. Lines that match it are headings and no rows, both numbers begin again after each,
    and a further column, section, holds what the group took in the last one (null before the first). So many small texts
    need no file each.

    Lines end with a line feed, a carriage return or both. Files are read in splits, of which any number may be of one
    file: lines are counted in each split, the counts are summed up over a file's splits, and a second pass adds a line's
    place in its split. Lines don't move. If the splits of the two passes differ, as they can if the number of cores
    changes in between, the query fails; then set spark.sql.files.minPartitionNum.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    head = F.when(F.col("value").rlike(heading), F.regexp_extract("value", heading, 1)) if heading else F.lit(None)
    raw = raw.withColumn("some", ~F.col("value").rlike(r"(?U)^\s*$")).withColumn("head", head.cast("string"))
    if heading:
        ends = raw.drop("value").mapInArrow(_ends, "path string, start bigint, under string, n bigint, n_some bigint, at bigint")
        splits = ends.groupBy("path", "start").agg(F.max_by(F.struct("n", "n_some", "under"), "at").alias("end")).select("path", "start", "end.*")
    else:
        splits = raw.groupBy("path", "start").agg(F.count("*").alias("n"), F.count_if("some").alias("n_some"), F.lit(None).cast("string").alias("under"))
    order = Window.partitionBy("path").orderBy("start")
    splits = splits.withColumn("headed", F.sum(F.col("under").isNotNull().cast("int")).over(order))
    # a split without a heading goes on with what the one before ended with
    so_far = Window.partitionBy("path", "headed").orderBy("start")
    splits = splits.select("path", "start", "headed", *(F.sum(c).over(so_far).alias(c) for c in ("n", "n_some")), F.first("under").over(so_far).alias("section"))
    splits = splits.select("path", "start", *(F.lag(c, 1, 0).over(order).alias(c) for c in ("n", "n_some")), F.lag("section").over(order).alias("section"))
    placed = raw.mapInArrow(_placed, "path string, start bigint, value string, some boolean, head string, place bigint, some_place bigint, under string").join(splits, ["path", "start"], "left")
    changed = F.raise_error(F.lit("the splits of a file have changed between two passes"))
    earlier = lambda c: F.when(F.col(c).isNull(), changed).when(F.col("under").isNotNull(), 0).otherwise(F.col(c))
    kept = placed.filter("head is null") if blank else placed.filter("head is null and some")
    row = earlier("n") + F.col("place") if blank else earlier("n_some") + F.col("some_place")
    section = [F.coalesce("under", "section").alias("section")] if heading else []
    return kept.select("path", row.alias("row_idx"), (earlier("n") + F.col("place") + 1).alias("line_no"), "value", *section)


def jsonl_strict(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as variants; a bad line stops the query and is named."""
    bad = F.raise_error(F.concat(F.lit("bad JSON in line "), F.col("line_no").cast("string"), F.lit(" of "), F.col("path")))
    v = F.try_parse_json(F.trim("value"))
    return lines(spark, path).select("path", "row_idx", "line_no", F.when(v.isNull(), bad).otherwise(F.trim("value")).alias("raw")).withColumn("doc", F.parse_json("raw"))


def jsonl_lenient(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as variants; bad lines are left out."""
    return lines(spark, path).withColumn("raw", F.trim("value")).withColumn("doc", F.try_parse_json("raw")).filter("doc is not null").drop("value")


def text_objects(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """The JSON objects that a text holds, one a line, and the lines that are none."""
    rows = df.withColumn("__lines", F.split(column, r"\R")).select("*", F.posexplode("__lines").alias("line_idx", "line")).drop("__lines").withColumn("line", F.trim("line")).filter("line <> ''")
    good = is_object(F.col("line"))
    return rows.filter(good), rows.filter(~good)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """pos and item (JSON text) of a metadata file: a list, or an object with a list under items, docs, data or metadata."""
    v = F.parse_json("value")
    pick = F.coalesce(*(F.try_variant_get(v, p, "array<variant>") for p in ("$", "$.items", "$.docs", "$.data", "$.metadata")))
    whole = spark.read.text(path, wholetext=True).select(F.when(pick.isNull(), F.raise_error(F.lit("no list in the metadata"))).otherwise(pick).alias("items"))
    return whole.select(F.posexplode("items").alias("pos", "item")).select(F.col("pos").cast("long").alias("pos"), F.to_json("item").alias("item"))


def key_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("key")).filter("key <> ''").distinct()


def done_indexes(spark: SparkSession, path: str) -> DataFrame:
    """Distinct whole numbers, one a line; other lines are left out, and a missing file is an empty set."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "row_idx long")
    return spark.read.text(path).select(F.trim("value").try_cast("long").alias("row_idx")).filter("row_idx is not null").distinct()


def stats(spark: SparkSession, folder: str) -> DataFrame:
    """key and value of key=value[ms] lines of all *.txt of a folder; of equal keys the last file's last line counts."""
    rows = lines(spark, f"{folder}/*.txt").filter(F.col("value").contains("="))
    key, text = F.trim(F.substring_index("value", "=", 1)), F.trim(F.expr("substring(value, locate('=', value) + 1)"))
    rows = rows.select(key.alias("key"), F.trim(F.regexp_replace(text, "ms$", "")).try_cast("double").alias("value"), "path", "row_idx").filter("value is not null")
    return rows.groupBy("key").agg(F.max_by("value", F.struct("path", "row_idx")).alias("value"))


def prediction_files(spark: SparkSession, root: str) -> DataFrame:
    """path and label of root/*/*.jsonl, by path."""
    return spark.read.format("binaryFile").load(f"{root}/*/*.jsonl").select("path", label_of(F.col("path")).alias("label")).orderBy("path")


def label_of(path):
    """The name of the folder that holds a file, else the file's name without its ending."""
    parts = F.split(path, "/")
    parent = F.get(parts, F.size(parts) - 2)
    return F.coalesce(F.nullif(parent, F.lit("")), F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", ""))


def dataset(spark: SparkSession, path: str) -> DataFrame:
    """A whole dataset as one table: JSON, JSON lines or Parquet, by the ending of path."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "jsonl":
        return spark.read.json(path)
    if kind == "json":
        return spark.read.option("multiLine", True).json(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no dataset format: {path}")


def vectors(spark: SparkSession, path: str, expected: int | None = None) -> tuple[DataFrame, str | None]:
    """A vector table (vec_id, embedding, ...) and a warning if it doesn't hold expected rows."""
    df = spark.read.parquet(path)
    n = df.count() if expected is not None else None
    return df, None if n == expected else f"{n} vectors, but {expected} rows of metadata"
