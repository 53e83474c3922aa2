"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Shelf

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Words in a block.
BLOCK = 256
#: A source's words are taken this many times at most.
REPEATS = 3
#: Slots whose ranks one window counts, and rows of a part of a source's shuffled order, if one source has all.
CHUNK, PART_ROWS = 1 << 15, 4096
#: Points i * STEP mod 2**31 of the golden-ratio sequence; STEP is the odd number next to 2**31 / 1.618...
POINTS, STEP = 1 << 31, 1327217885
#: Equal cells of the unit interval in which slots meet sources.
CELLS = 1 << 12


def words(c: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(c), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, repeats: int = REPEATS) -> DataFrame:
    """sizes (source, source_size), one row a source: adds weight and target (double).

    Sources by code point, null last, weigh as weights repeat. Together they take share of all words; a target stops
    at repeats times its source's size and what is over is shared again by weight until none is above. That fixed
    point is min(cap, level * weight); sources in order of cap / weight show where the level lies. A source of no words
    has target 0. The table has one row a source, which is all that its windows without a partition see.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    cases = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", cases.cast("long")).withColumn("cap", F.col("source_size") * repeats)
    everything = Window.partitionBy()
    t = t.withColumn("total", F.sum("source_size").over(everything) if share == 1.0 else F.floor(F.sum("source_size").over(everything) * share))
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    t = t.withColumn("below", F.coalesce(F.sum("cap").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("open", F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing)))
    # the first source that stays under its cap, if all before it are capped, and what is left for it and those after it
    under = (F.col("total") - F.col("below")) * F.col("weight") <= F.col("cap") * F.col("open")
    t = t.withColumn("under", under)
    rank = F.row_number().over(full)
    t = t.withColumn("place", rank).withColumn("first", F.min(F.when(F.col("under"), F.col("place"))).over(everything))
    left = F.max(F.when(F.col("place") == F.col("first"), F.col("total") - F.col("below"))).over(everything)
    wide = F.max(F.when(F.col("place") == F.col("first"), F.col("open"))).over(everything)
    level = left.cast("double") * F.col("weight") / wide
    target = F.when(F.col("place") < F.coalesce("first", F.lit(1 << 30)), F.col("cap").cast("double")).otherwise(level)
    return t.withColumn("target", target).select("source", "source_size", "weight", "target")


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """The order of training: slot, source, source_size, turn (the slot's rank inside its source, from 0), words.

    Slot i has the point i * STEP mod 2**31, and the source is the one whose share of the targets, laid end to end,
    holds it; so each stretch of slots has each source near its share. Where the sequence gives a source fewer
    slots than its target needs, by the sequence's discrepancy of a few, the last ones follow at the end in turn; slots past
    the target are left out and the last one is cut. Slots and sources meet in equal cells of the interval by an equi-join. Ranks are counted in chunks of slots and
    added up over chunks, so no window holds all slots of a source. Steps are written: one plan of all of them is
    planned again after each of its shuffles, which fills the driver's memory.
    """
    shelf = Shelf(targets.sparkSession, "schedule")
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    t = targets.withColumn("want", F.floor("target").cast("long")).filter("want > 0")
    t = t.withColumn("hi", F.sum("want").over(order)).withColumn("all", F.sum("want").over(Window.partitionBy()))
    t = t.withColumn("no", F.row_number().over(order))
    point = lambda c: F.floor(c.cast("decimal(38,0)") * POINTS / F.col("all")).cast("long")
    t = t.withColumn("lo", point(F.col("hi") - F.col("want"))).withColumn("hi", point(F.col("hi"))).withColumn("need", F.ceil(F.col("want") / block))
    t = shelf.put(t.withColumn("total", F.sum("need").over(Window.partitionBy())), "targets")
    # as many slots as the targets need: one row of the sum, exploded in chunks
    width = POINTS // CELLS
    chunks = t.agg(F.sum("need").alias("need")).filter("need > 0").select("need", F.explode(F.sequence(F.lit(0), F.floor((F.col("need") - 1) / CHUNK))).alias("chunk")).repartition("chunk")
    slots = chunks.select("chunk", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("need")) - 1)).alias("slot"))
    slots = slots.withColumn("point", F.pmod(F.pmod("slot", F.lit(POINTS)) * STEP, F.lit(POINTS))).withColumn("cell", F.floor(F.col("point") / width))
    cells = t.filter("hi > lo").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    # merge, here and below: the planner takes slots for as small as the one row they are exploded from, and would broadcast them
    of_source = ["no", "source", "source_size", "want", "need"]
    hit = slots.join(cells.select("cell", "lo", "hi", *of_source).hint("merge"), "cell").filter("point >= lo and point < hi").select("slot", "chunk", *of_source)
    hit = shelf.put(hit, "hits")
    counts = hit.groupBy("no", "chunk").agg(F.count("*").alias("n"))
    counts = shelf.put(counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "counts")
    hit = hit.withColumn("turn", F.row_number().over(Window.partitionBy("no", "chunk").orderBy("slot")) - 1)
    hit = hit.join(counts.select("no", "chunk", "before").hint("merge"), ["no", "chunk"]).select("slot", *of_source, (F.col("turn") + F.col("before")).alias("turn"))
    has = counts.groupBy("no").agg(F.sum("n").alias("has"))
    late = t.join(has, "no", "left").withColumn("has", F.coalesce("has", F.lit(0))).filter("has < need")
    late = late.select("no", "total", *of_source[1:], F.explode(F.sequence("has", F.col("need") - 1)).alias("turn"))
    late = late.select((F.col("total") + F.row_number().over(Window.orderBy("turn", "no")) - 1).alias("slot"), *of_source, "turn")  # a few rows a source
    out = hit.unionByName(late).filter("turn < need")
    return out.select("slot", "source", "source_size", "turn", F.least(F.lit(block), F.col("want") - F.col("turn") * block).alias("words"))


def shuffled_spans(docs: DataFrame, sizes: DataFrame, seed: str, digits: int) -> DataFrame:
    """docs (source, doc_id, size, ...) with start, the words before each in its source's shuffled order.

    The order is that of md5(seed:doc_id), then the row's own hash. Sums run inside 16**digits parts of the order
    and then over parts, so a hot source is many windows.
    """
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    d = docs.withColumn("key", key).withColumn("part", F.substring("key", 1, digits))
    parts = d.groupBy("source", "part").agg(F.sum("size").alias("n"))
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("source", "part").orderBy("key", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    p = parts.select(F.col("source").alias("ps"), F.col("part").alias("pp"), "before")
    d = d.join(p, F.col("source").eqNullSafe(F.col("ps")) & (F.col("part") == F.col("pp")))
    return d.withColumn("start", F.col("inside") + F.col("before")).drop("key", "part", "inside", "before", "ps", "pp")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, repeats: int = REPEATS, block: int = BLOCK, seed: str = "mix") -> DataFrame:
    """One row per row of docs (doc_id, text, source, ...): doc_id, source, size, source_size, target, taken, first_slot, draws and row_hash (xxhash64 of text).

    Every source's documents stand in a shuffled order, cut into blocks of block words, again from the start where the
    target is larger than the source; the r-th slot that schedule() gives a source takes its r-th block, the last as
    much of it as the target asks for. taken counts the words of a document in those blocks, repeats counted: the sum
    over a source is its target rounded down, and no document is taken more than repeats times. first_slot is where in
    training it is met first (null if never), and draws how often a slot takes a piece of it. Reruns agree, as order
    and points are fixed.

    Null text: size 0, taken 0. Null source is a source of its own. Rows that repeat a doc_id are told apart by
    their text; equal rows share their span in some order and their counts are the same set each time. Other columns
    are left out. An empty table gives no rows.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words().alias("size"), F.xxhash64("text").alias("row"))
    shelf = Shelf(docs.sparkSession, "mixing")
    d = shelf.put(d, "documents")  # no texts: these are read and their words counted once
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = shelf.put(source_targets(sizes, weights, share, repeats), "targets")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    digits = max(1, math.ceil(math.log(max(1, d.count()) / PART_ROWS, 16)))
    tt = targets.select(F.col("source").alias("ts"), "source_size", "target", F.floor("target").cast("long").alias("want"))
    placed = shelf.put(shuffled_spans(d, sizes, seed, digits).join(tt, same("source", "ts")).drop("ts"), "placed")
    # where each pass over the source meets a document, in words of the mix; a block of those is the slot of one turn
    met = placed.filter("size > 0 and start < want").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("want") - 1 - F.col("start")) / F.col("source_size")))))
    met = met.withColumn("lo", F.col("pass") * F.col("source_size") + F.col("start")).withColumn("hi", F.least(F.col("lo") + F.col("size"), "want"))
    met = met.select("source", "start", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))).alias("turn"))
    slots = shelf.put(schedule(targets, block).select(F.col("source").alias("ss"), F.col("turn").alias("st"), "slot", "words"), "slots")
    # merge, as both are far larger exploded than estimated
    drawn = met.hint("merge").join(slots, same("source", "ss") & (F.col("turn") == F.col("st")))
    cut = F.least("hi", F.col("turn") * block + F.col("words")) - F.greatest("lo", F.col("turn") * block)
    took = drawn.groupBy("source", "start").agg(F.sum(cut).alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("draws"))
    took = shelf.put(took.select(F.col("source").alias("ks"), F.col("start").alias("kstart"), "taken", "first_slot", "draws"), "taken")
    out = placed.join(took, same("source", "ks") & (F.col("start") == F.col("kstart")) & (F.col("size") > 0), "left")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "source", "size", "source_size", "target", none("taken"), "first_slot", none("draws"), F.col("row").alias("row_hash"))
