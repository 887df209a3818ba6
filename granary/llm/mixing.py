"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType
from pyspark.sql.window import Window

from .common import Scratch, cut, free_name, join_skewed

WORDS = r"[^\x20\x09-\x0D]+"
#: No source, and so no document, is taken more often than this.
MOST_REPEATS = 3
#: Slopes of the weight schedules, dealt to the sources in turn as the weights are, before they are centred: the share
#: of a source at time t of the run, from 0 to 1, is its weight times 1 + slope * (2t - 1), whose integral over the run
#: is its weight.
SLOPES = (-0.5, 0.0, 0.5)
#: Decimals of a centred slope and of a position that is given out.
DECIMALS = 6


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = MOST_REPEATS) -> DataFrame:
    """sizes (source, source_size) with turn, weight, slope and target.

    The targets fill up like water: target = least(repeats * size, weight * level), the level such that they add up to
    all sizes. The slopes are centred by the targets, so that at every time the shares of all sources add up to one:
    the time is the share of the run's words that have been given by then. One row per source goes through one
    window; sources by code point, null last.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.row_number().over(by_name) - 1
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("turn") % len(values) + 1).cast("int"))
    t = sizes.withColumn("turn", turn).withColumn("weight", pick(weights)).withColumn("slope", pick(SLOPES))
    t = t.withColumn("most", F.col("source_size") * repeats)
    order = Window.orderBy(F.col("most") / F.col("weight"), "turn")
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    t = t.withColumn("level", (F.sum("source_size").over(everything) - before) / left)
    fits = F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct("turn", "level"))
    t = t.withColumn("first", F.min(F.when(fits.isNotNull(), F.struct((F.col("most") / F.col("weight")).alias("r"), "turn", "level"))).over(everything))
    level = F.coalesce(F.col("first.level"), F.lit(float("inf")))
    t = t.withColumn("target", F.least(F.col("most").cast("double"), F.col("weight") * level))
    mean = F.coalesce(F.sum(F.col("target") * F.col("slope")).over(everything) / F.nullif(F.sum("target").over(everything), F.lit(0.0)), F.lit(0.0))
    return t.select("source", "turn", "source_size", "weight", F.round(F.col("slope") - mean, DECIMALS).alias("slope"), "target")


def position(u: Column, slope: Column) -> Column:
    """The time at which a source whose schedule is 1 + slope * (2t - 1) has given the share u of its words."""
    s = slope
    root = (s - 1 + F.sqrt((1 - s) * (1 - s) + 4 * s * u)) / F.nullif(2 * s, F.lit(0.0))
    return F.least(F.greatest(F.coalesce(root, u), F.lit(0.0)), F.lit(1.0))


def _hashable(name: str, kind: DataType) -> Column:
    column = F.col(f"`{name}`")
    return F.to_json(F.struct(column)) if isinstance(kind, (ArrayType, MapType, StructType, VariantType)) else column


def row_keys(docs: DataFrame) -> list[Column]:
    """Two 64-bit hashes of all that a row holds; rows that share both are taken to be the same."""
    columns = [_hashable(f.name, f.dataType) for f in docs.schema.fields]
    nulls = F.concat(*(F.col(f"`{c}`").isNull().cast("int").cast("string") for c in docs.columns))
    return [F.xxhash64(F.lit(seed), nulls, *columns) for seed in (1, 2)]


_RUNNING = "doc_id long, size long, r1 long, r2 long, m long, turn int, source_size long, target double, slope double, part int, running long"


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over items in the order of their source's turn: the words of the same source before each in this partition."""
    from pyspark import TaskContext

    part, last, total = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not len(batch):
            continue
        turn, words = batch.column("turn").to_numpy(), batch.column("size").to_numpy() * batch.column("m").to_numpy()
        starts = np.flatnonzero(np.r_[True, turn[1:] != turn[:-1]])
        before = np.cumsum(words) - words
        base = before[starts].copy()
        if last == turn[0]:
            base[0] -= total
        before = before - np.repeat(base, np.diff(np.r_[starts, len(turn)]))
        last, total = turn[-1], int(before[-1] + words[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), part, np.int32)), pa.array(before)], names=[*batch.schema.names, "part", "running"])


def _plan(docs: DataFrame, weights: tuple[int, ...], repeats: int, tables: Scratch) -> DataFrame:
    """A row for each row of docs: doc_id, r1, r2 (see row_keys), size, source_size, target, slope, before, copies.

    Only ids, sizes and hashes are sorted, never texts. Rows that are the same in all columns are one item with a
    count until the end, so a row that repeats without end is no burden for the task that sorts it.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r1, r2 = row_keys(docs)
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    items = docs.select("doc_id", "source", size.alias("size"), r1.alias("r1"), r2.alias("r2"))
    items = tables.cut(items.groupBy(*items.columns).agg(F.count("*").alias("m")), "items")
    targets = source_targets(items.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size")), weights, repeats)
    targets = tables.cut(targets.select(F.col("source").alias("s"), "turn", "source_size", "target", "slope"), "targets")
    rows = items.join(targets, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "r1", "r2", "m", "turn", "source_size", "target", "slope")
    order = [F.col("turn"), F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit("g")), F.col("doc_id"), F.col("size"), F.col("r1"), F.col("r2")]
    running = tables.cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_running, _RUNNING), "running")
    sums = running.groupBy("turn", "part").agg(F.sum(F.col("size") * F.col("m")).alias("words"))  # few: a partition holds a range of sources
    earlier = Window.partitionBy("turn").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = tables.cut(sums.select("turn", "part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start")), "starts")
    each = join_skewed(running, starts, ["turn", "part"]).withColumn("nth", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    each = each.withColumn("before", F.col("running") + F.col("start") + F.col("nth") * F.col("size"))
    passes = F.when(F.col("target") >= repeats * F.col("source_size"), F.lit(repeats).cast("long")).otherwise(F.floor(F.col("target") / F.col("source_size")))
    each = each.withColumn("passes", F.when(F.col("source_size") > 0, passes).otherwise(F.lit(0)))
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    more = (F.col("passes") < repeats) & (F.col("before") + F.col("size") / 2 <= rest) & (F.col("source_size") > 0)
    copies = (F.col("passes") + F.when(more, 1).otherwise(0)).cast("int")
    return each.select("doc_id", "r1", "r2", "size", "source_size", "target", "slope", "before", copies.alias("copies"))


def _position_of(copy: Column) -> Column:
    """The place in the run of a copy (from 0) of a document: its source's cumulative demand, inverted."""
    return position((copy * F.col("source_size") + F.col("before")) / F.greatest(F.col("target"), F.lit(1.0)), F.col("slope"))


def _by_position(rows: DataFrame, *keys: str) -> DataFrame:
    """rows range-sorted by the first of keys, a position, then by the others; those without one come last."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(k).asc_nulls_last() for k in keys]
    return rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)


def mixture(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = MOST_REPEATS) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, copies, first_position; in training order.

    A source's documents stand in the order of md5(doc_id), doc_id, size and a hash of the row. Whole passes over them
    come first; the rest of the target is a pass over the documents whose middle lies within it, so the words taken
    miss the target by half a document at most. A position is the share of the run's words before a copy.

    Null and empty texts have size 0 and as many copies as their neighbours; a null source is a source, the last one;
    a null doc_id stands last in its source; rows that repeat a doc_id, or a whole row, are so many documents. Only
    doc_id, text and source are read.
    """
    with Scratch(docs.sparkSession) as tables:
        plan = _plan(docs.select("doc_id", "text", "source"), weights, repeats, tables)
        first = F.when(F.col("copies") > 0, F.round(_position_of(F.lit(0)), DECIMALS))
        rows = plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", first.alias("first_position"))
        return _by_position(cut(rows, "mixture"), "first_position", "doc_id")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = MOST_REPEATS) -> DataFrame:
    """The documents that the mix takes, a row for each copy, with the columns of docs, in training order.

    The plan of mixture() is made without the texts and joined back by the rows' hashes, whatever docs' other columns
    are called; texts go through that join and the sort by position alone.
    """
    r1, r2, place = (free_name(docs, name) for name in ("r1", "r2", "place"))
    with Scratch(docs.sparkSession) as tables:
        plan = _plan(docs, weights, repeats, tables)
        each = plan.where("copies > 0").withColumn("nth_copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        places = cut(each.select(F.col("r1").alias(r1), F.col("r2").alias(r2), _position_of(F.col("nth_copy")).alias(place)), "places")
    h1, h2 = row_keys(docs)
    once = docs.withColumns({r1: h1, r2: h2}).dropDuplicates([r1, r2])
    rows = once.join(places, [r1, r2])
    return _by_position(rows, place, r1, r2).select(*(F.col(f"`{c}`") for c in docs.columns))
