"""Frequency mining over byte corpora: histograms, costs, n-grams, words, candidates, pairs, codes.

Inputs have the columns file_id and data (binary). Patterns are given as upper-case hex, whose order is that of the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dictionary

NO_CODE = 18


def byte_histogram(corpus: DataFrame) -> DataFrame:
    """(file_id, byte, freq) of the bytes that occur; counted where the file is, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, data in zip(batch.column("file_id"), batch.column("data"), strict=True):
                if not data.is_valid or not len(data.as_buffer()):
                    continue
                counts = np.bincount(np.frombuffer(data.as_buffer(), np.uint8), minlength=256)
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([file_id.as_py()] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["file_id", "byte", "freq"])

    return corpus.select("file_id", "data").mapInArrow(run, "file_id long, byte int, freq long")


def byte_histogram_sql(corpus: DataFrame) -> DataFrame:
    """byte_histogram in built-in functions, with a shuffle."""
    pairs = F.regexp_extract_all(F.hex("data"), F.lit("[0-9A-F]{2}"), F.lit(0))
    rows = corpus.select("file_id", F.explode(pairs).alias("pair"))
    return rows.groupBy("file_id", F.conv("pair", 16, 10).cast("int").alias("byte")).agg(F.count("*").alias("freq"))


def estimated_bits(freq: str | Column, total: str | Column) -> Column:
    """Integer estimate of a symbol's code length; 18 for one that doesn't occur."""
    f, t = (F.col(x) if isinstance(x, str) else x for x in (freq, total))
    quotient = F.greatest(F.floor(t / F.greatest(f, F.lit(1))), F.lit(1)).cast("long")
    return F.when(f > 0, F.least(F.lit(24), F.greatest(F.lit(1), F.length(F.bin(quotient))))).otherwise(F.lit(NO_CODE)).cast("int")


def literal_costs(corpus: DataFrame) -> DataFrame:
    """(file_id, byte, bits) for all 256 bytes of every file that isn't empty."""
    own = byte_histogram(corpus).groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("byte", "freq"))).alias("counts"), F.sum("freq").alias("total"))
    rows = own.select("file_id", "total", "counts", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("byte"))
    return rows.select("file_id", "byte", estimated_bits(F.coalesce(F.try_element_at("counts", "byte"), F.lit(0)), F.col("total")).alias("bits"))


def ngrams(corpus: DataFrame, longest: int = 5, least: int = 4, scan_window: int = 1 << 20) -> DataFrame:
    """(file_id, pattern, freq): substrings of 2 to longest bytes within the scan window that occur at least so often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, data in zip(batch.column("file_id"), batch.column("data"), strict=True):
                found = dictionary.ngrams(bytes(memoryview(data.as_buffer())[:scan_window]), longest, least) if data.is_valid else {}
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([file_id.as_py()] * len(found), pa.int64()), pa.array([p.hex().upper() for p in found]), pa.array([*found.values()], pa.int64())], names=["file_id", "pattern", "freq"])

    return corpus.select("file_id", "data").mapInArrow(run, "file_id long, pattern string, freq long")


def words(texts: DataFrame, least: int = 4, longest: int = 24) -> DataFrame:
    """(file_id, pattern, freq) from (file_id, text): runs of 3 to longest ASCII letters, digits and underscores."""
    w = F.explode(F.regexp_extract_all("text", F.lit("[0-9A-Z_a-z]{3,}"), F.lit(0))).alias("word")
    rows = texts.select("file_id", w).where(F.length("word") <= longest)
    return rows.groupBy("file_id", F.hex("word").alias("pattern")).agg(F.count("*").alias("freq")).where(F.col("freq") >= least)


def candidates(grams: DataFrame, tokens: DataFrame) -> DataFrame:
    """N-grams, and the words that are no n-grams; a word that is one keeps the n-gram's count."""
    return grams.unionByName(tokens.join(grams.select("file_id", "pattern"), ["file_id", "pattern"], "left_anti"))


def gains(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """found (file_id, pattern, freq) with gain: bits saved by an entry, less its own place in the dictionary."""
    own = byte_histogram(corpus).groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("byte", "freq"))).alias("counts"), F.sum("freq").alias("total"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda b: estimated_bits(F.coalesce(F.try_element_at("counts", b.cast("int")), F.lit(0)), F.col("total")))
    own = own.select("file_id", "total", bits.alias("bits"))
    rows = found.join(own, "file_id")
    size = F.expr("length(pattern) div 2")
    spelled = F.expr("aggregate(sequence(0, length(pattern) div 2 - 1), 0, (s, i) -> s + bits[cast(conv(substring(pattern, 2 * i + 1, 2), 16, 10) as int)])")
    gain = F.col("freq") * (spelled - estimated_bits("freq", "total")) - 8 * (size + 3)
    return rows.select("file_id", "pattern", "freq", gain.cast("long").alias("gain"))


def admitted(scored: DataFrame, most: int = 3072) -> DataFrame:
    """Of each file the candidates that pay, ranked; the first so many."""
    w = Window.partitionBy("file_id").orderBy(F.desc("gain"), "pattern")
    return scored.where("gain > 0").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def pair_counts(corpus: DataFrame) -> DataFrame:
    """(file_id, a, b, freq) of neighbouring bytes, overlaps included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, data in zip(batch.column("file_id"), batch.column("data"), strict=True):
                x = np.frombuffer(data.as_buffer(), np.uint8).astype(np.int32) if data.is_valid else np.empty(0, np.int32)
                pairs, n = np.unique(x[:-1] << 8 | x[1:], return_counts=True)
                if len(n):
                    yield pa.RecordBatch.from_arrays([pa.array([file_id.as_py()] * len(n), pa.int64()), pa.array(pairs >> 8), pa.array(pairs & 255), pa.array(n, pa.int64())], names=["file_id", "a", "b", "freq"])

    return corpus.select("file_id", "data").mapInArrow(run, "file_id long, a int, b int, freq long")


def merge_scores(pairs: DataFrame, corpus: DataFrame, least: int = 4) -> DataFrame:
    """The first round's offers: pairs of bytes that occur often enough and pay as an entry of two bytes."""
    hist = byte_histogram(corpus)
    total = hist.groupBy("file_id").agg(F.sum("freq").alias("total"))
    side = lambda s: hist.select("file_id", F.col("byte").alias(s), F.col("freq").alias(f"freq_{s}"))
    rows = pairs.where(F.col("freq") >= least).join(side("a"), ["file_id", "a"]).join(side("b"), ["file_id", "b"]).join(total, "file_id")
    spelled = estimated_bits("freq_a", "total") + estimated_bits("freq_b", "total")
    return rows.select("file_id", "a", "b", "freq", (F.col("freq") * (spelled - estimated_bits("freq", "total")) - 40).cast("long").alias("gain"))


def merge_choice(scored: DataFrame, most: int = 32) -> DataFrame:
    w = Window.partitionBy("file_id").orderBy(F.desc("gain"), "a", "b")
    return scored.where("gain > 0").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def code_lengths(histogram: DataFrame) -> DataFrame:
    """(file_id, sid, len) from (file_id, byte, freq): lengths of at most 16 bits; at most 256 rows a file meet."""
    from ..functions import huffman

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, counts in zip(batch.column("file_id").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                lengths = sorted(huffman.limited_lengths({c["byte"]: c["freq"] for c in counts}).items())
                yield pa.RecordBatch.from_arrays([pa.array([file_id] * len(lengths), pa.int64()), pa.array([s for s, _ in lengths], pa.int32()), pa.array([n for _, n in lengths], pa.int32())], names=["file_id", "sid", "len"])

    return histogram.groupBy("file_id").agg(F.collect_list(F.struct("byte", "freq")).alias("counts")).mapInArrow(run, "file_id long, sid int, len int")


def canonical_codes(table: DataFrame) -> DataFrame:
    """table (file_id, sid, len) with code: prefix sums of the code space, in the order of length and symbol."""
    whole = Window.partitionBy("file_id")
    order = whole.orderBy("len", "sid").rowsBetween(Window.unboundedPreceding, -1)
    rows = table.withColumn("most", F.max("len").over(whole))
    used = F.coalesce(F.sum(F.pow(F.lit(2.0), F.col("most") - F.col("len"))).over(order), F.lit(0.0))
    return rows.withColumn("code", F.floor(used / F.pow(F.lit(2.0), F.col("most") - F.col("len"))).cast("long")).drop("most")
