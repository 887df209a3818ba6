"""Made-up files, the same for the same seed: prose, JSON, CSV, log lines, binary records, noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = "time year people way day man thing woman life child world school state family student group country problem hand part".split()
KINDS = ("prose", "json", "csv", "log", "binary", "noise")


def _draw(seed: int, *of: Column, below: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(below)).cast("int")


def files(spark: SparkSession, n: int, lines: int = 100, seed: int = 42) -> DataFrame:
    """n files of each kind: (file_id, kind, data). Every line depends on the file, its place and the seed alone."""
    i = F.col("file_id")
    rows = spark.range(n * len(KINDS)).select(F.col("id").alias("file_id"), F.element_at(F.array(*map(F.lit, KINDS)), (F.col("id") % len(KINDS) + 1).cast("int")).alias("kind"))
    word = lambda k, j: F.element_at(F.array(*map(F.lit, WORDS)), _draw(seed, i, k, F.lit(j), below=len(WORDS)) + 1)
    number = lambda k, j, below: _draw(seed, i, k, F.lit(j), below=below).cast("string")

    def line(k: Column) -> Column:
        return (
            F.when(F.col("kind") == "prose", F.concat_ws(" ", *(word(k, j) for j in range(9))))
            .when(F.col("kind") == "json", F.concat(F.lit('{"id":'), k.cast("string"), F.lit(',"name":"'), word(k, 1), F.lit('"}')))
            .when(F.col("kind") == "csv", F.concat_ws(",", k.cast("string"), word(k, 1), number(k, 2, 1000)))
            .when(F.col("kind") == "log", F.concat_ws(" ", F.lit("2024-01-01T00:00"), F.lit("INFO"), word(k, 1), F.concat(F.lit("took="), number(k, 2, 500))))
        )

    text = F.encode(F.concat_ws("\n", F.transform(F.sequence(F.lit(0), F.lit(lines - 1)), line)), "UTF-8")
    record = lambda k: F.concat(F.lpad(F.hex(k), 8, "0"), F.lpad(F.hex(_draw(seed, i, k, below=256)), 8, "0"))
    noise = lambda k: F.sha2(F.concat_ws("-", F.lit(str(seed)), i.cast("string"), k.cast("string")), 256)
    packed = lambda f: F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(lines - 1)), f), ""))
    return rows.withColumn("data", F.when(F.col("kind") == "binary", packed(record)).when(F.col("kind") == "noise", packed(noise)).otherwise(text))
