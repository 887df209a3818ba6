"""The relations of the run log, derived from the driver's tables with exact arithmetic, and the byte corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, filename, corpus, data, n_bytes: a file per document; a null text is an empty file."""
    d = table(spark, sf_dir, "documents")
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = d.select(F.col("doc_id").alias("file_id"), F.concat(F.lit("doc_"), "doc_id", F.lit("."), "lang").alias("filename"), F.col("source").alias("corpus"), data.alias("data"))
    return rows.withColumn("n_bytes", F.octet_length("data").cast("long"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per order; four runs in a row are a batch of the customer of the first of them, the last its child."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    leaders = o.select(F.col("o_orderkey").alias("leader"), F.col("o_custkey").alias("user_id"))
    o = o.withColumn("leader", F.col("o_orderkey") - F.col("o_orderkey") % 4).join(leaders, "leader")
    i = F.col("o_orderkey")
    text = i.cast("string")
    original = F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long")
    o = o.withColumn("original_bytes", original)
    share = lambda low, spread: F.expr(f"original_bytes * ({low} + o_orderkey % {spread}) div 100")
    o = o.withColumn("compressed_bytes", F.when(i % 17 == 0, F.lit(0).cast("long")).otherwise(share(10, 80)))
    names = [F.concat(F.lit("file_"), text, F.lit(".txt")), F.concat(F.lit("file_"), text), F.concat(F.lit("file_"), text, F.lit(".")), F.concat(F.lit("a.b_"), text, F.lit(".JSON")), F.concat(F.lit("report_"), text, F.lit(".Csv")), F.lit(".rc"), F.concat(F.lit("doc_"), text, F.lit(".tar.gz"))]
    filename = F.element_at(F.array(*names), (i % 7 + 1).cast("int"))
    first = F.substring("o_orderpriority", 1, 1)
    return with_derived(o).select(
        i.alias("id"), "user_id", filename.alias("filename"), F.when(i % 11 == 0, "decompress").otherwise("compress").alias("operation"), "original_bytes", "compressed_bytes", "ratio", "space_saved_pct",
        F.when(F.col("o_orderstatus") == "F", "native").when(F.col("o_orderstatus") == "O", "plain").otherwise("").alias("engine"),
        F.when(first.isin("1", "2"), "fast").when(first == "3", "balanced").otherwise("maximum").alias("preset"),
        (i % 13 != 0).alias("lossless_verified"), (i % 1000).alias("duration_ms"), F.col("leader").cast("string").alias("batch_id"), F.when(i % 4 == 3, F.col("leader")).alias("parent_history_id"),
        F.col("o_orderdate").alias("created_at"), F.when(i % 9 == 0, F.lit(0).cast("long")).otherwise(share(30, 50)).alias("gzip_bytes"), share(50, 40).alias("huffman_bytes"),
        (i % 800).alias("entropy_centibits"), F.sha2(F.expr("o_orderkey div 3").cast("string"), 256).alias("sha256_container"),
    )


def with_derived(rows: DataFrame) -> DataFrame:
    """ratio and space_saved_pct, computed once, when a run is written; both sizes count as 0 at least."""
    o, c = F.greatest("original_bytes", F.lit(0)), F.greatest("compressed_bytes", F.lit(0))
    return rows.withColumn("ratio", F.when(c > 0, o / c).otherwise(0.0)).withColumn("space_saved_pct", F.when(o > 0, 100 * (1 - c / o)).otherwise(0.0))


HISTORY_SQL = """
history as (select o.o_orderkey id, l.o_custkey user_id,
  case o.o_orderkey % 7 when 0 then 'file_' || o.o_orderkey || '.txt' when 1 then 'file_' || o.o_orderkey when 2 then 'file_' || o.o_orderkey || '.' when 3 then 'a.b_' || o.o_orderkey || '.JSON'
    when 4 then 'report_' || o.o_orderkey || '.Csv' when 5 then '.rc' else 'doc_' || o.o_orderkey || '.tar.gz' end filename,
  case when o.o_orderkey % 11 = 0 then 'decompress' else 'compress' end operation, ob original_bytes, cb compressed_bytes,
  case when cb > 0 then ob / cb else 0.0 end ratio, case when ob > 0 then 100 * (1 - cb / ob) else 0.0 end space_saved_pct,
  case o.o_orderstatus when 'F' then 'native' when 'O' then 'plain' else '' end engine,
  case when left(o.o_orderpriority, 1) in ('1', '2') then 'fast' when left(o.o_orderpriority, 1) = '3' then 'balanced' else 'maximum' end preset,
  o.o_orderkey % 13 <> 0 lossless_verified, o.o_orderkey % 1000 duration_ms, l.o_orderkey::varchar batch_id, case when o.o_orderkey % 4 = 3 then l.o_orderkey end parent_history_id,
  o.o_orderdate created_at, case when o.o_orderkey % 9 = 0 then 0 else ob * (30 + o.o_orderkey % 50) // 100 end gzip_bytes, ob * (50 + o.o_orderkey % 40) // 100 huffman_bytes,
  o.o_orderkey % 800 entropy_centibits, sha256((o.o_orderkey // 3)::varchar) sha256_container
  from (select *, floor(o_totalprice * 100 + 0.5)::bigint ob, case when o_orderkey % 17 = 0 then 0 else floor(o_totalprice * 100 + 0.5)::bigint * (10 + o_orderkey % 80) // 100 end cb from orders) o
  join orders l on l.o_orderkey = o.o_orderkey - o.o_orderkey % 4)"""


def artifacts(runs: DataFrame) -> DataFrame:
    """A stored result for each run that is no archive child, but for every fifth."""
    kept = runs.where("id % 4 <> 3 and id % 5 <> 0")
    return kept.select(F.col("id").alias("history_id"), "user_id", F.md5(F.col("id").cast("string")).alias("storage_key"), F.col("compressed_bytes").alias("byte_size"), F.col("sha256_container").alias("sha256"), "created_at")


ARTIFACTS_SQL = "artifacts as (select id history_id, user_id, md5(id::varchar) storage_key, compressed_bytes byte_size, sha256_container sha256, created_at from history where id % 4 <> 3 and id % 5 <> 0)"


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.lower("c_mktsegment").alias("segment"))


USERS_SQL = "users as (select c_custkey id, c_name username, lower(c_mktsegment) segment from customer)"


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed logins: the error events, from one of two addresses."""
    return table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "user_id", F.concat(F.lit("10.0.0."), (F.col("event_id") % 2).cast("string")).alias("ip_address"), "ts")


ATTEMPTS_SQL = "attempts as (select event_id, user_id, '10.0.0.' || event_id % 2 ip_address, ts from events where event_type = 'error')"


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark trials: a file is an order's lines with one return flag, each line a trial of one of three presets."""
    l = table(spark, sf_dir, "lineitem")
    preset = F.element_at(F.array(*map(F.lit, ("fast", "balanced", "maximum"))), (F.col("l_linenumber") % 3 + 1).cast("int"))
    size = F.floor(F.col("l_extendedprice")).cast("long") + 1
    return l.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), "l_returnflag").alias("path"), F.col("l_returnflag").alias("corpus"), preset.alias("preset"), size.alias("original_bytes"),
        F.expr("(floor(l_extendedprice) + 1) * (20 + l_partkey % 60) div 100").cast("long").alias("compressed_bytes"), (F.col("l_suppkey") % 97).alias("compression_ms"),
        F.when(F.col("l_partkey") % 29 == 0, "failed").otherwise("ok").alias("status"), (F.col("l_partkey") % 31 != 0).alias("sha256_equal"),
    )


TRIALS_SQL = """trials as (select l_orderkey || '-' || l_returnflag path, l_returnflag corpus, ['fast', 'balanced', 'maximum'][l_linenumber % 3 + 1] preset, floor(l_extendedprice)::bigint + 1 original_bytes,
  (floor(l_extendedprice)::bigint + 1) * (20 + l_partkey % 60) // 100 compressed_bytes, l_suppkey % 97 compression_ms, case when l_partkey % 29 = 0 then 'failed' else 'ok' end status, l_partkey % 31 <> 0 sha256_equal from lineitem)"""


def codec_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document with its size under four codecs."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("corpus"), F.col("doc_id"), F.col("n_chars").alias("orig_bytes"))
    part = lambda a, m: F.expr(f"orig_bytes * ({a} + doc_id % {m}) div 100")
    return d.select("corpus", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("file"), "orig_bytes", part(30, 17).alias("own"), part(32, 13).alias("gzip9"), part(31, 19).alias("bzip2"), part(29, 23).alias("lzma"))


CODECS_SQL = """codec_sizes as (select source corpus, 'doc_' || doc_id file, n_chars orig_bytes, n_chars * (30 + doc_id % 17) // 100 own, n_chars * (32 + doc_id % 13) // 100 gzip9,
  n_chars * (31 + doc_id % 19) // 100 bzip2, n_chars * (29 + doc_id % 23) // 100 lzma from documents)"""
