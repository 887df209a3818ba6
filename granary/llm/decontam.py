"""Benchmark decontamination: short test items are searched inside long documents by size-partitioned MinHash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: An index of more rows than this is joined by a shuffle, a smaller one is broadcast (some 50 MB).
MOST_BROADCAST = 1_000_000
#: Minima kept of an item in the largest size classes.
MOST_MINIMA = 24


def words(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def shingles(w: str, k: int) -> Column:
    """Hashes of the runs of k words of the array w; of fewer words the whole sequence's; of none, none."""
    run = ", ".join(f"{w}[i + {j}]" for j in range(k))
    return F.expr(f"case when size({w}) >= {k} then transform(sequence(0, size({w}) - {k}), i -> xxhash64({run})) when size({w}) > 0 then array(xxhash64({w})) else array() end")


def _shingle_rows(rows: DataFrame, key: str, k: int) -> DataFrame:
    w = rows.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(key, words("text").alias("w"))
    return w.select(key, F.explode(shingles("w", k)).alias("h"))


def index_items(benchmark: DataFrame, k: int, percent: int) -> DataFrame:
    """(h, item_id, q, size_class, minimum): every distinct shingle of every item; minimum marks those of its MinHash.

    Items are partitioned by the power of two of their size, and all of a class keep as many minima: so many that
    percent of an item's shingles can't miss them all (more than what may be absent of the class's largest item), or
    MOST_MINIMA, which all miss with probability under 1e-16 at 80 percent.
    """
    rows = _shingle_rows(benchmark, "item_id", k).distinct()
    per_item = Window.partitionBy("item_id")
    rows = rows.withColumn("q", F.count("*").over(per_item))
    rows = rows.withColumn("size_class", F.floor(F.log2("q")).cast("int"))
    minima = F.least(F.lit(MOST_MINIMA), F.floor((100 - percent) / 100 * F.pow(F.lit(2.0), F.col("size_class") + 1)) + 1)
    rank = F.row_number().over(per_item.orderBy(F.xxhash64(F.col("h"), F.lit(1)), "h"))
    return rows.withColumn("minimum", rank <= minima)


def _sized(index: DataFrame) -> DataFrame:
    return F.broadcast(index) if index.count() <= MOST_BROADCAST else index


def contamination(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment): the items of which a document holds percent of the shingles.

    Documents probe the minima of all items; who meets one is a candidate and is verified on all shingles of the item.
    Words are runs of digits, ASCII letters and non-ASCII characters, A-Z lower-cased, so punctuation doesn't hide a passage.
    An item of fewer than k words is one shingle, its whole sequence, which only a document of just those words has:
    such an item is not found inside a longer document. Null and empty texts, on either side, and null ids match nothing. Rows that repeat an id count as one text that
    holds the shingles of all of them. Other columns are ignored.
    """
    index = cut(index_items(benchmark.select("item_id", "text"), k, percent), "items")
    own = docs.select("doc_id", "text")
    probes = _sized(index.where("minimum").select("h", "item_id"))
    found = cut(_shingle_rows(own, "doc_id", k).join(probes, "h").select("doc_id", "item_id").distinct(), "candidates")
    texts = own.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    items = _sized(index.join(found.select("item_id").distinct(), "item_id", "left_semi").select("h", "item_id", "q"))
    met = _shingle_rows(texts, "doc_id", k).join(items, "h").distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"), F.max("q").alias("n_item"))
    met = met.join(found, ["doc_id", "item_id"], "left_semi")
    return met.where(F.col("n_shared") * 100 >= F.col("n_item") * percent).withColumn("containment", F.col("n_shared") / F.col("n_item"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without those that hold an item; rows with a null doc_id stay."""
    return docs.join(contamination(docs, benchmark, k, percent).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
