"""What several operators share: the shared folder, written tables, joins that stand hot keys, word hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a temporary folder if everything runs in the driver's process, else one in the warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        alone = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
        found = "file://" + tempfile.mkdtemp(prefix="granary-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/granary-scratch"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/granary/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again, so that what follows doesn't depend on lost shuffle files."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores as tell it from the columns of df."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


class Scratch:
    """The tables that one run of an operator writes on its way; they go when it ends, and only its result stays."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            drop_path(self.spark, path)

    def path(self, name: str) -> str:
        self.paths.append(fresh_path(self.spark, name))
        return self.paths[-1]

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Deletes a table that cut() wrote; nothing may read it afterwards."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, path)


def qualified(spark: SparkSession, path: str) -> str:
    """path as a URI that pyarrow's file systems take too."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return re.sub(r"^file:/+", "file:///", uri)


def file_system(uri: str):
    """The pyarrow file system of a URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished queries now, not at the driver's next full collection."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def join_skewed(rows: DataFrame, keyed: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """rows joined to keyed, which has one row for each key, while a key may have any share of rows.

    Both must be written tables or row-wise maps of such, never the direct result of an aggregation: then each side has
    an exchange of its own, and adaptive execution splits a partition of rows that one key has made large (by default
    one of over 256 MB and five times the median; what is smaller is no burden for a task).
    """
    return rows.join(keyed, key, how)


# --- bytes to word hashes -------------------------------------------------------------------------------------------

_SPACE = re.compile(rb"[\x20\x09-\x0d]")
#: Bytes whose words are hashed at once, in some 80 times as many of working memory; rows of a batch whose texts are held at once.
_CHUNK, _ROWS = 1 << 18, 1000
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 4096), _BASE, np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hash_words(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of bytes, A-Z lower-cased."""
    a = a + ((a >= 65) & (a <= 90)) * np.uint8(32)
    word = ~((a == 32) | ((a >= 9) & (a <= 13)))
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    lengths = ends - starts
    own = a[word].astype(np.uint64) + np.uint64(1)
    first = np.cumsum(lengths) - lengths
    offset = np.arange(len(own)) - np.repeat(first, lengths)
    powers = _power_table(int(lengths.max()))
    return starts, mix(np.add.reduceat(own * powers[offset], first) + lengths.astype(np.uint64))


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces that end between words."""
    at = 0
    while len(text) - at > 2 * _CHUNK:
        m = _SPACE.search(text, at + _CHUNK)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def words_of_texts(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """For each text the hashes of its words in order; None counts as empty."""
    i = 0
    while i < len(texts):
        group, size = [], 0
        while i < len(texts) and (not group or size + len(texts[i] or b"") <= _CHUNK):
            group.append(texts[i] or b"")
            size += len(group[-1]) + 1
            i += 1
        if len(group) == 1 and size > 2 * _CHUNK:
            yield np.concatenate([_hash_words(np.frombuffer(p, np.uint8))[1] for p in _pieces(group[0])])
            continue
        starts, hashes = _hash_words(np.frombuffer(b"\n".join(group), np.uint8))
        begins = np.cumsum([0, *(len(g) + 1 for g in group)])
        cuts = np.searchsorted(starts, begins)
        for k in range(len(group)):
            yield hashes[cuts[k] : cuts[k + 1]]


def shingles_of_words(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words; of fewer words the whole sequence; of none, none."""
    n = min(k, len(words))
    if not n:
        return np.empty(0, np.uint64)
    out = np.full(len(words) - n + 1, np.uint64(n), np.uint64)
    for j in range(n):
        out = mix(out * np.uint64(_BASE) + words[j : len(words) - n + 1 + j])
    return np.unique(out)


def few_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices, so that copies of texts and what is made of them stay small beside a batch."""
    for batch in batches:
        for at in range(0, len(batch), _ROWS):
            yield batch.slice(at, _ROWS)


def plain_bytes(column) -> list[bytes | None]:
    """The values of an Arrow string column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def utf8(c: str | Column) -> Column:
    return F.encode(F.col(c) if isinstance(c, str) else c, "UTF-8")
