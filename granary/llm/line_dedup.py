"""Line dedup: lines that many documents share go, and what stays of a document is a compressed bitmap of its lines."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, plain_bytes

_LINES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("pos", pa.list_(pa.int32()))])
_LINES_DDL = "h1 long, h2 long, doc_id long, th long, pos array<int>"
_OUT = pa.schema([("kind", pa.int8()), ("n", pa.int64()), *_LINES])
_OUT_DDL = f"kind byte, n long, {_LINES_DDL}"
_DROP, _PENDING, _EDGE = 0, 1, 2


def line_keys(text: bytes | None) -> list[bytes]:
    """The key of each line: ASCII white space off both ends, A-Z lower-cased."""
    return [line.strip().lower() for line in (text or b"").split(b"\n")]


def _line_rows(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            ids, hashes = batch.column("doc_id"), batch.column("th")
            digests, owners, positions, sizes = [], [], [], []
            for k, text in enumerate(plain_bytes(batch.column("text"))):
                found: dict[bytes, list[int]] = {}
                for i, key in enumerate(line_keys(text)):
                    if key and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars):
                        found.setdefault(digest(key), []).append(i)
                digests += found.keys()
                owners += [k] * len(found)
                for at in found.values():
                    positions += at
                    sizes.append(len(at))
            if digests:
                pair = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
                own = pa.array(owners, pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(positions, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), ids.take(own), hashes.take(own), lists], schema=_LINES)

    return run


def _stream(min_docs: int, distinct: bool = True):
    """Over rows in the order of (key, doc_id): the rows of keys in min_docs documents (not distinct: rows) or more.

    The first and the last key of a partition may go on in the neighbour. Such a key's count is given as an edge row,
    and its rows, fewer than min_docs documents, are pending unless this partition alone settles them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: pa.Table | pa.RecordBatch, kind: int) -> Iterator[pa.RecordBatch]:
            t = rows if isinstance(rows, pa.Table) else pa.Table.from_batches([rows])
            t = t.add_column(0, "n", pa.array(np.zeros(len(t), np.int64))).add_column(0, "kind", pa.array(np.full(len(t), kind, np.int8)))
            yield from t.cast(_OUT).to_batches()

        def edge(key: tuple[int, int], n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"kind": _EDGE, "n": n, "h1": key[0], "h2": key[1]}], schema=_OUT)

        key, seen, last, held, first = None, 0, None, [], True  # the run that is open: key, documents, last document, rows kept back
        for batch in batches:
            if not len(batch):
                continue
            h1, h2 = (batch.column(i).to_numpy() for i in (0, 1))
            doc = batch.column(2).fill_null(np.iinfo(np.int64).min).to_numpy()
            starts = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            ends = np.r_[starts[1:], len(h1)]
            fresh = np.r_[True, doc[1:] != doc[:-1]] if distinct else np.ones(len(doc), bool)
            fresh[starts] = True
            docs = np.add.reduceat(fresh.astype(np.int64), starts)
            at = 0
            if key == (h1[0], h2[0]):  # goes on
                seen += int(docs[0]) - (distinct and last == doc[0])
                held.append(batch.slice(0, ends[0]))
                last, at = doc[ends[0] - 1], 1
                if seen >= min_docs:
                    yield from out(pa.Table.from_batches(held), _DROP)
                    held = []
            if at < len(starts):
                if key is not None:
                    if first:
                        yield edge(key, seen)
                        if held:
                            yield from out(pa.Table.from_batches(held), _PENDING)
                    first = False
                whole = np.zeros(len(starts), bool)
                whole[at:-1] = True
                if key is None:
                    whole[0] = False  # the partition's first key is an edge
                    if len(starts) > 1:
                        yield edge((int(h1[0]), int(h2[0])), int(docs[0]))
                        yield from out(batch.slice(0, ends[0]), _DROP if docs[0] >= min_docs else _PENDING)
                        first = False
                gone = np.repeat(whole & (docs >= min_docs), ends - starts)
                if gone.any():
                    yield from out(batch.filter(pa.array(gone)), _DROP)
                s = starts[-1]
                key, seen, last, held = (int(h1[s]), int(h2[s])), int(docs[-1]), doc[-1], [batch.slice(s)]
                if seen >= min_docs:
                    yield from out(pa.Table.from_batches(held), _DROP)
                    held = []
        if key is not None:
            yield edge(key, seen)
            if held:
                yield from out(pa.Table.from_batches(held), _PENDING)

    return run


def pack_keep(dropped: list[list[int]]) -> bytes:
    """The compressed bitmap of the lines that stay (a set bit each), as far as the last that goes; all after it stay."""
    keep = np.ones(-(-(max(map(max, dropped)) + 1) // 8) * 8, bool)
    for at in dropped:
        keep[at] = False
    return zlib.compress(np.packbits(keep).tobytes())


def unpack_keep(bitmap: bytes | None, n: int) -> np.ndarray:
    """Which of n lines stay; without a bitmap all do."""
    keep = np.ones(n, bool)
    if bitmap:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n]
        keep[: len(bits)] = bits
    return keep


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [pack_keep(x) for x in batch.column("dropped").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(packed, pa.binary())], names=["doc_id", "th", "keep_bitmap"])


def keep_bitmaps(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """(doc_id, th, keep_bitmap) of the documents that lose lines, without their texts; th: the text's 64-bit hash."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(_line_rows(min_chars), _LINES_DDL)
    dropped = settled_rows(rows, min_docs).groupBy("doc_id", "th").agg(F.collect_list("pos").alias("dropped"))
    return dropped.mapInArrow(_bitmaps, "doc_id long, th long, keep_bitmap binary")


def settled_rows(rows: DataFrame, least: int, distinct: bool = True) -> DataFrame:
    """Those of rows (h1, h2, doc_id, th, pos) whose key (h1, h2) is in least documents, or on least rows, or more."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = ["doc_id"] if distinct else ["doc_id", "pos"]
    ordered = rows.repartitionByRange(parts, "h1", "h2", *spread).sortWithinPartitions("h1", "h2", "doc_id", F.col("pos")[0])
    found = cut(ordered.mapInArrow(_stream(least, distinct), _OUT_DDL), "settled")
    # two edge rows for each partition at most, and fewer than least pending documents for each of them
    edges = found.where(F.col("kind") == _EDGE).groupBy("h1", "h2").agg(F.sum("n").alias("docs")).where(F.col("docs") >= least)
    late = found.where(F.col("kind") == _PENDING).join(F.broadcast(edges), ["h1", "h2"], "left_semi")
    return found.where(F.col("kind") == _DROP).unionByName(late)


def _apply(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, shas, kept_texts = [], [], [], []
            for text, bitmap in zip(plain_bytes(batch.column("text")), batch.column("keep_bitmap").to_pylist(), strict=True):
                kept, n, out = text or b"", (text or b"").count(b"\n") + 1, 0
                if bitmap:
                    keep = unpack_keep(bitmap, n)
                    kept, out = b"\n".join(compress(kept.split(b"\n"), keep)), n - int(keep.sum())
                total.append(n)
                gone.append(out)
                shas.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    kept_texts.append(kept.decode())
            columns = [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), batch.column("keep_bitmap"), pa.array(shas, pa.string())]
            names = ["doc_id", "n_lines", "n_dropped", "keep_bitmap", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(kept_texts, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, with_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, keep_bitmap (see unpack_keep; null where all stays), kept_sha256.

    Each key's rows are range-partitioned by (hash, doc_id), sorted, and read once as a stream; a key that fills
    several partitions is split between them, and only the partitions' edges are summed afterwards.
    Null and empty texts: one empty line, never dropped. Rows that repeat a doc_id are one document in the counts,
    yet each keeps a row of its own; a null doc_id counts as one more document. Other columns are ignored.
    """
    maps = keep_bitmaps(docs.select("doc_id", "text"), min_docs, min_chars).select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "keep_bitmap")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    joined = rows.join(maps, rows["doc_id"].eqNullSafe(maps["d"]) & (rows["th"] == maps["t"]), "left").select("doc_id", "text", "keep_bitmap")
    ddl = "doc_id long, n_lines long, n_dropped long, keep_bitmap binary, kept_sha256 string" + ", kept_text string" * with_text
    return joined.mapInArrow(_apply(with_text), ddl)
