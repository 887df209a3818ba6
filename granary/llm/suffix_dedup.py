"""Removal of repeated byte strings: every byte goes that a string of `length` bytes covers which starts elsewhere too.

Instead of sorting all suffixes, each window of `length` bytes is known by its anchor, the least hash of the k-byte
strings in it, which equal windows share. Runs of windows with one anchor are compared as wholes; only runs that share
their anchor but differ are taken apart, first into runs of STEP windows, and what is still open into single windows.
Each comparison is a range-partitioned sort.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, mix, plain_bytes, release
from .line_dedup import _LINES, _LINES_DDL, settled_rows

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CHUNK = 1 << 20
_POSITION = np.uint64(22)  # bits of a position in a chunk of at most 4 MB

#: Windows of a short run.
STEP = 16

_RUNS = pa.schema([("ah", pa.int64()), ("dg", pa.int64()), ("rid", pa.int64()), ("p0", pa.int64()), ("p1", pa.int64())])
_RUNS_DDL = "ah long, dg long, rid long, p0 long, p1 long"


class Rolling:
    """64-bit hashes of any substrings of a chunk."""

    def __init__(self, most: int = 4 * _CHUNK) -> None:
        self.most, self.up, self.down = most, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def load(self, a: np.ndarray) -> None:
        n = len(a) + 1
        if len(self.up) < n:
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(max(n, _CHUNK + 4096), base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * self.up[: len(a)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all runs of w neighbours."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def _chunks(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Bytes of some texts, where each begins in them, which texts they are, and the offset of the first in its text."""
    i = 0
    while i < len(texts):
        if len(texts[i]) > _CHUNK:
            a = np.frombuffer(texts[i], np.uint8)
            for at in range(0, len(a) - length + 1, _CHUNK):
                yield a[at : at + _CHUNK + length - 1], np.array([0]), np.array([i]), at
            i += 1
            continue
        own, size = [], 0
        while i < len(texts) and len(texts[i]) <= _CHUNK and (not own or size + len(texts[i]) <= _CHUNK):
            if len(texts[i]) >= length:
                own.append(i)
                size += len(texts[i])
            i += 1
        if own:
            sizes = np.array([len(texts[j]) for j in own])
            yield np.frombuffer(b"".join(texts[j] for j in own), np.uint8), np.cumsum(sizes) - sizes, np.array(own), 0


def _runs(length: int, k: int):
    """For each text the runs of windows with one anchor: the anchor's hash, the whole run's, its first and last window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Rolling()
        for batch in batches:
            texts = [t or b"" for t in plain_bytes(batch.column("text"))]
            rids = batch.column("rid").to_numpy()
            for a, begins, own, offset in _chunks(texts, length):
                n = len(a)
                h.load(a)
                at = np.arange(n - k + 1)
                grams = mix(h.of(at, at + k))
                keys = grams >> _POSITION << _POSITION | at.astype(np.uint64)
                anchor = (_least(keys, length - k + 1) & np.uint64((1 << 22) - 1)).astype(np.int64)
                starts = np.arange(n - length + 1)
                text = np.searchsorted(begins, starts, side="right") - 1
                whole = starts + length <= np.r_[begins[1:], n][text]
                starts, text, anchor = starts[whole], text[whole], anchor[whole]
                if not len(starts):
                    continue
                first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
                last = np.r_[first[1:], len(starts)] - 1
                p0, p1, at = starts[first], starts[last], anchor[first]
                whole_run = mix(mix(h.of(p0, p1 + length) + (p1 - p0).astype(np.uint64)) + (at - p0).astype(np.uint64))
                of = text[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (grams[at].view(np.int64), whole_run.view(np.int64), rids[own[of]], p0 - begins[of] + offset, p1 - begins[of] + offset)], schema=_RUNS
                )

    return run


_REPEATED, _OPEN = 0, 1


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over runs in the order of their anchor and digest: those that occur twice are repeated; those that share only
    their anchor stay open, and so does one of each repeated kind, for them to be compared with.

    The first and the last anchor of a batch may have more runs outside it, so what is single among them stays open.
    """
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        ah, dg = batch.column("ah").to_numpy(), batch.column("dg").to_numpy()
        new_a = np.r_[True, ah[1:] != ah[:-1]]
        new_d = new_a | np.r_[True, dg[1:] != dg[:-1]]
        a_of, d_of = np.cumsum(new_a) - 1, np.cumsum(new_d) - 1
        rows, same = np.bincount(a_of)[a_of], np.bincount(d_of)[d_of]
        kinds = np.bincount(a_of[new_d])[a_of]
        edge = (a_of == 0) | (a_of == a_of[-1])
        repeated = same > 1
        opened = np.where(repeated, new_d & ((kinds > 1) | edge), (rows > 1) | edge)
        for kind, which in ((_REPEATED, repeated), (_OPEN, opened)):
            if which.any():
                part = batch.filter(pa.array(which))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int8)), *part.columns[2:]], names=["kind", *part.schema.names[2:]])


def _pieces(length: int, k: int):
    """The bytes of open runs, and where in them the anchor is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Rolling()
        for batch in batches:
            for rid, text, spans in zip(batch.column("rid").to_pylist(), plain_bytes(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                data = [text[s["p0"] : s["p1"] + length] for s in spans]
                anchors = []
                for piece in data:
                    h.load(np.frombuffer(piece, np.uint8))
                    at = np.arange(len(piece) - k + 1)
                    # a run's anchor lies in all of its windows: from its last window's start to its first window's end
                    inside = at[len(piece) - length : length - k + 1]
                    keys = mix(h.of(inside, inside + k)) >> _POSITION
                    anchors.append(int(inside[np.argmin(keys)]))
                starts = [s["p0"] for s in spans]
                yield pa.RecordBatch.from_arrays([pa.array([rid] * len(data), pa.int64()), pa.array(starts, pa.int64()), pa.array(anchors, pa.int64()), pa.array(data, pa.binary())], names=["rid", "start", "anchor", "piece"])

    return run


def _short_runs(length: int):
    """Open runs in steps counted from their anchor: the hash of what all windows of a step share, and of the whole step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Rolling()
        for batch in batches:
            for rid, start, anchor, piece in zip(*(batch.column(c).to_pylist() for c in ("rid", "start", "anchor", "piece")), strict=True):
                h.load(np.frombuffer(piece, np.uint8))
                step = (anchor - np.arange(len(piece) - length + 1)) // STEP
                first = np.flatnonzero(np.r_[True, step[1:] != step[:-1]])
                last = np.r_[first[1:], len(step)] - 1
                shared = anchor - STEP * step[first]  # the last start that a window of this step can have
                common = mix(mix(h.of(shared, shared - STEP + 1 + length)) + (anchor - shared).astype(np.uint64))
                whole = mix(mix(h.of(first, last + length) + (last - first).astype(np.uint64)) + (anchor - first).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(common.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(np.full(len(first), rid)), pa.array(first + start), pa.array(last + start), pa.array(np.full(len(first), start))], names=["ah", "dg", "rid", "p0", "p1", "start"])

    return run


def _windows(length: int):
    """The single windows of open short runs: two hashes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Rolling()
        half = length // 2
        for batch in batches:
            for rid, start, piece, p0, p1 in zip(*(batch.column(c).to_pylist() for c in ("rid", "start", "piece", "p0", "p1")), strict=True):
                a = np.frombuffer(piece, np.uint8)[p0 - start : p1 - start + length]
                h.load(a)
                at = np.arange(p1 - p0 + 1)
                first = mix(h.of(at, at + length))
                second = mix(mix(h.of(at, at + half)) + h.of(at + half, at + length))
                m = len(at)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1), pa.int32()), pa.array(at + p0, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), pa.array(np.full(m, rid)), pa.array(np.zeros(m, np.int64)), lists], schema=_LINES)

    return run


def _gathered(source, rows: int = 10_000):
    """Batches of about so many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in source(batches):
            held.append(b)
            n += len(b)
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def _remove(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, shas, kept_texts = [], [], [], [], []
            for text, own in zip(plain_bytes(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                data = np.frombuffer(text or b"", np.uint8)
                gone = np.zeros(len(data), bool)
                if own:
                    step = np.zeros(len(data) + 1, np.int32)
                    np.add.at(step, [s["p0"] for s in own], 1)
                    np.add.at(step, [s["p1"] + length for s in own], -1)
                    gone = np.cumsum(step[:-1]) > 0
                kept = data[~gone].tobytes()
                sizes.append(len(data))
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(gone) else 0)
                shas.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept)
            columns = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(shas, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(kept_texts, pa.binary())], [*names, "kept_bytes"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def remove_repeats(docs: DataFrame, length: int = 200, with_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_bytes).

    Texts are UTF-8 bytes, null is empty; matches don't cross documents, and a match within one document counts.
    Rows are documents of their own even if they repeat a doc_id, so an exact copy of a row loses all that a window
    covers. Texts shorter than length keep everything. Other columns are ignored.
    """
    spark = docs.sparkSession
    k = max(1, length * 8 // 25)
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), "text").alias("rid"))
    runs = cut(rows.select("rid", "text").mapInArrow(_gathered(_runs(length, k)), _RUNS_DDL), "runs")
    found = _compared(runs)
    drop_cut(runs)
    release(spark)
    opened = found.where(F.col("kind") == _OPEN).select("rid", "p0", "p1").distinct().groupBy("rid").agg(F.collect_list(F.struct("p0", "p1")).alias("spans"))
    pieces = rows.select("rid", "text").join(opened, "rid")
    pieces = cut(pieces.select("rid", "text", "spans").mapInArrow(_gathered(_pieces(length, k)), "rid long, start long, anchor long, piece binary"), "pieces")
    release(spark)
    short = _compared(cut(pieces.mapInArrow(_gathered(_short_runs(length)), f"{_RUNS_DDL}, start long"), "short"))
    left = short.where(F.col("kind") == _OPEN).select("rid", "start", "p0", "p1").distinct()
    windows = pieces.select("rid", "start", "piece").join(left, ["rid", "start"]).mapInArrow(_gathered(_windows(length)), _LINES_DDL)
    windows = cut(windows.select("h1", "h2", "doc_id", "th", "pos"), "windows")
    again = settled_rows(windows, 2, distinct=False).select(F.col("doc_id").alias("rid"), F.col("pos")[0].cast("long").alias("p0"))
    release(spark)
    whole = found.unionByName(short.drop("start")).where(F.col("kind") == _REPEATED).select("rid", "p0", "p1")
    gone = whole.union(again.select("rid", "p0", F.col("p0").alias("p1"))).groupBy("rid").agg(F.collect_list(F.struct("p0", "p1")).alias("spans"))
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_text
    return rows.join(gone, "rid", "left").select("doc_id", "text", "spans").mapInArrow(_remove(length, with_text), ddl)


def _compared(runs: DataFrame) -> DataFrame:
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = runs.repartitionByRange(parts, "ah", "dg", "rid", "p0").sortWithinPartitions("ah", "dg")
    kept = ", ".join(f"{c} long" for c in runs.columns[2:])
    return cut(ordered.mapInArrow(_compare, f"kind byte, {kept}"), "compared")
