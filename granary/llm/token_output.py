"""Token ids in a binary file format: frequency ranks in byte-aligned variable-length coding, control bytes apart.

A file is a row of blocks. A block: the magic, four little-endian integers (documents u32, tokens u64, control bytes
u64, data bytes u64), then per document its id (i64), whether that is null (u8) and its length (u64), then the control
bytes (two bits a token: its bytes less one; four tokens a byte, lowest bits first), then the data bytes (the token's
rank, little-endian). The file of ranks lists the token ids (u32) from the most frequent on.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import cut, drop_cut, file_system, fresh_path, qualified

MAGIC = b"GRTOK001"
_HEAD = "<IQQQ"
#: Tokens after which a block is closed.
BLOCK_TOKENS = 2_000_000
#: Pieces whose ids a worker remembers, twice at most, at some 150 bytes each: it keeps them after its task. Bytes of texts whose
#: pieces are looked up together.
PIECES, GROUP = 350_000, 1_000_000

#: What may follow a word's letters as a pre-token of its own (an apostrophe may not).
MARKS = ".,;:!?%*$&#@()"
#: Stands for the ids of a piece that can't be told from its neighbours; its length is that of no ids.
UNSAFE = b"?"
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class Memory:
    """A dict of two generations of about so many entries each; what is asked for again moves to the younger one."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, key: str) -> bytes | None:
        found = self.young.get(key)
        return self.old.get(key) if found is None else found

    def update(self, found: dict[str, bytes]) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young.update(found)


def byte_letters() -> dict[int, int]:
    """The letters for bytes of byte-level tokenizers: printable ones stand for themselves, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts, made of the remembered ids of their pieces.

    Byte-level pre-tokenization never joins what stands before a lone space with what follows it: the space opens a
    new pre-token. So a text is encoded piece by piece, each from such a space on, and most pieces have been met.
    The others of a group of texts go to the tokenizer as one text, whose ids part where a token begins with a space.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.pieces, self.marks = Memory(PIECES), Memory(PIECES // 100)
        space = byte_letters()[32]
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith(chr(space))]] = True

    @classmethod
    def of_worker(cls, path: str) -> Encoder:
        """One per Python worker, which outlives a task."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        held = sys.__dict__.setdefault("_granary_encoders", {})
        if path not in held:
            held[path] = cls(path)
        return held[path]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def _met(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of pieces that aren't remembered among the latest: " " and a text's first piece, or a later one.

        A piece that white space begins or ends is UNSAFE.
        """
        found: dict[str, bytes] = {}
        marked: list[tuple[str, str, str]] = []
        later: dict[str, None] = {}
        get, older = self.pieces.get, self.pieces.old.get
        for piece in pieces:
            known = older(piece)
            if known is not None:
                found[piece] = known
            elif piece[:1] == " ":
                found[piece] = UNSAFE if piece[1:][-1:].isspace() else self._ids(piece[1:]).tobytes()
            elif piece.isalpha():
                later[piece] = None
            elif not piece or piece[0].isspace() or piece[-1].isspace():
                found[piece] = UNSAFE
            else:
                word = piece.rstrip(MARKS)
                if len(word) == len(piece) or not word.isalpha():
                    later[piece] = None
                else:  # letters, then marks: two pre-tokens
                    marked.append((piece, word, piece[len(word) :]))
                    known = get(word)
                    if known is None:
                        later[word] = None
                    else:
                        found[word] = known
        if later:
            ids = self._ids(" " + " ".join(later))
            begins = np.flatnonzero(self.spaced[ids])
            if len(begins) == len(later):  # each piece has one space, its first character
                raw, at = ids.tobytes(), [*(begins * ids.itemsize).tolist(), ids.nbytes]
                found.update(zip(later, [raw[s:e] for s, e in pairwise(at)], strict=True))
            else:
                found.update((p, self._ids(" " + p).tobytes()) for p in later)
        for piece, word, marks in marked:
            known = self.marks.get(marks)
            if known is None:
                known = self._ids(marks).tobytes()
                self.marks.update({marks: known})
            found[piece] = found[word] + known
        self.pieces.update(found)
        return found

    def _by_safe_spaces(self, text: str) -> bytes:
        first, *rest = _SAFE_SPACE.split(text)
        return b"".join([self._ids(first).tobytes(), *(self._ids(" " + p).tobytes() for p in rest)])

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """The ids of each text; texts go in groups of some GROUP bytes."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False))
        out: list[bytes] = []
        while len(out) < len(column):
            begin = len(out)
            done = int(ends[begin - 1]) if begin else 0
            out += self._group(column.slice(begin, max(1, int(np.searchsorted(ends, done + GROUP)) - begin)))
        return out

    def _group(self, texts: pa.Array) -> list[bytes]:
        """Texts are split and their distinct pieces looked up once; the ids are gathered by the pieces' numbers."""
        texts = pc.fill_null(texts, "")
        pieces = pc.split_pattern(texts, " ")
        begins = pieces.offsets.to_numpy()[:-1] - pieces.offsets[0].as_py()
        coded = pieces.flatten().dictionary_encode()
        number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        firsts = [" " + keys[i] for i in number[begins].tolist()]
        number[begins] = len(keys) + np.arange(len(firsts))
        keys += firsts
        ids = [*map(self.pieces.young.get, keys)]
        gaps = [i for i, x in enumerate(ids) if x is None]
        found = self._met({keys[i] for i in gaps}) if gaps else {}
        for i in gaps:
            ids[i] = found[keys[i]]
        size = np.array([*map(len, ids)], np.int64)
        unsafe = size == len(UNSAFE)
        for i in np.flatnonzero(unsafe).tolist():
            ids[i] = b""
        size = np.where(unsafe, 0, size // self.kind.itemsize)
        pool = np.frombuffer(b"".join(ids), self.kind)
        own = size[number]
        place = np.repeat((np.cumsum(size) - size)[number] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        raw = pool[place].tobytes()
        ends = [0, *(np.cumsum(np.add.reduceat(own, begins)) * self.kind.itemsize).tolist()]
        out = [raw[s:e] for s, e in pairwise(ends)]
        if unsafe.any():  # a space next to other white space
            for i in np.flatnonzero(np.logical_or.reduceat(unsafe[number], begins)).tolist():
                out[i] = self._by_safe_spaces(texts[i].as_py())
        return out


def _encode(path: str, end_id: int):
    """ids of each row's text; all columns but the text are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of_worker(path)
        end = np.array([end_id], encoder.kind).tobytes()
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                ids = [x + end for x in encoder.encode(part.column("text"))]
                kept = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(ids, pa.binary())], names=[*kept, "ids"])

    return run


def _count(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            column = batch.column("ids")
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            own = np.bincount(np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind)) if len(column) else counts[:0]
            if len(own) > len(counts):
                own[: len(counts)] += counts
                counts = own
            else:
                counts[: len(own)] += own
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["id", "n"])

    return run


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes."""
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


_SIZES = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)  # by control byte


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks: sizes by table lookup, then a gather per byte."""
    size = _SIZES[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(size) - size
    raw = np.r_[np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = size > k
        if more.any():
            out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_block(out, doc_ids: list[int | None], ids: list[np.ndarray], rank_of: np.ndarray) -> None:
    tokens = np.concatenate(ids)
    control, data = pack(rank_of[tokens])
    out.write(MAGIC + struct.pack(_HEAD, len(doc_ids), len(tokens), len(control), len(data)))
    out.write(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes())
    out.write(np.array([len(x) for x in ids], "<u8").tobytes())
    out.write(control)
    out.write(data)


def read_blocks(source, id_of: np.ndarray) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    """The documents of each block: their ids and their token ids."""
    while head := source.read(len(MAGIC) + struct.calcsize(_HEAD)):
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a block of token ids")
        docs, tokens, n_control, n_data = struct.unpack(_HEAD, head[len(MAGIC) :])
        ids, null, sizes = (np.frombuffer(source.read(docs * w), k) for w, k in ((8, "<i8"), (1, np.uint8), (8, "<u8")))
        all_ids = id_of[unpack(source.read(n_control), source.read(n_data), tokens)]
        cuts = np.cumsum(sizes.astype(np.int64))
        yield [None if z else int(i) for i, z in zip(ids, null, strict=True)], np.split(all_ids, cuts[:-1]) if docs else []


def _write(folder: str, rank_of: np.ndarray, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        # each attempt has its own file; which one counts, the manifest says
        uri = f"{folder}/{part:06d}-{uuid.uuid4().hex}.tok"
        fs, path = file_system(uri)
        docs = tokens = held = 0
        ids: list[int | None] = []
        rows: list[np.ndarray] = []
        out = None
        for batch in batches:
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                if out is None:
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                ids.append(doc_id)
                rows.append(np.frombuffer(x.as_py(), kind))
                held += len(rows[-1])
                if held >= BLOCK_TOKENS:
                    write_block(out, ids, rows, rank_of)
                    docs, tokens, held, ids, rows = docs + len(ids), tokens + held, 0, [], []
        if ids:
            write_block(out, ids, rows, rank_of)
            docs, tokens = docs + len(ids), tokens + held
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "file": uri, "n_docs": docs, "n_tokens": tokens}])

    return run


def file_order(docs: DataFrame) -> list[Column]:
    """Keys by which the rows of docs stand as they were written, if docs are read from files that Spark wrote as the
    partitions of a sorted table: the part's number, its file, the row in it. Of other tables, no keys."""
    try:
        at = docs.metadataColumn("_metadata")
        keys = [F.regexp_extract(at["file_name"], r"part-(\d+)", 1).try_cast("long"), at["file_name"], at["row_index"]]
        docs.select(*keys).schema  # noqa: B018  resolves them
    except AnalysisException:
        return []
    return keys


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, order: Sequence[Column] = ()) -> tuple[DataFrame, str]:
    """Writes the token files of docs; their manifest (part, file, n_docs, n_tokens, start), and the file of ranks.

    Files hold the documents in the order of the columns given, or of doc_id (null first), a range of it each; rows
    that are alike in it stand in the order of a hash of their ids. Frequencies are counted over all documents; they,
    the ranks and a manifest row per file are all that the driver gets. Null and empty texts consist of the end id
    alone. Rows that repeat a doc_id are so many documents.
    """
    spark = docs.sparkSession
    kind = Encoder(tokenizer_path).kind.str
    by = [f"key{i}" for i in range(len(order))]
    rows = docs.select("doc_id", "text", *(c.alias(n) for c, n in zip(order, by, strict=True)))
    schema = StructType([*(f for f in rows.schema.fields if f.name != "text"), StructField("ids", BinaryType())])
    ids = fresh_path(spark, "ids")
    rows.mapInArrow(_encode(tokenizer_path, end_id), schema).write.option("compression", "zstd").parquet(ids)
    ids = spark.read.schema(schema).parquet(ids)
    counts = ids.select("ids").mapInArrow(_count(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # one row per id of the vocabulary
    counts = counts.sort_values(["n", "id"], ascending=[False, True])
    id_of = counts["id"].to_numpy(np.uint32)
    rank_of = np.zeros(int(id_of.max()) + 1 if len(id_of) else 1, np.uint32)
    rank_of[id_of] = np.arange(len(id_of), dtype=np.uint32)
    folder = qualified(spark, fresh_path(spark, "tokens"))
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/ranks", compression=None) as out:
        out.write(id_of.astype("<u4").tobytes())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*(by or ["doc_id"]), F.xxhash64("ids")]
    ordered = ids.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("doc_id", "ids")
    manifest = cut(ordered.mapInArrow(_write(folder, rank_of, kind), "part long, file string, n_docs long, n_tokens long"), "manifest")
    drop_cut(ids)
    files = manifest.orderBy("part").collect()
    starts = np.cumsum([0, *(r["n_tokens"] for r in files)]).tolist()
    rows = [(r["part"], r["file"], r["n_docs"], r["n_tokens"], s) for r, s in zip(files, starts, strict=False)]
    return spark.createDataFrame(rows, "part long, file string, n_docs long, n_tokens long, start long").repartition(max(1, len(rows))), f"{folder}/ranks"


def read_tokens(manifest: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(ranks)
        with fs.open_input_stream(path, compression=None) as f:
            id_of = np.frombuffer(f.read(), "<u4")
        for batch in batches:
            for uri, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                fs, path = file_system(uri)
                with fs.open_input_stream(path, compression=None) as f:
                    for doc_ids, rows in read_blocks(f, id_of):
                        sizes = np.array([len(x) for x in rows], np.int64)
                        crcs = [zlib.crc32(x.astype("<u4").tobytes()) for x in rows]
                        starts = start + np.cumsum(sizes) - sizes
                        start += int(sizes.sum())
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(sizes), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 2, order: Sequence[Column] = ()) -> DataFrame:
    """Encodes every whole text, writes the token files and gives what they hold: see write_tokens and read_tokens."""
    return read_tokens(*write_tokens(docs, tokenizer_path, end_id, order))
