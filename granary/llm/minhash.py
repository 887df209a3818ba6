"""MinHash near-dedup with b-bit signatures: bands propose, bit counts sift, full shingle sets decide.

No step gives pairs of documents as rows. Buckets give stars around a hub, blocks of members give a spanning forest of
what they found, so every table has rows in proportion to the documents and to the buckets they share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, few_rows, join_skewed, mix, plain_bytes, shingles_of_words, words_of_texts
from .components import components

HASHES = 128
#: Low bits kept of each minimum: 4, so a signature is 8 longs of 16 lanes.
BITS = 4
_LANES = "1229782938247303441"  # 0x1111111111111111
#: Members on each side of a block, which one task compares, and the shingles that they may hold together.
BLOCK, BLOCK_SHINGLES = 512, 4_000_000
#: Shingles in a row of a set on its way to a block: rows stay small, however long a text is.
PIECE = 512
_ROW = "doc_id long, n_shingles long, k1 long, k2 long, sig array<long>, bands array<long>"


def band_rows(threshold: float) -> int:
    """Minima in a band: as many as leave a pair at the threshold unseen in one case in a million at most."""
    return max(r for r in range(1, 9) if r == 1 or (1 - threshold**r) ** (HASHES // r) <= 1e-6)


def signature(shingles: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The packed low bits of the minima as 8 longs, and the bands' 64-bit keys from the whole minima."""
    rng = np.random.default_rng(20240607)
    a = (rng.integers(0, 1 << 31, HASHES, np.uint32) << np.uint32(1)) | np.uint32(1)
    b = rng.integers(0, 1 << 32, HASHES, np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 4096):
        np.minimum(low, (a[:, None] * x[None, at : at + 4096] + b[:, None]).min(axis=1), out=low)
    wide = mix(low.astype(np.uint64) + (np.arange(HASHES, dtype=np.uint64) << np.uint64(32)))
    lanes = (wide & np.uint64((1 << BITS) - 1)).reshape(-1, 64 // BITS)
    sig = (lanes << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)
    n = HASHES // rows
    keys = np.arange(n, dtype=np.uint64)
    for j in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + wide[j : n * rows : rows])
    return sig.view(np.int64), keys.view(np.int64)


def _sketch(k: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            sizes, keys, sigs, bands = [], [], [], []
            for words in words_of_texts(plain_bytes(batch.column("text"))):
                s = shingles_of_words(words, k)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                sig, band = signature(s, rows) if len(s) else (None, None)
                sigs.append(sig)
                bands.append(band)
            pair = np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(-1, 2)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(sigs, longs), pa.array(bands, longs)],
                names=["doc_id", "n_shingles", "k1", "k2", "sig", "bands"],
            )

    return run


def estimate(a: str, b: str) -> Column:
    """Similarity from two packed signatures: lanes that agree, less those that agree by chance (2**-BITS of the rest)."""
    fold = "x -> shiftrightunsigned(x, 2) | x"
    fold2 = "x -> (shiftrightunsigned(x, 1) | x) & " + _LANES
    differ = f"aggregate(transform(transform(zip_with({a}, {b}, (x, y) -> x ^ y), {fold}), {fold2}), 0, (n, x) -> n + bit_count(x))"
    chance = 2.0**-BITS
    return (F.lit(1.0) - F.expr(differ) / HASHES - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    """Five standard deviations below the threshold: pairs under it aren't looked at."""
    agree = threshold + (1 - threshold) * 2.0**-BITS
    return threshold - 5 * (agree * (1 - agree) / HASHES) ** 0.5 / (1 - 2.0**-BITS)


def _runs_of(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(np.r_[True, new])


def _whole_runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Sorted rows in tables that hold whole runs of equal keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        last = [batch.column(c)[len(batch) - 1].as_py() for c in keys]
        same = np.logical_and.reduce([batch.column(c).to_numpy() == x for c, x in zip(keys, last, strict=True)])
        begin = int(np.argmax(same))  # the run that is open starts here
        if begin:
            yield pa.Table.from_batches([*held, batch.slice(0, begin)])
            held = []
        elif held and [held[-1].column(c)[len(held[-1]) - 1].as_py() for c in keys] != last:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def _forest(nodes: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links between rows x and y of nodes: each node that has one, and the least node that it reaches."""
    label = nodes.copy()
    while len(x):
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        if (before == label).all():
            break
    some = label != nodes
    return nodes[some], label[some]


# --- buckets ----------------------------------------------------------------------------------------------------------

_STAR_DDL = "kind byte, key long, a long, b long"
_PAIR, _EDGE = 0, 1


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (key, doc_id) in order: the first document of a key's run is its hub, and every other one pairs with it.

    A key may go on in the next partition, so the hubs of a partition's first and last run are given as edges.
    """
    schema = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def out(kind: int, key, a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(key), pa.array(a), pa.array(b)], schema=schema)

    first = last = None  # the first run's and the open run's key and hub
    for batch in batches:
        if not len(batch):
            continue
        key, doc = batch.column("key").to_numpy(), batch.column("doc_id").to_numpy()
        starts = _runs_of(key)
        hubs = doc[starts].copy()
        if last is not None and last[0] == key[0]:
            hubs[0] = last[1]
        hub = np.repeat(hubs, np.diff(np.r_[starts, len(key)]))
        first = first or (int(key[0]), int(hubs[0]))
        last = (int(key[starts[-1]]), int(hubs[-1]))
        other = hub != doc
        if other.any():
            yield out(_PAIR, key[other], hub[other], doc[other])
    for edge in {first, last} - {None}:
        yield out(_EDGE, np.array([edge[0]]), np.array([edge[1]]), np.array([edge[1]]))


def star_pairs(members: DataFrame, tables: Scratch) -> DataFrame:
    """(a, b) distinct: a hub of a bucket of members (key, doc_id), and another member; a bucket's hubs are paired too.

    Buckets are ranges of a sort, so one that fills several partitions is split, with a hub in each.
    """
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = tables.cut(members.repartitionByRange(parts, "key", "doc_id").sortWithinPartitions("key", "doc_id").mapInArrow(_stars, _STAR_DDL), "stars")
    edges = found.where(F.col("kind") == _EDGE)  # two rows for each partition at most
    joint = edges.groupBy("key").agg(F.min("a").alias("least"))
    joint = edges.join(F.broadcast(joint), "key").where("a <> least").select(F.col("least").alias("a"), F.col("a").alias("b"))
    return found.where(F.col("kind") == _PAIR).select("a", "b").union(joint).distinct()


# --- blocks of signatures: who may be similar to whom -----------------------------------------------------------------


def _suspects(least: float, percent: int):
    """Over blocks (key, i, j) of buckets: links between members of different components whose estimate is high enough."""
    lanes, most = np.uint64(int(_LANES)), (1 - 2.0**-BITS) * (1 - least) * HASHES

    def links(ids, comp, n, part, sig, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        left = np.flatnonzero(part == i)
        right = left if i == j else np.flatnonzero(part == j)
        x, y = np.repeat(left, len(right)), np.tile(right, len(left))
        some = (comp[x] != comp[y]) & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent)
        if i == j:
            some &= x < y
        x, y = x[some], y[some]
        d = sig[x] ^ sig[y]
        d |= d >> np.uint64(2)
        d |= d >> np.uint64(1)
        near = np.bitwise_count(d & lanes).sum(axis=1) <= most
        return _forest(ids, x[near], y[near])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_runs(batches, ("key", "i", "j")):
            key, i, j, part, ids, comp, n = (t.column(c).to_numpy() for c in ("key", "i", "j", "part", "doc_id", "comp", "n_shingles"))
            sig = t.column("sig").combine_chunks().flatten().to_numpy().reshape(len(t), -1).view(np.uint64)
            starts = _runs_of(key, i, j)
            found = [links(ids[s:e], comp[s:e], n[s:e], part[s:e], sig[s:e], i[s], j[s]) for s, e in zip(starts, [*starts[1:], len(key)], strict=True)]
            both = np.unique(np.stack([np.concatenate([f[k] for f in found]) for k in (0, 1)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    return run


# --- blocks of whole sets: who is similar to whom ---------------------------------------------------------------------

_PIECES = pa.schema([("doc_id", pa.int64()), ("v", pa.int64()), ("at", pa.int32()), ("piece", pa.binary())])
_PIECES_DDL = "doc_id long, v long, at int, piece binary"


def _set_pieces(k: int):
    """The shingle set of each text in rows of PIECE shingles; v tells texts of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            ids, texts = batch.column("doc_id").to_numpy(), plain_bytes(batch.column("text"))
            for at in range(0, len(texts), 256):
                own, versions, places, pieces = [], [], [], []
                for doc_id, words in zip(ids[at : at + 256], words_of_texts(texts[at : at + 256]), strict=True):
                    s = shingles_of_words(words, k)
                    v = int(np.bitwise_xor.reduce(mix(s + np.uint64(len(s)))).view(np.int64)) if len(s) else 0
                    for p, begin in enumerate(range(0, len(s), PIECE)):
                        own.append(doc_id), versions.append(v), places.append(p), pieces.append(s[begin : begin + PIECE].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((own, versions, places, pieces), _PIECES.types, strict=True)], schema=_PIECES)

    return run


def _intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles each set of left has in common with each of right: products of 0/1 matrices, a slice at a time."""
    same = np.zeros((len(left), len(right)), np.int64)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = _runs_of(values)
    often = np.diff(np.r_[starts, len(values)]) > 1
    column = np.repeat(np.cumsum(often) - 1, np.diff(np.r_[starts, len(values)]))
    keep = np.repeat(often, np.diff(np.r_[starts, len(values)]))
    column, owner = column[keep], owner[keep]
    total = int(often.sum())
    width = min(4096, total)
    for at in range(0, total, width or 1):
        s, e = np.searchsorted(column, [at, at + width])
        held = np.zeros((len(sets), width), np.float32)
        held[owner[s:e], column[s:e] - at] = 1
        same += (held[left] @ held[right].T).astype(np.int64)
    return same


def _confirmed(percent: int):
    """Over blocks (key, i, j) with the pieces of their members' sets: links between members of parts i and j of
    different components, as a spanning forest."""

    def links(ids, comp, part, sets: list[np.ndarray], i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        if not len(left) or not len(right):
            return ids[:0], ids[:0]
        n = np.array([len(s) for s in sets], np.int64)
        same = _intersections(sets, left, right)
        near = (same > 0) & (100 * same >= percent * (n[left][:, None] + n[right] - same)) & (comp[left][:, None] != comp[right])
        x, y = np.nonzero(near)
        return _forest(ids, left[x], right[y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_runs(batches, ("key", "i", "j")):
            key, i, j, part, ids, comp, v = (t.column(c).to_numpy() for c in ("key", "i", "j", "part", "doc_id", "comp", "v"))
            pieces = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("piece").combine_chunks()]
            blocks, members = _runs_of(key, i, j), _runs_of(key, i, j, ids, v)
            ends = [*members[1:], len(key)]
            sets = [np.concatenate(pieces[s:e]) if e - s > 1 else pieces[s] for s, e in zip(members, ends, strict=True)]
            cuts = [*np.searchsorted(members, blocks), len(members)]
            found = []
            for b, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                own = members[s:e]
                found.append(links(ids[own], comp[own], part[own], sets[s:e], i[blocks[b]], j[blocks[b]]))
            both = np.unique(np.stack([np.concatenate([f[k] for f in found]) for k in (0, 1)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    return run


def confirmed(members: DataFrame, texts: DataFrame, k: int, percent: int, tables: Scratch) -> DataFrame:
    """(a, b): a spanning forest of the links in blocks (key, i, j) of members (doc_id, comp, part), by their whole sets.

    A set is shipped once to each block that it is a member of, in pieces.
    """
    members = tables.cut(members.distinct(), "members")  # texts that share a doc_id may have met a hub several times
    nodes = members.select("doc_id").distinct()
    pieces = texts.join(nodes, "doc_id", "left_semi").mapInArrow(_set_pieces(k), _PIECES_DDL)
    pieces = tables.cut(pieces.dropDuplicates(["doc_id", "v", "at"]), "pieces")
    rows = join_skewed(members, pieces, "doc_id").select("key", "i", "j", "part", "doc_id", "comp", "v", "at", "piece")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "doc_id", "v", "at")
    return tables.cut(rows.mapInArrow(_confirmed(percent), "a long, b long"), "confirmed")


def _parts(n: str, shingles: str):
    """Into how many parts a group goes: so that two of them fill a block at most."""
    return F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(shingles) / (BLOCK_SHINGLES / 2)), F.lit(1)).cast("int")


def _blocks(members: DataFrame) -> DataFrame:
    """members (doc_id, parts and more) with part, i and j: every part meets every other, and itself."""
    own = members.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return own.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("other", "parts")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept (doc_id = component_id).

    Documents are linked when 100 * |A and B| >= percent * |A or B| over their distinct k-word shingles. Equal sets
    are one class and are represented by their least doc_id.

    Within each band's bucket every class is first held against the bucket's hub, and links found so are settled.
    Buckets that still hold several components are compared within, by signature alone and in blocks; what may be
    similar there is gathered into groups, and the members of a group meet in blocks once more, now with their whole
    sets. So a bucket of similar texts costs a comparison each, texts that several buckets share meet once, and no link
    between components is lost.

    Texts without words (null and empty too) have no shingles and stand alone. Each of several rows with one doc_id is
    placed by its own text, and what any of their texts links with is linked through that doc_id; a null doc_id has a
    null component and is kept. Other columns are ignored.
    """
    with Scratch(docs.sparkSession) as tables:
        return cut(_near_duplicates(docs.select("doc_id", "text"), k, percent, tables), "near-duplicates")


def _near_duplicates(texts: DataFrame, k: int, percent: int, tables: Scratch) -> DataFrame:
    threshold = percent / 100
    least = least_estimate(threshold)
    sketch = tables.cut(texts.mapInArrow(_sketch(k, band_rows(threshold)), _ROW), "sketch")
    full = sketch.where("doc_id is not null and n_shingles > 0")
    reps = full.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n_shingles", "sig", "bands")))
    reps = tables.cut(reps, "reps")

    pairs = tables.cut(star_pairs(reps.select(F.explode("bands").alias("key"), "doc_id"), tables), "pairs")
    sized = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    near = _signed(pairs, reps).where(sized & (estimate("sig_a", "sig_b") >= least)).select("a", "b", "n_a", "n_b")
    near = tables.cut(near, "near")
    # a hub is part 0 of its blocks, its members are parts from 1 on
    hubs = near.groupBy("a").agg(F.count("*").alias("n"), F.sum("n_b").alias("shingles")).select("a", _parts("n", "shingles").alias("parts"))
    spokes = join_skewed(near.select("a", "b"), tables.cut(hubs, "hubs"), "a")
    spokes = spokes.select(F.col("a").alias("key"), F.col("b").alias("doc_id"), (F.pmod(F.xxhash64("b"), F.col("parts")) + 1).cast("int").alias("part")).withColumn("j", F.col("part"))
    hubs = hubs.select(F.col("a").alias("key"), F.col("a").alias("doc_id"), F.lit(0).alias("part"), F.explode(F.sequence(F.lit(1), F.col("parts"))).alias("j"))
    stars = hubs.unionByName(spokes).withColumn("i", F.lit(0)).withColumn("comp", F.col("doc_id"))
    links = confirmed(stars, texts, k, percent, tables)
    settled = components(links, keep=tables)

    # buckets that still hold several components; a class that shares no bucket has no pair
    shared = tables.cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "shared")
    placed = reps.join(shared, "doc_id", "left_semi").join(settled.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    placed = tables.cut(placed.select("doc_id", "n_shingles", "sig", "bands", F.coalesce("component_id", "doc_id").alias("comp")), "placed")
    members = placed.select("doc_id", "comp", F.explode("bands").alias("key"))
    several = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    several = tables.cut(several.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "several")
    open_members = tables.cut(_blocks(join_skewed(members.select("key", "doc_id"), several, "key")), "open")
    blocks = join_skewed(open_members, placed.select("doc_id", "comp", "n_shingles", "sig"), "doc_id")
    blocks = blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    suspects = tables.cut(blocks.mapInArrow(_suspects(least, percent), "a long, b long").distinct(), "suspects")

    groups = components(suspects, keep=tables)
    grouped = tables.cut(join_skewed(groups.withColumnRenamed("node", "doc_id"), placed.select("doc_id", "comp", "n_shingles"), "doc_id"), "grouped")
    sizes = tables.cut(grouped.groupBy("component_id").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")).select("component_id", _parts("n", "shingles").alias("parts")), "sizes")
    met = _blocks(join_skewed(grouped.select("component_id", "doc_id", "comp"), sizes, "component_id")).withColumnRenamed("component_id", "key")
    more = confirmed(met, texts, k, percent, tables)
    if not more.isEmpty():
        settled = components(links.union(more), keep=tables)

    of_class = reps.join(settled.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(F.struct("k1", "k2").alias("key"), F.coalesce("component_id", "doc_id").alias("component_id"))
    of_class = tables.cut(of_class, "of_class")
    rows = sketch.select("doc_id", "n_shingles", F.struct("k1", "k2").alias("key"))
    placed_rows = join_skewed(rows.where("doc_id is not null and n_shingles > 0"), of_class, "key").select("doc_id", "n_shingles", "component_id")
    alone = rows.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed_rows.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _signed(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """pairs (a, b) with both signatures."""
    of = lambda side: reps.select(F.col("doc_id").alias(side), F.col("n_shingles").alias("n_" + side), F.col("sig").alias("sig_" + side))
    return join_skewed(join_skewed(pairs, of("b"), "b"), of("a"), "a")
