"""Toxicity: gradient-boosted trees over dense features of the text, calibrated by isotonic regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _CHUNK, _pieces, _power_table, cut, few_rows, mix, plain_bytes

# Insults, threats and second-person words, lower-case letters only.
LEXICON = {
    "insult": "idiot idiots moron morons stupid dumb dumbass fool loser losers clown clowns scum trash garbage pathetic worthless useless disgusting imbecile cretin jerk pig rat vermin filth creep coward liar degenerate parasite freak lunatic psycho".split(),
    "threat": "kill die hurt destroy punch strangle burn hang shoot stab beat".split(),
    "hate": "hate despise loathe detest disgust vile repulsive subhuman inferior".split(),
}
SECOND_PERSON = "you your yours yourself u ur youre vous votre vos tu toi te du dich dir dein deine ihr euch usted ustedes ti tus".split()
# Signs often written for letters.
LEET = dict(zip("01345789@$!+|", "oleastbgasitl", strict=True))

FEATURES = [
    "insult_density", "insult_count", "insult_distinct", "threat_density", "hate_density", "obfuscated_density", "obfuscated_count",
    "second_person_density", "near_second_person", "least_distance", "capitals", "shouted_words", "exclamations", "questions",
    "repeated_marks", "stretched_words", "mixed_words", "digits", "log_words", "mean_word",
    "learned_density", "learned_count", "learned_weight", "stem_density", "stem_count", "stem_weight", "near_learned",
]
#: Bytes of a stem; words of fewer have none.
STEM = 6
#: A learned word or stem occurs in at least LEAST_TOXIC toxic rows and has at least LEAST_ODDS of log odds.
LEAST_TOXIC, LEAST_ODDS = 3, 2.0
#: Words between an insult and a second-person word that count as near.
NEAR = 6


def _tables() -> dict[str, np.ndarray]:
    plain, leet = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
    for c in range(97, 123):
        plain[c] = leet[c] = c
        plain[c - 32] = leet[c - 32] = c
    plain[128:] = leet[128:] = np.arange(128, 256)
    for k, v in LEET.items():
        leet[ord(k)] = ord(v)
    return {"plain": plain, "leet": leet}


def _hashes(a: np.ndarray, word: np.ndarray, n: int, table: np.ndarray, squeeze: bool, stem: int = 0) -> np.ndarray:
    """A hash of each word's kept bytes (0 where none is kept). word: each byte's word, -1 between words.

    stem: only the first so many of them count, and words of fewer get 0.
    """
    x = table[a]
    keep = (x > 0) & (word >= 0)
    at = np.flatnonzero(keep)
    x, w = x[at], word[at]
    if squeeze and len(at):
        other = np.r_[True, (x[1:] != x[:-1]) | (w[1:] != w[:-1])]
        x, w = x[other], w[other]
    size = np.bincount(w, minlength=n)
    begin = np.cumsum(size) - size
    offset = np.arange(len(w)) - begin[w]
    if stem:
        x, w = x[offset < stem], w[offset < stem]
        offset, size = offset[offset < stem], np.minimum(size, stem)
        begin = np.cumsum(size) - size
    powers = _power_table(int(size.max()) if len(size) else 1)
    out = np.zeros(n, np.uint64)
    if len(w):
        full = size > 0
        out[full] = mix(np.add.reduceat(x.astype(np.uint64) * powers[offset], begin[full]) + size[full].astype(np.uint64))
        if stem:
            out[size < stem] = 0
            out ^= np.uint64(STEM) * (out > 0)
    return out


def _known(words: list[str], table: np.ndarray, squeeze: bool) -> np.ndarray:
    a = np.frombuffer(" ".join(words).encode(), np.uint8)
    word, n = _word_index(a)[:2]
    return np.unique(_hashes(a, word, n, table, squeeze))


def _word_index(a: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    inside = ~((a == 32) | ((a >= 9) & (a <= 13)))
    begins = inside & np.r_[True, ~inside[:-1]]
    word = np.cumsum(begins) - 1
    n = int(begins.sum())
    return np.where(inside, word, -1), n, np.flatnonzero(begins)


def _is_in(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return known[at] == h


class _Lookup:
    def __init__(self) -> None:
        self.tables = _tables()
        plain, leet = self.tables["plain"], self.tables["leet"]
        self.kinds = {k: _known(v, plain, False) for k, v in LEXICON.items()}
        self.you = _known(SECOND_PERSON, plain, False)
        self.squeezed = _known(sum(LEXICON.values(), []), leet, True)


Lexicon = tuple[np.ndarray, np.ndarray]  # sorted hashes of words and stems, their weights


def _weights(h: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    if not len(lexicon[0]):
        return np.zeros(len(h))
    at = np.minimum(np.searchsorted(lexicon[0], h), len(lexicon[0]) - 1)
    return np.where(lexicon[0][at] == h, lexicon[1][at], 0.0)


def _counts(a: np.ndarray, look: _Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word: its start, its length, its flags (columns), its plain hash, its stem's hash."""
    word, n, starts = _word_index(a)
    length = np.bincount(word[word >= 0], minlength=n)
    plain = _hashes(a, word, n, look.tables["plain"], False)
    loose = _hashes(a, word, n, look.tables["leet"], True)
    kinds = [_is_in(plain, look.kinds[k]) & (plain > 0) for k in ("insult", "threat", "hate")]
    bad = kinds[0] | kinds[1] | kinds[2]
    upper = (a >= 65) & (a <= 90)
    letter = upper | ((a >= 97) & (a <= 122)) | (a >= 128)
    digit = (a >= 48) & (a <= 57)
    mark = ~letter & ~digit & (word >= 0)
    per = lambda m: np.bincount(word[m & (word >= 0)], minlength=n)
    ups, letters, digits, marks = per(upper), per(letter), per(digit), per(mark)
    same = np.r_[False, a[1:] == a[:-1]]
    triple = same & np.r_[False, same[:-1]]
    flags = np.stack([
        *kinds, _is_in(loose, look.squeezed) & ~bad & (loose > 0), _is_in(plain, look.you) & (plain > 0),
        ups, letters, (ups >= 2) & (ups == letters), per(a == 33), per(a == 63), per(mark & same), per(triple & letter) > 0,
        (letters > 0) & ((digits > 0) | (marks > 2)), digits,
    ], axis=1).astype(np.float64)
    return starts, length, flags, plain, _hashes(a, word, n, look.tables["plain"], False, STEM)


def _of_doc(length: np.ndarray, flags: np.ndarray, plain: np.ndarray, stems: np.ndarray, lexicon: Lexicon) -> list[float]:
    n = len(length)
    if not n:
        return [0.0] * 9 + [50.0] + [0.0] * (len(FEATURES) - 10)
    learned, stemmed = _weights(plain, lexicon), _weights(stems, lexicon)
    total = flags.sum(axis=0)
    chars = float(length.sum())
    bad = np.flatnonzero((flags[:, 0] + flags[:, 1] + flags[:, 2] + flags[:, 3]) > 0)
    you = np.flatnonzero(flags[:, 4])
    least, near = 50.0, 0
    if len(bad) and len(you):
        at = np.searchsorted(you, bad)
        gap = np.minimum(np.abs(you[np.minimum(at, len(you) - 1)] - bad), np.abs(you[np.maximum(at - 1, 0)] - bad))
        least, near = min(50.0, float(gap.min())), int((gap <= NEAR).sum())
    marked = np.flatnonzero(learned)
    close = 0
    if len(marked) and len(you):
        at = np.searchsorted(you, marked)
        close = int((np.minimum(np.abs(you[np.minimum(at, len(you) - 1)] - marked), np.abs(you[np.maximum(at - 1, 0)] - marked)) <= NEAR).sum())
    insults = plain[flags[:, 0] > 0]
    return [
        100 * total[0] / n, total[0], float(len(np.unique(insults))) if len(insults) else 0.0, 100 * total[1] / n, 100 * total[2] / n,
        100 * total[3] / n, total[3], 100 * total[4] / n, float(near), least, total[5] / max(1.0, total[6]), total[7] / n,
        total[8] / n, total[9] / n, total[10] / n, total[11] / n, total[12] / n, total[13] / chars, float(np.log1p(n)), chars / n,
        100 * len(marked) / n, float(len(marked)), float(learned.sum()), 100 * np.count_nonzero(stemmed) / n, float(np.count_nonzero(stemmed)), float(stemmed.sum()), float(close),
    ]


def words_of(texts: list[bytes | None], look: _Lookup) -> Iterator[tuple[np.ndarray, ...]]:
    """For each whole text what _counts says of its words, without their starts."""
    i = 0
    while i < len(texts):
        group, size = [], 0
        while i < len(texts) and (not group or size + len(texts[i] or b"") <= _CHUNK):
            group.append(texts[i] or b"")
            size += len(group[-1]) + 1
            i += 1
        if len(group) == 1 and size > 2 * _CHUNK:
            parts = [_counts(np.frombuffer(p, np.uint8), look) for p in _pieces(group[0])]
            yield tuple(np.concatenate([p[k] for p in parts]) for k in (1, 2, 3, 4))
            continue
        a = np.frombuffer(b"\n".join(group), np.uint8)
        starts, *found = _counts(a, look)
        cuts = np.searchsorted(starts, np.cumsum([0, *(len(g) + 1 for g in group)]))
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            yield tuple(x[s:e] for x in found)


def features_of(texts: list[bytes | None], look: _Lookup, lexicons: list[Lexicon]) -> np.ndarray:
    """A row of FEATURES for each text, by the lexicon beside it; null and empty texts have no words and so zeros."""
    out = [_of_doc(*found, lexicon) for found, lexicon in zip(words_of(texts, look), lexicons, strict=True)]
    return np.array(out, np.float64).reshape(len(texts), len(FEATURES))


# --- trees ------------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """Trees as arrays (feature, threshold, left, right, value), and the calibration curve."""

    base: float = 0.0
    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    knots: np.ndarray | None = None
    levels: np.ndarray | None = None
    lexicon: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0))

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, left, right, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(8):
                inner = feature[node] >= 0
                if not inner.any():
                    break
                goes = x[rows, np.maximum(feature[node], 0)] <= cut[node]
                node = np.where(inner, np.where(goes, left[node], right[node]), node)
            out += value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated, from 0 to 1; a thousandth of the score keeps the order of the trees within a level."""
        raw = self.raw(x)
        p = 1 / (1 + np.exp(-raw))
        return p if self.knots is None else 0.999 * np.interp(raw, self.knots, self.levels) + 0.001 * p


def _tree(bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: float, rate: float) -> tuple[np.ndarray, ...]:
    feature, cut, left, right, value = [], [], [], [], []
    n_bins = 64

    def grow(rows: np.ndarray, level: int) -> int:
        me = len(feature)
        gs, hs = g[rows].sum(), h[rows].sum()
        for at, x in ((feature, -1), (cut, 0.0), (left, 0), (right, 0), (value, -rate * gs / (hs + 1.0))):
            at.append(x)
        best = (1e-6, -1, -1)
        if level < depth and hs >= 2 * least:
            for f in range(bins.shape[1]):
                b = bins[rows, f]
                gl = np.cumsum(np.bincount(b, g[rows], n_bins))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], n_bins))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(hl < least) | (hs - hl < least)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0] and k < len(edges[f]):
                    best = (gain[k], f, k)
        if best[1] >= 0:
            goes = bins[rows, best[1]] <= best[2]
            feature[me], cut[me] = best[1], edges[best[1]][best[2]]
            left[me], right[me] = grow(rows[goes], level + 1), grow(rows[~goes], level + 1)
        return me

    grow(np.arange(len(g)), 0)
    return np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(value)


def _isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; a knot at the mean of each pool, each level drawn a little to the mean."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []
    for x, t in zip(raw[order], y[order], strict=True):
        pools.append([t, 1.0, x])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, n, m = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2] + m]
    mean = y.mean()
    knots = np.array([m / n for _, n, m in pools])
    levels = np.maximum.accumulate(np.array([(s + mean) / (n + 1) for s, n, _ in pools]))
    return knots, levels


def fit(x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15) -> Model:
    """Logistic boosting on the rows that calibrate doesn't mark, isotonic calibration on those that it marks.

    Without both labels in the rows to learn from, every text gets their mean (0 where there are none).
    """
    own, late = ~calibrate, calibrate
    if len({*y[own]}) < 2:
        p = float(np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4))
        return Model(base=float(np.log(p / (1 - p))))
    edges = [np.unique(np.quantile(x[own, f], np.linspace(0, 1, 64)[1:-1])) for f in range(x.shape[1])]
    edges = [np.unique(np.r_[e, x[own, f].min() + 1e-9])[:63] for f, e in enumerate(edges)]
    bins = np.stack([np.searchsorted(e, x[own, f], side="left") for f, e in enumerate(edges)], axis=1)
    t = y[own].astype(np.float64)
    model = Model(base=float(np.log(t.mean() / (1 - t.mean()))))
    raw = np.full(len(t), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        tree = _tree(bins, edges, p - t, p * (1 - p), depth, 2.0, rate)
        model.trees.append(tree)
        raw += Model(0.0, [tree]).raw(x[own])
    if len({*y[late]}) == 2:
        model.knots, model.levels = _isotonic(model.raw(x[late]), y[late].astype(np.float64))
    return model


# --- Spark ------------------------------------------------------------------------------------------------------------


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; rows of fold 0 are held out."""
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 5


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    look = _Lookup()
    for batch in few_rows(batches):
        found = [np.unique(np.r_[plain, stems]).view(np.int64) for _, _, plain, stems in words_of(plain_bytes(batch.column("text")), look)]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("fold"), pa.array(found, pa.list_(pa.int64()))], names=["toxic", "fold", "tokens"])


def _learned(rows: DataFrame) -> dict[int, Lexicon]:
    """The lexicon learned from all of rows (under 0), and for each fold the one learned from the other folds."""
    tokens = rows.mapInArrow(_token_rows, "toxic int, fold int, tokens array<long>")
    sizes = {r["fold"]: (r["t"], r["n"]) for r in rows.groupBy("fold").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).collect()}
    folds = range(1, 5)
    each = [F.sum(F.when(F.col("fold") == f, x)).alias(f"{name}{f}") for f in folds for name, x in (("t", F.col("toxic")), ("n", F.lit(1)))]
    counts = tokens.select("toxic", "fold", F.explode("tokens").alias("token")).where("token <> 0").groupBy("token").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"), *each)
    toxic, total = (sum(x[i] for x in sizes.values()) for i in (0, 1))
    # rows is bounded, and so is what is common enough in its toxic rows
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (total - toxic + 1))
    found = counts.where((F.col("t") >= LEAST_TOXIC) & (odds >= LEAST_ODDS / 2)).toPandas().fillna(0)
    out = {}
    for f in (0, *folds):
        t, n = (found[c] - (found[f"{c}{f}"] if f else 0) for c in "tn")
        nt, nn = toxic - sizes.get(f, (0, 0))[0] * bool(f), total - sizes.get(f, (0, 0))[1] * bool(f)
        weight = np.log((t + 0.5) / (nt + 1)) - np.log((n - t + 0.5) / (nn - nt + 1))
        keep = (t >= LEAST_TOXIC) & (weight >= LEAST_ODDS)
        hashes = found["token"][keep].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(hashes)
        out[f] = (hashes[order], weight[keep].to_numpy(np.float64)[order])
    return out


def _feature_rows(lexicons: dict[int, Lexicon]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _Lookup()
        for batch in few_rows(batches):
            x = features_of(plain_bytes(batch.column("text")), look, [lexicons[f] for f in batch.column("fold").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000) -> Model:
    """Learns from at most train_rows labelled documents (those whose id hashes lowest), never from fold 0.

    Besides the fixed lexicon there is one learned from these rows; a row's own features use what the other folds
    taught, so that the trees see it as they will see new texts. A document with several labels counts as toxic if any
    says so; rows that repeat a doc_id are learned from once, by the least of their texts; null labels and null ids are
    left out.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(fold() != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)  # a bounded table, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = cut(rows.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"), fold().cast("int").alias("fold")), "labelled")
    lexicons = _learned(rows)
    found = rows.mapInArrow(_feature_rows(lexicons), "doc_id long, toxic int, x array<double>").toPandas()
    found["key"] = [tuple(v) for v in found["x"]]
    found = found.sort_values(["doc_id", "key"])
    x = np.array([*found["x"]], np.float64).reshape(-1, len(FEATURES))
    order = np.argsort(mix(found["doc_id"].to_numpy(np.int64).view(np.uint64)), kind="stable")
    calibrate = np.zeros(len(x), bool)
    calibrate[order[: len(x) // 4]] = True
    model = fit(x, found["toxic"].to_numpy(np.int64), calibrate)
    model.lexicon = lexicons[0]
    return model


def _scores(model: Model, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _Lookup()
        for batch in few_rows(batches):
            x = features_of(plain_bytes(batch.column("text")), look, [model.lexicon] * len(batch))
            rest = [batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(model.score(x), pa.float64())], names=[*batch.schema.names, name])

    return run


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs and a column of that name, from 0 to 1; null and empty texts are scored as texts without words."""
    from pyspark.sql.types import DoubleType, StructType

    return docs.mapInArrow(_scores(model, name), StructType([*docs.schema.fields]).add(name, DoubleType()))


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. Only doc_id and text of docs are read.

    A null doc_id is not held out, though nothing is learned from it either.
    """
    model = train(docs, labels, train_rows)
    scored = with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
