"""Operators on texts against brute force, on a fixture of edge cases and on empty tables."""

import collections
import hashlib
import re
import string
import zlib

import numpy as np
import pytest

from granary.llm import components, decontam, licenses, line_dedup, minhash, mixing, suffix_dedup, token_output
from granary.llm.queries import tokenizer_path

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def same(df, want, columns):
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("least", [1, 3])
def test_line_dedup(docs, rows, no_docs, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    seen = collections.defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            seen[key(line)].add(r[0])
    want = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= least and len(seen[key(x)]) >= 10)]
        want.append((r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    assert any(w[2] for w in want)
    df = line_dedup.dedup_lines(docs, 10, least, with_text=True)
    same(df, want, ["doc_id", "n_lines", "n_dropped", "kept_sha256"])
    for r in df.collect():
        bits = line_dedup.unpack_keep(r.keep_bitmap, r.n_lines)
        assert (r.keep_bitmap is None) == (r.n_dropped == 0)
        assert bits.sum() == r.n_lines - r.n_dropped and hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
    assert line_dedup.dedup_lines(no_docs).count() == 0


def shingle_sets(rows, k):
    out = {}
    for r in rows:
        w = WORDS.findall((r[1] or "").translate(LOWER))
        n = min(k, len(w))
        out[r[0]] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    return out


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, no_docs, k, percent):
    sets = shingle_sets(rows, k)
    known = [i for i in sets if i is not None]
    root = {i: i for i in known}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in known:
        for j in known:
            if i < j and (both := len(sets[i] & sets[j])) and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = []
    for r in rows:
        c = find(r[0]) if r[0] is not None else None
        n = len(shingle_sets([r], k)[r[0]])
        want.append((r[0], n, c, r[0] == c))
    assert sum(not w[3] for w in want) > 5
    same(minhash.near_duplicates(docs, k, percent), want, ["doc_id", "n_shingles", "component_id", "kept"])
    assert minhash.near_duplicates(no_docs).count() == 0


def test_estimate_is_unbiased():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.7, 0.9):
        found = []
        for _ in range(40):
            x = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
            cut = int(len(x) * (1 - share) / (1 + share))
            a, b = x[cut:], np.r_[x[: len(x) - 2 * cut] if False else x[: len(x) - cut], rng.integers(0, 1 << 63, 0).astype(np.uint64)]
            truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            s, t = (minhash.signature(v, 4)[0].view(np.uint64) for v in (a, b))
            lanes = [(s >> np.uint64(4 * i) & np.uint64(15)) == (t >> np.uint64(4 * i) & np.uint64(15)) for i in range(16)]
            found.append((np.sum(lanes) / 128 - 1 / 16) / (15 / 16) - truth)
        assert abs(np.mean(found)) < 0.03


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (30, 30), (None, 4)] + [(100 + i, 101 + i) for i in range(40)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component_id for r in components.components(df).collect()}
    want = {i: 1 for i in (1, 2, 3, 7, 8, 9)} | {20: 20, 21: 20, 30: 30} | {i: 100 for i in range(100, 141)}
    assert got == want


def test_license_scan(docs, rows, no_docs):
    want = []
    for r in rows:
        w = PLAIN.findall((r[1] or "").translate(LOWER))
        places, base, labels, score = [], set(), set(), 0.0
        for t in licenses.templates():
            n = len(t.words)
            for s in range(-n, len(w)):
                hit = [0 <= s + j < len(w) and w[s + j] == t.words[j] for j in range(n)]
                if sum(hit) >= t.needed and all(hit[t.key[0] : t.key[1] + 1]):
                    labels.add(t.label)
                    score = max(score, sum(hit) / n)
                    if t.base:
                        places.append(s)
                        base.add(t.label)
        want.append((r[0], len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
    assert {x[5] for x in want} > {"", "mit", "apache"}
    same(licenses.scan(docs), want, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
    assert licenses.scan(no_docs).count() == 0


def test_token_output(docs, rows, no_docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    whole.encode_special_tokens = True
    ids = [(r[0], np.array([*whole.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in rows]
    got = sorted((tuple(r) for r in token_output.token_output(docs, tokenizer_path()).collect()), key=lambda r: r[1])
    assert [g[0] for g in got] == sorted((i for i, _ in ids), key=lambda i: (i is not None, i or 0))
    start = 0
    for doc_id, s, n, _ in got:
        assert s == start
        start += n
    assert sorted((g[0] is not None, g[0], g[3]) for g in got if g[0] is not None) == sorted((True, i, zlib.crc32(b)) for i, b in ids if i is not None)
    assert token_output.token_output(no_docs, tokenizer_path()).count() == 0


def test_pieces_encode_as_whole_texts():
    encoder = token_output.Encoder(tokenizer_path())
    for text in ["a  b", " a", "a \n b", "a\n b  ", "  ", "it's don't 's  ' s", "x   y z \x1c q", "<|endoftext|> a", "é à\r\n", "1 2  3 44 a1", " \n foo\n \nbar   baz", "a  b  c"]:
        assert np.frombuffer(encoder.encode([text])[0], encoder.kind).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_that_begin_with_nul():
    encoder = token_output.Encoder(tokenizer_path())
    assert np.frombuffer(encoder.encode(["a \0b"])[0], encoder.kind).tolist() == [64, 220, 188, 65]
    for text in [" \0", " \0b", "\0b", "\0", "\0 \0 b", "a \0", "a  \0b \0", "\0b  \0 b", "b \0b b", "\0 a", " a \0\0b", "  \0b"]:
        assert np.frombuffer(encoder.encode([text])[0], encoder.kind).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_special_tokens_as_the_library_has_them():
    from tokenizers import Tokenizer

    encoder, plain = token_output.Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    assert np.frombuffer(encoder.encode(["a<|endoftext|>b"])[0], encoder.kind).tolist() == [64, 50256, 65]
    for text in ["<|endoftext|>", " <|endoftext|>", "a <|endoftext|> b", "a  <|endoftext|>  b", "a.<|endoftext|><|endoftext|> .", "a\n <|endoftext|>\n b", "<|endoftext| >", "a <|endoftext|>b c<|endoftext|>"]:
        assert np.frombuffer(encoder.encode([text])[0], encoder.kind).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_variable_length_coding():
    ranks = np.array([0, 255, 256, 65535, 65536, 1 << 24, 7] * 3, np.uint32)
    assert (token_output.unpack(*token_output.pack(ranks), len(ranks)) == ranks).all()
    assert len(token_output.unpack(b"", b"", 0)) == 0


def test_contamination(spark, docs, rows, no_docs):
    passage = next(r[1] for r in rows if r[0] == 11)
    items = spark.createDataFrame([(1, passage), (2, "Never, seen: anywhere at all here"), (3, "two words"), (4, None), (5, ""), (6, passage.replace(" ", ", ").upper())], "item_id long, text string")
    sets = lambda t: {tuple(w[i : i + min(5, len(w))]) for w in [PLAIN.findall((t or "").translate(LOWER))] for i in range(max(len(w) - 4, 1)) if w}
    want = []
    for r in rows:
        for i in items.collect():
            s = sets(i.text)
            if r[0] is not None and s and 100 * len(s & sets(r[1])) >= 80 * len(s):
                want.append((r[0], i.item_id, len(s & sets(r[1])), len(s)))
    assert len(want) >= 7
    same(decontam.contamination(docs, items), {*want}, ["doc_id", "item_id", "n_shared", "n_item"])
    kept = decontam.clean_documents(docs, items)
    assert kept.columns == docs.columns and kept.count() == len([r for r in rows if r[0] not in {w[0] for w in want}])
    assert decontam.contamination(no_docs, items).count() == 0 and decontam.contamination(docs, items.limit(0)).count() == 0


def test_repeated_bytes(docs, rows, no_docs):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    n = 200
    count = collections.Counter(b[i : i + n] for _, b in texts for i in range(len(b) - n + 1))
    want = []
    for doc_id, b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        want.append((doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    assert sum(w[2] > 0 for w in want) > 8
    same(suffix_dedup.remove_repeats(docs), want, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_mixing(docs, rows, no_docs):
    got = mixing.mixture(docs).collect()
    size = lambda r: len(WORDS.findall(r[1] or ""))
    per = collections.Counter()
    for r in rows:
        per[r[3]] += size(r)
    assert sorted((str(g.doc_id), g.size, g.source_size) for g in got) == sorted((str(r[0]), size(r), per[r[3]]) for r in rows)
    assert all(g.taken <= 3 * g.size for g in got)
    targets = {(g.source_size, g.target) for g in got}
    assert abs(sum(t for _, t in targets) - sum(per.values())) < 1e-6 and all(t <= 3 * s + 1e-9 for s, t in targets)
    for s, t in targets:
        own = [g for g in got if g.source_size == s]
        assert abs(sum(g.taken for g in own) - t) <= max(g.size for g in own) / 2 + 1e-6
    times = [g.first_position for g in got if g.first_position is not None]
    assert all(0 <= t <= 1 for t in times)
    again = mixing.mixture(docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns and copies.count() == sum(g.copies for g in got)
    assert mixing.mixture(no_docs).count() == 0
