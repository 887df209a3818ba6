"""Vectors, pages, toxicity and the pipeline."""

import base64
import collections
import hashlib

import numpy as np
import pytest

from granary.llm import embedding, toxicity, warc

SF = "/root/testdata/sf0.001"


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    near = base[:20] + 0.08 * rng.normal(size=(20, 16))
    vectors = [*base, *near, *base[:5], *(3 * base[5:8]), *(base[0] + 0.05 * rng.normal(size=16) for _ in range(30))]
    rows = [(i, [float(x) for x in v], 1, "extra") for i, v in enumerate(vectors)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0] * 15 + [None]), (904, [float("nan")] * 16), (905, [float("inf")] + [1.0] * 15), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (None, [1.0] * 16)]
    rows += [(i, v, None, None) for i, v in odd] + [rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, unit string").repartition(4)
    good = [(i, np.array(v) / np.linalg.norm(v)) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0]
    links, root = collections.Counter(), {i: i for i, *_ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(good):
        for b, (j, y) in enumerate(good):
            if a != b and len(x) == len(y) and x @ y >= 0.95:
                links[a] += 1
                p, q = sorted((find(i), find(j)))
                root[q] = p
    n_of = {i: links[a] for a, (i, _) in enumerate(good)}
    got = embedding.near_duplicate_vectors(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id) == (n_of.get(r.vec_id, 0), find(r.vec_id)) and r.kept == (r.vec_id == r.component_id)
    assert embedding.near_duplicate_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("least", [0, 10])
def test_warc(spark, least):
    html = ["<p>one</p>" * 50, "", None, "<p>é</p>", "short"]
    rows = [(i, f"http://x/{i}", html[i % 5], "x") for i in range(40)] + [(39, "http://x/39", html[4], "x"), (None, None, html[0], None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string")
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = max(first.get(h or "", -1), i)
    want = []
    for i, _, h, _ in rows:
        b = (h or "").encode()
        own = i is not None and len(b) >= least and first[h or ""] > i
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if own else "response", first[h or ""] if own else None))
    manifest = warc.write_archives(df, least)
    for split in (100, 1 << 20):
        assert sorted(map(str, map(tuple, warc.read_archives(manifest, split).collect()))) == sorted(map(str, want))
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_false_magic_inside_members():
    import io

    payload = b"".join(warc.GZIP + bytes([i]) * 9 for i in range(200))
    members = [warc.record(i, "u", payload + bytes([i]), warc.base32_sha1(payload + bytes([i])), None, "2024-01-01T00:00:00Z") for i in range(20)]
    data = b"".join(members)

    class File(io.BytesIO):
        def read_at(self, n, at):
            self.seek(at)
            return self.read(n)

    for step in (7, 64, 1000):
        found = [warc.parse(m)["page_id"] for s in range(0, len(data), step) for m in warc.records_in(File(data), s, min(s + step, len(data)), len(data))]
        assert found == [*range(20)]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels)
    rows = got.join(labels, "doc_id").where("held_out").collect()
    pos, neg = ([r.score for r in rows if r.toxic == t] for t in (1, 0))
    auc = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert auc > 0.8 and sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.85
    assert got.where("score < 0 or score > 1 or score is null").count() == 0


def test_toxicity_edges(spark, docs, rows, no_docs):
    labels = spark.createDataFrame([(i, None if i == 3 else int(i % 3 == 0), 1) for i in range(30)] + [(None, 1, 1)], "doc_id long, toxic int, score int")
    assert toxicity.toxicity(docs, labels).count() == len(rows)
    assert toxicity.toxicity(docs, labels.limit(0)).where("score is not null").count() == len(rows)
    assert toxicity.toxicity(no_docs, labels).count() == 0


def test_isotonic_levels_rise():
    rng = np.random.default_rng(0)
    raw = rng.normal(size=500)
    knots, levels = toxicity._isotonic(raw, (raw + rng.normal(size=500) > 0).astype(float))
    assert (np.diff(levels) >= 0).all() and (np.diff(knots) > 0).all()


def test_pipeline(spark):
    import corpus_pipeline as cp
    from granary.llm import decontam, minhash, mixing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in cp.STAGES[:4]:
        after = stage(spark, docs, SF).persist()
        assert after.columns == columns, name
        seen.append((docs, after))
        docs = after
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = seen[1]
    assert ids(before) - ids(after) == {r.doc_id for r in minhash.near_duplicates(before, 5, 80).where("not kept").collect()}
    before, after = seen[2]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert ids(before) - ids(after) == ids(decontam.contamination(before, bench))
    before, after = seen[3]
    assert after.count() == sum(r.copies for r in mixing.mixture(before).collect())
    assert cp.STAGES[4][1](spark, docs, SF).count() == docs.count()


def test_pipeline_against_independent_versions(spark, tmp_path):
    """Stages 2 to 5 against brute force and SQL; of the learned stage 1, that it splits by the scores of op5."""
    import re
    import zlib

    import corpus_pipeline as cp
    import duckdb
    from granary.llm.queries import ORACLE_SQL, tokenizer_path
    from tokenizers import Tokenizer

    at = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in cp.STAGES:
        stage(spark, at[-1], SF).write.parquet(f"{tmp_path}/{name}.parquet")
        at.append(spark.read.parquet(f"{tmp_path}/{name}.parquet"))
    ids = [sorted(r.doc_id for r in df.select("doc_id").collect()) for df in at]
    scores = toxicity.toxicity(at[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert ids[1] == sorted(r.doc_id for r in scores if r.score < 0.5) and len(ids[1]) < len(ids[0])

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, least = {}, {}
    for r in at[1].collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(lower))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    for i in sorted(sets):
        if i not in least:
            least[i], todo = i, [i]
            while todo:
                a = sets[todo.pop()]
                for j in sets:
                    if j not in least and a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                        least[j] = i
                        todo.append(j)
    assert ids[2] == sorted(i for i in least if least[i] == i)

    def by_sql(query, docs):
        con = duckdb.connect()
        con.execute(f"create view documents as select * from '{docs}/*.parquet'")
        con.execute(f"create view benchmark as select * from '{SF}/benchmark.parquet'")
        cur = con.execute(ORACLE_SQL[query])
        names = [d[0] for d in cur.description]
        return [dict(zip(names, x, strict=True)) for x in cur.fetchall()]

    leaks = {r["doc_id"] for r in by_sql("op6_benchmark_decontamination", f"{tmp_path}/near_dedup.parquet")}
    assert ids[3] == [i for i in ids[2] if i not in leaks]
    want = collections.Counter({r["doc_id"]: r["taken"] // r["size"] for r in by_sql("op8_source_mixing", f"{tmp_path}/decontamination.parquet") if r["taken"]})
    got = collections.Counter(i for i in ids[4] if i in want)
    assert got == want

    whole = Tokenizer.from_file(tokenizer_path())
    held = sorted((r.doc_id, zlib.crc32(np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in at[4].collect())
    assert sorted((r.doc_id, r.ids_crc32) for r in at[5].collect()) == held


def test_vectors_are_parsed_together():
    import time

    import numpy as np
    import pyarrow as pa

    from granary.llm import embedding

    odd = [None, [], [1.0, None], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [3.0, 4.0], [1e-200, 0.0], [1e200, 1e200], [1.0], [-0.0, 5.0], [3.0, 4.0]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(odd))), pa.array(odd, pa.list_(pa.float64()))], names=["vec_id", "embedding"])
    for part in (batch, batch.slice(4), batch.slice(0, 0)):
        out = pa.Table.from_batches(embedding._parse(iter([part]))).to_pylist()
        got = [None if r["unit"] is None else np.frombuffer(r["unit"]).round(12).tolist() for r in out]
        want = [None] * 6 + [[0.6, 0.8], [1.0, 0.0], [round(0.5**0.5, 12)] * 2, [1.0], [0.0, 1.0], [0.6, 0.8]]
        assert got == [want[r["vec_id"]] for r in out] and [r["vec_id"] for r in out] == part.column("vec_id").to_pylist()
        keys = {r["vec_id"]: (r["k1"], r["k2"]) for r in out}
        assert all((keys[i] == (0, 0)) == (want[i] is None) for i in keys)
        assert len({k for k in keys.values() if k != (0, 0)}) == len({str(odd[i]) for i in keys if want[i]})
    x = np.random.default_rng(1).normal(size=(20_000, 64))
    many = pa.RecordBatch.from_arrays([pa.array(range(len(x))), pa.ListArray.from_arrays(np.arange(0, x.size + 1, 64, np.int32), x.ravel())], names=["vec_id", "embedding"])
    began = time.process_time()
    made = pa.Table.from_batches(embedding._parse(iter([many])))
    took, began = time.process_time() - began, time.process_time()
    each = [np.array(v) / np.linalg.norm(v) for v in many.column("embedding").to_pylist()]
    assert took < time.process_time() - began
    assert np.abs(np.frombuffer(b"".join(made["unit"].to_pylist())).reshape(-1, 64) - each).max() < 1e-15
