"""Registered queries against their SQL on the smallest tables, and mining against brute force."""

import hashlib
from collections import Counter

import duckdb
import pytest

from granary.operators import experiment, mining, runlog
from granary.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str([r[c] for c in columns]) for r in df.collect())
    rel = duck.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(str([r[i] for i in at]) for r in rel.fetchall())


@pytest.mark.parametrize("name", ["c04_kraft_sums", "c09_baseline_size", "c17_envelope", "s17_archives", "d03_pdf_segments", "d19_component_containers", "d20_deflate_round_trip", "e06_symbols_account_for_all_bytes"])
def test_every_row_is_ok(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows and all(r["ok"] for r in rows)


def test_mining_by_brute_force(spark):
    texts = [(1, "abcabcabcabc the_word the_word the_word the_word!"), (2, ""), (3, None), (4, "ab" * 30 + "x" * 40)]
    df = spark.createDataFrame(texts, "file_id long, text string")
    corpus = df.selectExpr("file_id", "encode(coalesce(text, ''), 'UTF-8') data")
    grams = {(r.file_id, r.pattern): r.freq for r in mining.ngrams(corpus).collect()}
    want = {}
    for i, t in texts:
        b = (t or "").encode()
        for n in range(2, 6):
            for p, f in Counter(b[k : k + n] for k in range(len(b) - n + 1)).items():
                if f >= 4:
                    want[i, p.hex().upper()] = f
    assert grams == want
    words = mining.words(df)
    assert {(r.file_id, bytes.fromhex(r.pattern), r.freq) for r in words.collect()} == {(1, b"the_word", 4)}
    found = mining.candidates(mining.ngrams(corpus), words)
    assert found.count() == len(want) + 1
    from granary.functions import dictionary

    scored = {(r.file_id, r.pattern): r.gain for r in mining.gains(found, corpus).collect()}
    for (i, p), g in scored.items():
        data = dict(texts)[i].encode()
        f = want.get((i, p), 4)
        assert g == dictionary.gain(bytes.fromhex(p), f, dictionary.literal_bits(data), len(data))
    best = mining.admitted(mining.gains(found, corpus)).where("file_id = 1").orderBy("place").collect()
    data = texts[0][1].encode()
    assert [bytes.fromhex(r.pattern) for r in best] == dictionary.first_patterns(data, 4, dictionary.literal_bits(data), dictionary.Options())


def test_quota_refusals_use_nothing(spark):
    rows = spark.createDataFrame([(1, 1, 60), (1, 2, 50), (1, 3, 40), (2, 4, 101)], "user_id long, id long, byte_size long")
    assert [(r.id, r.accepted) for r in runlog.quota_decisions(rows, 100).orderBy("id").collect()] == [(1, True), (2, False), (3, True), (4, False)]


def test_exact_p():
    assert experiment.exact_p([2, 4, 6, 8, 10], 0) == 2 / 32
    assert abs(experiment.exact_p([2 * i for i in range(1, 13)], 0) - 0.000488) < 1e-6


def test_stats_leave_archive_children_out(spark):
    runs = spark.createDataFrame([(1, "compress", None, 10, 5, True, 2.0), (2, "compress", 1, 10, 5, True, 2.0), (3, "decompress", None, 7, 7, True, 1.0)], "id long, operation string, parent_history_id long, original_bytes long, compressed_bytes long, lossless_verified boolean, ratio double")
    assert runlog.history_stats(runs).first()["files"] == 1


def test_streaming_limiter_equals_batch(spark, tmp_path):
    from granary.sources import views
    from granary.streaming.limiter import failure_windows

    batch = runlog.trailing_failures(views.attempts(spark, SF), seconds=86400, limit=3)
    want = {(r.event_id, r.failures) for r in batch.collect()}
    spark.read.parquet(f"{SF}/events.parquet").where("event_type = 'error'").selectExpr("event_id", "user_id", "concat('10.0.0.', event_id % 2) ip_address", "cast(ts as timestamp) ts", "'failure' kind").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, user_id long, ip_address string, ts timestamp, kind string").parquet(str(tmp_path / "in"))
    q = failure_windows(stream, seconds=86400, limit=3).writeStream.format("memory").queryName("decisions").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.event_id, r.failures) for r in spark.table("decisions").collect()} == want


def test_synthetic_files_and_ablation(spark):
    rows = {r.kind: r for r in QUERIES["s23_synthetic_files"](spark, SF).collect()}
    assert len(rows) == 6 and all(r.files == 5 and r.bytes > 500 for r in rows.values())
    sizes = {r.variant: r.bytes for r in QUERIES["l09_option_ablation"](spark, SF).collect()}
    assert len(sizes) == 7 and sizes["all"] <= sizes["none"]


def test_searches_run_over_whole_documents(spark, tmp_path, monkeypatch):
    from granary.functions import dictionary
    from granary.operators.codec import VARIANTS

    texts = {1: "the cat and the dog and the cat " * 20, 2: None, 3: "".join(chr(97 + i * i % 23) for i in range(700)), 4: "a b " * 700}
    spark.createDataFrame([(i, t, "en", "s") for i, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    data = {i: (t or "").encode() for i, t in texts.items()}
    monkeypatch.setattr(dictionary, "LARGE", 2000)  # the last text takes the rungs of large inputs
    got = {r.file_id: (r["size"], r.sha256) for r in QUERIES["l04_best_of_ladder"](spark, str(tmp_path)).collect()}
    best = {i: dictionary.best_of_ladder(b, "balanced") for i, b in data.items()}
    assert got == {i: (len(b), hashlib.sha256(b).hexdigest()) for i, b in best.items()}
    rows = QUERIES["l07_monotone"](spark, str(tmp_path)).collect()
    assert {r.file_id: r.balanced for r in rows} == {i: len(b) for i, b in best.items()} and all(r.ok for r in rows)
    for r in QUERIES["l09_option_ablation"](spark, str(tmp_path)).collect():
        assert (r.files, r.bytes) == (4, sum(len(dictionary.compress(b, dictionary.Options(**VARIANTS[r.variant]))) for b in data.values()))


def test_archive_source(spark, tmp_path):
    from granary.functions import container, dictionary
    from granary.sources.files import ArchiveSource, folder

    (tmp_path / "a.pak").write_bytes(container.pack_archive([("x/y.txt", b"hello " * 20), ("z", b"")], dictionary.compress_baseline))
    spark.dataSource.register(ArchiveSource)
    got = {(r.path, bytes(r.data)) for r in spark.read.format("granary-archive").option("path", f"file://{tmp_path}").load().collect()}
    assert got == {("x/y.txt", b"hello " * 20), ("z", b"")}
    assert folder(spark, str(tmp_path), least=1).count() == 1 and folder(spark, str(tmp_path), most=2).count() == 0


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, f"i int, {schema}").select("i", column.alias("x")).orderBy("i").select("x").collect()]


def test_labels_sizes_and_times(spark):
    """Literal values, so that no SQL can repeat an error of the operators."""
    from granary.operators import inspection as I

    assert values(spark, I.byte_label("b"), [(i, b) for i, b in enumerate((32, 9, 10, 13, 65, 0, 127, 255, 10))], "b int") == ["SP", "TAB", "LF", "CR", "A", "00", "7F", "FF", "LF"]
    sizes = [0, 1023, 1024, 2000, 1280, 1331, 1 << 20, (1 << 20) + 52429, 5 << 30, 2 << 40]
    assert values(spark, I.human("n"), [*enumerate(sizes)], "n long") == ["0 B", "1023 B", "1.0 KB", "2.0 KB", "1.2 KB", "1.3 KB", "1.0 MB", "1.1 MB", "5.0 GB", "2048.0 GB"]
    assert values(spark, I.uptime("n"), [*enumerate((0, 59, 60, 61, 3600, 3661, 86400, 90061))], "n long") == ["0s", "59s", "1m 0s", "1m 1s", "1h 0m", "1h 1m", "1d 0h 0m", "1d 1h 1m"]
    assert values(spark, I.member_path("p"), [*enumerate((" /etc/passwd", "a\\b", " a/b ", "\u00a0C:/x", "x/../y", "./", None))], "p string") == [None, "a/b", "a/b", None, None, None, None]


def test_scope(spark):
    from granary.operators import inspection as I

    png, word = b"\x89PNG\r\n\x1a\n.", b"PK\x03\x04" + b"." * 70_000 + b"word/document.xml"
    files = [("a.pdf", b"%PDF-1.4"), ("A.DOCX", b""), ("x/docx.txt", b"plain"), ("a.png", b""), ("a.txt", png), ("a.txt", word), ("noname", b"x"), (None, b"x"), ("b.docx\\c.TXT", b""), ("a.zip", b""), ("a.cpp", None)]
    got = values(spark, I.scope_error("name", "data"), [(i, *f) for i, f in enumerate(files)], "name string, data binary")
    assert got == [None, I.SAY_BLOCKED, None, I.SAY_OUTSIDE, I.SAY_IMAGE, I.SAY_WORD, I.SAY_OUTSIDE, I.SAY_OUTSIDE, None, I.SAY_OUTSIDE, None]


def test_sniffed(spark):
    from granary.operators import inspection as I

    late = b"x " * 5000
    cases = [
        (b"", ""), (b"%PDF-1", ".pdf"), (b"PK\x03\x04xl/workbook.xml", ".xlsx"), (b"PK\x05\x06", ".zip"), (b"\0\0\0\x18ftypmp42", ".mp4"), (b"GIF89a", ".gif"), (b"\x00\x01", ""),
        (b'{"a": [1, 2]}', ".json"), (b'{"a": 1, "b": [', ".json"), (b"[1, 2", ".txt"), (b"  <?xml version", ".xml"), (b"<HEAD>x", ".html"), (b"x <html", ".txt"),
        (b"select a\nb\nfrom c", ".txt"), (b"select a\nfrom b", ".sql"), (b"select a from b", ".sql"), (b"preselect a from b", ".txt"), (late + b"insert into t", ".txt"), (b"a,b\n1,2\n\n3,4", ".csv"), (b"a,b\n1,2,3", ".txt"),
        (b"a\tb\n1\t2", ".tsv"), (b"import x\ndef f", ".py"), (late + b"import x def f", ".txt"), (b"#include <a>", ".c"), (late + b"int main(", ".txt"), (b"const a = () => 1", ".js"), (b"function f() { var x }", ".js"), (b"plain", ".txt"), (b"ab" + bytes([200]) * 9, ""),
    ]
    assert values(spark, I.sniffed(), [(i, d) for i, (d, _) in enumerate(cases)], "data binary") == [e for _, e in cases]


def test_explanations_and_attribution(spark):
    from pyspark.sql import functions as F

    from granary.operators import inspection as I

    c = [F.col(x) for x in "o s raw routed saved blocks share entries avg".split()]
    rows = [(0, 100, 90, True, False, 0, 0, 0.0, 0, 0.0), (1, 1000, 950, False, False, -5, 3, 0.0, 3, 2.0), (2, 1000, 500, False, True, 9, 0, 0.0, 0, 0.0), (3, 1000, 250, False, False, 9, 4, 62.5, 12, 3.25), (4, 0, 10, False, False, 0, 0, 0.0, 0, 0.0)]
    got = values(spark, I.explanation(*c), rows, "o long, s long, raw boolean, routed boolean, saved long, blocks long, share double, entries long, avg double")
    assert got[0].startswith("This file was stored raw") and got[1].startswith("This file barely compressed (5.0%): its byte") and got[4].startswith("This file barely compressed (0.0%)")
    assert got[2].startswith("Container-aware: already-compressed components") and "Saved 50.0% using single-byte Huffman codes only" in got[2]
    assert got[3].startswith("Saved 75.0%: 62% of the savings came from 12 structural blocks (averaging 3.2 bytes each)")
    symbols = spark.createDataFrame([(1, 65, 4, 1), (1, 256, 10, 5), (2, 66, 9, 1)], "file_id long, sid int, bits long, produced long")
    assert {(r.file_id, r["class"]): (r.symbols, r.bits, r.bytes, r.saved_bits, r.share_pct) for r in I.attribution(symbols).collect()} == {
        (1, "literal"): (1, 4, 1, 4, 11.8), (1, "pattern"): (1, 10, 5, 30, 88.2), (2, "literal"): (1, 9, 1, -1, -100.0), (2, "pattern"): (0, 0, 0, 0, 0.0)}


def test_totals_of_no_runs_are_zero(spark):
    runs = spark.createDataFrame([], "id long, user_id long, operation string, parent_history_id long, original_bytes long, compressed_bytes long, lossless_verified boolean, ratio double, duration_ms long, entropy_centibits long, gzip_bytes long, huffman_bytes long")
    assert [*runlog.history_stats(runs).first()] == [0] * 8 and [*runlog.system_stats(runs).first()] == [0] * 12


def test_rungs_of_several_ladders_are_tried_once(spark, tmp_path, monkeypatch):
    from granary.functions import dictionary
    from granary.operators import codec

    texts = {1: b"", 2: b"some words, some more words " * 9, 3: bytes(range(256)) * 3}
    want = {(i, p, len(dictionary.best_of_ladder(t, p))) for i, t in texts.items() for p in dictionary.PRESETS}
    plain, calls = dictionary.compress, str(tmp_path / "calls")

    def counted(*args):
        with open(calls, "a") as f:
            f.write("x\n")
        return plain(*args)

    monkeypatch.setattr(dictionary, "compress", counted)
    spark.createDataFrame([*texts.items()], "doc_id long, data binary").selectExpr("doc_id", "decode(data, 'ISO-8859-1') text", "'s' source", "'en' lang").where("doc_id < 3").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["l07_monotone"](spark, str(tmp_path)).collect()
    assert {(r.file_id, p, r[p]) for r in rows for p in dictionary.PRESETS} == {w for w in want if w[0] < 3} and all(r.ok for r in rows)
    assert len(open(calls).readlines()) == 2 * len(dictionary.ladder("maximum", 0))
    monkeypatch.undo()
    best = codec.best_of_ladder(spark.createDataFrame([*texts.items()], "file_id long, data binary"), "maximum").collect()
    assert {(r.file_id, r.sha256) for r in best} == {(i, hashlib.sha256(dictionary.best_of_ladder(t, "maximum")).hexdigest()) for i, t in texts.items()}


def test_symbols_are_handed_on_in_parts(spark, monkeypatch):
    from granary.functions import container, dictionary
    from granary.operators import structured

    texts = {1: b"", 2: b"a" * 500, 3: b"some words, some more words" * 40, 4: bytes(range(256))}
    blobs = {i: dictionary.compress(t) for i, t in texts.items()}
    rows = spark.createDataFrame([*blobs.items()], "file_id long, data binary")
    monkeypatch.setattr(structured, "HANDED_ON", 100)
    got = [(r.file_id, r.pos, r.sid, r.bits, r.produced) for r in structured.symbol_rows(rows).orderBy("file_id", "pos").collect()]
    want = [(i, k, *x) for i, b in blobs.items() for k, x in enumerate(zip(*(c.tolist() for c in container.symbols(container.read(b))), strict=True))]
    assert got == want and len(want) > 100
    sums = {r.file_id: (r.made, r.bits) for r in structured.symbol_totals(rows).collect()}
    assert sums == {i: (sum(w[4] for w in want if w[0] == i), sum(w[3] for w in want if w[0] == i)) for i in texts}
    words = spark.createDataFrame([(i, dictionary.compress_baseline(b"ab" * 40 + bytes([i]))) for i in range(40)], "file_id long, data binary").coalesce(1)
    assert structured.code_tables(words).count() == 40 * 3
    # a row for each symbol of a whole batch of files is what a task must not hold at once
    plan = QUERIES["e06_symbols_account_for_all_bytes"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_an_owner_without_runs_is_as_in_sql(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"create view orders as select * replace (o_custkey + 1000000 as o_custkey) from '{SF}/orders.parquet'")
    con.execute(f"copy orders to '{tmp_path}/orders.parquet'")
    rel = con.sql(ORACLE_SQL["r33_owner_scope"])
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    assert want[0]["files"] == 0
    assert [r.asDict() for r in QUERIES["r33_owner_scope"](spark, str(tmp_path)).collect()] == want


def test_archives_refuse_what_is_lossy():
    from granary.functions import container, dictionary

    with pytest.raises(ValueError, match="isn't restored"):
        container.pack_archive([("a", b"abc")], lambda _: dictionary.compress_baseline(b"abd"))
    blob = container.pack_archive([("a", b"abc"), ("a", b"")], dictionary.compress_baseline)
    assert b'"entries":' in blob and [m["path"] for m in container.archive_members(blob)] == ["a", "a"]


def test_previews_and_chunks(spark):
    from pyspark.sql import functions as F

    from granary.operators import inspection as I

    rows = spark.createDataFrame([(1, bytes(range(40))), (2, b""), (3, b"x" * 9999), (4, "\u00e9" .encode() * 600)], "key long, data binary")
    assert {r.key: r.kind for r in rows.select("key", I.preview_kind().alias("kind")).collect()} == {1: "hex", 2: None, 3: "text", 4: "hex"}
    lines = {(r.key, r.line): (r.at, r.hex, r.ascii) for r in I.hex_preview(rows).collect()}
    assert lines[1, 2] == ("00000020", "20 21 22 23 24 25 26 27", " !\"#$%&'") and max(k[1] for k in lines if k[0] == 3) == 31 and not any(k[0] == 2 for k in lines)
    parts = I.chunks(rows, 16)
    assert {r.key: (bytes(r.data), r.ok) for r in I.reassembled(parts).collect()} == {r.key: (bytes(r.data), True) for r in rows.collect()}
    torn = parts.where("not (key = 1 and part = 1)").withColumn("chunk", F.when(F.col("key") == 3, F.lit(b"y")).otherwise(F.col("chunk")))
    assert {r.key: r.ok for r in I.reassembled(torn).collect()} == {1: False, 2: True, 3: False, 4: True}


def test_printable(spark):
    from granary.operators import inspection as I

    rows = [(0, b""), (1, b"plain"), (2, b"a\n\xff~ b"), (3, b"exactly 14 byt"), (4, b"fifteen bytes!!"), (5, None)]
    assert values(spark, I.printable("data"), rows, "data binary") == ["", "plain", "a\u00b7\u00b7~ b", "exactly 14 byt", "fifteen bytes!\u2026", None]


def test_independent_sizes(spark):
    import heapq

    from granary.functions import huffman

    def by_hand(data):  # the inner nodes' weights add up to the bits
        heap, bits = [*Counter(data).values()], 0
        if len(heap) == 1:
            return 264 + (len(data) + 7) // 8
        heapq.heapify(heap)
        while len(heap) > 1:
            w = heapq.heappop(heap) + heapq.heappop(heap)
            bits += w
            heapq.heappush(heap, w)
        return 264 + (bits + 7) // 8

    rows = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.file_id: r["size"] for r in QUERIES["c10_independent_size"](spark, SF).collect()}
    assert got == {i: by_hand(x) for i, x in rows.items()} and by_hand(b"") == 264
    assert huffman.independent_size(b"") == 264 and huffman.independent_size(b"aaaaaaaaa") == 266
    steps = [1, 1]
    while len(steps) < 12:
        steps.append(steps[-1] + steps[-2])
    data = b"".join(bytes([i]) * n for i, n in enumerate(steps))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(huffman, "INDEPENDENT_BITS", 4)
        assert huffman.independent_size(data) > by_hand(data)  # shorter codes cost more, and there is an end


def test_manifests(spark):
    import json

    from granary.operators import inspection as I
    from granary.operators import storage as O

    rows = spark.createDataFrame([(1, b"x" * 25), (2, b"short"), (3, b"")], "key long, data binary")
    made = {r["key"]: bytes(r.manifest) for r in O.manifests(I.chunks(rows, 10)).collect()}
    parts = [{"sha256": hashlib.sha256(b"x" * n).hexdigest(), "size": n} for n in (10, 10, 5)]
    body = {"parts": parts, "size": 25, "version": 1}
    pack = lambda b: O.MANIFEST + json.dumps(b, sort_keys=True, separators=(",", ":")).encode()
    assert made == {1: pack(body)}
    bad = [
        made[1] + b"{}", made[1][:-1], O.MANIFEST, O.MANIFEST + b"[]", O.MANIFEST + "\u00e9".encode(), pack(body | {"version": 2}), pack(body | {"size": 24}), pack(body | {"size": 25.0}), pack({"parts": parts, "size": 25}),
        pack(body | {"parts": parts[:1], "size": 10}), pack(body | {"parts": {"a": 1}}), pack(body | {"parts": [*parts[:2], {"sha256": "0", "size": 5}]}), pack(body | {"parts": [*parts, {"sha256": "0" * 64, "size": -1}], "size": 24}),
        pack(body | {"parts": [{"sha256": "0" * 64, "size": 0}] * 1025, "size": 0}),
    ]
    objects = [(0, made[1]), (1, b"anything"), (2, None), (3, b""), *((10 + i, b) for i, b in enumerate(bad))]
    got = {r["key"]: (r.state, r.parts, r.size) for r in O.manifest_states(spark.createDataFrame(objects, "key long, blob binary")).collect()}
    assert got == {0: ("valid", 3, 25), **{i: ("plain", None, None) for i in (1, 2, 3)}, **{10 + i: ("invalid", None, None) for i in range(len(bad))}}


def test_extraction(spark, tmp_path):
    from granary.functions import container, dictionary
    from granary.operators import storage as O

    files = {"x/y.txt": b"hello " * 20, "z": b"", "x/deep/er": b"1"}
    blob = container.pack_archive([("z", b"older"), *files.items()], dictionary.compress_baseline)
    top = f"file://{tmp_path}/out"
    for _ in range(2):  # a second run leaves the same files
        rows = O.extracted(spark.createDataFrame([(7, blob), (8, blob)], "archive_id long, blob binary"), top).collect()
        assert {(r.archive_id, r.path, r.bytes) for r in rows} == {(a, p, len(x)) for a in (7, 8) for p, x in files.items()}
        assert {str(p.relative_to(tmp_path)): p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()} == {f"out/{a}/{p}": x for a in (7, 8) for p, x in files.items()}
    for broken in (blob.replace(b"x/deep/er", b"../../bad"), blob.replace(hashlib.sha256(b"1").hexdigest().encode(), b"0" * 64)):
        with pytest.raises(Exception, match="unsafe path|isn't restored"):
            O.extracted(spark.createDataFrame([(9, broken)], "archive_id long, blob binary"), top).collect()
    assert not (tmp_path / "out" / "9").exists() and not (tmp_path / "bad").exists()


def test_unfinished_writes_are_removed(spark, tmp_path):
    import os
    import time

    from granary.operators import storage as O

    old, new, other = "a" * 32 + ".tmp-" + "b" * 32, "c" * 32 + ".tmp-" + "d" * 32, "e" * 32
    for name, age in ((old, 4000), (new, 100), (other, 9000), (old + "x", 9000)):
        (tmp_path / name).write_bytes(b"x")
        os.utime(tmp_path / name, (time.time() - age,) * 2)
    assert O.remove_unfinished(spark, f"file://{tmp_path}") == 1
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted([new, other, old + "x"])
    assert O.remove_unfinished(spark, f"file://{tmp_path}") == 0 and O.remove_unfinished(spark, f"file://{tmp_path}", 0) == 1
