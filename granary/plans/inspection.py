"""Queries about what files are."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import codec as C
from ..operators import inspection as I
from ..functions import dictionary
from ..operators import mining as M
from ..operators import structured as S
from ..sources import synthetic
from ..sources import views as V
from .mining import HIST
from .registry import query

H = V.HISTORY_SQL


@query("e01_entropy", f"""with {HIST}, e as (select file_id, round(-sum(freq / total * log2(freq / total)), 6) h, count(*) u from hist join tot using (file_id) group by 1), n as (select doc_id file_id, octet_length(encode(coalesce(text, '')))::bigint n_bytes from documents),
 f as (select *, ceil(round(abs(coalesce(h, 0.0)) * n_bytes / 8, 3))::bigint floor_bytes from n left join e using (file_id))
 select file_id, n_bytes, abs(coalesce(h, 0.0)) entropy_bits, floor_bytes, case when floor_bytes > 0 then n_bytes / floor_bytes else 0.0 end order0_ratio, coalesce(u, 0) unique_bytes, case when n_bytes = 0 then 'empty' when h >= 7.5 then 'very low' when h >= 6.5 then 'low' when h >= 4.5 then 'moderate' when h >= 2.5 then 'high' else 'very high' end band from f""")
def e01(s, d):
    c = V.corpus(s, d)
    return I.entropy(M.byte_histogram(c), c.select("file_id", "n_bytes"))


_LABEL = "case byte when 32 then 'SP' when 9 then 'TAB' when 10 then 'LF' when 13 then 'CR' else case when byte > 32 and byte < 127 then chr(byte) else upper(lpad(to_hex(byte), 2, '0')) end end"


@query("e02_top_bytes", f"with {HIST}, r as (select *, row_number() over (partition by file_id order by freq desc, byte) place, 100.0::double * freq / sum(freq) over (partition by file_id) pct from hist) select *, {_LABEL} label from r where place <= 24")
def e02(s, d):
    return I.top_bytes(M.byte_histogram(V.corpus(s, d)))


@query("e03_byte_labels", f"select byte::int as byte, {_LABEL} label from (select range::int as byte from range(256))")
def e03(s, d):
    return s.range(256).select(F.col("id").cast("int").alias("byte")).withColumn("label", I.byte_label("byte"))


@query("e08_length_histogram", "select case when p_partkey % 500 < 256 then 'literal' else 'pattern' end class, 1 + p_size % 16 len, count(*) symbols from part group by all")
def e08(s, d):
    return I.length_histogram(V.table(s, d, "part").selectExpr("p_partkey file_id", "p_partkey % 500 sid", "1 + p_size % 16 len"))


@query("e09_leaf_counts", "select left(lpad(bin(p_partkey % 1024), 10, '0'), 4) prefix, count(*) leaves from part group by 1")
def e09(s, d):
    return V.table(s, d, "part").groupBy(F.substring(F.lpad(F.bin(F.col("p_partkey") % 1024), 10, "0"), 1, 4).alias("prefix")).agg(F.count("*").alias("leaves"))


_SYM = "sym as (select l_orderkey file_id, l_partkey % 300 sid, 1 + l_suppkey % 16 bits, case when l_partkey % 300 < 256 then 1 else 2 + l_suppkey % 9 end produced from lineitem)"


@query("e10_attribution", f"""with {_SYM}, t as (select file_id, sum(8 * produced - bits)::bigint total from sym group by 1), k(class, lo, hi) as (values ('literal', 0, 255), ('pattern', 256, 9999)),
 c as (select file_id, class, count(sid) symbols, coalesce(sum(bits), 0)::bigint bits, coalesce(sum(produced), 0)::bigint bytes from (t cross join k) left join sym using (file_id) where sid is null or sid between lo and hi group by all),
 a as (select t.file_id, k.class, coalesce(symbols, 0) symbols, coalesce(bits, 0) bits, coalesce(bytes, 0) bytes, total from t cross join k left join c on c.file_id = t.file_id and c.class = k.class)
 select file_id, class, symbols, bits, bytes, 8 * bytes - bits saved_bits, round(100.0::double * (8 * bytes - bits) / case when total > 0 then total else 1 end, 1) share_pct from a""")
def e10(s, d):
    return I.attribution(V.table(s, d, "lineitem").selectExpr("l_orderkey file_id", "l_partkey % 300 sid", "1 + l_suppkey % 16 bits", "case when l_partkey % 300 < 256 then 1 else 2 + l_suppkey % 9 end produced"))


_EXPLAINED = [
    "id", "original_bytes", "compressed_bytes", "id % 11 = 0 as raw", "id % 5 = 0 as routed", "case when id % 7 = 0 then -id else 800 * id end saved_bits",
    "case when id % 3 = 0 then 0 else 5 + id % 40 end blocks", "(id % 1000) / 10.0 as share", "id % 90 as entries", "2 + (id % 64) / 8.0 as block_bytes",
]


@query("e11_explain", f"""with {H}, x as (select {', '.join(_EXPLAINED)} from history), p as (select *, case when original_bytes > 0 then 100.0::double * (1 - compressed_bytes::double / original_bytes) else 0.0 end pct from x)
 select id, case when raw then '{I.SAY_RAW}' else case when routed then '{I.SAY_ROUTED}' else '' end || case when saved_bits <= 0 then printf('{I.SAY_RANDOM}', pct) when blocks = 0 then printf('{I.SAY_BYTES}', pct)
 else printf('{I.SAY_BLOCKS}', pct, printf('%.0f', share::double), entries::bigint, block_bytes::double) end end sentence from p""")
def e11(s, d):
    x = V.history(s, d).selectExpr(*_EXPLAINED)
    c = F.col
    return x.select("id", I.explanation(c("original_bytes"), c("compressed_bytes"), c("raw"), c("routed"), c("saved_bits"), c("blocks"), c("share").cast("double"), c("entries"), c("block_bytes").cast("double")).alias("sentence"))


@query("e13_sniff")
def e13(s, d):
    rows = V.table(s, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.coalesce("html", F.lit("")).alias("text"))
    rows = rows.unionByName(V.table(s, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")))
    return rows.withColumn("data", F.encode("text", "UTF-8")).select("kind", "id", I.sniffed().alias("ext"))


@query("e15_is_textual", r"with t as (select doc_id, left(coalesce(text, ''), 4096) h from documents) select doc_id, octet_length(encode(h)) > 0 and not contains(h, chr(0)) and length(regexp_replace(h, '[^\t\n\r\x20-\x7E]', '', 'g')) >= octet_length(encode(h)) * 0.9::double textual from t")
def e15(s, d):
    return V.table(s, d, "documents").select("doc_id", I.is_textual(F.substring(F.coalesce("text", F.lit("")), 1, 4096), 0.9).alias("textual"))


_NAMED = f"with {H}, n as (select id, filename || case when id % 3 = 0 then '.AFC' else '.afc' end name, case id % 4 when 0 then '.txt' when 1 then '' when 2 then '.json' else '.pdf' end ext from history), s as (select *, left(name, length(name) - 4) stem from n)"


@query("e16_restored_name", _NAMED + """ select id, case when instr(stem, '.') > 0 and list_last(string_split(stem, '.')) <> '' and length(list_last(string_split(stem, '.'))) <= 8 and not contains(list_last(string_split(stem, '.')), '/') then stem
 when ext <> '' and not ends_with(lower(stem), ext) then stem || ext else stem end name from s""")
def e16(s, d):
    rows = V.history(s, d).selectExpr("id", "filename || case when id % 3 = 0 then '.AFC' else '.afc' end name", "case id % 4 when 0 then '.txt' when 1 then '' when 2 then '.json' else '.pdf' end ext")
    return rows.select("id", I.restored_name("name", "ext").alias("name"))


@query("e17_hex_preview", r"""with h as (select doc_id file_id, left(hex(encode(coalesce(text, ''))), 1024) h from documents), l as (select file_id, unnest(range(0, (length(h) // 2 + 15) // 16))::int line, h from h), m as (select file_id, line, substr(h, 32 * line + 1, 32) x from l)
 select file_id, line, lpad(lower(to_hex(16 * line)), 8, '0') as at, trim(regexp_replace(lower(x), '(..)', '\1 ', 'g')) hex, list_aggregate(list_transform(range(length(x) // 2), lambda i: case when ('0x' || substr(x, 2 * i + 1, 2))::int between 32 and 126 then chr(('0x' || substr(x, 2 * i + 1, 2))::int) else '.' end), 'string_agg', '') ascii from m""")
def e17(s, d):
    return I.hex_preview(V.corpus(s, d).select("file_id", "data"))


@query("e17_preview_kind", r"""with h as (select doc_id file_id, encode(coalesce(text, '')) b from documents), x as (select file_id, octet_length(b) n, least(octet_length(b), 4096) m, left(hex(b), 8192) x from h)
 select file_id, case when n > 0 then case when regexp_replace(x, '(00)|(..)', '\1', 'g') = '' and length(regexp_replace(x, '(09|0A|0D|[2-6][0-9A-F]|7[0-9A-E])|(..)', '\1', 'g')) / 2 / m >= 0.85::double then 'text' else 'hex' end end kind from x""")
def e17_kind(s, d):
    return V.corpus(s, d).select("file_id", I.preview_kind().alias("kind"))


@query("e17_text_preview", "select doc_id, array_to_string(string_split(left(coalesce(text, ''), 4096), chr(10))[:40], chr(10)) head from documents")
def e17_text(s, d):
    return V.table(s, d, "documents").select("doc_id", F.array_join(F.slice(F.split(F.substring(F.coalesce("text", F.lit("")), 1, 4096), "\n"), 1, 40), "\n").alias("head"))


_SCOPED = "select id, case id % 9 when 0 then replace(filename, '.', '.docx.') when 1 then 'a\\b/' || upper(filename) || '.DOCX' when 2 then filename || '.PDF' when 3 then filename || '.png' when 4 then filename || '.txt' when 5 then filename || '.txt' when 6 then filename || '/x.c' else filename end name, case id % 9 when 4 then '{png}' when 5 then '{word}' else '{text}' end head from history"


@query("e18_scope", f"""with {H}, n as ({_SCOPED.format(png="89504E470D0A1A0A00", word=b"PK\x03\x04..word/document.xml".hex().upper(), text=b"plain".hex().upper())}), l as (select *, lower(list_last(string_split(replace(name, chr(92), '/'), '/'))) low from n)
 select id, case when regexp_matches(low, '\\.(docx|docm|dotx|dotm)$') then '{I.SAY_BLOCKED}' when not regexp_matches(low, '\\.(pdf|txt|csv|tsv|json|sql|xml|html|htm|log|py|js|c|cpp|h|hpp)$') then '{I.SAY_OUTSIDE}' when starts_with(head, '89504E470D0A1A0A') then '{I.SAY_IMAGE}' when starts_with(head, '504B0304') and contains(head, '{b"word/document.xml".hex().upper()}') then '{I.SAY_WORD}' end error from l""")
def e18(s, d):
    V.history(s, d).createOrReplaceTempView("scoped_history")
    rows = s.sql(_SCOPED.format(png="89504E470D0A1A0A00", word=b"PK\x03\x04..word/document.xml".hex().upper(), text=b"plain".hex().upper()).replace("from history", "from scoped_history").replace("a\\b", "a\\\\b"))
    return rows.withColumn("data", F.unhex("head")).select("id", I.scope_error("name", "data").alias("error"))


@query("e19_size_policy", f"with {H} select id, case when original_bytes = 0 then 'empty' when original_bytes < 1000000 then 'too small' when original_bytes > 40000000 then 'too large' when sum(original_bytes) over (partition by batch_id order by id) > 60000000 then 'batch too large' end error from history")
def e19(s, d):
    return I.size_errors(V.history(s, d), "batch_id", "id", "original_bytes", 1_000_000, 40_000_000, 60_000_000).select("id", "error")


@query("e20_human_bytes", f"with {H} select id, case when n < 1024 then n || ' B' when n < 1048576 then printf('%.1f KB', n / 1024::double) when n < 1073741824 then printf('%.1f MB', n / 1048576::double) else printf('%.1f GB', n / 1073741824::double) end size from (select id, case when id % 3 = 0 then original_bytes when id % 3 = 1 then original_bytes % 2000 else original_bytes * 100 end n from history)")
def e20(s, d):
    rows = V.history(s, d).selectExpr("id", "case when id % 3 = 0 then original_bytes when id % 3 = 1 then original_bytes % 2000 else original_bytes * 100 end n")
    return rows.select("id", I.human("n").alias("size"))


@query("e21_uptime", "select o_orderkey id, case when n >= 86400 then printf('%dd %dh %dm', n // 86400, n // 3600 % 24, n // 60 % 60) when n >= 3600 then printf('%dh %dm', n // 3600, n // 60 % 60) when n >= 60 then printf('%dm %ds', n // 60, n % 60) else printf('%ds', n) end up from (select o_orderkey, o_orderkey * 7 n from orders)")
def e21(s, d):
    return V.table(s, d, "orders").selectExpr("o_orderkey id", "o_orderkey * 7 n").select("id", I.uptime("n").alias("up"))


_SEG = "seg as (select l_orderkey file_id, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) - 1)::int seq, (l_partkey % 3)::int kind, l_quantity::bigint n from lineitem), tile as (select file_id, seq, kind, (sum(n) over (partition by file_id order by seq) - n)::bigint as start, (sum(n) over (partition by file_id order by seq))::bigint as \"end\" from seg)"


def _segments(s, d):
    rows = V.table(s, d, "lineitem").selectExpr("l_orderkey file_id", "cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 as int) seq", "cast(l_partkey % 3 as int) kind", "cast(l_quantity as bigint) n")
    return rows.selectExpr("file_id", "seq", "kind", "sum(n) over (partition by file_id order by seq) - n start", "sum(n) over (partition by file_id order by seq) end")


@query("d07_payload_class", r"select doc_id, case when octet_length(encode(coalesce(text, ''))) < 64 then 'pooled' when not contains(text, chr(0)) and length(regexp_replace(left(text, 256), '[^\t\n\r\x20-\x7E]', '', 'g')) >= octet_length(encode(left(text, 256))) * 0.85::double then 'pooled' else 'by entropy' end class from documents")
def d07(s, d):
    return V.table(s, d, "documents").withColumn("text", F.coalesce("text", F.lit(""))).select("doc_id", I.payload_class().alias("class"))


@query("d08_merge_segments", f'with {_SEG}, f as (select *, case when lag(kind) over (partition by file_id order by start) is distinct from kind then 1 else 0 end n from tile), g as (select *, sum(n) over (partition by file_id order by start) island from f) select file_id, kind, min(start) as start, max("end") as "end" from g group by file_id, island, kind')
def d08(s, d):
    return I.merged_segments(_segments(s, d)).drop("island")


@query("d09_tiling", f'with {_SEG}, w as (select *, lag("end", 1, 0) over (partition by file_id order by start) b from tile where seq <> 2) select file_id, (count(*) filter (b <> start) + count(*) filter ("end" <= start) + case when max("end") <> any_value(t) then 1 else 0 end)::bigint faults from w join (select file_id, max("end") t from tile group by 1) using (file_id) group by 1')
def d09(s, d):
    seg = _segments(s, d)
    return I.tiling_faults(seg.where("seq <> 2"), seg.groupBy("file_id").agg(F.max("end").alias("n_bytes")))


@query("d11_plan_summary", f'with {_SEG} select file_id, count(*) segments, sum("end" - start)::bigint bytes, coalesce(sum("end" - start) filter (kind = 0), 0)::bigint opaque_bytes, coalesce(sum("end" - start) filter (kind = 1), 0)::bigint pooled_bytes from tile group by 1')
def d11(s, d):
    return I.plan_summary(_segments(s, d))


_PATHS = "p(path) as (values ('a/b.txt'), ('a\\b\\c.txt'), ('./x//y'), ('/etc/passwd'), ('C:/x'), ('a/../b'), (''), ('.'), ('..'), ('a/./b/'), (' /etc/passwd'), ('\tC:/x '), (' a/b '))"


@query("t20_member_path", f"with {_PATHS}, q as (select path, trim(replace(path, chr(92), '/'), ' ' || chr(9)) t from p), r as (select *, list_filter(string_split(t, '/'), lambda x: x not in ('', '.')) parts from q) select path, case when not (starts_with(t, '/') or substr(t, 2, 1) = ':' or list_contains(parts, '..') or len(parts) = 0) then array_to_string(parts, '/') end safe from r")
def t20(s, d):
    rows = [("a/b.txt",), ("a\\b\\c.txt",), ("./x//y",), ("/etc/passwd",), ("C:/x",), ("a/../b",), ("",), (".",), ("..",), ("a/./b/",), (" /etc/passwd",), ("\tC:/x ",), (" a/b ",)]
    return s.createDataFrame(rows, "path string").select("path", I.member_path("path").alias("safe"))


@query("t22_offsets", f"with {H} select id, batch_id, coalesce(sum(compressed_bytes) over (partition by batch_id order by id rows between unbounded preceding and 1 preceding), 0)::bigint as offset from history")
def t22(s, d):
    return I.offsets(V.history(s, d), "batch_id", "id", "compressed_bytes").select("id", "batch_id", "offset")


@query("t24_download_name", "select page_id, list_last(string_split(replace(url, chr(92), '/'), '/')) name from pages")
def t24(s, d):
    return V.table(s, d, "pages").select("page_id", I.download_name("url").alias("name"))


@query("t25_registration", "with u as (select c_custkey id, lower(replace(c_name, '#', '_')) name, c_custkey % 10 = 0 short from customer) select id, case when short then 'too short' when not regexp_matches(name, '^[a-z0-9_]{3,32}$') then 'bad characters' when id % 7 = 0 then 'taken' end error from u")
def t25(s, d):
    rows = V.table(s, d, "customer").selectExpr("c_custkey id", "lower(replace(c_name, '#', '_')) name")
    taken = rows.where("id % 7 = 0").select("name").withColumn("taken", F.lit(True))
    rows = rows.join(taken, "name", "left")
    return rows.select("id", F.when(F.col("id") % 10 == 0, "too short").when(~F.col("name").rlike("^[a-z0-9_]{3,32}$"), "bad characters").when(F.col("taken"), "taken").alias("error"))


_BLOBS = "b as (select doc_id as key, encode(coalesce(text, '')) as data, case when doc_id % 17 = 0 then 'x' else sha256(coalesce(text, '')) end sha256, octet_length(encode(coalesce(text, ''))) + case when doc_id % 19 = 0 then 1 else 0 end byte_size from documents)"


@query("s12_verified_read", f"with {_BLOBS} select key, sha256(data) = sha256 and octet_length(data) = byte_size ok from b")
def s12(s, d):
    b = V.corpus(s, d).withColumn("sha256", F.when(F.col("file_id") % 17 == 0, "x").otherwise(F.sha2("data", 256))).withColumn("byte_size", F.col("n_bytes") + F.when(F.col("file_id") % 19 == 0, 1).otherwise(0))
    return I.verified_blobs(b.withColumnRenamed("file_id", "key")).select("key", "ok")


@query("s13_chunked_round_trip", "select doc_id as key, sha256(coalesce(text, '')) sha256 from documents")
def s13(s, d):
    blobs = V.corpus(s, d).select(F.col("file_id").alias("key"), "data")
    return I.reassembled(I.chunks(blobs, 1000)).select("key", F.sha2("data", 256).alias("sha256"))


@query("s14_key_listing", "select md5(o_orderkey::varchar) as key from orders where o_orderkey % 2 = 0")
def s14(s, d):
    return V.table(s, d, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, F.md5(F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.lit("tmp-"), F.col("o_orderkey").cast("string"))).alias("key")).where(F.col("key").rlike("^[0-9a-f]{32}$"))


@query("s20_manifest_verify", "select 'doc_' || doc_id path, case when doc_id % 11 = 0 then 'missing' when doc_id % 13 = 0 then 'size' when doc_id % 17 = 0 then 'md5' when doc_id % 19 = 0 then 'sha256' else 'ok' end status from documents")
def s20(s, d):
    files = V.corpus(s, d).select(F.concat(F.lit("doc_"), F.col("file_id").cast("string")).alias("path"), "file_id", "data", "n_bytes")
    off = lambda n, wrong, right: F.when(F.col("file_id") % n == 0, wrong).otherwise(right)
    manifest = files.select("path", off(13, F.lit(-1), F.col("n_bytes")).alias("size"), off(17, F.lit(""), F.md5("data")).alias("md5"), off(19, F.lit(""), F.sha2("data", 256)).alias("sha256"))
    return I.manifest_status(manifest, files.where("file_id % 11 <> 0").select("path", "data"))


@query("s21_pin_subset", "select source corpus, count(*) files, sum(octet_length(encode(text)))::bigint bytes, min(sha256(text)) first_digest from documents where octet_length(encode(text)) between 1 and 5000 group by 1")
def s21(s, d):
    rows = V.corpus(s, d).where("n_bytes between 1 and 5000")
    return rows.groupBy("corpus").agg(F.count("*").alias("files"), F.sum("n_bytes").alias("bytes"), F.min(F.sha2("data", 256)).alias("first_digest"))


@query("s03_size_bounded_scan", "select doc_id file_id, octet_length(encode(text))::bigint n_bytes from documents where octet_length(encode(text)) >= 500 and octet_length(encode(text)) <= 3000")
def s03(s, d):
    return V.corpus(s, d).where("n_bytes >= 500 and n_bytes <= 3000").select("file_id", "n_bytes")


@query("s04_tagged_corpora", "select 'documents' corpus, count(*) files, sum(octet_length(encode(coalesce(text, ''))))::bigint bytes from documents union all select 'pages', count(*), sum(octet_length(encode(coalesce(html, ''))))::bigint from pages union all select 'benchmark', count(*), sum(octet_length(encode(coalesce(text, ''))))::bigint from benchmark")
def s04(s, d):
    parts = None
    for name, column in (("documents", "text"), ("pages", "html"), ("benchmark", "text")):
        one = V.table(s, d, name).select(F.lit(name).alias("corpus"), F.octet_length(F.coalesce(column, F.lit(""))).alias("n"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("corpus").agg(F.count("*").alias("files"), F.sum("n").alias("bytes"))


@query("l03_ladder", "with r(preset, turn, shape, large) as (values ('fast', 0, 'default', true), ('fast', 1, 'ngram8', false), ('balanced', 2, 'default', true), ('balanced', 3, 'wide-dict', true), ('balanced', 4, 'ngram6', false), ('balanced', 5, 'ngram8', false), ('maximum', 6, 'default', true), ('maximum', 7, 'wide-dict', true), ('maximum', 8, 'ngram6', false), ('maximum', 9, 'ngram8', false), ('maximum', 10, 'many-merges', true), ('maximum', 11, 'wide-scan', true)), p as (select o_orderkey id, o_totalprice * 100 >= 8388608 big, case o_orderkey % 3 when 0 then 1 when 1 then 5 else 11 end most from orders) select p.id, count(*) rungs from p join r on r.turn <= p.most and (not big or r.large) group by 1")
def l03(s, d):
    rows = V.table(s, d, "orders").selectExpr("o_orderkey id", "o_totalprice * 100 >= 8388608 big", "case o_orderkey % 3 when 0 then 'fast' when 1 then 'balanced' else 'maximum' end preset")
    return rows.join(F.broadcast(C.rungs(s)), ["preset", "big"]).groupBy("id").agg(F.count("*").alias("rungs"))


@query("c16_round_trip")
def c16(s, d):
    """Every document through the fast preset's first rung and back."""
    return C.round_trip(V.corpus(s, d).select("file_id", "data"), "fast")


@query("c09_baseline_size")
def c09(s, d):
    return C.baseline(V.corpus(s, d).select("file_id", "data"))


@query("c17_envelope")
def c17(s, d):
    return C.envelopes(V.corpus(s, d).select("file_id", "filename", "data"))


@query("c23_reference_sizes")
def c23(s, d):
    return C.reference_sizes(V.corpus(s, d).select("file_id", "data"))


@query("l04_best_of_ladder")
def l04(s, d):
    return C.best_of_ladder(V.corpus(s, d).select("file_id", "data"), "balanced")


@query("l07_monotone")
def l07(s, d):
    rows = C.ladder_sizes(V.corpus(s, d).select("file_id", "data"))
    return rows.withColumn("ok", (F.col("maximum") <= F.col("balanced")) & (F.col("balanced") <= F.col("fast")))


@query("s17_archives")
def s17(s, d):
    """The benchmark's items in archives of ten, read back member by member."""
    items = V.table(s, d, "benchmark").selectExpr("item_id div 10 archive_id", "concat('item_', item_id, '.txt') path", "encode(coalesce(text, ''), 'UTF-8') data")
    return C.archive_members(C.archives(items))


def _pdfs(s, d):
    """A small PDF for each document: a page, its content, and a stream of near random bytes."""
    import random

    def build(frames):
        for f in frames:
            out = []
            for i, t in zip(f["doc_id"], f["text"], strict=True):
                text, noise = (t or "").encode(), random.Random(i).randbytes(400).replace(b"e", b"f")
                out.append(b"%PDF-1.4\n1 0 obj\n<< /Type /Page /Contents 2 0 R >>\nendobj\n2 0 obj\n<< /Length " + str(len(text)).encode() + b" >>\nstream\n" + text + b"\nendstream\nendobj\n3 0 obj\n<< /Subtype /Image /Filter /FlateDecode >>\nstream\r\n" + noise + b"\r\nendstream\nendobj\n")
            yield f.assign(file_id=f["doc_id"], data=out)[["file_id", "data"]]

    return V.table(s, d, "documents").select("doc_id", "text").mapInPandas(build, "file_id long, data binary")


def _zips(s, d):
    import io
    import zipfile

    def build(frames):
        for f in frames:
            out = []
            for t in f["text"]:
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(zipfile.ZipInfo("word/document.xml"), f"<w>{t or ''}</w>")
                    z.writestr(zipfile.ZipInfo("media/a.bin"), b"\0" * 100)
                out.append(held.getvalue())
            yield f.assign(file_id=f["doc_id"], data=out)[["file_id", "data"]]

    return V.table(s, d, "documents").select("doc_id", "text").mapInPandas(build, "file_id long, data binary")


@query("d01_pdf_objects", "select doc_id file_id, k.obj, k.kind, case k.obj when 2 then octet_length(encode(coalesce(text, '')))::bigint when 3 then 400 else 0 end length from documents cross join (values (1, 'object'), (2, 'page-content'), (3, 'image')) k(obj, kind) where coalesce(text, '') not like '%endstream%'")
def d01(s, d):
    return S.pdf_objects(_pdfs(s, d)).select("file_id", "obj", "kind", "length")


@query("d05_zip_members", "select doc_id file_id, n.name, case n.name when 'media/a.bin' then 100 else octet_length(encode(coalesce(text, '')))::bigint + 7 end uncompressed_size from documents cross join (values ('word/document.xml'), ('media/a.bin')) n(name)")
def d05(s, d):
    return S.zip_members(_zips(s, d)).select("file_id", "name", "uncompressed_size")


@query("d03_pdf_segments", "select doc_id file_id, 0::bigint faults, true ok from documents")
def d03(s, d):
    """Every file's tiling is exact."""
    files = _pdfs(s, d)
    return I.tiling_faults(S.segments(files), files.select("file_id", F.octet_length("data").alias("n_bytes"))).withColumn("ok", F.col("faults") == 0)


@query("d23_document_report")
def d23(s, d):
    files = _pdfs(s, d)
    return S.document_report(S.pdf_objects(files), S.segments(files))


@query("e06_symbols_account_for_all_bytes", "select doc_id file_id, true ok from documents")
def e06(s, d):
    """The symbols of every baseline container give back as many bytes as the file has, in bits within its length."""
    done = C.mapped(V.corpus(s, d).select("file_id", "data"), dictionary.compress_baseline, "container")
    rows = S.symbol_totals(done.select("file_id", F.octet_length("data").alias("n"), F.octet_length("container").alias("c"), (F.hex(F.substring("container", 5, 1)) == "00").alias("raw"), F.col("container").alias("data")))
    return rows.select("file_id", (F.col("raw") | ((F.col("made") == F.col("n")) & (F.col("bits") <= 8 * F.col("c")))).alias("ok"))


@query("e07_code_tree")
def e07(s, d):
    done = C.mapped(V.corpus(s, d).select("file_id", "data"), dictionary.compress_baseline, "container")
    return S.tree_nodes(S.code_tables(done.select("file_id", F.col("container").alias("data"))))


@query("d20_deflate_round_trip")
def d20(s, d):
    return S.deflate_round_trip(V.corpus(s, d))


@query("d19_component_containers")
def d19(s, d):
    return S.component_round_trip(_zips(s, d))


@query("l09_option_ablation")
def l09(s, d):
    return C.option_ablation(V.corpus(s, d).select("file_id", "data")).groupBy("variant").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query("s23_synthetic_files")
def s23(s, d):
    return synthetic.files(s, 5).groupBy("kind").agg(F.count("*").alias("files"), F.sum(F.octet_length("data")).alias("bytes"), F.min(F.sha2("data", 256)).alias("first_digest"))
