"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, embedding, licenses, line_dedup, minhash, mixing, suffix_dedup, token_output, toxicity, warc
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1).drop("keep_bitmap")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """Where byte_bpe_50k.json is on this machine, and so on executors that are set up alike."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=200)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"), least_bytes=0)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_minhash_near_dedup, op3_license_scan, op4_token_output, op5_toxicity, op6_benchmark_decontamination, op7_repeated_bytes, op8_source_mixing, op9_warc, op10_embedding_near_dedup)}
def _license_sql() -> str:
    """Every template at every place where any of its words stands, without the index."""
    known = licenses.templates()
    tokens = ", ".join(f"({n}, {j}, '{w}', {t.key[0] <= j <= t.key[1]})" for n, t in enumerate(known) for j, w in enumerate(t.words))
    rules = ", ".join(f"({n}, {len(t.words)}, {t.needed}, {t.key[1] - t.key[0] + 1}, '{t.label}', {t.base})" for n, t in enumerate(known))
    return rf"""
with d as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w from documents),
v(t, j, word, in_key) as (values {tokens}), r(t, size, needed, key_size, label, base) as (values {rules}),
u as (select doc_id, unnest(range(len(w))) i, unnest(w) word from d),
m as (select doc_id, t, i - j as start, count(*) n, count(*) filter (in_key) k from u join v using (word) group by all),
f as (select m.*, r.* exclude t from m join r using (t) where n >= needed and k = key_size),
a as (select doc_id, count(*) filter (base) n_base, min(start) filter (base) first_word, max(start) filter (base) last_word,
    string_agg(distinct label, ',' order by label) filter (base) base_labels, string_agg(distinct label, ',' order by label) labels, max(n / size) score from f group by 1)
select d.doc_id, len(w)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word, last_word, coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, coalesce(score, 0.0)::double score
from d left join a on d.doc_id is not distinct from a.doc_id"""


_EMBEDDING_SQL = r"""
with recursive e as (select vec_id, embedding::double[] x from embeddings),
l as (select a.vec_id a, b.vec_id b from e a join e b on a.vec_id <> b.vec_id and list_cosine_similarity(a.x, b.x) >= 0.95),
r as (select vec_id node, vec_id reach from e union select r.node, l.b from r join l on r.reach = l.a)
select node vec_id, (select count(*) from l where a = node)::bigint n_links, min(reach) component_id, node = min(reach) as kept from r group by node"""

ORACLE_SQL: dict[str, str] = {
    "op2_minhash_near_dedup": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: hash(array_to_string(w[i:i+2], ' '))))) g from w where len(w) > 0),
c as (select *, min(doc_id) over (partition by g) rep from s),
r as (select doc_id rep, g, len(g) n from c where doc_id = rep),
e as (select rep, n, unnest(g) x from r),
p as (select a.rep a, b.rep b, count(*) shared, any_value(a.n) na, any_value(b.n) nb from e a join e b on a.x = b.x and a.rep < b.rep and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by 1, 2),
l as (select a, b from p where 100 * shared >= 85 * (na + nb - shared)),
u as (select a, b from l union all select b, a from l),
t as (select rep node, rep reach from r union select t.node, u.b from t join u on t.reach = u.a),
m as (select node, min(reach) component_id from t group by 1)
select d.doc_id, coalesce(len(g), 0)::bigint n_shingles, coalesce(component_id, d.doc_id) component_id, d.doc_id = coalesce(component_id, d.doc_id) as kept
from documents d left join c on c.doc_id = d.doc_id left join m on m.node = c.rep""",
    "op10_embedding_near_dedup": _EMBEDDING_SQL,
    "op3_license_scan": _license_sql(),
    "op1_line_dedup": r"""
with l as (select doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) i, unnest(string_split(coalesce(text, ''), chr(10))) line from documents),
k as (select doc_id, i, line, translate(regexp_replace(line, '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key from l),
f as (select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10)
select doc_id, count(*)::bigint n_lines, count(*) filter (f.key is not null)::bigint n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by i) filter (f.key is null), '')) kept_sha256
from k left join f on k.key = f.key group by doc_id""",
    "op9_warc": r"""
with p as (select page_id, encode(coalesce(html, '')) b from pages),
g as (select *, max(page_id) over (partition by sha256(b)) m from p),
x as (select *, ('0000' || list_reduce(list_transform(range(20), lambda j: bin(('0x' || substr(sha1(b), 2 * j + 1, 2))::int + 256)[2:]), lambda u, v: u || v)) bits from g)
select page_id, octet_length(b)::bigint payload_bytes,
    list_reduce(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_reduce(list_transform(range(5), lambda k: substr(bits, 5 + 5 * j + k, 1)::int), lambda u, v: 2 * u + v), 1)), lambda u, v: u || v) payload_digest,
    case when page_id = m then 'response' else 'revisit' end record_type, case when page_id = m then null else m end refers_to from x""",
    "op6_benchmark_decontamination": r"""
with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents where text is not null and doc_id is not null),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where text is not null and item_id is not null),
ds as (select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' '))) s from d where len(w) > 0),
bs as (select distinct item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' '))) s from b where len(w) > 0),
q as (select item_id, count(*) n_item from bs group by all),
m as (select doc_id, item_id, count(*) n_shared from ds join bs using (s) group by all)
select doc_id, item_id, n_shared, n_item, n_shared / n_item as containment from m join q using (item_id) where n_shared * 100 >= n_item * 80""",
    "op8_source_mixing": r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
o as (select *, coalesce(md5(doc_id::varchar), 'g') ord from d),
s as (select source, sum(size)::bigint source_size from d group by 1),
t as (select *, row_number() over (order by source nulls last) - 1 turn from s),
u as (select *, turn % 3 + 1 weight, source_size * 3 most from t),
v as (select *, (sum(source_size) over () - coalesce(sum(most) over (order by most / weight, turn rows between unbounded preceding and 1 preceding), 0))::double
    / (sum(weight) over (order by most / weight, turn rows between current row and unbounded following))::double as lev from u),
x as (select source, turn, source_size, least(most::double, weight * coalesce((select min_by(lev, struct_pack(r := most / weight, turn := turn)) from v where lev <= most / weight), 'infinity'::double)) target from v),
w as (select *, [-0.5, 0.0, 0.5][turn % 3 + 1]::double sl from x),
c as (select *, round(sl - coalesce(sum(target * sl) over () / nullif(sum(target) over (), 0), 0), 6) slope from w),
y as (select o.*, source_size, target, slope, coalesce(sum(size) over (partition by o.source order by ord, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint bef
    from o join c on o.source is not distinct from c.source),
z as (select *, case when source_size = 0 then 0 when target >= 3 * source_size then 3 else floor(target / source_size)::bigint end passes from y),
q as (select *, (passes + case when source_size > 0 and passes < 3 and bef + size / 2 <= target - passes * source_size then 1 else 0 end)::int copies, bef / greatest(target, 1.0) u from z)
select doc_id, size, source_size, target, (size * copies)::bigint taken, copies,
    case when copies > 0 then round(least(greatest(coalesce((slope - 1 + sqrt((1 - slope) * (1 - slope) + 4 * slope * u)) / nullif(2 * slope, 0.0), u), 0.0), 1.0), 6)::double + 0.0 end first_position from q""",
}
