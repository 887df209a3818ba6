"""Queries over the byte corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mining as M
from ..sources import views as V
from .registry import query


def _bits(f: str, t: str) -> str:
    return f"case when {f} > 0 then least(24, greatest(1, length(bin(greatest({t} // greatest({f}, 1), 1))))) else 18 end"


HIST = "hx as (select doc_id file_id, hex(encode(coalesce(text, ''))) h from documents), hist as (select file_id, ('0x' || p)::int as byte, count(*) freq from (select file_id, unnest(regexp_extract_all(h, '[0-9A-F]{2}')) p from hx) group by all), tot as (select file_id, sum(freq)::bigint total from hist group by 1)"
COSTS = f"costs as (select t.file_id, b::int as byte, {_bits('coalesce(freq, 0)', 'total')}::int bits from tot t cross join range(256) r(b) left join hist h on h.file_id = t.file_id and h.byte = b)"
WORDS = "words as (select file_id, hex(encode(w)) pattern, count(*) freq from (select doc_id file_id, unnest(regexp_extract_all(text, '[0-9A-Z_a-z]{3,}')) w from documents) where length(w) <= 24 group by all having count(*) >= 4)"
PAIRS = "pairs as (select file_id, ('0x' || left(p, 2))::int a, ('0x' || right(p, 2))::int b, count(*) freq from (select file_id, unnest(list_transform(range(0, greatest(length(h) // 2 - 1, 0)), lambda i: substr(h, 2 * i + 1, 4))) p from hx) group by all)"
SCORES = f"{HIST}, {PAIRS}, scores as (select p.file_id, a, b, p.freq, (p.freq * (({_bits('x.freq', 'total')}) + ({_bits('y.freq', 'total')}) - ({_bits('p.freq', 'total')})) - 40)::bigint gain from pairs p join hist x on x.file_id = p.file_id and x.byte = a join hist y on y.file_id = p.file_id and y.byte = b join tot t on t.file_id = p.file_id where p.freq >= 4)"


# a04, a06, a07 and a08 take DuckDB minutes over whole texts, so they have no SQL; the tests compare them with brute force.


def _texts(s, d):
    return V.table(s, d, "documents").select(F.col("doc_id").alias("file_id"), "text")


def _candidates(s, d):
    return M.candidates(M.ngrams(V.corpus(s, d)), M.words(_texts(s, d)))


@query("a01_byte_histogram", f"with {HIST} select * from hist")
def a01(s, d):
    return M.byte_histogram(V.corpus(s, d))


@query("a01_byte_histogram_sql", f"with {HIST} select * from hist")
def a01_sql(s, d):
    return M.byte_histogram_sql(V.corpus(s, d))


@query("a02_code_length", f"with {HIST} select file_id, byte, ({_bits('freq', 'total')})::int bits from hist join tot using (file_id)")
def a02(s, d):
    h = M.byte_histogram(V.corpus(s, d))
    return h.join(h.groupBy("file_id").agg(F.sum("freq").alias("total")), "file_id").select("file_id", "byte", M.estimated_bits("freq", "total").alias("bits"))


@query("a03_literal_costs", f"with {HIST}, {COSTS} select * from costs")
def a03(s, d):
    return M.literal_costs(V.corpus(s, d))


@query("a04_ngrams")
def a04(s, d):
    return M.ngrams(V.corpus(s, d))


@query("a05_words", f"with {WORDS} select * from words")
def a05(s, d):
    return M.words(_texts(s, d))


@query("a06_candidates")
def a06(s, d):
    return _candidates(s, d)


@query("a07_gain")
def a07(s, d):
    return M.gains(_candidates(s, d), V.corpus(s, d))


@query("a08_admission")
def a08(s, d):
    return M.admitted(M.gains(_candidates(s, d), V.corpus(s, d)))


@query("a09_pair_counts", f"with {HIST}, {PAIRS} select * from pairs")
def a09(s, d):
    return M.pair_counts(V.corpus(s, d))


@query("a10_symbol_counts", f"with {HIST} select byte sid, sum(freq)::bigint freq, count(*) files from hist group by 1")
def a10(s, d):
    return M.byte_histogram(V.corpus(s, d)).groupBy(F.col("byte").alias("sid")).agg(F.sum("freq").alias("freq"), F.count("*").alias("files"))


@query("a11_merge_scores", f"with {SCORES} select * from scores")
def a11(s, d):
    c = V.corpus(s, d)
    return M.merge_scores(M.pair_counts(c), c)


@query("a12_merge_choice", f"with {SCORES}, r as (select *, row_number() over (partition by file_id order by gain desc, a, b) place from scores where gain > 0) select * from r where place <= 32")
def a12(s, d):
    c = V.corpus(s, d)
    return M.merge_choice(M.merge_scores(M.pair_counts(c), c))


@query("c04_kraft_sums")
def c04(s, d):
    """Every file's lengths fill the code space exactly (a file of one symbol: half of it)."""
    lengths = M.code_lengths(M.byte_histogram(V.corpus(s, d)))
    return lengths.groupBy("file_id").agg(F.sum(F.pow(F.lit(2.0), -F.col("len"))).alias("kraft"), F.max("len").alias("longest"), F.count("*").alias("symbols")).withColumn("ok", (F.col("kraft") == 1.0) | (F.col("symbols") == 1))


_TABLE = "select p_size % 40 file_id, p_partkey sid, 5 + p_partkey % 7 len from part"


@query("c06_canonical_codes", f"with t as ({_TABLE}), m as (select *, max(len) over (partition by file_id) most from t) select file_id, sid, len, floor(coalesce(sum(power(2, most - len)) over (partition by file_id order by len, sid rows between unbounded preceding and 1 preceding), 0) / power(2, most - len))::bigint code from m")
def c06(s, d):
    return M.canonical_codes(V.table(s, d, "part").selectExpr("p_size % 40 file_id", "p_partkey sid", "5 + p_partkey % 7 len"))
