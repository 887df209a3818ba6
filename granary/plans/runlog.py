"""Queries over the run log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import runlog as R
from ..sources import views as V
from .registry import query

H, A, U, T = V.HISTORY_SQL, V.ARTIFACTS_SQL, V.USERS_SQL, V.ATTEMPTS_SQL
AS_OF = datetime(1996, 1, 1)
TOP = "operation = 'compress' and parent_history_id is null"
SAVED = """coalesce(sum(original_bytes), 0)::bigint original_bytes, coalesce(sum(compressed_bytes), 0)::bigint compressed_bytes, coalesce(sum(original_bytes) - sum(compressed_bytes), 0)::bigint saved_bytes,
 case when sum(compressed_bytes) > 0 then sum(original_bytes)::bigint / sum(compressed_bytes)::bigint else 0.0 end overall_ratio,
 case when sum(original_bytes) > 0 then 100 * (1 - sum(compressed_bytes)::bigint / sum(original_bytes)::bigint) else 0.0 end saved_pct"""


def _both(s, d):
    runs = V.history(s, d)
    return runs, V.artifacts(runs)


@query("r01_append_run", f"with {H} select id, original_bytes, compressed_bytes, ratio, space_saved_pct from history")
def r01(s, d):
    return V.history(s, d).select("id", "original_bytes", "compressed_bytes", "ratio", "space_saved_pct")


@query("r02_history_list", f"with {H}, {A} select h.id, filename, a.history_id is not null available from history h left join artifacts a on a.history_id = h.id order by h.created_at desc, h.id desc limit 50 offset 20")
def r02(s, d):
    return R.history_list(*_both(s, d), limit=50, offset=20).select("id", "filename", "available")


QUALITY = "count(*) filter (lossless_verified) verified, coalesce(round(avg(ratio), 6), 0.0) avg_ratio"


@query("r03_history_stats", f"with {H} select count(*) files, {SAVED}, {QUALITY} from history where {TOP}")
def r03(s, d):
    return R.history_stats(V.history(s, d))


_R04 = f"count(*) files, {SAVED}, {QUALITY}, sum(duration_ms)::bigint total_ms, sum(entropy_centibits)::bigint / count(*) / 100 avg_entropy, sum(gzip_bytes)::bigint gzip_bytes, sum(huffman_bytes)::bigint huffman_bytes from history where operation = 'compress'"


@query("r04_system_stats", f"with {H} select {_R04}")
def r04(s, d):
    return R.system_stats(V.history(s, d))


@query("r04_user_stats", f"with {H} select user_id, {_R04} group by user_id")
def r04_user(s, d):
    return R.system_stats(V.history(s, d), by_user=True)


_EXT = "case when instr(filename, '.') > 0 and not ends_with(filename, '.') then lower(list_last(string_split(filename, '.'))) else '(none)' end"


@query("r05_by_extension", f"with {H} select {_EXT} ext, count(*) files, sum(original_bytes)::bigint original_bytes, sum(compressed_bytes)::bigint compressed_bytes, sum(original_bytes - compressed_bytes)::bigint saved_bytes, round(avg(ratio), 6) avg_ratio from history where operation = 'compress' group by 1 order by files desc, ext limit 12")
def r05(s, d):
    return R.by_extension(V.history(s, d))


@query("r06_time_series", f"with {H}, n as (select * from history where operation = 'compress' order by id desc limit 60) select id, created_at, ratio, original_bytes / nullif(gzip_bytes, 0) gzip_ratio, original_bytes / nullif(huffman_bytes, 0) huffman_ratio from n")
def r06(s, d):
    return R.time_series(V.history(s, d))


_SPEC = R.SearchSpec(text="FILE_1", first_day="1993-01-01", last_day="1997-12-31", preset="fast", sort="saved", page=2, per_page=500)


@query("r07_search", f"""with {H}, {A}, f as (select * from history where filename ilike '%FILE_1%' and created_at::date >= '1993-01-01' and created_at::date <= '1997-12-31' and preset = 'fast')
 select f.id, filename, space_saved_pct, (select count(*) from f) total, greatest(1, ceil((select count(*) from f) / 100))::bigint pages, byte_size artifact_bytes, a.history_id is not null available from f left join artifacts a on a.history_id = f.id order by space_saved_pct desc, f.id desc limit 100 offset 100""")
def r07(s, d):
    runs, kept = _both(s, d)
    return R.search(runs, _SPEC, kept).select("id", "filename", "space_saved_pct", "total", "pages", "artifact_bytes", "available")


@query("r08_page_clamp", "select o_orderkey id, greatest(1, o_orderkey % 7 - 3)::bigint page, least(100, greatest(1, o_orderkey % 200 - 20))::bigint per_page from orders")
def r08(s, d):
    i = F.col("o_orderkey")
    return V.table(s, d, "orders").select(i.alias("id"), F.greatest(F.lit(1), i % 7 - 3).cast("long").alias("page"), F.least(F.lit(100), F.greatest(F.lit(1), i % 200 - 20)).cast("long").alias("per_page"))


@query("r09_point_lookups", f"with {H}, {U} select h.id, filename, username from history h join users u on u.id = h.user_id where h.id = 42 or (h.user_id = 7 and operation = 'compress') or username = 'Customer#000000011'")
def r09(s, d):
    rows = V.history(s, d).join(V.users(s, d).select(F.col("id").alias("user_id"), "username"), "user_id")
    return rows.where("id = 42 or (user_id = 7 and operation = 'compress') or username = 'Customer#000000011'").select("id", "filename", "username")


@query("r10_latest_by_digest", f"with {H} select user_id, sha256_container, max(id) id, max_by(filename, id) filename from history where operation = 'compress' group by all")
def r10(s, d):
    return R.latest_by_digest(V.history(s, d))


@query("r11_distinct_engines", f"with {H} select distinct engine from history where engine <> ''")
def r11(s, d):
    return R.distinct_engines(V.history(s, d))


@query("r12_user_rollup", f"""with {H}, {A}, {U}, r as (select user_id, count(*) files, sum(original_bytes)::bigint o, sum(compressed_bytes)::bigint c from history where {TOP} group by 1), b as (select user_id, sum(byte_size)::bigint n from artifacts group by 1)
 select u.id, username, coalesce(files, 0) files, coalesce(o, 0)::bigint original_bytes, coalesce(c, 0)::bigint compressed_bytes, coalesce(n, 0)::bigint stored_bytes from users u left join r on r.user_id = u.id left join b on b.user_id = u.id""")
def r12(s, d):
    return R.user_rollup(V.users(s, d), *_both(s, d))


_REPORT = f"""with {H}, n as (select * from history order by created_at desc, id desc limit 1000), t as (select * from n where {TOP})
 select id, filename, original_bytes, compressed_bytes, ratio, space_saved_pct, case when lossless_verified then 'yes' else 'no' end verified from t union all
 select null, 'TOTAL', sum(original_bytes)::bigint, sum(compressed_bytes)::bigint, case when sum(compressed_bytes) > 0 then sum(original_bytes)::bigint / sum(compressed_bytes)::bigint else 0.0 end, case when sum(original_bytes) > 0 then 100 * (1 - sum(compressed_bytes)::bigint / sum(original_bytes)::bigint) else 0.0 end, count(*) filter (lossless_verified) || '/' || count(*) from t"""


@query("r13_report_with_totals", _REPORT)
def r13(s, d):
    return R.report(V.history(s, d))


@query("s07_report_csv_lines", f"select concat_ws(',', coalesce(id::varchar, ''), filename, original_bytes, compressed_bytes, verified) line from ({_REPORT})")
def s07(s, d):
    return R.report(V.history(s, d)).select(F.concat_ws(",", F.coalesce(F.col("id").cast("string"), F.lit("")), "filename", F.col("original_bytes").cast("string"), F.col("compressed_bytes").cast("string"), "verified").alias("line"))


@query("r14_compare", f"""with {H}, p as (select a.id left_id, b.id right_id, a, b from history a join history b on b.id = a.id + 1 and a.user_id = b.user_id), m as (select left_id, right_id, unnest([
 {{'metric': 'original_bytes', 'l': a.original_bytes::double, 'r': b.original_bytes::double}}, {{'metric': 'compressed_bytes', 'l': a.compressed_bytes::double, 'r': b.compressed_bytes::double}}, {{'metric': 'ratio', 'l': a.ratio, 'r': b.ratio}},
 {{'metric': 'space_saved_pct', 'l': a.space_saved_pct, 'r': b.space_saved_pct}}, {{'metric': 'duration_ms', 'l': a.duration_ms::double, 'r': b.duration_ms::double}}]) x from p)
 select left_id, right_id, x.metric metric, x.l left_value, x.r right_value, x.r - x.l difference, case when x.l <> 0 then 100 * (x.r - x.l) / x.l else 0.0 end difference_pct from m""")
def r14(s, d):
    runs = V.history(s, d)
    return R.compare(runs, runs.select(F.col("id").alias("left_id"), (F.col("id") + 1).alias("right_id")))


@query("r15_stored_bytes", f"with {H}, {A} select user_id, sum(byte_size)::bigint stored_bytes from artifacts group by 1")
def r15(s, d):
    return R.stored_bytes(_both(s, d)[1])


@query("r16_artifact_with_history", f"with {H}, {A} select storage_key, filename, operation, byte_size from artifacts a join history h on h.id = a.history_id")
def r16(s, d):
    runs, kept = _both(s, d)
    return R.artifacts_with_history(kept, runs).select("storage_key", "filename", "operation", "byte_size")


@query("r17_artifact_listing", f"with {H}, {A} select history_id, storage_key from artifacts where user_id % 50 = 3 order by history_id")
def r17(s, d):
    return _both(s, d)[1].where("user_id % 50 = 3").select("history_id", "storage_key").orderBy("history_id")


@query("r18_expired", f"with {H}, {A} select history_id from artifacts where created_at < timestamp '1996-01-01' - interval 365 days")
def r18(s, d):
    return R.expired(_both(s, d)[1], AS_OF, 365).select("history_id")


@query("r19_reconcile_store", f"with {H}, {A} select storage_key, 'missing' integrity_status from artifacts where history_id % 23 = 0")
def r19(s, d):
    kept = _both(s, d)[1]
    return R.reconcile(kept, kept.where("history_id % 23 <> 0")).select("storage_key", "integrity_status")


@query("r20_quota_decisions", f"""with recursive {H}, {A}, q as (select user_id, history_id id, byte_size, row_number() over (partition by user_id order by history_id) n from artifacts),
 r as (select *, byte_size <= 20000000 accepted, case when byte_size <= 20000000 then byte_size else 0 end used from q where n = 1
  union all select q.*, q.byte_size <= 20000000 - r.used, r.used + case when q.byte_size <= 20000000 - r.used then q.byte_size else 0 end from q join r on q.user_id = r.user_id and q.n = r.n + 1)
 select user_id, id, byte_size, accepted, used::bigint used_bytes from r""")
def r20(s, d):
    return R.quota_decisions(_both(s, d)[1].select("user_id", F.col("history_id").alias("id"), "byte_size"), limit=20_000_000)


@query("r20_quota_simple", f"with {H}, {A} select user_id, sum(byte_size)::bigint used, sum(byte_size) > 20000000 refused from artifacts group by 1")
def r20_simple(s, d):
    return _both(s, d)[1].groupBy("user_id").agg(F.sum("byte_size").alias("used"), (F.sum("byte_size") > 20_000_000).alias("refused"))


@query("r21_backfill_parents", f"with {H}, {A}, m as (select h.user_id, batch_id, max(h.id) parent from history h join artifacts a on a.history_id = h.id group by all) select h.id, parent from history h join m using (user_id, batch_id) where operation = 'compress' and h.id not in (select history_id from artifacts)")
def r21(s, d):
    return R.backfilled_parents(*_both(s, d))


@query("r22_cascading_delete", f"with {H} select id from history where id % 100 <> 0 and coalesce(parent_history_id % 100, 1) <> 0")
def r22(s, d):
    runs = V.history(s, d)
    return R.without_group(runs, runs.where("id % 100 = 0")).select("id")


def _audit(s, d):
    e = V.table(s, d, "events")
    name = F.concat(F.lit("user"), F.col("user_id").cast("string"))
    return e.select(F.col("event_id").alias("id"), "user_id", name.alias("username"), F.col("event_type").alias("event"), F.concat(F.lit("target=user"), (F.col("event_id") % 40).cast("string")).alias("detail"), F.concat(F.lit("10.0.0."), (F.col("event_id") % 250).cast("string")).alias("ip_address"), F.col("ts").alias("created_at"))


_AUDIT = "audit as (select event_id id, user_id, 'user' || user_id username, event_type event, 'target=user' || event_id % 40 detail, '10.0.0.' || event_id % 250 ip_address, ts created_at from events)"


@query("r23_account_erasure", f"with {_AUDIT}, m as (select *, user_id = 3 or username = 'user3' or contains(detail, 'target=user3') mine from audit) select id, user_id, case when mine then '' else username end username, event, case when mine then replace(detail, 'target=user3', 'target=[erased]') else detail end detail, case when mine then '' else ip_address end ip_address from m")
def r23(s, d):
    return R.erased(_audit(s, d), 3, "user3").drop("created_at")


@query("r24_audit_newest", f"with {_AUDIT} select id, event, detail from audit order by id desc limit 300")
def r24(s, d):
    return _audit(s, d).orderBy(F.desc("id")).limit(300).select("id", "event", "detail")


@query("r25_trailing_failures", f"with {T} select event_id, user_id, ip_address, count(*) over (partition by user_id, ip_address order by ts range between interval 300 seconds preceding and current row) failures, count(*) over (partition by user_id, ip_address order by ts range between interval 300 seconds preceding and current row) >= 5 limited from attempts")
def r25(s, d):
    return R.trailing_failures(V.attempts(s, d)).select("event_id", "user_id", "ip_address", "failures", "limited")


@query("r26_failures_since_success", "with e as (select *, max(case when event_type = 'signup' then event_id end) over (partition by user_id order by event_id) cleared from events where event_type in ('error', 'signup')) select user_id, coalesce(cleared, -1) cleared, count(*) failures from e where event_type = 'error' group by all")
def r26(s, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = V.table(s, d, "events").where("event_type in ('error', 'signup')").withColumn("cleared", F.max(F.when(F.col("event_type") == "signup", F.col("event_id"))).over(w))
    return e.where("event_type = 'error'").groupBy("user_id", F.coalesce("cleared", F.lit(-1).cast("long")).alias("cleared")).agg(F.count("*").alias("failures"))


@query("r27_insert_absent", "select n_nationkey id, n_name name from nation where n_nationkey < 15 union all select n_nationkey, upper(n_name) || '!' from nation where n_nationkey >= 15")
def r27(s, d):
    n = V.table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return R.insert_absent(n.where("id < 15"), n.where("id >= 5").withColumn("name", F.concat(F.upper("name"), F.lit("!"))), "id")


@query("r28_last_write_wins", "select user_id, max(event_id) event_id, max_by(event_type, event_id) event_type from events group by 1")
def r28(s, d):
    return R.newest_per_key(V.table(s, d, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type")


@query("r29_batches", f"with {H} select batch_id, count(*) files, sum(original_bytes)::bigint original_bytes from history group by 1")
def r29(s, d):
    return V.history(s, d).groupBy("batch_id").agg(F.count("*").alias("files"), F.sum("original_bytes").alias("original_bytes"))


@query("r30_queue_totals", f"with {H}, q as (select *, id % 19 <> 0 ok, case when operation = 'compress' then compressed_bytes else original_bytes end outb from history), t as (select sum(original_bytes) filter (ok)::bigint o, sum(outb) filter (ok)::bigint c, count(*) filter (not ok) f from q) select o original_bytes, c output_bytes, f failures, o / c ratio, 100 * (1 - c / o) saved_pct from t")
def r30(s, d):
    return R.queue_totals(V.history(s, d).withColumn("status", F.when(F.col("id") % 19 == 0, "failed").otherwise("ok")))


@query("r31_client_sort", f"with {H} select id, row_number() over (order by try_cast(nullif(regexp_extract(filename, '[0-9]+'), '') as bigint) nulls first, filename, id) place from history")
def r31(s, d):
    number = F.expr("try_cast(nullif(regexp_extract(filename, '[0-9]+', 0), '') as bigint)")
    rows = V.history(s, d).withColumn("number", number)
    return rows.select("id", F.row_number().over(Window.orderBy(F.col("number").asc_nulls_first(), "filename", "id")).cast("long").alias("place"))


@query("r32_result_cache", f"with {H}, n as (select id, user_id, row_number() over (partition by user_id order by id desc) r from history) select user_id, id from n where r <= 60")
def r32(s, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("id"))
    return V.history(s, d).withColumn("r", F.row_number().over(w)).where("r <= 60").select("user_id", "id")


@query("r33_owner_scope", f"with {H} select count(*) files, {SAVED}, count(*) filter (lossless_verified) verified, round(avg(ratio), 6) avg_ratio from history where {TOP} and user_id = 10")
def r33(s, d):
    """As its SQL has it, the average of no runs is null here."""
    return R.history_stats(R.scoped(V.history(s, d), 10)).withColumn("avg_ratio", F.when(F.col("files") > 0, F.col("avg_ratio")))


@query("r34_verification_state", f"with {H} select id, case when id % 5 = 0 then 'no reference' when id % 7 = 0 then 'not checked' when lossless_verified then 'verified' else 'mismatch' end state from history")
def r34(s, d):
    rows = V.history(s, d).withColumn("digest", F.when(F.col("id") % 5 != 0, F.col("sha256_container"))).withColumn("ok", F.when(F.col("id") % 7 != 0, F.col("lossless_verified")))
    return rows.select("id", R.verification_state("ok", "digest").alias("state"))


@query("r40_foreign_keys", f"with {H} select id, case when parent_history_id % 8 = 0 then parent_history_id end parent_history_id from history where user_id % 2 = 0")
def r40(s, d):
    runs = V.history(s, d)
    kept = R.cascade(runs, V.users(s, d).where("id % 2 = 0"), "user_id")
    return R.cascade(kept, runs.where("id % 8 = 0"), "parent_history_id", set_null=True).select("id", "parent_history_id")


@query("e22_decompress_report", f"""with {H}, k as (select user_id, sha256_container, max_by(original_bytes, id) declared_bytes from history where operation = 'compress' group by all), r as (select id k, user_id, case when id % 6 = 0 then 'unknown' else sha256_container end sha256_container, original_bytes actual_bytes from history)
 select r.k as key, actual_bytes, declared_bytes, case when declared_bytes is null then 'no_reference' when declared_bytes = actual_bytes then 'match' else 'mismatch' end status from r left join k using (user_id, sha256_container)""")
def e22(s, d):
    runs = V.history(s, d)
    restored = runs.select(F.col("id").alias("key"), "user_id", F.when(F.col("id") % 6 == 0, "unknown").otherwise(F.col("sha256_container")).alias("sha256_container"), F.col("original_bytes").alias("actual_bytes"))
    return R.digest_status(restored, runs).select("key", "actual_bytes", "declared_bytes", "status")


@query("p12_dashboard", f"with {H}, n as (select * from history order by created_at desc, id desc limit 10) select n.id, n.filename, (select count(*) from history where {TOP}) files from n")
def p12(s, d):
    runs, kept = _both(s, d)
    return R.history_list(runs, kept, limit=10).crossJoin(F.broadcast(R.history_stats(runs).select("files"))).select("id", "filename", "files")  # one row


@query("p15_login_decisions", f"with {T}, w as (select event_id, count(*) over (partition by user_id, ip_address order by ts range between interval 3600 seconds preceding and current row) n from attempts) select case when n >= 2 then 'limited' else 'asked' end decision, count(*) attempts from w group by 1")
def p15(s, d):
    rows = R.trailing_failures(V.attempts(s, d), seconds=3600, limit=2)
    return rows.groupBy(F.when(F.col("limited"), "limited").otherwise("asked").alias("decision")).agg(F.count("*").alias("attempts"))
