"""Queries over benchmark results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import experiment as X
from ..sources import views as V
from .registry import query

T, C = V.TRIALS_SQL, V.CODECS_SQL
CODECS = ["own", "gzip9", "bzip2", "lzma"]
PRESETS = ["fast", "balanced", "maximum"]
S = f"{T}, sizes as (select path, preset, min(compressed_bytes) size from trials group by all)"
P = f"{S}, pairs as (select a.path, a.preset left_preset, b.preset right_preset, a.size left_size, b.size right_size, b.size - a.size difference from sizes a join sizes b on a.path = b.path and a.preset < b.preset)"
K = f"{P}, k as (select left_preset, right_preset, difference, (rank() over (partition by left_preset, right_preset order by abs(difference)) + (count(*) over (partition by left_preset, right_preset, abs(difference)) - 1) / 2)::double r from pairs where difference <> 0)"


def _sizes(s, d):
    return V.trials(s, d).groupBy("path", "preset").agg(F.min("compressed_bytes").alias("size"))


@query("x01_trial_summary", f"""with {T}, g as (select path, preset, count(*) trials, count(*) filter (status = 'ok') ran, count(*) filter (status = 'ok' and sha256_equal) valid,
 count(distinct compressed_bytes) filter (status = 'ok' and sha256_equal) sizes, max(original_bytes) original_bytes, coalesce(max(compressed_bytes) filter (status = 'ok' and sha256_equal), 0) compressed_bytes,
 median(compression_ms) filter (status = 'ok' and sha256_equal) median_ms, coalesce(bool_and(sha256_equal) filter (status = 'ok'), false) all_equal from trials group by all)
 select *, case when ran = 0 then 'failed' when valid < ran or sizes <> 1 then 'invalid' else 'ok' end status, sizes = 1 deterministic, original_bytes / greatest(compressed_bytes, 1) ratio, 100 * (1 - compressed_bytes / greatest(original_bytes, 1)) saved_pct from g""")
def x01(s, d):
    return X.trial_summary(V.trials(s, d))


@query("x03_wilcoxon_ranks", f"with {K} select left_preset, right_preset, count(*) n, sum(r) filter (difference > 0) w_plus, sum(r) filter (difference < 0) w_minus, (sum(r) filter (difference > 0) - sum(r) filter (difference < 0)) / sum(r) effect, sum(r * r) squares from k group by all")
def x03(s, d):
    return X.wilcoxon(X.preset_pairs(_sizes(s, d)))


@query("x03_wilcoxon_p")
def x03_p(s, d):
    return X.wilcoxon_p(X.preset_pairs(_sizes(s, d)))


@query("x04_holm", """with t as (select p_brand family, p_partkey id, (p_partkey % 997) / 9970.0 p from part), o as (select *, row_number() over (partition by family order by p, id) i, count(*) over (partition by family) m from t)
 select family, id, p, max(least(1.0, (m - i + 1) * p)) over (partition by family order by p, id rows unbounded preceding) adjusted from o""")
def x04(s, d):
    p = (F.col("p_partkey") % 997) / F.lit(9970.0)
    return X.holm(V.table(s, d, "part").select(F.col("p_brand").alias("family"), F.col("p_partkey").alias("id"), p.alias("p")), "family")


@query("x05_preset_pairs", f"with {P} select left_preset, right_preset, count(*) n, median(left_size) median_left_size, median(right_size) median_right_size, median(difference) median_difference from pairs group by all")
def x05(s, d):
    return X.pair_medians(X.preset_pairs(_sizes(s, d)))


_TOT = ", ".join(f"sum({c})::bigint {c}" for c in ("orig_bytes", *CODECS)) + ", " + ", ".join(f"100 * (1 - sum({c})::bigint / sum(orig_bytes)::bigint) {c}_saved" for c in CODECS)


@query("x06_codec_totals", f"with {C} select coalesce(corpus, 'TOTAL') corpus, count(*) files, {_TOT} from codec_sizes group by rollup (corpus)")
def x06(s, d):
    return X.codec_totals(V.codec_sizes(s, d), CODECS)


@query("x07_wins", f"with {C}, u as (select corpus, case least(own, gzip9, bzip2, lzma) when own then 'own' when gzip9 then 'gzip9' when bzip2 then 'bzip2' else 'lzma' end codec from codec_sizes) select corpus, codec, count(*) wins from u group by all")
def x07(s, d):
    return X.wins(V.codec_sizes(s, d), CODECS)


@query("x08_join_tables", f"""with {C}, l as (select corpus, file, gzip9 from codec_sizes), r as (select corpus, file, own from codec_sizes where orig_bytes % 7 <> 0), j as (select l.corpus, count(own) files, sum(gzip9) filter (own is not null)::bigint gzip9, sum(own)::bigint own, count(*) filter (own is null) unmatched from l left join r using (corpus, file) group by 1)
 select *, 100 * (1 - own / gzip9) improvement_pct from j""")
def x08(s, d):
    rows = V.codec_sizes(s, d)
    return X.joined_results(rows, rows.where("orig_bytes % 7 <> 0"), "gzip9", "own")


@query("x09_next_preset", f"with {S}, o as (select *, list_position(['fast', 'balanced', 'maximum'], preset) turn from sizes) select a.preset, b.preset next_preset, count(*) filter (a.size > b.size) wins, count(*) filter (a.size = b.size) ties, count(*) filter (a.size < b.size) worse, sum(a.size - b.size)::bigint bytes_saved from o a join o b on a.path = b.path and b.turn = a.turn + 1 group by all")
def x09(s, d):
    return X.next_preset(_sizes(s, d), PRESETS)


@query("x10_filtered_map_load", f"with {S} select c.path, f.size from (select distinct path from trials) c left join sizes f on f.path = c.path and f.preset = 'balanced'")
def x10(s, d):
    files = V.trials(s, d).select("path").distinct()
    return files.join(_sizes(s, d).where("preset = 'balanced'").select("path", "size"), "path", "left")


@query("x11_before_after", f"with {S}, w as (select path, sum(size) filter (preset = 'fast')::bigint fast, sum(size) filter (preset = 'maximum')::bigint maximum from sizes group by 1) select *, 100 * (maximum - fast) / fast change_pct from w where fast is not null and maximum is not null")
def x11(s, d):
    return X.before_after(_sizes(s, d), "path", "preset", "size", "fast", "maximum")


@query("x12_upper_median", f"with {C} select corpus, list_sort(list(own))[len(list(own)) // 2 + 1] upper_median from codec_sizes group by 1")
def x12(s, d):
    return V.codec_sizes(s, d).groupBy("corpus").agg(X.upper_median("own").alias("upper_median"))


@query("x14_directions", f"with {C} select count(*) filter (own < gzip9) smaller, count(*) filter (own > gzip9) larger, count(*) filter (own = gzip9) unchanged, sum(gzip9)::bigint total_before, sum(own)::bigint total_after from codec_sizes")
def x14(s, d):
    return X.directions(V.codec_sizes(s, d), "gzip9", "own")


@query("x15_transform_totals", f"with {C} select corpus, sum(lzma)::bigint plain, sum(own)::bigint transformed, count(*) filter (own < lzma) wins, 100 * (sum(lzma) - sum(own))::bigint / sum(orig_bytes)::bigint points from codec_sizes group by 1")
def x15(s, d):
    return V.codec_sizes(s, d).groupBy("corpus").agg(F.sum("lzma").alias("plain"), F.sum("own").alias("transformed"), F.count_if(F.col("own") < F.col("lzma")).alias("wins"), (100 * (F.sum("lzma") - F.sum("own")) / F.sum("orig_bytes")).alias("points"))


@query("l08_ablation", f"with {C} select corpus, count(*) files, (sum(gzip9) - sum(own))::bigint gzip9_cost, 100 * (sum(gzip9) - sum(own))::bigint / (sum(orig_bytes) - sum(own))::bigint gzip9_share, (sum(bzip2) - sum(own))::bigint bzip2_cost, 100 * (sum(bzip2) - sum(own))::bigint / (sum(orig_bytes) - sum(own))::bigint bzip2_share from codec_sizes group by 1")
def l08(s, d):
    return X.ablation(V.codec_sizes(s, d), "own", ["gzip9", "bzip2"])
