"""Questions to the run log: lists, statistics, search, retention, reconciliation, quotas, rate limits."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOP_LEVEL = "operation = 'compress' and parent_history_id is null"


def scoped(rows: DataFrame, user_id: int | None) -> DataFrame:
    """Rows of one owner, or all rows where there is none."""
    return rows if user_id is None else rows.where(F.col("user_id") == user_id)


def history_list(runs: DataFrame, artifacts: DataFrame, batch_id: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Runs with whether their result is stored, newest first; with a limit, a page of them."""
    stored = artifacts.select(F.col("history_id").alias("id"), F.lit(True).alias("available"))
    rows = runs if batch_id is None else runs.where(F.col("batch_id") == batch_id)
    rows = rows.join(stored, "id", "left").withColumn("available", F.coalesce("available", F.lit(False)))
    return rows if limit is None else rows.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def _saved() -> list[Column]:
    total, out = F.sum("original_bytes"), F.sum("compressed_bytes")
    return [
        F.coalesce(total, F.lit(0)).alias("original_bytes"), F.coalesce(out, F.lit(0)).alias("compressed_bytes"), F.coalesce(total - out, F.lit(0)).alias("saved_bytes"),
        F.when(out > 0, total / out).otherwise(0.0).alias("overall_ratio"), F.when(total > 0, 100 * (1 - out / total)).otherwise(0.0).alias("saved_pct"),
    ]


def _quality() -> list[Column]:
    return [F.count_if("lossless_verified").alias("verified"), F.coalesce(F.round(F.avg("ratio"), 6), F.lit(0.0)).alias("avg_ratio")]


def history_stats(runs: DataFrame) -> DataFrame:
    """Totals over compress runs that are no archive children."""
    return runs.where(TOP_LEVEL).agg(F.count("*").alias("files"), *_saved(), *_quality())


def system_stats(runs: DataFrame, by_user: bool = False) -> DataFrame:
    """As history_stats, but with archive children, and with times, entropy and reference totals; zeros where there are no runs."""
    rows = runs.where("operation = 'compress'")
    group = rows.groupBy("user_id") if by_user else rows.groupBy()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    entropy = F.coalesce(F.sum("entropy_centibits") / F.count("entropy_centibits") / 100, F.lit(0.0))
    return group.agg(
        F.count("*").alias("files"), *_saved(), *_quality(), total("duration_ms").alias("total_ms"), entropy.alias("avg_entropy"), total("gzip_bytes").alias("gzip_bytes"), total("huffman_bytes").alias("huffman_bytes"),
    )


def extension(name: str = "filename") -> Column:
    """Lower-case text after the last dot; (none) without a dot or after a trailing one."""
    last = F.lower(F.substring_index(name, ".", -1))
    return F.when((F.instr(name, ".") > 0) & (last != ""), last).otherwise("(none)")


def by_extension(runs: DataFrame, top: int = 12) -> DataFrame:
    rows = runs.where("operation = 'compress'").groupBy(extension().alias("ext"))
    o, c = (F.coalesce(F.sum(x), F.lit(0)) for x in ("original_bytes", "compressed_bytes"))
    rows = rows.agg(F.count("*").alias("files"), o.alias("original_bytes"), c.alias("compressed_bytes"), (o - c).alias("saved_bytes"), F.coalesce(F.round(F.avg("ratio"), 6), F.lit(0.0)).alias("avg_ratio"))
    return rows.orderBy(F.desc("files"), "ext").limit(top)


def time_series(runs: DataFrame, newest: int = 60) -> DataFrame:
    """The newest compress runs, oldest first; a reference ratio is null where the reference has no size."""
    rows = runs.where("operation = 'compress'").orderBy(F.desc("id")).limit(newest)
    against = lambda c: (F.col("original_bytes") / F.nullif(F.col(c), F.lit(0)))
    return rows.select("id", "created_at", "ratio", against("gzip_bytes").alias("gzip_ratio"), against("huffman_bytes").alias("huffman_ratio")).orderBy("id")


SORTS = {"created_at": "created_at", "filename": "filename", "original": "original_bytes", "compressed": "compressed_bytes", "ratio": "ratio", "saved": "space_saved_pct", "duration": "duration_ms"}


@dataclass(frozen=True)
class SearchSpec:
    """A search: null parts don't restrict. text may hold % and _, and ignores case; unknown sorts fall back to time."""

    user_id: int | None = None
    text: str | None = None
    first_day: str | None = None
    last_day: str | None = None
    engine: str | None = None
    preset: str | None = None
    sort: str = "created_at"
    descending: bool = True
    page: int = 1
    per_page: int = 20

    @property
    def clamped(self) -> tuple[int, int]:
        return max(1, self.page), min(100, max(1, self.per_page))

    def filters(self) -> list[Column]:
        day = F.to_date("created_at")
        parts = [
            (self.user_id, lambda x: F.col("user_id") == x), (self.text, lambda x: F.col("filename").ilike(f"%{x}%")), (self.first_day, lambda x: day >= F.to_date(F.lit(x))),
            (self.last_day, lambda x: day <= F.to_date(F.lit(x))), (self.engine, lambda x: F.col("engine") == x), (self.preset, lambda x: F.col("preset") == x),
        ]
        return [f(x) for x, f in parts if x is not None]


def search(runs: DataFrame, spec: SearchSpec, artifacts: DataFrame | None = None) -> DataFrame:
    """A page of the runs that spec finds, each with the number of all of them and of pages, and with its stored result.

    artifacts has a row for a run at most; available, artifact_bytes and storage_key tell of it.
    """
    found = runs
    for condition in spec.filters():
        found = found.where(condition)
    page, per_page = spec.clamped
    key = F.col(SORTS.get(spec.sort, "created_at"))
    rows = found.orderBy(key.desc() if spec.descending else key.asc(), F.desc("id")).offset((page - 1) * per_page).limit(per_page)
    total = found.agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / per_page)).cast("long"))
    if artifacts is not None:
        stored = artifacts.select(F.col("history_id").alias("id"), F.col("byte_size").alias("artifact_bytes"), "storage_key")
        rows = rows.join(stored, "id", "left").withColumn("available", F.col("storage_key").isNotNull())
    return rows.crossJoin(F.broadcast(total))  # total is one row


def latest_by_digest(runs: DataFrame) -> DataFrame:
    """For each owner and container digest the newest compress run."""
    rows = runs.where("operation = 'compress'").groupBy("user_id", "sha256_container")
    return rows.agg(F.max("id").alias("id"), F.max_by("filename", "id").alias("filename"))


def distinct_engines(runs: DataFrame) -> DataFrame:
    return runs.where("engine <> ''").select("engine").distinct().orderBy("engine")


def user_rollup(users: DataFrame, runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Every user with the totals of their top-level runs and their stored bytes; zeros for those without."""
    own = runs.where(TOP_LEVEL).groupBy("user_id").agg(F.count("*").alias("files"), F.sum("original_bytes").alias("original_bytes"), F.sum("compressed_bytes").alias("compressed_bytes"))
    stored = stored_bytes(artifacts)
    rows = users.join(own.withColumnRenamed("user_id", "id"), "id", "left").join(stored.withColumnRenamed("user_id", "id"), "id", "left")
    return rows.select("id", "username", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("files", "original_bytes", "compressed_bytes", "stored_bytes")))


def stored_bytes(artifacts: DataFrame) -> DataFrame:
    return artifacts.groupBy("user_id").agg(F.sum("byte_size").alias("stored_bytes"))


def report(runs: DataFrame, newest: int = 1000) -> DataFrame:
    """Of the newest runs the top-level compress ones, then a TOTAL row. The limit comes before the filter."""
    rows = runs.orderBy(F.desc("created_at"), F.desc("id")).limit(newest).where(TOP_LEVEL)
    detail = rows.select("id", "filename", "original_bytes", "compressed_bytes", "ratio", "space_saved_pct", F.when(F.col("lossless_verified"), "yes").otherwise("no").alias("verified"))
    o, c = F.coalesce(F.sum("original_bytes"), F.lit(0)), F.coalesce(F.sum("compressed_bytes"), F.lit(0))
    total = rows.agg(
        F.lit(None).cast("long").alias("id"), F.lit("TOTAL").alias("filename"), o.alias("original_bytes"), c.alias("compressed_bytes"), F.when(c > 0, o / c).otherwise(0.0).alias("ratio"),
        F.when(o > 0, 100 * (1 - c / o)).otherwise(0.0).alias("space_saved_pct"), F.concat_ws("/", F.count_if("lossless_verified").cast("string"), F.count("*").cast("string")).alias("verified"),
    )
    return detail.unionByName(total)


COMPARED = ("original_bytes", "compressed_bytes", "ratio", "space_saved_pct", "duration_ms")


def compare(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (left_id, right_id) of one owner's runs: each metric on both sides, the difference, and its percentage of left (0 where that is 0)."""
    side = lambda s: runs.select(F.col("id").alias(f"{s}_id"), F.col("user_id").alias(f"{s}_user"), *(F.col(c).cast("double").alias(f"{s}_{c}") for c in COMPARED))
    both = pairs.join(side("left"), "left_id").join(side("right"), "right_id").where("left_user = right_user")
    metrics = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"left_{c}").alias("l"), F.col(f"right_{c}").alias("r")) for c in COMPARED)))
    rows = both.select("left_id", "right_id", metrics.alias("m")).select("left_id", "right_id", "m.metric", F.col("m.l").alias("left_value"), F.col("m.r").alias("right_value"))
    change = F.col("right_value") - F.col("left_value")
    return rows.withColumn("difference", change).withColumn("difference_pct", F.when(F.col("left_value") != 0, 100 * change / F.col("left_value")).otherwise(0.0))


def artifacts_with_history(artifacts: DataFrame, runs: DataFrame) -> DataFrame:
    return artifacts.join(runs.select(F.col("id").alias("history_id"), "filename", "operation"), "history_id")


def expired(artifacts: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Results older than so many days; none are where days isn't positive."""
    if days <= 0:
        return artifacts.limit(0)
    return artifacts.where(F.col("created_at") < F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))


def reconcile(artifacts: DataFrame, listing: DataFrame) -> DataFrame:
    """Results of which the store has no object, to be marked missing."""
    return artifacts.join(listing.select("storage_key").distinct(), "storage_key", "left_anti").withColumn("integrity_status", F.lit("missing"))


def quota_decisions(requests: DataFrame, limit: int) -> DataFrame:
    """requests (user_id, id, byte_size) in the order of id: accepted or refused; what was refused uses nothing."""

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        used, accepted, after = 0, [], []
        for n in rows["byte_size"]:
            ok = n <= limit - used
            used += n if ok else 0
            accepted.append(ok)
            after.append(used)
        return pd.DataFrame({"user_id": rows["user_id"], "id": rows["id"], "byte_size": rows["byte_size"], "accepted": accepted, "used_bytes": after})

    return requests.groupBy("user_id").applyInPandas(decide, "user_id long, id long, byte_size long, accepted boolean, used_bytes long")


def backfilled_parents(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(id, parent): compress rows without a result of their own get the newest stored run of their user and batch."""
    stored = artifacts.select(F.col("history_id").alias("id"))
    heads = runs.join(stored, "id", "left_semi").groupBy("user_id", "batch_id").agg(F.max("id").alias("parent"))
    return runs.where("operation = 'compress'").join(stored, "id", "left_anti").join(heads, ["user_id", "batch_id"]).select("id", "parent")


def without_group(runs: DataFrame, gone: DataFrame) -> DataFrame:
    """runs without those that gone (id) names, and without their children."""
    ids = gone.select("id").distinct()
    return runs.join(ids, "id", "left_anti").join(ids.withColumnRenamed("id", "parent_history_id"), "parent_history_id", "left_anti").select(*runs.columns)


def cascade(children: DataFrame, parents: DataFrame, key: str, parent_key: str = "id", set_null: bool = False) -> DataFrame:
    """children whose parent is among parents; the others go, or lose the reference."""
    known = parents.select(F.col(parent_key).alias(key)).distinct()
    if not set_null:
        return children.join(known, key, "left_semi").select(*children.columns)
    marked = children.join(known.withColumn("__known", F.lit(True)), key, "left")
    return marked.withColumn(key, F.when(F.col("__known"), F.col(key))).select(*children.columns)


def erased(audit: DataFrame, user_id: int, username: str) -> DataFrame:
    """audit without traces of a user: names and addresses blank, target=name replaced, also inside longer names."""
    mark = f"target={username}"
    mine = (F.col("user_id") == user_id) | (F.col("username") == username) | F.contains("detail", F.lit(mark))
    out = audit
    for c, value in (("username", F.lit("")), ("ip_address", F.lit("")), ("detail", F.replace("detail", F.lit(mark), F.lit("target=[erased]")))):
        out = out.withColumn("__" + c, F.when(mine, value).otherwise(F.col(c)))
    return out.select(*(F.col("__" + c).alias(c) if c in ("username", "ip_address", "detail") else c for c in audit.columns))


def trailing_failures(attempts: DataFrame, seconds: int = 300, limit: int = 5, key: tuple[str, ...] = ("user_id", "ip_address")) -> DataFrame:
    """Each failed attempt with how many its user had from its address within so many seconds up to it, itself included."""
    n = F.expr(f"count(*) over (partition by {', '.join(key)} order by ts range between interval {seconds} seconds preceding and current row)")
    return attempts.withColumn("failures", n).withColumn("limited", n >= limit)


def newest_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Point updates as last write wins."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def insert_absent(existing: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return existing.unionByName(rows.join(existing.select(key), key, "left_anti").select(*existing.columns))


def queue_totals(results: DataFrame) -> DataFrame:
    """results (status, operation, original_bytes, compressed_bytes): what a batch's table shows in its last line."""
    ok = F.col("status") == "ok"
    out = F.when(F.col("operation") == "compress", F.col("compressed_bytes")).otherwise(F.col("original_bytes"))
    o, c = F.coalesce(F.sum(F.when(ok, F.col("original_bytes"))), F.lit(0)), F.coalesce(F.sum(F.when(ok, out)), F.lit(0))
    return results.agg(o.alias("original_bytes"), c.alias("output_bytes"), F.count_if(~ok).alias("failures"), F.when(c > 0, o / c).otherwise(0.0).alias("ratio"), F.when(o > 0, 100 * (1 - c / o)).otherwise(0.0).alias("saved_pct"))


def verification_state(verified: str, digest: str) -> Column:
    """What is shown of a run: one of four outcomes."""
    return F.when(F.col(digest).isNull(), "no reference").when(F.col(verified).isNull(), "not checked").when(F.col(verified), "verified").otherwise("mismatch")


def digest_status(restored: DataFrame, runs: DataFrame) -> DataFrame:
    """restored (key, user_id, sha256_container, actual_bytes): sizes and digests against the newest run that wrote the container."""
    known = latest_by_digest(runs).join(runs.select("id", "original_bytes"), "id").select("user_id", "sha256_container", F.col("original_bytes").alias("declared_bytes"))
    rows = restored.join(known, ["user_id", "sha256_container"], "left")
    status = F.when(F.col("declared_bytes").isNull(), "no_reference").when(F.col("declared_bytes") == F.col("actual_bytes"), "match").otherwise("mismatch")
    return rows.withColumn("status", status)
