"""Runs over time: previous and latest run, retention, changes of pages and policies, stored copies, due stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storegrain.sources.tables import merge_buckets


def to_prune(runs: DataFrame, store: list[str], keep: int) -> DataFrame:
    """Runs beyond the newest `keep` of each store. runs: store, run_id, started_at."""
    w = Window.partitionBy(*store).orderBy(F.desc("started_at"), F.desc("run_id"))
    return runs.withColumn("k", F.row_number().over(w)).filter(F.col("k") > keep)


def expired(runs: DataFrame, store: list[str], now: Column, days: int | None = None, keep: int | None = None) -> DataFrame:
    """Runs that are neither young enough nor among the newest; without any policy none.

    A run is as old as the time since its finished_at, where it has one, else since its started_at, to the second.
    """
    if days is None and keep is None:
        return runs.limit(0)
    w = Window.partitionBy(*store).orderBy(F.desc("started_at"), F.desc("run_id"))
    ended = F.coalesce("finished_at", "started_at") if "finished_at" in runs.columns else F.col("started_at")
    young = F.lit(False) if days is None else ended >= now.cast("timestamp") - F.make_dt_interval(F.lit(days))
    new = F.lit(False) if keep is None else F.row_number().over(w) <= keep
    return runs.withColumn("kept", young | new).filter("not kept").drop("kept")


def over_cap(entries: DataFrame, key: str, cap: int) -> DataFrame:
    """Entries that are not among the newest `cap` of all; no window over the whole table."""
    newest = entries.orderBy(F.desc("created_at"), F.desc(key)).limit(cap).select(key)
    return entries.join(newest, key, "left_anti")


def with_previous(runs: DataFrame, store: list[str]) -> DataFrame:
    w = Window.partitionBy(*store).orderBy("started_at", "run_id")
    return runs.withColumn("previous", F.lag("run_id").over(w))


def latest(runs: DataFrame, store: list[str]) -> DataFrame:
    return runs.groupBy(*store).agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"), F.max("started_at").alias("started_at"))


def upsert_snapshots(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """The newest row of each key by fetched_at, the new table's of equal ones."""
    both = old.withColumn("g", F.lit(0)).unionByName(new.withColumn("g", F.lit(1)))
    rest = [c for c in old.columns if c not in by]
    return both.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("fetched_at", "g")).alias("r")).select(*by, "r.*")


def store_snapshots(new: DataFrame, path: str, by: list[str], buckets: int = 64) -> None:
    """upsert_snapshots on the table at path (of write_buckets by the same key): only the folders of new keys are read and written."""
    merge_buckets(new, path, by, lambda old, fresh: upsert_snapshots(old, fresh.select(*old.columns), by), buckets)


def changed(new: DataFrame, stored: DataFrame, by: list[str], hashes: list[str], first_sight: bool = True) -> DataFrame:
    """Rows of new whose hashes differ from the stored ones; first_sight says whether a key not stored counts."""
    s = stored.select(*by, *[F.col(h).alias(f"old_{h}") for h in hashes], F.lit(True).alias("known"))
    differs = F.lit(False)
    for h in hashes:
        differs = differs | ~F.col(h).eqNullSafe(F.col(f"old_{h}"))
    j = new.join(s, by, "left")
    return j.filter(F.when(F.col("known"), differs).otherwise(F.lit(first_sight))).drop("known")


def policy_hashes(texts: DataFrame) -> DataFrame:
    """(policy_id, hash) over all texts of a policy and their places, white space collapsed. texts: policy_id, pos, text.

    Each text is hashed with its place and the hashes are combined by exclusive or and a count, so that parts
    of a policy are combined before the shuffle and no policy has to fit into one row.
    """
    one = F.sha2(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " ")).cast("binary"), 256)
    t = texts.select("policy_id", "pos", one.alias("h"))
    parts = [F.hex(F.bit_xor(F.xxhash64(F.lit(k), "pos", "h"))) for k in (1, 2)]
    return t.groupBy("policy_id").agg(F.concat_ws("-", F.count(F.lit(1)).cast("string"), *parts).alias("hash"))


def reaudits(changed_policies: DataFrame, stores: DataFrame) -> DataFrame:
    """(url, trigger): every store that opted in, with the names of the changed policies; none if nothing changed."""
    trigger = changed_policies.agg(F.array_join(F.sort_array(F.collect_set("policy_id")), ", ").alias("trigger")).filter("trigger <> ''")
    return stores.filter("on_policy_change").select("url").crossJoin(F.broadcast(trigger))  # one row


# The modes of a watched store.
MODES = ["interval", "on_change", "both"]


def due(stores: DataFrame, now: Column) -> DataFrame:
    """stores with full and cheap, true if the full audit or the cheap check is due: never done, or its days ago. Only stores where one is.

    Full audits are for the modes interval and both, cheap checks for on_change and both.
    """
    late = lambda last, days: F.col(last).isNull() | (F.date_add(F.col(last), F.col(days)) <= now)
    full = F.col("mode").isin("interval", "both") & F.col("interval_days").isNotNull() & late("last_full_audit_at", "interval_days")
    cheap = F.col("mode").isin("on_change", "both") & F.col("cheap_check_interval_days").isNotNull() & late("last_cheap_check_at", "cheap_check_interval_days")
    return stores.withColumns({"full": F.coalesce(full, F.lit(False)), "cheap": F.coalesce(cheap, F.lit(False))}).filter("full or cheap")


def registration_errors(stores: DataFrame) -> DataFrame:
    """(url, error): unknown mode, an interval that the mode needs and that is not there or 0, a URL given twice."""
    lacks = lambda c: F.coalesce(F.col(c) == 0, F.lit(True))
    found = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("mode").isin(MODES), F.lit(False)), "unknown mode"), F.when(F.col("mode").isin("interval", "both") & lacks("interval_days"), "interval_days is required"),
        F.when(F.col("mode").isin("on_change", "both") & lacks("cheap_check_interval_days"), "cheap_check_interval_days is required"),
    ))
    twice = stores.groupBy("url").count().filter("count > 1").select("url", F.lit("already registered").alias("error"))
    return stores.select("url", F.explode(found).alias("error")).unionByName(twice)


def old_jobs(jobs: DataFrame, now: Column, days: int) -> DataFrame:
    """Jobs made more than `days` days before now, to the second."""
    return jobs.filter(F.col("created_at") < now.cast("timestamp") - F.make_dt_interval(F.lit(days)))


def blobs(references: DataFrame) -> DataFrame:
    """(hash, bytes, refcount, last_referenced_at) of referenced contents (content, at)."""
    return references.groupBy(F.sha2(F.col("content").cast("binary"), 256).alias("hash")).agg(F.max(F.octet_length("content")).alias("bytes"), F.count(F.lit(1)).alias("refcount"), F.max("at").alias("last_referenced_at"))


def merged_blobs(stored: DataFrame, deltas: DataFrame) -> DataFrame:
    """(hash, bytes, refcount, last_referenced_at, released) of stored (hash, bytes, refcount, last_referenced_at) after deltas (hash, bytes, change, at, seq).

    change is 1 for a reference more and -1 for one less. A count of zero releases the content; releasing what isn't there does
    nothing, and a later reference stores it anew. So a count is the running sum less its lowest point below zero. Sums and lowest
    points are taken for each day of a content first, then over its days, so a content that is referenced everywhere
    is not one group. Rows with released are tombstones: their objects are to be deleted.
    """
    day = F.date_trunc("day", F.col("at"))
    w = Window.partitionBy("hash", "day").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, 0)
    each = deltas.withColumn("day", day).withColumn("run", F.sum("change").over(w))
    # the sum and the lowest running sum of a day
    days = each.groupBy("hash", "day").agg(F.sum("change").alias("total"), F.min("run").alias("low"), F.max("bytes").alias("bytes"), F.max(F.when(F.col("change") > 0, F.col("at"))).alias("at"))
    start = stored.select("hash", F.lit(None).cast("timestamp").alias("day"), F.col("refcount").cast("long").alias("total"), F.col("refcount").cast("long").alias("low"), "bytes", F.col("last_referenced_at").alias("at"))
    all_days = Window.partitionBy("hash").orderBy(F.col("day").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    both = start.unionByName(days).withColumn("low", F.coalesce(F.sum("total").over(all_days), F.lit(0)) + F.col("low"))
    out = both.groupBy("hash").agg(F.max("bytes").alias("bytes"), (F.sum("total") - F.least(F.lit(0), F.min("low"))).alias("refcount"), F.max("at").alias("last_referenced_at"))
    return out.withColumn("released", F.col("refcount") == 0)


def orphans(objects: DataFrame, kept: DataFrame) -> DataFrame:
    """Stored objects (hash, ..) that no kept content (hash, released) names."""
    return objects.join(kept.filter("not released").select("hash"), "hash", "left_anti")


def with_columns(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """df with the columns it lacks, and the default where one is null."""
    return df.withColumns({c: F.coalesce(F.col(c), d) if c in df.columns else d for c, d in defaults.items()})
