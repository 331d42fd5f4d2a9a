"""The change log: polling, current state, compaction, replication folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemora.functions.scoring import merge_counters
from mnemora.schemas import EXPERIENCE, MAX_COUNTER_BUCKETS

#: Sequence numbers a range holds when a log is numbered; they are unique, so no task gets more rows at once.
RANGE_NUMBERS = 65_536


def scan(log: DataFrame, since: int, limit: int) -> DataFrame:
    return log.where(F.col("seq") > since).orderBy("seq").limit(limit)


def numbered(log: DataFrame, place: str = "place") -> DataFrame:
    """The whole log in order of seq with each row's place from 1: places within ranges of seq, after the counts of the ranges before."""
    dealt = log.withColumn("_range", F.floor(F.col("seq") / RANGE_NUMBERS))
    # one row a range
    sums = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sums.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy("seq"))
    return dealt.withColumn(place, own).join(F.broadcast(before), "_range").withColumn(place, F.col(place) + F.col("_before")).drop("_range", "_before").orderBy("seq")


def poll(log: DataFrame, since: int, limit: int = 1000) -> DataFrame:
    """Experience events among the next `limit` rows: the limit comes first."""
    return scan(log, since, limit).where(F.col("entity_type") == "Experience")


def latest(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """Each key's row that is last in order."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(order)).alias("last")).select(*by, "last.*")


def current(log: DataFrame, by: list[str], order: str = "seq") -> DataFrame:
    return latest(log, by, order).where(F.col("event_type") != "Deleted")


def compact(log: DataFrame, cursors: DataFrame) -> DataFrame:
    """The rows that some peer has not seen; all without a peer."""
    low = cursors.agg(F.coalesce(F.min("last_sequence"), F.lit(0)).alias("low"))
    return log.join(F.broadcast(low), F.col("seq") > F.col("low")).drop("low")


def merge_state(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """Created experiences: counters and reinforcement times merge by maximum; unknown ids are inserted."""
    a = local.select("id", F.col("applications").alias("a"), F.col("last_reinforced_ms").alias("x"))
    b = incoming.select("id", F.col("applications").alias("b"), F.col("last_reinforced_ms").alias("y"))
    none = F.create_map().cast("map<string,bigint>")
    both = a.join(b, "id", "full")
    return both.select("id", merge_counters(F.coalesce("a", none), F.coalesce("b", none)).alias("applications"), F.greatest("x", "y").alias("last_reinforced_ms"), F.when(F.col("x").isNull(), "inserted").when(F.col("y").isNull(), "kept").otherwise("merged").alias("outcome"))


def apply_updates(local: DataFrame, patches: DataFrame, columns: list[str], last_write_wins: bool) -> DataFrame:
    """Patches (id, ts_ms, columns) over rows; with last_write_wins an older patch loses."""
    p = patches.select("id", F.col("ts_ms").alias("_ts"), *[F.col(c).alias(f"_{c}") for c in columns])
    takes = F.col("_ts").isNotNull()
    if last_write_wins:
        takes = takes & ~(F.col("ts_ms") > F.col("_ts"))
    joined = local.join(p, "id", "left")
    return joined.select(*[F.when(takes, F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in local.columns])


def hydrate(log: DataFrame, rows: DataFrame) -> DataFrame:
    """Log rows with their entity; rows without one stay only for archived and deleted events."""
    full = log.join(rows, "entity_id", "left")
    return full.where(F.col("found").isNotNull() | F.col("event_type").isin("Archived", "Deleted"))


def gcounter(counts: DataFrame, by: str) -> DataFrame:
    """Many replicas' counters: largest of each instance, then one map for each key."""
    best = counts.groupBy(by, "instance").agg(F.max("n").alias("n"))
    return best.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("instance", "n")))).alias("applications"))


def insert_new(rows: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    return rows.unionByName(new.join(rows, key, "left_anti"))


#: What an update from a peer may set.
PATCH = ["importance", "confidence", "domain", "related_files", "archived"]


def without(rows: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def fold_experiences(local: DataFrame, page: DataFrame, last_write_wins: bool) -> DataFrame:
    """What a page of a peer's experience events makes of the local rows: id, event_type, collective_id, origin, outcome, conflict, row.

    page: seq, event_type, entity_id, collective_id, ts_ms, origin, experience.  An
    id's events are folded to their last one; counters and reinforcement times merge
    by maximum whatever wins.  An update or archiving takes the last row's patch,
    unless the local row's time is later under last_write_wins.  Unknown ids are
    inserted if the page creates them, else skipped, as are rows with too many
    counters.  outcome: inserted, updated, deleted or skipped (then row is null).
    """
    columns = [c.split()[0] for c in EXPERIENCE.split(", ")]
    events = page.where(~F.coalesce(F.size("experience.applications") > MAX_COUNTER_BUCKETS, F.lit(False))).withColumnRenamed("entity_id", "id")
    full = F.col("event_type").isin("Created", "Updated", "Archived") & F.col("experience").isNotNull()
    changed = F.col("event_type").isin("Updated", "Archived") & F.col("experience").isNotNull()
    folded = events.groupBy("id").agg(
        F.max_by(F.struct("event_type", "collective_id", "origin"), "seq").alias("last"),
        F.max_by("experience", F.when(full, F.col("seq"))).alias("newest"),
        F.max_by("ts_ms", F.when(changed, F.col("seq"))).alias("patch_ms"),
        F.bool_or(F.col("event_type") == "Created").alias("created"),
        F.max("experience.last_reinforced_ms").alias("last_reinforced_ms"),
    )
    counts = gcounter(events.select("id", F.explode("experience.applications").alias("instance", "n")), "id")
    incoming = folded.join(counts, "id", "left").withColumn("applications", F.coalesce("applications", F.create_map().cast("map<string,bigint>")))
    mine = local.join(folded.select("id"), "id", "left_semi").select(columns)
    merged = merge_state(mine.select("id", "applications", "last_reinforced_ms"), incoming.where("newest is not null").select("id", "applications", "last_reinforced_ms"))
    patches = folded.where("patch_ms is not null").select("id", F.col("patch_ms").alias("ts_ms"), *[F.col(f"newest.{c}").alias(c) for c in PATCH])
    patched = apply_updates(mine, patches, PATCH, last_write_wins)
    rest = [c for c in columns if c not in ("applications", "last_reinforced_ms")]
    body = F.struct(*columns)
    kept = patched.select(rest).join(merged.select("id", "applications", "last_reinforced_ms"), "id").select("id", body.alias("held"))
    fresh = folded.select("id", "newest").join(merged.where("outcome = 'inserted'").select("id", "applications", "last_reinforced_ms"), "id").select("id", *[F.col(f"newest.{c}").alias(c) for c in rest if c != "id"], "applications", "last_reinforced_ms").select("id", body.alias("made"))
    before = mine.select("id", F.struct(*columns).alias("before"))
    every = folded.join(before, "id", "left").join(kept, "id", "left").join(fresh, "id", "left")
    gone = F.col("last.event_type") == "Deleted"
    same = [F.col(f"held.{c}").eqNullSafe(F.col(f"before.{c}")) if c != "applications" else F.array_sort(F.map_entries("held.applications")) == F.array_sort(F.map_entries("before.applications")) for c in ["applications", "last_reinforced_ms", *PATCH]]
    unchanged = same[0]
    for x in same[1:]:
        unchanged = unchanged & x
    known = F.col("before").isNotNull()
    outcome = (
        F.when(known & gone, "deleted").when(known & F.col("held").isNotNull() & ~unchanged, "updated")
        .when(~known & ~gone & F.col("created") & F.col("made").isNotNull(), "inserted").otherwise("skipped")
    )
    # under last_write_wins every update that meets a row is a conflict that was settled
    conflict = known & ~gone & F.col("patch_ms").isNotNull() if last_write_wins else F.lit(False)
    event = F.when(outcome == "inserted", "Created").otherwise(F.col("last.event_type"))
    row = F.when(outcome == "inserted", F.col("made")).when(outcome == "updated", F.col("held"))
    return every.select("id", event.alias("event_type"), F.coalesce("before.collective_id", "last.collective_id").alias("collective_id"), F.col("last.origin").alias("origin"), outcome.alias("outcome"), conflict.alias("conflict"), row.alias("row"))


def fold_others(local: DataFrame, page: DataFrame, column: str) -> DataFrame:
    """The same for relations, insights or collectives: created once, deleted where there is one."""
    events = page.withColumnRenamed("entity_id", "id")
    folded = events.groupBy("id").agg(F.max_by(F.struct("event_type", "collective_id", "origin"), "seq").alias("last"), F.max_by(column, F.when(F.col(column).isNotNull(), F.col("seq"))).alias("row"))
    new = without(folded.where((F.col("last.event_type") != "Deleted") & F.col("row").isNotNull()), local).select("id", F.lit("inserted").alias("outcome"))
    gone = folded.where(F.col("last.event_type") == "Deleted").join(local.select("id"), "id", "left_semi").select("id", F.lit("deleted").alias("outcome"))
    out = folded.join(new.unionByName(gone), "id", "left").withColumn("outcome", F.coalesce("outcome", F.lit("skipped")))
    event = F.when(F.col("outcome") == "inserted", "Created").otherwise(F.col("last.event_type"))
    return out.select("id", event.alias("event_type"), "last.collective_id", "last.origin", "outcome", F.lit(False).alias("conflict"), F.when(F.col("outcome") == "inserted", F.col("row")).alias("row"))
