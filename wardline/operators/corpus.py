"""Labels, splits, identifiers and the integrity of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.scalar import partition_number, python_round
from wardline.operators.timeline import position_index

NAMESPACED = ("event_id", "session_id", "scenario_id", "sequence_id")


def label_audit(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Events without a label and labels without an event; both must be zero."""
    bare = events.select("event_id").join(labels.select("event_id"), "event_id", "left_anti")
    stray = labels.select("event_id").join(events.select("event_id"), "event_id", "left_anti")
    return bare.agg(F.count("*").alias("events_without_label")).crossJoin(stray.agg(F.count("*").alias("labels_without_event")))


def label_join(events: DataFrame, labels: DataFrame, strict: bool = True) -> DataFrame:
    if strict:
        audit = label_audit(events, labels).first()
        if audit["events_without_label"] or audit["labels_without_event"]:
            raise ValueError(f"events and labels do not match: {audit.asDict()}")
    return events.join(labels, "event_id")


def namespace(rows: DataFrame, split: str) -> DataFrame:
    changed = {c: F.concat(F.lit(split + "-"), F.col(c)) for c in NAMESPACED if c in rows.columns}
    return rows.withColumns(changed)


def union_splits(splits: dict[str, DataFrame]) -> DataFrame:
    frames = [namespace(df, name) for name, df in splits.items()]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def assign_splits(entities: DataFrame, train: float = .70, validation: float = .85) -> DataFrame:
    """Cut entities into disjoint splits by the digest of their id; slots of the digest share the ranking."""
    digest = F.md5(F.col("entity_id").cast("binary"))
    rows = entities.select("entity_id").distinct().select(
        "entity_id", digest.alias("digest"), F.lit(0).alias("_all"), F.conv(F.substring(digest, 1, 4), 16, 10).cast("long").alias("_sl"))
    ranked = position_index(rows, ["_all"], ["digest", "entity_id"], "place", slot="_sl")
    total = rows.groupBy("_all").agg(F.count("*").alias("total"))
    return ranked.join(F.broadcast(total), "_all").select("entity_id", F.when(
        F.col("place") <= F.floor(F.col("total") * train), "train").when(
        F.col("place") <= F.floor(F.col("total") * validation), "validation").otherwise("test").alias("split"))


def split_integrity(rows: DataFrame, order=("train", "validation", "test", "audit"), held_back: DataFrame | None = None) -> DataFrame:
    """Entity overlap, chronology of the splits, uniqueness of ids and overlap with a held-back stream."""
    shared = rows.select("entity_id", "split").distinct().groupBy("entity_id").count().where("count > 1").agg(F.count("*").alias("shared_entities"))
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("split"))
    spans = rows.groupBy("split").agg(F.min("us").alias("starts"), F.max("us").alias("ends")).withColumn("place", place)
    follows = F.lag("ends").over(Window.orderBy("place"))  # one row per split
    late = spans.withColumn("previous", follows).agg(F.count_if(F.col("starts") <= F.col("previous")).alias("overlapping_splits"))
    ids = rows.groupBy("event_id").count().agg(F.count_if(F.col("count") > 1).alias("repeated_event_ids"))
    result = shared.crossJoin(late).crossJoin(ids)
    if held_back is not None:
        both = held_back.select("event_id").distinct().join(rows.select("event_id"), "event_id", "left_semi")
        result = result.crossJoin(both.agg(F.count("*").alias("held_back_overlap")))
    return result.select("*", (F.col("shared_entities") == 0).alias("entity_disjoint"),
                         (F.col("overlapping_splits") == 0).alias("strictly_chronological"), (F.col("repeated_event_ids") == 0).alias("unique_event_ids"))


def manifest(rows: DataFrame) -> DataFrame:
    attacked = F.col("label") != "normal"
    attacks = F.count_if(attacked)
    sessions = F.count_distinct(F.when(~attacked, F.col("session_id")))
    scenarios = F.count_distinct(F.when(attacked, F.col("scenario_id")))
    return rows.groupBy("split").agg(
        F.count("*").alias("events"), attacks.alias("attacks"), python_round(attacks / F.count("*"), 4).alias("attack_event_rate"),
        sessions.alias("normal_sessions"), scenarios.alias("attack_scenarios"),
        python_round(scenarios / F.greatest(sessions, F.lit(1)), 4).alias("attack_scenario_rate"),
        F.count_distinct("entity_id").alias("entities"))


def label_histogram(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("split", "label").agg(F.count("*").alias("n"))
    return counts.groupBy("split").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("labels"))


def partition_loads(events: DataFrame, partitions: int = 32) -> DataFrame:
    return events.groupBy(partition_number("entity_id", partitions).alias("partition")).agg(
        F.count("*").alias("events"), F.count_distinct("entity_id").alias("entities"))


def cold_identities(attacks: DataFrame) -> DataFrame:
    """Re-issue identities per scenario in order of first appearance.

    Observed and claimed devices share one numbering, the observed one first. Ids are reduced to
    their first appearance before they are numbered.
    """
    def numbered(rows: DataFrame) -> DataFrame:
        first = rows.groupBy("scenario_id", "id").agg(F.min(F.struct("us", "event_id", "place")).alias("f"))
        return position_index(first.select("scenario_id", "id", "f.us", "f.event_id", "f.place"), ["scenario_id"],
                              ["us", "event_id", "place"], "n").select("scenario_id", "id", (F.col("n") - 1).alias("n"))

    base = attacks.where("label <> 'normal'")
    people = numbered(base.select("scenario_id", "us", "event_id", F.col("entity_id").alias("id"), F.lit(0).alias("place")))
    seen = F.explode(F.array(F.struct(F.col("device_id").alias("id"), F.lit(0).alias("place")),
                             F.struct(F.col("claimed_device_id").alias("id"), F.lit(1).alias("place")))).alias("s")
    devices = numbered(base.select("scenario_id", "us", "event_id", seen).select("scenario_id", "us", "event_id", "s.*"))
    prefix = F.concat(F.lit("cold-"), "scenario_id", F.lit("-"))
    who = people.select("scenario_id", F.col("id").alias("entity_id"), F.concat(prefix, F.col("n")).alias("cold_entity"))
    device = F.concat(prefix, F.lit("device-"), F.col("n"))
    observed = devices.select("scenario_id", F.col("id").alias("device_id"), device.alias("cold_device"))
    claimed = devices.select("scenario_id", F.col("id").alias("claimed_device_id"), device.alias("cold_claimed"))
    joined = base.join(who, ["scenario_id", "entity_id"]).join(observed, ["scenario_id", "device_id"]).join(claimed, ["scenario_id", "claimed_device_id"])
    replaced = {"entity_id": F.col("cold_entity"), "device_id": F.col("cold_device"), "claimed_device_id": F.col("cold_claimed"),
                "device_fingerprint": F.concat(prefix, "device_fingerprint"), "device_mac_hash": F.concat(prefix, "device_mac_hash")}
    if "user_id" in base.columns:
        replaced["user_id"] = F.col("cold_entity")
    return joined.withColumns(replaced).select(*base.columns)
