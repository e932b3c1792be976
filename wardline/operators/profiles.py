"""Trusted behaviour as facts: one row per trusted event and profile key.

The four profile levels are keys of one facts table. A profile "as of" an event is the number of
facts of its key that precede the event, so every question about a profile becomes a running total
or an equality join on (key, number of facts) or (key, dimension, value). No profile is ever held
as a document.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.scalar import (DAY, HOUR, MINUTE, circular_hours, clip, floor_div, guarded_z, hour_of_day,
                                       log1p_share, minute_of_day, padded_distance, python_round, sensitive_flag)
from wardline.operators.bounded_lists import ANY, CHUNK, spells
from wardline.operators.timeline import dealt_join, few_keys, running_before
from wardline.operators.windows import Spans
from wardline.schema import (ENTITY_MINIMUM, LOG_LIMIT, MATURE_KINDS, NUMERIC_LIMIT, PEER_MINIMUM, VALUE_LIMITS)
from wardline.session import cut_lineage

ORDER = ["us", "event_id"]
KEYS = ["scope", "key"]


@dataclass(frozen=True)
class ProfilePolicy:
    entity_minimum: int = ENTITY_MINIMUM
    peer_minimum: int = PEER_MINIMUM
    numeric_limit: int = NUMERIC_LIMIT
    log_limit: int = LOG_LIMIT
    value_limits: dict = field(default_factory=lambda: dict(VALUE_LIMITS))
    chunk: int = 4096
    list_chunk: int = CHUNK


# ---- keys, trust ------------------------------------------------------------------------------

def peer_subject() -> Column:
    return F.concat_ws(":", "entity_type", "department", "user_role")


def level_keys() -> Column:
    """The four keys an event feeds, most specific first."""
    def level(kind: str, subject: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(kind + ":"), subject).alias("key"))

    return F.array(level("entity", F.col("entity_id")), level("device", F.col("device_id")),
                   level("peer", peer_subject()), level("global", F.lit("organization")))


def fan_out(events: DataFrame) -> DataFrame:
    return events.withColumn("level", F.explode(level_keys())).select("*", "level.kind", "level.key").drop("level")


def trusted_by_label(events: DataFrame) -> DataFrame:
    return events.withColumn("trusted", F.col("label") == "normal")


def trusted_live(scored: DataFrame, max_risk: float = 29.0) -> DataFrame:
    """Automatic trust of low-risk normal events, or an explicit override."""
    override = F.coalesce(F.col("trusted_override"), F.lit(False)) if "trusted_override" in scored.columns else F.lit(False)
    low = (python_round("risk_score", 2) <= max_risk) & (F.col("predicted_attack") == "normal")
    return scored.withColumn("trusted", low | override)


def fork_holdouts(events: DataFrame, train: str = "train",
                  holdouts: tuple = ("validation", "test", "audit")) -> DataFrame:
    """Give each holdout split a copy of the training facts, then let it learn without labels.

    Training rows appear once as events to score and once per holdout as `seed` rows, each split in a
    `scope` of its own. Splits must be in chronological order, which the corpus audit checks.
    """
    in_train = F.col("split") == train
    own = (events.withColumn("scope", F.col("split")).withColumn("seed", F.lit(False))
           .withColumn("trusted", F.when(in_train, F.col("label") == "normal").otherwise(F.lit(True))))
    seeds = (events.where(in_train & (F.col("label") == "normal"))
             .withColumn("scope", F.explode(F.array(*[F.lit(h) for h in holdouts])))
             .withColumn("seed", F.lit(True)).withColumn("trusted", F.lit(True)))
    return own.unionByName(seeds)


# ---- positions and baseline choice ----------------------------------------------------------

def _slot() -> Column:
    """Broad keys get short slots: the broader the key, the more rows share it."""
    us = F.col("us")
    return (F.when(F.col("kind").isin("entity", "device"), floor_div(us, DAY))
            .when(F.col("kind") == "peer", floor_div(us, HOUR)).otherwise(floor_div(us, 5 * MINUTE)))


def positions(events: DataFrame) -> DataFrame:
    """Each event under each of its four keys, with the trusted facts that precede it.

    Needs `trusted`; `scope` and `seed` are optional. `facts_before` counts facts,
    `transfers_before` counts facts that were external transfers.
    """
    for name, default in (("scope", F.lit("")), ("seed", F.lit(False))):
        if name not in events.columns:
            events = events.withColumn(name, default)
    external = F.col("is_external_destination")
    narrow = events.select(
        "event_id", "us", "scope", "seed", "trusted", "resource_id", level_keys().alias("levels"),
        minute_of_day("us").alias("minute"), F.col("resource_sensitivity").alias("sensitivity"),
        sensitive_flag("resource_sensitivity", "is_privileged_action").cast("long").alias("flag"),
        F.col("bytes_downloaded").alias("down"), F.col("bytes_uploaded").alias("up"),
        F.col("session_duration_seconds").cast("long").alias("duration"),
        F.when(external, F.col("bytes_downloaded") + F.col("bytes_uploaded")).alias("transfer"))
    rows = narrow.select("*", F.explode("levels").alias("level")).select("*", "level.kind", "level.key").drop("levels", "level")
    rows = (rows.withColumn("slot", _slot())
            .withColumn("facts", F.col("trusted").cast("long"))
            .withColumn("transfers", (F.col("trusted") & F.col("transfer").isNotNull()).cast("long")))
    return (running_before(rows, KEYS, ORDER, {"facts": "sum", "transfers": "sum"}, slot="slot", prefix="before_")
            .withColumnRenamed("before_facts", "facts_before")
            .withColumnRenamed("before_transfers", "transfers_before"))


def choose_baseline(placed: DataFrame, policy: ProfilePolicy = ProfilePolicy(),
                    runtime: bool = False, priors: DataFrame | None = None) -> DataFrame:
    """One baseline per event: the first mature level, with its size and confidence.

    Offline, the organisation level needs a single fact. At runtime it must be as mature as a peer
    group; below that the priors of the training run apply (`key`, `prior_count`).
    """
    def of(kind: str, value: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(value)))

    wide = placed.where("NOT seed").groupBy("scope", "event_id").agg(
        F.first("us").alias("us"), F.max("us").alias("last_us"),
        *[of(k, v).alias(f"{k}_{v}") for k in ("entity", "device", "peer", "global")
          for v in ("key", "facts_before", "transfers_before")])

    def level(kind: str, minimum: int, name: str | None = None) -> Column:
        return F.struct(F.lit(name or kind).alias("baseline_kind"), F.col(f"{kind}_key").alias("key"),
                        F.col(f"{kind}_facts_before").alias("baseline_count"),
                        F.col(f"{kind}_transfers_before").alias("transfer_count"), F.lit(minimum).alias("minimum"))

    e, p = policy.entity_minimum, policy.peer_minimum
    chosen = (F.when(F.col("entity_facts_before") >= e, level("entity", e))
              .when(F.col("device_facts_before") >= e, level("device", e))
              .when(F.col("peer_facts_before") >= p, level("peer", p)))
    if not runtime:
        chosen = (chosen.when(F.col("global_facts_before") > 0, level("global", p))
                  .otherwise(level("global", p, "global_default")))
    else:
        chosen = chosen.when(F.col("global_facts_before") >= p, level("global", p))
    result = wide.select("scope", "event_id", "us", "last_us", F.greatest("entity_facts_before", "device_facts_before")
                         .alias("subject_history_count"), "peer_key", "global_key", chosen.alias("c"))
    if runtime:
        result = _with_priors(result, priors)
    result = result.select("scope", "event_id", "us", "last_us", "subject_history_count", "c.*")
    grown = F.least(F.lit(1.0), F.lit(.25) + F.lit(.75) * F.col("baseline_count") / (2.0 * F.col("minimum")))
    confidence = (F.when(F.col("baseline_kind").endswith("_prior"), F.lit(.55))
                  .when(F.col("baseline_count") > 0, grown).otherwise(F.lit(.1)))
    # Priors live in a scope of their own, so their facts never mix with live ones of the same key.
    scope = F.when(F.col("baseline_kind").endswith("_prior"), F.lit("prior")).otherwise(F.col("scope"))
    return result.withColumns({"baseline_confidence": confidence, "scope": scope}).drop("minimum")


def prior_seeds(events: DataFrame) -> DataFrame:
    """Trusted training events as prior facts; they must precede the events they serve."""
    return events.where("trusted").withColumns({"scope": F.lit("prior"), "seed": F.lit(True)})


def _with_priors(result: DataFrame, priors: DataFrame | None) -> DataFrame:
    def filled(kind: Column, key: Column, count: Column, transfers: Column) -> Column:
        return F.struct(kind.alias("baseline_kind"), key.alias("key"), count.cast("long").alias("baseline_count"),
                        transfers.cast("long").alias("transfer_count"), F.lit(PEER_MINIMUM).alias("minimum"))

    none = filled(F.lit("global_default"), F.lit("global:organization"), F.lit(0), F.lit(0))
    if priors is None:
        return result.withColumn("c", F.coalesce("c", none))
    peer = priors.select(F.col("key").alias("peer_key"), F.col("prior_count").alias("_peer_prior"), F.col("prior_transfers").alias("_peer_sent"))
    world = priors.select(F.col("key").alias("global_key"), F.col("prior_count").alias("_global_prior"), F.col("prior_transfers").alias("_global_sent"))
    joined = result.join(peer, "peer_key", "left").join(world, "global_key", "left")
    prior = (F.when(F.col("_peer_prior").isNotNull(), filled(F.lit("peer_prior"), F.col("peer_key"), F.col("_peer_prior"), F.col("_peer_sent")))
             .when(F.col("_global_prior").isNotNull(),
                   filled(F.lit("global_prior"), F.col("global_key"), F.col("_global_prior"), F.col("_global_sent"))).otherwise(none))
    return joined.withColumn("c", F.coalesce("c", prior))


def is_cold(kind) -> Column:
    return ~F.col(kind).isin(*MATURE_KINDS)


def maturity(kind) -> Column:
    return F.when(is_cold(kind), F.lit("building")).otherwise(F.lit("mature"))


def bootstrap_priors(events: DataFrame) -> DataFrame:
    """Size of each peer and organisation profile of the trusted rows, and how many of its facts are external transfers."""
    facts = fan_out(events.where("trusted")).where(F.col("kind").isin("peer", "global"))
    return facts.groupBy("key").agg(F.count("*").alias("prior_count"), F.count_if("is_external_destination").alias("prior_transfers"))


# ---- numeric histories -----------------------------------------------------------------------

def _exact(value) -> Column:
    return F.col(value).cast("decimal(19,0)")


def rolling_state(facts: DataFrame, index: str, columns: dict[str, bool], limit: int, chunk: int) -> DataFrame:
    """Sums over the last `limit` facts, for every (key, number of facts).

    `columns` maps a value to whether its squares are wanted. Sums run over one chunk of facts plus the
    `limit` facts before it and the window's start is looked up with `lag`, so each fact costs the same
    whatever the limit. Integers are summed as decimals, which keeps squares of large byte counts exact.
    """
    chunk = max(chunk, limit)
    own = F.floor((F.col(index) - 1) / chunk)
    ahead = F.floor((F.col(index) - 1 + limit) / chunk)
    spread = facts.withColumn("_chunk", F.explode(F.when(ahead > own, F.array(own, own + 1)).otherwise(F.array(own))))
    part = Window.partitionBy(*KEYS, "_chunk").orderBy(index)
    upto = part.rowsBetween(Window.unboundedPreceding, 0)
    sums = {}
    for name, squared in columns.items():
        value = F.col(name) if dict(facts.dtypes)[name] == "double" else _exact(name)
        sums["s_" + name] = F.coalesce(F.sum(value).over(upto), value * 0)
        if squared:
            sums["q_" + name] = F.coalesce(F.sum(value * value).over(upto), value * value * 0)
    running = spread.select(*KEYS, index, "_chunk", *[v.alias(k) for k, v in sums.items()])
    windowed = [(F.col(k) - F.coalesce(F.lag(k, limit).over(part), F.col(k) * 0)).alias(k) for k in sums]
    return (running.select(*KEYS, index, "_chunk", *windowed)
            .where(F.col("_chunk") == own).drop("_chunk"))


def mean_of(name: str, count: Column) -> Column:
    return F.col("s_" + name).cast("double") / F.when(count > 0, count)


def deviation_of(name: str, count: Column) -> Column:
    """Population deviation from exact sums: the difference is taken before leaving decimals."""
    spread = F.col("q_" + name) * count - F.col("s_" + name) * F.col("s_" + name)
    return F.sqrt(F.greatest(spread.cast("double"), F.lit(0.0))) / F.when(count > 0, count)


def _salts(kind: Column) -> Column:
    """Over how many tasks the rows of one key are dealt: the broader the key, the more."""
    return F.when(kind == "global", 256).when(kind == "peer", 32).otherwise(4)


def _of_key() -> Column:
    return _salts(F.split("key", ":")[0])


def asked_keys(baselines: DataFrame) -> DataFrame:
    """The keys some event is judged by, with the most facts (`asked_n`) and the latest time (`asked_us`) asked for.

    A cold key, such as the organisation's, is asked for early on only; its later facts are seen by no event.
    """
    until = "last_us" if "last_us" in baselines.columns else "us"
    return baselines.groupBy(*KEYS).agg(F.max("baseline_count").alias("asked_n"), F.max(until).alias("asked_us"))


def _within(number, most) -> Column:
    """Whether a fact or sighting lies within what is asked for; without a limit it does."""
    return F.coalesce(F.col(number) <= F.col(most), F.lit(True))


def facts_of(placed: DataFrame, baselines: DataFrame) -> DataFrame:
    """Facts of the keys some event is judged by, up to the last such event, numbered, with the gap to the previous fact."""
    wanted, facts = cut_lineage(asked_keys(baselines).drop("asked_us")), placed.where("trusted")
    if few_keys(wanted):
        facts = facts.join(F.broadcast(wanted), KEYS)
    else:
        levels = wanted.groupBy("scope", F.split("key", ":")[0].alias("kind")).agg(F.max("asked_n").alias("level_n"))
        facts = facts.join(F.broadcast(levels), ["scope", "kind"]).where(_within("facts_before", "level_n")).drop("level_n")
        facts = dealt_join(facts, wanted, KEYS, "event_id", "inner", _salts(F.col("kind")), _of_key())
    facts = facts.where(_within("facts_before", "asked_n")).select(*placed.columns)
    return facts.withColumn("n", F.col("facts_before") + 1).withColumn("m", F.col("transfers_before") + 1)


def last_facts(facts: DataFrame, policy: ProfilePolicy = ProfilePolicy()) -> DataFrame:
    """What a finished profile holds of its facts: the last ones and the last transfers, as far as its histories reach."""
    ends = facts.groupBy(*KEYS).agg(F.max("n").alias("last_n"), F.max("m").alias("last_m"))
    reach = max(policy.log_limit, policy.numeric_limit + 1) + 1
    late = (F.col("n") > F.col("last_n") - reach) | (F.col("transfer").isNotNull() & (F.col("m") > F.col("last_m") - reach))
    return dealt_join(facts, ends, KEYS, "event_id", "inner", _salts(F.col("kind")), _of_key()).where(late).drop("last_n", "last_m")


def numeric_history(facts: DataFrame, policy: ProfilePolicy = ProfilePolicy()) -> DataFrame:
    """State of every numeric history after `n` facts of a key."""
    chunk, limit = policy.chunk, policy.numeric_limit
    limit_chunk = max(chunk, limit + 1)
    own = F.floor((F.col("n") - 1) / limit_chunk)
    ahead = F.floor((F.col("n") + limit) / limit_chunk)
    # One extra fact of head room lets the same pass compute gaps.
    base = facts.select(*KEYS, "n", "us", "minute", "sensitivity", "flag", "down", "up", "duration")
    spread = base.withColumn("_chunk", F.explode(
        F.when(ahead > own, F.array(own, own + 1)).otherwise(F.array(own))))
    part = Window.partitionBy(*KEYS, "_chunk").orderBy("n")
    upto = part.rowsBetween(Window.unboundedPreceding, 0)
    spread = spread.withColumn("gap", F.greatest(F.col("us") - F.lag("us").over(part), F.lit(0).cast("long")))
    squared = {"minute": False, "sensitivity": True, "flag": False, "down": True, "up": True,
               "duration": True, "gap": True}
    sums = {}
    for name, square in squared.items():
        value = F.col(name) if name == "sensitivity" else (
            F.col(name) if name in ("minute", "flag", "duration") else F.coalesce(_exact(name), F.lit(0).cast("decimal(19,0)")))
        sums["s_" + name] = F.sum(value).over(upto)
        if square:
            sums["q_" + name] = F.sum(value * value).over(upto)
    running = spread.select(*KEYS, "n", "_chunk", *[v.alias(k) for k, v in sums.items()])
    windowed = [(F.col(k) - F.coalesce(F.lag(k, limit).over(part), F.col(k) * 0)).alias(k) for k in sums]
    return running.select(*KEYS, "n", "_chunk", *windowed).where(F.col("_chunk") == own).drop("_chunk")


def numeric_features(events: DataFrame, baselines: DataFrame, facts: DataFrame, since_last: DataFrame,
                     policy: ProfilePolicy = ProfilePolicy()) -> DataFrame:
    """F17, F22, F26, F27, F29, F30 and the baseline side of F32."""
    state = numeric_history(facts, policy)
    current = events.select(
        "event_id", hour_of_day("us").alias("hour"), F.col("resource_sensitivity").alias("sensitivity"),
        F.col("bytes_downloaded").alias("down"), F.col("bytes_uploaded").alias("up"),
        F.col("session_duration_seconds").alias("duration")).join(since_last, "event_id")
    joined = (baselines.join(state.withColumnRenamed("n", "baseline_count"), [*KEYS, "baseline_count"], "left")
              .join(current, "event_id"))
    n = F.least(F.col("baseline_count"), F.lit(policy.numeric_limit))
    gaps = F.least(F.greatest(F.col("baseline_count") - 1, F.lit(0)), F.lit(policy.numeric_limit))

    def z(value: str, name: str) -> Column:
        return guarded_z(value, n, mean_of(name, n), deviation_of(name, n))

    mature = F.col("baseline_kind").isin(*MATURE_KINDS)
    gap_z = guarded_z("seconds_since_last", gaps, mean_of("gap", gaps) / 1e6, deviation_of("gap", gaps) / 1e6)
    hours = F.col("s_minute").cast("double") / 60.0 / F.when(n > 0, n)
    return joined.select(
        "event_id",
        F.when(n < 1, F.lit(.25)).otherwise(F.least(F.lit(1.0), circular_hours("hour", hours) / 6.0))
        .alias("access_hour_deviation_score"),
        clip(F.greatest(F.lit(0.0), z("sensitivity", "sensitivity")) / 5.0, 0, 1)
        .alias("resource_sensitivity_deviation_score"),
        z("down", "down").alias("download_volume_zscore"), z("up", "up").alias("upload_volume_zscore"),
        z("duration", "duration").alias("session_duration_zscore"),
        F.when(mature & F.col("seconds_since_last").isNotNull(), gap_z).otherwise(0.0).alias("inter_event_time_zscore"),
        n.alias("flag_count"), F.coalesce(mean_of("flag", n), F.lit(0.0)).alias("flag_mean"))


def transfer_history(facts: DataFrame, policy: ProfilePolicy = ProfilePolicy()) -> DataFrame:
    return rolling_state(facts.where("transfer IS NOT NULL").select(*KEYS, "m", "transfer"), "m",
                         {"transfer": True}, policy.numeric_limit, policy.chunk)


# ---- time ranges over the baseline key -------------------------------------------------------

ENTROPY_SCALE = 10_000_000_000
_RANGE_MEASURES = ("flags_n", "flags_sum", "moved_n", "moved_sum", "res_n", "res_kinds", "res_mass")


def _mass(count: Column) -> Column:
    """count * ln(count) in fixed point, so that sums of differences telescope without drift."""
    return F.round(F.when(count > 1, count * F.log(count.cast("double"))).otherwise(0.0) * ENTROPY_SCALE).cast("long")


def _capped(facts: DataFrame, index: str, values: list[str], limit: int, chunk: int) -> DataFrame:
    """Each fact with the fact `limit` places before it, which it pushes out of the bounded log."""
    chunk = max(chunk, limit)
    own = F.floor((F.col(index) - 1) / chunk)
    ahead = F.floor((F.col(index) - 1 + limit) / chunk)
    spread = facts.withColumn("_chunk", F.explode(F.when(ahead > own, F.array(own, own + 1)).otherwise(F.array(own))))
    part = Window.partitionBy(*KEYS, "_chunk").orderBy(index)
    pushed = F.lag(F.struct("us", *values), limit).over(part).alias("pushed")
    return spread.select("*", pushed).where(F.col("_chunk") == own).drop("_chunk")


def _lifetimes(facts: DataFrame, index: str, values: list[str], width: int, policy: ProfilePolicy) -> DataFrame:
    """Signed entries: a fact enters, leaves after `width`, or earlier when the log is full.

    An early exit is booked at the fact that causes it and cancelled at the regular time.
    """
    rows = _capped(facts.select(*KEYS, "kind", "us", "event_id", index, *values), index, values, policy.log_limit, policy.chunk)
    us, old = F.col("us"), F.col("pushed")

    def edge(at: Column, late: int, sign: int, source: Column | None, cause: Column) -> Column:
        fields = [(source[v] if source is not None else F.col(v)).alias(v) for v in values]
        return F.struct(at.alias("us"), F.lit(late).alias("late"), cause.alias("event_id"), F.lit(sign).alias("sign"), *fields)

    own = F.array(edge(us, 0, 1, None, F.col("event_id")), edge(us + width, 1, -1, None, F.col("event_id")))
    early = F.array(edge(us, 0, -1, old, F.col("event_id")), edge(old["us"] + width, 1, 1, old, F.lit("")))
    crowded = old.isNotNull() & (old["us"] + width >= us)
    return rows.select(*KEYS, "kind", F.explode(F.when(crowded, F.concat(own, early)).otherwise(own)).alias("e")).select(
        *KEYS, "kind", "e.*")


def range_features(events: DataFrame, baselines: DataFrame, facts: DataFrame, numeric: DataFrame,
                   spans: Spans = Spans(), policy: ProfilePolicy = ProfilePolicy()) -> DataFrame:
    """F21, F28 and F32: day and month ranges of the baseline key, in one running total."""
    order = ["us", "late", "event_id", "phase", "sign"]
    probes = baselines.join(events.select("event_id", "resource_id"), "event_id").select(
        *KEYS, "us", "event_id", "resource_id", F.split("key", ":")[0].alias("kind"),
        F.lit(0).alias("late"), F.lit(0).alias("phase"), F.lit(0).alias("sign"))

    # Occurrences of each resource inside the day, and how each change moves the entropy sums.
    visits = _lifetimes(facts, "n", ["resource_id"], spans.day, policy).withColumn("phase", F.lit(1))
    # Additions first at equal positions, so counts never go below zero.
    visits = visits.withColumn("phase", F.when(F.col("sign") > 0, 1).otherwise(2)).unionByName(probes)
    visits = visits.withColumn("slot", _slot()).withColumn("step", F.col("sign").cast("long"))
    counted = running_before(visits, [*KEYS, "resource_id"], order, {"step": "sum"}, slot="slot", prefix="seen_")
    before, after = F.col("seen_step"), F.col("seen_step") + F.col("step")
    zero = F.lit(0).cast("long")
    moves = counted.select(
        *KEYS, "kind", "us", "late", "event_id", "phase", "sign", F.col("seen_step").alias("same_resource"),
        F.col("step").alias("res_n"), ((after > 0).cast("long") - (before > 0).cast("long")).alias("res_kinds"),
        (_mass(after) - _mass(before)).alias("res_mass"),
        zero.alias("flags_n"), zero.alias("flags_sum"), zero.alias("moved_n"), F.lit(0).cast("decimal(19,0)").alias("moved_sum"))
    flags = _lifetimes(facts, "n", ["flag"], spans.month, policy).select(
        *KEYS, "kind", "us", "late", "event_id", F.lit(1).alias("phase"), "sign",
        F.col("sign").cast("long").alias("flags_n"), (F.col("sign") * F.col("flag")).cast("long").alias("flags_sum"))
    moved = _lifetimes(facts.where("transfer IS NOT NULL"), "m", ["transfer"], spans.day, policy).select(
        *KEYS, "kind", "us", "late", "event_id", F.lit(1).alias("phase"), "sign",
        F.col("sign").cast("long").alias("moved_n"),
        (F.col("sign") * F.col("transfer")).cast("decimal(19,0)").alias("moved_sum"))
    rows = (moves.unionByName(flags, allowMissingColumns=True).unionByName(moved, allowMissingColumns=True)
            .withColumn("slot", _slot()))
    totals = running_before(rows, KEYS, order, {m: "sum" for m in _RANGE_MEASURES}, slot="slot", prefix="in_")
    totals = totals.where("phase = 0").select("event_id", "same_resource", *["in_" + m for m in _RANGE_MEASURES])
    return _range_values(totals, events, baselines, facts, numeric, policy)


def _range_values(totals: DataFrame, events: DataFrame, baselines: DataFrame, facts: DataFrame, numeric: DataFrame,
                  policy: ProfilePolicy) -> DataFrame:
    current = events.select(
        "event_id", F.col("is_external_destination").alias("external"),
        (F.col("bytes_uploaded") + F.col("bytes_downloaded")).alias("moved_now"),
        sensitive_flag("resource_sensitivity", "is_privileged_action").alias("flag_now"))
    history = transfer_history(facts, policy).withColumnRenamed("m", "transfer_count")
    joined = (totals.join(baselines.select("event_id", *KEYS, "transfer_count"), "event_id")
              .join(history, [*KEYS, "transfer_count"], "left")
              .join(current, "event_id").join(numeric.select("event_id", "flag_count", "flag_mean"), "event_id"))
    c = F.col
    visits_n = (c("in_res_n") + 1).cast("double")
    kinds = c("in_res_kinds") + (c("same_resource") == 0).cast("long")
    mass = (c("in_res_mass") - _mass(c("same_resource")) + _mass(c("same_resource") + 1)) / F.lit(float(ENTROPY_SCALE))
    entropy = (F.log(visits_n) - mass / visits_n) / F.when(kinds > 1, F.log(kinds.cast("double")))
    external = c("external").cast("long")
    moves_n = (c("in_moved_n") + external).cast("double")
    total = (c("in_moved_sum") + F.when(c("external"), c("moved_now")).otherwise(0)).cast("double")
    m = F.least(c("transfer_count"), F.lit(policy.numeric_limit))
    spread = F.greatest(deviation_of("transfer", m) * F.sqrt(moves_n), F.lit(1000.0))
    transfer = (F.when(moves_n < 1, F.lit(0.0)).when(m < 2, log1p_share(total))
                .otherwise(clip((total - mean_of("transfer", m) * moves_n) / spread, -20, 20)))
    rate = (c("in_flags_sum") + c("flag_now")) / (c("in_flags_n") + 1).cast("double")
    flag_spread = F.greatest(F.sqrt(F.greatest(c("flag_mean") * (1 - c("flag_mean")), F.lit(0.0))), F.lit(.1))
    sensitive = (F.when(c("flag_count") < 2, F.when(c("flag_now") == 1, .25).otherwise(0.0))
                 .otherwise(clip((rate - c("flag_mean")) / flag_spread, -20, 20)))
    return joined.select(
        "event_id",
        F.when(kinds <= 1, F.lit(0.0)).otherwise(entropy * F.least(F.lit(1.0), (kinds - 1) / 5.0))
        .alias("resource_access_entropy_24h"),
        transfer.alias("cumulative_external_transfer_24h_zscore"),
        sensitive.alias("sensitive_access_rate_30d_zscore"))


def closed_range_features(events: DataFrame, baselines: DataFrame, facts: DataFrame, numeric: DataFrame,
                          spans: Spans = Spans(), policy: ProfilePolicy = ProfilePolicy()) -> DataFrame:
    """F21, F28 and F32 against finished profiles: every logged fact since the range began counts.

    Time runs backwards, so "since" becomes "before" and the same running totals apply.
    """
    ends = facts.groupBy(*KEYS).agg(F.max("n").alias("last_n"), F.max("m").alias("last_m"))
    logged = facts.join(ends, KEYS).where(F.col("n") > F.col("last_n") - policy.log_limit)
    moved = facts.where("transfer IS NOT NULL").join(ends, KEYS).where(F.col("m") > F.col("last_m") - policy.log_limit)
    back = (-F.col("us")).alias("us")
    asked = baselines.join(events.select("event_id", "resource_id"), "event_id")

    def probes(width: int, *extra: str) -> DataFrame:
        return asked.select(*KEYS, (F.lit(width) - F.col("us")).alias("us"), "event_id", *extra, F.lit(1).alias("phase"))

    def summed(rows: DataFrame, asking: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
        both = rows.withColumn("phase", F.lit(0)).unionByName(asking, allowMissingColumns=True)
        both = both.withColumns({m: F.coalesce(m, F.lit(0)) for m in measures})
        return running_before(both, keys, ["us", "phase", "event_id"], {m: "sum" for m in measures}, prefix="in_")

    one = F.lit(1).cast("long")
    visits = summed(logged.select(*KEYS, "resource_id", back, "event_id", one.alias("step")), probes(spans.day, "resource_id"),
                    [*KEYS, "resource_id"], ["step"]).withColumnRenamed("in_step", "same_resource")
    before, after = F.col("same_resource"), F.col("same_resource") + F.col("step")
    moves = visits.select(*KEYS, "us", "event_id", "phase", "same_resource", F.col("step").alias("res_n"),
                          ((after > 0).cast("long") - (before > 0).cast("long")).alias("res_kinds"), (_mass(after) - _mass(before)).alias("res_mass"))
    mixed = running_before(moves, KEYS, ["us", "phase", "event_id"], {m: "sum" for m in ("res_n", "res_kinds", "res_mass")}, prefix="in_").where("phase = 1")
    flags = summed(logged.select(*KEYS, back, "event_id", one.alias("flags_n"), F.col("flag").alias("flags_sum")), probes(spans.month),
                   KEYS, ["flags_n", "flags_sum"]).where("phase = 1")
    sent = summed(moved.select(*KEYS, back, "event_id", one.alias("moved_n"), F.col("transfer").cast("decimal(19,0)").alias("moved_sum")),
                  probes(spans.day), KEYS, ["moved_n", "moved_sum"]).where("phase = 1")
    totals = (mixed.select("event_id", "same_resource", "in_res_n", "in_res_kinds", "in_res_mass")
              .join(flags.select("event_id", "in_flags_n", "in_flags_sum"), "event_id")
              .join(sent.select("event_id", "in_moved_n", "in_moved_sum"), "event_id"))
    return _range_values(totals, events, baselines, facts, numeric, policy)


# ---- known values --------------------------------------------------------------------------

# Dimension -> score when the profile has never recorded the dimension.
NOVELTY_DEFAULTS = {"auth_method": .25, "endpoint": .25, "source_ip": .25, "device": .35, "posture": .3,
                    "location": .3, "resource": .25, "event_action": .25, "protocol_port": .25, "transition": .3}
_GATED = ("source_ip", "device", "posture")
_OPTIONAL = ("auth_method", "endpoint", "transition")


def transitions(commands) -> Column:
    """Ordered command pairs, the first from a start marker."""
    commands = F.col(commands)
    return F.zip_with(F.concat(F.array(F.lit("__start__")), F.slice(commands, 1, F.greatest(F.size(commands) - 1, F.lit(0)))),
                      commands, lambda a, b: F.concat(a, F.lit("->"), b))


def observed_values() -> Column:
    """Values an event shows in each novelty dimension.

    A dimension an event may leave out also carries a mark, so "has this profile any value of it" is
    the same equality join as "does it have this value".
    """
    def one(dim: str, value: Column) -> Column:
        return F.struct(F.lit(dim).alias("dim"), value.alias("value"))

    def optional(dim: str, value: Column) -> list[Column]:
        return [one(dim, value), one(dim, F.when(value.isNotNull(), F.lit(ANY)))]

    api, command = F.col("event_type") == "api_call", F.size("command_sequence") > 0
    fixed = F.array(
        *optional("auth_method", F.when(F.col("auth_method") != "not_applicable", F.col("auth_method"))),
        *optional("endpoint", F.when(api, F.concat("http_method", F.lit(":"), "api_route"))),
        one("source_ip", F.col("source_ip")), one("device", F.col("device_id")),
        one("fingerprint", F.col("device_fingerprint")),
        one("posture", F.concat_ws("|", "operating_system", "firmware_version", "browser", "device_mac_hash")),
        one("location", F.concat_ws("|", "country", "city")), one("resource", F.col("resource_id")),
        one("event_action", F.concat_ws(":", "event_type", "action")),
        one("protocol_port", F.concat_ws(":", "network_protocol", "destination_port")),
        one("privileged", F.when(F.col("is_privileged_action"), F.col("resource_id"))),
        one("transition", F.when(command, F.lit(ANY))))
    steps = F.transform(F.when(command, transitions("command_sequence")).otherwise(F.array().cast("array<string>")),
                        lambda t: F.struct(F.lit("transition").alias("dim"), t.alias("value")))
    return F.filter(F.concat(fixed, steps), lambda v: v["value"].isNotNull())


def first_sightings(events: DataFrame, wanted: DataFrame | None = None, policy: ProfilePolicy = ProfilePolicy(),
                    dims: tuple | None = None, kinds: tuple | None = None) -> DataFrame:
    """Each stay of a (key, dimension, value) in its list of trusted values, with the moment it is pushed out.

    `dims` and `kinds` leave out dimensions and levels nobody asks for; lists do not depend on each other. `wanted` may
    name the last time each key is asked for (`asked_us`): what is shown later is left out, and who goes then counts as listed.
    """
    levels = level_keys() if kinds is None else F.filter(level_keys(), lambda x: x["kind"].isin(*kinds))
    shown = observed_values() if dims is None else F.filter(observed_values(), lambda v: v["dim"].isin(*dims))
    rows = events.where("trusted").select(
        *([F.col("scope")] if "scope" in events.columns else [F.lit("").alias("scope")]), "us", "event_id",
        levels.alias("levels"), F.posexplode(shown).alias("place", "v"))
    rows = rows.select("scope", "us", "event_id", "place", F.explode("levels").alias("l"), "v.dim", "v.value")
    rows = rows.where(F.col("l.kind").isin(*MATURE_KINDS) | ~F.col("dim").isin(*_GATED, "fingerprint"))
    rows = rows.select("scope", F.col("l.key").alias("key"), "dim", "value", "us", "event_id", "place")
    if wanted is not None:
        wanted = cut_lineage(wanted)
        timed = "asked_us" in wanted.columns
        if few_keys(wanted):
            rows = rows.join(F.broadcast(wanted), KEYS).where(_within("us", "asked_us")).drop("asked_us") if timed else rows.join(F.broadcast(wanted), KEYS, "left_semi")
            wanted = None
        elif timed:
            level = F.split("key", ":")[0]
            levels = wanted.groupBy("scope", level.alias("_kind")).agg(F.max("asked_us").alias("level_us"))
            rows = (rows.withColumn("_kind", level).join(F.broadcast(levels), ["scope", "_kind"]).where(_within("us", "level_us"))
                    .drop("_kind", "level_us"))
            wanted = wanted.drop("asked_us")
    return spells(rows, policy.value_limits, policy.list_chunk, wanted)


def listed(asked: DataFrame, sightings: DataFrame) -> DataFrame:
    """Values asked for, with `known`: whether the value was in its list just before the event.

    The stays of a value do not overlap, so at most one row matches.
    """
    names = [*KEYS, "dim", "value"]
    stays = sightings.select(*[F.col(c).alias("_" + c) for c in names], "first_at", "gone_at")
    at = F.struct("us", "event_id")
    same = [F.col(c) == F.col("_" + c) for c in names]
    inside = (F.col("first_at") < at) & (F.col("gone_at").isNull() | (at <= F.col("gone_at")))
    joined = asked.join(stays, [*same, inside], "left")
    return joined.select(*asked.columns, F.col("first_at").isNotNull().alias("known"))


def novelty_features(events: DataFrame, baselines: DataFrame, sightings: DataFrame,
                     policy: ProfilePolicy = ProfilePolicy()) -> DataFrame:
    """F06, F09-F12, F14, F15, F19, F20 and F23-F25 from one equality join."""
    b = baselines.select("event_id", *KEYS, "baseline_kind", "baseline_count")
    mature = F.col("baseline_kind").isin(*MATURE_KINDS)
    asked = events.select("event_id", "us", F.explode(observed_values()).alias("v")).select(
        "event_id", "us", "v.*").join(b, "event_id")
    asked = asked.where(mature | ~F.col("dim").isin(*_GATED, "fingerprint"))
    matched = listed(asked, sightings)

    def shown(dim: str) -> Column:
        return (F.col("dim") == dim) & (F.col("value") != ANY)

    def is_known(dim: str) -> Column:
        return F.max(F.when(shown(dim), F.col("known").cast("int"))).alias("known_" + dim)

    def has_any(dim: str) -> Column:
        return F.max(F.when((F.col("dim") == dim) & (F.col("value") == ANY), F.col("known").cast("int"))).alias("any_" + dim)

    names = [d for d in NOVELTY_DEFAULTS if d != "transition"] + ["privileged", "fingerprint"]
    flags = cut_lineage(matched.groupBy("event_id").agg(
        *[is_known(d) for d in names], *[has_any(d) for d in _OPTIONAL],
        F.avg(F.when(shown("transition"), 1.0 - F.col("known").cast("double"))).alias("new_transitions")))
    unseen = (flags.where("known_fingerprint = 0").select("event_id").join(b.where("baseline_count > 0"), "event_id")
              .join(events.select("event_id", "us", F.col("device_fingerprint").alias("value")), "event_id"))
    distances = print_distances(unseen, sightings, policy)
    methods = auth_lists(events, b, sightings)
    joined = (b.join(flags, "event_id", "left").join(distances, "event_id", "left").join(methods, "event_id", "left")
              .join(events.select("event_id", "event_type", "auth_method", "is_privileged_action",
                                  F.size("command_sequence").alias("commands")), "event_id"))
    c = F.col
    started = c("baseline_count") > 0

    def always(dim: str) -> Column:
        score = F.when(started, 1.0 - F.coalesce(c("known_" + dim), F.lit(0))).otherwise(F.lit(NOVELTY_DEFAULTS[dim]))
        if dim in _GATED:
            score = F.when(mature, score).otherwise(F.lit(NOVELTY_DEFAULTS[dim]))
        return score.cast("double")

    def optional(dim: str) -> Column:
        return F.when(c("any_" + dim) == 1, 1.0 - F.coalesce(c("known_" + dim), F.lit(0))).otherwise(
            F.lit(NOVELTY_DEFAULTS[dim])).cast("double")

    method = (F.when(c("auth_method") == "not_applicable",
                     F.when(c("has_methods"), F.lit(0.0)).otherwise(F.lit(.25))).otherwise(optional("auth_method")))
    fingerprint = (F.when(~mature | ~started, F.lit(.35)).when(c("known_fingerprint") == 1, F.lit(0.0))
                   .otherwise(F.coalesce(c("distance"), F.lit(.35))))
    return joined.select(
        "event_id", method.alias("auth_method_novelty_score"),
        F.when(c("event_type") == "api_call", optional("endpoint")).otherwise(0.0)
        .alias("api_endpoint_method_novelty_score"),
        always("source_ip").alias("source_ip_novelty_score"), always("device").alias("new_device_score"),
        fingerprint.alias("device_fingerprint_distance"), always("posture").alias("device_posture_novelty_score"),
        always("location").alias("location_novelty_score"), always("resource").alias("resource_novelty_score"),
        always("event_action").alias("event_action_novelty_score"),
        F.when(c("is_privileged_action"), 1.0 - F.coalesce(c("known_privileged"), F.lit(0))).otherwise(0.0)
        .alias("privilege_expansion_score"),
        always("protocol_port").alias("protocol_port_novelty_score"),
        F.when(c("commands") <= 0, F.lit(0.0)).when(c("any_transition") == 1, c("new_transitions"))
        .otherwise(F.lit(.3)).alias("command_transition_novelty_score"))


def auth_lists(events: DataFrame, baselines: DataFrame, sightings: DataFrame) -> DataFrame:
    """Whether the baseline had recorded any method before an event that carries none."""
    silent = events.where(F.col("auth_method") == "not_applicable").select("event_id", "us").join(
        baselines.select("event_id", *KEYS), "event_id")
    started = sightings.where((F.col("dim") == "auth_method") & (F.col("value") == ANY)).select(*KEYS, "first_at")
    return silent.join(started, KEYS, "left").select(
        "event_id", F.coalesce(F.col("first_at") < F.struct("us", "event_id"), F.lit(False)).alias("has_methods"))


def print_distances(unseen: DataFrame, sightings: DataFrame, policy: ProfilePolicy = ProfilePolicy()) -> DataFrame:
    """Distance of unknown prints to the prints listed at that moment: the last `limit` that were appended."""
    limit = policy.value_limits["fingerprint"]
    prints = sightings.where(F.col("dim") == "fingerprint").select(
        *KEYS, "first_at.us", "first_at.event_id", F.col("value").alias("other"), F.lit(1).cast("long").alias("seen"))
    probes = unseen.select(*KEYS, "us", "event_id", "value", F.lit(0).cast("long").alias("seen"))
    # An event that first shows a print sits at the same position as its own probe: probe first.
    rows = prints.unionByName(probes, allowMissingColumns=True)
    counted = running_before(rows, KEYS, [*ORDER, "seen"], {"seen": "sum"}, prefix="had_")
    listed = counted.where("seen = 1").select(*KEYS, (F.col("had_seen") + 1).alias("rank"), "other")
    asked = counted.where("seen = 0 AND had_seen > 0").select(
        *KEYS, "event_id", "value",
        F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("had_seen") - limit + 1), F.col("had_seen"))).alias("rank"))
    return (asked.join(listed, [*KEYS, "rank"])
            .groupBy("event_id").agg(F.min(padded_distance("value", "other")).alias("distance")))


# ---- summaries ---------------------------------------------------------------------------

def profile_summary(events: DataFrame, policy: ProfilePolicy = ProfilePolicy()) -> DataFrame:
    """Profile card numbers per key: counts, means, deviations and numbers of known values.

    Histories are the last 500 facts of the key (of the successes, for sign-in hours).
    """
    rows = fan_out(events.where("trusted")).select(
        "key", "us", "event_id", "kind", F.lit("").alias("scope"), hour_of_day("us").alias("hour"),
        (F.col("authentication_result") == "success").cast("long").alias("success"),
        F.col("bytes_downloaded").alias("down"), F.col("session_duration_seconds").alias("duration"))
    rows = rows.withColumn("slot", _slot()).withColumn("one", F.lit(1).cast("long"))
    placed = running_before(rows, ["key"], ORDER, {"one": "sum", "success": "sum"}, slot="slot", prefix="p_")
    totals = rows.groupBy("key").agg(F.sum("one").alias("total"), F.sum("success").alias("successes"))
    tail = placed.join(totals, "key")
    limit = policy.numeric_limit
    recent = F.col("p_one") >= F.col("total") - limit
    login = (F.col("success") == 1) & (F.col("p_success") >= F.col("successes") - limit)

    def stats(name: str, cond: Column, value: str) -> list[Column]:
        v = F.when(cond, F.col(value).cast("double"))
        return [F.coalesce(F.avg(v), F.lit(0.0)).alias(name + "_mean"), F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias(name + "_std")]

    return tail.groupBy("key", F.col("kind").alias("baseline_kind")).agg(
        F.max("total").alias("event_count"), *stats("login_hour", login, "hour"),
        *stats("download", recent, "down"), *stats("session", recent, "duration"))


def known_values(events: DataFrame, dims: tuple = ("device", "location", "resource", "auth_method", "protocol_port"),
                 policy: ProfilePolicy = ProfilePolicy()) -> DataFrame:
    """Current known values of every key, one array per dimension in first-seen order.

    Arrays hold only values still inside their list, so each is bounded by its limit.
    """
    current = first_sightings(events, None, policy, dims).where((F.col("value") != ANY) & F.col("gone_at").isNull())
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("first_at", "value"))), lambda x: x["value"])
    return current.groupBy(*KEYS, "dim").agg(ordered.alias("known"))


def profile_cards(events: DataFrame, policy: ProfilePolicy = ProfilePolicy()) -> DataFrame:
    """Each entity's latest event with the runtime baseline it would be judged by, and its summary."""
    at = F.struct("us", "event_id")
    latest = events.groupBy("entity_id").agg(F.max_by(F.struct("device_id", "entity_type", "department", "user_role"), at).alias("l")).select(
        "entity_id", "l.*").withColumn("levels", level_keys())
    cards = profile_summary(events, policy)
    asked = latest.select("entity_id", "user_role", "department", F.explode("levels").alias("x")).select("entity_id", "user_role", "department", "x.kind", "x.key")
    needed = F.when(F.col("kind").isin(*MATURE_KINDS), policy.entity_minimum).otherwise(policy.peer_minimum)
    place = F.array_position(F.array(*[F.lit(k) for k in ("entity", "device", "peer", "global")]), F.col("kind"))
    joined = asked.join(cards, "key", "left").withColumn("place", F.when(F.col("event_count") >= needed, place))
    stats = [c for c in cards.columns if c not in ("key", "baseline_kind")]
    best = joined.groupBy("entity_id", "user_role", "department").agg(F.min_by(F.struct("kind", *stats), "place").alias("b"), F.min("place").alias("p"))
    none = F.col("p").isNull()
    result = best.select("entity_id", "user_role", "department", F.when(none, F.lit("global_default")).otherwise(F.col("b.kind")).alias("baseline_kind"),
                         *[F.when(none, 0).otherwise(F.col("b." + c)).alias(c) for c in stats])
    return result.withColumn("profile_maturity", maturity("baseline_kind"))
