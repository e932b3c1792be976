"""Imbalance-aware evaluation: curves, thresholds, budgets and per-class reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators.timeline import ranged_before, running_before
from wardline.session import cut_lineage

NORMAL = "normal"


def attack(label="label") -> Column:
    return F.col(label) != NORMAL


def ratio(top, bottom) -> Column:
    """Quotient whose denominator is at least one."""
    return top.cast("double") / F.greatest(bottom, F.lit(1)).cast("double")


def count_of(condition) -> Column:
    return F.coalesce(F.count_if(condition), F.lit(0))


# ---- score curves -----------------------------------------------------------------------------

def score_curve(df: DataFrame, score: str, positive: Column, groups=()) -> DataFrame:
    """Positives and negatives above, and at and above, each distinct score, with the totals of the group.

    Rows shrink to distinct scores before the shuffle, so a score shared by most rows is one row; the distinct scores
    are written once and cut into even ranges. Rows without a score do not count.
    """
    keys = list(groups) or ["_all"]
    counts = (df.select(*([F.col(g) for g in groups] or [F.lit(0).alias("_all")]), F.col(score).cast("double").alias("score"),
                        positive.alias("_pos")).where("score IS NOT NULL")
              .groupBy(*keys, "score").agg(F.count_if("_pos").alias("pos"), F.count_if(~F.col("_pos")).alias("neg")))
    ranked = ranged_before(counts.withColumn("falling", -F.col("score")), keys, ["falling"], ["pos", "neg"], prefix="above_")
    return ranked.select(*keys, "score", "pos", "neg", "above_pos", "above_neg", (F.col("above_pos") + F.col("pos")).alias("tp"),
                         (F.col("above_neg") + F.col("neg")).alias("fp"), F.col("all_pos").alias("positives"), F.col("all_neg").alias("negatives"))


def ranking_quality(df: DataFrame, score: str, positive: Column, groups=()) -> DataFrame:
    """ROC area with averaged ties and step-rule average precision; zero when a class is missing."""
    keys = list(groups) or ["_all"]
    curve = score_curve(df, score, positive, groups)
    below = F.col("negatives") - F.col("fp")
    wins = F.sum(F.col("pos").cast("double") * (below + F.col("neg") / 2.0))
    steps = F.sum(F.col("pos").cast("double") * F.col("tp") / (F.col("tp") + F.col("fp")))
    summed = curve.groupBy(*keys).agg(wins.alias("_w"), steps.alias("_s"), F.max("positives").alias("p"), F.max("negatives").alias("n"))
    one = (F.col("p") == 0) | (F.col("n") == 0)
    result = summed.select(*keys, F.when(one, 0.0).otherwise(
        F.col("_w") / F.when(~one, F.col("p").cast("double") * F.col("n"))).alias("roc_auc"),
        F.when(one, 0.0).otherwise(F.col("_s") / F.when(~one, F.col("p"))).alias("pr_auc"))
    return result if groups else result.drop("_all")


def tuned_threshold(df: DataFrame, score: str, max_normal_fpr: float, fallback: float | None = None,
                    positive: Column | None = None) -> DataFrame:
    """Threshold with the best (recall, precision, -fpr, threshold) under a false-positive limit.

    Every distinct score is a candidate. With a fallback the result keeps one row even when no
    score qualifies.
    """
    positive = attack() if positive is None else positive
    curve = score_curve(df, score, positive)
    rated = curve.select(
        F.col("score").alias("threshold"), ratio(F.col("tp"), F.col("positives")).alias("recall"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("fp"), F.col("negatives")).alias("false_positive_rate"),
        (F.col("tp") + F.col("fp")).alias("alerts"))
    best = rated.where(F.col("false_positive_rate") <= max_normal_fpr).agg(F.max(F.struct(
        "recall", "precision", (-F.col("false_positive_rate")).alias("minus_fpr"), "threshold", "alerts")).alias("b"))
    result = best.where("b IS NOT NULL").select(
        "b.threshold", "b.recall", "b.precision", (-F.col("b.minus_fpr")).alias("false_positive_rate"), "b.alerts")
    if fallback is None:
        return result
    at = F.col("score") >= fallback

    def summed(column: str, where=None) -> Column:
        return F.coalesce(F.sum(F.col(column) if where is None else F.when(where, F.col(column))), F.lit(0))

    tp, fp = summed("pos", at), summed("neg", at)
    spare = curve.agg(F.lit(float(fallback)).alias("threshold"), ratio(tp, summed("pos")).alias("recall"), ratio(tp, tp + fp).alias("precision"),
                      ratio(fp, summed("neg")).alias("false_positive_rate"), (tp + fp).alias("alerts"), F.lit(1).alias("_spare"))
    both = result.withColumn("_spare", F.lit(0)).unionByName(spare)
    return (both.agg(F.min_by(F.struct(*result.columns), "_spare").alias("b")).select("b.*"))


def budget_metrics(df: DataFrame, score: str, fraction: float = .01, event_id: str = "event_id") -> DataFrame:
    """Metrics of the highest `ceil(n * fraction)` scores; ties are broken by the digest of the id.

    The cut-off is one row of the score curve. Only rows tied at the cut-off are ranked, in slots of
    the digest, which spreads even a very large tie evenly.
    """
    rows = F.col("positives") + F.col("negatives")
    curve = score_curve(df, score, attack()).withColumn("budget", F.greatest(F.lit(1), F.ceil(rows * F.lit(fraction))).cast("long"))
    cut = (curve.where((F.col("above_pos") + F.col("above_neg") < F.col("budget")) & (F.col("tp") + F.col("fp") >= F.col("budget")))
           .select("_all", F.col("score").alias("threshold"), "above_pos", (F.col("budget") - F.col("above_pos") - F.col("above_neg")).alias("left"),
                   "budget", rows.alias("rows"), "positives"))
    cut = cut_lineage(cut)
    tied = (df.select(F.col(score).cast("double").alias("threshold"), attack().cast("long").alias("hit"),
                      F.md5(F.col(event_id).cast("binary")).alias("digest")).join(F.broadcast(cut), "threshold"))
    tied = tied.withColumn("one", F.lit(1).cast("long")).withColumn("slot", F.conv(F.substring("digest", 1, 4), 16, 10).cast("long"))
    ranked = running_before(tied, ["_all"], ["digest"], {"one": "sum"}, slot="slot", prefix="before_")
    taken = ranked.where(F.col("before_one") < F.col("left")).groupBy("_all").agg(F.sum("hit").alias("tied_hits"))
    tp = F.col("above_pos") + F.col("tied_hits")
    return taken.join(F.broadcast(cut), "_all").select(
        F.lit(fraction).alias("budget_fraction"), F.col("budget").alias("budget_count"),
        (tp / F.col("budget")).alias("precision"), ratio(tp, F.col("positives")).alias("recall"),
        (F.col("budget") - tp).alias("false_positives"), "threshold",
        (F.col("budget") / F.col("rows")).alias("alert_rate"))


# ---- alert metrics -----------------------------------------------------------------------------

def alert_metrics(df: DataFrame, alerted: Column, groups=(), label: str = "label") -> DataFrame:
    hit = attack(label)
    tp, fp = count_of(hit & alerted), count_of(~hit & alerted)
    p, n = count_of(hit), count_of(~hit)
    return df.groupBy(*groups).agg(
        (tp + fp).alias("alert_count"), ((tp + fp) / F.count("*")).alias("alert_rate"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp, p).alias("recall"),
        ratio(fp, n).alias("false_positive_rate"), fp.alias("false_positives"))


def scenario_recall(df: DataFrame, alerted: Column) -> DataFrame:
    """Found and existing attack scenarios per class and overall.

    Scenarios are reduced to one row each before they are counted, so no distinct set is gathered.
    """
    per = df.where(attack()).groupBy("label", "scenario_id").agg(F.max(alerted.cast("int")).alias("found"))
    by_class = per.groupBy("label").agg(F.sum("found").cast("long").alias("detected"), F.count("*").alias("total"))
    whole = (per.groupBy("scenario_id").agg(F.max("found").alias("found"))
             .agg(F.coalesce(F.sum("found"), F.lit(0)).cast("long").alias("detected"), F.count("*").alias("total"))
             .withColumn("label", F.lit("all")))
    return by_class.unionByName(whole).withColumn("recall", ratio(F.col("detected"), F.col("total")))


def confusion(df: DataFrame, actual: str = "label", predicted: str = "predicted_attack") -> DataFrame:
    """Counts for the full grid of classes that occur on either side."""
    pairs = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    classes = pairs.select(F.explode(F.array("actual", "predicted")).alias("c")).distinct()
    grid = classes.agg(F.collect_set("c").alias("s")).select(F.explode("s").alias("actual"), "s").select(
        "actual", F.explode("s").alias("predicted"))
    return grid.join(pairs, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def class_report(df: DataFrame, actual: str = "label", predicted: str = "predicted_attack") -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy, macro and weighted averages.

    Everything derives from the class-pair counts, one row per pair.
    """
    pairs = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("name"), F.col("n").alias("support"), F.lit(0).cast("long").alias("given")),
        F.struct(F.col("p").alias("name"), F.lit(0).cast("long").alias("support"), F.col("n").alias("given")))).alias("s"),
        "a", "p", "n").select("s.*", F.when((F.col("a") == F.col("p")) & (F.col("s.given") > 0), F.col("n")).otherwise(0).alias("hit"))
    per = sides.groupBy("name").agg(F.sum("support").alias("support"), F.sum("given").alias("given"), F.sum("hit").alias("hit"))

    def safe(top, bottom):
        return F.when(bottom > 0, top / F.when(bottom > 0, bottom)).otherwise(0.0)

    per = per.withColumn("precision", safe(F.col("hit"), F.col("given"))).withColumn("recall", safe(F.col("hit"), F.col("support")))
    per = per.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    rows = per.select("name", "precision", "recall", "f1", "support")
    weight = F.sum("support")
    macro = rows.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], weight.alias("support")).withColumn("name", F.lit("macro avg"))
    weighted = rows.agg(*[(F.sum(F.col(c) * F.col("support")) / weight).alias(c) for c in ("precision", "recall", "f1")],
                        weight.alias("support")).withColumn("name", F.lit("weighted avg"))
    accuracy = per.agg((F.sum("hit") / weight).alias("f1"), weight.alias("support")).select(
        F.lit("accuracy").alias("name"), F.col("f1").alias("precision"), F.col("f1").alias("recall"), "f1", "support")
    return rows.unionByName(macro).unionByName(weighted).unionByName(accuracy)




def history_bucket(count: str) -> Column:
    value = F.col(count)
    return F.when(value < 1, "0").when(value < 3, "1-2").when(value < 12, "3-11").otherwise("12+")


def cold_start_metrics(df: DataFrame, alerted: Column, flagged: Column, maturity: int = 12) -> DataFrame:
    """Benign safety and coverage by amount of history, and for all immature subjects together."""
    hit = attack()
    part = F.explode(F.filter(F.array(history_bucket("subject_history_count"), F.when(
        F.col("subject_history_count") < maturity, F.lit("cold"))), lambda x: x.isNotNull())).alias("bucket")
    rows = df.select("label", "predicted_attack", alerted.alias("alerted"), flagged.alias("flagged"), part)
    tp, fp = count_of(hit & F.col("alerted")), count_of(~hit & F.col("alerted"))
    return rows.groupBy("bucket").agg(
        F.count("*").alias("sample_count"), count_of(~hit).alias("normal_count"), count_of(hit).alias("attack_count"),
        ratio(fp, count_of(~hit)).alias("benign_false_positive_rate"), ratio(tp, count_of(hit)).alias("attack_recall"),
        ratio(tp, tp + fp).alias("finding_precision"),
        F.avg((F.col("label") == F.col("predicted_attack")).cast("double")).alias("classifier_accuracy"),
        ratio(count_of(hit & F.col("flagged")), count_of(hit)).alias("behavioral_attack_recall"))


def baseline_usage(df: DataFrame, maturity: int = 12) -> DataFrame:
    return df.where(F.col("subject_history_count") < maturity).groupBy("baseline_kind").agg(F.count("*").alias("n"))


def behavioural_layer(df: DataFrame, flagged: Column) -> DataFrame:
    """Share of flagged events per class; for `normal` this is the false-positive rate."""
    return df.groupBy("label").agg(F.count("*").alias("n"), F.avg(flagged.cast("double")).alias("flagged_share"))


def population_rates(df: DataFrame, alerted: Column, flagged: Column) -> DataFrame:
    """Insider-drift false positives, attacked-entity recall, prevalence and alerts per 10,000."""
    drifting = F.col("scenario_id").startswith("insider_drift-")
    entities = df.where(attack()).groupBy("entity_id").agg(F.max(alerted.cast("int")).alias("found"))
    reached = entities.agg(ratio(F.coalesce(F.sum("found"), F.lit(0)), F.count("*")).alias("attacked_entity_recall"))
    share = df.agg(
        F.coalesce(F.avg(F.when(drifting, alerted.cast("double"))), F.lit(0.0)).alias("insider_drift_false_positive_rate"),
        F.coalesce(F.avg(F.when(drifting, flagged.cast("double"))), F.lit(0.0)).alias("behavioral_insider_drift_false_positive_rate"),
        F.avg(attack().cast("double")).alias("attack_prevalence"), F.avg(alerted.cast("double")).alias("alert_rate"),
        (F.avg(alerted.cast("double")) * 10_000).alias("alerts_per_10000"), F.count("*").alias("sample_count"))
    return share.crossJoin(reached)


def outcome_counters(df: DataFrame, alerted: Column, opened: Column) -> DataFrame:
    """Replay outcome counters against labels."""
    hit, right = attack(), F.col("predicted_attack") == F.col("label")
    return df.agg(
        F.count("*").alias("processed_events"), count_of(hit & alerted).alias("detected_attack_events"),
        count_of(hit & ~alerted).alias("missed_attack_events"), count_of(hit & right).alias("correct_attack_classifications"),
        count_of(hit & ~right).alias("misclassified_attack_events"), count_of(~hit & alerted).alias("false_positive_events"),
        count_of(opened).alias("new_incident_count"))


def promotion_gate(old: DataFrame, new: DataFrame) -> DataFrame:
    """Challenger checks on two one-row metric tables; with no champion every check passes."""
    joined = new.select(F.lit(1).alias("k"), *[F.col(c).alias("n_" + c) for c in ("macro_f1", "false_positive_rate", "precision")]).join(
        old.select(F.lit(1).alias("k"), *[F.col(c).alias("o_" + c) for c in ("macro_f1", "false_positive_rate", "precision")]), "k", "left")
    f1 = F.coalesce(F.col("n_macro_f1") >= F.col("o_macro_f1") * .98, F.lit(True))
    fpr = F.coalesce(F.col("n_false_positive_rate") <= F.col("o_false_positive_rate") + .001, F.lit(True))
    top = F.coalesce(F.col("n_precision") >= F.col("o_precision") * .95, F.lit(True))
    return joined.select(f1.alias("improves_f1"), fpr.alias("controls_fpr"), top.alias("preserves_precision"), (f1 & fpr & top).alias("activated"))


# ---- operations --------------------------------------------------------------------------------

def latency_summary(df: DataFrame, column: str) -> DataFrame:
    from wardline.operators.scaling import long_quantiles
    values = df.select(F.lit("latency").alias("name"), F.col(column).cast("double").alias("value"))
    tails = long_quantiles(values, (.5, .95, .99))
    rest = values.groupBy("name").agg(F.avg("value").alias("mean"), F.min("value").alias("minimum"), F.max("value").alias("maximum"))
    return tails.join(rest, "name").select(F.col("q0").alias("p50"), F.col("q1").alias("p95"), F.col("q2").alias("p99"), "mean", "minimum", "maximum")


def ordering_violations(df: DataFrame, entity: str, arrival: str, sequence: str, slot: str | None = None, width: int = 1_000_000) -> DataFrame:
    """Entities for which some arrival carries a lower sequence number than an earlier arrival."""
    seen = running_before(df.select(entity, arrival, F.col(sequence).alias("highest")), [entity], [arrival],
                          {"highest": "max"}, slot=slot, width=width)
    return (seen.where(F.col("prior_highest") > F.col("highest")).select(entity).distinct()
            .agg(F.count("*").alias("violating_entities")))
