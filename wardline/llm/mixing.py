"""Mixing sources to target weights along a curriculum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import FILE, LOCATOR, ROW, anchored, prefix_sums, source_rows, with_locator, words_of, write_table

WEIGHTS = (3, 1, 2)
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
SHARE, LIMIT = 1.5, 2


def _cycled(values: Sequence, rank: str) -> Column:
    return F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (F.col(rank) % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """One row per source: `source`, `rank` (code point order, null last), `base` (words of the sources before), `source_size`, `target`.

    The sources share `share` x all words by weight; a source stops at `limit` x its size and the excess is
    shared again by weight. The fixed point is a level L with target = min(limit x size, L x weight): sources
    are ordered by size / weight, running totals give the level that each would set, and the first source
    that stays under its own limit sets it.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = prefix_sums(totals.withColumn("one", F.lit(1)), [F.col("source").asc_nulls_last()], {"rank": "one", "base": "source_size"}, "sources")
    scale = 1
    for w in weights:
        scale *= w
    ranked = ranked.withColumn("weight", _cycled(weights, "rank"))
    caps = ranked.withColumns({"cap": F.col("source_size") * limit, "fill": F.col("source_size") * (F.lit(scale) / F.col("weight")).cast("long")})
    caps = write_table(prefix_sums(caps, [F.col("fill"), F.col("rank")], {"caps_before": "cap", "weights_before": "weight"}, "fill"), "levels")
    whole = caps.agg(F.sum("source_size"), F.sum("weight")).first()
    demand, weight = share * (whole[0] or 0), whole[1] or 0
    level = (F.lit(float(demand)) - F.col("caps_before")) / (F.lit(weight) - F.col("weights_before"))
    open_ = caps.withColumn("level", level).filter(F.col("level") * F.col("weight") <= F.col("cap"))
    found = open_.agg(F.min_by("level", F.struct("fill", "rank"))).first()[0]
    reach = F.lit(found) * F.col("weight") if found is not None else F.col("cap").cast("double")
    return caps.select("source", "rank", "base", "source_size", F.least(F.col("cap").cast("double"), reach).alias("target"))


def training_time(share: Column, weights: Column, steps: int) -> Column:
    """The time in [0, 1] at which a source has asked for `share` of its words.

    `weights` holds the source's weight at `steps` + 1 equally spaced times. The weight is linear in between, so
    the demand is its integral, quadratic in each step: the step is found from the cumulated areas and the
    quadratic solved in it.
    """
    at = [F.element_at(weights, i + 1) for i in range(steps + 1)]
    areas = [(at[i] + at[i + 1]) / (2 * steps) for i in range(steps)]
    asked = share * sum(areas[1:], areas[0])
    done, found = F.lit(0.0), []
    for i, area in enumerate(areas):
        rest, slope = asked - done, (at[i + 1] - at[i]) * steps
        root = F.sqrt(F.greatest(at[i] * at[i] + F.lit(2.0) * slope * rest, F.lit(0.0)))
        inside = F.when(at[i] + root > 0, F.lit(2.0) * rest / (at[i] + root)).otherwise(F.lit(0.0))
        done = done + area
        found.append((done, F.lit(i / steps) + inside))
    time = found[-1][1]
    for end, value in reversed(found[:-1]):
        time = F.when(asked <= end, value).otherwise(time)
    return F.least(F.greatest(time, F.lit(0.0)), F.lit(1.0))


def curriculum(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = WEIGHTS, schedules: Sequence[Sequence[float]] = SCHEDULES, share: float = SHARE, limit: int = LIMIT,
) -> DataFrame:
    """One row per row of `docs`: locator, id, `size`, `source_size`, `target`, `taken` and `copies`.

    `copies` lists what the mix takes of the row: (epoch, words, position); position in [0, 1] is the training
    time. A source's words lie on a line in the order of a digest of the id; the mix takes the first `target`
    words of the line repeated `limit` times, so the taken words of a source add up to its target rounded down,
    at most one copy per source is cut, and no row is taken more than `limit` times. The position is the
    time at which the integral of the source's weight schedule reaches the middle of the copy.

    A null text has size 0 and is never taken; a null source is a source of its own; equal ids are told apart
    by their place; an empty table gives an empty result. Reruns give the same rows.
    """
    src = source_rows(docs, id=id_col, text=text_col, source=source_col)
    sizes = write_table(src.select(*LOCATOR, "id", "source", words_of(F.col("text")).alias("size"), F.md5(F.col("id").cast("string")).alias("draw")), "sizes")
    targets = write_table(source_targets(sizes, weights, share, limit), "targets")
    order = [F.col("source").asc_nulls_last(), F.col("draw"), F.col("id"), F.col(FILE), F.col(ROW)]
    placed = prefix_sums(sizes, order, {"before": "size"}, "line")
    per = targets.select(F.col("source").alias("s"), "rank", "base", "source_size", "target")
    joined = placed.join(per, F.col("source").eqNullSafe(F.col("s")))
    begin, goal = F.col("before") - F.col("base"), F.floor("target").cast("long")
    curve = _cycled([F.array(*[F.lit(float(w)) for w in s]) for s in schedules], "rank")
    steps = len(schedules[0]) - 1

    def copy(epoch: int) -> Column:
        start = begin + epoch * F.col("source_size")
        words = F.least(F.greatest(goal - start, F.lit(0)), F.col("size"))
        middle = F.when(F.col("target") > 0, (start + words / 2) / F.col("target")).otherwise(F.lit(0.0))
        return F.struct(F.lit(epoch).alias("epoch"), words.cast("long").alias("words"), training_time(F.least(middle, F.lit(1.0)), curve, steps).alias("position"))

    copies = F.filter(F.array(*[copy(i) for i in range(limit)]), lambda c: c["words"] > 0)
    out = joined.select(*LOCATOR, "id", "size", "source_size", "target", copies.alias("copies"))
    return out.withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]))


def in_training_order(plan: DataFrame) -> DataFrame:
    """The rows of a curriculum range-sorted by the position of their first copy; rows that the mix leaves out come last."""
    order = [F.try_element_at("copies", F.lit(1))["position"].asc_nulls_last(), F.md5(F.col("id").cast("string")), F.col(FILE), F.col(ROW)]
    return plan.repartitionByRange(*order).sortWithinPartitions(*order)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents of the mix in training order, with the columns of `docs`; a repeated document comes once per copy.

    The one cut copy of a source keeps its first words. `n_chars`, where there is one, follows the text.
    Range-sorted by position, then by digest of the id and place.
    """
    names = docs.columns
    docs = anchored(docs)
    placed = with_locator(docs)
    plan = write_table(curriculum(docs, id_col, text_col, source_col, **options).filter("taken > 0").select(
        F.col(FILE).alias("_p_file"), F.col(ROW).alias("_p_row"), F.col("size").alias("_p_size"), F.explode("copies").alias("_p_copy")), "plan")
    full = placed.join(plan, (placed[FILE] == plan["_p_file"]) & (placed[ROW] == plan["_p_row"]))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("_p_copy.words").cast("int")), "")
    text = F.when(F.col("_p_copy.words") < F.col("_p_size"), cut).otherwise(F.col(text_col))
    changed = {text_col: text}
    out = full.withColumns(changed)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("_p_copy.words") < F.col("_p_size"), F.length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    order = [F.col("_p_copy.position"), F.md5(F.col(id_col).cast("string")), F.col("_p_file"), F.col("_p_row"), F.col("_p_copy.epoch")]
    return out.repartitionByRange(*order).sortWithinPartitions(*order).select(*names)
