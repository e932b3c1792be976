"""Lists of limited length that take new values and push out their oldest: what was listed when.

A value is appended when the list does not hold it; beyond the limit the oldest entry goes. A value that went and
is shown again is appended again, so it may be listed several times, each a spell of its own.
"""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.scalar import HOUR
from wardline.operators.timeline import dealt_join, position_index, sliced
from wardline.session import cut_lineage

LIST = ["scope", "key", "dim"]
AT = ["us", "event_id", "place"]
ANY = "*"  # the mark that a list has any entry; it is no entry itself
CHUNK = 200_000


def replay(shown: list[str], held: list[str], limit: int) -> list[int]:
    """Which of the values shown in order are appended to a list that holds `held`, oldest first."""
    listed, added = dict.fromkeys(held), []
    for i, value in enumerate(shown):
        if value not in listed:
            listed[value] = None
            added.append(i)
            if len(listed) > limit:
                del listed[next(iter(listed))]
    return added


def additions(rows: DataFrame, limits: Mapping[str, int], chunk: int) -> DataFrame:
    """Each time a value is appended: LIST, `value`, `position` and `number`, from 1 within the list.

    `rows` holds LIST, `value` and `position`. Lists are replayed in chunks of `chunk` positions, all lists side by
    side; from one chunk to the next only the list itself is carried, as the last `limit` additions. A task holds one
    chunk of one list, and a round that is lost is run again from the written table of the one before.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in LIST}
    schema = ", ".join(f"{c} {kinds[c]}" for c in LIST) + ", value string, position bigint, number bigint"
    limits = dict(limits)

    def advance(key, part: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        part, state = part.sort_values("position"), state.sort_values("number")
        places = replay(part["value"].tolist(), state["value"].tolist(), limits[key[2]])
        out = part.iloc[places][[*LIST, "value", "position"]]
        return out.assign(number=range(int(state["number"].max() if len(state) else 0) + 1, int(state["number"].max() if len(state) else 0) + 1 + len(out)))

    spark = rows.sparkSession
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col("dim"))
    held = spark.createDataFrame([], schema)
    found = None
    for part in sliced(rows, "position", chunk, LIST):
        added = cut_lineage(part.groupBy(*LIST).cogroup(held.groupBy(*LIST)).applyInPandas(advance, schema))
        newest = F.row_number().over(Window.partitionBy(*LIST).orderBy(F.desc("number")))
        held = cut_lineage(held.unionByName(added).withColumn("_age", newest).where(F.col("_age") <= limit).drop("_age"))
        found = added if found is None else found.unionByName(added)
    return found


def spells(shown: DataFrame, limits: Mapping[str, int], chunk: int = CHUNK, wanted: DataFrame | None = None) -> DataFrame:
    """One row per stay of a value in its list: LIST, `value`, `first_at`, `gone_at` (null while listed).

    `shown` holds LIST, `value` and its moment AT (`place` orders the values of one event). Lists that never
    overflow are a plain aggregate; only those with more distinct values than their limit are replayed. `wanted` (scope,
    key) names the lists asked for: they are picked after the aggregate, which leaves one row per list and value.
    """
    first = shown.groupBy(*LIST, "value").agg(F.min(F.struct(*AT)).alias("first"))
    first = cut_lineage(first if wanted is None else dealt_join(first, wanted, ["scope", "key"], "value", "left_semi", 4))
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col("dim"))
    crowded = cut_lineage(first.where(F.col("value") != ANY).groupBy(*LIST).count().where(F.col("count") > limit).select(*LIST))
    at = F.struct("first.us", "first.event_id").alias("first_at")
    never = F.lit(None).cast("struct<us:bigint,event_id:string>").alias("gone_at")
    if crowded.isEmpty():
        return first.select(*LIST, "value", at, never)
    roomy = first.where(F.col("value") == ANY).unionByName(first.where(F.col("value") != ANY).join(crowded, LIST, "left_anti"))
    rows = dealt_join(shown.where(F.col("value") != ANY).select(*LIST, "value", *AT), crowded, LIST, "event_id", "left_semi")
    rows = cut_lineage(position_index(rows, LIST, AT, width=HOUR))
    added = additions(rows.select(*LIST, "value", "position"), limits, chunk)
    added = cut_lineage(added.join(rows.select(*LIST, "position", F.struct("us", "event_id").alias("first_at")), [*LIST, "position"]))
    # The list is full from its limit on: each further addition pushes out the one `limit` before it.
    pushing = added.select(*LIST, (F.col("number") - limit).alias("number"), F.col("first_at").alias("gone_at"))
    stays = added.join(pushing, [*LIST, "number"], "left").select(*LIST, "value", "first_at", "gone_at")
    return roomy.select(*LIST, "value", at, never).unionByName(stays)
