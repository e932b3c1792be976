"""Exact URL filters by a cascade of Bloom filters."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import write_table

# The rules of the contract and the listed sites of the default list.
BLOCK_RULES = ("net/", "example.com/de/")
ALLOW_RULES = ("example.net/en/", "org/fr/")
LISTED = (
    "adult-x.example.com/", "ads-track.example.com/", "ads-track.example.org/", "casino-win.example.net/", "cheap-pills.example.com/",
    "cheap-pills.example.net/", "free-bets.example.com/", "free-bets.example.net/", "spam-farm.example.org/",
)
MAX_LIST_BYTES = 32 << 20  # of one filter level, inlined into the plan; every level is in proportion to the list


@dataclass(frozen=True)
class Level:
    """One Bloom filter: `bits` positions, `hashes` per key, the bytes of the bit array."""

    bits: int
    hashes: int
    data: bytes


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host is what follows the first `://` up to `/`, `?`, `#`, lower-cased in A-Z; the path follows up to `?` or `#`.

    A null url, or one without `://`, has an empty host and path.
    """
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """All keys that could be listed for a url: every domain suffix of the host with every path prefix of a listed length."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length(path))
    prefixes = F.transform(fitting, lambda n: F.substring(path, F.lit(1), n))
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))))


def _position(key: Column, level: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level * 64 + i)), F.lit(bits))


def _held(key: Column, number: int, level: Level) -> Column:
    """Whether the filter holds the key: each of its bits is set."""
    found = F.lit(True)
    data = F.lit(bytearray(level.data))
    for i in range(level.hashes):
        at = _position(key, number, i, level.bits)
        byte = F.conv(F.hex(F.substring(data, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        found = found & (byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0)
    return found


def _build(keys: DataFrame, number: int, count: int, rate: float) -> Level:
    """The filter of the keys: bit numbers are set in blocks byte by byte, one row per byte."""
    bits = max(64, math.ceil(count * -math.log(rate) / math.log(2) ** 2 / 64) * 64)
    if bits > MAX_LIST_BYTES * 8:
        raise ValueError(f"the filter of {count} keys needs {bits // 8} bytes, over {MAX_LIST_BYTES}: split the list")
    hashes = max(1, round(bits / count * math.log(2)))
    at = keys.select(F.explode(F.array(*[_position(F.col("key"), number, i, bits) for i in range(hashes)])).alias("at"))
    byte = at.groupBy(F.floor(F.col("at") / 8).alias("byte")).agg(F.bit_or(F.pow(F.lit(2), F.col("at") % 8).cast("int")).alias("value"))
    data = bytearray(bits // 8)
    for row in byte.toLocalIterator():
        data[row["byte"]] = row["value"]
    return Level(bits, hashes, bytes(data))


def in_cascade(key: Column, levels: Sequence[Level]) -> Column:
    """Membership by the first level that does not hold the key: at an odd level (1, 3, ..) it is not listed, at an even one it is.

    A key that passes every level belongs to the side that the last level encodes.
    """
    verdict = F.lit(len(levels) % 2 == 1)
    for number in range(len(levels) - 1, -1, -1):
        verdict = F.when(_held(key, number, levels[number]), verdict).otherwise(F.lit(number % 2 == 1))
    return verdict


def first_rate(listed: int, universe: int, rate: float = 0.5) -> float:
    """The false-positive rate of level 1: it lets through about as many wrong keys as there are listed ones.

    With it level 2 is as large as level 1 without its logarithm, and does not grow with the universe.
    """
    return min(rate, math.sqrt(rate) * listed / max(universe - listed, 1))


def build_cascade(listed: DataFrame, universe: DataFrame, rate: float = 0.5) -> list[Level]:
    """A cascade that is exact for every key of `universe` (column `key`, distinct).

    Level 1 encodes the listed keys that occur; level 2 the keys of the universe that level 1 holds wrongly;
    level 3 the listed keys that level 2 holds wrongly, and so on until no wrong key is left. Level 1's rate is
    (listed / universe) x sqrt(1/2), later ones 1/2, so level 1 takes about 1.44 log2(universe / listed) bits for each
    listed key and the later levels a bounded number. No join takes part in a lookup; the build marks listed keys once.
    """
    marks = listed.select(F.col("key").alias("listed_key")).distinct()
    both = universe.join(marks, F.col("key") == F.col("listed_key"), "left").select("key", F.col("listed_key").isNotNull().alias("in"))
    sides = {True: write_table(both.filter(F.col("in")).select("key"), "listed"), False: write_table(both.filter(~F.col("in")).select("key"), "unlisted")}
    levels: list[Level] = []
    side = True
    while True:
        keys = sides[side]
        count = keys.count()
        if not count:
            return levels
        levels.append(_build(keys, len(levels), count, rate if levels else first_rate(count, universe.count(), rate)))
        side = not side
        sides[side] = write_table(sides[side].filter(_held(F.col("key"), len(levels) - 1, levels[-1])), "wrong")


def judge_urls(
    pages: DataFrame, url_col: str = "url", block: Sequence[str] = BLOCK_RULES, allow: Sequence[str] = ALLOW_RULES, listed: Sequence[str] = LISTED,
) -> DataFrame:
    """The columns of `pages` plus `judged`: struct(host, path, rule, verdict).

    A key is `host` + `path`; it fits the host and all its subdomains if the url's path starts with the key's.
    Of the rules that fit the longest wins (at equal length the allowing one) and gives the verdict. Without a
    rule the list decides: blocked if a listed key fits, else allowed; `rule` is then null.

    Method: one Bloom cascade each for allow rules, block rules and listed keys, exact over the complete
    universe of keys that the pages can match; a lookup is bit tests inside the plan. Null urls have no key and
    are allowed; repeated rows are judged alike; an empty table gives an empty result. The columns of `pages`
    keep their names; a column `judged` of the input is replaced.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col(url_col))
    sets = {"allow": set(allow), "block": set(block), "listed": set(listed)}
    lengths = sorted({len(k) - k.index("/") for keys in sets.values() for k in keys})
    keys_of = candidate_keys(F.col("_u_host"), F.col("_u_path"), lengths)
    urls = pages.select(host.alias("_u_host"), path.alias("_u_path")).distinct()
    universe = write_table(urls.select(F.explode(keys_of).alias("key")).distinct(), "universe")
    cascades = {name: build_cascade(spark.createDataFrame([(k,) for k in sorted(keys)], "key string"), universe) for name, keys in sets.items()}
    split = pages.withColumns({"_u_host": host, "_u_path": path}).withColumn("_u_keys", keys_of)

    def longest(name: str) -> Column:
        return F.array_max(F.transform(F.filter("_u_keys", lambda k: in_cascade(k, cascades[name])), lambda k: F.struct(F.length(k).alias("size"), k.alias("rule"))))

    found = split.withColumns({"_u_allow": longest("allow"), "_u_block": longest("block"), "_u_listed": F.exists("_u_keys", lambda k: in_cascade(k, cascades["listed"]))})
    allowed = F.col("_u_allow").isNotNull() & (F.col("_u_block").isNull() | (F.col("_u_allow.size") >= F.col("_u_block.size")))
    judged = F.struct(
        F.col("_u_host").alias("host"), F.col("_u_path").alias("path"),
        F.when(allowed, F.col("_u_allow.rule")).otherwise(F.col("_u_block.rule")).alias("rule"),
        F.when(allowed, "allow").when(F.col("_u_block").isNotNull() | F.col("_u_listed"), "block").otherwise("allow").alias("verdict"))
    return found.withColumn("judged", judged).select(*[c for c in pages.columns if c != "judged"], "judged")
