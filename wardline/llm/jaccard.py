"""N-gram Jaccard join by chosen paths."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import FILE, LOCATOR, ROW, anchored, arrow_batches, drop_table, source_rows, without_rows, write_table
from wardline.llm.components import components
from wardline.llm.textkit import minhash, multipliers, shingles, smallest_labels, sorted_groups

TOKENS = 64  # minhash tokens that stand for a set
BUCKET = 96  # rows of a bucket that are compared directly
TILE_ROWS, TILE_ITEMS = 512, 1_000_000  # of a tile of a larger bucket
DEPTH = 4  # splits of a path at most; larger buckets are then compared tile by tile
DENSE = 0.7  # a split that leaves this part of the rows together found a group of near copies
SPAN = 1024  # rows of a file whose places are sent as one row of bits
MARGIN = 0.22  # over four standard deviations of an estimate from TOKENS tokens


def _place() -> Column:
    return F.struct(F.col("id").isNull().alias("unknown"), F.col("id").alias("id"), F.col(FILE).alias("file"), F.col(ROW).alias("row"))


def sketches(rows: DataFrame, size: int, seed: int) -> DataFrame:
    """Locator, id, `digest` of the shingle set (null without words), `n` shingles, `tokens`."""
    a, b = multipliers(TOKENS, seed)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, counts, tokens = [], [], []
            for text in batch.column(3).to_pylist():
                items = shingles(text or "", size)
                counts.append(len(items))
                digests.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None)
                tokens.append(minhash(items, a, b).view(np.int32) if len(items) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(tokens, pa.list_(pa.int32()))],
                names=[FILE, ROW, "id", "digest", "n", "tokens"])

    with arrow_batches(rows.sparkSession):
        return write_table(rows.select(FILE, ROW, "id", "text").mapInArrow(
            run, f"{FILE} string, {ROW} bigint, id {kind}, digest binary, n bigint, tokens array<int>"), "sketches")


def _root_picks(runs: int, threshold: float, seed: int) -> list[int]:
    """Token positions that start the runs' paths: each run takes its share of a shuffled list, one at least."""
    random = np.random.default_rng(seed)
    order, picks = random.permutation(TOKENS), []
    for _ in range(runs):
        picks.append(max(1, int(random.binomial(TOKENS, 1 / (threshold * TOKENS)))))
    return [int(p) for p in order[:min(TOKENS, sum(picks))]]


def chosen_path_buckets(sets: DataFrame, threshold: float, recall: float, seed: int) -> DataFrame:
    """(leaf, digest, n): the buckets of at least two sets that the paths end in, equal buckets once.

    A path is a list of (position, token) pairs. At each node every position is chosen with probability
    1 / (threshold x TOKENS), by a hash of the path, at least one; a set goes on to the node of its own token.
    So two sets that share a token there stay together, and a bucket splits until it is small, or until a split
    hardly shrinks it, or DEPTH. The number of runs follows from `recall` at a path of full depth.
    """
    runs = math.ceil(math.log(1 - recall) / math.log(1 - threshold ** DEPTH))
    picks = _root_picks(runs, threshold, seed)
    leaf = [F.xxhash64(F.lit(seed), F.lit(p), F.element_at("tokens", p + 1)) for p in picks]
    rows = write_table(sets.select("digest", F.explode(F.array(*leaf)).alias("leaf")), "paths").withColumn("parent", F.lit(None).cast("bigint"))
    closed: DataFrame | None = None
    for depth in range(1, DEPTH + 1):
        sizes = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select(F.col("leaf").alias("of"), "size")
        sized = write_table(rows.join(sizes, F.col("leaf") == F.col("of")).select("leaf", "digest", "size", "parent"), "sized")
        ends = (F.col("size") <= BUCKET) | F.coalesce(F.col("size") >= F.col("parent") * DENSE, F.lit(False)) if depth < DEPTH else F.lit(True)
        done = sized.filter(ends).select("leaf", "digest", "size")
        closed = done if closed is None else closed.unionByName(done)
        if depth == DEPTH:
            break
        open_ = sized.filter(~ends)
        if open_.isEmpty():
            break
        tokens = sets.select(F.col("digest").alias("d"), "tokens")
        draws = [(F.pmod(F.xxhash64(F.lit(seed), F.col("leaf"), F.lit(j)), F.lit(1 << 30)), j) for j in range(TOKENS)]
        drawn = F.array(*[F.struct(d.alias("draw"), F.lit(j).alias("at")) for d, j in draws])
        cut = int((1 << 30) / (threshold * TOKENS))
        nodes = open_.select("leaf", F.col("size").alias("parent")).distinct().withColumn("drawn", drawn)
        nodes = nodes.withColumn("picked", F.filter("drawn", lambda x: x["draw"] < cut))
        nodes = nodes.select(F.col("leaf").alias("of"), F.explode(F.when(F.size("picked") > 0, F.transform("picked", lambda x: x["at"])).otherwise(F.array(F.array_min("drawn")["at"]))).alias("at"))
        going = open_.select("leaf", "digest", F.col("size").alias("parent")).join(nodes, F.col("leaf") == F.col("of"))
        rows = write_table(going.join(tokens, F.col("digest") == F.col("d")).select(
            F.xxhash64(F.lit(seed), F.col("leaf"), F.col("at"), F.element_at("tokens", F.col("at") + 1)).alias("leaf"), "digest", "parent"), "paths")
    mark = [F.sum(F.xxhash64(F.lit(s), "digest").cast("decimal(38,0)")).alias(f"mark{s}") for s in (1, 2)]
    shapes = closed.groupBy("leaf", "size").agg(*mark)
    single = shapes.groupBy("size", "mark1", "mark2").agg(F.min("leaf").alias("of"))
    return _united(write_table(closed.join(single.select("of"), F.col("leaf") == F.col("of")).select("leaf", "digest", "size"), "closed"))


def _united(buckets: DataFrame) -> DataFrame:
    """`buckets` with those larger than a tile put together where they hold much the same rows.

    A group of near copies fills a bucket in each run. A bucket takes the number of another one if that is the
    first large bucket of over half of its rows: all its rows go there, so no pair is lost, and the group's pairs
    are compared once instead of once a run.
    """
    large, small = buckets.filter(F.col("size") > TILE_ROWS), buckets.filter(F.col("size") <= TILE_ROWS)
    first = large.groupBy("digest").agg(F.min("leaf").alias("first")).select(F.col("digest").alias("d"), "first")
    votes = large.join(first, F.col("digest") == F.col("d")).groupBy("leaf", "first").agg(F.count(F.lit(1)).alias("votes"), F.max("size").alias("size"))
    moves = votes.filter(F.col("votes") * 2 > F.col("size")).select(F.col("leaf").alias("of"), F.col("first").alias("to"))
    moved = large.join(moves, F.col("leaf") == F.col("of"), "left").select(F.coalesce("to", "leaf").alias("leaf"), "digest")
    moved = write_table(moved.distinct(), "united")
    sizes = moved.groupBy("leaf").agg(F.count(F.lit(1)).alias("size")).select(F.col("leaf").alias("of"), "size")
    return small.unionByName(moved.join(sizes, F.col("leaf") == F.col("of")).select("leaf", "digest", "size"))


def _tiled(buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of tiles of each bucket: a bucket of up to BUCKET rows is one tile; a row of a larger one meets every tile once.

    Tiles are bounded in rows and in shingles. The rows carry the set's `tokens`, `copies` and all its `leaves`.
    """
    known = sets.select(F.col("digest").alias("d"), "n", "copies", "tokens")
    weights = buckets.join(known.select("d", "n"), F.col("digest") == F.col("d")).groupBy("leaf").agg(F.sum("n").alias("items")).select(F.col("leaf").alias("of"), "items")
    tiles = F.when(F.col("size") <= BUCKET, 1).otherwise(F.greatest(F.ceil(F.col("size") / TILE_ROWS), F.ceil(F.col("items") / TILE_ITEMS))).cast("int")
    sized = buckets.join(weights, F.col("leaf") == F.col("of")).select("leaf", "digest", tiles.alias("tiles"))
    own = F.pmod(F.xxhash64("leaf", "digest"), "tiles").cast("int")
    spread = sized.select("leaf", "digest", own.alias("tile"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    leaves = buckets.groupBy("digest").agg(F.collect_list("leaf").alias("leaves"))  # at most a path's ends per run
    known = known.join(leaves, F.col("d") == F.col("digest")).drop("digest", "n")
    return spread.join(known, F.col("digest") == F.col("d")).select(
        "leaf", "digest", "tile", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tokens", "copies", "leaves")


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition("leaf", "lo", "hi").sortWithinPartitions("leaf", "lo", "hi")


def _considered(tile: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The pairs of a group that belong to it: within one tile, or across the two."""
    return ~np.eye(len(tile), dtype=bool) if lo == hi else (tile[:, None] != tile[None, :])


def _met_before(leaf: int, leaves: list[list[int]]) -> np.ndarray | None:
    """Which pairs of rows share a bucket with a smaller number than `leaf`: they are compared there."""
    earlier = [[x for x in own if x < leaf] for own in leaves]
    known = {x: i for i, x in enumerate({x for own in earlier for x in own})}
    if not known:
        return None
    member = np.zeros((len(leaves), len(known)), dtype=np.float32)
    for i, own in enumerate(earlier):
        member[i, [known[x] for x in own]] = 1
    return member @ member.T > 0


def _with_partner(tokens: np.ndarray, pairs: np.ndarray, least: float) -> np.ndarray:
    """Which rows agree with a partner of theirs in `pairs` (symmetric) at `least` positions; few pairs are compared one by one."""
    found = np.zeros(len(tokens), dtype=bool)
    if pairs.sum() * 16 < pairs.size:
        one, two = np.nonzero(np.triu(pairs))
        alike = (tokens[one] == tokens[two]).sum(axis=1) >= least
        found[one[alike]] = found[two[alike]] = True
        return found
    rows = np.flatnonzero(pairs.any(axis=1))
    block = np.ascontiguousarray(tokens[rows].T)
    same = np.zeros((len(rows), len(rows)), dtype=np.uint8)
    for column in block:
        same += column[:, None] == column[None, :]
    found[rows] = ((same >= least) & pairs[np.ix_(rows, rows)]).any(axis=1)
    return found


def likely_rows(tiled: DataFrame, threshold: float) -> DataFrame:
    """The rows of `tiled` that have a partner, not met in another bucket, whose estimated similarity may reach the threshold."""
    least = threshold - MARGIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in sorted_groups(batches, ("leaf", "lo", "hi")):
            tokens = table.column("tokens").chunk(0).flatten().to_numpy().reshape(-1, TOKENS)
            tile, lo, hi, leaf = (table.column(c).to_numpy() for c in ("tile", "lo", "hi", "leaf"))
            leaves = table.column("leaves")
            keep = np.zeros(table.num_rows, dtype=bool)
            for s, e in zip(starts, [*starts[1:], table.num_rows], strict=True):
                if e <= s + 1:
                    continue
                met = _met_before(leaf[s], leaves.slice(s, e - s).to_pylist())
                pairs = _considered(tile[s:e], lo[s], hi[s])
                if met is not None:
                    pairs &= ~met
                keep[s:e] = _with_partner(tokens[s:e], pairs, least * TOKENS)
            yield from table.filter(pa.array(keep)).select(["leaf", "digest", "tile", "lo", "hi", "copies", "leaves"]).to_batches()

    return _grouped(tiled).mapInArrow(run, "leaf bigint, digest binary, tile int, lo int, hi int, copies bigint, leaves array<bigint>")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of incidence blocks over the items that occur twice."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    items, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[inverse] > 1
    owner, inverse = owner[shared], inverse[shared]
    number = np.cumsum(count > 1) - 1
    column = number[inverse]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), dtype=np.float64)
    width = 4096
    for first in range(0, int((count > 1).sum()), width):
        s, e = np.searchsorted(column, [first, first + width])
        block = np.zeros((len(sets), width), dtype=np.float32)
        block[owner[s:e], column[s:e] - first] = 1
        total += block @ block.T
    return total


def verified_rows(tiled: DataFrame, threshold: float) -> DataFrame:
    """Per row of a group with links: `links` to documents (each pair in one group only) and `root`, a member it is connected to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in sorted_groups(batches, ("leaf", "lo", "hi")):
            digests, raw, shared = (table.column(c).to_pylist() for c in ("digest", "items", "leaves"))
            tile, lo, hi, leaf, copies = (table.column(c).to_numpy() for c in ("tile", "lo", "hi", "leaf", "copies"))
            out: tuple[list, list, list] = ([], [], [])
            for s, e in zip(starts, [*starts[1:], table.num_rows], strict=True):
                if e <= s + 1:
                    continue
                sets = [np.frombuffer(x, dtype=np.uint64) for x in raw[s:e]]
                sizes = np.array([len(x) for x in sets])
                both = _overlaps(sets)
                linked = (both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9) & _considered(tile[s:e], lo[s], hi[s])
                if not linked.any():
                    continue
                met = _met_before(leaf[s], shared[s:e])
                counted = linked if met is None else linked & ~met
                labels = smallest_labels(linked)
                links = counted @ copies[s:e]
                for i in np.flatnonzero(linked.any(axis=1)):
                    out[0].append(digests[s + i])
                    out[1].append(digests[s + labels[i]])
                    out[2].append(int(links[i]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], names=["digest", "root", "links"])

    return _grouped(tiled).mapInArrow(run, "digest binary, root binary, links bigint")


def rows_at(src: DataFrame, places: DataFrame) -> DataFrame:
    """The rows of `src` at the places (f, r) of `places`; the others stay where they are read.

    The places go to all tasks as bits, one row for a file and SPAN of its rows: 128 bytes and the file's name, whatever
    the number of places in it. No text is shuffled to be found.
    """
    word, bit = F.expr(f"CAST(pmod(r, {SPAN}) AS INT) div 64"), F.expr("shiftleft(1L, CAST(pmod(r, 64) AS INT))")
    bits = [F.coalesce(F.bit_or(F.when(word == w, bit)), F.lit(0).cast("bigint")) for w in range(SPAN // 64)]
    spans = places.groupBy("f", F.expr(f"r div {SPAN}").alias("span")).agg(F.array(*bits).alias("bits"))
    here = src.join(F.broadcast(spans), (F.col(FILE) == F.col("f")) & (F.expr(f"{ROW} div {SPAN}") == F.col("span")))
    return here.filter(F.expr(f"shiftright(bits[CAST(pmod({ROW}, {SPAN}) AS INT) div 64], CAST(pmod({ROW}, 64) AS INT)) & 1L = 1L")).select(*src.columns)


def texts_at(src: DataFrame, places: DataFrame) -> DataFrame:
    """`text` of the rows of `src` at the places (f, r) of `places`."""
    return rows_at(src, places).select("text")


def _sets_of(texts: DataFrame, size: int) -> DataFrame:
    """(digest, items) of the texts, digests as in `sketches`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [shingles(t or "", size).tobytes() for t in batch.column(0).to_pylist()]
            digests = [hashlib.blake2b(x, digest_size=16).digest() for x in items]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(items, pa.binary())], names=["digest", "items"])

    return texts.mapInArrow(run, "digest binary, items binary")


def jaccard_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, recall: float = 0.999, seed: int = 7,
) -> DataFrame:
    """One row per row of `docs`: locator, id, `class_id`, `links`, `stays`.

    Two documents are linked when the Jaccard similarity of their sets of `size`-word shingles reaches
    `threshold`; words are lower-cased runs of letters and digits, and a text of fewer words is one shingle.
    `links` is the number of other documents that a document is linked with, equal texts included. Classes are
    the connected groups; `class_id` is the smallest id in the class (nulls last) and that row `stays`.
    A null, empty or wordless text has no links and a class of its own. Repeated rows are linked to each other.
    An empty table gives an empty result; other columns are not read.

    Method: equal sets are put together first. The distinct sets go through `chosen_path_buckets`; rows without a
    likely partner by their tokens leave; the others' full sets are compared exactly within buckets, large
    buckets tile by tile, each task giving counts and one edge per row, never all pairs.
    """
    src = source_rows(docs, id=id_col, text=text_col)
    rows = sketches(src, size, seed)
    keep = _place()
    sets = write_table(rows.filter(F.col("digest").isNotNull()).groupBy("digest").agg(
        F.min(keep).alias("keep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("tokens").alias("tokens")), "sets")
    with arrow_batches(docs.sparkSession, 2000):
        buckets = write_table(chosen_path_buckets(sets, threshold, recall, seed), "buckets")
        likely = write_table(likely_rows(_tiled(buckets, sets), threshold), "likely")
    kept = sets.select(F.col("digest").alias("d"), F.col("keep.file").alias("f"), F.col("keep.row").alias("r"))
    picked = write_table(likely.select("digest").distinct().join(kept, F.col("digest") == F.col("d")).select("f", "r"), "picked")
    with arrow_batches(docs.sparkSession):
        items = write_table(_sets_of(texts_at(src, picked), size), "items")
    full = likely.join(items.select(F.col("digest").alias("i"), "items"), F.col("digest") == F.col("i")).drop("i")
    with arrow_batches(docs.sparkSession, 512):
        found = write_table(verified_rows(full, threshold), "links")
    drop_table(items)
    links = found.groupBy("digest").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("digest").alias("a"), F.col("root").alias("b")))
    named = sets.select("digest", "keep", "copies").join(roots, F.col("digest") == F.col("node"), "left").join(links.select(F.col("digest").alias("l"), "links"), F.col("digest") == F.col("l"), "left")
    named = write_table(named.select("digest", F.coalesce("root", "digest").alias("root"), "keep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "named")
    firsts = named.groupBy("root").agg(F.min("keep").alias("first")).select(F.col("root").alias("c"), "first")
    classes = write_table(named.join(firsts, F.col("root") == F.col("c")).select(F.col("digest").alias("g"), "first", "links"), "classes")
    joined = rows.select(*LOCATOR, "id", "digest").join(classes, F.col("digest") == F.col("g"), "left")
    alone = F.col("g").isNull()
    return joined.select(
        *LOCATOR, "id", F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"),
        (alone | ((F.col("first.file") == F.col(FILE)) & (F.col("first.row") == F.col(ROW)))).alias("stays"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that stay, one per class, with their columns."""
    docs = anchored(docs)
    gone = write_table(jaccard_classes(docs, id_col, text_col, **options).filter("not stays").select(*LOCATOR), "dropped")
    return without_rows(docs, gone)
