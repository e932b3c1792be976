"""Repeated passages: equal windows of words, and paragraph MinHash banding for similar ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import FILE, LOCATOR, ROW, arrow_batches, drop_table, source_rows, write_table
from wardline.llm.components import components
from wardline.llm.jaccard import _considered, _grouped, _overlaps, rows_at
from wardline.llm.textkit import U, mix, multipliers, rolled, smallest_labels, sorted_groups, span_hashes, spans_rolled, word_spans, words

PASSAGE = 51  # words: passages of over 50 words
PARAGRAPH = 24  # words of an anchor
SPREAD = PASSAGE - PARAGRAPH + 1  # among so many starts in a row one is an anchor
SHINGLE, BANDS, DEPTH = 5, 12, 4  # a pair of paragraphs with Jaccard 0.8 shares a band with probability 1 - (1 - 0.8^4)^12 = 0.998
SIMILAR = 0.8
CHUNK = 1 << 17  # characters of texts that are marked at once
TILE_ROWS, TILE_ITEMS = 1536, 500_000  # paragraphs of a band that are compared at once, and their shingles


def window_anchors(hashes: np.ndarray) -> np.ndarray:
    """For each window of PASSAGE words the word offset of its anchor: of the PARAGRAPH words in it those with the least shingle hash.

    The choice depends on the words of the window alone, so every copy of it has its anchor at the same word.
    """
    count = len(hashes) - PARAGRAPH + 1
    if count < SPREAD:
        return np.zeros(0, dtype=np.int64)
    order = rolled(hashes, SHINGLE)[:count]
    least = np.lib.stride_tricks.sliding_window_view(order, SPREAD).argmin(axis=1)
    return np.arange(len(least)) + least


def word_runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of the texts one after the other, the word that each text begins with (and the end), and the words that lines begin with (and the end)."""
    parts = [text.lower().encode("utf-8", "surrogatepass") for text in texts]
    raw = np.frombuffer(b"\n".join(parts), dtype=np.uint8)
    begin, end = word_spans(raw)
    edges = np.searchsorted(begin, np.cumsum([0, *[len(x) + 1 for x in parts]]))
    return span_hashes(raw, begin, end), edges, np.unique(np.concatenate([edges, np.searchsorted(begin, np.flatnonzero(raw == 10))]))


def text_chunks(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts in order, so many at once that vector code pays; a long text comes alone."""
    chunk, size = [], 0
    for text in texts:
        if chunk and size + len(text or "") > CHUNK:
            yield chunk
            chunk, size = [], 0
        chunk.append(text or "")
        size += len(text or "")
    if chunk:
        yield chunk


def band_keys(hashes: np.ndarray, start: np.ndarray, stop: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The BANDS keys of each paragraph, each of DEPTH MinHash values of its shingles."""
    if not len(start):
        return np.zeros((0, BANDS), dtype=np.int64)
    counts = stop - start - SHINGLE + 1
    first = np.cumsum(counts) - counts
    items = rolled(hashes, SHINGLE)[np.repeat(start - first, counts) + np.arange(counts.sum())]
    least = np.stack([np.minimum.reduceat(mix(items * x + y), first) for x, y in zip(a, b, strict=True)], axis=1).reshape(-1, BANDS, DEPTH)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U), (len(start), BANDS))
    for j in range(DEPTH):
        key = mix(key + least[:, :, j])
    return key.view(np.int64)


def window_groups(hashes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, key, same, at, size): the runs of `size` windows from word `at` of a text that have one anchor; `edges` are the borders of the texts.

    `key` is the hash of the anchor's words, `same` that of all words of the run. The windows of equal runs are
    equal one by one, and an anchor that two equal windows have is the same in both.
    """
    anchors = window_anchors(hashes)
    text = np.searchsorted(edges, np.arange(len(anchors)), side="right") - 1
    whole = np.flatnonzero(np.arange(len(anchors)) + PASSAGE <= edges[text + 1])
    if not len(whole):
        return (np.zeros(0, dtype=np.int64),) * 5
    anchors, text = anchors[whole], text[whole]
    fresh = np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1])])
    heads = np.flatnonzero(fresh)
    size = np.diff(np.append(heads, len(whole)))
    at, spot, text = whole[heads], anchors[heads], text[heads]
    return text, spans_rolled(hashes, spot, spot + PARAGRAPH).view(np.int64), spans_rolled(hashes, at, at + size + PASSAGE - 1).view(np.int64), at - edges[text], size


def _lists(owner: np.ndarray, count: int, kind: pa.DataType, *columns: np.ndarray) -> pa.Array:
    """A list of structs for each of `count` owners, from the structs' columns, which lie in the owners' order."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=count))])
    fields = [pa.array(c, f.type) if c.ndim == 1 else pa.FixedSizeListArray.from_arrays(pa.array(c.ravel()), c.shape[1]).cast(f.type) for c, f in zip(columns, kind, strict=True)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(kind)))


def text_marks(rows: DataFrame, seed: int) -> DataFrame:
    """One row per text: locator, id, `doc` (a number), `groups`, its runs of windows with one anchor, and its paragraphs with the hash of their words and their bands.

    `first` is 1 at one place of a key in the text. Paragraphs are lines of PASSAGE words or more.
    """
    a, b = multipliers(BANDS * DEPTH, seed)
    kind = rows.schema["id"].dataType.simpleString()
    group = pa.struct([("key", pa.int64()), ("same", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("first", pa.int64())])
    part = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("exact", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            done = 0
            for texts in text_chunks(batch.column(3).to_pylist()):
                count = len(texts)
                hashes, edges, lines = word_runs(texts)
                text, key, *rest = window_groups(hashes, edges)
                order = np.lexsort((key, text))
                first = np.ones(len(key), dtype=np.int64)
                first[order[1:]] = (key[order[1:]] != key[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
                groups = _lists(text, count, group, key, *rest, first)
                start, stop = lines[:-1], lines[1:]
                start, stop = start[stop - start >= PASSAGE], stop[stop - start >= PASSAGE]
                owner = np.searchsorted(edges, start, side="right") - 1
                parts = _lists(owner, count, part, start - edges[owner], stop - edges[owner], spans_rolled(hashes, start, stop).view(np.int64), band_keys(hashes, start, stop, a, b))
                docs = np.arange(number, number + count, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([*batch.slice(done, count).columns[:3], pa.array(docs), groups, parts], names=[FILE, ROW, "id", "doc", "groups", "paragraphs"])
                number, done = number + count, done + count

    schema = (f"{FILE} string, {ROW} bigint, id {kind}, doc bigint, groups array<struct<key: bigint, same: bigint, at: bigint, size: bigint, first: bigint>>, "
              "paragraphs array<struct<start: bigint, stop: bigint, exact: bigint, bands: array<bigint>>>")
    with arrow_batches(rows.sparkSession):
        return write_table(rows.select(FILE, ROW, "id", "text").mapInArrow(run, schema), "marks")


def ranked_places(marks: DataFrame) -> DataFrame:
    """Locator, id, `doc` and `rank`: a number that grows with the id (nulls last), then with the place."""
    order = [F.col("id").asc_nulls_last(), F.col(FILE), F.col(ROW)]
    ranged = marks.select(*LOCATOR, "id", "doc").repartitionByRange(*order).sortWithinPartitions(*order)
    return write_table(ranged.withColumn("rank", F.monotonically_increasing_id()), "places")


def shared_groups(marks: DataFrame, places: DataFrame) -> DataFrame:
    """(doc, key, same, at, size): the runs of windows whose anchor occurs in two documents at least; `doc` is the document's rank."""
    groups = marks.select("doc", F.explode("groups").alias("g")).select("doc", "g.*")
    shared = groups.groupBy("key").agg(F.sum("first").alias("docs")).filter("docs > 1").select(F.col("key").alias("k"))
    found = groups.join(shared, F.col("key") == F.col("k")).select("doc", "key", "same", "at", "size")
    return write_table(found.join(places.select(F.col("doc").alias("d"), "rank"), F.col("doc") == F.col("d")).select(F.col("rank").alias("doc"), "key", "same", "at", "size"), "groups")


def held_groups(groups: DataFrame) -> DataFrame:
    """Per different run of windows: `keeper` (doc, at), its first place, `last`, the last document, `n` places, `ats`, the sum of their words, marks of its holders, and whether its anchor is `alone` in having one run."""
    mark = F.xxhash64("doc")
    found = write_table(groups.groupBy("same").agg(
        F.first("key").alias("key"), F.first("size").alias("size"), F.min(F.struct("doc", "at")).alias("keeper"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n"),
        F.sum("at").alias("ats"), F.bit_xor(mark).alias("odd"), F.sum(F.pmod(mark, F.lit(1 << 30))).alias("all")), "held")
    kinds = found.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).select(F.col("key").alias("k"), (F.col("kinds") == 1).alias("alone"))
    held = write_table(found.join(kinds, F.col("key") == F.col("k")).drop("k"), "held")
    drop_table(found)
    return held


def _read_again(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(hash, doc, at, windows, items): what is wanted of a text.

    Of each of its `groups` the hashes of the windows, under the run's hash; and of each of its `spans` the
    shingle hashes, under the span's hash; both in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, groups, spans, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                hashes, groups, spans = words(text or ""), groups or [], spans or []
                rows = rolled(hashes, PASSAGE).view(np.int64)
                windows = [rows[x["at"]:x["at"] + x["size"]] for x in groups] + [None] * len(spans)
                items = [None] * len(groups) + [rolled(hashes[x["start"]:x["stop"]], SHINGLE).tobytes() for x in spans]
                marks, places = [x["same"] for x in groups] + [x["exact"] for x in spans], [x["at"] for x in groups] + [x["start"] for x in spans]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(marks, pa.int64()), pa.array([doc] * len(marks), pa.int64()), pa.array(places, pa.int64()), pa.array(windows, pa.list_(pa.int64())), pa.array(items, pa.binary())],
                    names=["hash", "doc", "at", "windows", "items"])

    placed = wanted.select("rank", "groups", "spans", F.col(FILE).alias("f"), F.col(ROW).alias("r"))
    read = rows_at(texts, placed.select("f", "r")).join(placed, (F.col(FILE) == F.col("f")) & (F.col(ROW) == F.col("r"))).select("rank", "groups", "spans", "text")
    return read.mapInArrow(run, "hash bigint, doc bigint, at bigint, windows array<bigint>, items binary")


def _numbered_runs(rows: DataFrame, owner: str) -> DataFrame:
    """`rows` with `run`, a number within the owner: a row goes on with the run before it while both have the same holders at the same distances."""
    inside = Window.partitionBy(owner).orderBy("at")  # at most a text's words
    steps = {"at": F.lit(1), "k_doc": F.lit(0), "k_at": F.lit(1), "ats": F.col("n")}
    follows = F.lag("who").over(inside) == F.col("who")
    for name, step in steps.items():
        follows &= F.lag(name).over(inside) == F.col(name) - step * F.lag("size").over(inside)
    return rows.withColumn("fresh", (~F.coalesce(follows, F.lit(False))).cast("int")).withColumn("run", F.sum("fresh").over(inside.rowsBetween(Window.unboundedPreceding, 0)))


def shared_windows(groups: DataFrame, held: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc, at, size, k_doc, k_at, n, ats, who): the places of windows that two documents hold, equal neighbours together.

    A window is held by `n` places with `ats` words before them in all, first by (k_doc, k_at); `who` stands for
    the documents. Where an anchor has one run of windows, all of its windows have the run's holders. The
    windows of other anchors, (same, windows) in `windows`, are put together one by one, each run once.
    """
    facts = ["keeper", "last", "n", "ats", "odd", "all"]
    who = F.xxhash64("odd", "all", "n", "last").alias("who")
    alone = held.filter("alone AND keeper.doc < last").select("same", F.lit(0).cast("bigint").alias("at"), "size", F.col("keeper.doc").alias("k_doc"), F.col("keeper.at").alias("k_at"), "n", "ats", who)
    known = held.filter("NOT alone").select(F.col("same").alias("s"), *facts)
    single = windows.select("same", F.posexplode("windows").alias("j", "hash")).withColumn("j", F.col("j").cast("bigint"))
    each = single.join(known, F.col("same") == F.col("s")).select(
        "hash", F.struct(F.col("keeper.doc").alias("doc"), (F.col("keeper.at") + F.col("j")).alias("at")).alias("keeper"), "last", "n", (F.col("ats") + F.col("j") * F.col("n")).alias("ats"), "odd", "all")
    holders = each.groupBy("hash").agg(
        F.min("keeper").alias("keeper"), F.max("last").alias("last"), F.sum("n").alias("n"), F.sum("ats").alias("ats"), F.bit_xor("odd").alias("odd"), F.sum("all").alias("all"))
    several = holders.filter("keeper.doc < last").select(F.col("hash").alias("h"), F.col("keeper.doc").alias("k_doc"), F.col("keeper.at").alias("k_at"), "n", "ats", who)
    rows = single.join(several, F.col("hash") == F.col("h")).select("same", F.col("j").alias("at"), F.lit(1).cast("bigint").alias("size"), "k_doc", "k_at", "n", "ats", "who")
    pieces = _numbered_runs(rows, "same").groupBy("same", "run").agg(
        F.min("at").alias("at"), F.sum("size").alias("size"), F.min("k_at").alias("k_at"), F.min("ats").alias("ats"), *[F.first(c).alias(c) for c in ("k_doc", "n", "who")])
    pieces = write_table(pieces.select(*alone.columns).unionByName(alone).withColumnsRenamed({"same": "s", "at": "j"}), "pieces")
    return groups.select("doc", "same", "at").join(pieces, F.col("same") == F.col("s")).select(
        "doc", (F.col("at") + F.col("j")).alias("at"), "size", "k_doc", "k_at", "n", "ats", "who")


def equal_runs(windows: DataFrame) -> DataFrame:
    """(doc, start, stop, cluster, removed): the runs of windows that other documents hold too; `windows` comes from `shared_windows`.

    A window is kept where its document has the smallest number, at its first place there; a place in the same
    document that overlaps that one stays as well. Neighbouring windows make a run while they have the same
    holders at the same distances, so the runs of all holders are cut at the same words.
    """
    runs = _numbered_runs(windows, "doc").groupBy("doc", "run").agg(
        F.min("at").alias("start"), F.max(F.col("at") + F.col("size")).alias("end"), F.min("k_at").alias("k_at"), F.first("k_doc").alias("k_doc"), F.first("who").alias("who"))
    stays = (F.col("doc") == F.col("k_doc")) & (F.col("start") - F.col("k_at") < PASSAGE)
    return runs.select("doc", "start", (F.col("end") + PASSAGE - 1).alias("stop"), F.xxhash64("k_doc", "k_at", "who").alias("cluster"), (~stays).alias("removed"))


def banded(kinds: DataFrame) -> DataFrame:
    """(key, exact, size): the bands of different paragraphs that at least two share."""
    rows = kinds.select("exact", F.explode("bands").alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select(F.col("key").alias("k"), "size")
    return write_table(rows.join(sizes, F.col("key") == F.col("k")).select("key", "exact", "size"), "banded")


def _tiled(bands: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of the groups to compare: a band of up to a tile is one group; a row of a larger one meets every tile once."""
    full = bands.join(items.select(F.col("hash").alias("i"), "doc", "at", "items"), F.col("exact") == F.col("i"))
    weights = full.groupBy("key").agg(F.sum(F.length("items") / 8).alias("weight")).select(F.col("key").alias("k"), "weight")
    tiles = F.greatest(F.ceil(F.col("size") / TILE_ROWS), F.least(F.ceil(F.col("weight") / TILE_ITEMS), F.col("size"))).cast("int")
    sized = full.join(weights, F.col("key") == F.col("k")).withColumn("tiles", tiles)
    sized = sized.withColumn("tile", F.pmod(F.xxhash64("key", "exact"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return sized.select(F.col("key").alias("leaf"), F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "exact", "doc", "at", "items")


def similar_links(bands: DataFrame, items: DataFrame) -> DataFrame:
    """(exact, root, doc, at, begin, end) per paragraph and group with a similar one: `root` is one it is connected to.

    `doc` and `at` are the place of the similar paragraph with the smallest place before its own (null: none),
    `begin` and `end` the words from the first to the last shingle that they share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in sorted_groups(batches, ("leaf", "lo", "hi")):
            tile, lo, hi, exact, doc, at = (table.column(c).to_numpy() for c in ("tile", "lo", "hi", "exact", "doc", "at"))
            raw = table.column("items")
            out: list[tuple] = []
            for s, e in zip(starts, [*starts[1:], table.num_rows], strict=True):
                if e <= s + 1:
                    continue
                order = s + np.lexsort((at[s:e], doc[s:e]))
                runs = [np.frombuffer(raw[int(i)].as_py(), dtype=U) for i in order]
                sets = [np.unique(x) for x in runs]
                sizes = np.array([len(x) for x in sets])
                both = _overlaps(sets)
                linked = (both >= SIMILAR * (sizes[:, None] + sizes[None, :] - both) - 1e-9) & _considered(tile[order], lo[s], hi[s])
                if not linked.any():
                    continue
                labels = smallest_labels(linked)
                for i in np.flatnonzero(linked.any(axis=1)):
                    first = int(linked[i].argmax())
                    row = (int(exact[order[i]]), int(exact[order[labels[i]]]))
                    if first < i:
                        common = np.flatnonzero(np.isin(runs[i], sets[first]))
                        out.append((*row, int(doc[order[first]]), int(at[order[first]]), int(common[0]), int(common[-1]) + SHINGLE))
                    else:
                        out.append((*row, None, None, None, None))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["exact", "root", "doc", "at", "begin", "end"])

    with arrow_batches(items.sparkSession, 512):
        return write_table(_grouped(_tiled(bands, items)).mapInArrow(run, "exact bigint, root bigint, doc bigint, at bigint, begin bigint, end bigint"), "links")


def similar_runs(places: DataFrame, links: DataFrame) -> DataFrame:
    """(doc, start, stop, cluster, removed) of the paragraphs that have a similar one; `places` has all (doc, start, stop, exact).

    A paragraph is removed where one similar to it stands before it, from the first to the last shingle that
    they share. Clusters are connected components, those within one document left out.
    """
    roots = components(links.select(F.col("exact").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("n"), F.col("root").alias("cluster"))
    before = links.groupBy("exact").agg(F.min(F.when(F.col("doc").isNotNull(), F.struct("doc", "at", "begin", "end"))).alias("found"))
    known = write_table(before.join(roots, F.col("exact") == F.col("n")).select(F.col("exact").alias("x"), "found", "cluster"), "similar")
    rows = write_table(places.join(known, F.col("exact") == F.col("x")).select("doc", "start", "stop", "exact", "found", "cluster"), "similar")
    apart = rows.groupBy("cluster").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select(F.col("cluster").alias("c"))
    rows = rows.join(apart, F.col("cluster") == F.col("c"))
    removed = F.col("found").isNotNull()
    return rows.select(
        "doc", F.when(removed, F.col("start") + F.col("found.begin")).otherwise(F.col("start")).alias("start"),
        F.when(removed, F.col("start") + F.col("found.end")).otherwise(F.col("stop")).alias("stop"), F.xxhash64(F.lit("similar"), "cluster").alias("cluster"), removed.alias("removed"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """One row per repeated passage of a document: locator, id, `start`, `stop` (words), `cluster`, `removed`.

    A passage is a run of PASSAGE words or more that other documents hold too (words are lower-cased runs of
    letters and digits). A document's passages are cut where the set of their holders changes, so passages may
    overlap; the passages of a `cluster` are equal. The one of the smallest id stays (nulls last) and the others
    are `removed`, further places in one document included. So every removed word stands, in the same passage,
    in a document of smaller id or earlier in its own, and at last in one place where it stays.

    Paragraphs (lines of PASSAGE words or more) that differ but whose sets of shingles have a Jaccard similarity of
    SIMILAR or more are passages as well, in clusters of their own. One is `removed`, but for the ends that are
    its own, where a similar one stands before it; equal copies of one that stays are a passage of the first kind.

    Texts without repeats, null, empty and short ones have no row; repeats within one document alone do not
    count; repeated rows repeat each other. An empty table gives an empty result.

    Method: each window of PASSAGE words has an anchor of PARAGRAPH words that its own words choose. Windows
    whose anchor occurs in one document only cannot repeat. Those that follow each other with one anchor go
    together, by the hash of all their words; where an anchor has different runs of them, the windows of
    each different run meet by the hash of their own words.
    Different paragraphs meet by MinHash bands, and all pairs of a band are compared exactly, tile by tile.
    """
    src = source_rows(docs, id=id_col, text=text_col)
    marks = text_marks(src, seed)
    places = ranked_places(marks)
    groups = shared_groups(marks, places)
    ranks = places.select(F.col("doc").alias("d"), "rank")
    parts = marks.select("doc", F.explode("paragraphs").alias("p")).join(ranks, F.col("doc") == F.col("d")).select(F.col("rank").alias("doc"), "p.*")
    parts = write_table(parts, "paragraphs")
    drop_table(marks)
    kinds = parts.groupBy("exact").agg(F.min(F.struct("doc", "start", "stop")).alias("first"), F.first("bands").alias("bands"))
    bands = banded(kinds)
    met = bands.select(F.col("exact").alias("x")).distinct()
    firsts = parts.groupBy("exact").agg(F.min(F.struct("doc", "start", "stop")).alias("first")).join(met, F.col("exact") == F.col("x"))
    spans = firsts.groupBy(F.col("first.doc").alias("d")).agg(F.collect_list(F.struct("first.start", "first.stop", "exact")).alias("spans"))
    held = held_groups(groups)
    wanted = held.filter("NOT alone").groupBy(F.col("keeper.doc").alias("g")).agg(F.collect_list(F.struct("same", "keeper.at", "size")).alias("groups"))
    both = wanted.join(spans, F.col("g") == F.col("d"), "full").select(F.coalesce("g", "d").alias("w"), "groups", "spans")
    placed = write_table(both.join(places, F.col("w") == F.col("rank")).select(*LOCATOR, "rank", "groups", "spans"), "wanted")
    with arrow_batches(docs.sparkSession):
        again = write_table(_read_again(src.select(*LOCATOR, "text"), placed), "again")
    links = similar_links(bands, again.filter(F.col("items").isNotNull()))
    similar = write_table(similar_runs(parts.select("doc", "start", "stop", "exact"), links), "runs")
    windows = again.filter(F.col("windows").isNotNull()).select(F.col("hash").alias("same"), "windows")
    equal = write_table(equal_runs(shared_windows(groups, held, windows)), "runs")
    for table in (placed, again, groups, held):
        drop_table(table)
    runs = equal.unionByName(similar)
    return runs.join(places.select(*LOCATOR, "id", "rank"), F.col("doc") == F.col("rank")).select(*LOCATOR, "id", "start", "stop", "cluster", "removed")


def without_passages(docs: DataFrame, passages: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the removed passages cut out of the text; `passages` comes from `repeated_passages` over the same table."""
    from wardline.llm.common import with_locator

    placed = with_locator(docs)
    cuts = passages.filter("removed").groupBy(*LOCATOR).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("_c_cuts")).select(F.col(FILE).alias("_c_file"), F.col(ROW).alias("_c_row"), "_c_cuts")

    @F.pandas_udf("string")
    def cut(texts, cuts):
        def one(text, spans):
            if text is None or spans is None or not len(spans):
                return text
            raw = text.lower().encode("utf-8", "surrogatepass")
            begin, end = word_spans(np.frombuffer(raw, dtype=np.uint8))
            if len(raw) != len(text.encode("utf-8", "surrogatepass")):
                return text  # lower-casing moved the offsets: the text is left as it is
            body, out, last = text.encode("utf-8", "surrogatepass"), [], 0
            for span in spans:
                out.append(body[last:int(begin[span["start"]])])
                last = max(last, int(end[span["stop"] - 1]))
            return b"".join([*out, body[last:]]).decode("utf-8", "surrogatepass")

        return texts.combine(cuts, one)

    joined = placed.join(cuts, (placed[FILE] == cuts["_c_file"]) & (placed[ROW] == cuts["_c_row"]), "left")
    return joined.withColumn(text_col, cut(F.col(text_col), F.col("_c_cuts"))).select(*docs.columns)
