import random

import numpy as np
from pyspark.sql import functions as F

from wardline.llm import jaccard, substring
from wardline.llm.common import FILE, ROW, session_conf, source_rows
from wardline.llm.components import components
from wardline.llm.jaccard import jaccard_classes, keep_representatives
from wardline.llm.substring import PASSAGE, repeated_passages, without_passages
from wardline.llm.textkit import mix, rolled, shingles, smallest_labels, spans_rolled, words
from wardline.llm.topk import top_k

from .conftest import documents, sentence


def brute_classes(rows):
    sets = [set(shingles(t or "").tolist()) for _, t, *_ in rows]
    n = len(rows)
    linked = np.zeros((n, n), dtype=bool)
    for i in range(n):
        for j in range(n):
            if i != j and sets[i] and sets[j]:
                linked[i, j] = len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    labels = smallest_labels(linked)
    ids = [r[0] for r in rows]
    first = {c: min((ids[i] for i in range(n) if labels[i] == c and ids[i] is not None), default=None) for c in set(labels.tolist())}
    return sorted((str(ids[i]), str(first[labels[i]]), int(linked[i].sum())) for i in range(n))


def near_rows():
    rng = random.Random(8)
    rows = []
    for g in range(30):
        base = sentence(rng, rng.randrange(60, 200)).split()
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy), "en", "a"))
    base = sentence(rng, 150).split()
    for _ in range(260):  # a group larger than a bucket
        copy = list(base)
        for _ in range(rng.randrange(0, 3)):
            copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
        rows.append((len(rows), " ".join(copy), "en", "a"))
    rng.shuffle(rows)
    return rows


def result(df):
    return sorted((str(r["id"]), str(r["class_id"]), r["links"]) for r in df.collect())


def test_jaccard_matches_brute_force(spark, monkeypatch):
    rows = near_rows()
    assert result(jaccard_classes(documents(spark, rows))) == brute_classes(rows)
    monkeypatch.setattr(jaccard, "TILE_ROWS", 40)
    monkeypatch.setattr(jaccard, "BUCKET", 16)
    assert result(jaccard_classes(documents(spark, rows))) == brute_classes(rows)


def test_jaccard_odd_rows(odd, odd_rows, none):
    found = jaccard_classes(odd)
    assert result(found) == brute_classes(odd_rows)
    kept = keep_representatives(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r["stays"] for r in found.collect())
    assert jaccard_classes(none).count() == 0 and keep_representatives(none).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(200, i) for i in range(201, 260)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    linked = np.zeros((300, 300), dtype=bool)
    for a, b in edges:
        linked[a, b] = linked[b, a] = True
    labels = smallest_labels(linked)
    assert got == {i: int(labels[i]) for i in range(300) if labels[i] != i or (linked[i].any() and (i, i) not in edges) or linked[i].sum() > 1}


def passage_rows():
    rng = random.Random(5)
    shared = [sentence(rng, n) for n in (PASSAGE, 60, 120, 200)]
    rows, dirty = [], {}
    for i in range(120):
        body = sentence(rng, rng.randrange(20, 300)).split()
        if i % 3 == 0:
            k = i // 3 % len(shared)
            at = rng.randrange(len(body))
            body[at:at] = shared[k].split()
            dirty[i] = k
        rows.append((i, " ".join(body), "en", "a"))
    line = sentence(rng, PASSAGE - 6)
    for i in range(120, 140):  # a shorter common line is no passage
        rows.append((i, f"{line}. {sentence(rng, 40)}", "en", "a"))
    return rows, dirty


def test_passages_match_brute_force(spark):
    rows, dirty = passage_rows()
    owners = {}
    for i, text, *_ in rows:
        for h in set(rolled(words(text), PASSAGE).tolist()) if len(words(text)) >= PASSAGE else ():
            owners.setdefault(h, set()).add(i)
    brute = {i for own in owners.values() if len(own) > 1 for i in own}
    found = repeated_passages(documents(spark, rows)).collect()
    assert {r["id"] for r in found} == brute == set(dirty)
    clusters = {}
    for r in found:
        clusters.setdefault(r["cluster"], []).append(r)
        assert r["stop"] - r["start"] >= PASSAGE
    for members in clusters.values():
        assert len({dirty[m["id"]] for m in members}) == 1
        assert [m["id"] for m in members if not m["removed"]] == [min(m["id"] for m in members)]


def kept_words(rows, found):
    """The words that stay of each document, as text."""
    left = {}
    for i, text, *_ in rows:
        gone = {k for r in found if r["id"] == i and r["removed"] for k in range(r["start"], r["stop"])}
        left[i] = " ".join(w for k, w in enumerate(text.split()) if k not in gone)
    return left


def test_copies_that_share_a_passage_keep_their_own_text(spark):
    rng = random.Random(21)
    p, q, u, v = (sentence(rng, n) for n in (70, 80, 90, 60))
    whole = f"{u} {p} {v}"
    rows = [(1, p, "en", "a"), (2, whole, "en", "a"), (3, whole, "en", "a")]
    left = kept_words(rows, repeated_passages(documents(spark, rows)).collect())
    assert left == {1: p, 2: f"{u} {v}", 3: ""}
    rows = [(1, p, "en", "a"), (2, f"{p} {q}", "en", "a"), (3, q, "en", "a")]  # adjacent passages
    found = repeated_passages(documents(spark, rows)).collect()
    assert kept_words(rows, found) == {1: p, 2: q, 3: ""}
    assert {r["cluster"] for r in found if r["id"] == 1}.isdisjoint({r["cluster"] for r in found if r["id"] == 3})


def test_passage_whose_anchor_others_hold_too(spark):
    rng = random.Random(22)
    head = sentence(rng, 24)
    passage = f"{head} {sentence(rng, 27)}"
    rows = [(i, f"{sentence(rng, 40)} {head} {sentence(rng, 40)}", "en", "a") for i in (1, 9)]
    rows += [(i, f"{sentence(rng, 40)} {passage} {sentence(rng, 40)}", "en", "a") for i in (5, 6)]
    found = repeated_passages(documents(spark, rows)).collect()
    assert sorted((r["id"], r["start"], r["stop"], r["removed"]) for r in found) == [(5, 40, 91, False), (6, 40, 91, True)]


def test_passage_held_twice_by_a_document(spark):
    rng = random.Random(23)
    passage = sentence(rng, 60)
    twice = f"{' '.join(passage.split()[:30])} {sentence(rng, 20)} {passage} {sentence(rng, 20)} {passage}"
    rows = [(1, f"{sentence(rng, 10)} {passage}", "en", "a"), (2, twice, "en", "a"), (3, f"{passage} {sentence(rng, 9)} {passage}", "en", "a")]
    found = repeated_passages(documents(spark, rows)).collect()
    assert sorted((r["id"], r["start"], r["stop"], r["removed"]) for r in found) == [
        (1, 10, 70, False), (2, 50, 110, True), (2, 130, 190, True), (3, 0, 60, True), (3, 69, 129, True)]
    alone = repeated_passages(documents(spark, rows[2:])).collect()
    assert not alone


def test_words_that_differ_break_a_passage(spark):
    rng = random.Random(24)
    one, two = sentence(rng, 24), sentence(rng, 24)
    rows = [(i, f"{one} name{i} number{i} date{i} {two}", "en", "a") for i in range(12)]
    assert not repeated_passages(documents(spark, rows)).collect()


def test_similar_paragraphs_match_brute_force(spark, monkeypatch):
    rng = random.Random(25)
    rows, lines = [], []
    for _ in range(12):
        base = sentence(rng, rng.randrange(60, 130)).split()
        for _ in range(rng.randrange(2, 14)):
            copy = list(base)
            for _ in range(rng.randrange(1, 3)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            lines.append(" ".join(copy))
    base = sentence(rng, 100).split()
    for one, two in (("x1", "x2"), ("y1", "y2")):  # two words changed at a third and two thirds
        lines.append(" ".join([*base[:33], one, *base[34:66], two, *base[67:]]))
    rng.shuffle(lines)
    for i, line in enumerate(lines):
        rows.append((i, f"{sentence(rng, 20)}\n{line}\n{sentence(rng, 20)}", "en", "a"))
    sets = [set(shingles(x).tolist()) for x in lines]
    near = {i: [j for j in range(len(sets)) if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(sets))}
    pairs = [i for i in near if near[i]]
    equal = substring.equal_runs
    monkeypatch.setattr(substring, "equal_runs", lambda windows: equal(windows).filter("false"))
    for tile in (substring.TILE_ROWS, 3):
        monkeypatch.setattr(substring, "TILE_ROWS", tile)
        found = repeated_passages(documents(spark, rows)).collect()
        assert len(pairs) > 40 and sorted(r["id"] for r in found) == pairs
        assert {r["id"] for r in found if r["removed"]} == {i for i in near if near[i] and min(near[i]) < i}


def test_passages_odd_rows_and_removal(odd, none):
    found = repeated_passages(odd)
    assert {r["id"] for r in found.collect()} == {4, None, 6, 7}  # the copy in 5 is changed every few words
    left = without_passages(odd, found)
    assert left.columns == odd.columns and left.count() == odd.count()
    texts = {r["id"]: r["text"] for r in left.selectExpr("doc_id as id", "text").collect()}
    assert texts[7].strip().endswith("tail") and len(texts[7]) < 100 and texts[1] is None
    assert repeated_passages(none).count() == 0


def brute_top(rows, k):
    sound = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in sound:
        if q % 50 == 0:
            ranked = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in sound if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(ranked)]
    return sorted(out)


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 420)] + [(i, [1e4 * x for x in rows[i % 9][1]]) for i in range(420, 440)]
    rows += [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (503, [float("inf")] + [0.0] * 5), (None, rows[0][1]), (550, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, score int")
    got = sorted(tuple(r) for r in top_k(df, df["vec_id"] % 50 == 0).collect())
    assert got == brute_top(rows, 5)
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in top_k(few, few["vec_id"] % 50 == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert top_k(few.filter("vec_id > 5"), few["vec_id"] % 50 == 0).count() == 0


def test_texts_are_found_without_shuffling_them(spark, tmp_path):
    spark.range(3000, numPartitions=2).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")).write.parquet(str(tmp_path / "docs"))
    src = source_rows(spark.read.parquet(str(tmp_path / "docs")), id="doc_id", text="text")
    places = src.where(F.col(ROW).isin(0, 62, 63, 64, 1023, 1024, 1499)).select(F.col(FILE).alias("f"), F.col(ROW).alias("r"), "text")
    with session_conf(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        found = jaccard.texts_at(src, places.select("f", "r"))
        assert "SortMergeJoin" not in found._jdf.queryExecution().toString()
        assert sorted(r["text"] for r in found.collect()) == sorted(r["text"] for r in places.collect())
    assert found.count() == 14


def brute_runs(rows):
    """(id, start, stop, removed) of the equal passages, window by window."""
    holders, marks = {}, {i: rolled(words(t), PASSAGE).tolist() if len(words(t)) >= PASSAGE else [] for i, t, *_ in rows}
    for i, own in marks.items():
        for at, h in enumerate(own):
            holders.setdefault(h, []).append((i, at))
    out = []
    for i, own in marks.items():
        last = None
        for at, h in enumerate(own):
            held = sorted(holders[h])
            state = (tuple(d for d, _ in held), tuple(a - at for _, a in held)) if held[0][0] < held[-1][0] else None
            if state and state == last:
                out[-1][2] += 1
            elif state:
                out.append([i, at, at + PASSAGE, not (held[0][0] == i and at - held[0][1] < PASSAGE)])
            last = state
    return sorted(map(tuple, out))


def test_runs_match_windows_put_together_one_by_one(spark, monkeypatch):
    rng, similar = random.Random(31), substring.similar_runs
    monkeypatch.setattr(substring, "similar_runs", lambda *given: similar(*given).filter("false"))
    pool = [sentence(rng, n) for n in (52, 75, 130, 240)]
    rows = []
    for i in range(90):
        parts = [sentence(rng, rng.randrange(1, 60))]
        for _ in range(rng.randrange(0, 4)):
            whole = rng.choice(pool).split()
            cut = sorted(rng.choices(range(len(whole) + 1), k=2)) if rng.random() < .6 else [0, len(whole)]
            parts += [" ".join(whole[cut[0]:cut[1]]), sentence(rng, rng.choice((0, 0, 1, 30)))]
        rows.append((i, " ".join(p for p in parts if p), "en", "a"))
    rows += [(90 + i, rows[i][1], "en", "a") for i in range(0, 60, 7)] + [(200, "", "en", "a"), (201, "word " * 300, "en", "a"), (202, "word " * 180, "en", "a")]
    found = repeated_passages(documents(spark, rows)).collect()
    assert sorted((r["id"], r["start"], r["stop"], r["removed"]) for r in found) == brute_runs(rows)


def test_windows_of_copies_are_not_shuffled_one_by_one(spark, monkeypatch):
    rng = random.Random(32)
    text, written, write = sentence(rng, 400), {}, substring.write_table
    def noted(df, tag):
        table = write(df, tag)
        written[tag] = max(written.get(tag, 0), table.count())
        return table
    monkeypatch.setattr(substring, "write_table", noted)
    found = repeated_passages(documents(spark, [(i, text, "en", "a") for i in range(40)])).collect()
    assert sorted((r["id"], r["start"], r["stop"], r["removed"]) for r in found) == [(i, 0, 400, i > 0) for i in range(40)]
    assert max(written.values()) < 40 * 100  # a document has 350 windows


def test_hashes_of_many_words_from_one_sum():
    rng = np.random.default_rng(4)
    hashes = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    for size in (1, 5, 9, 24, 51, 300, 700, 900):
        n = min(size, 700)
        out = np.zeros(700 - n + 1, dtype=np.uint64)
        for k in range(n):
            out = out * np.uint64(0xD1342543DE82EF95) + hashes[k:700 - n + 1 + k]
        assert (rolled(hashes, size) == mix(out + np.uint64(n))).all()
    assert spans_rolled(hashes, np.array([3, 10]), np.array([60, 11])).tolist() == [rolled(hashes[3:60], 57)[0], rolled(hashes[10:11], 1)[0]]
