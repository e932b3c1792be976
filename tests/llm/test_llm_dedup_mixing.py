import hashlib
import re

from pyspark.sql import functions as F

from wardline.llm.common import prefix_sums
from wardline.llm.dedup import deduplicate, keep_first
from wardline.llm.mixing import curriculum, mixed_documents, training_time

from .conftest import documents


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_dedup_matches_a_plain_loop(odd, odd_rows):
    groups = {}
    for i, text, *_ in odd_rows:
        groups.setdefault(norm(text), []).append(i)
    rows = deduplicate(odd).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        group = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        assert r["group_size"] == len(group) and r["keep_id"] == min(x for x in group if x is not None)
    assert sum(r["kept"] for r in rows) == len(groups)


def test_dedup_splits_a_digest_that_holds_different_texts(odd):
    full = {(r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in deduplicate(odd).collect()}
    weak = {(r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in deduplicate(odd, key_chars=1).collect()}
    assert weak == full


def test_dedup_in_several_batches(odd):
    spread = odd.repartition(4)
    assert sorted(map(str, deduplicate(spread, files_per_batch=1).drop("_w_file", "_w_row").collect())) == sorted(map(str, deduplicate(odd).drop("_w_file", "_w_row").collect()))


def test_dedup_stage_keeps_columns(odd, none):
    kept = keep_first(odd)
    assert kept.columns == odd.columns and kept.count() == len({norm(r["text"]) for r in odd.collect()})
    assert deduplicate(none).count() == 0 and keep_first(none).count() == 0


def test_prefix_sums(spark):
    df = spark.createDataFrame([(i % 3, i, i * 2) for i in range(50)], "a int, b int, v int")
    got = {r["b"]: r["before"] for r in prefix_sums(df, [F.col("a"), F.col("b")], {"before": "v"}, "t").collect()}
    total = 0
    for _, b, v in sorted((i % 3, i, i * 2) for i in range(50)):
        assert got[b] == total
        total += v


def level(sizes, weights, share, limit):
    """Targets by resharing the excess until no source is over its limit."""
    goal, full, left = share * sum(sizes), {}, set(range(len(sizes)))
    while left:
        rest = goal - sum(full.values())
        each = rest / sum(weights[i] for i in left)
        over = [i for i in left if each * weights[i] > limit * sizes[i]]
        if not over:
            return [full.get(i, each * weights[i]) for i in range(len(sizes))]
        for i in over:
            full[i] = limit * sizes[i]
            left.discard(i)
    return [full[i] for i in range(len(sizes))]


def test_mixing_targets_and_sums(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), "en", f"s{i % 5}" if i % 11 else None) for i in range(200)]
    out = curriculum(documents(spark, rows)).collect()
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    goals = dict(zip(names, level([sizes[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2), strict=True))
    source = {i: s for i, _, _, s in rows}
    taken = {}
    for r in out:
        s = source[r["id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - goals[s]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        assert all(0 <= c["position"] <= 1 for c in r["copies"])
        taken[s] = taken.get(s, 0) + r["taken"]
    assert taken == {s: int(goals[s] + 1e-9) for s in names}


def test_training_time_inverts_the_integral(spark):
    curve = [2.0, 0.5, 1.0, 3.0]
    area = [(a + b) / 6 for a, b in zip(curve, curve[1:], strict=False)]
    shares = [0.0, 0.1, 0.33, 0.5, 0.8, 1.0]
    got = spark.createDataFrame([(s,) for s in shares], "s double").select(training_time(F.col("s"), F.array(*[F.lit(x) for x in curve]), 3).alias("t")).collect()
    for s, row in zip(shares, got, strict=True):
        done, t = 0.0, row["t"]
        for i in range(3):
            x = min(max(t * 3 - i, 0), 1)
            done += (curve[i] * x + (curve[i + 1] - curve[i]) * x * x / 2) / 3
        assert abs(done / sum(area) - s) < 1e-9


def test_mixed_documents(odd, odd_rows, none):
    plan = curriculum(odd).collect()
    mixed = mixed_documents(odd).collect()
    assert sum(len((r["text"] or "").split()) for r in mixed) == sum(r["taken"] for r in plan)
    assert len(mixed) == sum(len(r["copies"]) for r in plan)
    assert mixed_documents(odd).columns == odd.columns and all(r["n_chars"] == len(r["text"]) for r in mixed)
    assert curriculum(none).count() == 0 and mixed_documents(none).count() == 0
    assert [r["copies"] for r in plan if r["id"] in (1, 2, 3)] == [[], [], []]
