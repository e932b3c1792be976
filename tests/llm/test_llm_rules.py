import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardline.llm.common import write_table
from wardline.llm.rules import FENCE, LIMITS, MEASURES, bucket, counts_of, edge, keep_usual, quality_rules, sketches, thresholds
from wardline.llm.textkit import long_text_hashes, span_hashes

from .conftest import documents, sentence


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for p in range(len(words) - 7):
        windows.setdefault(tuple(words[p:p + 8]), []).append(p)
    inside = {q for at in windows.values() if len(at) > 1 for p in at for q in range(p, p + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), len(lines)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é世 \n\t\x0b #|"), max_size=200))
def test_counts_match_a_plain_loop(text):
    assert counts_of(text.encode()) == plain_counts(text)


def test_stretches_give_the_same_hashes():
    import numpy as np

    raw = np.frombuffer(sentence(random.Random(1), 300).encode(), dtype=np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (raw != 32).astype(np.int8), [0]])))
    whole = span_hashes(raw, edges[::2], edges[1::2])
    for size in (1, 7, 100, len(raw)):
        assert (long_text_hashes(raw, edges[::2], edges[1::2], size) == whole).all()


def test_buckets_hold_their_edges(spark):
    values = [*range(300), 1000, 4095, 4096, 10**6, 2**40 + 12345]
    rows = spark.createDataFrame([(v,) for v in values], "v bigint").withColumn("b", bucket("v"))
    last = -1
    for r in rows.select("v", "b", edge("b", False).alias("low"), edge("b", True).alias("high")).orderBy("v").collect():
        assert r["low"] <= r["v"] <= r["high"] and r["high"] - r["low"] <= r["v"] / 32 and r["b"] >= last
        last = r["b"]


def test_sketches_merge(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(rng.choice("ab"), *[rng.randrange(5000) for _ in MEASURES]) for _ in range(400)], "k string, " + ", ".join(f"m_{m[0]} bigint" for m in MEASURES))
    whole = sketches(rows, ["k"])
    parts = [sketches(rows.filter(F.crc32(F.concat_ws("-", *rows.columns)) % 3 == i), ["k"]) for i in range(3)]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("k", "measure", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, merged.collect()))


def test_thresholds_follow_language_and_source(spark):
    rng = random.Random(5)
    rows = [(lang, source, 1000 * mean + rng.randrange(-200, 200), 0, 0, 0) for lang, source, mean, n in (("x", "s", 5, 300), ("x", "t", 9, 300), ("x", None, 7, 5), (None, "u", 3, 4)) for _ in range(n)]
    measured = write_table(spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"m_{m[0]} bigint" for m in MEASURES)), "m")
    got = {(r["lang"], r["source"]): r for r in thresholds(measured, 100).collect()}
    assert len(got) == 4 and all(got[k][c] is not None for k in got for c in LIMITS)
    for (source, mean) in (("s", 5), ("t", 9)):
        own = sorted(r[2] for r in rows if r[:2] == ("x", source))
        median, spread = own[150], own[150] - own[75]
        assert abs(got["x", source]["low_word_length"] - (median - max(FENCE * spread, 1000))) < 0.35 * 1000 * mean
    assert got["x", "s"]["high_word_length"] < 9000 < got["x", None]["high_word_length"]
    assert got[None, "u"]["high_word_length"] == got["x", None]["high_word_length"] or got[None, "u"]["high_word_length"] > 9000


def test_symbol_heavy_documents_go_where_they_are_unusual(spark):
    rng = random.Random(6)
    rows = [(i, sentence(rng, 60), "en", "prose") for i in range(150)]
    rows += [(1000 + i, " | ".join(sentence(rng, 1) for _ in range(60)), "en", "tables") for i in range(150)]
    rows += [(2000, " | ".join(sentence(rng, 1) for _ in range(60)), "en", "prose"), (2001, "few words only", "en", "prose"), (2002, "same words here again and so on it " * 9, "en", "prose")]
    got = {r["id"]: r for r in quality_rules(write_table(documents(spark, rows), "d"), source_col="source").collect()}
    assert all(got[i]["kept"] for i in [*range(150), *range(1000, 1150)])
    assert got[2000]["reasons"] == "word_length,symbols" and got[2001]["reasons"] == got[2002]["reasons"] == "base"


def test_odd_rows(odd, odd_rows, none):
    rows = quality_rules(odd).collect()
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
    key = lambda row: tuple((x is not None, x) for x in row)
    assert sorted(((r["id"], *[r[c] for c in counts]) for r in rows), key=key) == sorted(((i, *plain_counts(t or "")) for i, t, *_ in odd_rows), key=key)
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["kept"] and r["base_failed"])
    assert keep_usual(odd).columns == odd.columns and keep_usual(odd).count() == sum(r["kept"] for r in rows)
    assert quality_rules(none).count() == keep_usual(none).count() == 0


@pytest.mark.parametrize("missing", ["lang", "source"])
def test_without_a_column(odd, missing):
    assert quality_rules(odd.drop(missing)).count() == odd.count()
