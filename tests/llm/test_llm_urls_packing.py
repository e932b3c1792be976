import math
import random
import zlib

import numpy as np
import pytest

from wardline.llm.packing import END_ID, WordCoder, pack, sequences
from wardline.llm.queries import vocabulary
from wardline.llm.urls import ALLOW_RULES, BLOCK_RULES, LISTED, build_cascade, in_cascade, judge_urls


def judged(url, block=BLOCK_RULES, allow=ALLOW_RULES, listed=LISTED):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        ends = [i for i, c in enumerate(rest) if c in "/?#"]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:ends[0] if ends else len(rest)])
        path = rest[len(host):]
        path = path[:min([i for i, c in enumerate(path) if c in "?#"], default=len(path))]

    def fits(rule):
        h, p = rule.split("/", 1)
        return (host == h or host.endswith("." + h)) and path.startswith("/" + p)

    rules = [(len(r), kind == "allow", r, kind) for kind, keys in (("block", block), ("allow", allow)) for r in keys if fits(r)]
    if rules:
        return host, path, max(rules)[2], max(rules)[3]
    return host, path, None, "block" if any(map(fits, listed)) else "allow"


URLS = [
    None, "", "no scheme/net/", "http://", "http://a.net", "http://a.net/", "http://A.NET/x?y=/z", "https://x.example.net/en/1#t", "https://example.net/en/", "https://example.net/en",
    "https://badexample.net/en/2", "http://example.com/de/5", "http://de.example.com/de?x", "http://q.org/fr/9", "http://q.org/fr?/", "http://www.spam-farm.example.org/fr/1",
    "http://spam-farm.example.org/en/1", "ftp://spam-farm.example.org", "http://net/a", "http://example.com:80/de/1", "http://é.example.com/de/ü", "http://x.net/://b.org/fr/",
    "http://a..net/q", "http://.net/q", "http://x.org/fr/\nline",
]


def test_urls_match_a_plain_loop(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(5, URLS[5], "x")]
    out = judge_urls(spark.createDataFrame(rows, "page_id int, url string, host string")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert tuple(r["judged"]) == judged(r["url"]), r["url"]
    assert judge_urls(spark.createDataFrame([], "page_id int, url string")).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    rng = random.Random(1)
    keys = [f"k{rng.randrange(10**9)}" for _ in range(3000)]
    listed = set(keys[:600])
    universe = spark.createDataFrame([(k,) for k in sorted(set(keys))], "key string")
    levels = build_cascade(spark.createDataFrame([(k,) for k in listed], "key string"), universe)
    assert len(levels) > 2
    rows = universe.withColumn("in", in_cascade(universe["key"], levels)).collect()
    assert {r["key"] for r in rows if r["in"]} == listed


def test_cascade_follows_the_list_not_the_universe(spark):
    listed = spark.range(40).selectExpr("concat('k', id) AS key")
    sizes = []
    for n in (4_000, 400_000):
        universe = spark.range(n).selectExpr("concat('k', id) AS key")
        levels = build_cascade(listed, universe)
        found = universe.where(in_cascade(universe["key"], levels)).collect()
        assert {r["key"] for r in found} == {f"k{i}" for i in range(40)}
        sizes.append([level.bits for level in levels])
    small, large = sizes
    # A universe a hundred times as large adds about log2(100) x 1.44 bits for each listed key to level 1, nothing to the others.
    assert large[0] - small[0] <= 40 * 1.45 * math.log2(100) + 64
    assert sum(large[1:]) <= 40 * 12


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_word_coder_agrees_with_the_library(library):
    coder = WordCoder(vocabulary())
    rng = random.Random(4)
    signs = "abzABZ01 9'’sßéÉñİΣσςǺ漢字!?.,-_<|>endoftext\x1c\x85  \t\n​😀"
    texts = ["", " ", "it's we'll THE The, end. x1y2 a-b", "<|endoftext|> a<|endoftext|>b", "ΟΔΟΣ ΣΑΣ", "İstanbul", "éa", "a\x1cb c"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    for text in texts:
        assert coder.text(text) == coder.pack(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_packing_round_trip(odd, odd_rows, library, none):
    pieces = pack(odd, vocabulary(), window=64)
    rows = pieces.collect()
    wanted = [(i, library.encode(t or "", add_special_tokens=False).ids + [END_ID]) for i, t, *_ in odd_rows]
    stream = []
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["sequence_id"] * 64 + r["offset"] == len(stream) and r["length"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        stream += r["ids"]
    assert len(stream) == sum(len(ids) for _, ids in wanted)
    ends = [i for i, x in enumerate(stream) if x == END_ID]
    starts = sorted((r["sequence_id"] * 64 + r["offset"], r["doc_id"], r["doc_tokens"]) for r in rows if r["start"] == 0)
    assert sorted((str(d), tuple(stream[a:a + n])) for a, d, n in starts) == sorted((str(d), tuple(ids)) for d, ids in wanted)
    assert len(ends) >= len(wanted)
    whole = {r["sequence_id"]: r["ids"] for r in sequences(pieces).collect()}
    assert [x for k in sorted(whole) for x in whole[k]] == stream and all(len(v) == 64 for k, v in whole.items() if k < max(whole))
    assert pack(none, vocabulary()).count() == 0
