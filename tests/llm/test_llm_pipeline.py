import hashlib
import os
import random

import duckdb
import pytest

import corpus_pipeline
from wardline.llm.common import session_conf, table, write_table
from wardline.llm.dedup import deduplicate
from wardline.llm.mixing import curriculum
from wardline.llm.queries import ORACLES, QUERIES

from .conftest import documents, sentence


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from '{os.path.join(small, t)}.parquet'")
    got = QUERIES[name](spark, small).toPandas()
    want = con.sql(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    sides = [x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want)]
    assert sides[0].equals(sides[1])


def test_stages_follow_each_other(spark, small):
    docs = table(spark, small, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = write_table(stage(spark, docs, small), name)
        assert docs.columns == columns
        seen[name] = docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_duplicates", "source_mix", "packing"]
    assert seen["language_id"] == 200 and seen["exact_dedup"] == deduplicate(table(spark, small, "documents")).filter("kept").count() > seen["near_duplicates"]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    whole = corpus_pipeline.run(spark, small)
    assert sorted(map(tuple, pieces.select("doc_id", "length", "ids_crc32").collect())) == sorted(map(tuple, whole.select("doc_id", "length", "ids_crc32").collect()))


def test_packed_pieces_follow_the_curriculum(spark, small):
    rng = random.Random(31)
    docs = write_table(documents(spark, [(i, sentence(rng, rng.choice((5, 40, 900))), "en", "abc"[i % 3]) for i in range(90)]), "curriculum")
    plan = curriculum(docs).selectExpr("id", "explode(copies) as c").selectExpr("id", "c.epoch", "c.position").collect()
    want = [r["id"] for r in sorted(plan, key=lambda r: (r["position"], hashlib.md5(str(r["id"]).encode()).hexdigest(), r["epoch"]))]
    with session_conf(spark, spark__sql__adaptive__coalescePartitions__enabled="false", spark__sql__shuffle__partitions="6"):
        mixed = write_table(corpus_pipeline.source_mix(spark, docs, small), "mixed")
        assert len(mixed.inputFiles()) > 3
        pieces = corpus_pipeline.packing(spark, mixed, small).collect()
    begun = [r for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])) if r["start"] == 0]
    assert [r["doc_id"] for r in begun] == want


def test_mix_rows_come_in_training_order(spark, small):
    plan = curriculum(table(spark, small, "documents")).selectExpr("id", "try_element_at(copies, 1).position as position").collect()
    first = {r["id"]: 2.0 if r["position"] is None else r["position"] for r in plan}
    positions = [first[r["doc_id"]] for r in QUERIES["op9_mixing"](spark, small).select("doc_id").collect()]
    assert positions == sorted(positions)
