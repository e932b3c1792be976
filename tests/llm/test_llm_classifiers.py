import random

from pyspark.sql import functions as F

from wardline.llm.common import table
from wardline.llm.labelled import fold
from wardline.llm.language import identify, keep_identified, pages_as_documents
from wardline.llm.quality import quality
from wardline.llm.queries import QUERIES
from wardline.llm.toxicity import toxicity

from .conftest import documents


def test_language_of_the_given_documents(spark, small):
    docs = table(spark, small, "documents")
    joined = QUERIES["op10_language_id"](spark, small).join(docs.select("doc_id", F.col("lang").alias("declared")), "doc_id").collect()
    assert len(joined) == docs.count()
    assert sum(r["lang"] == r["declared"] for r in joined) >= 0.98 * len(joined) and all(0 < r["posterior"] <= 1 for r in joined)


def test_text_overrules_a_wrong_declaration(spark, small):
    docs = table(spark, small, "documents")
    wrong = docs.withColumn("lang", F.when(F.col("doc_id") % 10 == 0, F.when(F.col("lang") == "en", "de").otherwise("en")).otherwise(F.col("lang")))
    truth = {r["doc_id"]: r["lang"] for r in docs.filter("n_chars > 200").collect()}
    got = {r["id"]: r["lang"] for r in identify(wrong).collect()}
    assert sum(got[i] == t for i, t in truth.items()) >= 0.97 * len(truth)


def test_language_odd_rows(odd, none, spark):
    got = {r["id"]: r for r in identify(odd).collect()}
    assert [got[i]["lang"] for i in (1, 2, 3, 8)] == ["und"] * 4 and not got[1]["identified"]
    kept = keep_identified(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r["identified"] for r in identify(odd).collect())
    assert identify(none).count() == 0 and keep_identified(none).count() == 0


def test_pages_use_markup_and_address(spark, small):
    pages = pages_as_documents(table(spark, small, "pages"))
    got = identify(pages, id_col="page_id", host_col="host").collect()
    declared = {r["page_id"]: r["lang"] for r in pages.collect()}
    assert len(got) == pages.count() and sum(r["lang"] == declared[r["id"]] for r in got) >= 0.8 * len(got)
    short = spark.createDataFrame([(1, "ok", None, "a.de"), (2, "ok", None, "b.fr"), (3, "ok", "es", None)], "doc_id int, text string, lang string, source string")
    whole = table(spark, small, "documents").select(F.col("doc_id") + 10, "text", "lang", "source").toDF("doc_id", "text", "lang", "source")
    by = {r["id"]: r["lang"] for r in identify(short.unionByName(whole)).collect()}
    assert (by[1], by[2], by[3]) == ("de", "fr", "es")


def test_quality_of_labelled_documents(spark, small):
    labels = table(spark, small, "labels")
    rows = QUERIES["op1_quality_classifier"](spark, small).join(labels, "doc_id").collect()
    assert sum(r["kept"] == bool(r["quality"]) for r in rows) >= 0.95 * len(rows)


def test_quality_shrinks_sparse_sites(spark):
    rng = random.Random(1)
    good, bad = "a calm line of words about rivers and towns.", "BUY!! NOW!! %%% $$$ WIN!!"
    rows = [(i, (good if (i % 10 < 9 if i % 2 else i % 10 < 1) else bad) + f" {rng.random()}", "en", "good" if i % 2 else "bad") for i in range(400)]
    rows += [(1000, good, "en", "lonely")]
    labels = spark.createDataFrame([(i, int(t.startswith("a calm"))) for i, t, *_ in rows[:400]], "doc_id int, quality int")
    out = {r["id"]: r for r in quality(documents(spark, rows), labels).collect()}
    mean = sum(r["evidence"] for r in out.values()) / len(out)
    assert abs(out[1000]["path_rate"] - mean) < 0.02
    assert out[1]["path_rate"] > 0.75 > mean > out[0]["path_rate"] and out[1]["score"] > out[0]["score"]


def test_quality_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(4, 1), (8, 0), (None, 1), (5, None)], "doc_id bigint, quality int")
    rows = quality(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality(none, labels).count() == 0
    assert all(r["kept"] for r in quality(odd, labels.filter("doc_id < 0")).collect())


def test_toxicity_held_out(spark):
    rng = random.Random(6)
    calm = ["stone", "river", "window", "table", "morning", "walked", "slowly", "the", "of", "and"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        body = [rng.choice(calm) for _ in range(rng.randrange(10, 120))]
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                at = rng.randrange(len(body))
                body[at:at] = [rng.choice(["you", "the"]), rng.choice(["moron", "zlurkface", "st0pid", "zlurkhead"])]
        rows.append((i, " ".join(body), "en", "a"))
        labels.append((i, int(toxic)))
    docs = documents(spark, rows)
    out = toxicity(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    held = [r for r in out if r["held_out"]]
    assert len(out) == 900 and 120 < len(held) < 240
    assert sum(r["predicted"] == (r["id"] % 3 == 0) for r in held) >= 0.95 * len(held)
    turned = spark.createDataFrame([(i, x) for i, x in labels], "doc_id bigint, toxic int").withColumn(
        "toxic", F.when(fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {(r["id"], r["score"]) for r in toxicity(docs, turned).collect()} == {(r["id"], r["score"]) for r in out}


def test_toxicity_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(4, 1), (8, 0), (None, 1)], "doc_id bigint, toxic int")
    rows = toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert not [r["held_out"] for r in rows if r["id"] is None][0]
    assert toxicity(none, labels).count() == 0
