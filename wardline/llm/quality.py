"""Quality by hierarchical empirical Bayes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import FILE, LOCATOR, ROW, arrow_batches, source_rows, write_table
from wardline.llm.labelled import MAX_LABELLED, labelled_sample
from wardline.llm.textkit import span_hashes, word_spans

FEATURES = ("words", "word_length", "capitals", "symbols", "bars", "exclaimed", "digits", "marked", "distinct", "top_word", "repeated_lines", "stops")
KEEP = 0.5
EDGE = 1e-4


def features_of(text: str) -> np.ndarray:
    """Dense signs of care or junk in a whole text, in the order of FEATURES; zeros for an empty one."""
    out = np.zeros(len(FEATURES))
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    low = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    begin, end = word_spans(low)
    count = len(begin)
    if not count:
        return out
    bytes_ = np.bincount(raw, minlength=256)
    letters = bytes_[65:91].sum() + bytes_[97:123].sum()
    symbols = bytes_[35:39].sum() + bytes_[42] + bytes_[43] + bytes_[60:63].sum() + bytes_[64] + bytes_[91:97].sum() + bytes_[126]
    _, seen = np.unique(span_hashes(low, begin, end), return_counts=True)
    lines = [x for x in text.split("\n") if x]
    marked = np.isin(low[np.minimum(end, len(low) - 1)], (33, 35, 36, 37, 38, 42, 124)).sum()
    out[:] = (
        np.log1p(count), (end - begin).mean(), bytes_[65:91].sum() / max(1, letters), symbols / len(raw), bytes_[124] / count, bytes_[33] / count, bytes_[48:58].sum() / len(raw),
        marked / count, len(seen) / count ** 0.75, seen.max() / count if count > 20 else 0.0, 1 - len(set(lines)) / len(lines) if lines else 0.0, bytes_[46] / count)
    return out


def _featured(rows: DataFrame) -> DataFrame:
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "host", "path")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.zeros((batch.num_rows, len(FEATURES)))
            for i, text in enumerate(batch.column(5).to_pylist()):
                values[i] = features_of(text or "")
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *[pa.array(values[:, c]) for c in range(len(FEATURES))]], names=[FILE, ROW, "id", "host", "path", *FEATURES])

    schema = f"{FILE} string, {ROW} bigint, id {kinds['id']}, host {kinds['host']}, path {kinds['path']}, " + ", ".join(f"{n} double" for n in FEATURES)
    with arrow_batches(rows.sparkSession):
        return write_table(rows.select(FILE, ROW, "id", "host", "path", "text").mapInArrow(run, schema), "features")


def _logit(p: Column) -> Column:
    inside = F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
    return F.log(inside / (1 - inside))


def _strength(groups: DataFrame, mean: float) -> float:
    """How many documents the parent's mean counts for, by the method of moments.

    The spread of the group means around the overall mean, less what sampling explains, is the variance
    of a beta prior; little spread means strong shrinkage.
    """
    row = groups.filter("n >= 2").agg(F.sum(F.col("n")), F.sum(F.col("n") * F.pow(F.col("p") / F.col("n") - mean, 2)), F.count(F.lit(1))).first()
    n, squares, count = (row[0] or 0), (row[1] or 0.0), (row[2] or 0)
    if count < 2 or not 0 < mean < 1:
        return 50.0
    between = squares / n - mean * (1 - mean) * count / n
    return float(min(max(mean * (1 - mean) / max(between, 1e-6) - 1, 2.0), 1000.0))


def quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = "source", path_col: str | None = "lang",
    label_col: str = "quality", most: int = MAX_LABELLED, weight: float = 0.5,
) -> DataFrame:
    """One row per row of `docs`: locator, id, `evidence`, `host_rate`, `path_rate`, `score`, `kept`.

    `evidence` is the classifier's probability for the whole text, learnt from at most `most` labelled rows. Site
    rates are means of the evidence of the site's other documents, shrunk: paths to their host, hosts to the
    overall mean; the strength of each level is estimated from the spread of its groups. The score's log-odds are the
    evidence's plus `weight` times the path's distance from the overall mean; rows of KEEP or more are `kept`.

    Null and empty texts have all features 0 and score like the emptiest texts; a null host or path is a site
    of its own; repeated rows count each; an empty table gives an empty result. Without labels of both kinds
    the evidence is the share of label 1 (1 without labels: nothing is dropped unlearnt).
    """
    src = source_rows(docs, id=id_col, text=text_col, host=host_col, path=path_col)
    features = _featured(src)
    sample = labelled_sample(labels, label_col, folds=(0, 1, 2, 3, 4), most=most)
    known = features.join(F.broadcast(sample), F.col("id") == F.col("label_id")).select(*FEATURES, F.col("label").cast("double").alias("label"))
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="vector")
    known = write_table(assembler.transform(known).select("vector", "label").coalesce(6), "training")
    seen = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) == 2:
        line = LogisticRegression(featuresCol="vector", labelCol="label", maxIter=60, regParam=1e-4).fit(known)
        judged = line.transform(assembler.transform(features)).withColumn("evidence", vector_to_array("probability")[1])
    else:
        judged = features.withColumn("evidence", F.lit(float(next(iter(seen), 1.0))))
    rows = write_table(judged.select(*LOCATOR, "id", F.coalesce(F.col("host").cast("string"), F.lit("")).alias("host"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), "evidence"), "evidence")
    paths = write_table(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("evidence").alias("p")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    total = hosts.agg(F.sum("n"), F.sum("p")).first()
    mean = float((total[1] or 0.0) / total[0]) if total[0] else 0.5
    host_strength, path_strength = _strength(hosts, mean), _strength(paths, mean)
    sites = paths.join(hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("p").alias("host_p")), F.col("host") == F.col("h"))
    sites = write_table(sites.select(F.col("host").alias("site_host"), F.col("path").alias("site_path"), "n", "p", "host_n", "host_p"), "sites")
    joined = rows.join(sites, (F.col("host") == F.col("site_host")) & (F.col("path") == F.col("site_path")))
    host_rate = (F.col("host_p") - F.col("evidence") + host_strength * mean) / (F.col("host_n") - 1 + host_strength)
    out = joined.withColumn("host_rate", host_rate)
    out = out.withColumn("path_rate", (F.col("p") - F.col("evidence") + path_strength * F.col("host_rate")) / (F.col("n") - 1 + path_strength))
    odds = _logit(F.col("evidence")) + weight * (_logit(F.col("path_rate")) - _logit(F.lit(mean)))
    out = out.withColumn("score", 1 / (1 + F.exp(-odds)))
    return out.select(*LOCATOR, "id", "evidence", "host_rate", "path_rate", "score", (F.col("score") >= KEEP).alias("kept"))
