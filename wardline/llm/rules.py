"""Quality rules whose thresholds follow each language and source, from mergeable quantile sketches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import FILE, LOCATOR, ROW, anchored, arrow_batches, source_rows, without_rows, write_table
from wardline.llm.textkit import long_text_hashes, rolled

WINDOW = 8  # words in a window that may repeat
LEAST_WORDS, MOST_REPEATED = 20, 30  # base rule: fewer words, or more per cent of them in repeated windows, fail
SUB_BUCKETS = 32  # buckets of the sketch per power of two: values are known to one part in 32
FENCE = 6  # how many quartile distances from the median are still usual
LEAST_DOCUMENTS = 100  # a group of fewer documents is judged by its language, a language of fewer by all
SALTS = 16
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Measures in thousandths: name, numerator, denominator, what a document may always differ from the median by.
MEASURES = (
    ("word_length", "word_chars", "n_words", 1000), ("symbols", "n_symbols", "n_words", 100),
    ("dup_lines", "n_dup_lines", "n_lines", 300), ("repeats", "n_repeat_words", "n_words", 200),
)
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True


def repeated_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """How many words lie in a window of words that occurs twice or more."""
    if len(hashes) <= window:
        return 0
    _, which, times = np.unique(rolled(hashes, window), return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[which] > 1)
    change = np.zeros(len(hashes) + 1, dtype=np.int64)
    change[starts] += 1
    change[starts + window] -= 1
    return int((np.cumsum(change) > 0).sum())


def counts_of(text: bytes) -> tuple[int, ...]:
    """The COUNTS of a whole text in UTF-8."""
    raw = np.frombuffer(text, dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~WHITE[raw]
    edges = np.flatnonzero(np.diff(inside))
    begin, end = edges[::2], edges[1::2]
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\x0b\x0c\r")]
    characters = int(inside.sum()) - int(((raw & 0xC0) == 0x80).sum())
    return len(begin), characters, int(SYMBOL[raw].sum()), len(lines) - len(set(lines)), repeated_words(long_text_hashes(raw, begin, end)), len(lines)


def measured(rows: DataFrame) -> DataFrame:
    """One row per document: locator, id, lang, source, COUNTS, `base_failed` and the MEASURES."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "lang", "source")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.array([counts_of(text.as_py() or b"") for text in batch.column(5)], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *[pa.array(c) for c in counts.T]], names=[*LOCATOR, "id", "lang", "source", *COUNTS])

    schema = f"{FILE} string, {ROW} bigint, id {kinds['id']}, lang {kinds['lang']}, source {kinds['source']}, " + ", ".join(f"{c} bigint" for c in COUNTS)
    with arrow_batches(rows.sparkSession):
        counted = rows.select(*LOCATOR, "id", "lang", "source", F.col("text").cast("binary")).mapInArrow(run, schema)
        failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
        shares = {f"m_{name}": F.expr(f"1000 * {top} div greatest({below}, 1)") for name, top, below, _ in MEASURES}
        return write_table(counted.withColumn("base_failed", failed).withColumns(shares), "measured")


def bucket(value: str) -> Column:
    """The sketch's bucket of a whole number >= 0: itself below SUB_BUCKETS, then its leading bits and their place."""
    shift = f"(length(bin({value})) - 6)"
    return F.expr(f"CASE WHEN {value} < {SUB_BUCKETS} THEN cast({value} as int) ELSE {shift} * {SUB_BUCKETS} + cast(shiftright({value}, {shift}) as int) END")


def edge(of: str, upper: bool) -> Column:
    """The least or the greatest whole number of a bucket."""
    lead, shift = f"cast({of} % {SUB_BUCKETS} + {SUB_BUCKETS} as bigint)", f"({of} div {SUB_BUCKETS} - 1)"
    beyond = f"shiftleft({lead} + 1, cast({shift} as int)) - 1" if upper else f"shiftleft({lead}, cast({shift} as int))"
    return F.expr(f"CASE WHEN {of} < {SUB_BUCKETS} THEN cast({of} as bigint) ELSE {beyond} END")


def sketches(documents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Quantile sketches: `n` documents by group, measure and bucket.

    Two sketches are merged by adding counts, so partial ones are combined before the shuffle and the sketch of a
    language is the sum of its sources'. A sketch has some hundred buckets however many documents it has seen.
    """
    pairs = ", ".join(f"'{name}', m_{name}" for name, *_ in MEASURES)
    long = documents.selectExpr(*keys, f"stack({len(MEASURES)}, {pairs}) as (measure, value)")
    return long.groupBy(*keys, "measure", bucket("value").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per group: `documents`, and `low_` and `high_` of each measure.

    The quartiles are read off the sketch; the fences lie FENCE times the distance of the quartile from the median
    beyond the median, or as far as every document may differ. Up to a quarter of odd documents move neither.
    """
    by = Window.partitionBy(*keys, "measure")
    ranked = sketch.withColumn("upto", F.sum("n").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(by))
    read = ranked.groupBy(*keys, "measure").agg(
        F.max("total").alias("documents"), *[F.min(F.when(F.expr(f"4 * upto >= {q} * total"), F.col("bucket"))).alias(f"q{q}") for q in (1, 2, 3)])
    slack = F.create_map(*[F.lit(x) for name, *_, s in MEASURES for x in (name, s)])[F.col("measure")]
    read = read.select(
        *keys, "measure", "documents",
        (edge("q2", False) - F.greatest(FENCE * (edge("q2", True) - edge("q1", False)), slack)).alias("low"),
        (edge("q2", True) + F.greatest(FENCE * (edge("q3", True) - edge("q2", False)), slack)).alias("high"))
    return read.groupBy(*keys).agg(F.max("documents").alias("documents"), *[
        F.max(F.when(F.col("measure") == name, F.col(side))).alias(f"{side}_{name}") for name, *_ in MEASURES for side in ("low", "high")])


LIMITS = [f"{side}_{name}" for name, *_ in MEASURES for side in ("low", "high")]


def thresholds(documents: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """One row per lang and source with its LIMITS: its own, its language's or all documents' fences.

    Rows of the result number the groups; sketches of languages and of all are merged from those of the groups.
    """
    sketch = write_table(sketches(documents, ("lang", "source")), "sketches")
    own = fences(sketch, ("lang", "source"))
    merged = sketch.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    wide = fences(merged, ("lang",)).select(F.col("lang").alias("l_lang"), F.col("documents").alias("l_documents"), *[F.col(c).alias(f"l_{c}") for c in LIMITS])
    whole = merged.groupBy("measure", "bucket").agg(F.sum("n").alias("n")).withColumn("one", F.lit(1))
    all_of = fences(whole, ("one",)).select("one", *[F.col(c).alias(f"a_{c}") for c in LIMITS])
    joined = own.join(wide, own["lang"].eqNullSafe(wide["l_lang"])).withColumn("one", F.lit(1)).join(F.broadcast(all_of), "one")
    return joined.select("lang", "source", *[
        F.when(F.col("documents") >= least, F.col(c)).when(F.col("l_documents") >= least, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}")).alias(c) for c in LIMITS])


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", source_col: str | None = "source",
    least: int = LEAST_DOCUMENTS,
) -> DataFrame:
    """One row per row of `docs`: locator, id, COUNTS, `base_failed`, `reasons`, `kept`.

    Words are runs other than ASCII white space. The base rules are fixed: fewer than 20 words, or more than 30% of
    them in windows of 8 words that the text repeats. All other thresholds come from the documents that pass those:
    a measure beyond the fences of the document's language and source is a reason (comma-joined names) not to keep it.
    Word windows are told apart by 64-bit hashes.

    Null and empty texts have no words and fail the base rules; a null language or source is a group of its own;
    repeated rows count each; groups of fewer than `least` documents use their language's fences, such languages
    all documents'; an empty table gives an empty result; other columns are not read. Fences join the documents by
    language and source with a salt, so a source with a third of all rows is spread over tasks.
    """
    rows = measured(source_rows(docs, id=id_col, text=text_col, lang=lang_col, source=source_col))
    limits = write_table(thresholds(rows.filter("not base_failed"), least), "thresholds")
    limits = limits.withColumnsRenamed({"lang": "t_lang", "source": "t_source"}).withColumn("t_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.col(ROW), F.lit(SALTS)).cast("int"))
    joined = salted.join(limits, (F.col("salt") == F.col("t_salt")) & F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    reasons = F.concat_ws(",", *[
        F.when((F.col(f"m_{name}") < F.col(f"low_{name}")) | (F.col(f"m_{name}") > F.col(f"high_{name}")), F.lit(name)) for name, *_ in MEASURES])
    return joined.withColumn("reasons", F.when(F.col("base_failed"), F.lit("base")).otherwise(reasons)).select(
        *LOCATOR, "id", *COUNTS, "base_failed", "reasons", (F.col("reasons") == "").alias("kept"))


def keep_usual(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that `quality_rules` keeps, with their columns."""
    placed = anchored(docs)
    return without_rows(placed, write_table(quality_rules(placed, **options).filter("not kept").select(*LOCATOR), "unusual"))
