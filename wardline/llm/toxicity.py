"""Toxicity by boosted trees over dense features with isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import FILE, LOCATOR, ROW, arrow_batches, source_rows, write_table
from wardline.llm.labelled import MAX_LABELLED, fold, labelled_sample
from wardline.llm.textkit import U, mix, span_hashes, word_spans

# A starting lexicon of insults and the second-person words of four languages.
INSULTS = (
    "idiot", "idiots", "idiotic", "moron", "morons", "stupid", "dumb", "loser", "losers", "pathetic", "worthless", "scum", "trash", "clown", "disgusting",
    "garbage", "hate", "ugly", "liar", "fool", "jerk", "shut", "dumm", "dummkopf", "trottel", "abschaum", "arschloch", "ekelhaft", "widerlich",
    "imbécile", "crétin", "connard", "salaud", "débile", "ordure", "imbécil", "estúpido", "basura", "asqueroso", "cabrón", "tonto",
)
SECOND_PERSON = (
    "you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "vous", "votre", "tú", "ti", "usted", "ustedes",
)
PREFIXES = (4, 5, 6)  # byte lengths of word beginnings in the learnt lexicon
LEXICON = 4000  # learnt entries at most
NEAR = 5  # words between an insult and a second person
FEATURES = (
    "words", "seed_density", "learnt_density", "learnt_count", "prefix_density", "prefix_count", "strength", "near_second_person", "second_person",
    "capitals", "exclaimed", "punctuation", "mixed_words", "hidden_density", "digits", "spelled_out",
)

_PLAIN = np.arange(256, dtype=np.uint8)
for _sign, _letter in zip("013457@$!", "oieastasi", strict=True):
    _PLAIN[ord(_sign)] = ord(_letter)


def _word_hashes(words: tuple[str, ...]) -> np.ndarray:
    out = []
    for word in words:
        raw = np.frombuffer(word.encode(), dtype=np.uint8)
        out.append(span_hashes(raw, np.array([0]), np.array([len(raw)]))[0])
    return np.unique(np.array(out, dtype=U))


_INSULTS, _SECOND = _word_hashes(INSULTS), _word_hashes(SECOND_PERSON)


def _entries(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Hashes of the words, then of their beginnings by length; a beginning is told apart from the word of the same letters."""
    return [span_hashes(raw, begin, end)] + [mix(span_hashes(raw, begin, np.minimum(end, begin + n)) + U(n)) for n in PREFIXES]


def _isin(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table) or not len(values):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def learn_lexicon(texts: DataFrame, most: int = LEXICON) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and log-odds of words and word beginnings that mark texts labelled 1.

    Counted by document over the bounded sample `texts` (text, label); an entry needs 5 toxic texts and a
    smoothed log-odds of 1.5; the `most` entries with the largest evidence stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[int, list[np.ndarray]] = {0: [], 1: []}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
                seen[label].append(np.unique(np.concatenate(_entries(raw, *word_spans(raw)))))
            for label, found in seen.items():
                if found:
                    entry, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(entry.view(np.int64)), pa.array(np.full(len(entry), label, np.int32)), pa.array(n.astype(np.int64))], names=["entry", "label", "n"])

    with arrow_batches(texts.sparkSession, 1000):
        counted = texts.select("text", "label").mapInArrow(run, "entry bigint, label int, n bigint")
        sums = counted.groupBy("entry").agg(F.sum(F.col("n") * F.col("label")).alias("toxic"), F.sum(F.col("n") * (1 - F.col("label"))).alias("clean")).filter("toxic >= 5")
        sizes = texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()
        size = {r["label"]: r["n"] for r in sizes}
        odds = F.log((F.col("toxic") + 0.5) / (size[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (size[0] + 1.0))
        best = sums.withColumn("odds", odds).filter("odds >= 1.5").orderBy((F.col("odds") * F.sqrt("toxic")).desc(), "entry").limit(most).toArrow()
    entry = best.column("entry").to_numpy().astype(np.int64).view(U)
    order = np.argsort(entry)
    return entry[order], best.column("odds").to_numpy()[order]


def features_of(text: str, lexicon: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """The dense features of a whole text, in the order of FEATURES; zeros for an empty one."""
    out = np.zeros(len(FEATURES))
    low = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    begin, end = word_spans(low)
    count = len(begin)
    if not count:
        return out
    whole, *starts = _entries(low, begin, end)
    seed = _isin(whole, _INSULTS)
    learnt = _isin(whole, lexicon)
    prefix = np.zeros(count, dtype=bool)
    strength = 0.0
    for hashes in (whole, *starts):
        hit = _isin(hashes, lexicon)
        if hit.any():
            strength = max(strength, float(odds[np.searchsorted(lexicon, hashes[hit])].max()))
        if hashes is not whole:
            prefix |= hit
    person = np.flatnonzero(_isin(whole, _SECOND))
    hits = np.flatnonzero(seed | learnt | prefix)
    near = 0
    if len(person) and len(hits):
        at = np.searchsorted(person, hits)
        gap = np.minimum(np.abs(person[np.minimum(at, len(person) - 1)] - hits), np.abs(person[np.maximum(at - 1, 0)] - hits))
        near = int((gap <= NEAR).sum())
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    bytes_ = np.bincount(raw, minlength=256)
    capitals, letters = bytes_[65:91].sum(), bytes_[65:91].sum() + bytes_[97:123].sum()
    signs = bytes_[33:48].sum() + bytes_[58:65].sum() + bytes_[91:97].sum() + bytes_[123:127].sum()
    plain = _PLAIN[low]
    changed = np.concatenate(([0], np.cumsum(plain != low)))
    hidden_begin, hidden_end = word_spans(plain)
    masked = changed[hidden_end] > changed[hidden_begin]
    hidden = span_hashes(plain, hidden_begin, hidden_end)
    digit = np.concatenate(([0], np.cumsum((low >= 48) & (low <= 57))))
    digits = digit[end] - digit[begin]
    single = (end - begin) == 1
    runs = single[:-2] & single[1:-1] & single[2:] if count > 2 else np.zeros(0, dtype=bool)
    out[:] = (
        np.log1p(count), seed.sum() / count, learnt.sum() / count, np.log1p(learnt.sum()), prefix.sum() / count, np.log1p(prefix.sum()), strength, near / count, len(person) / count,
        capitals / max(1, letters), bytes_[33] / count, signs / len(raw), ((digits > 0) & (digits < end - begin)).sum() / count,
        (masked & (_isin(hidden, _INSULTS) | _isin(hidden, lexicon))).sum() / count, bytes_[48:58].sum() / len(raw), runs.sum() / count)
    return out


def _featured(rows: DataFrame, lexicon: np.ndarray, odds: np.ndarray) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.zeros((batch.num_rows, len(FEATURES)))
            for i, text in enumerate(batch.column(3).to_pylist()):
                values[i] = features_of(text or "", lexicon, odds)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(values[:, c]) for c in range(len(FEATURES))]], names=[FILE, ROW, "id", *FEATURES])

    with arrow_batches(rows.sparkSession):
        return write_table(rows.select(FILE, ROW, "id", "text").mapInArrow(run, f"{FILE} string, {ROW} bigint, id {kind}, " + ", ".join(f"{n} double" for n in FEATURES)), "features")


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MAX_LABELLED, rounds: int = 20, depth: int = 3,
) -> DataFrame:
    """One row per row of `docs`: locator, id, `held_out`, `score`, `predicted`.

    Labels are learnt from ids whose crc32 modulo 5 is not 0: fold 1 calibrates, folds 2 to 4 fit the lexicon and the
    trees, over at most `most` labelled rows. Only the text enters a score. Null and empty texts have all
    features 0; a null id is never held out nor labelled; repeated rows get equal scores; an empty table gives
    an empty result. Without labels of both kinds the score is the share of label 1 (0 without labels).

    Method: lexicon densities (a starting list, and words and word beginnings learnt by log-odds), nearness of
    a second person, capitals, punctuation and obfuscation rates; gradient-boosted trees on them; isotonic
    regression of the labels on the trees' probability.
    """
    src = source_rows(docs, id=id_col, text=text_col)
    sample = labelled_sample(labels, label_col, most=most)
    texts = write_table(src.join(F.broadcast(sample), F.col("id") == F.col("label_id")).select(*LOCATOR, "id", "text", "label", "fold"), "labelled-texts")
    seen = {(r["fold"] == 1, r["label"]): r["n"] for r in texts.groupBy((F.col("fold") == 1).alias("fold"), "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    held = F.coalesce(fold(F.col("id")) == 0, F.lit(False))
    if not all(seen.get((part, label)) for part in (False, True) for label in (0, 1)):
        share = sum(n for (_, label), n in seen.items() if label) / max(1, sum(seen.values()))
        score = F.lit(float(share))
        return src.select(*LOCATOR, "id", held.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
    lexicon, odds = learn_lexicon(texts.filter("fold <> 1"))
    features = _featured(src, lexicon, odds)
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="vector")
    known = features.join(F.broadcast(sample), F.col("id") == F.col("label_id")).select(*FEATURES, F.col("label").cast("double").alias("label"), "fold")
    known = write_table(assembler.transform(known).select("vector", "label", "fold").coalesce(6), "training")
    trees = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=0.2, seed=5).fit(known.filter("fold <> 1"))
    raw = lambda df: trees.transform(df).withColumn("raw", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")
    line = IsotonicRegression(featuresCol="raw", labelCol="label").fit(raw(known.filter("fold = 1")))
    scored = line.transform(raw(assembler.transform(features))).withColumn("score", F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0)))
    return scored.select(*LOCATOR, "id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
