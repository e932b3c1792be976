"""Language identification by fusing evidence."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import FILE, LOCATOR, ROW, anchored, arrow_batches, source_rows, without_rows, write_table

# Frequent function words and national address suffixes of the languages.
FUNCTION_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "with", "this", "are", "from"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "mit", "den", "von", "zu", "im", "sich", "auf", "dem"),
    "fr": ("le", "la", "les", "des", "du", "et", "est", "une", "dans", "que", "pour", "pas", "sur", "avec"),
    "es": ("el", "la", "los", "las", "del", "que", "en", "por", "una", "con", "para", "se", "su", "es"),
}
SUFFIXES = {"uk": "en", "us": "en", "ie": "en", "au": "en", "nz": "en", "de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "cl": "es"}
LANGUAGES = tuple(FUNCTION_WORDS)
OTHER = "und"
CLASSES = (*LANGUAGES, OTHER)
BUCKETS = 1 << 15  # hashed byte trigrams
EVIDENCE = 40.0  # trigrams that a text counts for at most: neighbours depend on each other
STRENGTH = 20.0  # documents that a parent prior counts for
SUFFIX_WEIGHT = math.log(20.0)
OTHER_PRIOR = 1e-3

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(low: str) -> np.ndarray:
    """Bucket numbers of the byte trigrams of a lower-cased text; all that is not a letter is one space."""
    raw = _FOLD[np.frombuffer(f" {low} ".encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    space = raw == 32
    raw = raw[~(space & np.concatenate(([False], space[:-1])))]
    if len(raw) < 3:
        return np.zeros(0, dtype=np.int64)
    wide = raw.astype(np.uint32)
    code = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def seed_language(low: str) -> str | None:
    """The language whose function words clearly lead: three at least, and twice the next."""
    votes = dict.fromkeys(LANGUAGES, 0)
    for names, n in Counter(map(_SPEAKERS.get, low.split())).items():
        for name in names or ():
            votes[name] += n
    (most, name), (next_, _) = sorted(((n, name) for name, n in votes.items()), reverse=True)[:2]
    return name if most >= 3 and most >= 2 * next_ else None


_SPEAKERS = {word: tuple(name for name in FUNCTION_WORDS if word in FUNCTION_WORDS[name]) for words in FUNCTION_WORDS.values() for word in words}


def text_model(rows: DataFrame) -> np.ndarray:
    """Log-probabilities (language x bucket), from trigram counts of all texts with a clear seed language.

    Half of the mass is uniform: a few unseen trigrams do not push a short text out of its language. Tasks count by language and bucket; the sums are at most languages x BUCKETS rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(LANGUAGES), BUCKETS), dtype=np.int64)
        for batch in batches:
            grams: dict[str, list[np.ndarray]] = {}
            for text in batch.column(0).to_pylist():
                low = (text or "").lower()
                name = seed_language(low)
                if name:
                    grams.setdefault(name, []).append(trigrams(low))
            for name, found in grams.items():
                counts[LANGUAGES.index(name)] += np.bincount(np.concatenate(found), minlength=BUCKETS)
        language, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(language, pa.int32()), pa.array(bucket, pa.int32()), pa.array(counts[language, bucket])], names=["language", "bucket", "n"])

    with arrow_batches(rows.sparkSession):
        sums = rows.select("text").mapInArrow(run, "language int, bucket int, n bigint").groupBy("language", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((len(LANGUAGES), BUCKETS), 0.1)
    counts[sums.column("language").to_numpy(), sums.column("bucket").to_numpy()] += sums.column("n").to_numpy()
    return np.log(0.5 * counts / counts.sum(axis=1, keepdims=True) + 0.5 / BUCKETS).astype(np.float32)


def text_evidence(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """Per row the log-likelihood of each class (`t0`..), `best` by text alone, `letters`; the text stays behind.

    The class without a language is uniform over the buckets. A text counts for at most EVIDENCE trigrams.
    """
    table = np.concatenate([model.T, np.full((BUCKETS, 1), -math.log(BUCKETS), dtype=np.float32)], axis=1)
    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "declared", "host")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros((batch.num_rows, len(CLASSES)))
            letters = np.zeros(batch.num_rows, dtype=np.int64)
            for i, text in enumerate(batch.column(5).to_pylist()):
                grams = trigrams((text or "").lower())
                letters[i] = len(grams)
                if len(grams):
                    scores[i] = table[grams].mean(axis=0, dtype=np.float64) * min(len(grams), EVIDENCE)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(letters), *[pa.array(scores[:, c]) for c in range(len(CLASSES))]],
                names=[FILE, ROW, "id", "declared", "host", "letters", *[f"t{c}" for c in range(len(CLASSES))]])

    schema = f"{FILE} string, {ROW} bigint, id {kinds[0]}, declared {kinds[1]}, host {kinds[2]}, letters bigint, " + ", ".join(f"t{c} double" for c in range(len(CLASSES)))
    with arrow_batches(rows.sparkSession):
        scored = rows.select(FILE, ROW, "id", "declared", "host", "text").mapInArrow(run, schema)
        best = F.greatest(*[F.col(f"t{c}") for c in range(len(CLASSES))])
        first = F.lit(len(CLASSES) - 1)
        for c in range(len(CLASSES) - 1, -1, -1):
            first = F.when(F.col(f"t{c}") == best, c).otherwise(first)
        return write_table(scored.withColumn("best", F.when(F.col("letters") > 0, first).otherwise(len(CLASSES) - 1)), "evidence")


def _counts(rows: DataFrame, by: list[Column]) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.sum((F.col("best") == c).cast("long")).alias(f"n{c}") for c in range(len(CLASSES))])


def _shrunk(parent: list[Column], strength: float) -> list[Column]:
    whole = sum([F.col(f"n{c}") for c in range(1, len(CLASSES))], F.col("n0"))
    return [(F.col(f"n{c}") + strength * parent[c]) / (whole + strength) for c in range(len(CLASSES))]


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang", host_col: str | None = "source", strength: float = STRENGTH,
) -> DataFrame:
    """One row per row of `docs`: locator, id, `lang` (or `und`), `posterior`, `identified`.

    The posterior of a language is proportional to the product of
    * the text's likelihood under hashed byte trigrams, learnt from all texts whose function words are clear,
    * the likelihood of the declared markup language, from a table of text decisions by declared language,
    * a bonus for a national address suffix of the host,
    * a host prior: the host's counts of text decisions, shrunk to those of its suffix, these to all documents'.
    All counts are grouped sums over the whole table. A text without letters (null, empty, digits, symbols)
    is `und`, as is one that no language explains better than a
    uniform source; only `und` rows are not `identified`. Null or unknown declarations and null hosts give no
    evidence of their own. Repeated rows are judged alike; an empty table gives an empty result.
    """
    src = source_rows(docs, id=id_col, text=text_col, declared=declared_col, host=host_col)
    src = src.withColumns({"declared": F.lower(F.substring(F.col("declared").cast("string"), 1, 2)), "host": F.lower(F.coalesce(F.col("host").cast("string"), F.lit("")))})
    rows = text_evidence(src, text_model(src))
    known = F.when(F.col("declared").isin(*LANGUAGES), F.col("declared")).when(F.col("declared").isNotNull(), F.lit(OTHER))
    declared = {r["d"]: [r[f"n{c}"] for c in range(len(CLASSES))] for r in _counts(rows, [known.alias("d")]).collect()}  # at most one row per class
    total = np.array([sum(r[c] for r in declared.values()) for c in range(len(CLASSES))], dtype=float)
    overall = (total + 1.0) / (total.sum() + len(CLASSES))
    overall[-1] = max(OTHER_PRIOR, min(overall[-1], 0.5))
    suffix = F.when(F.col("host").contains("."), F.substring_index("host", ".", -1)).otherwise(F.lit(""))
    hosts = write_table(_counts(rows, [F.col("host")]), "hosts")
    suffixes = hosts.groupBy(suffix.alias("suffix")).agg(*[F.sum(f"n{c}").alias(f"n{c}") for c in range(len(CLASSES))])
    top = suffixes.select("suffix", *[p.alias(f"s{c}") for c, p in enumerate(_shrunk([F.lit(float(x)) for x in overall], strength))])
    hosts = hosts.withColumn("suffix", suffix).join(top, "suffix")
    priors = write_table(hosts.select(F.col("host").alias("h"), "suffix", *[F.log(p).alias(f"p{c}") for c, p in enumerate(_shrunk([F.col(f"s{c}") for c in range(len(CLASSES))], strength))]), "priors")
    joined = rows.join(priors, F.col("host") == F.col("h"))

    def declaration(c: int) -> Column:
        whole = sum(r[c] for d, r in declared.items() if d is not None)
        out = F.lit(0.0)
        for name in CLASSES:
            share = (declared.get(name, [0] * len(CLASSES))[c] + (4.0 if name == CLASSES[c] else 1.0)) / (whole + len(CLASSES) + 3.0)
            out = F.when(known == name, math.log(share)).otherwise(out)
        return out

    def national(c: int) -> Column:
        mine = [s for s, name in SUFFIXES.items() if name == CLASSES[c]]
        return F.when(F.col("suffix").isin(*mine), SUFFIX_WEIGHT).otherwise(0.0) if mine else F.lit(0.0)

    fused = joined.withColumns({f"f{c}": F.col(f"t{c}") + F.col(f"p{c}") + declaration(c) + national(c) for c in range(len(CLASSES))})
    best = F.greatest(*[F.col(f"f{c}") for c in range(len(CLASSES))])
    name = F.lit(OTHER)
    for c in range(len(CLASSES) - 1, -1, -1):
        name = F.when(F.col(f"f{c}") == best, CLASSES[c]).otherwise(name)
    silent = F.col("letters") == 0
    posterior = 1 / sum([F.exp(F.col(f"f{c}") - best) for c in range(1, len(CLASSES))], F.exp(F.col("f0") - best))
    out = fused.select(*LOCATOR, "id", F.when(silent, OTHER).otherwise(name).alias("lang"), F.when(silent, 1.0).otherwise(posterior).alias("posterior"))
    return out.withColumn("identified", F.col("lang") != OTHER)


def pages_as_documents(pages: DataFrame) -> DataFrame:
    """Raw pages as input of `identify`: page_id, text without markup, declared `lang` of the html element, `host` of the url."""
    from wardline.llm.urls import split_url

    body = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    return pages.select("page_id", body.alias("text"), F.nullif(F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([a-z]+)", 1), F.lit("")).alias("lang"), split_url(F.col("url"))[0].alias("host"))


def keep_identified(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` with an identified language, with their columns."""
    docs = anchored(docs)
    gone = write_table(identify(docs, **options).filter("not identified").select(*LOCATOR), "dropped")
    return without_rows(docs, gone)
