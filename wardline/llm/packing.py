"""Packing token streams into fixed windows: concatenate and cut."""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import arrow_batches, long_id, write_table

WINDOW, END_ID = 4096, 2
# The split pattern of the vocabulary's own pre-tokenizer.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CACHED_WORDS = 300_000  # of each of two generations in a worker
ODD_SPACES = ("\x1c", "\x1d", "\x1e", "\x1f")  # Python splits at these, the vocabulary's pattern does not


class WordCoder:
    """Token ids of texts as bytes of 16-bit numbers; words seen before are looked up.

    White space ends every token of this vocabulary, so a text's ids are its words' ids in a row. A new word is
    split by the vocabulary's pattern and each part coded by the library; what the fast path does not surely
    split alike goes to the library whole.
    """

    def __init__(self, vocabulary: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.model = self.library.model
        self.split = regex.compile(PARTS).findall
        self.special = "<|"
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u2").tobytes()

    def whole(self, text: str) -> bytes:
        return self.pack(self.library.encode(text, add_special_tokens=False).ids)

    def part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            if part.isascii() and part.isalnum():
                found = self.pack([token.id for token in self.model.tokenize(part)])
            else:
                found = self.whole(part)
            if len(self.parts) >= CACHED_WORDS:
                self.parts.clear()
            self.parts[part] = found
        return found

    def word(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            low = word.lower()
            if word.isascii():
                if low.isalpha():
                    found = self.part(low)
                elif low[:-1].isalpha() and not low[-1].isalnum():
                    found = self.part(low[:-1]) + self.part(low[-1])
                elif self.special in word:
                    found = self.whole(word)
                else:
                    found = b"".join(map(self.part, self.split(low)))
            elif len(low) != len(word) or "Σ" in word or self.special in word or not unicodedata.is_normalized("NFC", word):
                found = self.whole(word)
            elif low.isalpha():
                found = self.part(low)
            else:
                found = b"".join(map(self.part, self.split(low)))
        if len(self.new) >= CACHED_WORDS:
            self.old, self.new = self.new, {}
        self.new[word] = found
        return found

    def text(self, text: str) -> bytes:
        if any(c in text for c in ODD_SPACES):
            return self.whole(text)
        get, word = self.new.get, self.word
        return b"".join([get(w) or word(w) for w in text.split()])


_CODERS: dict[str, WordCoder] = {}


def coder(vocabulary: str) -> WordCoder:
    """One coder per worker process and vocabulary."""
    if vocabulary not in _CODERS:
        _CODERS[vocabulary] = WordCoder(vocabulary)
    return _CODERS[vocabulary]


def token_table(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pass 1: `doc_id`, `ids` (16-bit little-endian, with the end id), `doc_tokens`, `part`, `part_start` (ids before it in its partition)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = coder(vocabulary), np.array([END_ID], dtype="<u2").tobytes()
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [code.text(t or "") + end for t in batch.column(1).to_pylist()]
            counts = np.array([len(x) // 2 for x in ids], dtype=np.int64)
            starts = total + np.cumsum(counts) - counts
            total += int(counts.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(counts), pa.array(starts, pa.int64()), pa.array(np.full(len(ids), part, np.int32))],
                names=["doc_id", "ids", "doc_tokens", "part_start", "part"])

    chosen = docs.select(long_id(docs, id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    with arrow_batches(docs.sparkSession):
        return write_table(chosen.mapInArrow(run, f"doc_id {kind}, ids binary, doc_tokens bigint, part_start bigint, part int"), "tokens")


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids.

    Concatenate and cut. Pass 1 codes each partition once and keeps running totals; the partition totals are
    summed up in order (one row per partition), which gives every document its global offset. Pass 2 cuts the
    stream at multiples of `window`: a document over a border has a piece on each side, and a window shared by
    two partitions gets pieces from both (`sequences` puts them together). All windows are full but the last.

    A null text counts as empty and gives the end id alone; repeated rows are packed each; texts of any length
    are cut freely; an empty table gives an empty result; other columns are not read. The order of documents
    is that of the partitions of `docs`.
    """
    tokens = token_table(docs, vocabulary, id_col, text_col)
    kind = tokens.schema["doc_id"].dataType.simpleString()
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = tokens.join(F.broadcast(bases), F.col("part") == F.col("p")).select("doc_id", "ids", (F.col("base") + F.col("part_start")).alias("begin"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("row", "start", "length", "crc", "tokens", "sequence", "offset", "ids")}
            for row, (raw, begin) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                ids = np.frombuffer(raw, dtype="<u2").astype("<u4")
                start = 0
                while start < len(ids):
                    at = begin + start
                    size = min(window - at % window, len(ids) - start)
                    piece = ids[start:start + size]
                    for name, value in (("row", row), ("start", start), ("length", size), ("crc", zlib.crc32(piece.tobytes())), ("tokens", len(ids)), ("sequence", at // window), ("offset", at % window)):
                        out[name].append(value)
                    if with_ids:
                        out["ids"].append(piece.astype(np.int32))
                    start += size
            columns = [batch.column(0).take(pa.array(out["row"], pa.int64())), *[pa.array(out[k], pa.int64()) for k in ("start", "length", "crc", "tokens", "sequence", "offset")]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array(out["ids"], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids
    return placed.mapInArrow(cut, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """The windows themselves: sequence_id, ids (at most a window, in order) and the documents' borders. `pieces` needs `ids`."""
    parts = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids"))).alias("parts"))
    return parts.select(
        "sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"),
        F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["start"].alias("start"), p["offset"].alias("offset"), p["length"].alias("length"))).alias("borders"))
