"""Features of whole texts for the classifiers: shape (bytes, words, lines) and hashed words."""

from __future__ import annotations

import zlib
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD_BUCKETS = 4096
WORD_CACHE = 300_000

_CLASSES = np.zeros((256, 14), np.float32)
for _k, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",", b"!?", b"#$%&*", b"|", b"\"'=:;-_", b"()[]{}<>", b"@/\\+~^`", bytes(range(128, 256)))):
    _CLASSES[list(_set), _k] = 1.0
SHAPE_NAMES = ("upper", "lower", "digit", "blank", "newline", "dot", "comma", "bang", "symbol", "pipe", "mark", "bracket", "other", "beyond", "log_bytes", "log_words", "word_length", "distinct_words", "distinct_lines", "stutter", "empty")


def shape_features(raw: bytes) -> np.ndarray:
    """Shares of byte classes (square roots), sizes, and how far words and lines repeat; all zero but `empty` for an empty text."""
    out = np.zeros(len(SHAPE_NAMES), np.float32)
    words = raw.split()
    if not words:
        out[-1] = 1.0
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float32)
    out[:14] = np.sqrt(counts @ _CLASSES / len(raw))
    lines = [x for x in raw.split(b"\n") if x]
    out[14], out[15] = np.log1p(len(raw)) / 10, np.log1p(len(words)) / 10
    out[16] = min(len(raw) / len(words), 40.0) / 10
    out[17] = len(set(words)) / len(words)
    out[18] = len(set(lines)) / len(lines)
    out[19] = np.sqrt(sum(map(eq, words, words[1:])) / len(words))
    return out


class WordBuckets(dict):
    """Word -> crc32 mod WORD_BUCKETS, remembered up to WORD_CACHE words. Words differ by their letters alone: case and marks around them don't count."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        bucket = self[word] = zlib.crc32(word.strip(b".,;:!?#$%&*|\"'()[]") or word) % WORD_BUCKETS
        return bucket


def hashed_words(raw: bytes, buckets: WordBuckets) -> tuple[np.ndarray, np.ndarray, int]:
    """The buckets that the text's words fall in, each one's weight log(1 + count) scaled to unit length, and the number of words."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.float32), 0
    ids, counts = np.unique(np.fromiter(map(buckets.__getitem__, words), np.int64, len(words)), return_counts=True)
    weights = np.log1p(counts).astype(np.float32)
    return ids, weights / np.linalg.norm(weights), len(words)


def text_bytes(column: str = "text"):
    """The text as UTF-8 bytes, null as empty: Python then need not decode it."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def sampled(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """At most n rows, the same ones each time: those whose key has the smallest keyed hashes."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def gathered_shapes(rows: DataFrame, group: str, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Groups and shape features of a bounded sample of texts, on the driver; the texts themselves stay on the executors."""

    def shapes(batches):
        for batch in batches:
            found = [shape_features(x.as_py()).tobytes() for x in batch.column("raw")]
            yield pa.RecordBatch.from_arrays([batch.column("g"), pa.array(found, pa.binary())], names=["g", "f"])

    got = rows.select(F.col(group).cast("int").alias("g"), text_bytes(text).alias("raw")).mapInArrow(shapes, "g int, f binary").toArrow()
    groups = np.asarray(got.column("g").to_pylist(), dtype=np.int64)
    if not len(groups):
        return groups, np.zeros((0, len(SHAPE_NAMES)), np.float32)
    order = sorted(range(len(groups)), key=lambda i: (groups[i], got.column("f")[i].as_py()))
    return groups[order], np.frombuffer(b"".join(got.column("f")[i].as_py() for i in order), np.float32).reshape(len(groups), -1)


def gathered_words(rows: DataFrame, group: str, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Groups and dense hashed words of a bounded sample of texts, on the driver."""

    def hashed(batches):
        buckets = WordBuckets()
        for batch in batches:
            found = [hashed_words(x.as_py(), buckets) for x in batch.column("raw")]
            ids, weights = [x[0].astype(np.int32).tobytes() for x in found], [x[1].tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("g"), pa.array(ids, pa.binary()), pa.array(weights, pa.binary())], names=["g", "i", "w"])

    got = rows.select(F.col(group).cast("int").alias("g"), text_bytes(text).alias("raw")).mapInArrow(hashed, "g int, i binary, w binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["g"], r["i"], r["w"]))
    dense = np.zeros((len(got), WORD_BUCKETS), np.float32)
    for k, r in enumerate(got):
        dense[k, np.frombuffer(r["i"], np.int32)] = np.frombuffer(r["w"], np.float32)
    return np.array([r["g"] for r in got], dtype=np.int64), dense
