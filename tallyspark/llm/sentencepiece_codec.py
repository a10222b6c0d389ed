"""SentencePiece encoding by streaming Viterbi, and decoding.

The best segmentation of a text into pieces is searched from left to right. Only positions within the
longest piece's length of the reading point can still start a piece that ends beyond it; those are the
surviving states. Whenever their backpointers meet in one boundary, everything before it is final: its
ids are committed and forgotten. Vocabularies in which no piece spans the start of a word (or a
character that no piece holds) converge there for certain, so such segments are searched alone and
their ids kept in a bounded table.

The public vocabulary holds merge ranks instead of unigram probabilities. ZIPF turns a rank into a
log probability (p ~ 1 / (rank + 1)); scores are whole numbers of 1/1024 nats, so sums are exact for
texts of any length. Ids therefore differ from those of a merging encoder; decoding gives the same
text. Characters without a piece become byte pieces, and so does a literal U+2581.
"""

from __future__ import annotations

import math
import re
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SPACE = "▁"
LITERAL = "\udfff"  # stands for a U+2581 of the text; no valid text holds it
UNIT = 1024
UNKNOWN_PENALTY = 10.0
CACHE_ENTRIES, CACHE_CHARS = 150_000, 48


@dataclass
class Vocabulary:
    """Pieces with their ids and scores (whole units), and the ids of the 256 byte pieces."""

    ids: dict[str, tuple[int, int]]
    byte_ids: list[int]
    tokens: list[bytes]
    unknown: int
    longest: int = 0
    tree: dict[str, tuple] = field(default_factory=dict)  # pieces by characters: each one's (score, id or -1 for what only begins one, what may follow)
    split: re.Pattern | None = None

    def __post_init__(self):
        self.longest = max(map(len, self.ids), default=1)
        follows = {"": self.tree}
        for p in sorted({p[:k] for p in self.ids for k in range(1, len(p) + 1)}, key=len):
            one, score = self.ids.get(p, (-1, 0))
            follows[p] = {}
            follows[p[:-1]][p[-1]] = (score, one, follows[p])
        chars = {c for p in self.ids for c in p}
        stop = "".join(c for c in "\n\t\r" if c not in chars)
        words = all(SPACE not in p.lstrip(SPACE) for p in self.ids)
        if words:
            self.split = re.compile(f"{SPACE}*[^{SPACE}{stop}]+|{SPACE}+" + (f"|[{stop}]" if stop else ""))


def zipf_score(rank: float, size: int) -> int:
    """Whole units of the log probability of the piece at this rank among size pieces, by Zipf's law."""
    harmonic = math.log(size) + 0.5772156649
    return -round(UNIT * (math.log(min(max(rank, 0.0), size) + 1) + math.log(harmonic)))


def load_vocabulary(model_file: str) -> Vocabulary:
    """Read a SentencePiece model file with byte fallback."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = sp.get_piece_size()
    ids, byte_ids, tokens = {}, [0] * 256, []
    for i in range(size):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            value = int(piece[3:5], 16)
            byte_ids[value] = i
            tokens.append(bytes([value]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            tokens.append(b"")
        else:
            ids[piece] = (i, zipf_score(-sp.get_score(i), size))
            tokens.append(piece.replace(SPACE, " ").encode())
    worst = min(s for _, s in ids.values())
    return Vocabulary(ids, byte_ids, tokens, worst - round(UNIT * UNKNOWN_PENALTY))


class Encoder:
    """Encodes texts one after another; keeps the ids of segments in two halves of at most CACHE_ENTRIES together. A full half takes the other's place, so what comes again stays."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.longest_window = 0

    def _unknown(self, char: str) -> list[int]:
        return [self.v.byte_ids[b] for b in (SPACE if char == LITERAL else char).encode("utf-8", "surrogatepass")]

    def stream(self, s: str) -> list[int]:
        """The ids of the best segmentation of s; of equal ones, that whose last piece is longest."""
        v, n, longest = self.v, len(s), self.v.longest
        pieces = v.ids
        out: list[int] = []
        done = 0
        best = {0: 0}  # scores of the surviving states
        back: dict[int, tuple[int, int]] = {}  # end -> (start, id), since the last committed boundary
        check = 2 * longest
        for i in range(n):
            at = best.pop(i)
            follow, end = v.tree, i
            for char in s[i : i + longest]:
                hit = follow.get(char)
                if hit is None:
                    break
                score, one, follow = hit
                end += 1
                if one >= 0:
                    score += at
                    if end not in best or score > best[end]:
                        best[end] = score
                        back[end] = (i, one)
            if i + 1 not in best or at + v.unknown > best[i + 1] and s[i] not in pieces:
                best[i + 1] = at + v.unknown
                back[i + 1] = (i, -1)
            if i % check == check - 1 or i == n - 1 or len(best) == 1:
                # follow the survivors' backpointers until they meet
                alive = set(best) if i < n - 1 else {n}
                while len(alive) > 1:
                    latest = max(alive)
                    alive.remove(latest)
                    alive.add(back[latest][0])
                meet = alive.pop()
                if meet > done:
                    ids: list[int] = []
                    p = meet
                    while p > done:
                        start, one = back[p]
                        ids.extend([one] if one >= 0 else reversed(self._unknown(s[start])))
                        p = start
                    out.extend(reversed(ids))
                    self.longest_window = max(self.longest_window, i + 1 - done)
                    back = {k: x for k, x in back.items() if k > meet}
                    done = meet
        return out

    def short(self, s: str) -> list[int]:
        """The same for a segment that lies within one window, where nothing can be committed early."""
        tree, unknown = self.v.tree, self.v.unknown
        n = len(s)
        best, start, ids = [-(1 << 60)] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0
        for i in range(n):
            at, follow, end = best[i], tree, i
            for char in s[i:]:
                hit = follow.get(char)
                if hit is None:
                    break
                score, one, follow = hit
                end += 1
                if one >= 0:
                    score += at
                    if score > best[end]:
                        best[end], start[end], ids[end] = score, i, one
            if at + unknown > best[i + 1] and (s[i] not in tree or tree[s[i]][1] < 0):
                best[i + 1], start[i + 1], ids[i + 1] = at + unknown, i, -1
        out: list[int] = []
        while n:
            if ids[n] >= 0:
                out.append(ids[n])
            else:
                out.extend(reversed(self._unknown(s[start[n]])))
            n = start[n]
        out.reverse()
        return out

    def segment(self, s: str) -> bytes:
        ids = self.cache.get(s) or self.older.get(s) or array("i", self.short(s) if len(s) <= self.v.longest else self.stream(s)).tobytes()
        if len(s) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_ENTRIES // 2:
                self.older, self.cache = self.cache, {}
            self.cache[s] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text; an empty text has none."""
        if not text:
            return np.empty(0, np.int32)
        if SPACE in text:
            text = text.replace(SPACE, LITERAL)
        s = SPACE + text.replace(" ", SPACE)
        if self.v.split is None:
            return np.array(self.stream(s), dtype=np.int32)
        get, make = self.cache.get, self.segment
        return np.frombuffer(b"".join([get(x) or make(x) for x in self.v.split.findall(s)]), dtype=np.int32)


def decode(ids, tokens: list[bytes]) -> str:
    """The text of ids; bytes that are no UTF-8 become U+FFFD."""
    raw = b"".join([tokens[i] for i in ids])
    return (raw[1:] if raw.startswith(b" ") else raw).decode("utf-8", "replace")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Long texts: few rows in a batch sent to Python."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType()), T.StructField("lossless", T.BooleanType())])


def encode_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids, n_ids and lossless (decoding the ids gives the text) for every row of docs (doc_id, text).

    A null text has null ids, 0 as n_ids and null as lossless; an empty text has an empty list. Repeated
    rows are encoded each. Other columns aren't read. The vocabulary is of fixed size; it goes to the
    executors with the task.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(load_vocabulary(model_file))

    def encoded(batches):
        encoder = Encoder(shared.value)
        tokens = shared.value.tokens
        for batch in batches:
            offsets, flat, counts, same = [0], [], [], []
            for text in batch.column("text").to_pylist():
                ids = encoder.encode(text or "")
                flat.append(ids)
                offsets.append(offsets[-1] + len(ids))
                counts.append(len(ids))
                same.append(None if text is None else decode(ids.tolist(), tokens) == text)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(flat) if flat else [], pa.int32()), mask=pa.array([x is None for x in same]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(counts, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "ids", "n_ids", "lossless"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(encoded, ENCODED)


def decode_documents(rows: DataFrame, model_file: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """rows with the text of their ids (null ids: null); a column of the text's name is replaced."""
    from pyspark.sql import functions as F

    shared = rows.sparkSession.sparkContext.broadcast(load_vocabulary(model_file).tokens)

    @F.arrow_udf("string")
    def decoded(lists: pa.Array) -> pa.Array:
        return pa.array([None if x is None else decode(x, shared.value) for x in lists.to_pylist()], pa.string())

    return rows.withColumn(text, decoded(ids))
