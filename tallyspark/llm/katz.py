"""Katz backoff language model: Good-Turing discounted bigram counts, exactly normalised backoff weights.

    p(w | h) = d(c(h,w)) c(h,w) / (c(h) + e(h))      if the pair was seen in training,
             = alpha(h) p(w)                         if not;        p(w | h) = p(w) for an unseen h,
    p(w)     = d(c(w)) c(w) / N, and the mass that the discounts leave for a word that was not seen.
alpha(h) is what the discounts leave of h divided by what p(w) leaves of the words not seen after h, so
each context sums to one. e(h) is 1 where no count after h is small enough to be discounted, else 0.

Words are numbered by falling count, so that a word's count follows from its number by a short table of
steps. Documents are cut into blocks of about BLOCK_TOKENS tokens. A block asks each bucket of a table for
its distinct keys at once (packed sorted arrays) and adds its training counts on the same way; so
shuffles carry a key once for each block and frequent words weigh no more than others. Contexts with
very many tokens are spread over several buckets. The tables (words, pairs, contexts) are written to
the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_bucket, drop_stored, if_small, mix64, stored
from .sentencepiece_codec import small_batches
from .text_features import text_bytes

BLOCK_TOKENS = 1 << 20
BYTES_PER_BUCKET, LEAST_BUCKETS = 8 << 20, 64
#: Counts above this are trusted and not discounted.
TRUSTED = 5
FOLDS = 10
#: So many distinct words have pairs that a 64-bit key tells apart.
MOST_WORDS = 3_037_000_000
#: Rows of packed arrays. SEQUENCE: some documents' words as numbers inside their block; ORDER: the block's words in the order of its requests.
SEQUENCE, ORDER, WORDS, PAIRS, CONTEXTS, MODEL = range(6)
ROW = T.StructType(
    [T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("keys", T.BinaryType()), T.StructField("counts", T.BinaryType())]
)
_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
END = b" "  # no word holds a blank


SEQUENCE_TOKENS = 1 << 17  # about so many in one row


def pack(x: np.ndarray) -> bytes:
    """Compressed, byte by byte of all items: the high bytes of small numbers are alike."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize)
    return zstandard.compress(np.ascontiguousarray(planes.T).tobytes(), 1)


def unpack(raw: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.int64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, np.int64))


def as_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def dealt(keys: np.ndarray, buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the positions of its keys, in the keys' order."""
    if len(keys) and (keys[1:] >= keys[:-1]).all():  # the usual case; small numbers are sorted by their digits
        order = np.argsort(buckets.astype(np.uint16) if buckets.max() < 1 << 16 else buckets, kind="stable")
    else:
        order = np.lexsort((keys, buckets))
    cuts = np.flatnonzero(np.diff(buckets[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        yield int(buckets[part[0]]), part


# --- discounts ----------------------------------------------------------------------------------------


def discounts(kinds: list[int], trusted: int = TRUSTED) -> list[float]:
    """Katz's factors d(1)..d(trusted) from the numbers of kinds seen once, twice .. trusted + 1 times.

    Where Good-Turing gives a factor outside (0, 1) the trusted counts begin earlier; where it gives none,
    half a count is taken off each.
    """
    for k in range(trusted, 0, -1):
        if min(kinds[: k + 1]) <= 0:
            continue
        limit = (k + 1) * kinds[k] / kinds[0]
        found = [((r + 1) * kinds[r] / (r * kinds[r - 1]) - limit) / (1 - limit) if limit < 1 else 0.0 for r in range(1, k + 1)]
        if all(0 < d < 1 for d in found):
            return found + [1.0] * (trusted - k)
    return [1 - 0.5 / r for r in range(1, trusted + 1)]


def kept_counts(c: np.ndarray, d: list[float]) -> np.ndarray:
    """d(c) c."""
    return np.array([0.0, *d, 1.0])[np.minimum(c, TRUSTED + 1)] * c


@dataclass(frozen=True)
class Words:
    """Counts by number: words from starts[i] on were seen counts[i] times. size words (V), tokens (N), documents."""

    starts: np.ndarray
    counts: np.ndarray
    size: int
    tokens: int
    documents: int
    d: list[float]

    @staticmethod
    def of(classes: list[tuple[int, int]], documents: int) -> "Words":
        """From (count, number of words), any order."""
        classes = sorted(classes, reverse=True)
        counts = np.array([c for c, _ in classes], np.int64)
        numbers = np.array([n for _, n in classes], np.int64)
        by = dict(classes)
        d = discounts([by.get(r, 0) for r in range(1, TRUSTED + 2)])
        return Words(np.cumsum(numbers) - numbers, counts, int(numbers.sum()), int((counts * numbers).sum()), documents, d)

    def count(self, ids: np.ndarray) -> np.ndarray:
        """Training counts; the number `size` stands for the begin of a document; -1 for a word not seen."""
        out = np.zeros(len(ids), np.int64)
        known = (ids >= 0) & (ids < self.size)
        out[known] = self.counts[np.searchsorted(self.starts, ids[known], side="right") - 1]
        out[ids == self.size] = self.documents
        return out

    def kept(self, c: np.ndarray) -> np.ndarray:
        """d(c) c."""
        return kept_counts(c, self.d)

    @property
    def unseen(self) -> float:
        """p of a word that was not seen; the whole where nothing was."""
        if not self.tokens:
            return 1.0
        numbers = np.diff(np.append(self.starts, self.size))
        left = float(((self.counts - self.kept(self.counts)) * numbers).sum())
        return left / self.tokens if left > 0 else 1.0 / (self.tokens + 1)

    def p(self, c: np.ndarray) -> np.ndarray:
        """p(w) by training count; 0: not seen."""
        if not self.tokens:
            return np.ones(len(c))
        numbers = np.diff(np.append(self.starts, self.size))
        whole = self.tokens if float(((self.counts - self.kept(self.counts)) * numbers).sum()) > 0 else self.tokens + 1
        return np.where(c > 0, self.kept(c) / whole, self.unseen)


# --- blocks -------------------------------------------------------------------------------------------


class _Numbers(dict):
    """Word -> its number inside the block, by first appearance; the end of a text is 0."""

    def __init__(self):
        super().__init__({END: 0})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _blocks(docs: DataFrame, buckets: int, held_out: Column) -> DataFrame:
    """Rows SEQUENCE, ORDER and WORDS of all blocks."""

    def closed(block: int, numbers: _Numbers, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        trained = np.bincount(np.concatenate([np.empty(0, np.uint32), *[x for _, held, x in rows if not held]]), minlength=len(numbers))
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in numbers), np.uint64, len(numbers))
        order, out = [], []
        for bucket, part in dealt(hashes, (hashes % np.uint64(buckets)).astype(np.int64)):
            order.append(part)
            out.append((block, bucket, WORDS, pack(hashes[part]), pack(trained[part])))
        out.append((block, -1, ORDER, pack(np.concatenate(order).astype(np.uint32)), None))
        yield as_rows(out)
        ends = np.cumsum([len(x[2]) for x in rows])
        for part in np.split(np.arange(len(rows)), np.searchsorted(ends, np.arange(SEQUENCE_TOKENS, ends[-1], SEQUENCE_TOKENS))):
            if len(part):
                some = [rows[i] for i in part]
                about = np.array([[len(x[2]), x[0] or 0, int(x[1]) + 2 * (x[0] is None)] for x in some], np.int64)
                yield as_rows([(block, -1, SEQUENCE, pack(np.concatenate([x[2] for x in some])), pack(about.T.ravel()))])

    def cut(batches):
        context = TaskContext.get()
        block = context.partitionId() << 24
        numbers, rows, tokens = _Numbers(), [], 0
        for batch in batches:
            for doc_id, held, raw in zip(batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(), batch.column("raw"), strict=True):
                words = raw.as_py().lower().split()
                words.append(END)
                rows.append((doc_id, held, np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))))
                tokens += len(words)
                if tokens >= BLOCK_TOKENS:
                    yield from closed(block, numbers, rows)
                    block, numbers, rows, tokens = block + 1, _Numbers(), [], 0
        if rows:
            yield from closed(block, numbers, rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held"), text_bytes().alias("raw")).mapInArrow(cut, ROW)


def _answers(requests: DataFrame, table: DataFrame, values: list[tuple[str, np.dtype, float]], hashed: bool) -> DataFrame:
    """For each request row (block, bucket, kind, keys) the values of its keys in table (bucket, key, values), packed one after another; each value with what stands for a missing key."""

    def answered(asked: pa.Table, held: pa.Table) -> pa.Table:
        keys = held.column("key").to_numpy()
        keys = keys.view(np.uint64) if hashed else keys
        order = np.argsort(keys)
        keys = keys[order]
        columns = [held.column(name).to_numpy()[order].astype(kind) for name, kind, _ in values]
        out = []
        for block, bucket, kind, raw in zip(*(asked.column(c).to_pylist() for c in ("block", "bucket", "kind", "keys")), strict=True):
            want = unpack(raw, np.uint64) if hashed else unpack_sorted(raw)
            at = np.searchsorted(keys, want)
            at[at == len(keys)] = 0
            hit = keys[at] == want if len(keys) else np.zeros(len(want), bool)
            got = []
            for column, (_, dtype, missing) in zip(columns, values, strict=True):
                x = np.full(len(want), missing, dtype)
                x[hit] = column[at[hit]]
                got.append(x)
            out.append((block, bucket, kind, pack(np.concatenate(got)), None))
        return pa.Table.from_batches([as_rows(out)])

    return requests.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInArrow(answered, ROW)


def _by_kind(table: pa.Table, kind: int) -> list[dict]:
    rows = [r for r in table.select(["bucket", "kind", "keys"]).to_pylist() if r["kind"] == kind]
    return sorted(rows, key=lambda r: r["bucket"])


@dataclass(frozen=True)
class Block:
    """A block's documents one after another, always in the same order: each one's id, whether it is held out and its length, and the words' numbers inside
    the block. ids: the number in the vocabulary of each of these; -1: not seen. What depends on a word alone is computed once for each of the block's words."""

    doc_ids: list[int | None]
    held: np.ndarray
    lengths: np.ndarray
    numbers: np.ndarray
    ids: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.lengths) - self.lengths

    def before(self, begin: int) -> np.ndarray:
        """The number inside the block of the word before each word; begin where a document begins."""
        out = np.empty(len(self.numbers), np.int64)
        out[1:] = self.numbers[:-1]
        out[self.starts] = begin
        return out


def _numbered(block: pa.Table, answers: pa.Table) -> Block:
    rows = block.select(["kind", "keys", "counts"]).to_pylist()
    order = unpack(next(r["keys"] for r in rows if r["kind"] == ORDER), np.uint32)
    ids = np.empty(len(order), np.int64)
    ids[order] = np.concatenate([unpack(r["keys"], np.int64) for r in _by_kind(answers, WORDS)])
    rows = [r for r in rows if r["kind"] == SEQUENCE]
    lengths, doc_ids, flags = np.concatenate([unpack(r["counts"], np.int64).reshape(3, -1) for r in rows], axis=1)
    named = [None if flag & 2 else x for x, flag in zip(doc_ids.tolist(), flags.tolist(), strict=True)]
    return Block(named, (flags & 1).astype(bool), lengths, np.concatenate([unpack(r["keys"], np.uint32) for r in rows]), ids)


def _pairs(block: Block, size: int) -> np.ndarray:
    """The key of each token's context and word; -1 where either was not seen."""
    ids = block.ids[block.numbers]
    before = np.append(block.ids, size)[block.before(len(block.ids))]
    return np.where((before >= 0) & (ids >= 0), before * size + ids, -1)


def _pair_buckets(keys: np.ndarray, words: Words, buckets: int, per_bucket: int) -> np.ndarray:
    """A context's pairs share a bucket, but for contexts of more than per_bucket tokens: those are spread over as many more."""
    before = keys // words.size
    spread = (words.count(before) // per_bucket + 1).astype(np.uint64)
    return ((mix64(before.astype(np.uint64)) + mix64(keys.astype(np.uint64)) % spread) % np.uint64(buckets)).astype(np.int64)


def _contexts(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The block's distinct contexts: every seen word that another follows, and the begin of a document; and for each number inside the block, the begin's behind
    them, the place of its context, else that behind the last."""
    used = np.zeros(len(block.ids) + 1, bool)
    used[block.before(len(block.ids))] = True
    known = np.flatnonzero(used & (np.append(block.ids, size) >= 0))
    contexts = np.append(block.ids, size)[known]
    order = np.argsort(contexts)
    place = np.full(len(used), len(contexts), np.int64)
    place[known[order]] = np.arange(len(contexts))
    return contexts[order], place


def _asked(block: Block, pairs: np.ndarray):
    """The distinct ones of the block's pairs and their training counts."""
    held = np.repeat(block.held, block.lengths)
    trained, times = np.unique(pairs[~held], return_counts=True)
    keys = np.union1d(trained, pairs[held])
    counts = np.zeros(len(keys), np.int64)
    counts[np.searchsorted(keys, trained)] = times
    first = int(np.searchsorted(keys, 0))
    return keys[first:], counts[first:]


@dataclass(frozen=True)
class Plan:
    buckets: int
    per_bucket: int

    @staticmethod
    def of(text_bytes_total: int) -> "Plan":
        buckets = max(LEAST_BUCKETS, -(-text_bytes_total // BYTES_PER_BUCKET))
        return Plan(buckets, max(1, text_bytes_total // 6 // buckets // 8))


def _word_table(blocks: DataFrame) -> DataFrame:
    """bucket, key (hash) and c of every training word."""

    def summed(rows: pa.Table) -> pa.Table:
        keys = np.concatenate([unpack(x.as_py(), np.uint64) for x in rows.column("keys")])
        counts = np.concatenate([unpack(x.as_py(), np.int64) for x in rows.column("counts")])
        found, where = np.unique(keys, return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, where, counts)
        seen = total > 0
        bucket = rows.column("bucket")[0].as_py()
        return pa.table({"bucket": pa.array(np.full(int(seen.sum()), bucket, np.int32)), "key": pa.array(found[seen].view(np.int64)), "c": pa.array(total[seen])})

    return blocks.where(f"kind = {WORDS}").groupBy("bucket").applyInArrow(summed, "bucket int, key long, c long")


def _with_ids(table: DataFrame, words: Words) -> DataFrame:
    """Number the words by falling count; inside one count by bucket and key, so that no count's words meet in one task."""
    spark = table.sparkSession
    starts = spark.createDataFrame(pa.table({"c": pa.array(words.counts), "start": pa.array(words.starts)}))
    sizes = table.groupBy("c", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("c").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select("c", "bucket", F.coalesce(earlier, F.lit(0)).alias("before")).join(if_small(starts, len(words.counts)), "c")
    rank = F.row_number().over(Window.partitionBy("c", "bucket").orderBy("key")) - 1
    return table.withColumn("rank", rank).join(before, ["c", "bucket"]).select("bucket", "key", "c", (F.col("start") + F.col("before") + F.col("rank")).alias("id"))


COUNTED = T.StructType([*ROW, T.StructField("h", T.LongType()), T.StructField("kinds", T.ArrayType(T.LongType())), T.StructField("rest", T.LongType()), T.StructField("p", T.DoubleType())])


def _counted(requests: DataFrame, words: Words) -> DataFrame:
    """By bucket of pairs: the totals for each block that asked (PAIRS), the bucket's part of the model
    (MODEL: keys and counts), and of each context (CONTEXTS: h) how many kinds were seen 1..TRUSTED + 1
    times, the tokens of those seen more often than TRUSTED, and the sum of p(w)."""

    def counted(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        asked = [unpack_sorted(x.as_py()) for x in rows.column("keys")]
        keys, where = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, where, np.concatenate([unpack(x.as_py(), np.int32) for x in rows.column("counts")]))
        bucket = rows.column("bucket")[0].as_py()
        out, at = [], 0
        for block, x in zip(rows.column("block").to_pylist(), asked, strict=True):
            out.append((block, bucket, PAIRS, pack(total[where[at : at + len(x)]]), None))
            at += len(x)
        seen = total > 0
        keys, total = keys[seen], total[seen]
        out.append((None, bucket, MODEL, pack_sorted(keys), pack(total)))
        batch = as_rows(out)
        blank = [pa.nulls(len(out), pa.int64()), pa.nulls(len(out), pa.list_(pa.int64())), pa.nulls(len(out), pa.int64()), pa.nulls(len(out), pa.float64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *blank], names=COUNTED.names)
        if not len(keys):
            return
        before = keys // words.size
        first = np.flatnonzero(np.diff(before, prepend=-1))
        kinds = np.stack([np.add.reduceat((total == r).astype(np.int64), first) for r in range(1, TRUSTED + 2)], axis=1)
        rest = np.add.reduceat(np.where(total > TRUSTED, total, 0), first)
        p = np.add.reduceat(words.p(words.count(keys % words.size)), first)
        n = len(first)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (TRUSTED + 1)), pa.array(kinds.ravel()))
        fixed = [pa.nulls(n, pa.int64()), pa.array(np.full(n, bucket, np.int32)), pa.array(np.full(n, CONTEXTS, np.int32)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())]
        yield pa.RecordBatch.from_arrays([*fixed, pa.array(before[first]), lists, pa.array(rest), pa.array(p)], names=COUNTED.names)

    def whole(rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(counted(rows)))

    return requests.where(f"kind = {PAIRS}").groupBy("bucket").applyInArrow(whole, COUNTED)


def _context_table(counted: DataFrame, d: list[float], buckets: int) -> DataFrame:
    """bucket, key (h), below (c(h) + e(h)) and alpha of every context seen in training."""
    kinds = [F.sum(F.element_at("kinds", r)).alias(f"k{r}") for r in range(1, TRUSTED + 1)]
    sums = counted.where(f"kind = {CONTEXTS}").groupBy("h").agg(*kinds, F.sum("rest").alias("rest"), F.sum("p").alias("p"))
    whole = sum((F.col(f"k{r}") * r for r in range(1, TRUSTED + 1)), F.col("rest")).cast("double")
    taken = sum((F.col(f"k{r}") * r * d[r - 1] for r in range(1, TRUSTED + 1)), F.col("rest").cast("double"))
    left = whole - taken
    below = F.when(left > 1e-9, whole).otherwise(whole + 1)
    # what p(w) leaves of the words not seen after h holds at least the unseen word's mass
    alpha = (1 - taken / below) / F.greatest(1 - F.col("p"), F.lit(1e-12))
    return sums.select(F.pmod("h", F.lit(buckets)).cast("int").alias("bucket"), F.col("h").alias("key"), below.alias("below"), alpha.alias("alpha"))


SCORED = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
)


def score_documents(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text).

    Trained on the rows that are not held_out (default: crc32 of the id's text mod 10 is 0). A text is its
    words, A-Z lower-cased, and one end. base_score: sum of log10((c + 0.1) / (N + 0.1 (V + 1))); score: the
    model's log10 probability. Null and empty texts are one end. Repeated rows count and are scored each;
    a null id counts as empty text for the hash and stays null. With no training rows every token is
    unseen and both scores are those of a sure event, 0. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    held = F.coalesce(crc_bucket("doc_id", FOLDS) == 0 if held_out is None else held_out, F.lit(False))
    sums = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("b"), F.sum((~held).cast("long")).alias("n")).first()
    plan = Plan.of(sums["b"] or 0)
    blocks = stored(_blocks(docs, plan.buckets, held), "blocks")
    table = stored(_word_table(blocks), "counts")
    # one row for each count that occurs: at most the square root of twice the training tokens
    words = Words.of([(r["c"], r["n"]) for r in table.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()], sums["n"] or 0)
    counts, table = table, stored(_with_ids(table, words), "words")
    drop_stored(counts)
    ids = stored(_answers(blocks.where(f"kind = {WORDS}"), table, [("id", np.int64, -1)], True), "ids")
    drop_stored(table)
    sequences = blocks.where(f"kind in ({SEQUENCE}, {ORDER})")
    if words.size > MOST_WORDS:
        raise OverflowError(f"{words.size} distinct words; keys of pairs hold {MOST_WORDS}")
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def asked(block: pa.Table, answers: pa.Table) -> pa.Table:
        words = shared.value
        number = block.column("block")[0].as_py()
        whole = _numbered(block, answers)
        keys, counts = _asked(whole, _pairs(whole, words.size))
        buckets, contexts = _pair_buckets(keys, words, plan.buckets, plan.per_bucket), _contexts(whole, words.size)[0]
        out = [(number, b, PAIRS, pack_sorted(keys[part]), pack(counts[part].astype(np.int32))) for b, part in dealt(keys, buckets)]
        out += [(number, b, CONTEXTS, pack_sorted(contexts[part]), None) for b, part in dealt(contexts, contexts % plan.buckets)]
        return pa.Table.from_batches([as_rows(out)])

    requests = stored(sequences.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(asked, ROW), "requests")
    counted = stored(_counted(requests, words), "pairs")
    kinds = counted.where(f"kind = {CONTEXTS}").agg(*[F.sum(F.element_at("kinds", r)).alias(f"k{r}") for r in range(1, TRUSTED + 2)]).first()
    d = discounts([k or 0 for k in kinds])
    contexts = stored(_context_table(counted, d, plan.buckets), "contexts")
    weights = _answers(requests.where(f"kind = {CONTEXTS}"), contexts, [("below", np.float64, 1.0), ("alpha", np.float64, 1.0)], False)

    def scored(block: pa.Table, answers: pa.Table) -> pa.Table:
        words = shared.value
        whole = _numbered(block, answers)
        pairs = _pairs(whole, words.size)
        order = np.argsort(pairs)
        ranked = pairs[order]
        new = np.append(True, ranked[1:] != ranked[:-1])
        at = np.empty(len(pairs), np.int64)
        at[order] = np.cumsum(new) - 1
        keys = ranked[new]
        first = int(np.searchsorted(keys, 0))  # 1 where words or contexts were not seen
        buckets = _pair_buckets(keys[first:], words, plan.buckets, plan.per_bucket)
        totals = np.zeros(len(keys), np.int64)
        if len(keys) > first:
            totals[first + np.concatenate([p for _, p in dealt(keys[first:], buckets)])] = np.concatenate([unpack(r["keys"], np.int64) for r in _by_kind(answers, PAIRS)])
        contexts, place = _contexts(whole, words.size)
        below, alpha = np.ones(len(contexts) + 1), np.ones(len(contexts) + 1)  # the last: contexts not seen
        if len(contexts):
            got = [unpack(r["keys"], np.float64) for r in _by_kind(answers, CONTEXTS)]
            order = np.concatenate([p for _, p in dealt(contexts, contexts % plan.buckets)])
            below[order] = np.concatenate([x[: len(x) // 2] for x in got])
            alpha[order] = np.concatenate([x[len(x) // 2 :] for x in got])
        c = words.count(whole.ids)
        base = np.log10((c + 0.1) / (words.tokens + 0.1 * (words.size + 1)))
        seen, k = totals[at], place[whole.before(len(whole.ids))]
        p = np.where(seen > 0, kept_counts(seen, d) / below[k], alpha[k] * words.p(c)[whole.numbers])
        each = lambda x: np.add.reduceat(x, whole.starts)
        n = len(whole.lengths)
        columns = [whole.doc_ids, whole.held, whole.lengths, each((c > 0).astype(np.int64)[whole.numbers]), np.full(n, words.tokens), each(base[whole.numbers]), each(np.log10(p))]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=SCORED.names)

    answers = ids.unionByName(counted.where(f"kind = {PAIRS}").select(*ROW.names)).unionByName(weights)
    return sequences.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, SCORED)

