"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Python only tokenises (tokens_of): each text is cut into parts that no token of either side leaves, and a
block of texts is written as its distinct parts and each text's list of parts. A part has the byte ends of
both sides' tokens, for each byte the ids of the tokens that hold it, and the ids in decimal with the place
of each byte's. The rest are Spark's higher-order functions over these arrays: where both have an end
(array_intersect) a group of tokens ends. Each end that at least one has (array_union) closes one stretch of
bytes that lies in one token of either side, so these ends number the links. Spark interprets such functions
node by node, so what a link or group needs is looked up by its byte. A text's groups and links are those of
its parts in order. All is linear in the text.

The corpus-wide table of linked ids (id_pairs) counts documents. Its most frequent pairs, at most
HOT_PAIRS of them, are broadcast to the documents; links of the others meet their counts by a shuffle, in
which no key is frequent.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stored, stored

SPACE = "▁"
CACHE_PARTS, CACHE_CHARS = 300_000, 64
#: About the most bytes of the texts of a block (a longer text is a block of its own).
BLOCK_BYTES = 2_500_000
#: Most rows of the pair table that are broadcast.
HOT_PAIRS = 400_000
#: A text may be cut before a blank or line break between such characters, and before such a mark after a letter or digit, if no token goes across.
_BREAKS, _SAFE, _WORD, _MARKS = " \\n", "!-~À-ÿ", "0-9A-Za-zÀ-ÖØ-öø-ÿ", ",.:;!?"
CUT = re.compile(f"(?<=[{_SAFE}])(?=[{_BREAKS}][{_SAFE}])|(?<=[{_WORD}])(?=[{_MARKS}])")
UNSAFE = re.compile(f"[{_BREAKS}][^{_SAFE}]|[^{_SAFE}{_BREAKS}][{_BREAKS}]|[^{_WORD}{_MARKS}][{_MARKS}]|[{_MARKS}](?=[{_MARKS}])|\x1f")
#: How byte-level vocabularies of this kind cut words (fixed value, public), and the characters whose classes no version of Unicode changes.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
STABLE = re.compile("[\0-ÿ]*")
MARKED = (" ", "\n", *_MARKS)


class ByteTokenizer:
    """A byte-level BPE file: ids of texts, each id's bytes. Where the ids are the order of the merges, parts of stable characters go through a faster encoder of the same ranks."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, merges, byte_of = spec["model"]["vocab"], spec["model"]["merges"], _byte_alphabet()
        self.size = self.tokenizer.get_vocab_size()
        self.bytes: list[bytes] = [b""] * self.size
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(byte_of[c] for c in token if c in byte_of)
        self.lengths, self.decimal, self.digits = _measures(self.bytes)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        plain = spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not spec["normalizer"]
        self.fast = None
        if plain and all(vocabulary.get(x + y) == 256 + k for k, (x, y) in enumerate(pairs)):
            import tiktoken

            ranks = {raw: i for i, raw in enumerate(self.bytes[: 256 + len(pairs)])}
            self.fast = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_parts(self, parts: list[str]) -> list[list[int]]:
        """Parts as they stand."""
        if not self.fast:
            return self.encode(parts)
        one, stable = self.fast.encode_ordinary, STABLE.fullmatch
        out = [one(p) if stable(p) else None for p in parts]
        rest = iter(self.encode([p for p, ids in zip(parts, out, strict=True) if ids is None]))
        return [next(rest) if ids is None else ids for ids in out]


def _measures(tokens: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """For each id the length of its bytes, the id in decimal with a comma, and the length of that."""
    decimal = [b"%d," % i for i in range(len(tokens))]
    return np.array(list(map(len, tokens)), np.int32), decimal, np.array(list(map(len, decimal)), np.int32)


def _byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for themselves, the others follow from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(others)}


class PieceTokenizer:
    """A SentencePiece file: ids of texts (which it begins with a blank), each id's bytes."""

    def __init__(self, file: str):
        import sentencepiece

        self.processor = sp = sentencepiece.SentencePieceProcessor(model_file=file)
        self.size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(self.size)]
        self.bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.lengths, self.decimal, self.digits = _measures(self.bytes)
        # no piece goes across the start of a word, a line break or a mark after a letter or digit
        self.cuts = not any(SPACE in p.lstrip(SPACE) or len(p) > 1 and "\n" in p or re.search(f"[{_WORD}][{_MARKS}]", p) for i, p in enumerate(pieces) if not sp.is_byte(i))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode(texts, num_threads=1)

    def encode_parts(self, parts: list[str]) -> list[list[int]]:
        """Parts as they stand. The tokenizer begins with a blank: it is the part's own, else it is taken off with a line break that keeps it apart."""
        found = self.encode([p[1:] if p[0] == " " else "\n" + p for p in parts])
        return [ids if p[0] == " " else ids[2:] for p, ids in zip(parts, found, strict=True)]


@cache
def tokenizers(a_file: str, b_file: str) -> tuple[ByteTokenizer, PieceTokenizer]:
    return ByteTokenizer(a_file), PieceTokenizer(b_file)


class Parts:
    """Cuts texts and encodes the parts; remembers those of the last blocks, about CACHE_PARTS. None stands for a part that a side doesn't give back byte by byte."""

    def __init__(self, a: ByteTokenizer, b: PieceTokenizer):
        self.sides = a, b
        self.cut = b.cuts
        self.known: dict[str, tuple[bytes, bytes] | None] = {}
        self.older: dict[str, tuple[bytes, bytes] | None] = {}

    def parts(self, text: str | None) -> list[str]:
        if not text:
            return []
        text = " " + text
        if not self.cut:
            return [text]
        if UNSAFE.search(text + "\0"):
            return CUT.split(text)
        for mark in MARKED:
            text = text.replace(mark, "\x1f" + mark)
        return text[1:].split("\x1f")

    def learn(self, parts: list[str]) -> None:
        """Encode those parts that aren't known."""
        if len(self.known) > CACHE_PARTS // 3:  # a block adds to either half
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = [p for p in parts if p not in known]
        if older:
            known.update((p, older[p]) for p in new if p in older)
            new = [p for p in new if p not in known]
        both = [side.encode_parts(new) for side in self.sides]
        raw = "".join(new).encode()
        all_same = all(b"".join([side.bytes[i] for ids in found for i in ids]) == raw for side, found in zip(self.sides, both, strict=True))
        for p, a, b in zip(new, *both, strict=True):
            same = all_same or all(b"".join([side.bytes[i] for i in ids]) == p.encode() for side, ids in zip(self.sides, (a, b), strict=True))
            known[p] = (array("i", a).tobytes(), array("i", b).tobytes()) if same else None

    def forget(self, parts: list[str]) -> None:
        for p in parts:
            if len(p) > CACHE_CHARS:
                self.known.pop(p, None)


@cache
def parts_of(a_file: str, b_file: str) -> Parts:
    """A worker's own, kept from task to task."""
    return Parts(*tokenizers(a_file, b_file))


_INTS = T.ArrayType(T.IntegerType(), False)
#: Of each side: where its tokens end; of each place in the bytes, from 0 to the end, the id of the token that holds the byte before (0: none) and where in digits the ids from here on begin (from 1).
#: digits holds the ids in decimal, a comma after each, a's before b's.
SIDE = ("_end", "_id", "_from")
PART = T.StructType([*(T.StructField(side + c, _INTS, False) for side in "ab" for c in SIDE), T.StructField("digits", T.BinaryType(), False)])


def _sums(sizes: np.ndarray) -> np.ndarray:
    """0 and the running sums."""
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def part_fields(sides: tuple, tokens: list[tuple[np.ndarray, np.ndarray]]) -> list[pa.Array]:
    """The fields of PART from each side's tokens: the ids, one part after another, and how many are in each part."""
    lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.astype(np.int32, copy=False), pa.int32()))
    fields, written, before = [], [], np.ones(len(tokens[0][1]), np.int64)
    for side, (ids, sizes) in zip(sides, tokens, strict=True):
        bounds, lengths = _sums(sizes), side.lengths[ids]
        ends, digits = _sums(lengths), _sums(side.digits[ids])
        text = b"".join(map(side.decimal.__getitem__, ids.tolist()))
        written.append([text[i:j] for i, j in pairwise(digits[bounds].tolist())])
        at = ends[bounds]
        places, heads = at + np.arange(len(at)), at[:-1]
        stops = (digits[1:] + np.repeat(before - digits[bounds[:-1]], sizes)).astype(np.int32)
        fields += [lists(bounds, ends[1:] - np.repeat(heads, sizes)), lists(places, np.insert(np.repeat(ids, lengths), heads, 0)), lists(places, np.insert(np.repeat(stops, lengths), heads, before))]
        before = before + np.diff(digits[bounds])
    return [*fields, pa.array([x + y for x, y in zip(*written, strict=True)], pa.binary())]


def tokens_of(docs: DataFrame, a_file: str, b_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of texts: parts, an array of PART, the tokens of both sides of each distinct part; texts, an array of (key, n_a, n_b, parts), for each text the places of its parts.

    A text is read with a blank before it. A null or empty one has no parts, and so has one that a tokenizer
    doesn't give back byte by byte. Special tokens' names within a text are text. Whole texts, one for each row of docs.
    """
    text_type = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("n_a", T.LongType(), False), T.StructField("n_b", T.LongType(), False), T.StructField("parts", _INTS, False)])
    schema = T.StructType([T.StructField("parts", T.ArrayType(PART, False), False), T.StructField("texts", T.ArrayType(text_type, False), False)])

    def block(keys: pa.Array, texts: list[str | None], parts: Parts) -> pa.RecordBatch:
        cut = [parts.parts(x) for x in texts]
        distinct = list(dict.fromkeys(chain.from_iterable(cut)))
        parts.learn(distinct)
        known = [parts.known[p] for p in distinct]
        lost = {p for p, x in zip(distinct, known, strict=True) if x is None}
        cut = [[] if lost and not lost.isdisjoint(c) else c for c in cut]
        place = dict(zip(distinct, range(len(distinct)), strict=True))
        offsets = np.cumsum([0, *map(len, cut)], dtype=np.int32)
        places = np.fromiter(map(place.__getitem__, chain.from_iterable(cut)), np.int32, offsets[-1])
        tokens, numbers = [], []
        for k in (0, 1):
            raw = [x[k] if x else b"" for x in known]
            ids, sizes = np.frombuffer(b"".join(raw), np.int32), np.array(list(map(len, raw)), np.int64) // 4
            tokens.append((ids, sizes))
            total = _sums(sizes[places])
            numbers.append(pa.array(total[offsets[1:]] - total[offsets[:-1]], pa.int64()))
        parts_of = pa.StructArray.from_arrays(part_fields(parts.sides, tokens), PART.names)
        texts_of = pa.StructArray.from_arrays([keys, *numbers, pa.ListArray.from_arrays(pa.array(offsets), pa.array(places))], ["key", "n_a", "n_b", "parts"])
        whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        parts.forget(distinct)
        return pa.RecordBatch.from_arrays([whole(parts_of), whole(texts_of)], names=["parts", "texts"])

    def tokenised(batches):
        parts = parts_of(a_file, b_file)
        for batch in batches:
            column, start = batch.column("text"), 0
            sizes = pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
            while start < batch.num_rows:
                end, size = start, 0
                while end < batch.num_rows and (end == start or size + sizes[end] < BLOCK_BYTES):
                    size += int(sizes[end])
                    end += 1
                yield block(batch.column("key")[start:end], column[start:end].to_pylist(), parts)
                start = end

    return docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text")).mapInArrow(tokenised, schema)


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def groups(part: Column, put, together=lambda x: x) -> Column:
    """together of an array of put(start, end) for each group of a part, in order: its bytes lie between one common end of tokens and the next."""
    return let(F.array_intersect(part["a_end"], part["b_end"]), lambda ends: let(F.concat(F.array(F.lit(0)), ends), lambda starts: together(F.transform(ends, lambda end, k: put(F.get(starts, k), end)))))


def links(part: Column, put) -> Column:
    """put(id of a's token, id of b's token) for each two of a part that overlap, in the order of their bytes."""
    return F.transform(F.sort_array(F.array_union(part["a_end"], part["b_end"])), lambda e: put(F.get(part["a_id"], e), F.get(part["b_id"], e)))


def group_text(part: Column) -> Column:
    """A part's groups as `a1,a2|b1;a3|b2,b3`."""

    def written(text: Column) -> Column:
        def ids(side: str, start: Column, end: Column) -> Column:
            at = part[f"{side}_from"]
            return F.substring(text, F.get(at, start), F.get(at, end) - F.get(at, start) - 1)

        return groups(part, lambda start, end: F.concat(ids("a", start, end), F.lit(b"|"), ids("b", start, end)).cast("string"), lambda x: F.array_join(x, ";"))

    return let(part["digits"], written)


def align(blocks: DataFrame) -> DataFrame:
    """For each text of blocks (of tokens_of) a row: key, n_a, n_b, groups, an array of (a, b) arrays of ids, and links, an array of (a, b) ids."""
    as_struct = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    of = lambda part, side, start, end: F.transform(F.filter(part[f"{side}_end"], lambda e: (e > start) & (e <= end)), lambda e: F.get(part[f"{side}_id"], e))
    one = lambda part: F.struct(groups(part, lambda start, end: as_struct(of(part, "a", start, end), of(part, "b", start, end))).alias("groups"), links(part, as_struct).alias("links"))
    listed = lambda made, text, field: F.flatten(F.transform(text["parts"], lambda i: F.get(made, i)[field])).alias(field)
    texts = let(F.transform(blocks["parts"], one), lambda made: F.transform(blocks["texts"], lambda x: F.struct(x["key"].alias("key"), x["n_a"].alias("n_a"), x["n_b"].alias("n_b"), listed(made, x, "groups"), listed(made, x, "links"))))
    return blocks.select(F.inline(texts))


def pair_bits(a_size: int, b_size: int) -> tuple[int, str]:
    """How many bits b's ids take, and the type in which both ids fit."""
    bits = max(1, (b_size - 1).bit_length())
    return bits, "int" if (a_size - 1).bit_length() + bits <= 31 else "bigint"


def digests(blocks: DataFrame, bits: int, kind: str) -> DataFrame:
    """For each text of blocks a row: key, n_a, n_b, n_groups, n_links (long), groups_sha256, and linked: the pair of ids of each link as one number, sorted.

    The groups are digested as `a1,a2|b1;a3|b2,b3`; a text without tokens has zeros and an empty digest.
    """
    pair = lambda i, j: F.shiftleft(i.cast(kind), bits) + j

    def of_text(words: Column, pairs: Column, x: Column) -> Column:
        of = lambda made: F.transform(x["parts"], lambda i: F.get(made, i))
        sha = F.when(F.size(x["parts"]) > 0, F.sha2(F.array_join(of(words), ";").cast("binary"), 256)).otherwise("")
        return F.struct(x["key"].alias("key"), x["n_a"].alias("n_a"), x["n_b"].alias("n_b"), sha.alias("groups_sha256"), F.sort_array(F.flatten(of(pairs))).alias("linked"))

    made = lambda one: F.transform(blocks["parts"], one)
    texts = let(made(group_text), lambda words: let(made(lambda part: links(part, pair)), lambda pairs: F.transform(blocks["texts"], lambda x: of_text(words, pairs, x))))
    rows = blocks.select(F.inline(texts)).withColumn("n_links", F.size("linked").cast("long"))
    return rows.withColumn("n_groups", F.col("n_a") + F.col("n_b") - F.col("n_links"))


def id_pairs(linked: DataFrame, bits: int) -> DataFrame:
    """pair, n (documents that hold it) and best (no pair of the same id of A has more) of the column linked, written to the shared folder."""
    counted = stored(linked.select(F.explode(F.array_distinct("linked")).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pairs")
    most = counted.groupBy(F.shiftright("pair", bits).alias("a")).agg(F.max("n").alias("most"))  # a row for each id of A: bounded by its vocabulary
    flagged = counted.join(F.broadcast(most), F.shiftright(counted["pair"], bits) == most["a"])
    done = stored(flagged.select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs-best")
    drop_stored(counted)
    return done


def frequent_from(pairs: DataFrame, most: int = HOT_PAIRS) -> int:
    """The smallest count (a power of 2 to a quarter) that at most `most` pairs reach."""
    step = F.floor(F.log2("n") * 4)
    number, reach = 0, 0
    for at, rows in sorted(pairs.groupBy(step.alias("at")).count().collect(), reverse=True):  # 4 rows for each doubling of n
        number += rows
        if number > most:
            reach = at + 1
            break
    return int(2 ** (reach / 4)) if reach else 0


def link_counts(linked: DataFrame, pairs: DataFrame, key: str, most: int = HOT_PAIRS) -> DataFrame:
    """key, n_best and count_sum for each row of linked (key, linked) that has links."""
    step = frequent_from(pairs, most)
    hot, cold = F.broadcast(pairs.where(F.col("n") > step)), pairs.where(F.col("n") <= step)
    rows = linked.select(key, F.explode("linked").alias("pair"))
    warm = rows.join(hot, "pair").groupBy(key).agg(F.count_if("best").alias("n_best"), F.sum("n").alias("count_sum"))
    rare = rows.join(hot, "pair", "left_anti").groupBy(key, "pair").agg(F.count(F.lit(1)).alias("times"))  # one text may repeat a rare pair without end
    met = rare.join(cold, "pair").groupBy(key).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    both = warm.unionByName(met)
    return both.groupBy(key).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignment_counts(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum (long) and groups_sha256 for every row of docs (doc_id, text).

    A pair's count is the number of rows that hold it linked; repeated rows count each. Null and empty
    texts, and those that a tokenizer doesn't give back, have zeros and ''. An empty table gives none.
    """
    a, b = tokenizers(a_file, b_file)
    bits, kind = pair_bits(a.size, b.size)
    made = digests(tokens_of(docs.select("doc_id", "text"), a_file, b_file), bits, kind)
    made = stored(made.withColumn("row", F.monotonically_increasing_id()), "alignment")
    pairs = id_pairs(made, bits)
    out = made.join(link_counts(made, pairs, "row"), "row", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return out.select(F.col("key").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", *counts, "groups_sha256")
