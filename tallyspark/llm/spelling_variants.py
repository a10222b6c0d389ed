"""Spelling variants: words one edit apart, found by halves in Aho-Corasick automata.

One inserted, deleted or replaced code point leaves one half of a word as it is: the first half then
begins the other word, or the second half ends it. Halves are dealt to shards of bounded size by their
text, side and the length of their word; each word is dealt to the shards where a half could stand that
it begins or ends with. A shard builds one automaton of its halves and scans its words. A match counts if
it stands at the word's start or end and the lengths differ by one at most; then the distance is verified
on what is left of both words: of the words of one half an index knows what is left with any one code
point out, so a half that very many words share is no list to go through for each of them.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, drop_stored, stored

RUN = "[A-Za-zÀ-ÿ]+"
#: Most halves of a shard on average, and most words of one half that meet in one shard.
SHARD, GROUP = 50_000, 20_000


def runs_of(docs: DataFrame, slips: int = 31) -> DataFrame:
    """word: each maximal run of letters of each text, A-Z lower-cased. Where slips (0: never) divides the crc32 of `<doc_id>:<run>`, the code point at its remainder by the length is left out."""
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), F.explode(F.regexp_extract_all(ascii_lower(F.col("text").cast("string")), F.lit(RUN), F.lit(0))).alias("word"))
    if not slips:
        return run.select("word")
    hashed = run.select("word", F.crc32(F.concat("key", F.lit(":"), "word").cast("binary")).alias("h"))
    left_out = F.concat(F.expr("substring(word, 1, cast(h % length(word) as int))"), F.expr("substring(word, cast(h % length(word) as int) + 2)"))
    return hashed.select(F.when(F.col("h") % slips == 0, left_out).otherwise(F.col("word")).alias("word"))


def vocabulary(runs: DataFrame, least_length: int = 7, least_n: int = 2) -> DataFrame:
    """word and n of the distinct words that are long and frequent enough."""
    return runs.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def halves(word: str) -> tuple[str, str]:
    """Code points before the middle and from it on."""
    return word[: len(word) // 2], word[len(word) // 2 :]


PAIRS = "word string, near string, near_n long"


def _out_of(rest: str):
    """rest with each one code point out."""
    return [rest[:i] + rest[i + 1 :] for i in range(len(rest))]


def scan(patterns: list[tuple[str, int, int]], routes: list[tuple[str, int, int, int]]) -> list[tuple[str, str, int]]:
    """(word, near, n of near) both ways for words that are one edit apart.

    patterns: word, n, side of its half (0 first, 1 second). routes: word, n, side, and length of the words
    whose halves it is scanned for: its own length, or one less.
    """
    import ahocorasick

    known: dict[str, dict[tuple[int, int], tuple[dict[str, tuple[str, int]], dict[tuple[int, str], list[tuple[str, int]]]]]] = defaultdict(dict)
    for word, n, side in set(patterns):  # two copies of a half may meet in one shard
        parts = halves(word)
        half, rest = parts[side], parts[1 - side]
        whole, gaps = known[half].setdefault((side, len(word)), ({}, defaultdict(list)))
        whole[rest] = (word, n)
        for i, gap in enumerate(_out_of(rest)):
            gaps[i, gap].append((word, n))
    automaton = ahocorasick.Automaton()
    for half, kinds in known.items():
        automaton.add_word(half, (len(half), kinds))
    if not known:
        return []
    automaton.make_automaton()
    asked: dict[tuple[str, int], set[tuple[int, int]]] = defaultdict(set)
    for word, n, side, length in routes:
        asked[word, n].add((side, length))
    out = []
    for (word, n), wanted in asked.items():
        size = len(word)
        for end, (length, kinds) in automaton.iter(word):
            start = end + 1 - length
            for side, other in kinds:
                if (side, other) not in wanted or (start if side == 0 else end + 1 - size):
                    continue  # not dealt here for these, or at another offset
                whole, gaps = kinds[side, other]
                rest = word[length:] if side == 0 else word[:start]
                if other == size:
                    for i, gap in enumerate(_out_of(rest)):
                        out += [(word, near, k) for near, k in gaps.get((i, gap), ()) if near != word]
                else:
                    for near, k in {whole[gap] for gap in _out_of(rest) if gap in whole}:
                        if side == 0 or not word.startswith(halves(near)[0]):  # else its first half has found it
                            out += [(word, near, k), (near, word, n)]
    return out


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n for all pairs of words (word, n; distinct) that differ by exactly one inserted, deleted or replaced code point, both ways, each once."""
    size = F.length("word")
    first, second = F.expr("substring(word, 1, length(word) div 2)"), F.expr("substring(word, length(word) div 2 + 1)")
    sides = F.array(F.struct(F.lit(0).alias("side"), first.alias("half")), F.struct(F.lit(1).alias("side"), second.alias("half")))
    patterns = words.select("word", "n", size.alias("length"), F.inline(sides))
    # a word of length m begins with the half of one of length l, or ends with it, for l = m and m - 1
    begins = [F.struct(F.lit(0).alias("side"), (size - k).alias("length"), F.expr(f"substring(word, 1, (length(word) - {k}) div 2)").alias("half")) for k in (0, 1)]
    ends = [F.struct(F.lit(1).alias("side"), (size - k).alias("length"), F.expr(f"right(word, length(word) - {k} - (length(word) - {k}) div 2)").alias("half")) for k in (0, 1)]
    routes = words.select("word", "n", F.inline(F.array(*begins, *ends)))
    key = ["side", "length", "half"]
    # halves of very many words: at most 2 / GROUP as many as words; their scans are dealt to several shards, each with all its words
    large = F.broadcast(patterns.groupBy(*key).agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > GROUP).select(*key, F.ceil(F.col("many") / GROUP).cast("int").alias("copies")))
    shards = max(1, math.ceil(2 * words.count() / SHARD))
    shard = F.pmod(F.xxhash64(*key, "copy"), F.lit(shards))
    copies = F.coalesce("copies", F.lit(1))
    dealt = patterns.join(large, key, "left").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).select(shard.alias("held_shard"), F.col("word").alias("held"), F.col("n").alias("held_n"), F.col("side").alias("held_side"))
    asked = routes.join(large, key, "left").withColumn("copy", F.pmod(F.xxhash64("word"), copies).cast("int")).select(shard.alias("shard"), "word", "n", "side", "length")

    def found(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = lambda t, *names: list(zip(*(t.column(c).to_pylist() for c in names), strict=True))
        out = scan(rows(left, "held", "held_n", "held_side"), rows(right, "word", "n", "side", "length"))
        return pa.table({"word": pa.array([x[0] for x in out], pa.string()), "near": pa.array([x[1] for x in out], pa.string()), "near_n": pa.array([x[2] for x in out], pa.int64())})

    return dealt.groupBy("held_shard").cogroup(asked.groupBy("shard")).applyInArrow(found, PAIRS)


def with_roots(forms: DataFrame, most: int, ratio: int) -> DataFrame:
    """word, form, root of words that have a form: the last one that following forms comes to.

    Each step multiplies n by ratio at least, so no way is longer than the logarithm of the largest n; a
    round doubles what is followed.
    """
    roots = stored(forms.select("word", "form", F.col("form").alias("root")), "roots")
    for _ in range(math.ceil(math.log2(max(1.0, math.log(max(most, 1), ratio)))) if most > 1 else 0):
        ahead = roots.select(F.col("word").alias("at"), F.col("root").alias("further"))
        further = roots.join(ahead, roots["root"] == ahead["at"], "left").select("word", "form", F.coalesce("further", "root").alias("root"))
        before, roots = roots, stored(further, "roots")
        drop_stored(before)
    return roots


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n for each of words (word, n; stored, distinct).

    form: the near word of largest n, of equal ones the first in code-point order, if its n is ratio times
    the word's at least, else null; root: where following forms ends, the word itself without a form.
    """
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best")).alias("best"))
    table = stored(joined.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")), "variants")
    most = table.agg(F.max("n")).first()[0] or 0
    roots = with_roots(table.where(F.col("form").isNotNull()), most, ratio).select("word", "root")
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The variants among the words of docs (doc_id, text) with at least 7 code points and 2 occurrences.

    Null and empty texts have no words, a null doc_id counts as empty text in the slips' hash, repeated rows
    count again, an empty table gives no rows. Whole texts; one word may make up any share of them.
    """
    return variants(stored(vocabulary(runs_of(docs.select("doc_id", "text"))), "words"))
