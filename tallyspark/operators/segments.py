"""Rules whose state goes from row to row of a key (a stock, recent failures), replayed in segments that run at once.

Rows are sorted over the cluster by key and order and cut into parts, wherever in a key a cut falls, so no task
holds a whole key. Every part is replayed from a guess of the state at its first row. Then ends and beginnings of
neighbours are compared, and only parts that began with a wrong state are replayed again, all of them together.
The state at most parts' ends hardly depends on where they began, so a pass or two are enough, however long a key is.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import drop_stored, stored

_ROW_BITS = 33  # of monotonically_increasing_id: the row's place in its partition


def segments(rows: DataFrame, key: str, order: list[str], part: int) -> DataFrame:
    """rows with __part (long, ascending by key and order), at most `part` rows of each, in the shared folder."""
    cut = rows.repartitionByRange(max(1, -(-rows.count() // part)), key, *order).sortWithinPartitions(key, *order)
    place = F.monotonically_increasing_id()
    low = place.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return stored(cut.withColumn("__part", place - low + F.floor(low / part)), "segments")


def changed_entries(ends: DataFrame, key: str) -> DataFrame:
    """The parts (__part, __entry) whose key's part before ended with another state than they began with."""
    before = F.lag("__exit").over(Window.partitionBy(key).orderBy("__part"))
    return ends.withColumn("__entry", before).where("__entry is not null and not __entry <=> __used").select("__part", "__entry")


def moved_entries(ends: DataFrame, key: str) -> DataFrame:
    """The same for a state of one number, where a replay holds for all entries within __room (how much lower, and less than
    how much higher, null for any) and ends as much lower or higher. A part that doesn't hold is taken to end as it did
    until it is replayed. One task walks over a key's ends: a row for each of its parts."""

    def walk(parts: pd.DataFrame) -> pd.DataFrame:
        again, end = [], None
        for part, used, left, room in parts.sort_values("__part")[["__part", "__used", "__exit", "__room"]].itertuples(index=False):
            shift = 0 if end is None else end - used[0]
            lower, higher = room
            if (lower is None or -shift <= lower) and (higher is None or shift < higher):
                end = left[0] + shift
            else:
                again.append((part, [end]))
                end = left[0]
        return pd.DataFrame(again, columns=["__part", "__entry"])

    kind = T.StructType([T.StructField("__part", T.LongType()), T.StructField("__entry", ends.schema["__used"].dataType)])
    return ends.groupBy(key).applyInPandas(walk, kind)


def replayed(
    rows: DataFrame, key: str, order: list[str], run: Callable, results: str, state: str, part: int, wrong: Callable = changed_entries, guess: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """rows (with __start, the state before a key's first row) with the columns of results (a schema).

    run(rows of one key in order, lists by column, state) gives (results by column, lists, state after them, room or None); state is an
    array type. guess makes (__part, __entry) of the cut rows, for parts that begin within a key. wrong(ends, key)
    names the parts to replay again, with their entries; it gets key, __part, __used, __exit and __room of the first and last key of each part.
    """
    cut, added = segments(rows, key, order, part), T.StructType.fromDDL(results)
    names = [c for c in rows.columns if c != "__start"]
    kind = T.StructType.fromDDL(f"x {state}")[0].dataType
    own = [T.StructField("__part", T.LongType()), T.StructField("__end", T.BooleanType()), *[T.StructField(c, kind) for c in ("__used", "__exit", "__room")]]
    schema = T.StructType([*(rows.schema[c] for c in names), *added, *own])

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([key, *order], kind="stable", na_position="first").reset_index(drop=True)
        entry, n = frame["__entry"].iloc[0], len(frame)
        values, starts = {c: frame[c].tolist() for c in names}, frame["__start"].tolist()
        results: dict[str, list] = {c: [] for c in added.names}
        marks: dict[str, list] = {"__end": [False] * n, "__used": [None] * n, "__exit": [None] * n, "__room": [None] * n}
        cuts = [0, *(np.flatnonzero(np.diff(pd.factorize(frame[key])[0])) + 1), n]
        # lists, as a frame of its own for each key would take far longer than its few rows
        for low, high in pairwise(cuts):
            used = list(starts[low] if low or entry is None else entry)
            columns, left, room = run({c: v[low:high] for c, v in values.items()}, used)
            for c in added.names:
                results[c] += columns[c]
            if low == 0 or high == n:
                for c, v in zip(marks, (True, used, left, room), strict=True):
                    marks[c][high - 1] = v
        return frame[[*names, "__part"]].assign(**results, **marks)[schema.names]

    entries = guess(cut) if guess else None
    given = cut.join(entries, "__part", "left") if entries is not None else cut.withColumn("__entry", F.lit(None).cast(kind))
    passes: list[DataFrame] = []
    ends = None
    while True:
        passes.append(stored(given.groupBy("__part").applyInPandas(one, schema), "replayed"))
        new = passes[-1].where("__end").select(key, "__part", "__used", "__exit", "__room")
        held = new if ends is None else ends.join(new.select("__part").distinct(), "__part", "left_anti").unionByName(new)
        held, old = stored(held, "ends"), ends
        if old is not None:
            drop_stored(old)
        ends, again = held, wrong(held, key)
        if again.isEmpty():
            break
        given = cut.join(again, "__part")
    drop_stored(cut)
    out, later = passes[-1], passes[-1].select("__part").distinct()
    for table in reversed(passes[:-1]):
        out = out.unionByName(table.join(later, "__part", "left_anti"))
        later = later.unionByName(table.select("__part").distinct()) if table is not passes[0] else later
    drop_stored(ends)
    return out.select(*names, *added.names)
