"""Keys of few rows: what a replay costs beside its rules is for parts, not for keys."""

import pandas as pd

from tallyspark.operators import segments


def test_no_frame_is_made_for_each_key(spark):
    n = 500
    rows = spark.createDataFrame([(None if k % 100 == 7 else f"k{k // 2:03}", k, [0]) for k in range(n)], "key string, at int, __start array<int>")

    def run(rows, state):
        assert not isinstance(rows, pd.DataFrame)
        state = state[0]
        return {"n": [state + i + 1 for i in range(len(rows["at"]))]}, [state + len(rows["at"])], None

    got = segments.replayed(rows, "key", ["at"], run, "n int", "array<int>", 60).collect()
    want: dict = {}
    for k in range(n):
        want.setdefault(None if k % 100 == 7 else f"k{k // 2:03}", []).append(k)
    assert sorted((r.at, r.n) for r in got) == sorted((at, i + 1) for ats in want.values() for i, at in enumerate(ats))
