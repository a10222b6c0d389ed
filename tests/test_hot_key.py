from datetime import datetime, timedelta, timezone

import pytest

from tallyspark.streaming import limiter

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.mark.parametrize("part", [3, 64])
def test_a_hot_key_is_replayed_in_parts(spark, monkeypatch, part):
    steps, rows = [1, 2, 7, 30, 1, 1, 3], []
    at = 0
    for i in range(200):  # never a pause of over 120 s
        at += steps[i % 7]
        rows.append(("a", "ip", START + timedelta(seconds=at), i % 29 == 0))
    rows += [("b", "ip", START + timedelta(seconds=500 * i), False) for i in range(3)]
    want = []
    for email in "ab":
        want += [(f"{email}|ip", *x) for x in limiter.replay([(r[2].timestamp(), r[3]) for r in rows if r[0] == email], [], 0.0)[0]]
    whole = limiter.replay

    def bounded(attempts, failures, until):
        attempts = list(attempts)
        assert len(attempts) <= part
        return whole(attempts, failures, until)

    monkeypatch.setattr(limiter, "replay", bounded)
    df = spark.createDataFrame(rows, "email string, ip string, ts timestamp, success boolean")
    got = sorted(tuple(r) for r in limiter.blocked_attempts(df, part).collect())
    assert got == sorted(want) and any(r[3] for r in got) and any(r[4] for r in got)
    assert limiter.blocked_attempts(df.limit(0), part).count() == 0
