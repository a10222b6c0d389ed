"""Lines from boxes: a page cut into islands gives what one pass over its boxes gives."""

import random

import pytest

from tallyspark.operators import receipt_text

BOX = "page_id string, x0 double, x1 double, y0 double, y1 double, text string"


def brute(boxes):
    out = []
    for page in sorted({b[0] for b in boxes}):
        lines = []
        for _, x0, _, y0, y1, text in sorted((b for b in boxes if b[0] == page and b[5] and b[5].strip() and None not in b[1:5]), key=lambda b: (b[3], b[1], b[4], b[2], b[5])):
            for line in lines:
                if min(line[1], y1) - max(line[0], y0) > 0.5 * min(line[1] - line[0], y1 - y0):
                    line[0], line[1] = min(line[0], y0), max(line[1], y1)
                    line[2].append((x0, text))
                    break
            else:
                lines.append([y0, y1, [(x0, text)]])
        out += [(page, i, " ".join(t for _, t in sorted(line[2], key=lambda b: b[0]))) for i, line in enumerate(lines)]
    return out


@pytest.mark.parametrize("part", [1, 40, 5000])
def test_random_pages(spark, part):
    rng = random.Random(part)
    boxes = [("none", 0.0, 1.0, 0.0, 1.0, " "), ("none", None, 1.0, 0.0, 1.0, "x")]
    for page in ("a", "b", "c"):  # tilted lines of any height, some over each other, equal boxes
        for i in range(250):
            top, left = i // 6 * rng.choice([9.0, 14.0, 21.0]) + rng.random() * 6, i % 6 * 11.0
            boxes += [(page, left, left + 10, top, top + rng.choice([0.0, 4.0, 10.0, 30.0]), f"w{i % 90}")] * (1 + (i % 50 == 0))
    rng.shuffle(boxes)
    assert sorted(tuple(r) for r in receipt_text.lines_from_boxes(spark.createDataFrame(boxes, BOX), part).collect()) == brute(boxes)


def test_a_large_page_is_spread_over_tasks(spark):
    df = spark.range(40_000).selectExpr("'p' AS page_id", "double(id % 8 * 10) AS x0", "double(id % 8 * 10 + 9) AS x1", "double(id div 8 * 12) AS y0", "double(id div 8 * 12 + 10) AS y1", "string(id) AS text")
    rows = receipt_text.lines_from_boxes(df)
    got = rows.selectExpr("count(*) AS n", "max(line) AS last", "count_if(text = array_join(transform(sequence(0, 7), i -> string(line * 8 + i)), ' ')) AS right").first()
    assert tuple(got) == (5000, 4999, 5000)


def test_small_pages_cost_no_frame_of_their_own(spark):
    """Pages go through a task as one stream, after one shuffle; pages without an id are one page."""
    boxes = [(p, x, x + 9.0, y, y + 10.0, f"{x:g}/{y:g}") for p in (None, "a", "b") for y in (0.0, 12.0) for x in (10.0, 0.0)]
    rows = receipt_text.lines_from_boxes(spark.createDataFrame(boxes, BOX), 1)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and plan.count("Exchange") == 1
    assert sorted((r.page_id or "", r.line, r.text) for r in rows.collect()) == [(p, i, f"0/{y} 10/{y}") for p in ("", "a", "b") for i, y in enumerate((0, 12))]
