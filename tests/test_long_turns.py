from tallyspark.plans.registry import QUERIES


def lines(text):
    """Every word's box, seven to a printed line, merged by brute force."""
    rows = []
    boxes = [(i // 7 * 12.0 + i % 3, i % 7 * 10.0, i // 7 * 12.0 + 10 + i % 2, w) for i, w in enumerate(text.split(" ")) if w.strip()]
    for top, left, bottom, word in sorted(boxes, key=lambda b: b[:2]):
        for row in rows:
            if min(row[1], bottom) - max(row[0], top) > 0.5 * min(row[1] - row[0], bottom - top):
                row[0], row[1] = min(row[0], top), max(row[1], bottom)
                row[2].append((left, word))
                break
        else:
            rows.append([top, bottom, [(left, word)]])
    return [" ".join(w for _, w in sorted(r[2], key=lambda b: b[0])) for r in rows]


def test_every_word_of_long_turns_is_in_a_line(spark, tmp_path):
    turns = [(1, 0, " ".join(f"w{i}" for i in range(300))), (1, 1, "a b"), (2, 0, " ".join(f"x{i}" for i in range(61))), (3, 0, "")]
    spark.createDataFrame([(c, t, "user", x) for c, t, x in turns], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {}
    for r in sorted(QUERIES["V14_lines_from_boxes"](spark, str(tmp_path)).collect()):
        got.setdefault(r.page_id, []).append(r.text)
    assert got == {f"{c}-{t}": lines(x) for c, t, x in turns if x}
    assert sum(len(x.split(" ")) for x in got["1-0"]) == 300
