"""Line dedup against brute force."""

from __future__ import annotations

import random

import pytest

from refloom.llm import lines


def within_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p:] == b[p + 1 :] or (len(a) == len(b) and a[p + 1 :] == b[p + 1 :])


def brute(docs, edits=1):
    normal = lambda s: s.lower().translate({9: 32, 13: 32, 11: 32, 12: 32}).strip(" ")
    place = lambda i, n: (i is not None, i or 0, n)
    all_lines = [(place(i, n), normal(s)) for i, t in docs for n, s in enumerate((t or "").split("\n")) if normal(s)]
    out = []
    for i, t in docs:
        parts = t.split("\n") if t is not None else []
        kept = [s for n, s in enumerate(parts) if not normal(s) or not any(p < place(i, n) and (o == normal(s) or (edits and within_one(o, normal(s)))) for p, o in all_lines)]
        out.append((i, "\n".join(kept) if t is not None else None, len(parts), len(parts) - len(kept)))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(4)
    base = ["".join(rng.choice("abé xyz") for _ in range(rng.randrange(1, 60))) for _ in range(25)] + ["a", "b", "ab", "the same line", "aaaa", "aaa", "x" * 3000]
    docs = [(1, None), (2, ""), (3, "\n \n"), (None, "the same line\nno id"), (4, "the same line\r\nThe Same Line"), (5, "the same lime"), (6, "he same lime\nthe same")]
    for i in range(10, 50):
        picked = []
        for _ in range(rng.randrange(0, 8)):
            s = list(rng.choice(base))
            for _ in range(rng.randrange(0, 3)):
                k = rng.randrange(len(s) + 1)
                s[k : k + rng.randrange(2)] = rng.choice(["", "q", "Z", "é"])
            picked.append("".join(s))
        docs.append((i, "\n".join(picked)))
    return docs + [docs[20], (30, "another\nthe same line")]


@pytest.mark.parametrize("edits", [0, 1])
def test_documents(spark, edits):
    docs = cases()
    df = spark.createDataFrame([(i, t, 5, "s") for i, t in docs], "doc_id long, text string, n_lines int, source string")
    got = lines.dedup_lines(df.repartition(4), edits)
    assert got.columns == ["doc_id", "text", "source", "n_lines", "n_removed"]
    assert sorted(map(tuple, got.select("doc_id", "text", "n_lines", "n_removed").collect()), key=repr) == brute(docs, edits)


def test_empty_table_and_bounds(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lines.dedup_lines(df).count() == 0
    with pytest.raises(ValueError):
        lines.dedup_lines(df, 2)


def test_many_variants_of_one_line(spark):
    rows = [(i, f"line number {chr(33 + i)} of a form") for i in range(90)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed = 0").collect()
    assert [r.doc_id for r in got] == [0]


def test_documents_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "first line\nsecond one", 1, 2, 3, "4"), (2, "second one\nthird thing", 5, 6, 7, "8")], "doc_id long, text string, _row int, _doc int, _id int, _marks string")
    got = lines.dedup_lines(df)
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    assert sorted(map(tuple, got.collect())) == [(1, "first line\nsecond one", 1, 2, 3, "4", 2, 0), (2, "third thing", 5, 6, 7, "8", 2, 1)]


def test_lines_are_normalised_once_and_texts_are_not_sorted(spark):
    df = spark.createDataFrame([(1, "one\ttwo\n \r\x0b\x0c\t\n\x0bÉcole"), (2, None), (3, "\u00a0\n")], "doc_id long, text string")
    full = lines._lines(df, full=True)
    assert sorted(map(tuple, full.select("doc_id", "_line", "_t").collect())) == [(1, 0, "one two"), (1, 2, "école"), (3, 0, "\u00a0")]
    plan = full.select("_h")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 2  # both branches of one expression; a filter on its result would add two
