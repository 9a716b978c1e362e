"""Benchmark decontamination: templates by example, leaks against brute force, edge cases."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa

from refloom.llm import decontaminate as dc

QUESTION = "A train leaves with 120 people at 5 km per hour and Anna walks 3 miles to meet Anna near the old bridge before noon"


def marks(text):
    _, code, _ = dc.templates(pa.array([text], pa.string()))
    kinds = {int(m): k for m, k in ((dc.NUMBER, "#"), (dc.UNIT, "u"), (dc.NAME, "n"), (dc.MEASURE, "m"))}
    return "".join(kinds.get(int(c), ".") for c in code)


def test_placeholders():
    assert marks("He ran 5 km. With Anna, (12.5) times; 7kg\nThen 3 x $4,000 km É. Ünder Élan!") == "..#u.n#.m.#.#un.n"
    assert marks("") == "" and marks(None) == ""
    same = [dc.templates(pa.array([t]))[1].tolist() for t in ("The dog, ran!", "the DOG. ran")]
    assert same[0][2] == same[1][2] and same[0][0] == same[1][0]


def test_changed_questions(spark):
    rng = random.Random(2)
    filler = lambda: " ".join(f"w{rng.choice('abcdefgh')}{rng.choice('xyz')}" for _ in range(40))
    changed = QUESTION.replace("120", "75").replace("5 km", "9 miles").replace("Anna", "Maria").replace("3", "41")
    mixed = QUESTION.replace("Anna walks", "Maria walks").replace("meet Anna", "meet Bob")
    docs = [
        (1, f"{filler()} {QUESTION} {filler()}"), (2, f"{filler()}.\n{changed}"), (3, f"{filler()} {mixed} {filler()}"), (4, filler()), (5, None), (6, ""),
        (7, f"{filler()} {' '.join(QUESTION.split()[4:18])} {filler()}"), (8, " ".join(QUESTION.split()[:7])), (None, QUESTION), (1, filler()), (9, f"{QUESTION} " * 2000), (10, "five small words of text"),
    ]
    bench = [(70, QUESTION), (71, "Five small words of text"), (72, None), (73, "too short"), (74, "1 2 3 4 5 6 7 8 9 10 11 12")]
    df = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, item_ids string")
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = sorted(((r.doc_id, r.contaminated, tuple(r.item_ids)) for r in dc.mark(df.repartition(3), items).collect()), key=repr)
    leaked = {1: (70,), 2: (70,), 7: (70,), None: (70,), 9: (70,), 10: (71,)}
    want = [(i, i in leaked and k != 9, leaked.get(i, ()) if k != 9 else ()) for k, (i, _) in enumerate(docs)]
    assert got == sorted(want, key=repr)
    kept = dc.drop_contaminated(df, items)
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect())) == [1, 3, 4, 5, 6, 8]
    assert dc.mark(df, items.limit(0)).where("contaminated").count() == 0
    assert dc.mark(df.limit(0), items).count() == 0


def test_given_tables_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    strip = lambda w: w.strip(".,;:!?\"'()[]{}$%+-").lower() or w
    split = lambda t: [strip(w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    grams = {}
    for r in bench.collect():
        w = split(r.text)
        for k in range(len(w) - 12):
            grams.setdefault(tuple(w[k : k + 13]), set()).add(r.item_id)
    want = {}
    for r in docs.collect():
        w = split(r.text)
        want[r.doc_id] = set().union(*(grams.get(tuple(w[k : k + 13]), set()) for k in range(len(w) - 12))) if len(w) > 12 else set()
    got = {r.doc_id: set(r.item_ids) for r in dc.mark(docs, bench).collect()}
    assert got == want or all(got[i] >= want[i] for i in want) and np.mean([got[i] == want[i] for i in want]) > 0.99


def test_copies_without_literal_words(spark):
    """Items of capitals, names or numbers only, and copies in another case."""
    caps = "WHICH OF THE FOLLOWING RIVERS FLOWS THROUGH THE MOST COUNTRIES OF CENTRAL EUROPE"
    names = "the list has Anna Maria Bob Carla Dieter Emil Frida Gustav Hanna Ida Jonas Karl Lena"
    numbers = "sum 12 7 kg 19 mm 44 3 km 81 55 6 g 90 13 28 77"
    german = "Der alte Bäcker trägt Äpfel, Birnen, Brot, Käse, Öl und Wein über Brücken, Straßen, Plätze"
    items = spark.createDataFrame([(1, caps), (2, names), (3, numbers), (4, german)], "item_id long, text string")
    filler = "some words before"
    docs = [(1, f"{filler} {caps}"), (2, f"{filler} {names}"), (3, f"{filler} {numbers}"), (4, f"{filler} {german}"), (5, german.lower()), (6, german.upper()), (7, caps.lower()), (8, names.upper()), (9, filler.upper()), (10, None)]
    got = {r.doc_id: list(r.item_ids) for r in dc.mark(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {1: [1], 2: [2], 3: [3], 4: [4], 5: [4], 6: [4], 7: [1], 8: [2], 9: [], 10: []}


def test_one_edit_of_a_repeated_value(spark):
    """What is copied word for word counts, though a value that occurs twice was changed once."""
    item = "the farmer puts 12 apples in a box and takes the box to the market where people buy all of them and later 12 more apples are put in the same box"
    edited = "13 more".join(item.rsplit("12 more", 1))
    df = spark.createDataFrame([(1, edited), (2, item.replace("12", "15"))], "doc_id long, text string")
    items = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert {r.doc_id: r.contaminated for r in dc.mark(df, items).collect()} == {1: True, 2: True}


def test_documents_with_clashing_names(spark):
    item = " ".join(f"word{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = spark.createDataFrame([(1, item, 5, 6, 7), (2, "other", 5, 6, 7)], "doc_id long, text string, _doc int, _id int, _items int")
    assert [tuple(r) for r in dc.drop_contaminated(df, bench).collect()] == [(2, "other", 5, 6, 7)]
