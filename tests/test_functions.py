from __future__ import annotations

import random
import uuid

import pytest
from pyspark.sql import functions as F

from refloom.functions import scalar as sc
from refloom.functions.matching import MatchError, match_nodes
from refloom.functions.signature import quarter_turns


def subseq(q, txt):
    at, score, prev = 0, 0, -2
    for ch in q:
        f = txt.find(ch, at)
        if f < 0:
            return -1
        score += 1 + (5 if f == 0 or txt[f - 1] in "/_-. " else 0) + (3 if f == prev + 1 else 0)
        prev, at = f, f + 1
    return score


def score(q, txt):
    txt = txt.lower()
    i = txt.find(q)
    if i == 0:
        return 1000 - len(txt)
    if i > 0:
        return (700 if txt[i - 1] in "/_-. " else 500) - i - len(txt) * 0.1
    return subseq(q, txt)


@pytest.mark.parametrize("q", ["ab", "a.b", "b", "aab"])
def test_scores_match_brute_force(spark, q):
    rnd = random.Random(7)
    texts = sorted({"".join(rnd.choice("aAbB./_-c ") for _ in range(rnd.randint(1, 9))) for _ in range(150)})
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.s for r in df.select("t", sc.match_score(q, "t").alias("s")).collect()}
    assert got == pytest.approx({t: score(q, t) for t in texts})


def test_match_positions(spark):
    df = spark.createDataFrame([("abxab",), ("a-b",), ("zz",), ("aab",)], "t string")
    got = {r.t: r.p for r in df.select("t", sc.match_positions("ab", "t").alias("p")).collect()}
    assert got == {"abxab": [0, 1, 3, 4], "a-b": [0, 2], "zz": None, "aab": [1, 2]}


def test_tokens_round_trip(spark):
    rnd = random.Random(3)
    ids = [str(uuid.UUID(int=rnd.getrandbits(128))) for _ in range(60)]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    t, s = sc.encode_token("id"), sc.encode_token("id", short=True)
    rows = df.select("id", t.alias("t"), s.alias("s"), sc.decode_token(t).alias("dt"), sc.decode_token(s).alias("ds"), sc.looks_compressed(t).alias("ok")).collect()
    assert all(r.dt == r.id and r.ds == r.id and len(r.t) == 23 and len(r.s) == 22 and r.ok for r in rows)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    h = ids[0].replace("-", "")
    bits = bin(int(h[5:], 16))[2:].zfill(108)
    assert rows[0].t == h[:5] + "".join(alphabet[int(bits[i:i + 6], 2)] for i in range(0, 108, 6))


def test_paths_and_queries(spark):
    df = spark.createDataFrame([("a/b.c/D.PNG",), ("top",), ("x/y@1@2",)], "p string")
    r = df.select(sc.base("p"), sc.dir_of("p"), sc.ext_of("p"), sc.strip_ext("p"), sc.main_id("p"), sc.sub_id("p")).collect()
    assert tuple(r[0]) == ("D.PNG", "a/b.c", ".png", "a/b.c/D", "a/b.c/D.PNG", None)
    assert tuple(r[1]) == ("top", "", "", "top", "top", None)
    assert tuple(r[2])[4:] == ("x/y", "1@2")
    raw = ["  'db://assets/ui/Coin.png.meta' ", "\\assets\\\\ui\\", "./a//b/", '"x"']
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "q string").select(sc.normalize_path("q")).collect()]
    assert got == ["ui/Coin.png", "ui", "a/b", "x"]
    k = spark.createDataFrame([(512,), (1048576,)], "n long").select(sc.human_size("n")).collect()
    assert [x[0] for x in k] == ["0.5 KB", "1.0 MB"]


def test_size_text_rounds_halves_to_even_as_printf(spark):
    sizes = {256: "0.2 KB", 768: "0.8 KB", 1280: "1.2 KB", 2304: "2.2 KB", 1310720: "1.2 MB", 1835008: "1.8 MB", 2359296: "2.2 MB", 0: "0.0 KB"}
    k = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", sc.human_size("n")).collect()
    assert {r[0]: r[1] for r in k} == sizes


def test_json_helpers(spark):
    df = spark.createDataFrame([('{"b":{"fileId":"x\\"y","z":1},"a":[1,2]}',), ("{bad",)], "t string")
    rows = [r[0] for r in df.select(sc.blank_keys(sc.canonical_json("t"), ["fileId"])).collect()]
    assert rows == ['{"a":[1,2],"b":{"fileId":"","z":1}}', None]
    v = df.select(F.try_parse_json("t").alias("v")).where("v IS NOT NULL")
    assert v.select(sc.get_path("v", "a[1]", "int"), sc.get_path("v", "b.z", "int"), sc.get_path("v", "b.q.r")).first()[:] == (2, 1, None)
    kinds = spark.createDataFrame([(x,) for x in ["null", "[1]", "1.5", '"s"', "true", '{"__uuid__":"u"}', '{"__id__":3}', '{"__type__":"T"}', "{}"]], "t string")
    assert [r[0] for r in kinds.select(sc.value_kind(F.parse_json("t"))).collect()] == ["null", "array", "number", "string", "boolean", "asset", "ref", "T", "object"]


def test_array_edits(spark):
    df = spark.createDataFrame([(["a", "b", "c"], [2, 0, 1], 1), (["x"], [0, 0], 5)], "a array<string>, p array<int>, i int")
    r = df.select(
        sc.is_permutation("p", F.size("a")), sc.permute("a", "p"), sc.insert_at("a", "i", F.lit("N")), sc.remove_at("a", "i")
    ).collect()
    assert r[0][:] == (True, ["c", "a", "b"], ["a", "N", "b", "c"], ["a", "c"])
    assert (r[1][0], r[1][2], r[1][3]) == (False, None, None)


def test_quarter_turns_are_rotations():
    t = quarter_turns(2)
    assert t == [[0, 1, 2, 3], [2, 0, 3, 1], [3, 2, 1, 0], [1, 3, 0, 2]]


def test_matcher(spark, make):
    g = make({"1": ("a", 1, "X", "art/c.png"), "2": ("b", 1, "Y", "ui/c.png"), "3": ("a", 1, None, "ui/d.png")}, [])
    ids = lambda spec: {r.id for r in g.nodes.where(match_nodes(spec)).collect()}
    assert ids(None) == {"1", "2", "3"}
    assert ids({"type": "a", "pathStartsWith": ["ui/", "no/"]}) == {"3"}
    assert ids({"basename": "c.png", "not": {"container": "X"}}) == {"2"}
    assert ids({"pathRegex": "^art/", "basenameRegex": ["^c", "^z"]}) == {"1"}
    assert ids({"not": {"container": "X"}}) == {"2", "3"}
    with pytest.raises(MatchError):
        match_nodes({"pathRegex": "("})
