"""Closure sizes and closure reports of very many roots without a stored row for each pair of root and reached node.

What a link leads to is a target.  Every node reaches its own targets and whatever their heads reach: the head of a target is
the only node it links to, or the target itself where it links to several; a target without links has none.  So only heads need
sets of their own, and targets that lead to one and the same node share one.  Heads and all that lies behind them are the core;
core links are walked alone, which leaves out the many nodes that nothing leads to.  Then all links move twice: to their targets,
for number and head, and to their sources, where what a node reaches is put together and counted without being stored.

Exact sets are words of 64 bits, (node, word, bits): the bitwise or of the children's sets, level by level over the core with its
cycles contracted; core nodes, then targets with many links, get the lowest numbers, so that what many sets share lies in few
words.  Equal words of different sources are counted once for the sources of each target.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.operators.scc import cycle_members
from refloom.plans.ordering import global_positions
from refloom.plans.runtime import Cut, cut, join_frontier, union_all


# A task that puts together what sources reach gets about this many links, so that its tables fit into memory.
TASK_LINKS = 500_000


@dataclass(frozen=True)
class Heads:
    """``pairs`` (src, dst): the links that join two nodes, ``count`` of them; ``targets`` (id, uses, head, inside: in the core);
    ``core`` (id); ``inner`` (src, dst): the links between core nodes."""

    pairs: DataFrame
    count: int
    targets: Cut
    core: Cut
    inner: Cut


def _mark(c):
    return F.xxhash64(c)


def heads_of(links: DataFrame) -> Heads:
    """A node has a single child if the smallest and the largest hash of its children are equal and no other target has that hash."""
    pairs = links.where(F.col("src") != F.col("dst")).select("src", "dst")
    ends = cut(pairs.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("uses")))
    mark = _mark("dst")
    kids = pairs.groupBy(F.col("src").alias("id")).agg(F.min(mark).alias("low"), F.max(mark).alias("high"))
    kids = cut(kids.join(ends.hinted().select("id"), "id"))
    marks = ends.df.select(F.col("id").alias("only"), _mark("id").alias("mark"))
    shared = cut(marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark"))
    owned = kids.df.where("low = high").select("id", F.col("low").alias("mark"))
    if not shared.empty:
        owned = owned.join(shared.hinted(), "mark", "left_anti")
    single = cut(marks.join(owned, "mark").select("id", "only"))
    several = cut(kids.df.select("id").join(single.hinted().select("id"), "id", "left_anti"))
    onward = single.df.select(F.col("id").alias("src"), F.col("only").alias("dst"))
    if not several.empty:
        onward = onward.unionByName(pairs.join(several.hinted(), F.col("src") == F.col("id"), "left_semi").distinct())
        onward = cut(onward).df
    core = cut(onward.select(F.col("dst").alias("id")).unionByName(several.df.select("id")).distinct())
    inner = cut(onward.join(core.hinted(), F.col("src") == F.col("id"), "left_semi"))
    head = single.df.select("id", F.col("only").alias("head")).unionByName(several.df.select("id", F.col("id").alias("head")))
    targets = ends.df.join(head, "id", "left").join(core.hinted().withColumn("_in", F.lit(True)), "id", "left")
    count = ends.df.agg(F.sum("uses").alias("n")).first()["n"] or 0
    return Heads(pairs, count, cut(targets.select("id", "uses", "head", F.col("_in").isNotNull().alias("inside"))), core, inner)


def _words(df: DataFrame, node: str, member: str) -> DataFrame:
    """(node, word, bits) that sets the bit of ``member`` in the set of ``node``."""
    return df.select(F.col(node).alias("node"), F.shiftright(member, 6).alias("word"), _bit(member).alias("bits"))


def _bit(member: str):
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.col(member).bitwiseAND(F.lit(63)).cast("int"))


def _joined(parts: list[DataFrame]) -> DataFrame:
    return union_all(parts).groupBy("node", "word").agg(F.bit_or("bits").alias("bits"))


def _members(sets: DataFrame, *keep: str) -> DataFrame:
    """One row for each bit that is set, with the columns ``keep`` and its ``num``."""
    there = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("bits", i) == 1)
    return sets.select(*keep, "word", F.explode(there).alias("_i")).select(*keep, (F.col("word") * 64 + F.col("_i")).alias("num"))


def _levelled(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """((s, d, level of d), (node, comp) of nodes on cycles or None): links between components, each with its end's level.

    One job a level; what is left when no sink can be taken away holds all cycles, which are contracted once.
    """
    done: list[DataFrame] = []
    comps: DataFrame | None = None
    level, left = 0, edges
    while True:
        heads = left.select(F.col("s").alias("_s")).distinct()
        tagged = cut(left.join(heads, F.col("d") == F.col("_s"), "left").select("s", "d", F.col("_s").isNull().alias("sink")))
        if tagged.empty:
            break
        removed = tagged.df.where("sink")
        if removed.isEmpty():
            found = cycle_members(tagged.df.select(F.col("s").alias("src"), F.col("d").alias("dst")))
            comps = cut(found.select(F.col("member").alias("node"), F.col("group").alias("comp"))).df
            left = cut(_contracted(tagged.df, comps, ["s", "d"]).where("s <> d").select("s", "d").distinct()).df
            continue
        done.append(removed.select("s", "d", F.lit(level).alias("level")))
        left = tagged.df.where("NOT sink").select("s", "d")
        level += 1
    if not done:
        return edges.select("s", "d", F.lit(0).alias("level")).where(F.lit(False)), comps
    out = union_all(done)
    if comps is not None:
        out = _contracted(out, comps, ["s"]).distinct()
    return out, comps


def _contracted(df: DataFrame, comps: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        named = comps.select(F.col("node").alias("_node"), F.col("comp").alias("_comp"))
        df = df.join(named, F.col(c) == F.col("_node"), "left").withColumn(c, F.coalesce("_comp", c)).drop("_node", "_comp")
    return df


def _sets(nodes: DataFrame, edges: DataFrame) -> tuple[Cut, DataFrame | None]:
    """((node, word, bits): the number of each node and of all it reaches, (node) of nodes on cycles or None)."""
    levelled, comps = _levelled(edges)
    tops = levelled.groupBy(F.col("s").alias("_n")).agg((F.max("level") + 1).alias("at"))
    ready = cut(levelled.join(tops, F.col("s") == F.col("_n")).select("s", "d", "at")).df
    top = ready.agg(F.max("at").alias("n")).first()["n"] or 0
    own = _words(nodes, "num", "num")
    if comps is not None:
        in_cycle = _words(comps, "comp", "node").groupBy("node", "word").agg(F.bit_or("bits").alias("bits"))
        own = cut(own.join(comps.select("node"), "node", "left_anti").unionByName(in_cycle)).df
    stored: list[DataFrame] = []
    for at in range(1, top + 1):
        part = ready.where(F.col("at") == at).select("s", "d")
        below = union_all([own, *stored]).withColumnRenamed("node", "d")
        got = cut(_joined([part.join(below, "d").select(F.col("s").alias("node"), "word", "bits")]))
        stored.append(got.df)
    reach = _joined([own, *stored])
    if comps is None:
        return cut(reach), None
    shown = comps.select(F.col("node").alias("_member"), F.col("comp").alias("node")).join(reach, "node")
    alone = reach.join(comps.select("node"), "node", "left_anti")
    return cut(alone.unionByName(shown.select(F.col("_member").alias("node"), "word", "bits"))), comps.select("node")


@dataclass(frozen=True)
class _Numbered:
    """``targets`` (id, num, cls: the number of the head); ``sets`` (node, word, bits) of the core; ``looped`` (id, num) or None."""

    targets: Cut
    sets: Cut
    looped: Cut | None


def _numbered(h: Heads) -> _Numbered:
    order = h.targets.df.select((~F.col("inside")).alias("outside"), (-F.col("uses")).alias("rare"), "id", "head")
    nums = cut(global_positions(order, ["outside", "rare", "id"], "num").select("id", "head", "num", "outside"))
    core = cut(nums.df.where(~F.col("outside")).select("id", "num"))
    name = lambda i, n: core.hinted().select(F.col("id").alias(i), F.col("num").alias(n))
    edges = cut(h.inner.df.join(name("src", "s"), "src").join(name("dst", "d"), "dst").select("s", "d")).df
    sets, looped = _sets(core.df.select("num"), edges)
    targets = cut(nums.df.join(name("head", "cls"), "head", "left").select("id", "num", "cls"))
    if looped is not None:
        looped = cut(core.df.join(looped, F.col("num") == F.col("node")).select("id", "num"))
    return _Numbered(targets, sets, looped)


def _gathered(near: DataFrame, extra: list[str], count: int) -> DataFrame:
    """(src, key, far, extra): each source's targets by ``num`` and, marked ``far``, heads by ``cls``, once each, the rows of a source together.

    Heads are dealt out after the links moved, so that a link is one row on its way.
    """
    none = [F.lit(None).cast(near.schema[c].dataType).alias(c) for c in extra]
    both = F.array(F.struct(F.col("num").alias("key"), F.lit(False).alias("far"), *extra), F.struct(F.col("cls").alias("key"), F.lit(True).alias("far"), *none))
    tasks = -(-count // TASK_LINKS)
    few = tasks <= int(near.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    moved = near.repartition("src") if few else near.repartition(tasks, "src")
    rows = moved.select("src", F.explode(both).alias("_r")).select("src", "_r.*")
    return rows.where("key IS NOT NULL").distinct()


def closure_counts(links: DataFrame, heads: Heads | None = None) -> DataFrame:
    """(id, downstream, upstream) of every end of a link that joins two nodes."""
    h = heads or heads_of(links)
    n = _numbered(h)
    near = h.pairs.join(n.targets.hinted().withColumnRenamed("id", "dst"), "dst").select("src", "num", "cls")
    sets = n.sets.hinted().select(F.col("node").alias("_node"), F.col("word").alias("_word"), F.col("bits").alias("_bits"))
    rows = _gathered(near, [], h.count).join(sets, F.col("far") & (F.col("key") == F.col("_node")), "left")
    own = lambda c, e: F.when(F.col("far"), F.col(c)).otherwise(e)
    rows = rows.select("src", own("_word", F.shiftright("key", 6)).alias("word"), own("_bits", _bit("key")).alias("bits"))
    reach = rows.groupBy("src", "word").agg(F.bit_or("bits").alias("bits"))
    # one row for the source's own count and one for the word, whose equals are added up before its bits are taken apart
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    down = F.struct(F.col("src").alias("id"), none("word", "long"), none("bits", "long"), F.bit_count("bits").cast("long").alias("n"))
    up = F.struct(none("id", "string"), F.col("word"), F.col("bits"), F.lit(1).cast("long").alias("n"))
    tally = reach.select(F.explode(F.array(down, up)).alias("_r")).select("_r.*").groupBy("id", "word", "bits").agg(F.sum("n").alias("n"))
    tally = cut(tally).df
    above = _members(tally.where("id IS NULL"), "n").groupBy("num").agg(F.sum("n").alias("n")).join(n.targets.df.select("id", "num"), "num")
    zero = F.lit(0).cast("long")
    sums = [
        tally.where("id IS NOT NULL").select("id", F.col("n").alias("downstream"), zero.alias("upstream")),
        above.select("id", zero.alias("downstream"), F.col("n").alias("upstream")),
    ]
    if n.looped is not None:  # what lies on a cycle reached itself
        sums.append(n.looped.df.select("id", (zero - 1).alias("downstream"), (zero - 1).alias("upstream")))
    return union_all(sums).groupBy("id").agg(F.sum("downstream").alias("downstream"), F.sum("upstream").alias("upstream"))


def report_by_type(links: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, type, n, total_size) of what each root reaches; ``nodes`` has the (id, type, size) that count."""
    h = heads_of(links)
    n = _numbered(h)
    facts = n.targets.df.join(nodes.withColumn("there", F.lit(True)), "id", "left")
    near = h.pairs.join(facts.withColumnRenamed("id", "dst"), "dst").where("there OR cls IS NOT NULL").select("src", "num", "there", "type", "size", "cls")
    behind = cut(_members(n.sets.df, "node").join(facts.where("there").select("num", "type", "size"), "num")).hinted()
    behind = behind.select(F.col("node").alias("_node"), F.col("num").alias("_num"), F.col("type").alias("_type"), F.col("size").alias("_size"))
    rows = _gathered(near, ["there", "type", "size"], h.count).join(behind, F.col("far") & (F.col("key") == F.col("_node")), "left")
    own = lambda a, b: F.when(F.col("far"), F.col(a)).otherwise(F.col(b)).alias(b)
    rows = rows.where("there OR _num IS NOT NULL").select(F.col("src").alias("root"), own("_num", "key"), own("_type", "type"), own("_size", "size"))
    if n.looped is not None:
        rows = rows.join(n.looped.hinted().select(F.col("id").alias("root"), F.col("num").alias("key")), ["root", "key"], "left_anti")
    per = rows.distinct().groupBy("root", "type").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total_size"))
    return per.join(roots.select(F.col("id").alias("root")).distinct(), "root", "left_semi")


def _spread_sketches(start: DataFrame, links: DataFrame) -> Cut:
    """(id, sk): the union of each node's sketch with those of all that lead to it along ``links`` (src, dst)."""
    state = changed = cut(start)
    while not changed.empty:
        pushed = join_frontier(changed, links, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("pid")).agg(F.hll_union_agg("sk").alias("got"))
        both = F.hll_union("sk", "got")
        grown = state.df.join(pushed, F.col("id") == F.col("pid"), "left").select(
            "id",
            F.when(F.col("got").isNull(), F.col("sk")).otherwise(both).alias("sk"),
            (F.col("got").isNotNull() & (F.hll_sketch_estimate(both) > F.hll_sketch_estimate("sk"))).alias("grew"),
        )
        merged = cut(grown)
        state = Cut(merged.df.select("id", "sk"), merged.rows, merged.nbytes)
        changed = cut(merged.df.where("grew").select("id", "sk"))
    return state


def sketch_counts(links: DataFrame, lg_k: int, heads: Heads | None = None) -> DataFrame:
    """(id, downstream, upstream), estimated, of every end of a link that joins two nodes: rounds move sketches of the core alone."""
    h = heads or heads_of(links)
    core, inner = h.core.df.select("id"), h.inner.df
    sketch = lambda c: F.hll_sketch_agg(c, F.lit(lg_k))
    targets = h.targets.hinted().select(F.col("id").alias("dst"), "head", "inside")
    near = h.pairs.join(targets, "dst")
    # only what lies on a cycle may reach itself, and all of that is in the core: there a node counts itself, which is taken off again
    selves = core.select(F.col("id").alias("src"), F.col("id").alias("num"), F.lit(None).cast("string").alias("cls"), F.lit(1).alias("self"))
    behind = _spread_sketches(core.groupBy("id").agg(sketch("id").alias("sk")), inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    far = behind.hinted().select(F.col("id").alias("_id"), "sk")
    rows = near.select("src", F.col("dst").alias("num"), F.col("head").alias("cls"), F.lit(0).alias("self")).unionByName(selves)
    rows = _gathered(rows, ["self"], h.count).join(far, F.col("far") & (F.col("key") == F.col("_id")), "left")
    per = rows.groupBy(F.col("src").alias("id")).agg(
        sketch(F.when(~F.col("far"), F.col("key"))).alias("a"), F.hll_union_agg("sk").alias("b"), F.count("sk").alias("heads"), F.max("self").alias("self")
    )
    size = F.when(F.col("heads") == 0, F.hll_sketch_estimate("a")).otherwise(F.hll_sketch_estimate(F.hll_union("a", "b")))
    down = per.select("id", (size - F.coalesce("self", F.lit(0))).alias("downstream"), F.lit(0).cast("long").alias("upstream"))
    # sources of a target outside the core are also sources of its head
    keys = F.array("dst", F.when(~F.col("inside"), F.col("head")))
    direct = near.select("src", F.explode(keys).alias("id")).where("id IS NOT NULL").unionByName(core.select(F.col("id").alias("src"), "id"))
    met = cut(direct.groupBy("id").agg(sketch("src").alias("sk"))).df
    flagged = met.join(h.core.hinted().withColumn("_in", F.lit(1)), "id", "left")
    above = _spread_sketches(flagged.where("_in IS NOT NULL").select("id", "sk"), inner).df.select("id", "sk", F.lit(1).alias("self"))
    above = above.unionByName(flagged.where("_in IS NULL").select("id", "sk", F.lit(0).alias("self")))
    up = above.select("id", F.lit(0).cast("long").alias("downstream"), (F.hll_sketch_estimate("sk") - F.col("self")).alias("upstream"))
    return down.unionByName(up).groupBy("id").agg(F.sum("downstream").alias("downstream"), F.sum("upstream").alias("upstream"))
