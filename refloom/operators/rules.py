"""Policy rules evaluated to one violations table and a gate status.

A rule is a small dict {name, level, ...parameters}.  Checkers return lazy DataFrames of
(message, asset, src, dst, kind); only rules that are configured cost anything.  The sites behind an
edge violation are the long table ``sites`` so that a hot edge never becomes one huge row.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.functions.matching import match_nodes
from refloom.functions.scalar import human_size
from refloom.model import Graph
from refloom.operators.containers import container_duplication, container_edges, container_links
from refloom.operators.extract import component_names, site_selector
from refloom.operators.reports import dangling_report, unused_report, utilization
from refloom.operators.scc import cycle_members
from refloom.operators.traverse import forbidden_paths, path_names
from refloom.operators.validate import LEAK_NAME
from refloom.plans.runtime import cut, union_all

SCHEMA = "rule string, level string, message string, asset string, src string, dst string, kind string"

# Rules used when none are configured: health checks that never fail a gate.
DEFAULT_RULES = [{"name": "max-meta-errors", "level": "warn"}, {"name": "no-dangling-refs", "level": "warn"}]
# Properties an engine bakes itself; never a manual edit (fixed default).
BAKED_PROPS = ("lightmapSettings", "_shadowCastingMode", "_shadowReceivingMode")

Checker = Callable[[Graph, dict, "Context"], DataFrame]


@dataclass
class Context:
    """Inputs only some rules need; each may be a DataFrame or a function that makes one."""

    duplicates: dict | Callable | None = None  # axis -> annotated groups
    overrides: DataFrame | Callable | None = None
    leaks: DataFrame | Callable | None = None
    root_types: tuple = ()

    def get(self, name: str):
        v = getattr(self, name)
        return v() if callable(v) else v


@dataclass
class RuleResult:
    violations: DataFrame
    sites: DataFrame | None = None
    checked: list[str] = field(default_factory=list)

    def counts(self) -> dict[str, int]:
        got = {r["level"]: int(r["n"]) for r in self.violations.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
        return {lv: got.get(lv, 0) for lv in ("error", "warn", "config")}

    def gate(self) -> int:
        """0 passed, 1 errors, 2 configuration problems."""
        c = self.counts()
        return 2 if c["config"] else 1 if c["error"] else 0


def _list(v) -> list:
    return [] if v is None else list(v) if isinstance(v, (list, tuple, set)) else [v]


def _out(df: DataFrame, message, asset=None, src=None, dst=None, kind=None) -> DataFrame:
    opt = lambda c, n: (F.lit(None) if c is None else c).cast("string").alias(n)
    return df.select(message.alias("message"), opt(asset, "asset"), opt(src, "src"), opt(dst, "dst"), opt(kind, "kind"))


def _s(c):
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _nothing(g: Graph) -> DataFrame:
    return _out(g.nodes.where(F.lit(False)), F.col("id"))


def _meta_errors(g: Graph, rule: dict, ctx: Context) -> DataFrame:
    if g.parse_errors is None:
        return _nothing(g)
    limit = int(rule.get("max", 0))
    n = g.parse_errors.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    return _out(n, F.concat(_s("n"), F.lit(f" meta parse error(s) (max {limit})")))


def _dangling(g: Graph, rule: dict, ctx: Context) -> DataFrame:
    if g.dangling is None:
        return _nothing(g)
    r = dangling_report(g.dangling, g.missing)
    name = F.coalesce("path", "ref")
    return _out(r, F.concat(F.lit("dangling ref "), name, F.lit(" ("), _s("refs"), F.lit(" referrer(s))")), name)


def _orphans(g: Graph, rule: dict, ctx: Context) -> DataFrame:
    r = unused_report(g, ctx.root_types, _list(rule.get("type"))).where(~F.col("candidate"))
    return _out(r, F.concat(F.lit("unused "), "type", F.lit(" · "), "path"), F.col("path"))


def _container_cycle(g: Graph, rule: dict, ctx: Context) -> DataFrame:
    members = cycle_members(container_edges(g))
    # one row per cycle group; the text lists the containers of that group only
    names = members.groupBy("group").agg(F.array_join(F.array_sort(F.collect_set("member")), " ⇄ ").alias("names"))
    return _out(names, F.concat(F.lit("bundle cycle "), "names"))


def _duplication(g: Graph, rule: dict, ctx: Context) -> DataFrame:
    if g.containers is None:
        return _nothing(g)
    limit = int(rule.get("maxBytes", 0))
    t = container_duplication(g, g.containers).agg(F.coalesce(F.sum("wasted"), F.lit(0)).alias("wasted"), F.count(F.lit(1)).alias("n"))
    t = t.where(F.col("wasted") > limit)
    text = F.concat(F.lit("cross-bundle duplication "), human_size("wasted"), F.lit(" > "), human_size(F.lit(limit)), F.lit(" ("), _s("n"), F.lit(" asset(s))"))
    return _out(t, text)


def _duplicate_files(g: Graph, rule: dict, ctx: Context) -> DataFrame:
    groups = ctx.get("duplicates")
    axes = [a for a in (_list(rule.get("axis")) or ["files", "configs"]) if groups and a in groups]
    if not axes:
        return _nothing(g)
    parts = []
    for a in axes:
        text = F.concat(F.lit(f"duplicate {a}: "), _s(F.col("count") - 1), F.lit(" redundant copy(ies) of "), "canonical_path",
                        F.lit(" ("), human_size("reclaimable"), F.lit(")"))
        parts.append(_out(groups[a], text, F.col("canonical_path")))
    return union_all(parts)


def _forbid(g: Graph, rule: dict, ctx: Context) -> DataFrame:
    src, dst = rule.get("from"), rule.get("to")
    if not src and not dst:
        raise ValueError('forbid-dep needs a "from" and/or "to" matcher')
    if rule.get("transitive"):
        if not src or not dst:
            raise ValueError('forbid-dep transitive needs BOTH a "from" and a "to" matcher')
        paths = forbidden_paths(g, match_nodes(src), match_nodes(dst))
        named = path_names(paths, g.nodes)
        last = g.nodes.select(F.col("id").alias("target"), F.col("path").alias("target_path"))
        full = paths.join(named, "id").join(last, "target", "left")
        text = F.concat("path", F.lit(" ⇒ "), F.coalesce("target_path", "target"), F.lit(" (transitively, "), _s("hops"), F.lit(" hop(s): "), "names", F.lit(")"))
        return _out(full, text, F.col("path"))
    n = g.nodes.select("id", "path", "type", "container")
    f = n.where(match_nodes(src)).select(F.col("id").alias("src"), F.col("path").alias("src_path"))
    t = n.where(match_nodes(dst)).select(F.col("id").alias("dst"), F.col("path").alias("dst_path"))
    hits = g.edges.join(f, "src").join(t, "dst")
    text = F.concat("src_path", F.lit(" → "), "dst_path", F.lit(" ("), "kind", F.lit(")"))
    return _out(hits, text, F.col("src_path"), F.col("src"), F.col("dst"), F.col("kind"))


def _cross_container(g: Graph, rule: dict, ctx: Context) -> DataFrame:
    links = container_links(g)
    if rule.get("from"):
        links = links.where(F.col("src").isin(*_list(rule["from"])))
    if rule.get("to"):
        links = links.where(F.col("dst").isin(*_list(rule["to"])))
    text = F.concat("src", F.lit(" → "), "dst", F.lit(" ("), _s("refs"), F.lit(" cross-bundle ref(s))"), F.when(F.col("mutual"), F.lit(" ⇄")).otherwise(F.lit("")))
    return _out(links, text)


def _deep_override(g: Graph, rule: dict, ctx: Context) -> DataFrame:
    ov = ctx.get("overrides")
    if ov is None:
        return _nothing(g)
    files = rule.get("files")
    if files != "all":
        ov = ov.where(F.col("type").isin(*(_list(files) or ["prefab"])))
    # an empty list is a choice: nothing is ignored, or nothing allowed
    ignore = list(BAKED_PROPS) if rule.get("ignoreProps") is None else _list(rule["ignoreProps"])
    ov = ov.where(~F.col("prop").isin(*ignore))
    allowed = F.col("on_root")
    if rule.get("allowProps") is not None:
        allowed = allowed & F.col("prop").isin(*_list(rule["allowProps"]))
    ov = ov.where(~allowed)
    text = F.concat(F.lit('deep instance override: "'), "prop", F.lit('" on a node (localID '), F.array_join("local_id", "/"),
                    F.lit(') inside instance "'), F.coalesce("instance_path", "instance"), F.lit('"'))
    return _out(ov, text, F.col("file"))


def _leak(g: Graph, rule: dict, ctx: Context) -> DataFrame:
    leaks = ctx.get("leaks")
    if leaks is None:
        return _nothing(g)
    # one row a file; the text lists the leaked nodes of that file only
    per = leaks.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
    text = F.concat(F.lit("editor preview Canvas leaked into the file: "), "names", F.lit(f' — a "{LEAK_NAME}" node must never be saved (delete it, then re-save)'))
    return _out(per, text, F.col("file"))


def _min_util(g: Graph, rule: dict, ctx: Context) -> DataFrame:
    if g.sub_items is None or g.sub_usage is None:
        return _nothing(g)
    low = float(rule.get("min", 0.5))
    owners = g.sub_items.select("owner_id").distinct().join(g.nodes.select(F.col("id").alias("owner_id"), "path"), "owner_id")
    u = utilization(owners, g.sub_items, g.sub_usage).where(F.col("referenced") & ~F.col("whole_referenced") & (F.col("ratio") < low))
    text = F.concat("path", F.lit(" "), F.format_string("%.0f", F.col("ratio") * 100), F.lit(f"% < {low * 100:.0f}% ("), _s("used"), F.lit("/"), _s("total"), F.lit(")"))
    return _out(u, text, F.col("path"))


CHECKERS: dict[str, Checker] = {
    "max-meta-errors": _meta_errors,
    "no-dangling-refs": _dangling,
    "no-orphans": _orphans,
    "no-bundle-cycle": _container_cycle,
    "max-duplication": _duplication,
    "no-duplicate-files": _duplicate_files,
    "forbid-dep": _forbid,
    "no-cross-bundle": _cross_container,
    "no-deep-instance-override": _deep_override,
    "no-editor-preview-leak": _leak,
    "atlas-min-util": _min_util,
}


def _reason(e: Exception) -> str:
    """What went wrong: of an error in a task the last line of its Python traceback, of one in the JVM the first line."""
    text = str(e)
    lines = [line.strip() for line in text.splitlines() if line.strip()]
    told = [line for line in lines if re.match(r"\w+(Error|Exception): ", line)]
    return (told[-1] if "Traceback (most recent call last)" in text and told else lines[0]) if lines else type(e).__name__


def evaluate_rules(graph: Graph, rules=None, ctx: Context | None = None, extra: dict[str, Checker] | None = None) -> RuleResult:
    """Violations of every configured rule; a rule that cannot run is a ``config`` violation.

    Each rule's violations are written by a job of its own, so whatever fails in its checker, on the driver or in a task, is told
    of that rule alone and the others stand.
    """
    spark: SparkSession = graph.nodes.sparkSession
    ctx, extra = ctx or Context(), extra or {}
    parts, config, checked = [], [], []
    for rule in DEFAULT_RULES if rules is None else rules:
        name = rule.get("name") if isinstance(rule, dict) else None
        if not isinstance(name, str):
            config.append(("(invalid)", 'each rule needs a string "name"'))
            continue
        fn = CHECKERS.get(name) or extra.get(name)
        if fn is None:
            config.append((name, f'unknown rule "{name}" (known: {", ".join([*CHECKERS, *extra])})'))
            continue
        level = "warn" if rule.get("level") == "warn" else "error"
        try:
            found = fn(graph, rule, ctx).select(F.lit(name).alias("rule"), F.lit(level).alias("level"), "message", "asset", "src", "dst", "kind")
            parts.append(cut(found).df)
        except Exception as e:  # noqa: BLE001 - any failing checker becomes a config violation
            config.append((name, f'rule "{name}" failed: {_reason(e)}'))
            continue
        checked.append(name)
    bad = spark.createDataFrame([(n, "config", m, None, None, None, None) for n, m in config], SCHEMA)
    violations = union_all([*parts, bad])
    sites = None
    if graph.sites is not None:
        edges = violations.where(F.col("src").isNotNull()).select("rule", "src", "dst", "kind")
        named = site_selector(component_names(graph.sites, graph.nodes)).where(F.col("selector").isNotNull())
        sites = named.join(edges, ["src", "dst", "kind"]).select("rule", "src", "dst", "kind", F.col("selector").alias("location")).distinct()
    return RuleResult(violations, sites, checked)
