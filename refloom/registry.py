"""Extension points: extractors, types, reports, rule checkers, annotations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.model import Graph
from refloom.operators.rules import CHECKERS
from refloom.plans.runtime import cut, union_all


@dataclass
class Extraction:
    """What an extractor may emit; every part is optional."""

    edges: DataFrame | None = None  # src, dst, kind[, label]
    nodes: DataFrame | None = None  # type, path of synthetic nodes
    sub_usage: DataFrame | None = None
    dangling: DataFrame | None = None


@dataclass
class Registry:
    extractors: dict[str, Callable] = field(default_factory=dict)
    reports: dict[str, Callable] = field(default_factory=dict)
    checkers: dict[str, Callable] = field(default_factory=dict)
    importer_types: dict[str, str] = field(default_factory=dict)
    ext_types: dict[str, str] = field(default_factory=dict)
    root_types: set[str] = field(default_factory=set)
    walked_exts: set[str] = field(default_factory=set)

    def extractor(self, name: str):
        return lambda fn: self.extractors.setdefault(name, fn)

    def report(self, name: str):
        return lambda fn: self.reports.setdefault(name, fn)

    def checker(self, name: str):
        """Built-in checkers and earlier registrations win on a name collision."""

        def add(fn):
            if name not in CHECKERS:
                self.checkers.setdefault(name, fn)
            return fn

        return add

    def register_types(self, importer=None, ext=None, root_types=(), walked_exts=()) -> None:
        self.importer_types.update(importer or {})
        self.ext_types.update(ext or {})
        self.root_types.update(root_types)
        self.walked_exts.update(walked_exts)

    def type_table(self, spark: SparkSession) -> DataFrame:
        """(by, key, type) rows that override the built-in type table."""
        rows = [("importer", k, v) for k, v in self.importer_types.items()] + [("ext", k, v) for k, v in self.ext_types.items()]
        return spark.createDataFrame(rows, "by string, key string, type string")

    def run_report(self, name: str, graph: Graph, **args) -> DataFrame:
        if name not in self.reports:
            raise KeyError(f"unknown report {name!r} (known: {', '.join(sorted(self.reports))})")
        return self.reports[name](graph, **args)

    def run_extractors(self, project) -> tuple[list[Extraction], DataFrame]:
        """Run every extractor; one that fails loses only its own output and leaves an error row."""
        spark: SparkSession = project.nodes.sparkSession
        done, errors = [], []
        for name, fn in self.extractors.items():
            try:
                got = fn(project)
                got = got if isinstance(got, Extraction) else Extraction(edges=got)
                # forced here so that a failing task is caught with the extractor that owns it
                done.append(Extraction(**{k: (None if v is None else cut(v).df) for k, v in vars(got).items()}))
            except Exception as e:  # noqa: BLE001
                errors.append((name, str(e) or type(e).__name__))
        return done, spark.createDataFrame(errors, "name string, error string")


def merge_extractions(graph: Graph, parts: list[Extraction]) -> Graph:
    """A graph with the extractors' nodes, links, usage and dangling references added."""
    from refloom.model import edges_from_links
    from refloom.operators.extractors import add_virtual_nodes

    nodes = graph.nodes
    for p in parts:
        if p.nodes is not None:
            nodes = add_virtual_nodes(nodes, p.nodes)
    links = union_all([graph.adjacency] + [p.edges.select("src", "dst", "kind") for p in parts if p.edges is not None])
    join = lambda base, name: [d for d in [base, *[getattr(p, name) for p in parts]] if d is not None]
    usage, dangling = join(graph.sub_usage, "sub_usage"), join(graph.dangling, "dangling")
    edges = edges_from_links(links).drop("label")
    labels = [e.select("src", "dst", "kind", "label") for e in [graph.edges, *[p.edges for p in parts if p.edges is not None]] if "label" in e.columns]
    # of several labels of one edge the smallest stays
    named = union_all(labels).where("label IS NOT NULL").groupBy("src", "dst", "kind").agg(F.min("label").alias("label"))
    return graph.with_(
        nodes=nodes, links=links, edges=edges.join(named, ["src", "dst", "kind"], "left").select("src", "dst", "kind", "weight", "label"),
        sub_usage=union_all(usage) if usage else None,
        # the sites of unresolved references stay with them
        dangling=reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dangling) if dangling else None,
    )


def annotate(nodes: DataFrame, match, rows_fn: Callable, schema: str) -> DataFrame:
    """Extra rows per matching record, produced partition-wise by a pandas function."""
    return nodes.where(match).mapInPandas(rows_fn, schema)


def labelled(nodes: DataFrame, match, label) -> DataFrame:
    """Annotation rows that an expression can write: (id, path, label)."""
    return nodes.where(match).select("id", "path", label.alias("label"))


