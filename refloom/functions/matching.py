"""The matcher specification compiled to one Column."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from refloom.functions.scalar import base

FIELDS = {"type", "container", "pathStartsWith", "pathContains", "basename", "pathRegex", "basenameRegex", "not"}


class MatchError(ValueError):
    """A matcher that cannot be used (bad pattern, unknown field)."""


def _list(v) -> list:
    return [] if v is None else list(v) if isinstance(v, (list, tuple, set)) else [v]


def _any(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def match_nodes(spec: dict | None, path="path", type_="type", container="container") -> Column:
    """All listed fields must hold (each scalar or list = any of); an absent spec matches everything."""
    if not spec:
        return F.lit(True)
    unknown = set(spec) - FIELDS
    if unknown:
        raise MatchError(f"unknown matcher field(s): {', '.join(sorted(unknown))}")
    p, conds = F.col(path), []
    if spec.get("type"):
        conds.append(F.col(type_).isin(*_list(spec["type"])))
    if spec.get("container"):
        conds.append(F.col(container).isin(*_list(spec["container"])))
    if spec.get("pathStartsWith"):
        conds.append(_any([p.startswith(x) for x in _list(spec["pathStartsWith"])]))
    if spec.get("pathContains"):
        conds.append(_any([p.contains(x) for x in _list(spec["pathContains"])]))
    if spec.get("basename"):
        conds.append(base(p).isin(*_list(spec["basename"])))
    for name, target in (("pathRegex", p), ("basenameRegex", base(p))):
        if spec.get(name):
            for pattern in _list(spec[name]):
                try:
                    re.compile(pattern)
                except re.error as e:
                    raise MatchError(f"bad pattern {pattern!r}: {e}") from e
            conds.append(_any([target.rlike(x) for x in _list(spec[name])]))
    if spec.get("not"):
        conds.append(~match_nodes(spec["not"], path, type_, container))
    out = reduce(lambda a, b: a & b, conds) if conds else F.lit(True)
    return F.coalesce(out, F.lit(False))
