"""Basic graph patterns as joins over a quads table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    """A triple pattern: terms that begin with ? are variables, all others constants. graph may be a variable, too."""

    s: str
    p: str
    o: str
    graph: str | None = None


def scan(quads: DataFrame, pattern: Pattern) -> DataFrame:
    """The bindings of one pattern: its constants are filters that reach the scan, its variables columns."""
    out, columns, seen = quads, [], {}
    for col, term in (("s", pattern.s), ("p", pattern.p), ("o", pattern.o), ("g", pattern.graph)):
        if term is None:
            continue
        if not term.startswith("?"):
            out = out.where(F.col(col) == term)
        elif term in seen:
            out = out.where(F.col(col) == F.col(seen[term]))
        else:
            seen[term] = col
            columns.append(F.col(col).alias(term[1:]))
            if col == "g":
                out = out.where(F.col("g").isNotNull())
    return out.select(*columns).distinct() if pattern.graph is None else out.select(*columns)


def _order(patterns: list[Pattern]) -> list[Pattern]:
    """Patterns with most constants first, each next one sharing a variable with what is joined already, if any does."""
    names = lambda p: {t for t in (p.s, p.p, p.o, p.graph) if t and t.startswith("?")}
    left, out, bound = list(patterns), [], set()
    while left:
        best = min(left, key=lambda p: (not (names(p) & bound) if bound else False, len(names(p) - bound)))
        left.remove(best)
        out.append(best)
        bound |= names(best)
    return out


def match(quads: DataFrame, patterns: list[Pattern], optional: list[list[Pattern]] = ()) -> DataFrame:
    """Bindings of all patterns together, and of each optional group where it matches.

    Joins are on shared variables. A group that shares nothing with the rest is
    refused: it would be a cross product.
    """
    out = None
    for pattern in _order(patterns):
        found = scan(quads, pattern)
        out = found if out is None else _join(out, found, "inner")
    for group in optional:
        out = _join(out, match(quads, list(group)), "left")
    return out


def _join(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    on = [c for c in a.columns if c in b.columns]
    if not on:
        raise ValueError("patterns share no variable")
    return a.join(b, on, how)


def star(quads: DataFrame, predicates: dict[str, str], required: list[str] = ()) -> DataFrame:
    """s and a column for each predicate (its smallest object): one grouping in place of a join for each."""
    found = quads.where(F.col("p").isin(*predicates.values())).groupBy("s").agg(*[F.min(F.when(F.col("p") == p, F.col("o"))).alias(name) for name, p in predicates.items()])
    for name in required:
        found = found.where(F.col(name).isNotNull())
    return found


def describe(quads: DataFrame, term: str) -> DataFrame:
    """All quads with term as subject or object."""
    return quads.where(F.col("s") == term).unionByName(quads.where((F.col("o") == term) & (F.col("s") != term)))
