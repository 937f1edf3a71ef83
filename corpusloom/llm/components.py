"""Connected components of a link table, by contraction on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def _doubled(parents: DataFrame) -> DataFrame:
    """(id, parent, before): each parent replaced by its parent."""
    above = parents.select(F.col("id").alias("parent"), F.col("parent").alias("grand"))
    return parents.select("id", "parent").join(above, "parent").select("id", F.col("grand").alias("parent"), F.col("parent").alias("before"))


def roots(parents: DataFrame) -> tuple[DataFrame, int]:
    """(id, parent) with every parent followed to its end, and the number of steps; no chain of parents is a circle.

    Each step doubles the way twice; where the second doubling moves nobody, all are at their ends.
    """
    steps = 0
    while True:
        twice = _doubled(_doubled(parents)).select("id", "parent", (F.col("parent") != F.col("before")).alias("moved"))
        parents = stored(twice, "cc-jump")
        steps += 1
        if parents.filter("moved").isEmpty():
            return parents.select("id", "parent"), steps
        parents = parents.select("id", "parent")


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (columns a, b); component is the smallest id reachable.

    Each round hooks every node to its smallest neighbour, where that is smaller,
    follows the parents to their roots and contracts: ends are replaced by their
    roots and loops go.  Every node that is left with a link hooks or is hooked to,
    so a round at least halves them, and parents are followed by doubling: chains
    take a logarithmic number of steps.  All steps are joins and partial
    aggregations of narrow rows, and each one's table is written, so a lost
    executor repeats no step.
    """
    return _components(links)[0]


def extended(part: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) of ``part``, the components of earlier links, after ``links``; ids may be new.

    Ends are replaced by their components, so only links between different ones
    are followed.
    """
    at = lambda c, to: part.select(F.col("id").alias(c), F.col("component").alias(to))
    between = links.join(at("a", "pa"), "a", "left").join(at("b", "pb"), "b", "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
    moved, rounds, _ = _components(between)
    if not rounds:
        return part
    to = moved.select(F.col("id").alias("component"), F.col("component").alias("to"))
    known = part.join(to, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return stored(known.unionByName(moved.join(part.select("id"), "id", "left_anti").select("id", "component")), "cc-map")


def _components(links: DataFrame) -> tuple[DataFrame, int, int]:
    """The components, the number of rounds, and of doubling steps in all rounds."""
    ends = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "cc-edges")
    mapped, rounds, steps = None, 0, 0
    while not edges.isEmpty():
        hook = stored(ends(edges).groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("parent")), "cc-hook")
        root, taken = roots(hook)
        rounds, steps = rounds + 1, steps + taken
        at = lambda c, to: root.select(F.col("id").alias(c), F.col("parent").alias(to))  # noqa: E731,B023
        edges = stored(
            edges.join(at("a", "pa"), "a").join(at("b", "pb"), "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).filter("a < b").distinct(),
            "cc-edges",
        )
        if mapped is None:
            mapped = root.withColumnRenamed("parent", "component")
        else:
            moved = mapped.join(at("component", "to"), "component", "left")
            mapped = stored(moved.select("id", F.coalesce("to", "component").alias("component")), "cc-map")
    return (mapped if mapped is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("component"))), rounds, steps
