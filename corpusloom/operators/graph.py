"""Redirect chains, category trees and taxonomies as joins that double the way they look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

MAX_HOPS = 10


def capitalised(title: Column) -> Column:
    return F.concat(F.upper(F.substring(title, 1, 1)), F.substring(title, 2, 2**31 - 1))


def resolve_titles(wanted: DataFrame, pages: DataFrame, name: str, key: str = "page_id", title: str = "title") -> DataFrame:
    """``wanted`` with the page whose title its column ``name`` gives, exactly or else with its first letter upper-case; null if none."""
    known = pages.groupBy(F.col(title).alias("known title")).agg(F.min(key).alias("found"))
    exact = known.select(F.col("known title").alias("exact title"), F.col("found").alias("exact"))
    other = known.select(F.col("known title").alias("other title"), F.col("found").alias("other"))
    joined = wanted.join(exact, F.col(name) == F.col("exact title"), "left").join(other, capitalised(F.col(name)) == F.col("other title"), "left")
    return joined.select(*wanted.columns, F.coalesce("exact", "other").alias(key if key not in wanted.columns else "resolved"))


def _then(first: DataFrame, second: DataFrame) -> DataFrame:
    """Links (id, at) followed by those of ``second``; where ``at`` is no link's id the way ends there."""
    more = second.select(F.col("id").alias("from"), F.col("at").alias("to"))
    return first.join(more, first["at"] == more["from"], "left").select("id", F.when(F.col("from").isNotNull(), F.col("to")).otherwise(F.col("at")).alias("at"))


def resolve_redirects(pages: DataFrame, key: str = "page_id", title: str = "title", target: str = "target", hops: int = MAX_HOPS) -> DataFrame:
    """(key, resolved): the page at the end of each page's redirects.

    ``target`` is the title a page redirects to, null for a real page.  Titles
    match exactly, else with their first letter upper-case.  Null for real
    pages, cycles, broken targets and chains of more than ``hops``.

    The ways of 1, 2, 4, .. hops are joined with themselves, and those that make
    up ``hops`` with each other: a real page is where a way ends, so whoever is
    still at a redirect after ``hops`` is on a cycle or too long a chain.
    """
    redirects = pages.filter(F.col(target).isNotNull()).select(F.col(key).alias("id"), F.col(target).alias("wanted"))
    power = written(resolve_titles(redirects, pages, "wanted", key, title).select("id", F.col(key).alias("at")), "redirects-1")
    links, way, left = power.select("id"), None, hops
    while left:
        if left & 1:
            way = power if way is None else written(_then(way, power), "redirects-way")
        left >>= 1
        if left:
            power = written(_then(power, power), "redirects-power")
    open_ = links.select(F.col("id").alias("open"))
    ends = way.join(open_, way["at"] == open_["open"], "left").filter("open IS NULL").select(F.col("id").alias(key), F.col("at").alias("resolved"))
    return pages.select(key).join(ends, key, "left")


def tree_closure(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """(ancestor, key, depth) for every node and each of its ancestors, itself at depth 0.

    Every round doubles the depth that is covered, so a tree of depth d takes
    log d rounds; parents that form a circle raise ValueError.
    """
    far = written(nodes.filter(F.col(parent).isNotNull()).select(F.col(key).alias("id"), F.col(parent).alias("top")), "closure-far")
    near = nodes.select(F.col(key).alias("ancestor"), F.col(key).alias("id"), F.lit(0).alias("depth"))
    reach, most = 1, nodes.count()
    while not far.isEmpty():
        if reach > most:
            raise ValueError(f"the {parent} columns form a circle")
        # All within reach of the node that lies ``reach`` above.
        upper = far.select(F.col("id").alias("of"), "top").join(near, F.col("top") == near["id"]).select("ancestor", F.col("of").alias("id"), (F.col("depth") + reach).alias("depth"))
        near = written(near.unionByName(upper), "closure-near")
        above = far.select(F.col("id").alias("mid"), F.col("top").alias("higher"))
        far = written(far.join(above, F.col("top") == F.col("mid")).select("id", F.col("higher").alias("top")), "closure-far")
        reach *= 2
    return near.select("ancestor", F.col("id").alias(key), "depth")


def taxonomy(codes: DataFrame, code: str) -> DataFrame:
    """(parent, children): groups of dotted codes (``math.CO``), and codes without a dot as parents of their own, which may have no child.

    ``children``: the distinct codes below a parent, in order.
    """
    head = F.substring_index(code, ".", 1)
    below = F.when(F.col(code).contains("."), F.col(code))
    return codes.filter(F.col(code).isNotNull()).groupBy(head.alias("parent")).agg(F.array_sort(F.collect_set(below)).alias("children"))
