"""List routes as one call: free-text search, filters, membership, sort order and exact total together."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import listing


def list_page(
    rows: DataFrame, key: str, orders: Mapping[str, Sequence[Column]], default: str, q: str | None = None, matches: Callable[[str], DataFrame] | None = None, clauses: Sequence[Column | None] = (),
    done: DataFrame | None = None, embedded: bool | None = None, sort: str | None = None, limit: int = 50, offset: int = 0,
) -> DataFrame:
    """One page of ``rows`` that meet all ``clauses``, with the exact ``total``.

    ``q`` keeps the rows that ``matches`` finds for it, with their ``score``: (key,
    score) of all rows with its words, as :meth:`TextIndex.matches` gives.  They are
    written once; page and total are both taken from them.
    ``embedded`` keeps rows that are (or aren't) in ``done``.  Without ``sort`` a
    search is sorted by relevance and a list by ``default``; ties are broken by key.
    """
    sort = sort or ("relevance" if q else default)
    listing.check_page(limit, offset, sort, {**orders, "relevance": ()}, q)
    chosen = listing.where(rows, *clauses)
    if embedded is not None:
        chosen = listing.embedded(chosen, done, key, embedded)
    if q:
        chosen = chosen.join(written(matches(q), "route-hits"), key)
    order = [F.col("score")] if sort == "relevance" else list(orders[sort])
    return listing.page(chosen, [*order, F.col(key)], limit, offset)


def all_forms(lookup: DataFrame, forms: Sequence[str], wanted: Sequence[str]) -> DataFrame:
    """(form): every form of the entries that have one of the ``wanted`` forms in any of the columns ``forms``."""
    each = F.array_distinct(F.filter(F.array(*(F.col(c).cast("string") for c in forms)), lambda x: x.isNotNull()))
    return lookup.select(each.alias("all")).filter(F.arrays_overlap("all", F.array(*(F.lit(w) for w in wanted)))).select(F.explode("all").alias("form")).distinct()


def health(parts: DataFrame, name: str, status: str) -> DataFrame:
    """One row: whether all parts are ok, how many aren't, and their names in order."""
    bad = F.col(status).isNull() | (F.col(status) != "ok")
    return parts.agg(F.coalesce(F.every(~bad), F.lit(True)).alias("healthy"), F.count(F.when(bad, 1)).alias("failing"), F.array_join(F.array_sort(F.collect_set(F.when(bad, F.col(name)))), ",").alias("names"))
