"""Page queries: filters, sort orders with unique tie-breaks, exact totals."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LIMIT = 200


def contains_ascii(c: Column, part: str) -> Column:
    """Substring match that folds A-Z only, as LIKE does in SQLite."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(c, upper, lower).contains(part.translate(str.maketrans(upper, lower)))


def has_token(c: Column, wanted: str, by: str = " ") -> Column:
    """The list holds ``wanted`` or an item below it (``wanted.x``)."""
    return F.exists(F.split(c, by), lambda t: (t == wanted) | t.startswith(f"{wanted}."))


def in_list(c: Column, wanted: str) -> Column:
    """Membership in a list by commas or semicolons, spaces and case ignored."""
    return F.array_contains(F.split(F.regexp_replace(F.lower(c), " ", ""), "[,;]"), wanted.lower())


def in_year(c: Column, year: int) -> Column:
    return c.cast("string").startswith(f"{year}-")


def pending(status: Column, force: bool = False, retry_no_body: bool = False) -> Column:
    """Rows still to be fetched: all if forced, else the dead ones on request, else new ones and retries."""
    if force:
        return F.lit(True)
    if retry_no_body:
        return status.eqNullSafe("no_body")
    return status.isNull() | (status == "retry")


def fetched(body: Column, error: Column) -> Column:
    """Status of a row after a fetch: error, missing (no body came) or fetched."""
    return F.when(F.length(F.trim(F.coalesce(body, F.lit("")))) == 0, "missing").when(error.isNotNull(), "error").otherwise("fetched")


def after(df: DataFrame, columns: Sequence[str], done: Sequence) -> DataFrame:
    """Rows that come after the last one done, by several columns in order; all where nothing is done (None)."""
    if not done or done[0] is None:
        return df
    later, same = F.lit(False), F.lit(True)
    for c, v in zip(columns, done):
        later, same = later | (same & (F.col(c) > v)), same & (F.col(c) == v)
    return df.filter(later)


def at_most_pages(chars: Column, pages: int, chars_per_page: int = 2_000) -> Column:
    """Whether a text is no longer than so many pages."""
    return chars <= pages * chars_per_page


def is_status(status: Column, wanted: str, yes: bool = True) -> Column:
    same = status.eqNullSafe(wanted)
    return same if yes else ~same


def embedded(df: DataFrame, done: DataFrame, key: str, yes: bool | None) -> DataFrame:
    """Rows whose key is (or isn't) among ``done``; None: no filter.  A semi or anti join, whatever the size."""
    if yes is None:
        return df
    return df.join(done.select(key).distinct(), key, "left_semi" if yes else "left_anti")


def where(df: DataFrame, *clauses: Column | None) -> DataFrame:
    """All clauses that are given."""
    given = [c for c in clauses if c is not None]
    return df.filter(reduce(lambda a, b: a & b, given)) if given else df


def equals(c: Column, value) -> Column | None:
    return None if value is None else c == value


def between(c: Column, low=None, high=None) -> Column | None:
    parts = [x for x in (None if low is None else c >= low, None if high is None else c <= high) if x is not None]
    return reduce(lambda a, b: a & b, parts) if parts else None


def any_of(c: Column, values: Sequence) -> Column | None:
    return c.isin(*values) if values else None


def check_id(value: str, pattern: str) -> str:
    """The value, if all of it has the form of its source's ids."""
    if not re.fullmatch(pattern, value):
        raise ValueError(f"{value!r} is no id of this kind")
    return value


def check_page(limit: int, offset: int, sort: str, orders: Mapping, q: str | None = None, most: int = MAX_LIMIT) -> None:
    """ValueError where a page can't be asked for like this; ``most`` is the route's own bound."""
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be 1 to {most}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    if sort not in orders:
        raise ValueError(f"sort must be one of {', '.join(orders)}")
    if sort == "relevance" and not q:
        raise ValueError("sort=relevance needs q")


def page(df: DataFrame, order: Sequence[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in a unique order, with the exact ``total`` of the filtered rows.

    The total is one aggregated row, joined by broadcast; the rows are a top-k,
    so nothing is sorted as a whole.  An empty page has no row to carry a total:
    use :func:`total`.
    """
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total(df)))


#: A deep page cuts its range by so many bounds at a time, until it has at most so many rows.
CUTS, RANGE_ROWS = 64, 200_000


def _below(order: Sequence[tuple[str, bool]], row) -> Column:
    """Whether a row comes before ``row`` in the order; null is the smallest value."""
    out = F.lit(False)
    for name, rising in reversed(order):
        c, v = F.col(name), row[name]
        if v is None:
            first = F.lit(False) if rising else c.isNotNull()
        else:
            first = c.isNull() | (c < F.lit(v)) if rising else c > F.lit(v)
        out = F.coalesce(first, F.lit(False)) | (c.eqNullSafe(F.lit(v)) & out)
    return out


def deep_page(df: DataFrame, order: Sequence[tuple[str, bool]], limit: int, offset: int) -> DataFrame:
    """The page that :func:`page` gives, for any offset: only the range of rows that holds it is sorted.

    ``order`` names columns, each rising or not, that tell all rows apart; nulls come
    first if rising and last if not.  Bounds drawn from a sample cut the rows into
    ranges, a scan counts them, and the page lies in one or a few; a range that is
    still large is cut again.  The sample decides how many rows are sorted, never
    which rows are returned.
    """
    names = [n for n, _ in order]
    key = [F.col(n).asc_nulls_first() if rising else F.col(n).desc_nulls_last() for n, rising in order]
    rows, skip, every = df, offset, None
    while True:
        n = rows.count()
        every = n if every is None else every
        if n <= RANGE_ROWS or skip >= n:
            break
        picked = rows.select(*names).sample(min(1.0, 32 * CUTS / n), seed=7).orderBy(*key).limit(64 * CUTS).collect()
        bounds = [picked[len(picked) * i // CUTS] for i in range(1, CUTS)] if len(picked) >= CUTS else picked
        at = reduce(lambda a, b: a + b, (F.when(_below(order, b), 0).otherwise(1) for b in bounds), F.lit(0))
        counts = {r.at: r.n for r in rows.groupBy(at.alias("at")).agg(F.count("*").alias("n")).collect()}  # at most CUTS rows
        low, before = 0, 0
        while before + counts.get(low, 0) <= skip:
            before, low = before + counts.get(low, 0), low + 1
        high, upto = low, before + counts.get(low, 0)
        while upto < min(n, skip + limit):
            high, upto = high + 1, upto + counts.get(high + 1, 0)
        if upto - before == n:
            break  # the bounds didn't tell these rows apart
        some = F.lit(True)
        if low > 0:
            some = some & ~_below(order, bounds[low - 1]) & _from(order[0], bounds[low - 1], True)
        if high < len(bounds):
            some = some & _below(order, bounds[high]) & _from(order[0], bounds[high], False)
        rows, skip = rows.filter(some), skip - before
    return rows.orderBy(*key).offset(skip).limit(limit).withColumn("total", F.lit(every).cast("long"))


def _from(first: tuple[str, bool], row, after: bool) -> Column:
    """What the first column must be at least, or at most: a condition that reaches the scan."""
    name, rising = first
    if row[name] is None:
        return F.lit(True)
    if rising == after:
        return F.col(name) >= F.lit(row[name])
    return F.col(name).isNull() | (F.col(name) <= F.lit(row[name]))


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def point(df: DataFrame, key: str, value) -> DataFrame:
    """The row with this key; KeyError if there is none."""
    found = df.filter(F.col(key) == value)
    if found.isEmpty():
        raise KeyError(value)
    return found
