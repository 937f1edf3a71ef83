"""Conversation structure repair: error-correcting Earley parsing of a conversation's roles.

The grammar's productions are left-linear: a nonterminal stands only at the left
end of a body.  Every item of a chart then begins at the conversation's first row,
so an item is a dotted production, a chart set is bounded, and a parse can be cut:
a segment of rows is parsed from each item that may lie before it, and segments of
one conversation are joined like links of a chain.  Items keep the least
(cost, audit); the audit tells the edits, from which the repaired turns are read.

A conversation may hold most of a table's rows: narrow rows are dealt out by range,
segments are bounded, and only the repaired texts pass one task in a stream, as
whoever reads a conversation in order must.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Productions (head, body): s, u and a are rows of that initial, upper case are nonterminals; a whole parse is a C.
GRAMMAR = (("C", ""), ("C", "P"), ("P", "ua"), ("P", "sua"), ("P", "Pua"))
#: Costs of the error productions, and what a truncated row costs besides if it stays.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: Roles that rows may get, by initial.
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
#: Narrow rows in a segment, a power of two.
SEGMENT = 4096
SPACES = " \t\n\x0b\x0c\r"

Item = tuple[int, int]
Chart = dict[Item, tuple[int, str]]
#: Before the first row: every production is predicted.
START: Item = (-1, 0)
ITEMS = (START, *((p, dot) for p, (_, body) in enumerate(GRAMMAR) for dot in range(len(body) + 1)))


def _offer(chart: Chart, item: Item, cost: int, audit: str) -> bool:
    better = item not in chart or (cost, audit) < chart[item]
    if better:
        chart[item] = (cost, audit)
    return better


def _next(item: Item) -> str:
    """The symbol after the dot, or an empty string."""
    return GRAMMAR[item[0]][1][item[1] : item[1] + 1] if item != START else ""


def _close(chart: Chart) -> Chart:
    """Predict, complete and insert until no item gets better."""
    todo = list(chart)
    while todo:
        item = todo.pop()
        cost, audit = chart[item]
        if item == START:
            found = [((p, 0), cost, audit) for p in range(len(GRAMMAR))]
        elif symbol := _next(item):
            found = [((item[0], item[1] + 1), cost + INSERT, audit + "I")] if symbol in ROLES else []
        else:
            found = [((p, 1), cost, audit) for p, (_, body) in enumerate(GRAMMAR) if body[:1] == GRAMMAR[item[0]][0]]
        todo += [f[0] for f in found if _offer(chart, *f)]
    return chart


def parse(rows: str, entry: Item = START) -> Chart:
    """The chart set after ``rows`` from ``entry``: items with their least (cost, audit).

    A row is its role's initial (``o``: any other), upper case if truncated, or x
    where it must be deleted.  The audit has the edits' initials (Keep, Rerole,
    Delete, Insert) in order.  Of equal costs the ASCII-least audit stays; that
    holds after more rows too, as of two audits of the same rows and cost none
    begins with the other.
    """
    chart = _close({entry: (0, "")})
    for part in re.findall("x+|[^x]", rows):
        after: Chart = {}
        for item, (cost, audit) in chart.items():
            _offer(after, item, cost + DELETE * len(part), audit + "D" * len(part))
            symbol, row = _next(item), part.lower()
            if symbol.islower() and row != "x" * len(part):
                stays = cost + (TRUNCATED if part != row else 0)
                if row == symbol:
                    _offer(after, (item[0], item[1] + 1), stays, audit + "K")
                elif symbol in ROLES:
                    _offer(after, (item[0], item[1] + 1), stays + REROLE, audit + "R")
        chart = _close(after)
    return chart


@lru_cache(1 << 14)
def _links(rows: str, entries: tuple[Item, ...]) -> list[tuple[int, int, int, str]]:
    """(entry, exit, cost, audit) of a segment, items by their place in ITEMS."""
    return [(ITEMS.index(e), ITEMS.index(x), *best) for e in entries for x, best in parse(rows, e).items()]


def _joined(left: list, right: list) -> list:
    """The links of two segments in a row."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    onward: dict[int, list] = {}
    for e, x, cost, audit in right:
        onward.setdefault(e, []).append((x, cost, audit))
    for e, m, cost, audit in left:
        for x, more, rest in onward.get(m, ()):
            _offer(best, (e, x), cost + more, audit + rest)
    return [(e, x, *b) for (e, x), b in best.items()]


def least(links: list) -> tuple[int, str]:
    """(cost, audit) of the cheapest whole parse."""
    whole = [(cost, audit) for e, x, cost, audit in links if ITEMS[e] == START and (item := ITEMS[x]) != START and GRAMMAR[item[0]][0] == "C" and not _next(item)]
    return min(whole)


# ---- segments -----------------------------------------------------------------------------------

_LINK = "struct<entry: int, exit: int, cost: long, audit: string>"
_PART = f"first string, last string, illegal long, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, links array<{_LINK}>"
_PARTS = pa.schema(
    [("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64())]
    + [("links", pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))]
)


def _illegal(initials: str) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def _out(batch: pa.RecordBatch, keys: list[str], parts: list[dict]) -> pa.RecordBatch:
    for p in parts:
        p["links"] = [dict(zip(("entry", "exit", "cost", "audit"), x)) for x in p["links"]]
    table = pa.RecordBatch.from_pylist(parts, schema=_PARTS)
    return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *table.columns], names=[*keys, *_PARTS.names])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments: from their rows' symbols to links; only one that may go on a conversation is parsed from every item."""
    for batch in batches:
        parts = []
        for row in batch.select(["symbols", "initials", "begins", "turn_list", "blank", "duplicate", "truncated"]).to_pylist():
            turns = [t for t in row["turn_list"] if t is not None]
            links = _links(row["symbols"], (START,) if row["begins"] else ITEMS)
            head = {"first": row["initials"][:1], "last": row["initials"][-1:], "illegal": _illegal(row["initials"]), "links": links}
            span = {"first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "turns": len(set(turns))}
            parts.append(head | span | {k: row[k] for k in ("blank", "duplicate", "truncated")})
        yield _out(batch, ["conv_id", "block"], parts)


def _together(keys: list[str]):
    """Consecutive segments, as a list in order, into one."""

    def two(a: dict, b: dict) -> dict:
        turns = a["turns"] + b["turns"] - (a["last_turn"] is not None and a["last_turn"] == b["first_turn"])
        seen = lambda k, x, y: x[k] if x[k] is not None else y[k]
        return {
            "first": a["first"], "last": b["last"], "illegal": a["illegal"] + b["illegal"] + (a["last"] + b["first"] not in LEGAL), "links": _joined(a["links"], b["links"]),
            "first_turn": seen("first_turn", a, b), "last_turn": seen("last_turn", b, a), "turns": turns, **{k: a[k] + b[k] for k in ("blank", "duplicate", "truncated")},
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alone = pc.equal(pc.list_value_length(batch.column("parts")), 1)
            whole, batch = batch.filter(alone), batch.filter(pc.invert(alone))
            if len(whole):
                made = whole.column("parts").flatten()
                yield pa.RecordBatch.from_arrays([*(whole.column(k) for k in keys), *(made.field(n) for n in _PARTS.names)], names=[*keys, *_PARTS.names])
            if not len(batch):
                continue
            parts = []
            for row in batch.column("parts"):
                chain = [p | {"links": [tuple(x.values()) for x in p["links"]]} for p in row.as_py()]
                while len(chain) > 1:  # by halves, so that a long audit is copied a logarithmic number of times
                    chain = [two(*chain[i : i + 2]) if i + 1 < len(chain) else chain[i] for i in range(0, len(chain), 2)]
                parts.append({k: chain[0][k] for k in _PARTS.names})
            yield _out(batch, keys, parts)

    return run


def _on(rows: DataFrame, others: DataFrame, columns: list[str], how: str) -> DataFrame:
    """A join on columns of the same names, nulls being equal; the others' go."""
    on = F.lit(True)
    for c in columns:
        others = others.withColumnRenamed(c, f"other {c}")
        on = on & F.col(c).eqNullSafe(F.col(f"other {c}"))
    return rows.join(others, on, how).drop(*(f"other {c}" for c in columns))


def turns_of(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", times: Column | None = None) -> DataFrame:
    """conv_id, turn, role, text, times: nulls of role and text are one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"), (F.lit(1) if times is None else times).cast("long").alias("times"))


def _placed(turns: DataFrame) -> DataFrame:
    """One narrow row per different (conv_id, turn, role, text), ``place`` rising in their order; texts are hashes."""
    body = F.rtrim("text", F.lit(SPACES))
    ended = F.right(body, F.lit(1)).isin(".", "!", "?")
    fault = F.when(body == "", "blank").when(~ended, "truncated").otherwise("none")
    told = turns.withColumn("hash", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    narrow = stored(told.groupBy("conv_id", "turn", "role", "hash").agg(F.sum("times").alias("times"), F.first(fault).alias("fault")), "repair-rows")
    by = ["conv_id", "turn", "role"]
    # Texts are only sorted where turn and role are equal.
    tied = stored(narrow.groupBy(*by).count().filter("count > 1").select(*by), "repair-ties")
    if tied.isEmpty():
        narrow = narrow.withColumn("tie", F.lit(None).cast("string"))
    else:
        texts = _on(told, tied, by, "left_semi").groupBy(*by, "hash").agg(F.first("text").alias("tie"))
        narrow = _on(narrow, texts, [*by, "hash"], "left")
    order = [F.col(c).asc_nulls_first() for c in (*by, "tie")]
    placed = narrow.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    return stored(placed.drop("tie"), "repair-places")


def audits(turns: DataFrame) -> DataFrame:
    """Per conversation of :func:`turns_of`: gaps, blank, duplicate, truncated, illegal, cost and audit.

    Rows are taken by turn (null first), role and text.  A row's first fault counts:
    blank, duplicate (role and text seen earlier), truncated (no ``.!?`` at its end).
    ``illegal`` counts neighbours whose initials aren't su, ua or au; an empty role
    has no initial and fits nowhere.  ``gaps`` are the whole numbers between the
    least and the greatest turn that are no turn; without any turn 0.
    """
    placed = _placed(turns)
    key = ["conv_id", "role", "hash"]
    seen = placed.groupBy(*key).agg(F.min("place").alias("seen"), F.count("*").alias("n")).filter("n > 1")
    marked = _on(placed, seen, key, "left").withColumn("again", F.col("seen") < F.col("place"))
    again, blank = F.coalesce("again", F.lit(False)), F.col("fault") == "blank"
    initial = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("o")
    first = F.when(blank | again, "x").when(F.col("fault") == "truncated", F.upper(initial)).otherwise(initial)
    more = (F.col("times") - 1).cast("int")
    copies = F.col("times").cast("int")
    row = F.struct("place", F.concat(first, F.repeat(F.lit("x"), more)).alias("symbols"), F.repeat(initial, copies).alias("initials"), "turn")
    of = lambda c, n: F.sum(F.when(c, n).otherwise(0)).alias
    segments = marked.groupBy("conv_id", F.shiftright("place", SEGMENT.bit_length() - 1).alias("block")).agg(
        F.sort_array(F.collect_list(row)).alias("rows"),
        of(blank, F.col("times"))("blank"), of(~blank, F.when(again, F.col("times")).otherwise(F.col("times") - 1))("duplicate"), of(~blank & ~again & (F.col("fault") == "truncated"), F.lit(1))("truncated"),
    )
    # What comes before a segment's first row in its block is another conversation's.
    segments = segments.select("conv_id", "block", (F.col("rows")[0]["place"] % SEGMENT > 0).alias("begins"), F.array_join("rows.symbols", "").alias("symbols"), F.array_join("rows.initials", "").alias("initials"), F.col("rows.turn").alias("turn_list"), "blank", "duplicate", "truncated")
    kind = dict(turns.dtypes)["conv_id"]
    parts = segments.mapInArrow(_parsed, f"conv_id {kind}, block long, {_PART}")
    names = [f.split(" ")[0] for f in _PART.split(", ")[:9]] + ["links"]
    part = F.shiftright(F.col("block"), 33 - SEGMENT.bit_length() + 1)  # the place's partition: its bounded number of segments is joined first
    for keys in (["conv_id", "part"], ["conv_id"]):
        rows = parts.withColumn("part", part) if "part" in keys else parts.withColumn("block", F.col("part"))
        listed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("block", *names))).alias("parts"))
        parts = listed.mapInArrow(_together(keys), ", ".join([f"conv_id {kind}", *["part long"] * (len(keys) - 1), _PART]))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0).cast("long")).alias("gaps")
    whole = [i for i, x in enumerate(ITEMS) if x != START and GRAMMAR[x[0]][0] == "C" and not _next(x)]
    ends = F.filter("links", lambda x: (x["entry"] == 0) & x["exit"].isin(whole))
    best = F.array_min(F.transform(ends, lambda x: F.struct(x["cost"].alias("cost"), x["audit"].alias("audit"))))
    return parts.select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", best.alias("best")).select("*", "best.cost", "best.audit").drop("best")


# ---- repaired turns -----------------------------------------------------------------------------


def _edited(kind: pa.DataType):
    schema = pa.schema([("conv_id", kind), ("seq", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, seq, last = "", 0, 0, ""
        for batch in batches:
            out: list[tuple] = []

            def inserts(conv):
                nonlocal at, seq, last
                while audit[at : at + 1] == "I":
                    last = "a" if last == "u" else "u"
                    out.append((conv, seq, ROLES[last], "", "I"))
                    at, seq = at + 1, seq + 1

            for conv, role, text, times in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "times"))):
                if role is None:  # a conversation's audit comes before its rows
                    audit, at, seq, last = text, 0, 0, ""
                    inserts(conv)
                    continue
                for _ in range(times):
                    edit = audit[at]
                    at += 1
                    if edit != "D":
                        last = role[:1] if edit == "K" else "a" if last == "u" else "u"
                        out.append((conv, seq, role if edit == "K" else ROLES[last], text, edit))
                        seq += 1
                    inserts(conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return run


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, seq, role, text, edit: the turns of :func:`turns_of` after the edits of :func:`audits`.

    A conversation's turns follow each other in one partition, in order.
    """
    kind = turns.schema["conv_id"].dataType
    none = lambda t: F.lit(None).cast(t)
    heads = found.select("conv_id", none("long").alias("turn"), none("string").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("times"))
    rows = heads.withColumn("after", F.lit(0)).unionByName(turns.withColumn("after", F.lit(1)))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "after", "turn", "role", "text")]
    sorted_ = rows.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text", "times")
    from pyspark.sql.pandas.types import to_arrow_type

    return sorted_.mapInArrow(_edited(to_arrow_type(kind)), f"conv_id {kind.simpleString()}, seq long, role string, text string, edit string")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, sha = None, None
    for batch in batches:
        done = []
        for c, seq, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "seq", "role", "text"))):
            if seq == 0:
                if sha is not None:
                    done.append((conv, sha.hexdigest()))
                conv, sha = c, hashlib.sha256()
            sha.update(f"{chr(10) if seq else ''}{role}:{text}".encode())
        kind = batch.schema.field("conv_id").type
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string())], names=["conv_id", "repaired_sha256"])
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([sha.hexdigest()])], names=["conv_id", "repaired_sha256"])


def digests(fixed: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of :func:`repaired` turns as ``role:text`` lines; it relies on their order."""
    return fixed.mapInArrow(_hashed, f"conv_id {dict(fixed.dtypes)['conv_id']}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """:func:`turns_of` conversations with faults by ``crc32(conv_id:turn) % 20``.

    0 drops the row, 1 empties its text, 2 removes ``.!?``, 3 repeats it, 4 makes it
    the user's.  Nulls are one space, also in what is hashed.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    hurt = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind")).filter("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    hurt = hurt.withColumn("text", text).withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    return turns_of(hurt, times=F.when(F.col("kind") == 3, 2).otherwise(1))


def repair(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The numbers, audit and repaired_sha256 of every conversation named in ``conversations`` (conv_id).

    One without turns has zeros, an empty audit and the empty string's hash, as has
    an empty table's none.  A null conv_id names a conversation like any other.
    """
    found = stored(audits(turns), "repair-audits")
    hashes = digests(repaired(turns, found))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = conversations.select("conv_id").distinct().unionByName(found, allowMissingColumns=True).unionByName(hashes, allowMissingColumns=True)
    one = every.groupBy("conv_id").agg(*(F.max(c).alias(c) for c in (*counts, "audit", "repaired_sha256")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return one.select("conv_id", *map(zero, counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
