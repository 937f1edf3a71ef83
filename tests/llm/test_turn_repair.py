import hashlib
import itertools
import random
import re
import zlib

import pytest

from corpusloom.llm import queries, turn_repair as T

SPACE = " \t\n\x0b\x0c\r"


def plain_best(rows):
    """(cost, audit) by trying every place in the language: least over (row, state), audits whole."""
    states = {"start": (0, "")}  # start, s, u, a
    moves = {"start": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def inserted(now):
        now = dict(now)
        for _ in range(6):
            for state, (cost, audit) in list(now.items()):
                for symbol, to in moves[state].items():
                    if symbol != "s":
                        now[to] = min(now.get(to, (9e9, "")), (cost + 5, audit + "I"))
        return now

    now = inserted(states)
    for row in rows:
        after = {}
        for state, (cost, audit) in now.items():
            after[state] = min(after.get(state, (9e9, "")), (cost + 2, audit + "D"))
            if row == "x":
                continue
            for symbol, to in moves[state].items():
                more = 5 if row.isupper() else 0
                if row.lower() == symbol:
                    after[to] = min(after.get(to, (9e9, "")), (cost + more, audit + "K"))
                if symbol != "s":
                    after[to] = min(after.get(to, (9e9, "")), (cost + more + 1, audit + "R"))
        now = inserted(after)
    return min(now[s] for s in ("start", "a") if s in now)


def exhaustive(rows, most_inserts=2):
    """Every sequence of edits that gives a sentence."""
    best = (9e9, "")

    def go(i, cost, audit, said, left):
        nonlocal best
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", said):
            best = min(best, (cost, audit))
        if left:
            for r in "ua":
                go(i, cost + 5, audit + "I", said + r, left - 1)
        if i < len(rows):
            row = rows[i]
            go(i + 1, cost + 2, audit + "D", said, left)
            if row != "x":
                more = 5 * row.isupper()
                if row.lower() != "o":
                    go(i + 1, cost + more, audit + "K", said + row.lower(), left)
                for r in "ua":
                    go(i + 1, cost + more + 1, audit + "R", said + r, left)

    go(0, 0, "", "", most_inserts)
    return best


def test_parser_against_every_edit():
    for n in range(4):
        for rows in itertools.product("suaoUAx", repeat=n):
            assert T.least(T._links("".join(rows), (T.START,))) == exhaustive("".join(rows)), rows


@pytest.mark.parametrize("seed", range(40))
def test_parser_and_segments_against_plain(seed):
    rng = random.Random(seed)
    rows = "".join(rng.choices("suaoSUAOx", [1, 5, 5, 1, 1, 2, 2, 1, 3], k=rng.randrange(80)))
    want = plain_best(rows)
    assert T.least(T._links(rows, (T.START,))) == want
    cut = rng.randrange(len(rows) + 1)
    half = rng.randrange(cut, len(rows) + 1)
    chain = T._joined(T._joined(T._links(rows[:cut], (T.START,)), T._links(rows[cut:half], T.ITEMS)), T._links(rows[half:], T.ITEMS))
    assert T.least(chain) == want


def plain_repair(table):
    """The contract's rows by plain loops."""
    convs, said = {}, lambda v: " " if v is None else str(v)
    for conv, turn, role, text in table:
        rows = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, counts, symbols = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, ""
        for _, role, text in rows:
            body = text.rstrip(SPACE)
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            symbols += {"blank": "x", "duplicate": "x", "truncated": initial.upper()}.get(fault, initial)
        turns = {r[0] for r in rows} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit = plain_best(symbols)
        lines, at, last = [], 0, ""
        for edit in audit:
            if edit == "I":
                last = "a" if last == "u" else "u"
                lines.append({"u": "user", "a": "assistant"}[last] + ":")
                continue
            _, role, text = rows[at]
            at += 1
            if edit == "K":
                last = role[0]
                lines.append(f"{role}:{text}")
            elif edit == "R":
                last = "a" if last == "u" else "u"
                lines.append({"u": "user", "a": "assistant"}[last] + f":{text}")
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def run(spark, rows, tmp_path, name="t"):
    path = tmp_path / name
    spark.createDataFrame([(*r, "x", 1, None) for r in rows], "conv_id long, turn long, role string, text string, hash string, place long, times date").write.parquet(str(path / "conversations.parquet"))
    got = queries.QUERIES["op12_conversation_repair"](spark, str(path)).select(*COLUMNS).collect()
    return sorted(map(tuple, got), key=repr)


def rows_of(seed, convs, most):
    rng, out = random.Random(seed), []
    texts = ["Yes.", "No!", "Why?", "Go on", "", " \n", None, "Cut here \x0b", "End. \t", "End. ", "Été."]
    for c in range(convs):
        for t in range(rng.randrange(1, most)):
            out.append((c if c else None, rng.choice([t, t, t, t * 3, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]), rng.choice(texts) if rng.random() < 0.6 else f"Text {rng.random()}."))
    return out + out[:5]


@pytest.mark.parametrize("segment", [4096, 2])
def test_query_against_plain(spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(T, "SEGMENT", segment)
    rows = rows_of(segment, 60, 9) + [(1000, t, ["user", "assistant"][t % 2], f"Long talk {t}." * (1 + t % 3)) for t in range(150)]
    rows += [(2000, 5, "user", "Same.")] * 40 + [(3000, None, "user", "a" * 100_000 + ".")]  # one row many times; a very long text
    rows += [(4000 + i, 0, "user", "Dropped?") for i in range(60)]  # some lose their only row
    assert run(spark, rows, tmp_path) == plain_repair(rows)


def test_empty_and_null_tables(spark, tmp_path):
    assert run(spark, [], tmp_path, "a") == []
    nulls = [(None, None, None, None)] * 3
    assert run(spark, nulls, tmp_path, "b") == plain_repair(nulls)


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Well."), (1, 2, "user", ""), (2, 0, "assistant", "Hello.")]
    turns = T.turns_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = T.audits(turns)
    assert {r.conv_id: (r.cost, r.audit) for r in found.collect()} == {1: (3, "KRD"), 2: (2, "D")}
    assert [tuple(r) for r in T.repaired(turns, found).orderBy("conv_id", "seq").collect()] == [(1, 0, "user", "Hi.", "K"), (1, 1, "assistant", "Well.", "R")]
