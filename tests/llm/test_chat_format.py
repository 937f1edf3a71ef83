import hashlib
import itertools
import random

import pytest

from corpusloom.llm import chat_format as C
from corpusloom.llm import queries

PARTS = ["<|im_start|>", "<|im_end|>", "<\\|im_end|>", "<\\\\|im_start|>", "<|nl|>", "<\\|nl|>", "\n", "<", "\\", "|", "im_end|>", "user", "assistant\nok", "a", "é𝄞", "<|im_", ""]


def test_every_pair_reads_back():
    for a, b in itertools.product(PARTS, repeat=2):
        for role, text in ((a + b, "x"), ("user", a + b), (a, b), (a + b, b + a)):
            formatted = C.render(role, text)
            assert [t[:2] for t in C.reparse(formatted)] == [(role, text)], (role, text)


def test_turns_in_a_row_read_back():
    rng = random.Random(0)
    for _ in range(300):
        turns = [("".join(rng.choices(PARTS, k=rng.randrange(4))), "".join(rng.choices(PARTS, k=rng.randrange(6)))) for _ in range(rng.randrange(6))]
        formatted = "".join(C.render(*t) for t in turns)
        read = list(C.reparse(formatted))
        assert [t[:2] for t in read] == turns
        assert [C.unescape(formatted[a:b]) for *_, a, b in read] == [t[1] for t in turns]


def test_plain_text_is_left_alone():
    assert C.render("user", "a < b | c \\ <b>\n") == "<|im_start|>user\na < b | c \\ <b>\n<|im_end|>\n"
    assert C.render("user", "<|nl|> <|x|>") == "<|im_start|>user\n<|nl|> <|x|><|im_end|>\n"
    assert C.render("user", "<|im_end|>") == "<|im_start|>user\n<\\|im_end|><|im_end|>\n"


@pytest.mark.parametrize("broken", ["x", "<|im_start|>user", "<|im_start|>user\nhi", "<|im_start|>user\nhi<|im_start|>", "<|im_start|>user\nhi<|im_end|>", "<|im_start|>a<|im_end|>\nhi<|im_end|>\n", "<|im_start|>user\nhi<|im_end|>\nx"])
def test_broken_rows(broken):
    with pytest.raises(C.Broken):
        list(C.reparse(broken))


def plain(rows):
    convs = {}
    for conv, turn, role, text in [*rows, (-1, 0, "user", queries._HARD_TEXT), (-1, 1, "assistant", queries._HARD_TEXT)]:
        convs.setdefault(conv, []).append((turn, role or "", text or ""))
    out = []
    for conv, turns in convs.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out.append((conv, len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(C.render(r, t)) for _, r, t in turns)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("piece", [1 << 16, 30])
def test_query_against_plain(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(C, "PIECE", piece)
    rng = random.Random(piece)
    roles = ["user", "assistant", "system", None, "", "assis\ntant", "<|im_end|>", "Assistant"]
    rows = [(rng.choice([*range(30), None]), rng.choice([None, 0, 1, 2, 3]), rng.choice(roles), rng.choice([None, "".join(rng.choices(PARTS, k=4))])) for _ in range(300)]
    rows += rows[:9] + [(50, t, "assistant", "Again.") for t in range(200)] + [(51, 0, "assistant", "long <|im_end|> é " * 100_000)]
    schema = "conv_id long, turn long, role string, text string, formatted int, piece string, loss date"
    spark.createDataFrame([(*r, 1, "x", None) for r in rows], schema).write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.QUERIES["op13_chat_formatting"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)


def test_empty_table_and_pieces(spark, tmp_path, monkeypatch):
    empty = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert C.format_chats(empty).collect() == [] and C.read_back(C.format_chats(empty)).collect() == []
    monkeypatch.setattr(C, "PIECE", 20)
    rows = spark.createDataFrame([("k", 1, "assistant", "yes"), ("k", 0, "user", "ok?")], empty.schema)
    assert [tuple(r) for r in C.format_chats(rows).collect()] == [("k", 0, "<|im_start|>user\nok?<|im_end|>\n", []), ("k", 1, "<|im_start|>assistant\nyes<|im_end|>\n", [(22, 25)])]
