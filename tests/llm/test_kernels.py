import re

import numpy as np
import pyarrow as pa
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import textkernel as K
from corpusloom.llm import tokens

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def blocks(texts, limit=K.BLOCK_BYTES):
    return list(K.text_blocks(pa.array(texts, pa.string()), limit))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t\x0b\x0c\r\x1f日", max_size=25)), max_size=8), st.integers(1, 30))
def test_words(texts, limit):
    seen = []
    for b in blocks(texts, limit):
        text, start, end = b.words()
        seen += [(b.first + t, bytes(b.data[s:e]).decode()) for t, s, e in zip(text, start, end)]
    assert seen == [(i, w) for i, t in enumerate(texts) for w in SPLIT.findall(t or "")]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB c", max_size=30), min_size=1, max_size=6), st.integers(2, 4))
def test_shingles_are_sets_of_word_runs(texts, k):
    (b,) = blocks(texts)
    text, h, n = K.shingles(b, k)
    text, h = K.distinct(text, h)
    for i, t in enumerate(texts):
        w = SPLIT.findall(t.replace("B", "b"))
        want = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
        assert n[i] == len(w) and len(h[text == i]) == len(want)
    # The same run hashes alike wherever it stands.
    for i, t in enumerate(texts):
        (alone,) = blocks([t])
        a, g = K.distinct(*K.shingles(alone, k)[:2])
        assert np.array_equal(g, h[text == i])


def test_sliced_and_large_arrays():
    a = pa.array(["x y", None, "z"], pa.large_string()).slice(1)
    (b,) = list(K.text_blocks(a))
    assert b.n == 2 and bytes(b.data) == b"z"
    assert list(K.text_blocks(pa.array([], pa.string()))) == []


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    for x in ["", " ", "\n\n  x\t\r\n y", "Ünï ©od € 😀 日本語     don't I'LL 12345 <|endoftext|> ¼²", "a" * 3000, " " * 500 + "b", "\x00\x1f\x7f\x85​", "Thon's été, überall.", "<|endoftext|>", "<|endoftext|>hello <|endoftext|> there<|endoftext|><|endoftext|>", "  <|endoftext|>\n <|endoftext", "<|endoftext|>" * 50]:
        assert tokens.encode(path, x).tolist() == t.encode(x, add_special_tokens=False).ids
