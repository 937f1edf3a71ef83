"""Byte-level BPE ids for whole texts, from a public tokenizer file."""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import tiktoken


def _printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves; the others take the code
    points from 256 on, in order.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def encoder(path: str) -> tiktoken.Encoding:
    """An encoder with the vocabulary and the added tokens of a byte-level BPE ``tokenizer.json``.

    Ids equal those of the tokenizers library, whose own encoder takes about five
    times as long on texts whose words rarely repeat.  Kept per worker.
    """
    import public_tokenizers

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if flags := {k for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized") if t[k]}:
        raise ValueError(f"added tokens with {sorted(flags)} aren't supported")
    byte = _printable_bytes()
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def encode(path: str, text: str) -> np.ndarray:
    """Ids of a text; as in the tokenizers library, the string of an added token is that token wherever it stands."""
    e = encoder(path)
    if any(t in text for t in e.special_tokens_set):
        return np.array(e.encode(text, allowed_special="all"), dtype="<u4")
    return np.array(e.encode_ordinary(text), dtype="<u4")
