"""Numpy kernels against plain loops: convolution, gradients, risk, and license windows at every offset."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import language_id, license_scan, toxicity
from corpusloom.llm.license_texts import TEMPLATES
from corpusloom.llm.textkernel import text_blocks


@pytest.fixture(scope="module")
def net():
    net = language_id.ByteConvNet.start(["a", "b", "c"], seed=3)
    net.bias[:] = np.linspace(-0.3, 0.3, len(net.bias))
    net.out_bias[:] = [0.1, -0.2, 0.05]
    return net


def plain_logits(net, row):
    e, f = net.embed.astype(float), net.filters.astype(float)
    pooled = []
    for k in range(f.shape[1]):
        width = language_id.WIDTHS[k // language_id.FILTERS]
        best = -math.inf
        for i in range(len(row) - max(language_id.WIDTHS) + 1):
            total = 0.0
            for j in range(width):
                for c in range(language_id.EMBED):
                    total += e[row[i + j], c] * f[j * language_id.EMBED + c, k]
            best = max(best, total)
        pooled.append(max(best + net.bias[k], 0.0))
    return [sum(p * net.out[k, lang] for k, p in enumerate(pooled)) + net.out_bias[lang] for lang in range(3)]


def test_convolution(net):
    rows = np.random.default_rng(1).integers(0, 256, (2, 40)).astype(np.uint8)
    got = net.logits(rows)
    for row, own in zip(rows, got):
        assert np.allclose(own, plain_logits(net, row.tolist()), atol=1e-4)


def test_gradients(net):
    r = np.random.default_rng(2)
    rows, label = r.integers(0, 30, (4, 24)).astype(np.uint8), np.array([0, 1, 2, 1])
    wide = language_id.ByteConvNet(net.languages, *(p.astype(np.float64) for p in net.params()))

    def loss():
        z = np.stack([plain_logits(wide, row.tolist()) for row in rows])
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(4), label]).mean())

    mask = language_id._mask()
    for g, p in zip(wide.gradients(rows, label), wide.params()):
        flat = [i for i in np.argsort(-np.abs(g).ravel())[:3]]
        for i in flat:
            at = np.unravel_index(i, p.shape)
            if p is wide.filters and not mask[at]:
                continue
            old, step = p[at], 1e-5
            p[at] = old + step
            up = loss()
            p[at] = old - step
            down = loss()
            p[at] = old
            assert abs((up - down) / (2 * step) - g[at]) < 1e-4 + 1e-3 * abs(g[at])


def test_windows_cover_every_gram():
    """Each run of the widest filter's bytes lies in exactly one window."""
    span = max(language_id.WIDTHS)
    for n in (1, 3, 255, 256, 257, 509, 510, 1000):
        text = bytes((i * 7) % 251 + 1 for i in range(n))
        (block,) = text_blocks(pa.array([text.decode("latin-1")]))
        data = bytes(block.data)
        _, rows = language_id.cut(block)
        grams = [bytes(row[i : i + span]) for row in rows for i in range(len(row) - span + 1)]
        grams = [g for g in grams if 0 not in g]
        assert sorted(grams) == sorted(data[i : i + span] for i in range(len(data) - span + 1))


def test_risk():
    r = np.random.default_rng(5)
    zp, zu, prior = r.normal(1, 2, 30), r.normal(-1, 2, 50), 0.2
    loss = lambda z: math.log1p(math.exp(-z)) if z > -30 else -z
    plus = prior * sum(loss(z) for z in zp) / 30
    minus = sum(loss(-z) for z in zu) / 50 - prior * sum(loss(-z) for z in zp) / 30
    assert np.allclose(toxicity.risk_parts(zp, zu, prior), (plus, minus))


def test_training_lowers_the_risk_and_does_not_go_below_zero():
    """Positives hold feature 1, a fifth of the unlabelled too; labels of those aren't known to the training."""
    r = random.Random(3)
    doc = lambda toxic: np.array(sorted({r.randrange(10, 40) for _ in range(8)} | ({1} if toxic else set())), np.int64)
    toxic, hidden = [doc(True) for _ in range(200)], [i % 5 == 0 for i in range(1000)]
    model = toxicity.train(toxic, [doc(h) for h in hidden], 0.2)
    assert 1 in model.features
    weight = dict(zip(model.features.tolist(), model.weights))
    logit = lambda d: model.bias + sum(weight.get(int(x), 0.0) for x in d)
    zp, zu = np.array([logit(d) for d in toxic]), np.array([logit(doc(h)) for h in hidden])
    assert sum(toxicity.risk_parts(zp, zu, 0.2)) < 0.1 < sum(toxicity.risk_parts(np.zeros(1), np.zeros(1), 0.2))
    assert (zp > 0).all() and ((zu > 0) == np.array(hidden)).all()


def shingles(t):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.mark.parametrize("name", ["mit", "zlib", "gpl-header", "mit-notice", "cc-by-4.0-notice"])
def test_edited_licenses_at_every_offset(text, name):
    """Words put in, left out and changed: found wherever the copy begins."""
    index = license_scan.Index(TEMPLATES)
    words = TEMPLATES[name].split()
    n = len(words)
    edits = {"whole": words, "inside": words[: n // 2] + text(n // 2, 77).split() + words[n // 2 :]}
    if n > 60:
        edits |= {"changed": [*words[:9], "other", *words[10:]], "cut": words[: n - n // 10], "twice": words[: n // 3] + text(n // 3, 5).split() + words[n // 3 : 2 * n // 3] + text(n // 4, 6).split() + words[2 * n // 3 :]}
    before = text(260, 9).split()
    for kind, copy in edits.items():
        want = len(shingles(" ".join(words)) & shingles(" ".join(copy))) >= 0.8 * len(shingles(" ".join(words)))
        offsets = range(0, 250, 7)
        texts = [" ".join(before[:at] + copy + before[:30]) for at in offsets]
        (block,) = text_blocks(pa.array(texts))
        found = {t for t, i, _, _ in index.matches(block) if index.names[i] == name}
        assert found == (set(range(len(texts))) if want else set()), kind
