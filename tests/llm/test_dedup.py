import collections
import hashlib
import re

import numpy as np
import pytest

from corpusloom.llm import exact_dedup, ngram_join, suffix_dedup
from corpusloom.llm.components import _components, connected_components, extended


def test_exact(docs):
    texts = ["a  b", "a\tb", None, "", "a b ", "x" * 50000, "x" * 50000 + " ", "x" * 49999 + "y", "q"]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs(texts)).collect()}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    for i, t in enumerate(norm):
        same = [j for j, u in enumerate(norm) if u == t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (same[0], len(same), same[0] == i)
        assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("share", [1e-4, 0.5, 2.0])
def test_exact_hot_and_other_groups(docs, share):
    """Groups sent round, some of each, and none."""
    df = docs(["a", "a ", "b", "a", "b", "c", None, "a"])
    want = [(0, 0, 4, True), (1, 1, 4, False), (2, 2, 2, True), (3, 0, 4, False), (4, 2, 2, False), (5, 5, 1, True), (6, 6, 1, True), (7, 0, 4, False)]
    want[1] = (1, 1, 1, True)  # "a " keeps its space
    want = [(i, k, 3 if i in (0, 3, 7) else n, kept) for i, k, n, kept in want]
    assert sorted(tuple(r)[:4] for r in exact_dedup.exact_dedup(df, hot_share=share).collect()) == want


def test_exact_odd_tables(docs):
    assert exact_dedup.exact_dedup(docs([]).limit(0)).count() == 0
    twice = docs(["a", "b"]).unionAll(docs(["a"]))
    assert sorted((r.doc_id, r.kept, r.group_size) for r in exact_dedup.exact_dedup(twice).collect()) == [(0, True, 2), (0, True, 2), (1, True, 1)]


def keyed(spark, rows):
    return spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "doc_id long, text string, row long")


def test_drop_copies_with_repeated_and_null_keys(spark):
    rows = [(1, "x y"), (5, "x y"), (5, "unique words"), (5, "unique words"), (5, "unique  words"), (None, "x y"), (None, "z"), (None, "z"), (2, None), (3, ""), (4, "q")]
    got = exact_dedup.drop_copies(keyed(spark, rows))
    assert got.columns == ["doc_id", "text", "row"]
    got = sorted((r.doc_id or 0, re.sub(" +", " ", r.text or "")) for r in got.collect())
    assert got == [(0, "z"), (1, "x y"), (2, ""), (4, "q"), (5, "unique words")]


def test_exact_null_keys(spark):
    rows = [(None, "a"), (3, "a"), (None, "b"), (None, "b")]
    got = sorted((r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup.exact_dedup(keyed(spark, rows)).collect())
    assert got == [(0, 2, True), (0, 2, True), (3, 2, False), (3, 2, True)]


def brute_components(texts, k, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    comp = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                x, y = comp[i], comp[j]
                comp = [min(x, y) if c in (x, y) else c for c in comp]
    return {i: (len(s), comp[i]) for i, s in enumerate(sets)}


def near_copies(text):
    r = np.random.default_rng(5)
    texts = [None, "", " \n", "one", "ONE", "one two three", "one two", "one two three"]
    for base in range(4):
        words = text(120, base).split()
        texts.append(" ".join(words))
        for n in range(12):  # from one changed word to many
            w = list(words)
            for at in r.choice(len(w), 1 + n // 2, replace=False):
                w[at] = f"new{base}x{n}x{at}"
            texts.append(" ".join(w))
    texts.append(text(3000, 9))
    texts.append(text(3000, 9).upper())
    return texts


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_ngram_join(docs, text, k, percent):
    texts = near_copies(text)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs(texts).repartition(3), k, percent).collect()}
    want = brute_components(texts, k, percent)
    assert got == want and len({c for _, c in want.values()}) < len(texts) - 10


def test_ngram_join_odd_tables(docs):
    assert ngram_join.ngram_components(docs([]).limit(0)).count() == 0
    assert [tuple(r) for r in ngram_join.ngram_components(docs([None])).collect()] == [(0, 0, 0)]
    twice = docs(["a b c d e f", "x"]).unionAll(docs(["a b c d e f"]))
    assert sorted(map(tuple, ngram_join.ngram_components(twice).collect())) == [(0, 2, 0), (0, 2, 0), (1, 1, 1)]


def test_ngram_join_split_lists(docs, text, monkeypatch, spark):
    """Every posting list in parts: same result."""
    monkeypatch.setattr(ngram_join, "SPLIT_BITS", 0)
    texts = near_copies(text)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs(texts).repartition(3), 4, 85).collect()}
    assert got == brute_components(texts, 4, 85)


def test_ngram_join_version_history(docs, text):
    """Each version is near its predecessor alone."""
    words = text(200, 3).split()
    versions = [" ".join(words[4 * i : 4 * i + 100]) for i in range(25)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs(versions), 4, 85).collect()}
    assert got == brute_components(versions, 4, 85) and {c for _, c in got.values()} == {0}


def test_drop_near_copies_with_repeated_and_null_keys(spark, text):
    base = text(100, 1).split()
    near = lambda i: " ".join([*base[:i], "changed", *base[i + 1 :]])
    rows = [(7, near(0)), (7, near(99)), (3, near(50)), (7, text(60, 2)), (7, text(60, 2)), (None, text(60, 3)), (None, text(60, 3) + " more"), (2, ""), (2, None), (None, "short")]
    got = ngram_join.drop_near_copies(keyed(spark, rows))
    assert got.columns == ["doc_id", "text", "row"]
    got = sorted((r.doc_id or 0, (r.text or "")[:12]) for r in got.collect())
    assert [k for k, _ in got] == [0, 0, 2, 2, 3, 7] and (7, text(60, 2)[:12]) in got and (0, "short") in got
    ids = {(r.doc_id, r.component_id) for r in ngram_join.ngram_components(keyed(spark, rows)).collect()}
    assert ids == {(7, 3), (3, 3), (7, 7), (None, None), (2, 2)}


def test_components_of_a_long_chain(spark):
    """Both in order and shuffled, in a logarithmic number of steps."""
    r = np.random.default_rng(4)
    for order in (np.arange(10_000), r.permutation(10_000)):
        links = spark.createDataFrame([(int(a), int(b)) for a, b in zip(order, order[1:])], "a long, b long").coalesce(2)
        found, rounds, steps = _components(links)
        assert found.filter("component = 0").count() == found.count() == 10_000
        assert rounds <= 10 and steps <= 20


def test_components(spark):
    r = np.random.default_rng(2)
    links = [(i, i + 1) for i in range(30)] + [(int(a) + 100, int(b) + 100) for a, b in r.integers(0, 40, (25, 2))] + [(7, 7)]
    got = {x.id: x.component for x in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    comp = {}
    for a, b in links:
        if a != b:
            comp.setdefault(a, a)
            comp.setdefault(b, b)
            x, y = comp[a], comp[b]
            comp = {k: min(x, y) if v in (x, y) else v for k, v in comp.items()}
    assert got == comp
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_extended(spark):
    """By links between components, within one, to new ids and among new ids: as of all links at once."""
    table = lambda links: spark.createDataFrame(links, "a long, b long")
    first, then = [(1, 2), (2, 3), (10, 11), (20, 21), (30, 31)], [(3, 1), (3, 11), (21, 5), (40, 41), (31, 7), (7, 41), (9, 9)]
    found = {r.id: r.component for r in extended(connected_components(table(first)), table(then)).collect()}
    assert found == {r.id: r.component for r in connected_components(table(first + then)).collect()}
    part = connected_components(table(first))
    assert extended(part, table([(1, 3), (11, 10)])) is part and extended(part, table([])) is part


def test_ngram_join_follows_new_links_alone(docs, text, monkeypatch, spark):
    """Links of a later step are followed from the components that are there, and the sketch comes in few jobs."""
    whole, jobs = [], []
    once = ngram_join.connected_components
    monkeypatch.setattr(ngram_join, "connected_components", lambda links: whole.append(1) or once(links))
    counted = ngram_join._count_sketch

    def sketch(summary):
        spark.sparkContext.setJobGroup("sketch", "")
        try:
            return counted(summary)
        finally:
            jobs.extend(spark.sparkContext.statusTracker().getJobIdsForGroup("sketch"))
            spark.sparkContext.setJobGroup("", "")

    monkeypatch.setattr(ngram_join, "_count_sketch", sketch)
    texts = near_copies(text)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs(texts).repartition(3), 5, 80).collect()}
    assert got == brute_components(texts, 5, 80)
    assert len(whole) == 1 and len(jobs) <= 2 * ngram_join.SKETCH_PARTS


def brute_removal(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = {}
    for k, b in enumerate(data):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[k] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def repeats(text):
    shared = text(60, 1)
    return [
        None, "", "short", text(80, 2) + shared + text(50, 3), shared + text(30, 4), text(90, 5), text(90, 5), shared[:199], shared[:200], "ab" * 400, "é" * 300,
        text(40, 6) + shared[50:260] + text(40, 7) + shared[50:260], "\n".join([text(30, 8)] * 5), text(5000, 10), text(300, 11) + text(5000, 10)[900:1500],
    ]


@pytest.mark.parametrize(("shard_bytes", "hot"), [(1 << 20, 4000), (1500, 4000), (1 << 20, 1), (900, 1)])
def test_suffix_dedup(docs, text, shard_bytes, hot):
    texts = repeats(text)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs(texts).repartition(3), shard_bytes=shard_bytes, hot=hot).collect()}
    assert got == brute_removal(texts, 200)


def test_suffix_dedup_tells_rows_with_one_key_apart(spark, text):
    rows = [(None, text(80, 1)), (1, text(80, 2)), (1, text(80, 1)), (1, text(80, 3)), (None, None)]
    got = suffix_dedup.remove_repeats(keyed(spark, rows)).collect()
    want = brute_removal([t for _, t in rows], 200)
    assert sorted(tuple(r)[1:] for r in got) == sorted(want.values())


def test_suffix_windows_without_a_sampled_gram(text):
    """They are split by another value of their content."""
    data = np.frombuffer(text(300, 4).encode(), np.uint8)
    w = suffix_dedup.Windows(data, np.array([0, len(data)]))
    assert (w.samples() != 0).all() and len(np.unique(w.samples())) > 10
    again = suffix_dedup.Windows(data[37:], np.array([0, len(data) - 37]))
    assert np.array_equal(again.samples(), w.samples()[37:])


def test_suffix_dedup_stretches(docs, text, monkeypatch):
    texts = [text(4000, 1), text(10, 2) + text(4000, 1)[7000:9000]]
    want = brute_removal(texts, 200)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    got = [b for t in texts for b in _stretched(t)]
    assert len(got) > 2
    assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs(texts)).collect()} == want


def _stretched(t):
    import pyarrow as pa

    from corpusloom.llm.textkernel import text_blocks

    return [w for b in text_blocks(pa.array([t])) for w in suffix_dedup._stretches(b, 200)]


def test_suffix_dedup_odd_tables(docs, text):
    assert suffix_dedup.remove_repeats(docs([]).limit(0)).count() == 0
    twice = docs([text(60, 3)]).unionAll(docs([text(60, 3)]))
    assert {r.n_removed for r in suffix_dedup.remove_repeats(twice).collect()} == {len(text(60, 3))}


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(1)
    for n, a in ((1, 2), (5, 1), (300, 2), (500, 1), (2000, 4)):
        d = r.integers(0, a, n).astype(np.uint8)
        b = d.tobytes()
        order = sorted(range(n), key=lambda i: b[i:])
        assert suffix_dedup.suffix_array(d).tolist() == order
        starts = np.unique(np.concatenate(([0], r.integers(0, n, 3))))

        def common(x, y):
            k = 0
            while k < 40 and max(x, y) + k < n and b[x + k] == b[y + k]:
                k += 1
            return k

        assert suffix_dedup.kasai(d, starts, np.array(order), 40).tolist() == [0] + [common(x, y) for x, y in zip(order, order[1:])]
