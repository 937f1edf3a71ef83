import sqlite3

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import stemming
from corpusloom.functions import text as T
from corpusloom.operators import graph, index, listing, merge, quality, retrieve, search
from corpusloom.operators.textindex import TextIndex


def test_page_checks():
    orders = {"newest": [], "relevance": []}
    listing.check_page(1, 0, "newest", orders)
    for bad in ((0, 0, "newest", None), (201, 0, "newest", None), (1, -1, "newest", None), (1, 0, "oldest", None), (1, 0, "relevance", None)):
        with pytest.raises(ValueError):
            listing.check_page(*bad[:3], orders, bad[3])


def test_filters(spark):
    df = spark.createDataFrame([(1, "cs.CL math", None, "É A"), (2, "csx", "retry", "é b"), (3, "cs", "no_body", "c"), (4, None, "downloaded", None)], "k long, c string, s string, x string")
    ids = lambda cond: sorted(r.k for r in df.filter(cond).collect())
    assert ids(listing.has_token(F.col("c"), "cs")) == [1, 3]
    assert ids(listing.pending(F.col("s"))) == [1, 2]
    assert ids(listing.pending(F.col("s"), retry_no_body=True)) == [3]
    assert ids(listing.pending(F.col("s"), force=True)) == [1, 2, 3, 4]
    assert ids(listing.is_status(F.col("s"), "retry", yes=False)) == [1, 3, 4]
    assert ids(listing.contains_ascii(F.col("x"), "é")) == [2]
    assert ids(listing.contains_ascii(F.col("x"), "B")) == [2]
    assert ids(listing.in_list(F.lit("a, B;c"), "b")) == [1, 2, 3, 4]
    none = df.limit(0)
    assert listing.embedded(df, none, "k", True).count() == 0 and listing.embedded(df, none, "k", False).count() == 4
    with pytest.raises(KeyError):
        listing.point(df, "k", 9)


def test_merge(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k long, v string, own string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k long, v string, n long")
    got = {r.k: r.v for r in merge.upsert(old.select("k", "v"), new, ["k"], "n").collect()}
    assert got == {1: "a", 2: "d", 3: "e"}
    got = {r.k: r.v for r in merge.insert_ignore(old.select("k", "v"), new, ["k"], "n").collect()}
    assert got == {1: "a", 2: "b", 3: "e"}
    again = merge.upsert(old.select("k", "v"), old.select("k", "v"), ["k"], "v")
    assert sorted(map(tuple, again.collect())) == [(1, "a"), (2, "b")]
    latest = spark.createDataFrame([(1, "a"), (2, "z"), (3, "e")], "k long, v string")
    rows = {r.k: (r.v, r.own) for r in merge.change_upsert(old, latest, ["k"], "v", ["own"]).collect()}
    assert rows == {1: ("a", "x"), 2: ("z", "y"), 3: ("e", None)}
    extra = spark.createDataFrame([(1, "q"), (9, "r")], "k long, v string")
    assert sorted(r.k for r in merge.append_defaults(old.select("k", "v"), extra, "k").collect()) == [1, 2, 9]


def test_redirects(spark):
    rows = [(1, "Animal", "Animals are living things."), (2, "Animalia", "#redirect [[animal]]"), (3, "Critter", "#REDIRECT [[Animalia]]"), (4, "Loop A", "#REDIRECT [[Loop B]]"), (5, "Loop B", "#REDIRECT [[Loop A]]"), (6, "Broken", "#REDIRECT [[Nonexistent Page]]")]
    pages = spark.createDataFrame(rows, "page_id long, title string, t string").withColumn("target", T.redirect_target(F.col("t")))
    assert {r.page_id: r.resolved for r in graph.resolve_redirects(pages).collect()} == {1: None, 2: 1, 3: 1, 4: None, 5: None, 6: None}


def test_tree(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id long, parent long")
    assert sorted(map(tuple, graph.tree_closure(nodes, "id", "parent").collect())) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0)]


def test_quality(spark):
    texts = ["x " * 300, "short", "![a](b)" * 40, "日" * 300, "[a](b) " * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    assert [r.c for r in df.orderBy("i").select(quality.classify(F.col("t")).alias("c")).collect()] == [None, "too_short", "image_only", "non_english", "link_dump"]
    assert df.filter(quality.is_junk(F.lit("This paper has been withdrawn. " + "x" * 200))).count() == 5


def test_porter():
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "rational": "ration", "digitizer": "digit", "triplicate": "triplic", "hopefulness": "hope", "revival": "reviv", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "running": "run", "licensed": "licens"}
    assert {w: stemming.stem(w) for w in pairs} == pairs


DOCS = ["running runs run fast", "the quick brown fox", "Éclair of the day", "the the the day", "licensed under the license", "fox run quick"]


def test_bm25_as_sqlite(spark):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    con.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", list(enumerate(DOCS)))
    df = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string")
    postings, lengths = search.index_documents(df, "doc_id", search.document_tokens(F.col("text")))
    stems = stemming.stem_postings(postings).cache()
    for q in ("run", "the", "quick fox", "eclair", "license", "day the", "absent"):
        want = {r[0]: r[1] for r in con.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (" ".join(f'"{w}"' for w in q.split()),))}
        got = {r.doc_id: r.score for r in search.bm25(stems, lengths, [stemming.stem(w) for w in search.plain_terms(q)], "doc_id").collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want), q


def test_predicates_as_sqlite(spark):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    con.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", list(enumerate(DOCS)))
    df = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string").withColumn("w", search.document_tokens(F.col("text")))
    w = F.col("w")
    has = lambda *x: search.has_words(w, x)
    cases = {"the day": has("the", "day"), '"the quick"': search.has_phrase(w, "the quick"), "qui*": search.has_prefix(w, "qui"), "fox OR day": has("fox") | has("day"), "the NOT quick": has("the") & ~has("quick"), "(fox OR day) NOT the": (has("fox") | has("day")) & ~has("the")}
    for q, predicate in cases.items():
        want = sorted(r[0] for r in con.execute("SELECT rowid FROM f WHERE f MATCH ?", (q,)))
        assert sorted(r.doc_id for r in df.filter(predicate).collect()) == want, q


def test_stored_postings(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string")
    postings, lengths = search.index_documents(df, "doc_id", search.document_tokens(F.col("text")))
    index = TextIndex(spark, str(tmp_path / "p"), buckets=8)
    index.opened()
    index.update(df)
    read = index.blocks({"the": 0.0, "fox": 0.0})
    got = read.select("term", F.explode(F.arrays_zip("keys", "tfs")).alias("p")).select("term", "p.keys", "p.tfs").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, postings.filter("term IN ('the', 'fox')").select("term", "doc_id", "tf").collect()))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "EqualTo(term" in plan and "GreaterThanOrEqual(most" in plan
    a = {r.doc_id: r.score for r in index.matches("the fox").collect()}
    assert a == pytest.approx({r.doc_id: r.score for r in search.bm25(postings, lengths, ["the", "fox"], "doc_id").collect()}) and a


def test_trigram(spark):
    df = spark.createDataFrame([("Hello World",)], "t string")
    for part, n in (("lo wo", 1), ("LO", 0), ("xyz", 0)):
        assert df.filter(search.trigram(F.col("t"), part)).count() == n


def test_knn_is_not_starved(spark):
    near = [(i, f"o{i}", [0.95, 0.0]) for i in range(400)]
    far = [(1000 + i, f"p{i}", [0.0, 1.0]) for i in range(5)]
    df = spark.createDataFrame(near + far, "id long, d string, embedding array<float>")
    allow = spark.createDataFrame([(1000 + i,) for i in range(5)], "id long")
    got = retrieve.knn(df, [1.0, 0.0], 50, "id", allow=allow).collect()
    assert sorted(r.id for r in got) == [1000, 1001, 1002, 1003, 1004] and abs(got[0].distance - 2**0.5) < 1e-6
    assert retrieve.knn(df, [1.0, 0.0], 10_000, "id").count() == 405
    assert retrieve.knn(df, [1.0, 0.0], 5, "id", allow=allow.limit(0)).count() == 0


def test_fusion(spark):
    dense = spark.createDataFrame([(1, 0.1), (2, 0.2)], "id long, distance double")
    sparse = spark.createDataFrame([(2, -3.0), (3, -2.0)], "id long, score double")
    rows = retrieve.fused_top(retrieve.fuse(dense, sparse, "id"), 10, "id").collect()
    assert [r.id for r in rows] == [2, 1, 3] and rows[0].used_dense
    assert abs(rows[0].score - (1 / 62 + 1 / 61)) < 1e-12
    alone = retrieve.fuse(None, sparse, "id").orderBy("id").collect()
    assert [r.id for r in alone] == [2, 3] and not alone[0].used_dense


@pytest.fixture(scope="module")
def corpus(spark):
    """Chunks 0 to 39 of 20 documents, ten of them about foxes; vectors on a circle."""
    import math

    rows = [(i, i // 2, "red fox runs" if i % 4 == 0 else "the quick brown dog", f"p. {i % 2}") for i in range(40)]
    chunks = spark.createDataFrame(rows, "chunk_id long, doc_id long, text string, section string")
    vectors = spark.createDataFrame([(i, [math.cos(i / 10), math.sin(i / 10)]) for i in range(40)], "chunk_id long, embedding array<double>")
    meta = spark.createDataFrame([(i, f"title {i}", "even" if i % 2 == 0 else "odd") for i in range(19)], "doc_id long, title string, subject string")
    return chunks, vectors, meta, lambda query, k, allow: search.sparse_hits(chunks, "chunk_id", search.document_tokens(F.col("text")), query, k, allow)


def test_retrieve(corpus):
    chunks, vectors, meta, find = corpus
    hits = retrieve.retrieve("fox", [1.0, 0.0], chunks, vectors, meta, find, top_k=15).collect()
    assert [r.rank for r in hits] == list(range(1, 16)) and hits[0].chunk_id == 0 and all(r.used_dense for r in hits)
    assert all(a.score >= b.score for a, b in zip(hits, hits[1:])) and hits[0].title == "title 0"
    sparse = retrieve.retrieve("fox", None, chunks, vectors, meta, find, top_k=100, candidate_k=200).collect()
    assert {r.chunk_id for r in sparse} == set(range(0, 40, 4)) and not any(r.used_dense for r in sparse)
    assert [r.title for r in sparse if r.doc_id == 18] == ["title 18"]
    late = retrieve.retrieve("dog", [1.0, 0.0], chunks, vectors, meta, find, top_k=100, candidate_k=200).collect()
    assert len(late) == 40 and {r.title for r in late if r.doc_id == 19} == {None}
    for bad in ({"top_k": 0}, {"top_k": 101}, {"candidate_k": 9}, {"candidate_k": 201}):
        with pytest.raises(ValueError):
            retrieve.retrieve("fox", None, chunks, vectors, meta, find, **bad)


def test_retrieve_in_scope(spark, corpus):
    chunks, vectors, meta, find = corpus
    odd = chunks.join(meta, "doc_id").filter("subject = 'odd'").select("chunk_id")
    hits = retrieve.retrieve("the", [1.0, 0.0], chunks, vectors, meta, find, top_k=5, candidate_k=10, allow=odd).collect()
    assert len(hits) == 5 and {r.subject for r in hits} == {"odd"}
    for query, allow in (("", None), ("  ", None), ("fox", odd.limit(0))):
        assert retrieve.retrieve(query, [1.0, 0.0], chunks, vectors, meta, find, allow=allow).count() == 0
    best = find('The "quick" brown', 3, odd).collect()
    assert len(best) == 3 and {r.chunk_id for r in best} <= {r.chunk_id for r in odd.collect()}
    assert retrieve.scope(meta, "doc_id") is None
    assert [r.doc_id for r in retrieve.scope(meta, "doc_id", subject=["odd"], title=["title 1", "title 2"]).collect()] == [1]
    assert retrieve.scope(meta, "doc_id", subject=[]).count() == 0


def test_long_redirects_and_deep_trees(spark):
    chain = [(i, f"T{i}", None if i == 0 else f"T{i - 1}") for i in range(13)] + [(20, "A", "B"), (21, "B", "A"), (22, "C", "b"), (30, "D", "E"), (31, "E", None), (32, "F", "d")]
    pages = spark.createDataFrame(chain, "page_id long, title string, target string")
    got = {r.page_id: r.resolved for r in graph.resolve_redirects(pages).collect()}
    want = {i: 0 if 0 < i <= 10 else None for i in range(13)} | {20: None, 21: None, 22: None, 30: 31, 31: None, 32: 31}
    assert got == want
    deep = spark.createDataFrame([(i, i - 1 if i else None) for i in range(150)], "id long, parent long")
    rows = graph.tree_closure(deep, "id", "parent").collect()
    assert len(rows) == 150 * 151 // 2 and all(r.id - r.ancestor == r.depth for r in rows)
    with pytest.raises(ValueError):
        graph.tree_closure(spark.createDataFrame([(1, 2), (2, 1)], "id long, parent long"), "id", "parent")


def test_bounds_of_a_route():
    assert listing.check_id("W123", r"W\d+") == "W123"
    listing.check_page(1_500, 0, "id", {"id": ()}, most=2_000)
    for bad in (lambda: listing.check_id("W12x", r"W\d+"), lambda: listing.check_page(201, 0, "id", {"id": ()}), lambda: listing.check_page(5, 0, "relevance", {"relevance": ()})):
        with pytest.raises(ValueError):
            bad()


def test_taxonomy(spark):
    codes = spark.createDataFrame([("math.CO",), ("math.AG",), ("hep-th",), ("math.CO",), (None,), ("cs",), ("cs.LG",)], "code string")
    assert {r.parent: r.children for r in graph.taxonomy(codes, "code").collect()} == {"math": ["math.AG", "math.CO"], "hep-th": [], "cs": ["cs.LG"]}


def test_reindex(spark):
    from corpusloom.functions import chunking

    schema = "doc_id string, title string, version string, text string"
    cut = lambda d: chunking.chunks(d, "markdown", chunking.Profile(500, 600, 50))
    docs = spark.createDataFrame([("42", "Earth", "v1", "## History\n" + "word " * 400), ("7", "Void", "v1", "")], schema)
    empty_chunks = cut(docs).limit(0)
    meta0 = spark.createDataFrame([], "doc_id string, version string, title string, chunk_count long, indexed_at string")
    chunks, meta = index.reindex(docs, empty_chunks, meta0, cut)
    chunks, meta = chunks.cache(), meta.cache()
    n = chunks.count()
    assert n > 1 and [(r.doc_id, r.chunk_count) for r in meta.collect()] == [("42", n)]
    docs2 = spark.createDataFrame([("42", "Earth", "v2", "## A\n" + "alpha " * 30)], schema)
    chunks2, meta2 = index.reindex(docs2, chunks, meta, cut)
    assert [r.text[:5] for r in chunks2.collect()] == ["alpha"] and meta2.first().version == "v2"
    same, _ = index.reindex(docs2, chunks2, meta2, cut)
    assert same.count() == 1
    gone, meta3 = index.reindex(spark.createDataFrame([("42", "Earth", "v3", " ")], schema), chunks2, meta2, cut)
    assert gone.count() == 0 and meta3.count() == 0
