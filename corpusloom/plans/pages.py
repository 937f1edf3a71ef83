"""Registered queries: composed list routes, scoped search and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import builders, markup
from ..functions import text as T
from ..functions.arrow import spread
from ..operators import graph, index, listing, merge, retrieve, routes, search
from ..operators.textindex import TextIndex
from ..sources import archives, xmlrows
from .indexes import once, text_index
from .registry import query

_TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x != '')"
_POINT = [round(((i * 37) % 64 - 31) / 64, 6) for i in range(64)]
_POINT_SQL = "[" + ", ".join(map(str, _POINT)) + "]::DOUBLE[]"


def _bm25(terms: list[str], table: str = "documents", key: str = "doc_id") -> str:
    """CTEs b (key, score) of all rows of a table that hold all terms."""
    n = range(len(terms))
    counts = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS f{i}" for i, t in enumerate(terms))
    sums = ", ".join(f"count(CASE WHEN f{i} > 0 THEN 1 END) AS d{i}" for i in n)
    idf = [f"ln((n - d{i} + 0.5) / (d{i} + 0.5))" for i in n]
    parts = " + ".join(f"CASE WHEN {x} <= 0 THEN 1e-6 ELSE {x} END * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / a))" for i, x in enumerate(idf))
    every = " AND ".join(f"f{i} > 0" for i in n)
    return f"""d AS (SELECT {key}, {_TOKENS} AS w FROM {table}), c AS (SELECT {key}, len(w) AS dl, {counts} FROM d),
      s AS (SELECT count(*) AS n, avg(dl) AS a, {sums} FROM c), b AS (SELECT {key}, -({parts}) AS score FROM c, s WHERE {every})"""


def _orders():
    return {"longest": [F.desc("n_chars")], "shortest": [F.col("n_chars")], "source": [F.col("source"), F.desc("n_chars")]}


def _chunk_find(t):
    """The sparse arm over documents that are their own chunks."""
    index = text_index(t("documents"))
    return lambda query, k, allow: index.top(query, k, None if allow is None else allow.withColumnRenamed("chunk_id", "doc_id")).withColumnRenamed("doc_id", "chunk_id")


@query(f"""WITH {_bm25(['license'])}, r AS (SELECT d.doc_id, source, n_chars, round(score, 6) AS score FROM documents d JOIN b ON b.doc_id = d.doc_id
          WHERE lang IN ('en', 'de') AND n_chars >= 200 AND d.doc_id IN (SELECT doc_id FROM labels))
          SELECT *, count(*) OVER () AS total FROM r ORDER BY score, doc_id LIMIT 20 OFFSET 1""")
def list_search_page(t):
    docs = t("documents")
    clauses = [listing.any_of(F.col("lang"), ["en", "de"]), listing.between(F.col("n_chars"), 200), listing.equals(F.col("source"), None)]
    found = routes.list_page(docs, "doc_id", _orders(), "longest", "License", text_index(docs).matches, clauses, t("labels"), True, limit=20, offset=1)
    return found.select("doc_id", "source", "n_chars", F.round("score", 6).alias("score"), "total")


@query("""SELECT doc_id, source, n_chars, count(*) OVER () AS total FROM documents WHERE lang = 'fr' AND doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY n_chars DESC, doc_id LIMIT 30""")
def list_default_sort(t):
    return routes.list_page(t("documents"), "doc_id", _orders(), "longest", clauses=[listing.equals(F.col("lang"), "fr")], done=t("labels"), embedded=False, limit=30).select("doc_id", "source", "n_chars", "total")


@query(f"""WITH {_bm25(['the'])} SELECT d.doc_id, source, n_chars, count(*) OVER () AS total FROM documents d JOIN b ON b.doc_id = d.doc_id ORDER BY source, n_chars DESC, doc_id LIMIT 40 OFFSET 10""")
def list_search_sorted(t):
    return routes.list_page(t("documents"), "doc_id", _orders(), "longest", "the", text_index(t("documents")).matches, sort="source", limit=40, offset=10).select("doc_id", "source", "n_chars", "total")


@query("""SELECT 'longest' AS sort, doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents QUALIFY place <= 5
  UNION ALL SELECT 'shortest', doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS place FROM documents QUALIFY place <= 5
  UNION ALL SELECT 'source', doc_id, row_number() OVER (ORDER BY source, n_chars DESC, doc_id) AS place FROM documents QUALIFY place <= 5""")
def sort_maps(t):
    from pyspark.sql import Window

    out = None
    for name, order in _orders().items():
        page = routes.list_page(t("documents"), "doc_id", _orders(), "longest", sort=name, limit=5)
        five = page.select(F.lit(name).alias("sort"), "doc_id", F.row_number().over(Window.orderBy(*order, "doc_id")).cast("long").alias("place"))
        out = five if out is None else out.unionByName(five)
    return out


@query(f"WITH {_bm25(['the', 'of'])} SELECT doc_id, round(score, 6) AS score FROM b WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY b.score, doc_id LIMIT 20")
def sparse_filtered(t):
    hits = text_index(t("documents")).top('The "of"', 20, t("labels").filter("quality = 1"))
    return hits.select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_bm25(['the'])}, allow AS (SELECT doc_id FROM documents WHERE lang IN ('en', 'es') AND source IN ('src0', 'src1', 'src2', 'src3')),
  sp AS (SELECT doc_id, row_number() OVER (ORDER BY score, doc_id) AS sparse_rank FROM b WHERE doc_id IN (FROM allow) QUALIFY sparse_rank <= 50),
  de AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY list_distance(embedding::DOUBLE[], {_POINT_SQL}), vec_id) AS dense_rank FROM embeddings WHERE vec_id IN (FROM allow) QUALIFY dense_rank <= 50),
  f AS (SELECT coalesce(sp.doc_id, de.doc_id) AS doc_id, sparse_rank, dense_rank, coalesce(1.0 / (60.0 + dense_rank), 0) + coalesce(1.0 / (60.0 + sparse_rank), 0) AS score FROM sp FULL JOIN de ON sp.doc_id = de.doc_id),
  x AS (SELECT *, row_number() OVER (ORDER BY score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, doc_id) AS rank FROM f QUALIFY rank <= 20)
  SELECT x.doc_id, x.rank, source, quality, true AS used_dense FROM x JOIN documents d ON d.doc_id = x.doc_id LEFT JOIN labels l ON l.doc_id = x.doc_id""")
def retrieve_scoped(t):
    """Retrieval within an allowlist that comes from metadata; labels are the data of a document, null where it has none."""
    docs = t("documents")
    allow = retrieve.scope(docs.withColumnRenamed("doc_id", "chunk_id"), "chunk_id", lang=["en", "es"], source=[f"src{i}" for i in range(4)])
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", "source", "text")
    hits = retrieve.retrieve("the", _POINT, chunks, t("embeddings").withColumnRenamed("vec_id", "chunk_id"), t("labels"), _chunk_find(t), allow=allow)
    return hits.select("doc_id", F.col("rank").cast("long").alias("rank"), "source", "quality", "used_dense")


@query(f"""WITH {_bm25(['of'])}, x AS (SELECT doc_id, row_number() OVER (ORDER BY score, doc_id) AS rank FROM b QUALIFY rank <= 10)
  SELECT x.doc_id, x.rank, lang, false AS used_dense FROM x JOIN documents d ON d.doc_id = x.doc_id""")
def retrieve_without_vector(t):
    docs = t("documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", "text")
    hits = retrieve.retrieve("of", None, chunks, t("embeddings").withColumnRenamed("vec_id", "chunk_id"), docs.select("doc_id", "lang"), _chunk_find(t), top_k=10, candidate_k=10)
    return hits.select("doc_id", F.col("rank").cast("long").alias("rank"), "lang", "used_dense")


@query("""SELECT CASE WHEN lang IN ('xx') THEN 1 ELSE 0 END AS in_scope, source, 0 AS blank, 0 AS no_scope, 0 AS no_words, count(*) AS documents FROM documents GROUP BY ALL""")
def retrieve_nothing(t):
    """A blank query, an allowlist that metadata leaves empty and a query without words find nothing in any source; no allowlist does."""
    docs = t("documents")
    chunks, vectors = docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", "text"), t("embeddings").withColumnRenamed("vec_id", "chunk_id")
    none = retrieve.scope(docs.withColumnRenamed("doc_id", "chunk_id"), "chunk_id", lang=["xx"])
    asked = {"blank": ("  ", None), "no_scope": ("the", none), "no_words": ('"" --', None)}
    found = None
    for name, (text, allow) in asked.items():
        hits = retrieve.retrieve(text, None if name == "no_words" else _POINT, chunks, vectors, t("labels"), _chunk_find(t), allow=allow).select("doc_id", F.lit(name).alias("name"))
        found = hits if found is None else found.unionByName(hits)
    per = docs.select("doc_id", "source", "lang").join(found, "doc_id", "left").groupBy("source").agg(*(F.count(F.when(F.col("name") == n, 1)).cast("int").alias(n) for n in asked), F.count_distinct("doc_id").alias("documents"), F.count(F.when(F.col("lang") == "xx", 1)).cast("int").alias("in_scope"))
    return per.select("in_scope", "source", *asked, "documents")


@query(f"""WITH {_bm25(['the'])}, e AS (SELECT conv_id * 1000 + turn AS id, {_TOKENS} AS w FROM conversations),
  ec AS (SELECT id, len(w) AS dl, len(list_filter(w, lambda x: x = 'the')) AS f FROM e), es AS (SELECT count(*) AS n, avg(dl) AS a, count(CASE WHEN f > 0 THEN 1 END) AS df FROM ec),
  eb AS (SELECT id, -(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / a))) AS score FROM ec, es WHERE f > 0)
  SELECT * FROM (SELECT doc_id AS id, 'documents' AS branch, round(score, 8) AS score FROM b UNION ALL SELECT id, 'conversations', round(score, 8) FROM eb) ORDER BY score, branch, id LIMIT 25""")
def merged_branches(t):
    """Hits of two independent indexes by their own scores."""
    a = text_index(t("documents")).matches("the").select(F.col("doc_id").alias("id"), F.lit("documents").alias("branch"), F.round("score", 8).alias("score"))
    turns = t("conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    b = text_index(turns, "id", "turns").matches("the").select("id", F.lit("conversations").alias("branch"), F.round("score", 8).alias("score"))
    return search.merge_branches(a, b).orderBy("score", "branch", "id").limit(25)


@query("""WITH f AS (SELECT unnest([n_nationkey::VARCHAR, n_name]) AS form FROM nation WHERE n_nationkey::VARCHAR IN ('3', '11') OR n_name IN ('3', '11', 'NATION_7'))
  SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey::VARCHAR IN (FROM f)""")
def country_forms(t):
    """Customers of countries that were asked for by number or by name."""
    forms = routes.all_forms(t("nation"), ["n_nationkey", "n_name"], ["3", "11", "NATION_7"])
    return t("customer").join(F.broadcast(forms), F.col("c_nationkey").cast("string") == F.col("form"), "left_semi").select("c_custkey", "c_nationkey")


@query("""SELECT parent, array_to_string(list_sort(list(DISTINCT code) FILTER (code LIKE '%.%')), ',') AS children FROM
  (SELECT split_part(code, '.', 1) AS parent, code FROM (SELECT replace(p_brand, '#', '.') AS code FROM part UNION ALL SELECT DISTINCT p_type FROM part)) GROUP BY parent""")
def taxonomy_parents(t):
    codes = t("part").select(F.replace("p_brand", F.lit("#"), F.lit(".")).alias("code")).union(t("part").select("p_type").distinct())
    return graph.taxonomy(codes, "code").select("parent", F.nullif(F.array_join("children", ","), F.lit("")).alias("children"))


@query("SELECT p_type AS code FROM part UNION SELECT p_brand FROM part")
def code_union(t):
    return t("part").select(F.col("p_type").alias("code")).union(t("part").select("p_brand")).distinct()


@query("SELECT conv_id, count(DISTINCT role) AS num_chapters, count(*) AS num_sections FROM conversations GROUP BY conv_id")
def book_rollup(t):
    return t("conversations").groupBy("conv_id").agg(F.countDistinct("role").alias("num_chapters"), F.count("*").alias("num_sections"))


@query("""SELECT bool_and(s = 'ok') AS healthy, count(CASE WHEN s != 'ok' THEN 1 END) AS failing, string_agg(DISTINCT CASE WHEN s != 'ok' THEN c_mktsegment END, ',' ORDER BY CASE WHEN s != 'ok' THEN c_mktsegment END) AS names
  FROM (SELECT c_mktsegment, CASE WHEN min(c_acctbal) < -999 THEN 'low' ELSE 'ok' END AS s FROM customer GROUP BY 1)""")
def health_summary(t):
    parts = t("customer").groupBy("c_mktsegment").agg(F.when(F.min("c_acctbal") < -999, "low").otherwise("ok").alias("s"))
    return routes.health(parts, "c_mktsegment", "s").withColumn("names", F.nullif("names", F.lit("")))


@query("SELECT d.doc_id, coalesce(CASE l.quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END, 'unknown') AS verdict FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def dictionary_default(t):
    names = t("labels").select("doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("verdict"))
    return merge.backfill(t("documents").select("doc_id"), names, "doc_id", "verdict", "unknown")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE c_mktsegment END AS note FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def backfill_notes(t):
    rows = t("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("note"))
    return merge.backfill(rows, t("customer").select("c_custkey", F.col("c_mktsegment").alias("note")), "c_custkey", "note").select("o_orderkey", "note")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_documents(t):
    return merge.delete_docs(t("documents").select("doc_id", "lang"), t("labels").filter("toxic = 1"))


@query("SELECT conv_id, turn AS chunk_index, role FROM conversations WHERE conv_id = 3 ORDER BY turn")
def reading_order(t):
    return index.reading_order(t("conversations").select("conv_id", F.col("turn").alias("chunk_index"), "role"), 3, "conv_id")


@query("""SELECT CASE WHEN length(trim(coalesce(text, ''))) = 0 THEN 'missing' WHEN n_chars > 5000 THEN 'error' ELSE 'fetched' END AS status, count(*) AS n,
  count(CASE WHEN n_chars > 5000 THEN 1 END) AS pending FROM documents GROUP BY 1""")
def fetch_status(t):
    rows = t("documents").select(listing.fetched(F.col("text"), F.when(F.col("n_chars") > 5000, "too long")).alias("status"))
    again = F.when(listing.pending(F.when(F.col("status") == "error", "retry").otherwise(F.col("status"))), 1)
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.count(again).alias("pending"))


@query("SELECT year(o_orderdate) AS year, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1")
def split_by_year(t):
    """A table written as one directory a year and read again; years without rows have none."""
    from ..sources.scratch import folder

    rows = t("orders").filter(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp")).select("o_orderkey", "o_orderdate")
    path = folder(rows.sparkSession, "years")
    merge.split_years(rows, "o_orderdate", path)
    return rows.sparkSession.read.parquet(path).groupBy(F.col("year").cast("long").alias("year")).agg(F.count("*").alias("n"))


@query(f"WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents) SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS term, count(*) AS tf FROM d GROUP BY 1, 2) WHERE term IN ('the', 'license', 'of', 'absent') GROUP BY term")
def postings_resumed(t):
    """An index that was begun with a third of the documents and finished later; read through its buckets."""
    from ..sources.scratch import folder

    docs = t("documents").select("doc_id", "text")
    index = TextIndex(docs.sparkSession, folder(docs.sparkSession, "postings"), buckets=16)
    index.opened()
    index.update(docs.filter("doc_id % 3 = 0"))
    index.update(docs.join(index.keys(), "doc_id", "left_anti"))
    tfs = F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)
    return index.blocks(dict.fromkeys(["the", "license", "of", "absent"], 0.0)).groupBy("term").agg(F.sum("n").alias("df"), F.sum(tfs).alias("tf"))


def _changed_sql() -> str:
    return """g AS (SELECT doc_id FROM labels WHERE toxic = 1),
      now AS (SELECT d.doc_id, CASE WHEN l.quality = 1 THEN d.text || ' apache revised' ELSE d.text END AS text FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.doc_id NOT IN (FROM g))"""


def _updated_index(t):
    """All documents, then those of good quality with words added, then the toxic ones taken back."""

    def make(spark, path):
        docs, labels = t("documents").select("doc_id", "text"), t("labels")
        index = TextIndex(spark, path, buckets=16)
        index.opened()
        index.update(docs)
        better = docs.join(labels.filter("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
        index.update(better.withColumn("text", F.concat("text", F.lit(" apache revised"))), labels.filter("toxic = 1").select("doc_id").distinct())
        toxic = labels.filter("toxic = 1").select("doc_id").distinct()
        index.update(docs.limit(0), toxic)
        return index

    return once(t("documents"), "text-index-updated", make)


@query(f"""WITH {_changed_sql()}, w AS (SELECT doc_id, {_TOKENS} AS w FROM now),
  c AS (SELECT count(*) AS documents, sum(len(w))::BIGINT AS words FROM w), x AS (SELECT DISTINCT doc_id, unnest(w) AS term FROM w)
  SELECT term, count(*) AS df, any_value(documents) AS documents, any_value(words) AS words FROM x, c GROUP BY term""")
def statistics_after_updates(t):
    """Document frequencies, number of documents and words after an insert, a change and a removal: sums of what each update added or took."""
    index = _updated_index(t)
    n, _ = index.corpus()
    words = sum(g["words"] for g in index.generations())
    return index.all_frequencies().select("term", "df", F.lit(n).cast("long").alias("documents"), F.lit(words).cast("long").alias("words"))


@query(f"""WITH {_changed_sql()}, {_bm25(['apache', 'revised'], 'now')} SELECT doc_id, round(score, 6) AS score FROM b ORDER BY b.score, doc_id LIMIT 25""")
def search_after_updates(t):
    return _updated_index(t).top("apache revised", 25).select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT n_name, CASE WHEN n_regionkey IS NULL THEN 'none' ELSE r_name END AS region, r_regionkey IS NULL AS missing FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3")
def provenance_left(t):
    few = t("region").filter("r_regionkey < 3")
    return t("nation").join(few, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_name", F.col("r_name").alias("region"), F.col("r_regionkey").isNull().alias("missing"))


@query("SELECT 'Customer#000000003' AS wanted, 3::BIGINT AS page_id UNION ALL SELECT 'customer#000000004', 4 UNION ALL SELECT 'nobody', NULL")
def title_resolve(t):
    wanted = t("customer").sparkSession.createDataFrame([("Customer#000000003",), ("customer#000000004",), ("nobody",)], "wanted string")
    return graph.resolve_titles(wanted, t("customer").select(F.col("c_custkey").alias("page_id"), F.col("c_name").alias("title")), "wanted")


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN m.doc_id IS NULL THEN 'new' ELSE 'unchanged' END AS status FROM documents d LEFT JOIN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) m ON m.doc_id = d.doc_id) GROUP BY status""")
def revision_versions(t):
    docs = t("documents").select("doc_id", index.revision_version(F.col("n_chars")).alias("version"))
    return index.version_diff(docs, docs.filter("doc_id % 2 = 0")).groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN left(sha256(o_orderstatus || chr(0)), 32) ELSE o_orderpriority END || '-' ||
  CASE WHEN o_orderkey % 7 = 0 THEN 'no-body' ELSE left(sha256('body' || chr(0)), 8) END || '-v3' AS version FROM orders""")
def body_versions(t):
    k = F.col("o_orderkey")
    return t("orders").select("o_orderkey", index.body_version(F.when(k % 5 != 0, F.col("o_orderpriority")).otherwise(""), F.when(k % 7 != 0, F.lit("body")), F.col("o_orderstatus")).alias("version"))


@query("SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'fresh' ELSE 'kept' END AS result FROM documents LEFT JOIN labels l USING (doc_id)")
def map_reduce_resumed(t):
    """Items that have results keep them; the others are worked on."""
    done = t("documents").join(t("labels"), "doc_id", "left_semi").select("doc_id", F.lit("kept").alias("result"))
    return index.map_reduce(t("documents").select("doc_id"), done, "doc_id", lambda rest: rest.withColumn("result", F.lit("fresh")))


@query("SELECT n_regionkey AS congress, n_nationkey AS kind FROM nation WHERE n_regionkey > 2 OR (n_regionkey = 2 AND n_nationkey > 7)")
def resume_pairs(t):
    """Work that is left after the pair (2, 7)."""
    return listing.after(t("nation").select(F.col("n_regionkey").alias("congress"), F.col("n_nationkey").alias("kind")), ["congress", "kind"], [2, 7])


@query("""SELECT year(o_orderdate) AS year, o_orderkey // 100 AS page, count(*) AS n FROM orders WHERE year(o_orderdate) > 1996 OR (year(o_orderdate) = 1996 AND o_orderkey // 100 > 3) GROUP BY 1, 2""")
def resume_year_page(t):
    pages = t("orders").select(F.year("o_orderdate").cast("long").alias("year"), F.floor(F.col("o_orderkey") / 100).alias("page"))
    return listing.after(pages, ["year", "page"], [1996, 3]).groupBy("year", "page").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, concat_ws(' > ', nullif(trim(p_brand), ''), nullif(p_type, '')) AS label FROM part")
def doc_titles(t):
    return t("part").select("p_partkey", F.concat_ws(" > ", T.blank_to_null(T.strip_all(F.col("p_brand"))), T.blank_to_null(F.col("p_type"))).alias("label"))


# ---- documents to index, and records in XML ----------------------------------------------------

_HASH = "left(sha256({}), 32) || '-v3'"
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(f"""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang || ' head' END AS h, {_TRIM.format("text")} AS c, source FROM documents)
  SELECT doc_id::VARCHAR AS doc_id, CASE WHEN h = '' THEN 'Title ' || doc_id % 50 || ' § ' || source ELSE h END AS title, {_HASH.format("h || chr(0) || c || chr(0)")} AS version, md5(c) AS body FROM r WHERE c != ''""")
def regulation_docs(t):
    rows = t("documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 50).alias("title_num"), F.col("source").alias("section"), F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.concat(F.lit(" "), "lang", F.lit(" head"))).alias("heading"), F.col("text").alias("content"))
    return builders.regulations(rows).select("doc_id", "title", "version", F.md5("text").alias("body"))


@query(f"""SELECT 'c' || doc_id AS doc_id, CASE WHEN doc_id % 2 = 0 THEN 'c' || doc_id ELSE source || ' x' END AS title, {_HASH.format("text || chr(0)")} AS version, md5(text) AS body FROM documents WHERE {_TRIM.format("text")} != ''""")
def law_docs(t):
    rows = t("documents").select(F.concat(F.lit("c"), "doc_id").alias("celex"), F.when(F.col("doc_id") % 2 == 1, F.concat("source", F.lit("   x "))).alias("name"), F.col("text").alias("body"))
    return builders.laws(rows).select("doc_id", "title", "version", F.md5("text").alias("body"))


@query(f"""WITH r AS (SELECT p_partkey AS k, p_type AS t, CASE WHEN p_partkey % 2 = 0 THEN 'know ' || p_name ELSE '' END AS o, p_name AS b FROM part WHERE p_partkey % 5 != 0)
  SELECT 's' || k AS doc_id, CASE WHEN k % 3 = 0 THEN 's' || k ELSE 'book' END AS title, {_HASH.format("t || chr(0) || o || chr(0) || b || chr(0)")} AS version,
  t || chr(10) || chr(10) || CASE WHEN o != '' THEN 'Learning objectives:' || chr(10) || o || chr(10) || chr(10) ELSE '' END || b AS text, CASE WHEN k % 4 = 0 THEN t ELSE 'ch — ' || t END AS section FROM r""")
def textbook_docs(t):
    k = F.col("p_partkey")
    rows = t("part").select(F.concat(F.lit("s"), k).alias("section_id"), F.when(k % 3 != 0, "book ").alias("book_title"), F.when(k % 4 == 0, "").otherwise("ch").alias("chapter_title"), F.col("p_type").alias("title"), F.when(k % 2 == 0, F.concat(F.lit("know "), "p_name")).alias("objectives"), F.when(k % 5 == 0, "  ").otherwise(F.col("p_name")).alias("body"))
    return builders.textbook_sections(rows)


@query(f"""WITH r AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name || ' & co' END AS t, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_type END AS a FROM part)
  SELECT 'W' || k AS doc_id, CASE WHEN t = '' THEN 'W' || k ELSE t END AS title, {_HASH.format("t || chr(0) || a || chr(0)")} AS version, concat_ws(chr(10) || chr(10), nullif(t, ''), nullif(a, '')) AS text FROM r WHERE t != '' OR a != ''""")
def work_docs(t):
    k = F.col("p_partkey")
    rows = t("part").select(F.concat(F.lit("https://host/W"), k).alias("id"), F.when(k % 3 != 0, F.concat("p_name", F.lit(" &amp;  co"))).alias("title"), F.when(k % 2 != 0, F.col("p_type")).alias("abstract"))
    return builders.works(rows).select("doc_id", "title", "version", "text")


@query(f"""SELECT 'r/' || doc_id AS doc_id, source AS title, {_HASH.format("text || chr(0)")} AS version, CASE WHEN contains(text, '<') OR contains(text, '&') THEN 'with tags' ELSE md5(text) END AS body FROM documents
  WHERE doc_id % 3 != 0 AND {_TRIM.format("text")} != '' AND NOT (length(text) >= 10000 AND ((length(text) - length(replace(text, '](', ''))) // 2) * 1000 >= 8 * length(text))""")
def readme_docs(t):
    """Whole texts; of those with tags or entities SQL can't tell the body, so it isn't compared."""
    rows = t("documents").select(F.concat(F.lit("r/"), "doc_id").alias("repo"), F.col("source").alias("name"), F.col("text").alias("readme"), F.when(F.col("doc_id") % 3 != 0, "fetched").otherwise("error").alias("status"))
    made = builders.readmes(rows).join(rows.select(F.col("repo").alias("doc_id"), F.col("readme").rlike("[<&]").alias("tags")), "doc_id")
    return made.select("doc_id", "title", "version", F.when(F.col("tags"), "with tags").otherwise(F.md5("text")).alias("body"))


@query(f"""SELECT c_custkey::VARCHAR AS doc_id, c_name || ' 10-K 2024-01-31' AS title, {_HASH.format("'body of ' || c_name || chr(0)")} AS version, 'body of ' || c_name AS text FROM customer WHERE c_custkey % 2 = 0""")
def filing_docs(t):
    k = F.col("c_custkey")
    rows = t("customer").select(k.alias("accession_number"), F.col("c_name").alias("company_name"), F.lit("10-K").alias("form_type"), F.lit("2024-01-31").alias("filed"), F.concat(F.lit("body of "), "c_name").alias("body"), F.when(k % 2 == 0, "fetched").alias("status"))
    return builders.filings(rows).select("doc_id", "title", "version", "text")


@query("""SELECT c_custkey::VARCHAR AS doc_id, c_name AS title, c_custkey * 7 || '-v3' AS version, c_mktsegment || ' text' AS text FROM customer WHERE c_custkey % 4 != 0 AND c_custkey % 5 != 0""")
def article_docs(t):
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, "#REDIRECT [[x]]").otherwise(F.concat(F.lit("{{stub}}[["), "c_mktsegment", F.lit("]] text")))
    rows = t("customer").select(k.alias("page_id"), F.when(k % 5 == 0, 14).otherwise(0).alias("namespace"), F.col("c_name").alias("title"), (k * 7).alias("revision_id"), text.alias("text"))
    return builders.articles(rows).select("doc_id", "title", "version", "text")


@query(f"""SELECT p_partkey::VARCHAR AS doc_id, p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN left(sha256(p_name || chr(0) || 'abs ' || p_type || chr(0) || '2020' || chr(0)), 32) ELSE '2024' END || '-' ||
  CASE WHEN p_partkey % 2 = 0 THEN left(sha256('<p>' || p_brand || '</p>' || chr(0)), 8) WHEN p_partkey % 7 = 0 THEN left(sha256('pdf' || chr(0)), 8) ELSE 'no-body' END || '-v3' AS version,
  CASE WHEN p_partkey % 2 = 0 THEN p_brand WHEN p_partkey % 7 = 0 THEN 'pdf' ELSE 'abs ' || p_type END AS text FROM part""")
def paper_docs(t):
    k = F.col("p_partkey")
    rows = t("part").select(
        k.alias("id"), F.concat(F.lit(" "), "p_name").alias("title"), F.concat(F.lit("abs "), "p_type").alias("abstract"), F.when(k % 2 == 0, F.concat(F.lit("<p>"), "p_brand", F.lit("</p>"))).alias("html"),
        F.when(k % 7 == 0, "pdf").alias("pdf_text"), F.when(k % 3 == 0, "").otherwise("2024").alias("datestamp"), F.lit("2020").alias("updated"),
    )
    return builders.papers(rows).select("doc_id", "title", "version", "text")


@query("""SELECT '118-hr-' || n_nationkey AS bill_id, 118 AS congress, 'hr' AS bill_type, n_nationkey::VARCHAR AS bill_number, n_name || ' & co' AS title, 'Rep. ' || n_regionkey AS sponsor, '2024-01-02' AS introduced_date,
  'Referred' AS latest_action, 'Energy' AS policy_area, 'Tax; ' || n_name AS subjects, 'The last ' || n_name AS summary FROM nation""")
def bill_records(t):
    n = F.col("n_name")
    xml = F.concat(
        F.lit("<billStatus><version>3</version><bill><congress>118</congress><type>hr</type><number>"), "n_nationkey", F.lit("</number><introducedDate>2024-01-02</introducedDate><title> "), n, F.lit(" &amp; co</title><sponsors><item><fullName>Rep. "), "n_regionkey",
        F.lit("</fullName></item></sponsors><latestAction><text>Referred</text></latestAction><policyArea><name>Energy</name></policyArea><subjects><item><name>Tax</name></item><item><name>"), n, F.lit("</name></item><item><name>Tax</name></item></subjects>"),
        F.lit("<summaries><summary><text>first</text></summary><summary><text><![CDATA[<p>The <b>last</b> "), n, F.lit("</p>]]></text></summary></summaries></bill></billStatus>"),
    )
    broken = t("region").select(F.lit("<billStatus><bill>").alias("text"))
    return archives.bills(t("nation").select(xml.alias("text")).union(broken))


@query("""SELECT n_nationkey AS title_num, 'Chapter I' AS chapter, 'Part ' || s AS part, n_nationkey || '.' || s AS section, n_name AS heading, 'one' || chr(10) || 'two ' || s AS content FROM nation, range(1, 3) x(s)""")
def regulation_records(t):
    section = lambda s: F.concat(F.lit(f'<DIV5 TYPE="PART"><HEAD>Part {s}</HEAD><DIV8 TYPE="SECTION" N="'), "n_nationkey", F.lit(f'.{s}"><HEAD> '), "n_name", F.lit(f"</HEAD><P>one</P><X><P> t<I>wo</I> {s}</P></X><P> </P></DIV8></DIV5>"))
    xml = F.concat(F.lit('<ECFR><DIV1 TYPE="TITLE"><DIV3 TYPE="CHAPTER"><HEAD>Chapter I</HEAD>'), section(1), section(2), F.lit("</DIV3></DIV1></ECFR>"))
    rows = t("nation").select(F.col("n_nationkey").alias("title_num"), xml.alias("xml")).union(t("region").select("r_regionkey", F.lit("<ECFR><broken>")))
    return xmlrows.regulation_sections(rows, ["title_num"], "xml")


@query("""SELECT n_nationkey AS title_num, '§ 1.' AS section, n_name AS heading, '§ 1. ' || n_name || ' Whole text' AS content FROM nation""")
def code_records(t):
    xml = F.concat(F.lit('<uslm xmlns="http://x/uslm"><main><section><num>§ 1.</num> <heading>'), "n_name", F.lit("</heading><content>  Whole <b>text</b></content></section><section> </section></main></uslm>"))
    return xmlrows.code_sections(t("nation").select(F.col("n_nationkey").alias("title_num"), xml.alias("xml")), ["title_num"], "xml")


@query("""SELECT 0::BIGINT AS without_vector, 0::BIGINT AS without_postings, count(*) AS documents, count(CASE WHEN conv_id % 3 = 0 THEN 1 END) AS second_version FROM conversations WHERE trim(coalesce(text, '')) != ''""")
def index_tables_kept(t):
    """An index of half the turns, then of all with some changed: every chunk has its vector and its postings, and no old ones."""
    from ..functions import chunking
    from ..functions.vector import hashed_embedding
    from ..sources.scratch import written

    turns = t("conversations")
    spark = turns.sparkSession
    changed = F.col("conv_id") % 3 == 0
    docs = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.col("role").alias("title"), F.lit("v1").alias("version"), "text", changed.alias("changed"))
    empty = {
        "chunks": "doc_id long, section string, chunk_index int, text string, text_length int, chunk_id string", "vectors": "chunk_id string, doc_id long, embedding array<float>",
        "postings": "term string, chunk_id string, doc_id long, tf long", "meta": "doc_id long, version string, title string, chunk_count long, indexed_at string",
    }
    old = {name: spark.createDataFrame([], schema) for name, schema in empty.items()}
    cut = lambda d: written(chunking.chunks(d, "text", chunking.Profile(300, 360, 30)), "index-chunks")
    embed = lambda title, text: hashed_embedding(search.document_tokens(T.embed_input(title, F.lit(""), text)), 8)
    for part in (docs.filter("doc_id % 2 = 0"), docs.withColumn("version", F.when(F.col("changed"), "v2").otherwise("v1"))):
        old = {name: written(rows, f"index-{name}") for name, rows in index.index_tables(part.drop("changed"), old, cut, embed, search.document_tokens).items()}
    lacks = lambda name: F.count(F.when(F.col(name).isNull(), 1)).alias(f"without_{name}")
    one = lambda name: old[name].groupBy("chunk_id").agg(F.count("*").alias(name.rstrip("s") if name == "vectors" else name))
    chunks = old["chunks"].select("chunk_id", F.size(search.document_tokens(F.col("text"))).alias("words"))
    both = chunks.filter("words > 0").join(one("vectors"), "chunk_id", "full").join(one("postings"), "chunk_id", "full").agg(lacks("vector"), lacks("postings"))
    return both.crossJoin(old["meta"].agg(F.count("*").alias("documents"), F.count(F.when(F.col("version") == "v2", 1)).alias("second_version")))


@query("""SELECT r_regionkey AS book, 'B ' || r_name AS book_title, n::INTEGER AS chapter_number, CASE WHEN n IS NOT NULL THEN 'Chapter ' || n END AS chapter_title, m AS module_id, p::INTEGER AS place
  FROM region, (VALUES (NULL, 'm0', 0), (1, 'm1', 1), (1, 'm2', 2), (2, 'm3', 3)) x(n, m, p)""")
def textbook_contents(t):
    chapter = lambda n, *names: f"<subcollection><title>Chapter {n}</title><content>{''.join(f'<module document={chr(34)}{m}{chr(34)}/>' for m in names)}</content></subcollection>"
    xml = F.concat(F.lit("<collection><metadata><title>B "), "r_name", F.lit(f'</title></metadata><content><module document="m0"/>{chapter(1, "m1", "m2")}{chapter(2, "m3")}</content></collection>'))
    rows = xmlrows.book_contents(t("region").select(F.col("r_regionkey").alias("book"), xml.alias("xml")), ["book"], "xml")
    return rows.select("book", "book_title", "chapter_number", "chapter_title", "module_id", "place")


@query("SELECT r_regionkey AS id, 'act' AS kind, 'A-' || r_regionkey AS number, r_name || ' Act' AS short_title, 'An Act about ' || r_name AS long_title, 'yes' AS in_force FROM region")
def act_records(t):
    xml = F.concat(F.lit('<Act in-force="yes"><Identification><LongTitle>An Act about <b>'), "r_name", F.lit("</b></LongTitle><ShortTitle>"), "r_name", F.lit(" Act</ShortTitle><Chapter><ConsolidatedNumber>A-"), "r_regionkey", F.lit("</ConsolidatedNumber></Chapter></Identification></Act>"))
    rows = xmlrows.acts(t("region").select(F.col("r_regionkey").alias("id"), xml.alias("xml")), ["id"], "xml")
    return rows.select("id", "kind", "number", "short_title", "long_title", "in_force")


@query("SELECT c_custkey, '## Abstract' || chr(10) || chr(10) || c_name || ' has $x^2$.' || chr(10) || chr(10) || '- ' || c_mktsegment || chr(10) || '- [1]' || chr(10) AS markdown FROM customer")
def paper_pages(t):
    html = F.concat(F.lit('<body><nav>menu</nav><article class="ltx_document"><h1>Title</h1><h6 class="ltx_title_abstract">Abstract</h6><p>'), "c_name", F.lit(' has <math alttext="x^2"/>.</p><ul><li>'), "c_mktsegment", F.lit('</li><li><cite>[<a href="#b1">1</a>]</cite></li></ul></article></body>'))
    return spread(t("customer").select("c_custkey", "c_name", "c_mktsegment")).select("c_custkey", markup.paper_to_markdown(html).alias("markdown"))
