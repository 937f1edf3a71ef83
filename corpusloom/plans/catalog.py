"""Registered queries over whole tables, each with its equivalent SQL where SQL can express it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import chunking, markup, stemming
from ..functions import text as T
from ..functions.vector import l2
from ..operators import graph, index, listing, merge, quality, retrieve, search
from ..streaming import incremental
from . import functions, pages, resumes  # noqa: F401  they register theirs
from .indexes import text_index, trigram_index, vector_index
from .registry import ORACLE_SQL, QUERIES, query, table  # noqa: F401


# ---- listing ----------------------------------------------------------------------------------


@query("""SELECT o_orderkey, o_custkey, o_totalprice, count(*) OVER () AS total FROM orders
          WHERE o_orderstatus = 'O' AND o_totalprice BETWEEN 1000 AND 400000 AND o_orderdate >= TIMESTAMP '1995-01-01'
          ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 20""")
def list_orders_filtered(t):
    c = F.col
    rows = listing.where(t("orders"), listing.equals(c("o_orderstatus"), "O"), listing.between(c("o_totalprice"), 1000, 400000), listing.between(c("o_orderdate"), F.lit("1995-01-01").cast("timestamp")))
    return listing.page(rows, [F.desc("o_orderdate"), c("o_orderkey")], 50, 20).select("o_orderkey", "o_custkey", "o_totalprice", "total")


@query("""SELECT doc_id, source, n_chars, count(*) OVER () AS total FROM documents WHERE lang = 'en'
          ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 50""")
def list_total_page(t):
    rows = listing.where(t("documents").select("doc_id", "source", "n_chars", "lang"), listing.equals(F.col("lang"), "en"))
    return listing.page(rows, [F.desc("n_chars"), F.col("doc_id")], 25, 50).select("doc_id", "source", "n_chars", "total")


@query("SELECT lang, count(*) AS n FROM documents WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'license') GROUP BY lang")
def substring_ascii_ci(t):
    return t("documents").filter(listing.contains_ascii(F.col("text"), "LICENSE")).groupBy("lang").agg(F.count("*").alias("n"))


@query("""SELECT year(o_orderdate) AS y, count(*) AS n, count(CASE WHEN year(o_orderdate) = 1997 THEN 1 END) AS n_1997 FROM orders GROUP BY 1""")
def year_filter(t):
    d = F.col("o_orderdate")
    return t("orders").groupBy(T.year_of(d.cast("string")).cast("long").alias("y")).agg(F.count("*").alias("n"), F.count(F.when(listing.in_year(d, 1997), 1)).alias("n_1997"))


@query("""SELECT p_partkey, p_name FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda x: x = 'red' OR starts_with(x, 'red.'))) > 0""")
def token_archive_match(t):
    return t("part").filter(listing.has_token(F.col("p_name"), "red")).select("p_partkey", "p_name")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'purchase') GROUP BY event_type")
def multi_value_in(t):
    return listing.where(t("events"), listing.any_of(F.col("event_type"), ["click", "purchase"]), listing.any_of(F.col("user_id"), [])).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def embedded_true(t):
    return listing.embedded(t("documents"), t("labels"), "doc_id", True).select("doc_id", "source")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def embedded_false(t):
    return listing.embedded(t("documents"), t("labels"), "doc_id", False).select("doc_id", "source")


@query("""SELECT d.doc_id, l.quality IS NOT DISTINCT FROM 1 AS good, l.quality IS NULL OR l.quality = 0 AS pending
          FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS DISTINCT FROM 1""")
def null_safe_status(t):
    both = t("documents").select("doc_id").join(t("labels"), "doc_id", "left").filter(~F.col("toxic").eqNullSafe(1))
    return both.select("doc_id", F.col("quality").eqNullSafe(1).alias("good"), (F.col("quality").isNull() | (F.col("quality") == 0)).alias("pending"))


@query("""SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000)""")
def exists_author(t):
    return t("customer").join(t("orders").filter("o_totalprice > 450000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


# ---- joins and aggregates ---------------------------------------------------------------------


@query("""SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer
          JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""")
def join_dim_3way(t):
    joined = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""SELECT l_orderkey, l_linenumber, coalesce(s_name, c_name) AS party FROM lineitem
          LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0 LEFT JOIN customer ON l_suppkey = c_custkey""")
def double_left_coalesce(t):
    s = t("supplier").filter("s_acctbal > 0")
    return t("lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left").join(t("customer"), F.col("l_suppkey") == F.col("c_custkey"), "left").select("l_orderkey", "l_linenumber", F.coalesce("s_name", "c_name").alias("party"))


@query("""SELECT conv_id, string_agg(role, ',' ORDER BY turn, role) AS roles, count(*) AS turns FROM conversations GROUP BY conv_id""")
def ordered_collect(t):
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return t("conversations").groupBy("conv_id").agg(F.array_join(roles, ",").alias("roles"), F.count("*").alias("turns"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def group_count_ordered(t):
    return t("documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query("SELECT count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs, count(*) AS n FROM documents")
def count_distinct(t):
    return t("documents").agg(F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs"), F.count("*").alias("n"))


@query("SELECT user_id, min(value) AS best, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY user_id")
def min_per_group(t):
    return t("events").groupBy("user_id").agg(F.min("value").alias("best"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("SELECT user_id, arg_min(event_type, event_id) AS first_type FROM events GROUP BY user_id")
def first_wins(t):
    return t("events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type"))


@query("""WITH u AS (SELECT c_custkey AS id, c_name AS name, 'customer' AS kind, c_mktsegment AS segment FROM customer
                     UNION ALL SELECT s_suppkey, s_name, 'supplier', NULL FROM supplier)
          SELECT *, count(*) OVER () AS total FROM u ORDER BY name, id LIMIT 100""")
def union_all_branches(t):
    a = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("customer").alias("kind"), F.col("c_mktsegment").alias("segment"))
    b = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind"), F.lit(None).cast("string").alias("segment"))
    return listing.page(a.unionByName(b), [F.col("name"), F.col("id")], 100)


@query("""SELECT l_shipdate IS NOT NULL AS dated, CASE WHEN l_quantity < 10 THEN 'small' ELSE 'large' END AS action, count(*) AS n,
                 list_sort(list(l_orderkey * 10 + l_linenumber))[1:3]::VARCHAR AS examples FROM lineitem GROUP BY 1, 2""")
def counts_with_examples(t):
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    kind = F.when(F.col("l_quantity") < 10, "small").otherwise("large")
    # A group's three smallest keys: the smallest, and those of what is left in windows that keep three rows of each task.
    rows = t("lineitem").select(F.col("l_shipdate").isNotNull().alias("dated"), kind.alias("action"), key.alias("k"))
    order = Window.partitionBy("dated", "action").orderBy("k")
    first = rows.withColumn("place", F.row_number().over(order)).filter("place <= 3").groupBy("dated", "action").agg(F.array_sort(F.collect_list("k")).alias("examples"))
    n = rows.groupBy("dated", "action").agg(F.count("*").alias("n"))
    return n.join(first, ["dated", "action"]).select("dated", "action", "n", F.concat(F.lit("["), F.array_join("examples", ", "), F.lit("]")).alias("examples"))


# ---- upserts ----------------------------------------------------------------------------------

_HALVES = """WITH o AS (SELECT o_orderkey AS id, o_totalprice AS price, year(o_orderdate) AS version FROM orders WHERE o_orderkey % 3 != 0 OR o_orderkey % 2 = 1),
n AS (SELECT o_orderkey AS id, o_totalprice + 1 AS price, CASE WHEN o_orderkey % 4 = 0 THEN year(o_orderdate) ELSE year(o_orderdate) + 1 END AS version, o_orderkey % 7 AS seq
      FROM orders WHERE o_orderkey % 2 = 0) """


def _halves(t):
    """An old and a new table out of orders, which overlap."""
    k, year = F.col("o_orderkey"), F.year("o_orderdate").cast("long")
    old = t("orders").filter((k % 3 != 0) | (k % 2 == 1)).select(k.alias("id"), F.col("o_totalprice").alias("price"), year.alias("version"))
    new = t("orders").filter(k % 2 == 0).select(k.alias("id"), (F.col("o_totalprice") + 1).alias("price"), F.when(k % 4 == 0, year).otherwise(year + 1).alias("version"))
    return old, new


@query(_HALVES + "SELECT id, price, version FROM n UNION ALL SELECT id, price, version FROM o WHERE id NOT IN (SELECT id FROM n)")
def upsert_last_wins(t):
    return merge.upsert(*_halves(t), ["id"], "version")


@query(_HALVES + "SELECT id, price, version FROM o UNION ALL SELECT id, price, version FROM n WHERE id NOT IN (SELECT id FROM o)")
def insert_ignore(t):
    return merge.insert_ignore(*_halves(t), ["id"], "version")


@query(_HALVES + """, a AS (SELECT CASE WHEN o.id IS NULL THEN 'inserted' WHEN n.id IS NULL THEN 'kept' WHEN o.version IS NOT DISTINCT FROM n.version THEN 'skipped' ELSE 'updated' END AS action
          FROM o FULL JOIN n ON o.id = n.id) SELECT action, count(*) AS n FROM a GROUP BY action""")
def change_classify(t):
    return merge.classify_changes(*_halves(t), ["id"], "version").groupBy("action").agg(F.count("*").alias("n"))


@query(_HALVES + """SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN n.price ELSE o.price END AS price,
          CASE WHEN n.id IS NOT NULL AND (o.id IS NULL OR o.version IS DISTINCT FROM n.version) THEN n.version ELSE o.version END AS version FROM o FULL JOIN n ON o.id = n.id""")
def change_upsert(t):
    return merge.change_upsert(*_halves(t), ["id"], "version", ["price"])


@query(_HALVES + "SELECT id, price, version FROM o WHERE version NOT IN (SELECT version FROM n WHERE version > 2000) UNION ALL SELECT id, price, version FROM n WHERE version > 2000")
def replace_partition(t):
    old, new = _halves(t)
    return merge.replace_partition(old, new.filter("version > 2000"), ["version"])


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS)
          OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last_signup FROM events""")
def carry_forward(t):
    rows = t("events").select("event_id", "user_id", F.when(F.col("event_type") == "signup", F.col("event_id")).alias("last_signup"))
    return merge.carry_forward(rows, ["user_id"], ["event_id"], ["last_signup"])


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS position FROM conversations")
def position_in_group(t):
    return merge.number_rows(t("conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn", "role"], start=0).withColumn("position", F.col("position").cast("long"))


# ---- text and identity ------------------------------------------------------------------------


@query("SELECT doc_id, substr(sha256(coalesce(lang, '') || chr(0) || coalesce(text, '') || chr(0)), 1, 32) AS hash FROM documents")
def content_hash(t):
    return t("documents").select("doc_id", T.content_hash(F.col("lang"), F.col("text")).alias("hash"))


@query("""WITH d AS (SELECT doc_id, substr(sha256(text || chr(0)), 1, 32) || '-v3' AS version FROM documents),
          m AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE version END AS version FROM d WHERE doc_id % 3 != 0 UNION ALL SELECT -1, 'x'),
          s AS (SELECT CASE WHEN m.doc_id IS NULL THEN 'new' WHEN d.doc_id IS NULL THEN 'gone' WHEN d.version = m.version THEN 'unchanged' ELSE 'updated' END AS status
                FROM d FULL JOIN m ON d.doc_id = m.doc_id) SELECT status, count(*) AS n FROM s GROUP BY status""")
def version_diff(t):
    docs = t("documents").select("doc_id", index.hash_version(F.col("text")).alias("version"))
    meta = docs.filter("doc_id % 3 != 0").withColumn("version", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("version")))
    gone = docs.sparkSession.createDataFrame([(-1, "x")], docs.schema)
    return index.version_diff(docs, meta.unionByName(gone)).groupBy("status").agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS clean FROM documents""")
def normalize_ws(t):
    return t("documents").select("doc_id", F.md5(T.normalize_whitespace(F.col("text"))).alias("clean"))


@query()
def strip_md(t):
    return t("documents").select("doc_id", F.length(T.strip_markdown(F.col("text"))).alias("n"))


@query(r"""WITH w AS (SELECT doc_id, '[[Category:' || lang || '_texts|' || doc_id || ']] ' || '[[category: ' || source || ']] [[Category:' || source || ']]' AS w FROM documents),
          c AS (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(w, '(?i)\[\[\s*category\s*:\s*([^\]|]+)', 1), lambda x: upper(replace(trim(x), '_', ' ')[1]) || replace(trim(x), '_', ' ')[2:]))) AS category FROM w)
          SELECT category, count(*) AS n FROM c GROUP BY category""")
def categories_extract(t):
    wiki = F.concat(F.lit("[[Category:"), F.col("lang"), F.lit("_texts|"), F.col("doc_id").cast("string"), F.lit("]] [[category: "), F.col("source"), F.lit("]] [[Category:"), F.col("source"), F.lit("]]"))
    return t("documents").select(F.explode(T.categories(wiki)).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS body FROM pages")
def strip_tags_pages(t):
    return t("pages").select("page_id", T.strip_tags(F.col("html")).alias("body"))


@query()
def strip_html_pages(t):
    return t("pages").select("page_id", markup.html_to_text("html").alias("text"))


@query()
def html_markdown_pages(t):
    return t("pages").select("page_id", markup.html_to_markdown("html").alias("markdown"))


@query()
def chunk_documents(t):
    return chunking.chunks(t("documents"), "text", chunking.DENSE)


@query()
def chunk_pages_markdown(t):
    pages = t("pages").select(F.col("page_id").alias("doc_id"), markup.html_to_markdown("html").alias("text"))
    return chunking.chunks(pages, "markdown", chunking.WIKI)


@query("SELECT 0 AS over_cap, 0 AS not_in_text, (SELECT count(*) FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) != '') AS documents")
def chunk_stats(t):
    """Invariants of chunking: no chunk beyond the cap, none with words that its document lacks, no document lost."""
    cut = chunking.chunks(t("documents"), "text", chunking.DENSE)
    per_doc = cut.groupBy("doc_id").agg(F.count(F.when(F.col("text_length") > chunking.DENSE.cap, 1)).alias("over"), F.count("*").alias("n"))
    every = cut.join(t("documents").select("doc_id", T.normalize_whitespace(F.col("text")).alias("clean")), "doc_id")
    lacking = every.filter(~F.col("clean").contains(F.col("text"))).agg(F.count("*").cast("int").alias("not_in_text"))
    return per_doc.agg(F.sum("over").cast("int").alias("over_cap"), F.count("*").alias("documents")).crossJoin(lacking)


@query(r"""SELECT source, sum(len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x != ''))) ::BIGINT AS tokens FROM documents GROUP BY source""")
def token_counts(t):
    return t("documents").groupBy("source").agg(F.sum(F.size(search.document_tokens(F.col("text")))).alias("tokens"))


@query("""WITH w AS (SELECT p_partkey, p_brand, string_split(CASE p_partkey % 3 WHEN 0 THEN 'one' WHEN 1 THEN p_name ELSE p_name || ' ' || p_type END, ' ') AS w FROM part)
  SELECT p_partkey, w[-1] AS keyname, nullif(array_to_string(w[:-2], ' '), '') AS forenames, lower(replace(p_brand, '#', '-')) AS slug FROM w""")
def name_parts(t):
    """Names of one, two and more words, with more spaces than they need."""
    kind, name = F.col("p_partkey") % 3, F.col("p_name")
    names = t("part").withColumn("name", F.when(kind == 0, "one ").when(kind == 1, name).otherwise(F.concat(F.lit(" "), name, F.lit("  "), "p_type")))
    return names.select("p_partkey", T.name_parts(F.col("name")).alias("x"), T.slugify(F.col("p_brand")).alias("slug")).select("p_partkey", "x.*", "slug")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(t):
    return t("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS pos FROM part)
          SELECT p_partkey, string_agg(word, ' ' ORDER BY pos, word) AS abstract FROM w GROUP BY p_partkey""")
def inverted_index_rebuild(t):
    words = F.split("p_name", " ")
    placed = F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i) == w))))
    return t("part").select("p_partkey", T.abstract_from_index(placed).alias("abstract"))


@query("""SELECT doc_id, CASE WHEN length(text) >= 10000 AND ((length(text) - length(replace(text, '](', ''))) // 2) * 1000 >= 8 * length(text) THEN 'link_dump'
          WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 150 THEN 'too_short'
          WHEN length(trim(regexp_replace(trim(regexp_replace(regexp_replace(text, '!\\[.*?\\]\\(.*?\\)', '', 'g'), '\\s+', ' ', 'g')), '[#*_\\[\\]()`~\\->|]', '', 'g'))) < 100 THEN 'image_only'
          WHEN length(regexp_replace(substr(text, 1, 2000), '[\\s<>"''=]+', '', 'g')) >= 50 AND
               length(regexp_replace(regexp_replace(substr(text, 1, 2000), '[\\s<>"''=]+', '', 'g'), '[\\x00-\\x7F]', '', 'g')) / length(regexp_replace(substr(text, 1, 2000), '[\\s<>"''=]+', '', 'g')) > 0.4 THEN 'non_english'
          END AS reason FROM documents""".replace("\\\\", "\\"))
def quality_classify(t):
    return t("documents").select("doc_id", quality.classify(F.col("text")).alias("reason"))


@query(r"""SELECT count(*) AS n, count(CASE WHEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 150 OR contains(lower(text), 'withdrawn by the author') THEN 1 END) AS junk FROM documents""")
def junk_filter(t):
    return t("documents").agg(F.count("*").alias("n"), F.count(F.when(quality.is_junk(F.col("text")), 1)).alias("junk"))


# ---- search -----------------------------------------------------------------------------------

_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x != '')"


def _words(t):
    return t("documents").select("doc_id", search.document_tokens(F.col("text")).alias("w"))


@query(rf"""WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
  c AS (SELECT doc_id, len(w) AS dl, len(list_filter(w, lambda x: x = 'license')) AS f1, len(list_filter(w, lambda x: x = 'the')) AS f2 FROM d),
  s AS (SELECT count(*) AS n, avg(dl) AS a, count(CASE WHEN f1 > 0 THEN 1 END) AS d1, count(CASE WHEN f2 > 0 THEN 1 END) AS d2 FROM c)
  SELECT doc_id, round(-(CASE WHEN ln((n - d1 + 0.5) / (d1 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d1 + 0.5) / (d1 + 0.5)) END * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / a))
     + CASE WHEN ln((n - d2 + 0.5) / (d2 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d2 + 0.5) / (d2 + 0.5)) END * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score
  FROM c, s WHERE f1 > 0 AND f2 > 0""")
def bm25_scores(t):
    hits = search.bm25_scan(t("documents"), "doc_id", search.document_tokens(F.col("text")), ["license", "the"])
    return hits.select("doc_id", F.round("score", 6).alias("score"))


@query(ORACLE_SQL["bm25_scores"] + " ORDER BY score, doc_id LIMIT 20")
def bm25_topk(t):
    hits = text_index(t("documents")).matches("license the").select("doc_id", F.round("score", 6).alias("score"))
    return hits.orderBy("score", "doc_id").limit(20)


@query(rf"""WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
  c AS (SELECT doc_id, len(w) AS dl, len(list_filter(w, lambda x: x IN ('license', 'licensed', 'licenses', 'licensing', 'licens'))) AS f FROM d),
  s AS (SELECT count(*) AS n, avg(dl) AS a, count(CASE WHEN f > 0 THEN 1 END) AS df FROM c)
  SELECT doc_id, round(-(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score FROM c, s WHERE f > 0""")
def bm25_stemmed(t):
    """A stored index of folded stems; a query's words are stemmed alike."""
    index = text_index(t("documents"), name="stems", stem=lambda w: stemming.stem(stemming.fold(w)))
    return index.matches("Licensed").select("doc_id", F.round("score", 6).alias("score"))


@query(rf"WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents) SELECT doc_id FROM d WHERE list_contains(w, 'license') AND list_contains(w, 'apache')")
def fts_and(t):
    return text_index(t("documents")).matches("license apache").select("doc_id")


@query(rf"WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents) SELECT doc_id FROM d WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' general public license ')")
def fts_phrase(t):
    return _words(t).filter(search.has_phrase(F.col("w"), "general public license")).select("doc_id")


@query(rf"WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents) SELECT doc_id FROM d WHERE len(list_filter(w, lambda x: starts_with(x, 'licen'))) > 0")
def fts_prefix(t):
    return _words(t).filter(search.has_prefix(F.col("w"), "licen")).select("doc_id")


@query(rf"""WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents) SELECT doc_id FROM d
  WHERE (list_contains(w, 'apache') OR list_contains(w, 'mit')) AND NOT list_contains(w, 'the')""")
def fts_or_not(t):
    return _words(t).filter((search.has_words(F.col("w"), ["apache"]) | search.has_words(F.col("w"), ["mit"])) & ~search.has_words(F.col("w"), ["the"])).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'apache lic')")
def trigram_match(t):
    return t("documents").filter(search.trigram(F.col("text"), "Apache Lic")).select("doc_id")


_PARTS = ["Apache Lic", "http", "ation of", "zzzz", "th"]


@query("SELECT part, doc_id FROM documents, (SELECT unnest(['Apache Lic', 'http', 'ation of', 'zzzz', 'th']) AS part) WHERE length(part) >= 3 AND contains(lower(text), lower(part))")
def trigram_index_match(t):
    """Substrings by the stored index of three-character pieces; shorter ones are in no text."""
    docs = t("documents").select("doc_id", "text")
    index = trigram_index(docs, "doc_id", "text", "documents")
    found = [index.containing(docs, part).select(F.lit(part).alias("part"), "doc_id") for part in _PARTS]
    return reduce(lambda a, b: a.unionByName(b), found)


_POINT = [round(((i * 37) % 64 - 31) / 64, 6) for i in range(64)]
_POINT_SQL = "[" + ", ".join(map(str, _POINT)) + "]::DOUBLE[]"


@query(f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_POINT_SQL}), 6) AS distance FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_POINT_SQL}), vec_id LIMIT 50")
def knn_l2(t):
    return retrieve.knn(t("embeddings"), _POINT, 50, "vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"""SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_POINT_SQL}), 6) AS distance FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)
  ORDER BY list_distance(embedding::DOUBLE[], {_POINT_SQL}), vec_id LIMIT 50""")
def knn_filtered(t):
    allow = t("labels").filter("quality = 1").select(F.col("doc_id").alias("vec_id"))
    return retrieve.knn(t("embeddings"), _POINT, 50, "vec_id", allow=allow).select("vec_id", F.round("distance", 6).alias("distance"))


@query(ORACLE_SQL["knn_filtered"])
def knn_cells(t):
    """As knn_filtered, from the cells of a stored index."""
    allow = t("labels").filter("quality = 1").select(F.col("doc_id").alias("vec_id"))
    return vector_index(t("embeddings")).nearest(_POINT, 50, allow).select("vec_id", F.round("distance", 6).alias("distance"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
  p AS (SELECT query_id, vec_id AS neighbour, list_distance(q, embedding::DOUBLE[]) AS d FROM q, embeddings),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), neighbour) AS rank FROM p)
  SELECT query_id, rank, round(d, 5) AS distance FROM r WHERE rank <= 10""")
def knn_per_query(t):
    v = t("embeddings").select("vec_id", "embedding")
    q = v.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    near = vector_index(v).nearest_each(q, 10, "query_id")
    return near.select("query_id", F.col("rank").cast("long").alias("rank"), F.round("distance", 5).alias("distance"))


def _hybrid(t, terms=("the", "of"), k: int = 50, top: int = 20):
    sparse = text_index(t("documents")).matches(" ".join(terms)).withColumn("score", F.round("score", 9)).orderBy("score", "doc_id").limit(k)
    dense = retrieve.knn(t("embeddings").withColumnRenamed("vec_id", "doc_id"), _POINT, k, "doc_id")
    return retrieve.fused_top(retrieve.fuse(dense, sparse, "doc_id"), top, "doc_id")


_RRF_SQL = rf"""WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
  c AS (SELECT doc_id, len(w) AS dl, len(list_filter(w, lambda x: x = 'the')) AS f1, len(list_filter(w, lambda x: x = 'of')) AS f2 FROM d),
  s AS (SELECT count(*) AS n, avg(dl) AS a, count(CASE WHEN f1 > 0 THEN 1 END) AS d1, count(CASE WHEN f2 > 0 THEN 1 END) AS d2 FROM c),
  b AS (SELECT doc_id, round(-(CASE WHEN ln((n - d1 + 0.5) / (d1 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d1 + 0.5) / (d1 + 0.5)) END * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / a))
     + CASE WHEN ln((n - d2 + 0.5) / (d2 + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d2 + 0.5) / (d2 + 0.5)) END * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * dl / a))), 9) AS score FROM c, s WHERE f1 > 0 AND f2 > 0),
  sp AS (SELECT doc_id, row_number() OVER (ORDER BY score, doc_id) AS sparse_rank FROM b QUALIFY sparse_rank <= 50),
  de AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY list_distance(embedding::DOUBLE[], {_POINT_SQL}), vec_id) AS dense_rank FROM embeddings QUALIFY dense_rank <= 50),
  f AS (SELECT coalesce(sp.doc_id, de.doc_id) AS doc_id, sparse_rank, dense_rank, coalesce(1.0 / (60.0 + dense_rank), 0) + coalesce(1.0 / (60.0 + sparse_rank), 0) AS score FROM sp FULL JOIN de ON sp.doc_id = de.doc_id)
  SELECT f.doc_id, round(f.score::DOUBLE, 6) AS score, source, n_chars FROM (SELECT * FROM f ORDER BY score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, doc_id LIMIT 20) f JOIN documents d ON d.doc_id = f.doc_id"""


@query(_RRF_SQL)
def rrf_hybrid(t):
    docs = t("documents").select("doc_id", "source", "n_chars")
    return docs.join(_hybrid(t), "doc_id").select("doc_id", F.round("score", 6).alias("score"), "source", "n_chars")


@query(rf"""WITH d AS (SELECT doc_id, source, {_TOKENS} AS w FROM documents),
  c AS (SELECT doc_id, source, len(w) AS dl, len(list_filter(w, lambda x: x = 'license')) AS f FROM d),
  s AS (SELECT count(*) AS n, avg(dl) AS a, count(CASE WHEN f > 0 THEN 1 END) AS df FROM c)
  SELECT source, round(min(-(ln((n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / a)))), 6) AS score FROM c, s WHERE f > 0 GROUP BY source""")
def page_rollup(t):
    hits = text_index(t("documents")).matches("license")
    return search.roll_up(hits.join(t("documents").select("doc_id", "source"), "doc_id"), "source").select("source", F.round("score", 6).alias("score"))


# ---- graphs -----------------------------------------------------------------------------------


@query("""WITH RECURSIVE p AS (SELECT c_custkey AS id, c_name AS title, CASE WHEN c_custkey % 4 != 0 THEN 'Customer#' || lpad((CASE WHEN c_custkey % 40 = 1 THEN 9999999 ELSE c_custkey - 1 END)::VARCHAR, 9, '0') END AS target FROM customer),
  l AS (SELECT p.id AS src, q.id AS dst FROM p LEFT JOIN p q ON q.title = p.target WHERE p.target IS NOT NULL),
  w AS (SELECT src AS id, dst AS pos, 1 AS hops FROM l UNION ALL SELECT w.id, l.dst, hops + 1 FROM w JOIN l ON l.src = w.pos WHERE hops < 10)
  SELECT p.id AS page_id, e.pos AS resolved FROM p LEFT JOIN (SELECT id, pos FROM w WHERE pos IS NOT NULL AND pos NOT IN (SELECT src FROM l)) e ON e.id = p.id""")
def redirect_resolve(t):
    k = F.col("c_custkey")
    to = F.format_string("Customer#%09d", F.when(k % 40 == 1, 9999999).otherwise(k - 1))
    pages = t("customer").select(k.alias("page_id"), F.col("c_name").alias("title"), F.when(k % 4 != 0, to).alias("target"))
    return graph.resolve_redirects(pages)


@query("""WITH RECURSIVE n AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 0 THEN (c_custkey - 1) // 3 END AS parent FROM customer),
  w AS (SELECT id AS ancestor, id, 0 AS depth FROM n UNION ALL SELECT n.parent, w.id, depth + 1 FROM w JOIN n ON n.id = w.ancestor WHERE n.parent IS NOT NULL)
  SELECT ancestor, id, depth FROM w""")
def tree_closure(t):
    k = F.col("c_custkey")
    return graph.tree_closure(t("customer").select(k.alias("id"), F.when(k > 0, F.floor((k - 1) / 3)).alias("parent")), "id", "parent")


# ---- incremental ------------------------------------------------------------------------------


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(t):
    return incremental.windowed_counts(t("events"), "ts", "event_type", "value").withColumn("total", F.round("total", 4))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
  s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
  SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, s.s""")
def event_sessions(t):
    return incremental.sessions(t("events"), "ts", "user_id", "6 hours")


@query("""WITH i AS (SELECT doc_id FROM documents), r AS (SELECT doc_id FROM labels)
  SELECT CASE WHEN count(*) = 0 THEN 'empty' WHEN count(r.doc_id) < count(*) THEN 'partial' ELSE 'complete' END AS status, count(*) AS items, count(r.doc_id) AS done FROM i LEFT JOIN r ON i.doc_id = r.doc_id""")
def issue_status(t):
    return index.issue_status(t("documents"), t("labels"), "doc_id")


@query(f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_POINT_SQL}), 6) AS distance FROM embeddings")
def vector_distance(t):
    return t("embeddings").select("vec_id", F.round(l2(F.col("embedding"), F.array(*(F.lit(x) for x in _POINT))), 6).alias("distance"))
