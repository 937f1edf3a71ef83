"""Registered queries: text, identity and date functions, and readers over files written from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import documents, markup
from ..functions import text as T
from ..functions.arrow import spread
from ..operators import listing
from ..sources import readers
from ..sources.scratch import folder
from ..streaming import incremental
from .registry import query

# ---- columns ----------------------------------------------------------------------------------


@query("SELECT p_partkey, coalesce(nullif(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END, ''), CASE WHEN p_partkey % 2 = 0 THEN p_type END, p_partkey::VARCHAR) AS title FROM part")
def title_fallback(t):
    k = F.col("p_partkey")
    return t("part").select("p_partkey", T.first_given(F.when(k % 3 == 0, "").otherwise(F.col("p_name")), F.when(k % 2 == 0, F.col("p_type")), k.cast("string")).alias("title"))


@query("SELECT p_partkey, nullif(CASE WHEN p_size > 25 THEN '' ELSE p_type END, '') AS kind FROM part")
def blank_to_null(t):
    return t("part").select("p_partkey", T.blank_to_null(F.when(F.col("p_size") > 25, "").otherwise(F.col("p_type"))).alias("kind"))


@query("SELECT page_id, list_last(string_split(url, '/')) AS short_id FROM pages")
def short_id(t):
    return t("pages").select("page_id", T.short_id(F.col("url")).alias("short_id"))


@query("SELECT doc_id, md5(substr(text, 1, 300)) AS head FROM documents")
def head_prefix(t):
    return t("documents").select("doc_id", F.md5(F.substring("text", 1, 300)).alias("head"))


@query("""SELECT p_partkey, CASE WHEN p_size > 40 THEN p_type WHEN p_size > 20 THEN p_name WHEN p_size > 5 THEN p_brand END AS body,
  CASE WHEN p_size > 40 THEN 'html' WHEN p_size > 20 THEN 'pdf' WHEN p_size > 5 THEN 'abstract' END AS source FROM part""")
def body_precedence(t):
    size = F.col("p_size")
    found = T.body_with_source(html=F.when(size > 40, F.col("p_type")), pdf=F.when(size > 20, F.col("p_name")).otherwise(" "), abstract=F.when(size > 5, F.col("p_brand")))
    return t("part").select("p_partkey", found.alias("x")).select("p_partkey", "x.*")


@query("""SELECT s_suppkey, s_name || ' is a ' || CASE WHEN s_suppkey % 2 = 0 THEN 'supplier' ELSE 'place' END || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE ', in ' || n_name END ||
  ', located at ' || s_nationkey || ', ' || n_regionkey || CASE WHEN s_suppkey > 0 THEN ', with a population of ' || format('{:,}', s_suppkey * 1001) ELSE '' END || '.' AS sentence
  FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def place_sentences(t):
    k = F.col("s_suppkey")
    rows = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    sentence = T.place_sentence(F.col("s_name"), F.when(k % 2 == 0, "supplier"), F.when(k % 3 == 0, "").otherwise(F.col("n_name")), F.col("s_nationkey"), F.col("n_regionkey"), k * 1001, F.lit(""))
    return rows.select("s_suppkey", sentence.alias("sentence"))


@query("SELECT l_orderkey || '-' || l_linenumber || '-' || lower(l_returnflag) AS id, l_orderkey FROM lineitem")
def composite_keys(t):
    return t("lineitem").select(T.joined(F.col("l_orderkey"), F.col("l_linenumber"), F.lower("l_returnflag")).alias("id"), "l_orderkey")


@query("SELECT p_partkey, p_name LIKE 'red %' OR p_type = 'ECONOMY' AS found FROM part")
def list_membership(t):
    first = F.element_at(F.split("p_name", " "), 1)
    joined = F.concat(F.upper(first), F.lit(" ;x , "), F.when(F.col("p_type") == "ECONOMY", "Red").otherwise("blue"))
    return t("part").select("p_partkey", listing.in_list(joined, "red").alias("found"))


@query("""SELECT o_orderkey, o_orderstatus = 'F' OR o_orderstatus = 'P' AS pending, o_orderstatus = 'O' AS dead FROM orders""")
def pending_selection(t):
    status = F.when(F.col("o_orderstatus") == "F", F.lit(None)).when(F.col("o_orderstatus") == "P", "retry").otherwise("no_body")
    return t("orders").select("o_orderkey", listing.pending(status).alias("pending"), listing.pending(status, retry_no_body=True).alias("dead"))


@query("SELECT event_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-03'")
def on_one_date(t):
    return t("events").filter(T.on_date(F.col("ts"), "2024-01-03")).select("event_id")


@query("SELECT doc_id FROM documents WHERE n_chars <= 2 * 2000")
def size_bound(t):
    return t("documents").filter(listing.at_most_pages(F.col("n_chars"), 2)).select("doc_id")


@query("SELECT p_partkey, len(list_filter(string_split(p_name || ' ; ' || p_type || ';;', ';'), lambda x: trim(x) != '')) AS n, upper(p_type) AS code FROM part")
def split_items(t):
    return t("part").select("p_partkey", F.size(T.split_list(F.concat("p_name", F.lit(" ; "), "p_type", F.lit(";;")))).cast("long").alias("n"), F.upper("p_type").alias("code"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || ' ' ELSE '' END || p_brand AS name FROM part")
def display_names(t):
    return t("part").select("p_partkey", T.display_name(F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(""), F.col("p_brand"), F.lit(None).cast("string")).alias("name"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey < 10 THEN '0/' || o_orderkey ELSE array_to_string(string_split(left(o_orderkey::VARCHAR, -1), ''), '/') || '/' || o_orderkey END AS path,
  replace('a/' || o_orderpriority, '/', '_') AS file FROM orders""")
def mirror_paths(t):
    return t("orders").select("o_orderkey", T.mirror_path(F.col("o_orderkey")).alias("path"), T.file_name(F.concat(F.lit("a/"), "o_orderpriority")).alias("file"))


@query("SELECT p_partkey, CASE WHEN p_size > 30 THEN p_type WHEN p_size > 10 THEN p_type || ' — ' || p_name ELSE p_name END AS label FROM part")
def section_labels(t):
    size = F.col("p_size")
    return t("part").select("p_partkey", T.section_label(F.when(size > 10, F.col("p_type")).otherwise(""), F.when(size <= 30, F.col("p_name"))).alias("label"))


@query("""SELECT doc_id, CASE WHEN b < 1024 THEN printf('%.1f B', b::DOUBLE) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0) ELSE printf('%.1f MB', b / 1048576.0) END AS size
  FROM (SELECT doc_id, n_chars * 137 AS b FROM documents)""")
def human_sizes(t):
    return t("documents").select("doc_id", T.human_size(F.col("n_chars") * 137).alias("size"))


@query("""SELECT doc_id, md5('search_document: ' || source || CASE WHEN lang = 'en' THEN '' ELSE ' - ' || lang END || chr(10) || chr(10) || text) AS input, 'search_query: ' || source AS asked FROM documents""")
def embed_inputs(t):
    section = F.when(F.col("lang") == "en", "").otherwise(F.col("lang"))
    return t("documents").select("doc_id", F.md5(T.embed_input(F.col("source"), section, F.col("text"))).alias("input"), T.embed_query(F.col("source")).alias("asked"))


@query("SELECT doc_id, source || ' ' || lang AS answer, source AS intro FROM documents")
def model_answers(t):
    """Answers without a model's thoughts, and what stands before their first heading."""
    raw = F.concat(F.lit("<think>"), F.substring("text", 1, 200), F.lit("</think>\n"), "source", F.lit("<THINK>x\ny</think> "), "lang")
    page = F.concat("source", F.lit("\n\n# Head\n"), "lang", F.lit("\n# More"))
    return t("documents").select("doc_id", T.strip_think(raw).alias("answer"), T.intro(page).alias("intro"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 2 = 1")
def template_dates(t):
    told = F.concat(F.lit("{{ date | "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit("}} text"))
    return t("orders").select("o_orderkey", T.template_date(F.when(F.col("o_orderkey") % 2 == 0, told).otherwise("{{date|soon}}")).alias("date"))


@query("SELECT year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, count(*) AS n, count(CASE WHEN year(o_orderdate) = 1996 THEN 1 END) AS inside FROM orders GROUP BY 1, 2")
def quarters(t):
    d = F.col("o_orderdate")
    rows = t("orders").select(T.year_and_quarter(d).alias("q"), T.within_year(d, 1996).alias("inside"))
    return rows.groupBy(F.col("q.year").cast("long").alias("year"), F.col("q.quarter").cast("long").alias("quarter")).agg(F.count("*").alias("n"), F.count(F.when(F.col("inside"), 1)).alias("inside"))


@query("""WITH s AS (SELECT o_custkey, min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b, max(o_orderdate) FILTER (o_orderstatus = 'F')::DATE AS d FROM orders GROUP BY 1),
  n AS (SELECT o_custkey, unnest(range(greatest(year(a) * 4 + quarter(a) - 1, coalesce(year(d) * 4 + quarter(d), 0)), year(b) * 4 + quarter(b))) AS q FROM s)
  SELECT o_custkey, (q // 4)::INT AS year, (q % 4 + 1)::INT AS quarter FROM n""")
def quarter_pairs(t):
    """The quarters of each customer's orders that come after the last finished one: what an ingest that resumes there has to fetch."""
    day = F.col("o_orderdate").cast("date")
    spans = t("orders").groupBy("o_custkey").agg(F.min(day).alias("a"), F.max(day).alias("b"), F.max(F.when(F.col("o_orderstatus") == "F", day)).alias("d"))
    return incremental.quarters_after(spans, "a", "b", "d").select("o_custkey", "year", "quarter")


@query("""SELECT event_id, CASE WHEN event_type IN ('click', 'error') THEN value / 10 ELSE value END AS value FROM events""")
def tenth_units(t):
    element = F.when(F.col("event_type") == "click", "TMAX").when(F.col("event_type") == "error", "PRCP").otherwise("SNOW")
    return t("events").select("event_id", readers.standard_unit(element, F.col("value").cast("string")).alias("value"))


@query("""SELECT n_nationkey, printf('%d°%02d′%02d″', s // 3600, (s % 3600) // 60, s % 60) || CASE WHEN v < 0 THEN 'S' ELSE 'N' END AS place FROM
  (SELECT n_nationkey, n_nationkey * 3.25 - 30 AS v, CAST(round(abs(n_nationkey * 3.25 - 30) * 3600) AS BIGINT) AS s FROM nation)""")
def coordinates(t):
    return t("nation").select("n_nationkey", T.degrees(F.col("n_nationkey") * 3.25 - 30, "N", "S").alias("place"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name || '|' || p_type END AS items FROM part")
def json_lists(t):
    raw = F.when(F.col("p_partkey") % 4 == 0, "{broken").otherwise(F.to_json(F.array(F.concat(F.lit(" "), "p_name"), F.lit(""), "p_type")))
    return t("part").select("p_partkey", F.array_join(T.json_strings(raw), "|").alias("items"))


@query("SELECT event_id, 'k' || json_extract_string(props, '$.k') AS short FROM events")
def nested_fallbacks(t):
    get = lambda path: F.get_json_object("props", path)
    return t("events").select("event_id", F.concat(F.lit("k"), F.coalesce(get("$.name.short"), get("$.name.long"), get("$.k"))).alias("short"))


@query("""SELECT n_nationkey::VARCHAR AS id, 'a, ' || n_name AS names, '{"k":' || n_regionkey || '}' AS data, '' AS gone FROM nation""")
def flat_records(t):
    n = t("nation")
    return readers.flat_strings(n.select(F.col("n_nationkey").alias("id"), F.array(F.lit("a"), "n_name").alias("names"), F.struct(F.col("n_regionkey").alias("k")).alias("data"), F.lit(None).cast("string").alias("gone")))


@query("""SELECT doc_id, left(sha256(coalesce(text, '')), 32) AS plain, sha256(text) AS digest, strlen(text) || '-' || left(sha256(CASE WHEN strlen(text) > 8192 THEN encode(text)[1:4096] || encode(text)[-4096:] ELSE encode(text) END), 16) AS edge FROM documents""")
def digests(t):
    binary = F.col("text").cast("binary")
    return t("documents").select("doc_id", T.plain_hash(F.col("text")).alias("plain"), T.file_digest(binary).alias("digest"), T.edge_fingerprint(binary).alias("edge"))


@query("SELECT n_nationkey, sha1('from=' || n_name || '&set=' || n_regionkey || '&verb=List') AS cache_key FROM nation")
def cache_keys(t):
    params = F.create_map(F.lit("verb"), F.lit("List"), F.lit("set"), F.col("n_regionkey").cast("string"), F.lit("from"), F.col("n_name"))
    return t("nation").select("n_nationkey", T.cache_key(params).alias("cache_key"))


@query("""SELECT o_orderkey, o_orderkey % 2 = 0 AS annual, CASE WHEN o_orderkey % 3 != 0 THEN o_totalprice END AS price FROM orders""")
def missing_markers(t):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    period = F.when(k % 2 == 0, F.year(d).cast("string")).otherwise(F.concat(F.year(d).cast("string"), F.lit("Q1")))
    return t("orders").select("o_orderkey", T.is_annual(period).alias("annual"), T.number_or_null(F.when(k % 3 == 0, ".").otherwise(F.col("o_totalprice").cast("string"))).alias("price"))


@query("""SELECT n_nationkey, '{"name":"' || n_name || '","region":{"key":' || n_regionkey || '}}' AS data FROM nation""")
def nested_json(t):
    return t("nation").select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("key")).alias("region"))).alias("data"))


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS first, len(string_split(p_name, ' ')) AS n FROM part")
def primary_category(t):
    words = F.split("p_name", " ")
    return t("part").select("p_partkey", F.element_at(words, 1).alias("first"), F.size(words).cast("long").alias("n"))


@query("SELECT c_custkey, c_custkey % 2 = 0 AS redirects, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS target FROM customer")
def redirect_targets(t):
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" #Redirect [[ "), "c_mktsegment", F.lit("#part|label]] x"))).otherwise(F.concat(F.lit("text #redirect [["), "c_name", F.lit("]]")))
    return t("customer").select("c_custkey", T.is_redirect(raw).alias("redirects"), T.redirect_target(raw).alias("target"))


@query("""SELECT p_partkey, CASE WHEN p_size > 20 THEN '## Product' || chr(10) || chr(10) || p_name || chr(10) || chr(10) ELSE '' END || '## Brand' || chr(10) || chr(10) || p_brand AS body FROM part""")
def sectioned_rows(t):
    return t("part").select("p_partkey", documents.sectioned({"Product": F.when(F.col("p_size") > 20, F.col("p_name")), "Empty": F.lit("  "), "Brand": F.concat(F.lit(" "), "p_brand")}).alias("body"))


@query("SELECT n_nationkey, '&lt;b&gt;' || n_name || '&amp; &quot;x&quot;&#x27;&lt;/b&gt;' AS escaped, n_name || ' & \"x\"' AS plain FROM nation")
def escapes(t):
    raw = F.concat(F.lit("<b>"), "n_name", F.lit("& \"x\"'</b>"))
    return t("nation").select("n_nationkey", T.escaped_html(raw).alias("escaped"), markup.html_to_text(F.concat("n_name", F.lit(" &amp; &quot;x&quot;"))).alias("plain"))


@query("SELECT page_id, strlen(html) AS size, html[1:9] AS head FROM pages")
def decoded_pages(t):
    """Bytes as UTF-8, or as Latin-1 where they are no UTF-8."""
    text = markup.decode_text(F.concat(F.unhex(F.lit("EFBBBF")), F.col("html").cast("binary")))
    return t("pages").select("page_id", text.alias("text")).select("page_id", F.octet_length("text").cast("long").alias("size"), F.substring("text", 1, 9).alias("head"))


@query("SELECT c_custkey, c_name AS body FROM customer")
def book_bodies(t):
    head, end = "Title\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\n", "\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\nlicense"
    raw = F.concat(F.lit(head + "A note of Project Gutenberg here\n\n\n**"), "c_name", F.lit("**" + end))
    return t("customer").select("c_custkey", documents.book_body(raw).alias("body"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '## Part' || chr(10) || chr(10) || c_name || ' a' ELSE c_name END AS body FROM customer")
def underlined_text(t):
    two = F.concat(F.lit("Top\n***\n\nPart\n====\n\n**"), "c_name", F.lit("** *a*"))
    return documents.underlined_markdown(t("customer").withColumn("text", F.when(F.col("c_custkey") % 2 == 0, two).otherwise(F.col("c_name"))), "c_custkey", "text", "body")


@query("SELECT c_custkey, '## Introduction' || chr(10) || chr(10) || c_name || ' lead' || chr(10) || chr(10) || '## Part' || chr(10) || chr(10) || c_mktsegment AS body FROM customer")
def wiki_articles(t):
    raw = F.concat(F.lit("{{box|{{x}}}}'''"), "c_name", F.lit("''' [[a|lead]]<ref>n</ref>\n== Part ==\n[[File:x.png|thumb]]"), "c_mktsegment", F.lit("\n== See also ==\n* [[b]]"))
    return spread(t("customer").select("c_custkey", "c_name", "c_mktsegment")).select("c_custkey", markup.wiki_to_markdown(raw).alias("body"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment ELSE c_name || ' plain' END AS body FROM customer")
def filing_bodies(t):
    """The document of the asked form, the first where there is none, and a filing without documents."""
    k = F.col("c_custkey")
    main = F.concat(F.lit("<DOCUMENT>\n<TYPE>10-K\n<TEXT><p>"), "c_name", F.lit("</p><script>x < y</script><div style='display: none'>hidden</div></TEXT></DOCUMENT>"))
    other = F.concat(F.lit("<SEC-HEADER>head</SEC-HEADER><DOCUMENT><TYPE>EX-1\n<TEXT>"), "c_mktsegment", F.lit("</TEXT></DOCUMENT>"))
    old = F.concat(F.lit("<IMS-HEADER>head\n</IMS-HEADER>\n"), "c_name", F.lit("  plain\n"))
    raw = F.when(k % 3 == 0, F.concat(other, main)).when(k % 3 == 1, other).otherwise(old)
    return t("customer").select("c_custkey", documents.filing_body(raw, F.lit("10-K")).alias("body"))


# ---- readers: files written from the tables and read again ------------------------------------


#: Records in one XML file, which one task reads; answers and dumps come in files of a bounded size.
RECORDS = 50_000


def _lines(df, name: str, lines, gz: bool = False, root: str | None = None) -> str:
    """One column of lines as text files; if a root element is named, each file is one with ``RECORDS`` lines at most."""
    path, rows = folder(df.sparkSession, name), df.select(lines.alias("value"))
    if not root:
        rows.coalesce(4).write.option("compression", "gzip" if gz else "none").text(path)
        return path
    part = F.floor(F.monotonically_increasing_id() / RECORDS).alias("part")
    whole = F.concat(F.lit(f"<{root}>\n"), F.array_join(F.collect_list("value"), "\n"), F.lit(f"\n</{root}>"))
    rows.select("value", part).groupBy("part").agg(whole.alias("value")).write.partitionBy("part").option("compression", "gzip" if gz else "none").text(path)
    return path


@query("SELECT n_nationkey::VARCHAR AS n_key, n_name AS nation_name, n_regionkey::VARCHAR AS c_2nd FROM nation")
def read_delimited(t):
    n = t("nation")
    path = folder(n.sparkSession, "delimited")
    n.select(F.col("n_nationkey").alias("N Key"), F.col("n_name").alias("Nation-Name"), F.col("n_regionkey").alias("2nd")).coalesce(1).write.option("header", True).option("sep", "\t").csv(path)
    return readers.delimited(n.sparkSession, path, sep="\t")


@query("SELECT s_suppkey AS geonameid, s_name AS name, s_nationkey::DOUBLE AS latitude, CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE s_suppkey END AS elevation, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_suppkey END AS population FROM supplier WHERE s_suppkey % 5 != 0")
def read_places(t):
    k = F.col("s_suppkey")
    number = F.when(k % 5 == 0, "north").otherwise(F.col("s_nationkey").cast("string"))
    cells = [k, "s_name", "s_name", F.lit(""), number, F.lit("1.5"), F.lit("P"), F.lit("PPL"), F.lit("XX"), *[F.lit("")] * 5, F.when(k % 3 == 0, "").otherwise(k.cast("string")), F.when(k % 2 == 0, "-9999").otherwise(k.cast("string")), F.lit("1"), F.lit("UTC"), F.lit("2024-01-01")]
    s = t("supplier")
    rows = readers.places(s.sparkSession, _lines(s, "places", F.concat_ws("\t", *cells)))
    return rows.select("geonameid", "name", "latitude", "elevation", "population")


@query("SELECT 'US' || lpad(s_suppkey::VARCHAR, 9, '0') AS station_id, CASE WHEN s_suppkey % 4 != 0 THEN s_nationkey::DOUBLE END AS latitude, s_name AS name, 'US' AS country_code FROM supplier")
def read_stations(t):
    s, k = t("supplier"), F.col("s_suppkey")
    line = F.concat(F.format_string("US%09d ", k), F.when(k % 4 == 0, F.lit("   n/a  ")).otherwise(F.format_string("%8.4f", F.col("s_nationkey").cast("double"))), F.lit("  -12.5000   10.0 TX "), F.rpad("s_name", 30, " "))
    rows = readers.stations(s.sparkSession, _lines(s, "stations", line))
    return rows.select("station_id", "latitude", "name", "country_code")


@query("SELECT user_id::VARCHAR AS station_id, CASE event_type WHEN 'click' THEN 'TMAX' ELSE 'SNOW' END AS element, round(CASE event_type WHEN 'click' THEN value / 10 ELSE value END, 6) AS value FROM events WHERE event_type IN ('click', 'purchase')")
def read_observations(t):
    e = t("events")
    element = F.when(F.col("event_type") == "click", "TMAX").when(F.col("event_type") == "purchase", "SNOW").otherwise("WT01")
    path = _lines(e, "observations", F.concat_ws(",", "user_id", F.date_format("ts", "yyyyMMdd"), element, F.col("value").cast("string")), gz=True)
    return readers.observations(e.sparkSession, path).select("station_id", "element", F.round("value", 6).alias("value"))


@query("SELECT c_name || ' Inc' AS company_name, '10-K' AS form_type, c_custkey::VARCHAR AS cik, 'n-' || c_custkey AS accession_number FROM customer WHERE c_custkey % 3 = 0")
def read_filing_index(t):
    c = t("customer")
    form = F.when(F.col("c_custkey") % 3 == 0, "10-K").otherwise("S-1")
    line = F.concat(F.rpad(F.concat("c_name", F.lit(" Inc")), 40, " "), F.rpad(form, 12, " "), F.rpad(F.col("c_custkey").cast("string"), 12, " "), F.lit("2024-01-31  edgar/data/1/n-"), "c_custkey", F.lit(".txt  "))
    head = c.sparkSession.createDataFrame([("Company Name   Form Type   CIK   Date Filed   File Name",), ("-" * 80,)], "value string")
    path = folder(c.sparkSession, "filings")
    head.union(c.select(line)).coalesce(2).write.text(path)
    return readers.filing_index(c.sparkSession, path).select("company_name", "form_type", "cik", "accession_number")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey % 4 != 1")
def read_json_lines(t):
    n = t("nation")
    line = F.when(F.col("n_nationkey") % 4 == 1, '{"id": 1, "na').otherwise(F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))))
    return readers.json_lines(n.sparkSession, _lines(n, "records", line, gz=True), "id int, name string")


@query("SELECT c_custkey AS page_id, c_name AS title, c_custkey % 4 = 0 AS is_redirect, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS target FROM customer WHERE c_custkey % 5 != 0")
def read_wiki_dump(t):
    c, k = t("customer"), F.col("c_custkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("#REDIRECT [["), "c_mktsegment", F.lit("]]"))).otherwise(F.lit("&lt;b&gt;text"))
    page = F.concat(F.lit("<page><title>"), "c_name", F.lit("</title><ns>"), F.when(k % 5 == 0, 14).otherwise(0), F.lit("</ns><id>"), k, F.lit('</id><revision><id>7</id><timestamp>t</timestamp><text xml:space="preserve">'), text, F.lit("</text></revision></page>"))
    rows = readers.wiki_pages(c.sparkSession, _lines(c, "dump", page, root="mediawiki"))
    return rows.select("page_id", "title", "is_redirect", "target")


@query("SELECT conv_id * 100 + turn AS post_id, CASE WHEN role = 'user' THEN 1 ELSE 2 END AS kind, role || ' & x' AS body FROM conversations")
def read_forum_posts(t):
    c = t("conversations")
    kind = F.when(F.col("role") == "user", 1).otherwise(2)
    row = F.concat(F.lit('<row Id="'), F.col("conv_id") * 100 + F.col("turn"), F.lit('" PostTypeId="'), kind, F.lit('" Score="1" Body="&lt;p&gt;'), "role", F.lit(' &amp; x&lt;/p&gt;" CreationDate="2024" />'))
    return readers.forum_posts(c.sparkSession, _lines(c, "posts", row, root="posts"), "site").select("post_id", "kind", "body")


@query("SELECT p_partkey::VARCHAR AS id, p_name AS title, 'math.CO' AS primary_category, 'Ann B' AS author FROM part WHERE p_partkey % 3 != 0")
def read_harvest(t):
    p, k = t("part"), F.col("p_partkey")
    head = F.concat(F.lit("<record><header"), F.when(k % 3 == 0, ' status="deleted"').otherwise(""), F.lit("><identifier>x</identifier><datestamp>2024-01-01</datestamp></header>"))
    meta = F.concat(F.lit("<metadata><arXiv><id>"), k, F.lit("</id><created>2024</created><authors><author><keyname>B</keyname><forenames>Ann</forenames></author></authors><title>"), F.replace("p_name", F.lit(" "), F.lit("\n  ")), F.lit("</title><categories>math.CO cs.LG</categories><abstract>text</abstract></arXiv></metadata></record>"))
    path = _lines(p, "harvest", F.concat(head, meta), root="ListRecords")
    rows = readers.harvested_papers(p.sparkSession, path)
    return rows.select("id", "title", "primary_category", F.get("authors", F.lit(0))["display_name"].alias("author"))


@query("SELECT DISTINCT 'o' || c_nationkey || '/' || lower(c_mktsegment) AS repo, 'list' || (SELECT min(c_custkey % 3) FROM customer d WHERE d.c_nationkey = c.c_nationkey AND d.c_mktsegment = c.c_mktsegment) AS source FROM customer c")
def linked_repositories(t):
    k = F.col("c_custkey")
    text = F.concat(F.lit("see [x](https://github.com/o"), "c_nationkey", F.lit("/"), F.lower("c_mktsegment"), F.lit(".git) and https://github.com/topics/a/b."))
    rows = t("customer").select(text.alias("text"), F.concat(F.lit("list"), k % 3).alias("list"), (k % 3).alias("place"))
    return readers.repository_links(rows, "text", "list", "place")
