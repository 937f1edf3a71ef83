"""Registered queries: merges in buckets, replay, resumed lines, numbers, deep pages, reasons to rebuild."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import listing, merge
from ..operators.merge import upsert
from ..operators.textindex import TextIndex
from ..sources import lines, replay
from ..sources.keyed import KeyedTable
from ..sources.scratch import folder
from ..streaming import incremental
from .registry import query


@query("""WITH r AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
  SELECT o_orderkey, CASE WHEN l_orderkey IS NULL THEN o_orderstatus ELSE 'R' END AS status, o_totalprice FROM orders LEFT JOIN r ON l_orderkey = o_orderkey WHERE o_orderstatus != 'P' OR l_orderkey IS NOT NULL""")
def merged_buckets(t):
    """Orders in buckets of keys: all of them, then returned ones with another status, then the open ones that weren't returned removed."""
    orders = t("orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), "o_totalprice", F.lit(1).alias("version"))
    table = KeyedTable(orders.sparkSession, folder(orders.sparkSession, "orders"), ["o_orderkey"], buckets=16)
    put = lambda old, new: upsert(old, new, ["o_orderkey"], "version")
    table.merge(orders, put)
    returned = t("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    table.merge(orders.join(returned, "o_orderkey").withColumn("status", F.lit("R")).withColumn("version", F.lit(2)), put)
    table.merge(table.read().filter("status = 'P'"), lambda old, new: old.join(new.select("o_orderkey"), "o_orderkey", "left_anti"))
    return table.read().select("o_orderkey", "status", "o_totalprice")


@query("""WITH e AS (SELECT user_id, max(event_id) AS event_id, count(*) AS n, max(ts)::DATE AS d FROM events GROUP BY 1)
  SELECT user_id, event_id, (SELECT max(ts)::DATE::VARCHAR FROM events) AS marked FROM e""")
def ingested_marks(t):
    """Events written as files and ingested into a keyed table of each user's last event; the watermark goes with the rows."""
    events = t("events").select("user_id", "event_id", F.col("ts").cast("date").cast("string").alias("d"))
    spark = events.sparkSession
    base = folder(spark, "ingest")
    events.write.parquet(f"{base}/in")
    schema = ", ".join(f"{n} {k}" for n, k in events.dtypes)
    for _ in range(2):  # the second call finds nothing new
        incremental.ingest(spark, f"{base}/in", schema, f"{base}/out", f"{base}/check", ["user_id"], "event_id", mark=incremental.date_mark("d"), buckets=8)
    marked = incremental.state_of(spark, f"{base}/out")["mark"]["date"]
    return incremental.current(spark, f"{base}/out").select("user_id", "event_id", F.lit(marked).alias("marked"))


@query("""WITH a AS (SELECT sha1('nation=' || c_nationkey) AS key, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY c_nationkey)
  SELECT key, customers, balance FROM a WHERE key || '.json' > '8'""")
def replayed_answers(t):
    """Answers per nation, cached under the hash of their request and replayed behind a name."""
    by = t("customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    path = folder(by.sparkSession, "answers")
    body = F.to_json(F.struct("customers", "balance"))
    replay.store_answers(by.select(F.sha1(F.concat(F.lit("nation="), F.col("c_nationkey").cast("string")).cast("binary")).alias("key"), body.alias("body")), path)
    said = F.from_json("body", "customers long, balance double")
    return replay.answers(by.sparkSession, path, after="8").select("key", said.alias("a")).select("key", "a.customers", "a.balance")


@query("""WITH l AS (SELECT c_mktsegment, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS line FROM customer)
  SELECT c_mktsegment AS segment, line, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_custkey END AS custkey, c_acctbal < 0 AS bad FROM l WHERE line > 10""")
def json_lines_resumed(t):
    """Customers as a file of JSON lines per segment, some of them cut off; read on behind each file's tenth line."""
    rows = t("customer").select("c_mktsegment", "c_custkey", F.when(F.col("c_acctbal") < 0, '{"custkey": ').otherwise(F.to_json(F.struct(F.col("c_custkey").alias("custkey")))).alias("value"))
    spark = rows.sparkSession
    path = folder(spark, "lines")
    rows.repartition("c_mktsegment").sortWithinPartitions("c_mktsegment", "c_custkey").select("c_mktsegment", "value").write.partitionBy("c_mktsegment").text(path)
    rest = lines.json_lines_after(spark, f"{path}/*", "custkey long", 10)
    return rest.select(F.url_decode(F.regexp_extract("file", "c_mktsegment=([^/]+)/", 1)).alias("segment"), "line", F.col("record.custkey").alias("custkey"), "bad")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS id FROM orders")
def numbered_orders(t):
    return merge.number_all(t("orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), "o_orderkey"]).select("o_orderkey", "id")


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice, (SELECT count(*) FROM lineitem) AS total FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber
          LIMIT 50 OFFSET (SELECT count(*) // 2 FROM lineitem)""")
def deep_page(t):
    """The page in the middle of all lines."""
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return listing.deep_page(rows, [("l_extendedprice", False), ("l_orderkey", True), ("l_linenumber", True)], 50, rows.count() // 2)


@query("""SELECT x.trigger, x.reason, CASE WHEN x.trigger = 'none' THEN n ELSE 0 END AS kept, n AS documents FROM (SELECT count(*) AS n FROM benchmark),
  (VALUES ('none', NULL), ('model', 'model'), ('dimension', 'dimension'), ('prefix', 'prefix'), ('tables', 'tables')) x(trigger, reason)""")
def rebuild_reasons(t):
    """Why an index can't be kept, what of it is left then, and how many documents it has once rebuilt."""
    docs = t("benchmark").select("item_id", "text")
    spark = docs.sparkSession
    stamp = {"model": "m1", "dimension": "64", "prefix": "search_document: "}
    path = folder(spark, "rebuilt")
    opened = lambda **changed: TextIndex(spark, path, "item_id", buckets=4, settings=stamp | changed)
    opened().opened()
    opened().update(docs)
    out = []
    for trigger, changed in (("none", {}), ("model", {"model": "m2"}), ("dimension", {"model": "m2", "dimension": "8"}), ("prefix", {"model": "m2", "dimension": "8", "prefix": ""}), ("tables", {"model": "m2", "dimension": "8", "prefix": ""})):
        index = opened(**changed)
        if trigger == "tables":
            index.versions.delete("terms")
        reason = index.opened()
        kept = index.corpus()[0]
        if reason:
            index.update(docs)
        out.append((trigger, reason, kept, index.corpus()[0]))
    return spark.createDataFrame(out, "trigger string, reason string, kept long, documents long")
