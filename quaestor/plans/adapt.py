"""Queries of foreign layouts, exposure reports and consistency checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import adapters as A
from ..operators import metrics as M
from ..sources.session import table
from .registry import query
from .select import ATOMS, norm


@query("SELECT s_suppkey, 'name' AS key, replace(s_name, '''', '') AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS VARCHAR) FROM supplier")
def map_literal_repair(spark, d):
    text = F.concat(F.lit("{'name': '"), F.replace("s_name", F.lit("'"), F.lit("")), F.lit("', 'nation': '"), F.col("s_nationkey").cast("string"), F.lit("'}"))
    rows = table(spark, d, "supplier").select("s_suppkey", A.map_pairs(text).alias("p"))
    return rows.select("s_suppkey", F.explode("p").alias("p")).select("s_suppkey", "p.*")


@query("SELECT conv_id, trim(min_by(text, turn) FILTER (WHERE role = 'user')) AS user FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING bool_and(NOT contains(text, chr(10))) AND bool_or(role = 'user')) GROUP BY conv_id")
def chat_log_first_user(spark, d):
    turns = table(spark, d, "conversations")
    fine = turns.groupBy("conv_id").agg(F.bool_and(~F.contains("text", F.lit("\n"))).alias("a"), F.bool_or(F.col("role") == "user").alias("b"), F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t")).where("a AND b")
    log = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n")
    return fine.select("conv_id", A.first_exchange(log)["user"].alias("user"))


@query("SELECT r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN r_name ELSE 'region ' || r_name END AS text FROM region")
def foreign_option_text(spark, d):
    said = F.when(F.col("r_regionkey") % 2 == 0, F.lit(" ")).otherwise(F.concat(F.lit("region "), "r_name"))
    return table(spark, d, "region").select("r_regionkey", A.described(F.col("r_name"), said).alias("text"))


@query("SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN 0.25 WHEN event_type = 'click' THEN 1 ELSE 0 END AS DOUBLE) AS p_click, CAST(CASE WHEN event_id % 3 = 0 THEN 0.75 WHEN event_type = 'view' THEN 1 ELSE 0 END AS DOUBLE) AS p_view FROM events")
def foreign_answer(spark, d):
    both = F.concat(F.lit('{"choice": "'), "event_type", F.lit('", "probabilities": {"click": 0.25, "view": 0.75}}'))
    bare = F.concat(F.lit('{"choice": "'), "event_type", F.lit('"}'))
    p = A.answer_distribution(F.when(F.col("event_id") % 3 == 0, both).otherwise(bare), ["click", "view"])
    return table(spark, d, "events").select("event_id", p[0].alias("p_click"), p[1].alias("p_view"))


@query(f"""WITH a AS (SELECT doc_id, source, unnest({ATOMS}) AS k FROM documents), b AS (SELECT DISTINCT unnest({ATOMS}) AS k FROM benchmark)
SELECT source, count(DISTINCT doc_id) AS hits, count(DISTINCT k) AS atoms FROM a WHERE k IN (SELECT k FROM b) GROUP BY source""")
def inherited_exposure(spark, d):
    a = table(spark, d, "documents").select("doc_id", "source", F.explode(K.content_atoms("text")).alias("k"))
    b = table(spark, d, "benchmark").select(F.explode(K.content_atoms("text")).alias("k")).distinct()
    return a.join(b, "k", "left_semi").groupBy("source").agg(F.countDistinct("doc_id").alias("hits"), F.countDistinct("k").alias("atoms"))


@query("SELECT abs(sum(n * m) / sum(n) - (SELECT avg(value) FROM events)) < 1e-6 AS consistent FROM (SELECT event_type, count(*) AS n, avg(value) AS m FROM events GROUP BY event_type)")
def weighted_mean_consistency(spark, d):
    e = table(spark, d, "events")
    parts = e.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.sum("value").alias("s"))
    return parts.agg((F.abs(F.sum(F.col("n") * F.col("m")) / F.sum("n") - F.sum("s") / F.sum("n")) < 1e-6).alias("consistent"))


@query("SELECT user_id, event_id, rank() OVER (PARTITION BY user_id ORDER BY event_type) + (count(*) OVER (PARTITION BY user_id, event_type) - 1) / 2.0 AS r FROM events")
def average_rank_ties(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", M.average_rank("event_type", "user_id").alias("r"))


@query("SELECT l.doc_id FROM labels l JOIN documents d USING (doc_id) WHERE l.quality = 1 AND d.lang = 'en'")
def complete_group_rows(spark, d):
    chosen = table(spark, d, "documents").where("lang = 'en'").select("doc_id")
    return table(spark, d, "labels").where("quality = 1").join(chosen, "doc_id", "left_semi").select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE {norm('text')} NOT IN (SELECT {norm('text')} FROM benchmark)")
def normalised_text_block(spark, d):
    blocked = table(spark, d, "benchmark").select(K.normalized("text").alias("k"))
    rows = table(spark, d, "documents").select("doc_id", K.normalized("text").alias("k"))
    return rows.join(blocked, "k", "left_anti").select("doc_id")


@query("SELECT doc_id, lang FROM documents EXCEPT SELECT doc_id, lang FROM documents JOIN labels USING (doc_id)")
def planned_minus_done(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").distinct()


@query("SELECT o_orderstatus, max(CASE WHEN o_orderpriority LIKE '1%' THEN n END) AS urgent, max(CASE WHEN o_orderpriority LIKE '5%' THEN n END) AS low FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_orderstatus")
def pivoted_counts(spark, d):
    level = F.when(F.col("o_orderpriority").startswith("1"), "urgent").when(F.col("o_orderpriority").startswith("5"), "low")
    return table(spark, d, "orders").withColumn("level", level).groupBy("o_orderstatus").pivot("level", ["urgent", "low"]).count()
