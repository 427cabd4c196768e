"""Queries of requests checked, capped, reused and looked up, of foreign suites, and of what protected content was met."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import adapters as A
from ..operators import examples as X
from ..operators import requests as R
from ..operators.manifest import fingerprint
from ..sources.session import Workspace, table
from .registry import query
from .select import ATOMS, norm


@query("""SELECT user_id, CASE WHEN user_id % 4 = 3 THEN 'type' WHEN min(value) < 1 THEN 'instructions'
    WHEN NOT CASE user_id % 4 WHEN 0 THEN count(DISTINCT event_type) BETWEEN 2 AND 255 WHEN 1 THEN count(DISTINCT event_type) BETWEEN 2 AND 10 ELSE count(DISTINCT event_type) = 0 END THEN 'options' ELSE 'ok' END AS reason
FROM (SELECT user_id, value, CASE WHEN user_id % 4 = 2 AND user_id % 3 > 0 THEN NULL ELSE event_type END AS event_type FROM events) GROUP BY user_id""")
def question_faults(spark, d):
    """Questions whose options are the kinds of a user's events, with why they aren't valid."""
    kind = F.get(F.array(*map(F.lit, ("choice", "score", "noul", "other"))), (F.col("user_id") % 4).cast("int"))
    option = F.when((F.col("user_id") % 4 == 2) & (F.col("user_id") % 3 > 0), None).otherwise(F.col("event_type"))
    asked = table(spark, d, "events").groupBy("user_id").agg(F.countDistinct(option).alias("n"), F.min("value").alias("least"))
    instructions = F.when(F.col("least") < 1, F.lit(" ")).otherwise(F.lit("What next?"))
    return asked.select("user_id", X.question_fault(kind, instructions, F.col("n")).alias("reason"))


@query("""WITH o AS (SELECT l_orderkey, list(DISTINCT p_name) AS names, min(p_name) AS least FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
x AS (SELECT l_orderkey, 'Like ' || least || '?' AS query, '{"first":"' || least || '","n":' || len(names) || '}' AS state, list_sum(list_transform(names, lambda x: length(x))) AS together FROM o),
m AS (SELECT CAST(quantile_disc(length(query), 0.9) AS BIGINT) AS a, CAST(quantile_disc(length(state), 0.8) AS BIGINT) AS b, CAST(quantile_disc(together, 0.7) AS BIGINT) AS c FROM x)
SELECT l_orderkey, CASE WHEN length(query) > a THEN 'query' WHEN length(state) > b THEN 'state' WHEN together > c THEN 'options' ELSE 'ok' END AS reason FROM x, m""")
def capped_requests(spark, d):
    """Requests whose options are the products of an order: which of three caps they pass. Caps are taken from the data."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    orders = lines.join(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey").groupBy("l_orderkey").agg(F.collect_set("p_name").alias("names"), F.min("p_name").alias("least"))
    state = F.to_json(F.struct(F.col("least").alias("first"), F.size("names").alias("n")))
    rows = orders.select("l_orderkey", F.concat(F.lit("Like "), "least", F.lit("?")).alias("query"), state.alias("state"), "names")
    at = lambda share, of: F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {of})")
    caps = rows.agg(at(0.9, "length(query)"), at(0.8, "length(state)"), at(0.7, "aggregate(names, 0, (n, x) -> n + length(x))")).first()  # one row
    return rows.select("l_orderkey", R.over_capacity(F.col("query"), F.col("state"), F.col("names"), tuple(int(c or 0) for c in caps)).alias("reason"))


@query("SELECT event_id, sha256(props) AS payload, round(value * 2, 6) AS answer FROM events WHERE event_type = 'click'")
def reused_results(spark, d):
    """Answers of an earlier run over all events, for the events that are asked again with the same payload."""
    rows = table(spark, d, "events").select("event_id", "event_type", K.digest("props").alias("payload"), F.lit("ok").alias("status"), F.round(F.col("value") * 2, 6).alias("answer"))
    earlier = Workspace(spark).write(rows.drop("event_type"), "earlier")
    again = rows.where("event_type = 'click'").select("event_id", "payload")
    return R.reused(again, earlier, "event_id", "payload", "status", "ok", "answer")


@query("SELECT doc_id, sha256(text) AS key, CAST(length(text) AS BIGINT) AS logit FROM documents")
def teacher_lookup(spark, d):
    """Each document's teacher value by its prompt's hash, from a table that notes the rows it was made from."""
    train = table(spark, d, "documents").select("doc_id", "text")
    noted = tuple(fingerprint(train, train.columns).first())
    teacher = Workspace(spark).write(train.select(K.digest("text").alias("key"), F.length("text").cast("long").alias("logit")).distinct(), "teacher")
    rows = train.select("doc_id", K.digest("text").alias("key"))
    return R.checked_lookup(rows, teacher, "key", "logit", train, noted)


@query("""WITH q AS (SELECT o_orderkey, (['choice', 'score', 'noul'])[1 + o_orderkey % 3] AS kind, o_orderstatus, substr(o_orderpriority, 1, 1) AS level FROM orders)
SELECT o_orderkey, 'Look.' || CASE WHEN kind = 'noul' AND o_orderkey % 2 = 0 THEN chr(10) || 'yes: it is ' || level || chr(10) || 'no: it is not' ELSE '' END AS instructions,
CASE kind WHEN 'choice' THEN 'F=F,O=open,P=P' ELSE '' END AS options,
CASE kind WHEN 'choice' THEN list_transform(['F', 'O', 'P'], lambda k: CASE WHEN k = o_orderstatus THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
    WHEN 'score' THEN list_transform(range(5), lambda i: CASE WHEN i + 1 = CAST(level AS INT) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
    ELSE CASE WHEN o_orderstatus = 'O' THEN [0.0::DOUBLE, 1.0::DOUBLE] ELSE [1.0::DOUBLE, 0.0::DOUBLE] END END AS target FROM q""")
def foreign_examples(spark, d):
    """Rows of a foreign suite as examples: keys where descriptions lack, what yes and no mean, one-hot targets."""
    kind = F.get(F.array(*map(F.lit, ("choice", "score", "noul"))), (F.col("o_orderkey") % 3).cast("int"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", kind.alias("kind"), F.substring("o_orderpriority", 1, 1).alias("level"))
    said = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("it is "), "level"))
    keys = F.when(F.col("kind") == "choice", F.array(*map(F.lit, "FOP"))).otherwise(F.array(*map(F.lit, "01234")))
    options = F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit("="), A.described(k, F.when(k == "O", "open")))), ",")
    label = F.when(F.col("kind") == "choice", F.col("o_orderstatus")).when(F.col("kind") == "score", (F.col("level").cast("int") - 1).cast("string"))
    label = label.otherwise(F.when(F.col("o_orderstatus") == "O", "true").otherwise("false"))
    instructions = A.foreign_question(F.col("kind"), F.lit("Look."), said, F.lit("it is not"))
    return rows.select("o_orderkey", instructions.alias("instructions"), F.when(F.col("kind") == "choice", options).otherwise("").alias("options"), A.foreign_target(F.col("kind"), keys, label).alias("target"))


@query(f"""WITH a AS (SELECT doc_id, source, sha256({norm('text')}) AS state, {ATOMS} AS ks FROM documents), b AS (SELECT DISTINCT unnest({ATOMS}) AS k FROM benchmark),
h AS (SELECT DISTINCT doc_id, source, state FROM (SELECT doc_id, source, state, unnest(ks) AS k FROM a) WHERE k IN (SELECT k FROM b))
SELECT source, state, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY source) AS BIGINT) AS of_source FROM h GROUP BY source, state""")
def inherited_exposure_states(spark, d):
    """Hashes of the states that hold protected content, with how many rows have each and how many of a source have any."""
    blocked = table(spark, d, "benchmark").select(F.explode(K.content_atoms("text")).alias("k")).distinct()
    rows = table(spark, d, "documents").select("doc_id", "source", K.state_key("text").alias("state"), F.explode(K.content_atoms("text")).alias("k"))
    each = rows.join(blocked, "k", "left_semi").select("doc_id", "source", "state").distinct().groupBy("source", "state").agg(F.count("*").alias("n"))
    total = each.groupBy(F.col("source").alias("_s")).agg(F.sum("n").alias("of_source"))
    return each.join(total, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
