"""Queries of generators, manifests and audits of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import generators as G
from ..operators.batches import token_budget
from ..operators.manifest import counts, fingerprint
from ..operators.scoring import answered
from ..sources.session import table
from .registry import query
from .select import bucket


@query("""WITH r AS (SELECT id, md5('rule|' || id) AS h FROM range(500) AS t(id)), b AS (SELECT id, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) AS x FROM r),
v AS (SELECT id, x % 2 = 1 AS a, x // 2 % 2 = 1 AS b, x // 4 % 2 = 1 AS c, x // 8 % 3 AS op1, x // 24 % 3 AS op2 FROM b),
s AS (SELECT *, CASE op1 WHEN 0 THEN a AND b WHEN 1 THEN a OR b ELSE a <> b END AS l FROM v) SELECT id, CASE op2 WHEN 0 THEN l AND c WHEN 1 THEN l OR c ELSE l <> c END AS truth FROM s""")
def gen_boolean_rules(spark, d):
    return G.boolean_rules(spark, 500).select("id", "truth")


@query("""WITH b AS (SELECT id, CAST(('0x' || substr(md5('sum|' || id), 1, 8)) AS BIGINT) AS x FROM range(500) AS t(id)), v AS (SELECT id, x % 199 - 99 AS a, x // 199 % 12 + 1 AS b, x // 2388 % 4 AS op FROM b)
SELECT id, CASE op WHEN 0 THEN a + b WHEN 1 THEN a * b WHEN 2 THEN CAST(floor(CAST(a AS DOUBLE) / b) AS BIGINT) ELSE ((a % b) + b) % b END AS result FROM v""")
def gen_arithmetic(spark, d):
    return G.arithmetic(spark, 500).select("id", "result")


@query("""WITH r AS (SELECT tree, x, CAST(('0x' || substr(md5('tree|' || tree), 1, 8)) AS BIGINT) // CAST(pow(2, x) AS BIGINT) % 2 = 1 AS truth FROM range(40) AS t(tree), range(16) AS u(x)),
p AS (SELECT a.tree, a.x, b.x AS y, bit_count(xor(a.x, b.x)) AS dist FROM r a JOIN r b ON a.tree = b.tree AND a.truth AND NOT b.truth)
SELECT tree, x, y, CAST(dist AS INTEGER) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY dist, x, y) AS r FROM p) WHERE r = 1""")
def gen_counterfactual_pairs(spark, d):
    return G.counterfactual_pairs(spark, 40)


@query("""SELECT o_orderkey, n, CASE WHEN late > 0 THEN 'late' WHEN late = 0 THEN 'due' ELSE 'early' END AS label, strftime(due, '%d.%m.%Y') AS shown FROM (
SELECT o_orderkey, n, date_diff('day', due, CAST(o_orderdate AS DATE) + CAST(n AS INTEGER)) AS late, due FROM (SELECT o_orderkey, o_orderdate, last_day(CAST(o_orderdate AS DATE)) AS due FROM orders), (VALUES (0), (1), (10), (29)) AS g(n))""")
def gen_deadlines(spark, d):
    return G.deadlines(table(spark, d, "orders"), "o_orderkey", "o_orderdate", [0, 1, 10, 29])


@query("SELECT * FROM (VALUES (DATE '2024-02-27', 'early'), (DATE '2024-02-28', 'due'), (DATE '2024-02-29', 'late'), (DATE '2024-03-01', 'late')) AS t(received, label)")
def deadline_leap_year(spark, d):
    days = spark.sql("SELECT explode(sequence(DATE '2024-02-27', DATE '2024-03-01')) AS received")
    return days.select("received", G.deadline_label(F.datediff("received", F.lit("2024-02-28").cast("date"))).alias("label"))


@query("SELECT id, k, v FROM (SELECT id, x, [x * x, x + 3, abs(x) % 7, greatest(x, 10)] AS vs FROM (SELECT id, id % 41 - 20 AS x FROM range(300) AS t(id))), LATERAL (SELECT unnest(range(4)) AS k, unnest(vs) AS v)")
def gen_program_results(spark, d):
    return G.programs(spark, 300)


@query("SELECT 'source' AS kind, source AS value, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY lang")
def manifest_counts(spark, d):
    return counts(table(spark, d, "documents"), ["source", "lang"])


@query(f"""SELECT floor({bucket("'order|' || doc_id")} * 4) AS position, count(*) AS n FROM documents GROUP BY ALL""")
def gold_position_histogram(spark, d):
    place = F.floor(K.bucket(F.concat(F.lit("order|"), F.col("doc_id").cast("string"))) * 4)
    return table(spark, d, "documents").groupBy(place.cast("double").alias("position")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, CAST(sum(CAST(('0x' || substr(md5(concat_ws('|', CAST(doc_id AS VARCHAR), lang, source, text)), 1, 8)) AS BIGINT)) AS BIGINT) AS checksum FROM documents")
def table_fingerprint(spark, d):
    return fingerprint(table(spark, d, "documents"), ["doc_id", "lang", "source", "text"])


@query("SELECT source, count(*) AS n, count(DISTINCT doc_id) AS ids, max(length(text)) AS longest FROM documents GROUP BY source")
def distinct_ids_per_family(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"), F.max(F.length("text").cast("long")).alias("longest"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY ALL")
def scan_aggregate(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""WITH RECURSIVE s AS (
    SELECT source, doc_id, length, row_number() OVER (PARTITION BY source ORDER BY length, doc_id) AS i
    FROM (SELECT source, doc_id, CAST(len(string_split(text, ' ')) AS BIGINT) AS length FROM documents)),
walk AS (
    SELECT source, doc_id, length, i, 0::BIGINT AS batch, 1::BIGINT AS held FROM s WHERE i = 1
    UNION ALL
    SELECT s.source, s.doc_id, s.length, s.i, batch + CASE WHEN s.length * (held + 1) > 8192 THEN 1 ELSE 0 END,
        CASE WHEN s.length * (held + 1) > 8192 THEN 1 ELSE held + 1 END
    FROM walk JOIN s ON s.source = walk.source AND s.i = walk.i + 1)
SELECT source, batch, doc_id AS row_id, length FROM walk""")
def token_budget_batches(spark, d):
    """Length-sorted rows in batches of at most 8,192 words of padded width, per source."""
    rows = table(spark, d, "documents").select("doc_id", "source", F.size(F.split("text", " ")).alias("length"))
    return token_budget(rows, "source", "doc_id", "length", 8192)


@query("""WITH q(name, keys) AS (VALUES ('letter', ['e', 'a', 'z']), ('mark', ['.', '?'])),
z AS (SELECT doc_id, name, keys, list_transform(keys, lambda k: CAST(len(string_split(coalesce(text, ''), k)) - 1 AS DOUBLE) / (1 + length(coalesce(text, '')))) AS raw FROM documents, q)
SELECT doc_id, name, keys[list_position(raw, list_max(raw))] AS choice, round(1 / list_sum(list_transform(raw, lambda x: exp(x - list_max(raw)))), 6) AS confidence, len(raw) AS n FROM z""")
def answers_by_state(spark, d):
    """Two questions with three and two options on each document, which is prepared once for both."""
    asked = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, k)).alias("keys")) for n, k in (("letter", ("e", "a", "z")), ("mark", (".", "?"))))))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("request_id"), F.coalesce("text", F.lit("")).alias("state"), asked.alias("q"))
    rows = rows.select("request_id", "state", "q.name", F.array_join("q.keys", " ").alias("question"), "q.keys")
    got = answered(rows, G.letter_counts, G.share_logits)
    return got.select(F.col("request_id").alias("doc_id"), "name", "choice", F.round("confidence", 6).alias("confidence"), F.size("raw").cast("long").alias("n"))


@query()
def scored_requests(spark, d):
    """Prompts through the pluggable batch scorer (rows only: a Python function)."""
    from ..operators.scoring import scored

    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("prompt"), F.lit(4).alias("n"))
    return scored(rows, "prompt", "n", G.length_scores).select("doc_id", "logits")
