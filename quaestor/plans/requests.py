"""Queries of requests with several questions, capacity, joins and counts that must hold, and gates over metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import metrics as M
from ..operators import requests as R
from ..sources.session import table
from .registry import query
from .score import ARGMAX, BASE, BRIER, NLL, base, families, r6


@query("SELECT doc_id, 'language=' || CASE WHEN lang = 'en' THEN 'yes' ELSE 'no' END || ';length=' || CASE WHEN length(text) > 2000 THEN 'yes' ELSE 'no' END || ';lines=' || CASE WHEN contains(text, chr(10)) THEN 'yes' ELSE 'no' END AS answers FROM documents WHERE text IS NOT NULL")
def multi_question_requests(spark, d):
    """Requests with three questions each on one state: exploded, answered row by row and put together again."""
    questions = F.create_map(*(F.lit(x) for pair in (("language", "is it English?"), ("length", "is it long?"), ("lines", "has it lines?")) for x in pair))
    rows = R.asked(table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "lang", "text", questions.alias("q")), "doc_id", "q")
    yes = F.when(F.col("name") == "language", F.col("lang") == "en").when(F.col("name") == "length", F.length("text") > 2000).otherwise(F.contains("text", F.lit("\n")))
    got = R.answered(rows.withColumn("a", F.when(yes, "yes").otherwise("no")), "doc_id", "a")
    return got.select("doc_id", F.array_join(F.transform(F.map_entries("answers"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";").alias("answers"))


@query(BASE + " SELECT vec_id, i - 1 AS k, round((p[i] + q[i]) / 2, 6) AS p FROM v, range(1, 6) AS r(i)")
def ensemble_by_key(spark, d):
    """Two answers whose options stand in different orders, matched by key; keys differ by case and space only."""
    keys = F.array(*map(F.lit, ("x", " X", "X", "x ", "y")))
    rows = base(spark, d).select("vec_id", R.ensemble_by_key(keys, F.col("p"), F.reverse(keys), F.reverse("q")).alias("m"))
    return rows.select("vec_id", F.posexplode("m").alias("k", "p")).select("vec_id", F.col("k").cast("long").alias("k"), r6("p"))


@query("SELECT * FROM (VALUES (1, true), (2, false), (3, false), (4, false)) AS t(id, valid)")
def ensemble_refusals(spark, d):
    """Other keys, no mass and a negative entry are refused."""
    rows = spark.sql("SELECT * FROM VALUES (1, array('a', 'b'), array(0.5D, 0.5D), array('b', 'a'), array(1D, 0D)), (2, array('a', 'b'), array(0.5D, 0.5D), array('A', 'b'), array(1D, 0D)), (3, array('a', 'b'), array(0D, 0D), array('a', 'b'), array(1D, 0D)), (4, array('a', 'b'), array(1D, 0D), array('a', 'b'), array(-1D, 2D)) AS t(id, k, p, j, q)")
    return rows.select("id", R.ensemble_by_key(F.col("k"), F.col("p"), F.col("j"), F.col("q")).isNotNull().alias("valid"))


@query("SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING bool_and(coalesce(len(regexp_split_to_array(text, ' ')) <= 30, false)))")
def whole_requests_that_fit(spark, d):
    tokens = F.size(F.split("text", " "))
    return R.fitting_requests(table(spark, d, "conversations"), "conv_id", F.when(F.col("text").isNotNull(), tokens), 30).select("conv_id", "turn")


@query("SELECT * FROM (VALUES (1), (3)) AS t(id)")
def capacity_at_the_limit(spark, d):
    """A request of exactly the limit is taken, one token more is refused whole."""
    rows = spark.sql("SELECT * FROM VALUES (1, 10), (1, 3), (2, 11), (2, 1), (3, 0) AS t(id, n)")
    return R.fitting_requests(rows, "id", F.col("n"), 10).select("id").distinct()


@query("SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY 1")
def minimum_counts(spark, d):
    return R.at_least(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag")), "flag", 10)


@query("SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 20")
def fixed_quota(spark, d):
    return R.quota(table(spark, d, "orders"), "o_orderpriority", 20, "o_orderkey").select("o_orderpriority", "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, p_type FROM lineitem JOIN part ON l_partkey = p_partkey")
def complete_lookup(spark, d):
    """Every line must find its part, as every prompt must find its teacher's logits."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    return R.total_lookup(rows, table(spark, d, "part"), "p_partkey", "p_type").select("l_orderkey", "l_linenumber", "p_type")


@query("SELECT c_custkey, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def label_lookup(spark, d):
    nations = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows
    return table(spark, d, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@query("SELECT a.user_id, CASE WHEN a.event_type = b.event_type THEN round(a.v - b.v, 6) END AS delta FROM (SELECT user_id, max_by(event_type, event_id) AS event_type, round(avg(value), 6) AS v FROM events WHERE event_id % 2 = 0 GROUP BY user_id) a JOIN (SELECT user_id, max_by(event_type, event_id) AS event_type, round(avg(value), 6) AS v FROM events WHERE event_id % 2 = 1 GROUP BY user_id) b USING (user_id)")
def score_table_join(spark, d):
    """Scores of two tables by id; a difference only where both name one metric."""
    side = lambda k, n: table(spark, d, "events").where(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias(f"m{n}"), F.round(F.avg("value"), 6).alias(f"v{n}"))
    return side(0, 1).join(side(1, 2), "user_id").select("user_id", F.when(F.col("m1") == F.col("m2"), r6(F.col("v1") - F.col("v2"), "x")).alias("delta"))


@query("SELECT user_id, min(event_id) AS first, count(*) AS length FROM (SELECT *, sum(CASE WHEN value > 20 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events) WHERE value > 20 GROUP BY user_id, island HAVING count(*) >= 3")
def failure_streaks(spark, d):
    return R.failure_streaks(table(spark, d, "events"), "user_id", "event_id", F.col("value") > 20).where("length >= 3")


@query(BASE + f", w AS (SELECT src, gold, list_max(p) AS top, CASE WHEN {ARGMAX.format(p='p')} = gold THEN 1.0 ELSE 0.0 END AS hit FROM v), bins AS (SELECT src, gold, bin, count(*) AS n, avg(top) AS conf, avg(hit) AS acc FROM (SELECT *, ceil(top * 10) - 1 AS bin FROM w) GROUP BY GROUPING SETS ((src, bin), (gold, bin), (bin))) SELECT src, gold, round(sum(n * abs(conf - acc)) / sum(n), 6) AS ece FROM bins GROUP BY src, gold")
def calibration_by_source_type_overall(spark, d):
    """The calibration error in each grouping set of the report."""
    rows = base(spark, d).select("src", "gold", F.array_max("p").alias("top"), M.hit().alias("hit")).withColumn("bin", F.ceil(F.col("top") * 10) - 1)
    sets = rows.groupingSets([[F.col("src"), F.col("bin")], [F.col("gold"), F.col("bin")], [F.col("bin")]], "src", "gold", "bin").agg(F.count("*").alias("n"), F.avg("top").alias("conf"), F.avg("hit").alias("acc"))
    return sets.groupBy("src", "gold").agg(r6(F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n"), "ece"))


GATED = BASE + f", m AS (SELECT avg(CASE WHEN {ARGMAX.format(p='p')} = gold THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN {ARGMAX.format(p='q')} = gold THEN 1.0 ELSE 0.0 END) AS drop, avg({NLL.format(p='q')}) - avg({NLL.format(p='p')}) AS nll FROM v), c AS (SELECT avg(CASE WHEN {ARGMAX.format(p='p')} = gold THEN 1.0 ELSE 0.0 END) AS acc FROM v)"


@query(GATED + " SELECT drop <= 0.005 AS accuracy_ok, nll <= 0.02 AS nll_ok FROM m")
def compression_gates(spark, d):
    """Accuracy may fall by half a point and the loss may rise by 0.02."""
    got = base(spark, d).agg((F.avg(M.hit("p")) - F.avg(M.hit("q"))).alias("drop"), (F.avg(V.nll("q", "t")) - F.avg(V.nll("p", "t"))).alias("nll"))
    return got.select((F.col("drop") <= 0.005).alias("accuracy_ok"), (F.col("nll") <= 0.02).alias("nll_ok"))


ECE = """e{0} AS (SELECT src, sum(n * abs(conf - acc)) / sum(n) AS e FROM (SELECT src, ceil(list_max({0}) * 10) - 1 AS bin, count(*) AS n, avg(list_max({0})) AS conf,
    avg(CASE WHEN {1} = gold THEN 1.0 ELSE 0.0 END) AS acc FROM v GROUP BY ALL) GROUP BY src)"""


@query(BASE + f", {ECE.format('p', ARGMAX.format(p='p'))}, {ECE.format('q', ARGMAX.format(p='q'))} SELECT src, round(eq.e - ep.e, 6) AS rise, round(eq.e - ep.e, 6) <= 0.01 AS ece_ok FROM ep JOIN eq USING (src)")
def calibration_gate(spark, d):
    """The calibration error of the compressed scorer may pass that of the whole one by 0.01, in each source."""
    rows = base(spark, d)
    whole, small = M.calibration_error(rows, ["src"]), M.calibration_error(rows, ["src"], p="q").withColumnRenamed("ece", "small")
    rise = r6(F.col("small") - F.col("ece"), "rise")
    return whole.join(small, "src").select("src", rise).withColumn("ece_ok", F.col("rise") <= 0.01)


@query(BASE + f", a AS (SELECT src, avg(CASE WHEN vec_id % 5 = gold THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN {ARGMAX.format(p='p')} = gold THEN 1.0 ELSE 0.0 END) AS delta FROM v GROUP BY src) SELECT src, round(100 * delta, 4) AS points FROM a WHERE delta < -0.005 ORDER BY delta, src LIMIT 5")
def deficits_in_points(spark, d):
    """The largest deficits of a guess by id against the scorer, of more than half a point."""
    rows = families(spark, d).withColumn("delta", F.col("baseline") - F.col("candidate")).where("delta < -0.005").orderBy("delta", "src").limit(5)
    return rows.select("src", F.round(100 * F.col("delta"), 4).alias("points"))


@query(BASE + f" SELECT round(0.7 * avg(loss) FILTER (WHERE src <> 0) + 0.3 * avg(loss) FILTER (WHERE src = 0), 6) AS objective FROM (SELECT src, {NLL.format(p='p')} AS loss FROM v)")
def focus_loss_objective(spark, d):
    rows = base(spark, d).select("src", V.nll("p", "t").alias("loss"))
    mean = lambda c: F.avg(F.when(c, F.col("loss")))
    return rows.agg(r6(0.7 * mean(F.col("src") != 0) + 0.3 * mean(F.col("src") == 0), "objective"))


@query(BASE + f" SELECT vec_id, round(CASE WHEN src % 2 = 0 THEN 2.0 ELSE 1.0 END * {NLL.format(p='p')} + 0.1 * {BRIER.format(p='q')}, 6) AS loss FROM v")
def anchored_objective(spark, d):
    """The family's weight on the loss, and an anchor to the softened answer."""
    weight = F.when(F.col("src") % 2 == 0, 2.0).otherwise(1.0)
    return base(spark, d).select("vec_id", r6(weight * V.nll("p", "t") + 0.1 * V.brier("q", "t"), "loss"))


KL = "4 * list_sum(list_transform(range(1, 6), lambda i: q[6 - i] * (ln(q[6 - i]) - ln(q[i]))))"


@query(BASE + f""" SELECT vec_id, round(CASE src WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 1 END * {NLL.format(p='p')}
    + 0.5 * CASE WHEN src IN (2, 3, 4) THEN 0.25 ELSE 1 END * {KL}, 6) AS loss FROM v""")
def kl_anchored_objective(spark, d):
    """The family's weight on the loss, and half the anchor: the divergence from a teacher at temperature 2, with a
    weight of its own. The teacher's logits are those of the options in reversed order."""
    weight = F.when(F.col("src") == 0, 4.0).when(F.col("src") == 1, 3.0).otherwise(1.0)
    anchor = F.when(F.col("src").isin(2, 3, 4), 0.25).otherwise(1.0)
    rows = base(spark, d).withColumn("teacher", F.reverse("z"))
    return rows.select("vec_id", r6(weight * V.nll("p", "t") + 0.5 * anchor * V.teacher_kl("z", "teacher"), "loss"))


@query("SELECT user_id, event_id, best FROM (SELECT *, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events WHERE event_type <> 'click') WHERE best IS NULL OR value < best")
def improving_steps(spark, d):
    """Eligible steps that are strictly better than all before; a first step counts."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, d, "events").where("event_type <> 'click'").withColumn("best", F.min("value").over(w))
    return rows.where("best IS NULL OR value < best").select("user_id", "event_id", "best")
