"""Queries of scoring, metrics, calibration, comparison and gates. Vectors are the first components of embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import metrics as M
from ..operators import scoring as Q
from ..operators.ordered import percentiles
from ..sources.session import table
from .registry import query

K = 5
#: z: logits from a row's vector; p and q: their softmax at 1 and 2; t: one-hot target; src: a source.
BASE = """WITH b AS (SELECT vec_id, vec_id % 7 AS src, label % 5 AS gold, embedding FROM embeddings),
o AS (SELECT vec_id, src, gold, k, list_sum(list_transform(range(k + 1, len(embedding) + 1, 5), lambda i: CAST(embedding[i] AS DOUBLE))) * 3.0 + CASE WHEN k = gold THEN 1.5 ELSE 0 END AS z FROM b, range(5) AS r(k)),
l AS (SELECT vec_id, src, gold, list(CAST(z AS DOUBLE) ORDER BY k) AS z, list(CASE WHEN k = gold THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END ORDER BY k) AS t FROM o GROUP BY ALL),
s AS (SELECT *, list_transform(z, lambda x: exp(x - list_max(z))) AS e, list_transform(z, lambda x: exp((x - list_max(z)) / 2)) AS f FROM l),
v AS (SELECT vec_id, src, gold, z, t, list_transform(e, lambda x: x / list_sum(e)) AS p, list_transform(f, lambda x: x / list_sum(f)) AS q FROM s)"""
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda x: {f}))"
NLL = "-list_sum(list_transform(range(1, 6), lambda i: t[i] * ln(least(greatest({p}[i], 1e-12), 1))))"
BRIER = "list_sum(list_transform(range(1, 6), lambda i: ({p}[i] - t[i]) * ({p}[i] - t[i])))"
ARGMAX = "(list_position({p}, list_max({p})) - 1)"


def base(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 7).alias("src"), (F.col("label") % K).alias("gold"), "embedding")
    rows = rows.withColumn("z", Q.vector_logits("embedding", "gold", K)).withColumn("t", V.one_hot("gold", K))
    return rows.withColumns({"p": V.softmax("z"), "q": V.softmax("z", 2.0)})


def r6(c, name=None):
    return F.round(c, 6).alias(name or c)


@query(BASE + " SELECT vec_id, i - 1 AS k, round(q[i], 6) AS p FROM v, range(1, 6) AS r(i)")
def softmax_temperature(spark, d):
    return base(spark, d).select("vec_id", F.posexplode("q").alias("k", "p")).select("vec_id", F.col("k").cast("long").alias("k"), r6("p"))


@query(BASE + f" SELECT vec_id, (['a', 'b', 'c', 'd', 'e'])[1 + {ARGMAX.format(p='p')}] AS choice, round(list_max(p), 4) AS probability, round(1 + list_sum(list_transform(p, lambda x: x * ln(x))) / ln(5), 4) AS confidence FROM v")
def typed_choice_answer(spark, d):
    return base(spark, d).select("vec_id", Q.choice_answer(F.array(*map(F.lit, "abcde")), F.col("p")).alias("a")).select("vec_id", "a.*")


@query(BASE + " SELECT vec_id, round(list_sum(list_transform(range(1, 6), lambda i: (i - 1) * p[i])), 4) AS score FROM v")
def typed_score_answer(spark, d):
    return base(spark, d).select("vec_id", F.round(V.expected_level("p"), 4).alias("score"))


@query("SELECT vec_id, round(CAST(1 / (1 + exp(CAST(embedding[1] AS DOUBLE) - CAST(embedding[2] AS DOUBLE))) AS DOUBLE), 4) AS p_yes FROM embeddings")
def typed_noul_answer(spark, d):
    z = F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(V.softmax(z)[1], 4).alias("p_yes"))


@query(BASE + " SELECT vec_id, round(1 + list_sum(list_transform(p, lambda x: x * ln(x))) / ln(5), 6) AS normalised, round(list_max(p), 6) AS top FROM v")
def normalised_confidence(spark, d):
    return base(spark, d).select("vec_id", r6(V.entropy_confidence("p"), "normalised"), r6(F.array_max("p"), "top"))


@query(BASE + " SELECT vec_id, i - 1 AS k, round((p[i] + q[6 - i]) / 2, 6) AS p FROM v, range(1, 6) AS r(i)")
def two_order_ensemble(spark, d):
    both = Q.two_orders(F.col("p"), F.col("q"))
    return base(spark, d).select("vec_id", F.posexplode(both).alias("k", "p")).select("vec_id", F.col("k").cast("long").alias("k"), r6("p"))


@query(BASE + " SELECT vec_id, round(list_sum(list_transform(range(1, 5), lambda c: pow(list_sum(list_transform(range(1, c + 1), lambda i: p[i] - t[i])), 2))) / 4, 6) AS rps FROM v")
def rank_probability_score(spark, d):
    return base(spark, d).select("vec_id", r6(V.ranked_probability_score("p", "t"), "rps"))


@query(BASE + ", w AS (SELECT vec_id, list_transform(z, lambda x: x * 0.7 + 0.1) AS y, z, q, list_transform(z, lambda x: exp((x * 0.7 + 0.1) / 2)) AS e FROM v) SELECT vec_id, round(4 * list_sum(list_transform(range(1, 6), lambda i: q[i] * (ln(q[i]) - ln(e[i] / list_sum(e))))), 6) AS kl FROM w")
def kl_to_teacher(spark, d):
    student = F.transform("z", lambda x: x * 0.7 + 0.1)
    return base(spark, d).select("vec_id", r6(V.kl("z", student), "kl"))


@query(BASE + f" SELECT round(sum(w * loss) / count(*), 6) AS objective FROM (SELECT CASE WHEN src = 0 THEN 2.0 ELSE 1.0 END AS w, -list_sum(list_transform(range(1, 6), lambda i: (0.98 * t[i] + 0.004) * ln(p[i]))) AS loss FROM v)")
def weighted_objective(spark, d):
    loss = -V.dot(V.smoothed("t"), V.log_softmax("z"))
    return base(spark, d).select(F.when(F.col("src") == 0, 2.0).otherwise(1.0).alias("w"), loss.alias("loss")).agg(r6(F.avg(F.col("w") * F.col("loss")), "objective"))


@query(BASE + f" SELECT src, gold, count(*) AS n, round(avg(CASE WHEN {ARGMAX.format(p='p')} = gold THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg({NLL.format(p='p')}), 6) AS nll, round(avg({BRIER.format(p='p')}), 6) AS brier FROM v GROUP BY GROUPING SETS ((src), (gold), ())")
def metrics_by_source_type_overall(spark, d):
    got = M.report(base(spark, d), [["src"], ["gold"], []])
    return got.select("src", "gold", "n", r6("accuracy"), r6("nll"), r6("brier"))


@query(BASE + f", b2 AS (SELECT src, ceil(list_max(p) * 10) - 1 AS bin, count(*) AS n, avg(list_max(p)) AS conf, avg(CASE WHEN {ARGMAX.format(p='p')} = gold THEN 1.0 ELSE 0.0 END) AS acc FROM v GROUP BY ALL) SELECT src, round(sum(n * abs(conf - acc)) / sum(n), 6) AS ece FROM b2 GROUP BY src")
def ece_10_bins(spark, d):
    return M.calibration_error(base(spark, d), ["src"]).select("src", r6("ece"))


LEVEL = "list_sum(list_transform(range(1, 6), lambda i: (i - 1) * {p}[i]))"


@query(BASE + f" SELECT src, round(avg(abs({LEVEL.format(p='p')} - gold) / 4), 6) AS mae, round(avg(CASE WHEN abs({ARGMAX.format(p='p')} - gold) <= 1 THEN 1.0 ELSE 0.0 END), 6) AS within_one FROM v GROUP BY src")
def ordinal_metrics(spark, d):
    return M.ordinal(base(spark, d), K, ["src"]).select("src", r6("mae"), r6("within_one"))


@query(BASE + f""", x AS (SELECT src, round({LEVEL.format(p='p')}, 6) AS e, gold FROM v), r AS (SELECT src, rank() OVER (PARTITION BY src ORDER BY e) + (count(*) OVER (PARTITION BY src, e) - 1) / 2.0 AS a, rank() OVER (PARTITION BY src ORDER BY gold) + (count(*) OVER (PARTITION BY src, gold) - 1) / 2.0 AS b FROM x)
SELECT src, round(corr(a, b), 6) AS spearman FROM r GROUP BY src""")
def spearman_ties(spark, d):
    rows = base(spark, d).select("src", "gold", F.round(V.expected_level("p"), 6).alias("e"))
    return M.spearman(rows, "e", "gold", ["src"]).select("src", r6("spearman"))


@query(BASE + """, g AS (SELECT exp(ln(0.25) + i * (ln(8) - ln(0.25)) / 120) AS temp FROM range(121) AS r(i)), y AS (SELECT src, temp, z[1 + gold] AS own, list_max(z) AS top, z FROM v, g),
n AS (SELECT src, temp, avg(ln(list_sum(list_transform(z, lambda x: exp((x - top) / temp)))) - (own - top) / temp) AS nll FROM y GROUP BY ALL) SELECT src, round(min_by(temp, struct_pack(a := round(nll, 9), b := temp)), 4) AS temperature FROM n GROUP BY src""")
def temperature_fit(spark, d):
    return M.best_temperature(base(spark, d), ["src"])


PRED = f"{ARGMAX.format(p='p')}"
COUNTS = f"count(*) FILTER (WHERE gold = 1 AND {PRED} = 1) AS tp, count(*) FILTER (WHERE gold <> 1 AND {PRED} = 1) AS fp, count(*) FILTER (WHERE gold = 1 AND {PRED} <> 1) AS fn"


@query(BASE + f" SELECT src, round(2.0 * tp / greatest(1, 2 * tp + fp + fn), 6) AS f1 FROM (SELECT src, {COUNTS} FROM v GROUP BY src)")
def positive_f1(spark, d):
    rows = base(spark, d).groupBy("src").agg(*M.binary_counts(F.col("gold") == 1, V.argmax("p") == 1))
    return rows.select("src", r6(M.f1(F.col("tp"), F.col("fp"), F.col("fn")), "f1"))


@query(BASE + f" SELECT src, tp, fp, fn, round(tp / greatest(1, tp + fp), 6) AS precision, round(tp / greatest(1, tp + fn), 6) AS recall FROM (SELECT src, {COUNTS} FROM v GROUP BY src)")
def precision_recall(spark, d):
    rows = base(spark, d).groupBy("src").agg(*M.binary_counts(F.col("gold") == 1, V.argmax("p") == 1))
    return rows.select("src", "tp", "fp", "fn", r6(F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp")), "precision"), r6(F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn")), "recall"))


@query(BASE + f", x AS (SELECT src, gold, {PRED} AS said FROM v), c AS (SELECT src, gold AS c FROM x UNION SELECT src, said FROM x), m AS (SELECT c.src, c.c, count(*) FILTER (WHERE gold = c AND said = c) AS tp, count(*) FILTER (WHERE gold <> c AND said = c) AS fp, count(*) FILTER (WHERE gold = c AND said <> c) AS fn FROM c JOIN x USING (src) GROUP BY ALL) SELECT src, round(avg(2.0 * tp / greatest(1, 2 * tp + fp + fn)), 6) AS macro_f1, count(*) AS classes FROM m GROUP BY src")
def macro_f1(spark, d):
    rows = base(spark, d).select("src", F.col("gold").cast("long").alias("gold"), V.argmax("p").alias("said"))
    return M.macro_f1(rows, "gold", "said", ["src"]).select("src", r6("macro_f1"), "classes")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS top, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    """Exact percentiles by counts along the values; the rest combines before the shuffle."""
    rows = table(spark, d, "events")
    p = percentiles(rows, "event_type", "value", [0.5, 0.9, 0.95]).select(F.col("event_type").alias("g"), "p")
    rest = rows.groupBy("event_type").agg(F.max("value").alias("top"), F.avg("value").alias("mean"))
    return rest.join(p, F.col("event_type").eqNullSafe(F.col("g"))).select("event_type", r6(F.col("p")[0], "p50"), r6(F.col("p")[1], "p90"), r6(F.col("p")[2], "p95"), r6("top"), r6("mean"))


@query("""WITH r AS (SELECT user_id, event_type, max(value) AS need FROM events GROUP BY ALL), x AS (SELECT lim, user_id, need <= lim AS ok FROM r, (VALUES (50), (100), (200), (400)) AS l(lim)), g AS (SELECT lim, user_id, count(*) AS n, count(*) FILTER (WHERE ok) AS fit, bool_and(ok) AS whole FROM x GROUP BY ALL)
SELECT lim, CAST(sum(n) AS BIGINT) AS requests, CAST(sum(fit) AS BIGINT) AS supported, count(*) AS groups, count(*) FILTER (WHERE whole) AS complete_groups FROM g GROUP BY lim""")
def capacity_coverage(spark, d):
    need = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("need"))
    each = need.select("user_id", "need", F.explode(F.array(*map(F.lit, (50, 100, 200, 400)))).alias("lim"))
    groups = each.groupBy("lim", "user_id").agg(F.count("*").alias("n"), F.count_if(F.col("need") <= F.col("lim")).alias("fit"), F.bool_and(F.col("need") <= F.col("lim")).alias("whole"))
    return groups.groupBy("lim").agg(F.sum("n").alias("requests"), F.sum("fit").alias("supported"), F.count("*").alias("groups"), F.count_if("whole").alias("complete_groups"))


@query("SELECT round(avg(m), 6) AS macro_mean FROM (SELECT event_type, avg(value) AS m FROM events GROUP BY event_type)")
def macro_family_mean(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("m")).agg(r6(F.avg("m"), "macro_mean"))


@query("SELECT round(sum(n * m) / sum(n), 6) AS weighted FROM (SELECT event_type, count(*) AS n, avg(value) AS m FROM events WHERE event_type <> 'click' GROUP BY event_type)")
def weighted_subset_mean(spark, d):
    rows = table(spark, d, "events").where("event_type <> 'click'").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("m"))
    return rows.agg(r6(F.sum(F.col("n") * F.col("m")) / F.sum("n"), "weighted"))


FAMILY = BASE + f", a AS (SELECT src, avg(CASE WHEN {ARGMAX.format(p='p')} = gold THEN 1.0 ELSE 0.0 END) AS candidate, avg(CASE WHEN vec_id % 5 = gold THEN 1.0 ELSE 0.0 END) AS baseline FROM v GROUP BY src)"


def families(spark, d):
    return base(spark, d).groupBy("src").agg(F.avg(M.hit()).alias("candidate"), F.avg((F.col("vec_id") % 5 == F.col("gold")).cast("double")).alias("baseline"))


@query(FAMILY + " SELECT round(0.7 * avg(candidate) FILTER (WHERE src <> 0) + 0.3 * avg(candidate) FILTER (WHERE src = 0), 6) AS objective, bool_and(candidate >= baseline - 0.02) AS guarded FROM a")
def objective_and_guards(spark, d):
    focus, kept = (F.avg(F.when(c, F.col("candidate"))) for c in (F.col("src") != 0, F.col("src") == 0))
    return families(spark, d).agg(r6(0.7 * focus + 0.3 * kept, "objective"), F.bool_and(F.col("candidate") >= F.col("baseline") - 0.02).alias("guarded"))


@query(FAMILY + " SELECT src, round(candidate - baseline, 6) AS delta FROM a ORDER BY delta, src LIMIT 5")
def largest_deficits(spark, d):
    return families(spark, d).select("src", r6(F.col("candidate") - F.col("baseline"), "delta")).orderBy("delta", "src").limit(5)


@query(BASE + f" SELECT count(*) AS n, round(avg({BRIER.format(p='p')} - {BRIER.format(p='q')}), 6) AS delta FROM v")
def paired_delta(spark, d):
    p, q = base(spark, d).select("vec_id", V.brier("p", "t").alias("x")), base(spark, d).select("vec_id", V.brier("q", "t").alias("y"))
    return p.join(q, "vec_id").agg(F.count("*").alias("n"), r6(F.avg(F.col("x") - F.col("y")), "delta"))


@query(BASE + f""", x AS (SELECT src, vec_id, round({BRIER.format(p='p')} - {BRIER.format(p='q')}, 9) AS y FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY vec_id) - 1 AS pos, count(*) OVER (PARTITION BY src) AS m FROM x),
w AS (SELECT src, j, CAST(('0x' || substr(md5(concat_ws('|', '11', CAST(j AS VARCHAR), CAST(vec_id AS VARCHAR))), 1, 8)) AS BIGINT) % m AS pos FROM r, range(5000) AS g(j)), d AS (SELECT j, avg(y) AS mean FROM w JOIN r USING (src, pos) GROUP BY j)
SELECT round((SELECT avg(y) FROM x), 6) AS delta, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM d""")
def stratified_bootstrap(spark, d):
    rows = base(spark, d).select("src", "vec_id", F.round(V.brier("p", "t") - V.brier("q", "t"), 9).alias("y"))
    return M.bootstrap_interval(rows, "src", "vec_id", "y", 5000, 11).select(r6("delta"), r6("low"), r6("high"))


@query(BASE + f", m AS (SELECT *, list_transform(range(1, 6), lambda i: 0.6 * p[i] + 0.4 * q[6 - i]) AS u FROM v) SELECT count(*) FILTER (WHERE {ARGMAX.format(p='p')} <> {ARGMAX.format(p='u')}) AS flips, round(max(list_max(list_transform(range(1, 6), lambda i: abs(p[i] - u[i])))), 6) AS drift FROM m")
def argmax_drift(spark, d):
    u = F.zip_with("p", F.reverse("q"), lambda a, b: 0.6 * a + 0.4 * b)
    gap = F.array_max(F.zip_with("p", "u", lambda a, b: F.abs(a - b)))
    return base(spark, d).withColumn("u", u).agg(F.count_if(V.argmax("p") != V.argmax("u")).alias("flips"), r6(F.max(gap), "drift"))


@query(BASE + f" SELECT round(avg({NLL.format(p='q')}) - avg({NLL.format(p='p')}), 6) AS nll_gain, avg({NLL.format(p='q')}) - avg({NLL.format(p='p')}) <= 0.02 AS nll_ok, avg(CASE WHEN {ARGMAX.format(p='p')} = {ARGMAX.format(p='q')} THEN 1.0 ELSE 0.0 END) AS agreement FROM v")
def quantisation_gates(spark, d):
    gain = F.avg(V.nll("q", "t")) - F.avg(V.nll("p", "t"))
    return base(spark, d).agg(r6(gain, "nll_gain"), (gain <= 0.02).alias("nll_ok"), F.avg((V.argmax("p") == V.argmax("q")).cast("double")).alias("agreement"))


@query(BASE + f", m AS (SELECT *, list_transform(range(1, 6), lambda i: (p[i] + q[i]) / 2) AS u FROM v), a AS (SELECT src, avg(CASE WHEN {ARGMAX.format(p='p')} = gold THEN 1.0 ELSE 0.0 END) AS one, avg(CASE WHEN {ARGMAX.format(p='u')} = gold THEN 1.0 ELSE 0.0 END) AS two FROM m GROUP BY src) SELECT (SELECT avg({NLL.format(p='u')}) < avg({NLL.format(p='p')}) FROM m) AND round(avg(two), 9) >= round(avg(one), 9) AS use_two FROM a")
def order_policy_choice(spark, d):
    u = F.zip_with("p", "q", lambda a, b: (a + b) / 2)
    rows = base(spark, d).withColumn("u", u).select("src", V.nll("p", "t").alias("x"), V.nll("u", "t").alias("y"), M.hit().alias("one"), M.hit("u").alias("two"))
    each = rows.groupBy("src").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.avg("one").alias("one"), F.avg("two").alias("two"))
    return each.agg(((F.sum("y") < F.sum("x")) & (F.round(F.avg("two"), 9) >= F.round(F.avg("one"), 9))).alias("use_two"))


@query(BASE + " SELECT vec_id, len(p) = 5 AND list_bool_and(list_transform(p, lambda x: isfinite(x) AND x >= 0)) AND list_sum(p) > 0 AS valid FROM v")
def distribution_validity(spark, d):
    ok = (F.size("p") == K) & F.forall("p", lambda x: ~F.isnan(x) & (x < float("inf")) & (x >= 0)) & (V.total("p") > 0)
    return base(spark, d).select("vec_id", ok.alias("valid"))


@query(BASE + " SELECT round(sum(CASE WHEN rel > 0 THEN rel / ln(r + 1) ELSE 0 END) * ln(2) / count(DISTINCT src), 6) AS ndcg FROM (SELECT src, row_number() OVER (PARTITION BY src ORDER BY list_max(p) DESC, vec_id) AS r, CASE WHEN gold = 1 THEN 1.0 ELSE 0.0 END AS rel FROM v) WHERE r <= 10")
def discounted_gain_at_10(spark, d):
    r = F.row_number().over(Window.partitionBy("src").orderBy(F.desc(F.array_max("p")), "vec_id"))
    rows = base(spark, d).withColumn("r", r).where("r <= 10").select("src", "r", F.when(F.col("gold") == 1, 1.0).otherwise(0.0).alias("rel"))
    return rows.agg(r6(F.sum(F.col("rel") / F.log2(F.col("r") + 1.0)) / F.countDistinct("src"), "ndcg"))
