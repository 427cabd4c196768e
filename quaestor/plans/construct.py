"""Queries that build examples, render prompts and check requests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import vectors as V
from ..operators import examples as X
from ..operators import selection as S
from ..sources.session import table
from .registry import query
from .select import bucket, norm, seeded


def _labelled(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, CAST(1 - quality AS DOUBLE) AS p_no, CAST(quality AS DOUBLE) AS p_yes, 'noul' AS type FROM documents JOIN labels USING (doc_id)")
def noul_from_quality(spark, d):
    target = X.noul_target(F.col("quality"))
    return _labelled(spark, d).select("doc_id", target[0].alias("p_no"), target[1].alias("p_yes"), F.lit("noul").alias("type"))


LANGS = ("de", "en", "es", "fr")
KEYS = "['de', 'en', 'es', 'fr']"
SHUFFLED = f"list_transform(list_sort(list_transform({KEYS}, lambda k: sha256(concat_ws('|', 'order', CAST(doc_id AS VARCHAR), k)) || k)), lambda x: substr(x, 65))"


@query(f"SELECT doc_id, array_to_string({SHUFFLED}, ',') AS options, list_position({SHUFFLED}, lang) - 1 AS gold FROM documents")
def choice_from_lang(spark, d):
    options = X.shuffled(F.array(*map(F.lit, LANGS)), "order", "doc_id")
    return table(spark, d, "documents").withColumn("o", options).select("doc_id", F.array_join("o", ",").alias("options"), (F.array_position("o", F.col("lang")) - 1).alias("gold"))


OTHERS = f"list_filter({SHUFFLED}, lambda k: k <> lang)"


@query(f"SELECT doc_id, array_to_string(list_sort(list_concat([lang], {OTHERS}[1:2])), ',') AS options FROM documents")
def choice_subset_keeps_gold(spark, d):
    picked = X.subset_with_gold(X.shuffled(F.array(*map(F.lit, LANGS)), "order", "doc_id"), F.col("lang"), 3)
    return table(spark, d, "documents").select("doc_id", F.array_join(F.sort_array(picked), ",").alias("options"))


@query(f"""SELECT doc_id, CASE WHEN {bucket("'half|' || doc_id")} < 0.5 THEN lang ELSE {OTHERS}[1] END AS asked, CASE WHEN {bucket("'half|' || doc_id")} < 0.5 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS p_yes FROM documents""")
def multiclass_to_noul(spark, d):
    own = K.bucket(F.concat(F.lit("half|"), F.col("doc_id").cast("string"))) < 0.5
    other = F.filter(X.shuffled(F.array(*map(F.lit, LANGS)), "order", "doc_id"), lambda k: k != F.col("lang"))
    return table(spark, d, "documents").select("doc_id", F.when(own, F.col("lang")).otherwise(F.get(other, F.lit(0))).alias("asked"), F.when(own, 1.0).otherwise(0.0).alias("p_yes"))


SCORE = "least(n_chars / 10000.0 * 4, 4.0)"


@query(f"SELECT doc_id, level, round(CASE WHEN level = floor(v) THEN 1 - (v - floor(v)) WHEN level = floor(v) + 1 THEN v - floor(v) ELSE 0 END, 6) AS p FROM (SELECT doc_id, CAST({SCORE} AS DOUBLE) AS v, unnest(range(5)) AS level FROM documents)")
def score_fractional_target(spark, d):
    target = X.score_target(X.rescaled(F.col("n_chars"), 10000.0, 5), 5)
    return table(spark, d, "documents").select("doc_id", F.posexplode(target).alias("level", "p")).select("doc_id", F.col("level").cast("long").alias("level"), F.round("p", 6).alias("p"))


@query("SELECT doc_id, round(CAST(least((10000.0 - least(n_chars, 10000)) / 10000.0 * 9, 9.0) AS DOUBLE), 6) AS value FROM documents")
def score_reversed_scale(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(X.rescaled(10000.0 - F.least("n_chars", F.lit(10000)), 10000.0, 10), 6).alias("value"))


@query(f"SELECT doc_id, 'option_' || (list_position({SHUFFLED}, lang) - 1) AS gold_key, array_to_string(list_transform({SHUFFLED}, lambda k, i: 'option_' || (i - 1) || '=' || k), ';') AS options FROM documents")
def anonymous_option_keys(spark, d):
    o = X.shuffled(F.array(*map(F.lit, LANGS)), "order", "doc_id")
    named = X.anonymous(F.col("o"))
    return table(spark, d, "documents").withColumn("o", o).select("doc_id", F.concat(F.lit("option_"), (F.array_position("o", F.col("lang")) - 1).cast("string")).alias("gold_key"), F.array_join(F.transform(named, lambda x: F.concat(x["key"], F.lit("="), x["desc"])), ";").alias("options"))


@query(f"SELECT doc_id, list_position({KEYS}, lang) - 1 AS gold, lang AS gold_text FROM documents")
def gold_index_roundtrip(spark, d):
    keys = F.array(*map(F.lit, LANGS))
    hot = V.one_hot(F.array_position(keys, F.col("lang")) - 1, 4)
    gold = F.array_position(hot, 1.0) - 1
    return table(spark, d, "documents").withColumn("gold", gold).select("doc_id", "gold", F.get(keys, F.col("gold").cast("int")).alias("gold_text"))


@query("""WITH c AS (SELECT source, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL), t AS (SELECT source, sum(n) AS total, count(*) AS k FROM c GROUP BY source),
w AS (SELECT c.*, least(3.0, total / (k * n)) AS raw FROM c JOIN t USING (source)), m AS (SELECT source, sum(raw * n) / sum(n) AS mean FROM w GROUP BY source) SELECT source, quality, round(CAST(raw / mean AS DOUBLE), 6) AS weight FROM w JOIN m USING (source)""")
def class_weights_capped(spark, d):
    return X.class_weights(_labelled(spark, d), "source", "quality").withColumn("weight", F.round("weight", 6))


@query("SELECT doc_id, round(CAST(0.98 * (1 - quality) + 0.01 AS DOUBLE), 6) AS p_no, round(CAST(0.98 * quality + 0.01 AS DOUBLE), 6) AS p_yes FROM documents JOIN labels USING (doc_id)")
def label_smoothing(spark, d):
    t = V.smoothed(X.noul_target(F.col("quality")))
    return _labelled(spark, d).withColumn("t", t).select("doc_id", F.round(F.col("t")[0], 6).alias("p_no"), F.round(F.col("t")[1], 6).alias("p_yes"))


@query("""WITH a AS (SELECT vec_id, unnest(list_transform(embedding, lambda x: greatest(CAST(x AS DOUBLE), 0.0))) AS p, unnest(range(len(embedding))) AS k FROM embeddings), s AS (SELECT vec_id, sum(p) AS s FROM a GROUP BY vec_id)
SELECT vec_id, k, round(p / s, 5) AS p FROM a JOIN s USING (vec_id) WHERE s > 0""")
def soft_label_normalise(spark, d):
    v = V.normalised(F.transform("embedding", lambda x: x.cast("double")))
    rows = table(spark, d, "embeddings").select("vec_id", v.alias("v")).where("v IS NOT NULL")
    return rows.select("vec_id", F.posexplode("v").alias("k", "p")).select("vec_id", F.col("k").cast("long").alias("k"), F.round("p", 5).alias("p"))


#: Five different numbers below n of each row (all, if n is less): draw i is a number up to i, or i where that is taken.
DRAWN = "WITH s0 AS (SELECT o_orderkey, gold, n, []::BIGINT[] AS taken FROM g, m), " + ", ".join(
    f"""s{i + 1} AS (SELECT o_orderkey, gold, n, CASE WHEN i < 0 THEN taken WHEN list_contains(taken, x) THEN list_append(taken, i) ELSE list_append(taken, x) END AS taken
    FROM (SELECT *, CASE WHEN i >= 0 THEN CAST(('0x' || substr({seeded(4, 'o_orderkey', 'i')}, 1, 12)) AS BIGINT) % (i + 1) END AS x FROM (SELECT *, n - 5 + {i} AS i FROM s{i})))"""
    for i in range(5)
)


@query(f"""WITH c AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS no FROM (SELECT DISTINCT p_type FROM part)), m AS (SELECT count(*) - 1 AS n FROM c),
g AS (SELECT l_orderkey AS o_orderkey, min(p_type) AS gold FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
d AS ({DRAWN} SELECT o_orderkey, list_transform(taken, lambda x: CASE WHEN x >= no THEN x + 1 ELSE x END) AS chosen FROM s5 JOIN c ON c.p_type = gold)
SELECT o_orderkey, p_type FROM (SELECT o_orderkey, unnest(chosen) AS no FROM d) JOIN c USING (no)""")
def catalog_distractors(spark, d):
    """Five other types for each order, whose own is the least of all its lines."""
    part = table(spark, d, "part")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    rows = lines.join(part.select("p_partkey", "p_type"), "p_partkey").groupBy("o_orderkey").agg(F.min("p_type").alias("gold"))
    return X.distractors(rows, part, "p_type", "gold", "o_orderkey", 5, 4)


@query("SELECT conv_id, turn, sha256(prefix) AS state, turns FROM (SELECT conv_id, turn, role, string_agg(role || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS turns FROM conversations) WHERE role = 'user' AND turns <= 12")
def conversation_prefix_states(spark, d):
    return X.prefix_states(table(spark, d, "conversations"), 12).select("conv_id", "turn", F.sha2("state", 256).alias("state"), "turns")


@query("SELECT event_id, key, value FROM (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events), LATERAL (SELECT json_extract_string(props, '$.' || key) AS value)")
def entity_explode(spark, d):
    m = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select("event_id", F.explode(m).alias("key", "value"))


@query("SELECT source, CASE WHEN source LIKE '%1%' THEN 'one' WHEN source LIKE '%2%' THEN 'two' WHEN source LIKE 'src%' THEN substr(source, 4) ELSE 'other' END AS family, count(*) AS n FROM documents GROUP BY ALL")
def family_mapping(spark, d):
    s = F.col("source")
    family = F.when(s.contains("1"), "one").when(s.contains("2"), "two").when(s.startswith("src"), F.substring("source", 4, 100)).otherwise("other")
    return table(spark, d, "documents").groupBy("source", family.alias("family")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'retention:' || source WHEN source LIKE 'src1%' THEN 'distill' ELSE source END AS source FROM documents")
def source_retag(spark, d):
    return table(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "en", F.concat(F.lit("retention:"), "source")).when(F.col("source").startswith("src1"), "distill").otherwise(F.col("source")).alias("source"))


@query("SELECT page_id, upper(left(t, 1)) || lower(substr(t, 2)) AS title FROM (SELECT page_id, replace(regexp_extract(url, '([^/]+)/?$', 1), '_', ' ') AS t FROM pages)")
def key_prettifier(spark, d):
    t = F.replace(F.regexp_extract("url", "([^/]+)/?$", 1), F.lit("_"), F.lit(" "))
    return table(spark, d, "pages").select("page_id", F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 100000))).alias("title"))


@query(f"SELECT doc_id, (['Which language?', 'Name the language.', 'Pick one.'])[1 + CAST(('0x' || substr({seeded('template', 'doc_id')}, 1, 8)) AS BIGINT) % 3] AS instructions FROM documents")
def template_pick(spark, d):
    options = F.array(F.lit("Which language?"), F.lit("Name the language."), F.lit("Pick one."))
    return table(spark, d, "documents").select("doc_id", X.picked(options, "template", "doc_id").alias("instructions"))


@query("""SELECT part_id, p FROM (SELECT p_partkey AS part_id, unnest([p_name, p_brand]) AS p FROM part WHERE p_name <> p_brand)""")
def rephrase_expansion(spark, d):
    return table(spark, d, "part").where("p_name <> p_brand").select(F.col("p_partkey").alias("part_id"), F.explode(F.array("p_name", "p_brand")).alias("p"))


@query(f"SELECT o_orderkey, CASE WHEN flip THEN b ELSE a END AS first, CASE WHEN flip THEN a ELSE b END AS second, CASE WHEN flip THEN 1 ELSE 0 END AS gold FROM (SELECT o_orderkey, o_orderpriority AS a, o_orderstatus AS b, {bucket(seeded('pair', 'o_orderkey'))} < 0.5 AS flip FROM orders)")
def preference_pair_order(spark, d):
    flip = K.bucket(K.seeded("pair", "o_orderkey")) < 0.5
    pick = lambda x, y: F.when(flip, F.col(y)).otherwise(F.col(x))
    return table(spark, d, "orders").select("o_orderkey", pick("o_orderpriority", "o_orderstatus").alias("first"), pick("o_orderstatus", "o_orderpriority").alias("second"), F.when(flip, 1).otherwise(0).alias("gold"))


@query("""SELECT doc_id, sha256('State:' || chr(10) || text || chr(10) || 'Question: Which language?' || chr(10) || 'A: de' || chr(10) || 'B: en' || chr(10) || 'C: es' || chr(10) || 'D: fr') AS prompt FROM documents""")
def render_prompt(spark, d):
    options = F.transform(F.array(*map(F.lit, LANGS)), lambda k: F.struct(k.alias("key"), F.lit(None).cast("string").alias("desc")))
    return table(spark, d, "documents").select("doc_id", F.sha2(X.prompt(F.col("text"), F.lit("Which language?"), options), 256).alias("prompt"))


@query("SELECT * FROM (VALUES (1, 'choice', 1, 'options'), (2, 'choice', 2, 'ok'), (3, 'choice', 255, 'ok'), (4, 'choice', 256, 'options'), (5, 'score', 10, 'ok'), (6, 'score', 11, 'options'), (7, 'noul', 0, 'ok'), (8, 'noul', 2, 'options'), (9, 'other', 2, 'type'), (10, 'choice', 3, 'instructions')) AS t(id, type, n, reason)")
def validate_requests(spark, d):
    rows = [(1, "choice", 1, "x"), (2, "choice", 2, "x"), (3, "choice", 255, "x"), (4, "choice", 256, "x"), (5, "score", 10, "x"), (6, "score", 11, "x"), (7, "noul", 0, "x"), (8, "noul", 2, "x"), (9, "other", 2, "x"), (10, "choice", 3, " ")]
    df = spark.createDataFrame(rows, "id int, type string, n int, instructions string")
    return df.select("id", "type", "n", X.question_fault(F.col("type"), F.col("instructions"), F.col("n")).alias("reason"))


@query("SELECT user_id, count(*) AS n_questions, bool_and(length(props) <= 60) AS fits, count(*) BETWEEN 1 AND 64 AS allowed FROM events GROUP BY user_id")
def whole_request_capacity(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n_questions"), F.bool_and(F.length("props") <= 60).alias("fits"), F.count("*").between(1, 64).alias("allowed"))


@query("SELECT doc_id, CASE WHEN len(w) <= 100 THEN array_to_string(w, ' ') ELSE array_to_string(w[1:50], ' ') || chr(10) || '[...]' || chr(10) || array_to_string(w[len(w) - 49:], ' ') END AS cut FROM (SELECT doc_id, regexp_split_to_array(text, ' ') AS w FROM documents)")
def middle_truncation(spark, d):
    return table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("w")).select("doc_id", X.middle_cut(F.col("w"), 100).alias("cut"))


@query("SELECT conv_id, array_to_string(list(text ORDER BY turn), chr(10) || chr(10)) AS state FROM conversations GROUP BY conv_id")
def list_state_rendering(spark, d):
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(turns, "\n\n").alias("state"))


@query("SELECT id, n FROM (VALUES (1, 2), (2, 27), (3, 255)) AS t(id, n0), LATERAL (SELECT CASE WHEN n0 <= 26 THEN chr(64 + n0) ELSE chr(65 + (n0 - 27) // 26) || chr(65 + (n0 - 27) % 26) END AS n)")
def label_allocation(spark, d):
    return spark.createDataFrame([(1, 2), (2, 27), (3, 255)], "id int, n0 int").select("id", F.element_at(X.labels(), F.col("n0")).alias("n"))


@query("SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '(?i)licensed under') AND length(text) <= 5000")
def refusal_and_length_filter(spark, d):
    return table(spark, d, "documents").where(~F.col("text").rlike("(?i)licensed under") & (F.length("text") <= 5000)).select("doc_id")


@query("SELECT conv_id, count(*) = count(DISTINCT text) AS unique_turns FROM conversations GROUP BY conv_id")
def unique_member_filter(spark, d):
    all_ = F.collect_list("text")
    return table(spark, d, "conversations").groupBy("conv_id").agg((F.size(F.array_distinct(all_)) == F.size(all_)).alias("unique_turns"))


FLAG = f"""WITH a AS (SELECT d.doc_id, d.lang, l.quality, sha256({norm('d.text')}) AS k FROM documents d JOIN labels l USING (doc_id)), u AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS r FROM a),
x AS (SELECT DISTINCT k FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[\\n.]')) AS s, text FROM documents), LATERAL (SELECT {norm('s')} AS n), LATERAL (SELECT sha256({norm('text')}) AS k) WHERE length(n) >= 32 AND n IN (SELECT {norm('s')} FROM (SELECT unnest(regexp_split_to_array(text, '[\\n.]')) AS s FROM benchmark))),
s AS (SELECT doc_id, lang, quality, CASE WHEN {bucket('k')} < 0.76 THEN 'train' WHEN {bucket('k')} < 0.84 THEN 'val' WHEN {bucket('k')} < 0.92 THEN 'calibration' ELSE 'test' END AS split FROM u WHERE r = 1 AND k NOT IN (SELECT k FROM x)),
b AS (SELECT *, row_number() OVER (PARTITION BY split, quality ORDER BY {seeded(1, 'doc_id')}, doc_id) AS t FROM s), p AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY t, quality) AS p FROM b WHERE t <= 100)
SELECT split, quality, count(*) AS n FROM p WHERE p <= 100 GROUP BY ALL"""


@query(FLAG)
def leak_free_dataset(spark, d):
    return flagship(spark, d)


def flagship(spark, d):
    """Documents with labels become yes/no examples without duplicates or protected content, split by content and
    balanced by class; counts by split and class."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "quality", "text", K.state_key("text").alias("k"))
    one = S.first_by(docs, ["k"], ["doc_id"])
    blocked = table(spark, d, "benchmark").select(F.explode(K.content_atoms("text")).alias("a"))
    clean = S.exclude_overlap(one, K.content_atoms("text"), blocked, "a", "doc_id").drop("text")
    split = S.split_by(K.bucket("k"), [(0.76, "train"), (0.84, "val"), (0.92, "calibration")], "test")
    sample = S.round_robin(clean.withColumn("split", split), ["split"], "quality", 100, 1, "doc_id")
    return sample.groupBy("split", "quality").agg(F.count("*").alias("n"))
