"""Queries of prompts by type, foreign answers, rule trees, list programs, splits, dictionaries and checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import vectors as V
from ..operators import generators as G
from ..operators import prompts as P
from ..operators import trees as T
from ..operators.manifest import fingerprint
from ..sources.session import Workspace, table
from .registry import query
from .score import ARGMAX, BASE, base, r6
from .select import bucket, norm

NAMES = {"de": "German", "en": "English", "es": "Spanish", "fr": "French"}
NL = "' || chr(10) || '"
ASKED = f"""'<state>{NL}' || text || '{NL}</state>{NL}{NL}Question: Which one?{NL}' || CASE doc_id % 3
WHEN 0 THEN 'Options:{NL}{NL.join(f"{'ABCD'[i]}: {k}: {v}" for i, (k, v) in enumerate(NAMES.items()))}{NL}Answer with the label of the best option (A-D).'
WHEN 1 THEN 'Scale (lowest to highest):{NL}{NL.join(f"{i}: {v}" for i, v in enumerate(NAMES.values()))}{NL}Answer with the level number (0-3).' ELSE 'Answer yes or no.' END"""


def _asked():
    kind = F.get(F.array(F.lit("choice"), F.lit("score"), F.lit("noul")), (F.col("doc_id") % 3).cast("int"))
    options = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("desc")) for k, v in NAMES.items()))
    return P.user_prompt(kind, F.col("text"), F.lit("Which one?"), options)


@query(f"SELECT doc_id, sha256({ASKED}) AS prompt FROM documents")
def prompts_by_type(spark, d):
    """Choice, score and yes/no prompts."""
    return table(spark, d, "documents").select("doc_id", F.sha2(_asked(), 256).alias("prompt"))


@query(f"SELECT doc_id, sha256('<|im_start|>system{NL}Answer with one label.<|im_end|>{NL}<|im_start|>user{NL}' || {ASKED} || '<|im_end|>{NL}<|im_start|>assistant{NL}') AS prompt FROM documents")
def chat_prompts(spark, d):
    """Prompts in a chat template, which is a parameter."""
    return table(spark, d, "documents").select("doc_id", F.sha2(P.chat([("system", F.lit("Answer with one label.")), ("user", _asked())]), 256).alias("prompt"))


@query("""SELECT event_id, CAST(CASE event_id % 7 WHEN 0 THEN 0.75 WHEN 1 THEN 0.25 WHEN 2 THEN 0 WHEN 3 THEN 0.5 WHEN 4 THEN 0.125 WHEN 5 THEN NULL ELSE 0.375 END AS DOUBLE) AS p0,
CAST(CASE event_id % 7 WHEN 0 THEN 0.25 WHEN 1 THEN 0.75 WHEN 2 THEN 0.75 WHEN 3 THEN 0.25 WHEN 4 THEN 0.875 WHEN 5 THEN NULL ELSE 0.625 END AS DOUBLE) AS p1,
CAST(CASE event_id % 7 WHEN 3 THEN 3 WHEN 5 THEN NULL ELSE 2 END AS BIGINT) AS n FROM events""")
def foreign_distributions(spark, d):
    """Answers of several layouts as distributions; one that gives none is null."""
    forms = [("noul", '{"probability": 0.25}'), ("noul", '{"yes": 0.75}'), ("choice", '{"distribution": {"view": 0.75}}'), ("choice", '{"probabilities": [0.5, 0.25, 0.25]}'), ("score", '{"probabilities": {"0": 0.125, "1": 0.875}}'), ("choice", '{"choice": "click"}'), ("score", '{"distribution": [{"probability": 0.375}, {"probability": 0.625}]}')]
    form = F.get(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(a).alias("answer")) for k, a in forms)), (F.col("event_id") % 7).cast("int"))
    rows = table(spark, d, "events").select("event_id", form.alias("f"))
    rows = rows.select("event_id", P.answer_probabilities(F.col("f.kind"), F.col("f.answer"), ["click", "view"]).alias("p"))
    return rows.select("event_id", F.get("p", F.lit(0)).alias("p0"), F.get("p", F.lit(1)).alias("p1"), F.array_size("p").cast("long").alias("n"))


@query(BASE + " SELECT vec_id, i - 1 AS k, round(z[i], 4) AS logit, round(p[i], 6) AS p FROM v, range(1, 6) AS r(i)")
def golden_records(spark, d):
    """Logits to four decimals and probabilities to six."""
    rows = base(spark, d).select("vec_id", F.posexplode(F.arrays_zip("z", "p")).alias("k", "x"))
    return rows.select("vec_id", F.col("k").cast("long").alias("k"), F.round("x.z", 4).alias("logit"), r6("x.p", "p"))


@query(BASE + f""", m AS (SELECT *, list_transform(range(1, 6), lambda i: 0.97 * p[i] + 0.03 * q[i]) AS u FROM v), d AS (SELECT src, avg(CASE WHEN {ARGMAX.format(p='p')} <> {ARGMAX.format(p='u')} THEN 1.0 ELSE 0.0 END) AS flips, max(list_max(list_transform(range(1, 6), lambda i: abs(p[i] - u[i])))) AS gap FROM m GROUP BY src)
SELECT src, round(flips, 6) AS flips, round(gap, 6) AS gap, flips = 0 AND gap <= 0.05 AS same, flips <= 0.03 AND gap < 0.075 AS near FROM d""")
def drift_limits(spark, d):
    """Share of changed answers and the largest change of a probability, with their limits."""
    u = F.zip_with("p", "q", lambda a, b: 0.97 * a + 0.03 * b)
    rows = base(spark, d).withColumn("u", u).withColumn("gap", F.array_max(F.zip_with("p", "u", lambda a, b: F.abs(a - b))))
    got = rows.groupBy("src").agg(F.avg((V.argmax("p") != V.argmax("u")).cast("double")).alias("flips"), F.max("gap").alias("gap"))
    return got.select("src", r6("flips"), r6("gap"), ((F.col("flips") == 0) & (F.col("gap") <= 0.05)).alias("same"), ((F.col("flips") <= 0.03) & (F.col("gap") < 0.075)).alias("near"))


GROUP = f"CASE WHEN starts_with(source, 'src1') THEN 'Which language?' ELSE {norm('text')} END"
PLACE = bucket(f"source || '|' || {GROUP}")


@query(f"SELECT doc_id, CASE WHEN source = 'src2' THEN 'test' WHEN {PLACE} < 0.05 THEN 'test' WHEN {PLACE} < 0.1 THEN 'val' ELSE 'train' END AS split FROM documents WHERE text IS NOT NULL")
def three_way_split(spark, d):
    """Test first, then val; one source is held out; some sources go by their instructions, others by their state."""
    group = F.when(F.col("source").startswith("src1"), "Which language?").otherwise(K.normalized("text"))
    place = K.bucket(F.concat_ws("|", "source", group))
    split = F.when((F.col("source") == "src2") | (place < 0.05), "test").when(place < 0.1, "val").otherwise("train")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", split.alias("split"))


@query("SELECT o_orderkey, CASE WHEN y <= 1994 THEN 'train' WHEN y <= 1996 THEN 'selection' ELSE 'test' END AS split FROM (SELECT o_orderkey, year(CAST(o_orderdate AS DATE)) AS y FROM orders)")
def year_range_split(spark, d):
    y = F.year(F.col("o_orderdate").cast("date"))
    return table(spark, d, "orders").select("o_orderkey", F.when(y <= 1994, "train").when(y <= 1996, "selection").otherwise("test").alias("split"))


LINES = f"list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: {norm('x')}), lambda x: length(x) >= {{n}}))"


@query(f"""SELECT doc_id, 'whole' AS variant, sha256({norm('text')}) AS key FROM documents WHERE length({norm('text')}) > 30
UNION ALL SELECT doc_id, 'lines', sha256(x) FROM (SELECT doc_id, unnest({LINES.format(n=20)}) AS x FROM documents) UNION ALL SELECT doc_id, 'long', sha256(x) FROM (SELECT doc_id, unnest({LINES.format(n=80)}) AS x FROM documents)""")
def content_key_variants(spark, d):
    """Key sets: whole texts of more than 30 characters, lines of 20 or more and instructions of 80 or more."""
    lines = F.transform(F.split("text", "\n"), K.normalized)
    keys = lambda name, parts, least: F.transform(F.array_distinct(F.filter(parts, lambda x: F.length(x) >= least)), lambda x: F.struct(F.lit(name).alias("variant"), F.sha2(x, 256).alias("key")))
    every = F.concat(keys("whole", F.array(K.normalized("text")), 31), keys("lines", lines, 20), keys("long", lines, 80))
    return table(spark, d, "documents").select("doc_id", F.explode(every).alias("x")).select("doc_id", "x.*")


MARK = "CAST(sum(CAST(('0x' || substr(md5(concat_ws('|', {0})), 1, 8)) AS BIGINT)) AS BIGINT)"


@query(f"""WITH b AS (SELECT count(*) AS n, {MARK.format('item_id, text')} AS m FROM benchmark), l AS (SELECT count(*) AS n, {MARK.format('doc_id, quality, toxic')} AS m FROM labels),
z AS (SELECT count(*) AS n, {MARK.format('doc_id, CASE WHEN doc_id % 100 = 7 THEN 1 - quality ELSE quality END, toxic')} AS m FROM labels)
SELECT 'benchmark' AS name, n, m AS checksum, true AS unchanged FROM b UNION ALL SELECT 'labels', z.n, z.m, z.n = l.n AND z.m = l.m FROM l, z""")
def protected_table_unchanged(spark, d):
    """Protected tables against the fingerprints noted before a job wrote them: one as it was, one with labels turned over."""
    work, out = Workspace(spark), None
    turned = F.when(F.col("doc_id") % 100 == 7, 1 - F.col("quality")).otherwise(F.col("quality"))
    jobs = (("benchmark", ["item_id", "text"], lambda rows: rows), ("labels", ["doc_id", "quality", "toxic"], lambda rows: rows.withColumn("quality", turned)))
    for name, columns, job in jobs:
        rows = table(spark, d, name).select(*columns)
        noted = fingerprint(rows, columns).first()  # one row
        now = fingerprint(work.write(job(rows), name), columns)
        same = F.col("n").eqNullSafe(F.lit(noted["n"])) & F.col("checksum").eqNullSafe(F.lit(noted["checksum"]))
        one = now.select(F.lit(name).alias("name"), "n", "checksum", same.alias("unchanged"))
        out = one if out is None else out.unionByName(one)
    return out


LEAF = [f"CAST(('0x' || substr(md5('leaf{i}|' || id), 1, 8)) AS BIGINT) AS x{i}" for i in range(5)]
SAID = [f"((x // (CAST(1 AS BIGINT) << (x{i} % 5))) % 2 = 1) <> (x{i} // 5 % 10 < 3)" for i in range(5)]
WORD = [f"CASE WHEN x{i} // 5 % 10 < 3 THEN 'not ' ELSE '' END || 'abcde'[x{i} % 5 + 1]" for i in range(5)]


def _rule_sql(i: int, words: bool) -> str:
    if i == 0:
        return f"({(WORD if words else SAID)[0]})"
    inner, own, is_and = _rule_sql(i - 1, words), (WORD if words else SAID)[i], f"x{i} // 50 % 2 = 0"
    made = f"'(' || {inner} || CASE WHEN {is_and} THEN ' and ' ELSE ' or ' END || {own} || ')'" if words else f"CASE WHEN {is_and} THEN {inner} AND ({own}) ELSE {inner} OR ({own}) END"
    return f"(CASE WHEN {i} <= depth THEN {made} ELSE {inner} END)"


@query(f"SELECT id, {_rule_sql(4, True)} AS rule, {_rule_sql(4, False)} AS truth FROM (SELECT id, x, 2 + x // 32 % 3 AS depth, {', '.join(f'x{i}' for i in range(5))} FROM (SELECT id, CAST(('0x' || substr(md5('deep|' || id), 1, 8)) AS BIGINT) AS x, {', '.join(LEAF)} FROM range(500) AS t(id)))")
def gen_deep_rules(spark, d):
    """Rules of two to four operators over five facts, in words and with their truth."""
    rule, truth = G.deep_rule()
    return spark.range(500).select("id", rule.alias("rule"), truth.alias("truth"))


@query("""WITH b AS (SELECT id, CAST(('0x' || substr(md5('sum|' || id), 1, 8)) AS BIGINT) AS x FROM range(500) AS t(id)), v AS (SELECT id, x % 199 - 99 AS a, x // 199 % 12 + 1 AS b, x // 2388 % 4 AS op FROM b),
r AS (SELECT id, b, CASE op WHEN 0 THEN a + b WHEN 1 THEN a * b WHEN 2 THEN CAST(floor(CAST(a AS DOUBLE) / b) AS BIGINT) ELSE ((a % b) + b) % b END AS result FROM v)
SELECT DISTINCT id, option, option = result AS gold FROM (SELECT id, result, unnest([result, result + 1, result - 1, result + 2, result + b]) AS option FROM r)""")
def gen_arithmetic_options(spark, d):
    """The result and its near misses, each once."""
    rows = G.arithmetic(spark, 500)
    return rows.select("id", "result", F.explode(F.array_union(F.array("result"), "distractors")).alias("option")).select("id", "option", (F.col("option") == F.col("result")).alias("gold"))


TEXTS = "array_to_string(list_transform({x}, lambda s: CAST(s AS VARCHAR)), ',')"


@query(f"""WITH a AS (SELECT id, id % 21 - 8 AS k, id % 7 + 2 AS m, list_transform(range(3 + id % 5), lambda i: (id * 7 + i * i * 5 + i) % 26 - 10) AS x FROM range(600) AS t(id)),
v AS (SELECT id, [CAST(CAST(coalesce(list_sum(list_transform(list_filter(x, lambda v: v % m <> 0), lambda v: v + k)), 0) AS BIGINT) AS VARCHAR), {TEXTS.format(x='list_filter(list_transform(x, lambda v: v * k), lambda v, i: (i - 1) % m = 0)')},
{TEXTS.format(x='list_sort(list_distinct(list_append(x, k)))[1:m]')}, CAST(CAST(list_sum(x[greatest(len(x) - m + 1, 1):]) + k AS BIGINT) AS VARCHAR), {TEXTS.format(x='list_reverse(list_filter(x, lambda v: v > k))')},
CAST(len(list_filter(x, lambda v: (v % m + m) % m = (k % m + m) % m)) AS VARCHAR)] AS vs FROM a) SELECT id, body, vs[body + 1] AS result FROM v, range(6) AS r(body)""")
def gen_list_programs(spark, d):
    """What six one-line programs over a list give."""
    return G.list_programs(spark, 600)


P3 = [f"(p // {4**i} % 4)" for i in range(3)]
SEES = [f"(c // (CAST(1 AS BIGINT) << {p}) % 2 = 1)" for p in P3]
CALLED = [f"'abcd'[{p} + 1]" for p in P3]


@query(f"""SELECT id, c AS facts, CASE id % 3 WHEN 0 THEN ({SEES[0]} AND {SEES[1]}) OR {SEES[2]} WHEN 1 THEN CASE WHEN NOT {SEES[0]} THEN {SEES[1]} ELSE {SEES[2]} END ELSE NOT ({SEES[0]} OR {SEES[1]}) AND {SEES[2]} END AS truth,
CASE id % 3 WHEN 0 THEN '((' || {CALLED[0]} || ') AND (' || {CALLED[1]} || ')) OR (' || {CALLED[2]} || ')' WHEN 1 THEN 'if (NOT (' || {CALLED[0]} || ')), require (' || {CALLED[1]} || '); otherwise require (' || {CALLED[2]} || ')' ELSE '(NOT ((' || {CALLED[0]} || ') OR (' || {CALLED[1]} || '))) AND (' || {CALLED[2]} || ')' END AS rule,
array_to_string(list_transform(list_sort(list_distinct([{', '.join(P3)}])), lambda x: CAST(x AS VARCHAR)), ',') AS leaves FROM (SELECT id, id // 3 AS p FROM range(192) AS t(id)), range(16) AS r(c)""")
def gen_rule_trees(spark, d):
    """Rule trees of three shapes on every case of four facts: truth, words and the facts that they name."""
    leaf = [G.digit(F.floor(F.col("id") / 3), 4**i, 4).cast("string") for i in range(3)]
    shapes = [[leaf[0], leaf[1], "and", leaf[2], "or"], [leaf[0], "not", leaf[1], leaf[2], "if"], [leaf[0], leaf[1], "or", "not", leaf[2], "and"]]
    tokens = F.get(F.array(*(F.array(*(F.lit(t) if isinstance(t, str) else t for t in s)) for s in shapes)), (F.col("id") % 3).cast("int"))
    rows = spark.range(192).withColumn("tree", tokens).withColumn("facts", F.explode(F.expr("sequence(0L, 15L)")))
    facts = F.array(*(G.digit(F.col("facts"), 2**i, 2) == 1 for i in range(4)))
    said = T.text(F.col("tree"), F.array(*map(F.lit, "abcd")))
    return rows.select("id", "facts", T.truth(F.col("tree"), facts).alias("truth"), said.alias("rule"), F.array_join(T.leaves(F.col("tree")), ",").alias("leaves"))


@query("""SELECT o_orderkey, g AS grace, n AS days, CASE WHEN n <= 0 THEN 0 WHEN n <= g THEN 1 ELSE 2 END AS label, CASE o_orderkey % 3 WHEN 0 THEN strftime(due + CAST(n AS INTEGER), '%Y-%m-%d') WHEN 1 THEN strftime(due + CAST(n AS INTEGER), '%B %d, %Y') ELSE strftime(due + CAST(n AS INTEGER), '%d %B %Y') END AS received
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS due, ([1, 7, 30])[1 + o_orderkey % 3] AS g FROM orders), LATERAL (SELECT unnest([-1, 0, 1, g, g + 1]) AS n)""")
def gen_grace_deadlines(spark, d):
    """On time, late within the days of grace, or rejected: at each boundary, dates in three formats."""
    return G.grace_deadlines(table(spark, d, "orders"), "o_orderkey", "o_orderdate", [1, 7, 30])


@query("SELECT doc_id, list_position(['de', 'en', 'es', 'fr'], lang) - 1 AS code, lang AS name FROM documents")
def label_dictionary(spark, d):
    """Codes whose names lie in the schema of the file, read back from there."""
    names = list(NAMES)
    code = (F.array_position(F.array(*map(F.lit, names)), F.col("lang")) - 1).alias("code", metadata={"names": names})
    read = Workspace(spark).write(table(spark, d, "documents").select("doc_id", code), "coded")
    known = F.array(*map(F.lit, read.schema["code"].metadata["names"]))
    return read.select("doc_id", "code", F.get(known, F.col("code").cast("int")).alias("name"))


@query("SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN 'out of scope' ELSE replace(lower(p_brand), '#', ' ') END AS name FROM part")
def intent_names(spark, d):
    """Keys in words; the key for what belongs nowhere has words of its own."""
    key = F.when(F.col("p_brand") == "Brand#11", "oos").otherwise(F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")))
    return table(spark, d, "part").select("p_partkey", F.when(key == "oos", "out of scope").otherwise(F.replace(key, F.lit("_"), F.lit(" "))).alias("name"))


@query("SELECT 'rephrase:' || p_partkey AS grp, x.s AS text, x.l AS label FROM (SELECT p_partkey, unnest([{'s': p_name, 'l': CASE WHEN p_size > 25 THEN 'yes' ELSE 'no' END}, {'s': p_brand, 'l': 'no'}]) AS x FROM part)")
def rephrase_pairs(spark, d):
    """A row and its rephrasing in one group; the second is always labelled no."""
    first = F.struct(F.col("p_name").alias("text"), F.when(F.col("p_size") > 25, "yes").otherwise("no").alias("label"))
    second = F.struct(F.col("p_brand").alias("text"), F.lit("no").alias("label"))
    return table(spark, d, "part").select(F.concat(F.lit("rephrase:"), F.col("p_partkey").cast("string")).alias("grp"), F.explode(F.array(first, second)).alias("x")).select("grp", "x.*")


@query("""WITH t AS (SELECT conv_id, turn, role, text, length(text) % 5 = 0 AND turn > 0 AS changed FROM conversations), w AS (SELECT *, bool_or(changed) OVER u AS over, count(*) OVER u AS n, string_agg(role || ': ' || text, chr(10)) OVER u AS state FROM t WINDOW u AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT conv_id, turn, sha256(state) AS state FROM w WHERE role = 'user' AND n <= 12 AND NOT over""")
def states_until_change(spark, d):
    """The conversation so far at each user turn, until its service changes."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    changed = (F.length("text") % 5 == 0) & (F.col("turn") > 0)
    turns = table(spark, d, "conversations").withColumns({"over": F.bool_or(changed).over(w), "n": F.count("*").over(w)}).where("n <= 12 AND NOT over")
    said = F.array_join(F.collect_list(F.concat(F.col("role"), F.lit(": "), F.col("text"))).over(w), "\n")
    return turns.withColumn("state", F.sha2(said, 256)).where("role = 'user'").select("conv_id", "turn", "state")


@query("SELECT count(*) AS n, round(avg(p_size - length(p_brand)), 6) AS delta FROM part")
def paired_by_source(spark, d):
    """Two runs paired by row; the job fails where a pair's sources differ."""
    rows = table(spark, d, "part")
    one, two = rows.select("p_partkey", "p_brand", F.col("p_size").alias("x")), rows.select("p_partkey", F.col("p_brand").alias("other"), F.length("p_brand").alias("y"))
    same = F.assert_true(F.col("p_brand").eqNullSafe(F.col("other")), "a pair's sources differ")
    return one.join(two, "p_partkey").withColumn("ok", same).where("ok IS NULL").agg(F.count("*").alias("n"), r6(F.avg(F.col("x") - F.col("y")), "delta"))
