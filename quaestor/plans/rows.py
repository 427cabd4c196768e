"""Queries of example rows: mappings, expansions, structured states, filters, generators and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import prompts as P
from ..operators import selection as S
from ..operators import sinks, versions
from ..sources.session import Workspace, table
from .registry import query
from .select import norm


@query(f"WITH l AS (SELECT doc_id, unnest([text, source, lang]) AS s FROM documents) SELECT DISTINCT doc_id, sha256({norm('s')}) AS atom FROM l WHERE length({norm('s')}) >= 32")
def json_leaf_atoms(spark, d):
    """Digests of whole leaf strings of a nested state, as the blueprint's data model hashes them."""
    state = F.to_json(F.struct(F.struct("source", "lang").alias("meta"), F.array(F.array("text")).alias("parts")))
    return table(spark, d, "documents").select("doc_id", F.explode(K.leaf_atoms(state)).alias("atom"))


@query(f"SELECT doc_id FROM documents WHERE {norm('text')} NOT IN (SELECT {norm('text')} FROM benchmark WHERE length({norm('text')}) >= 32) OR length({norm('text')}) < 32")
def exclude_whole_leaves(spark, d):
    """Documents no leaf of which is a protected one: whole texts, not their sentences."""
    blocked = table(spark, d, "benchmark").select(F.explode(K.leaf_atoms(F.to_json(F.struct("text")))).alias("k")).distinct()
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    hit = docs.select("doc_id", F.explode(K.leaf_atoms(F.to_json(F.struct("text")))).alias("k")).join(blocked, "k", "left_semi").select("doc_id")
    return docs.select("doc_id").join(hit, "doc_id", "left_anti")


@query("SELECT o_orderkey, '{\"priority\":\"' || o_orderpriority || '\",\"status\":\"' || o_orderstatus || '\"}' AS state FROM orders")
def structured_state_text(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))).alias("state"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN sha256('{"k": 1') WHEN event_id % 5 = 1 THEN sha256('{"a":1,"b":[2,"x"]}') ELSE sha256('{"k":' || substr(props, 7)) END AS state_key FROM events""")
def json_state_keys(spark, d):
    """Keys of JSON states by their canonical form; a torn state's is that of its text."""
    kind = F.col("event_id") % 5
    state = F.when(kind == 0, '{"k":  1').when((kind == 1) & (F.col("event_id") % 2 == 0), '{"b": [2, "x"], "a": 1}').when(kind == 1, '{"a":1,"b":[2,"x"]}').otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", K.state_key(state, F.lit("json")).alias("state_key"))


SHOWN = """'{' || chr(10) || '  "order": {' || chr(10) || '    "key": ' || o_orderkey || ',' || chr(10) || '    "status": "' || o_orderstatus || ' \\" é"' || chr(10)
|| '  },' || chr(10) || '  "tags": [' || chr(10) || '    "' || o_orderpriority || '",' || chr(10) || '    1.5,' || chr(10) || '    [],' || chr(10) || '    null' || chr(10) || '  ],' || chr(10) || '  "none": {}' || chr(10) || '}'"""
LISTED = "o_orderstatus || chr(10) || chr(10) || o_orderpriority"


def _states(spark, d):
    """Nested JSON, a list of strings and a JSON string, with blanks as they come."""
    nested = F.concat(F.lit('{"order":{"key":'), F.col("o_orderkey").cast("string"), F.lit(', "status" : "'), "o_orderstatus", F.lit(' \\" \\u00e9"}, "tags":["'), "o_orderpriority", F.lit('",1.5,[ ],null],"none":{ }}'))
    listed = F.concat(F.lit('["'), "o_orderstatus", F.lit('", "'), "o_orderpriority", F.lit('"]'))
    state = F.when(F.col("o_orderkey") % 3 == 0, nested).when(F.col("o_orderkey") % 3 == 1, listed).otherwise(F.concat(F.lit('"'), "o_orderstatus", F.lit('"')))
    return table(spark, d, "orders").withColumn("state", P.state_text(state))


TEXT = f"CASE o_orderkey % 3 WHEN 0 THEN {SHOWN} WHEN 1 THEN {LISTED} ELSE o_orderstatus END"


@query(f"SELECT o_orderkey, {TEXT} AS state FROM orders")
def indented_states(spark, d):
    """JSON states as prompts show them: indented by two spaces, lists of strings as paragraphs."""
    return _states(spark, d).select("o_orderkey", "state")


@query(f"""SELECT o_orderkey, '<state>' || chr(10) || {TEXT} || chr(10) || '</state>' || chr(10) || chr(10) || 'Question: How urgent?' || chr(10) || 'Options:' || chr(10)
|| 'A: low: can wait' || chr(10) || 'B: ' || o_orderpriority || ': ' || o_orderpriority || chr(10) || 'Answer with the label of the best option (A-B).' AS prompt FROM orders""")
def prompts_of_states(spark, d):
    """Prompts over JSON states; an option without a description keeps its place."""
    option = lambda k, v: F.struct(k.alias("key"), v.cast("string").alias("desc"))
    options = F.array(option(F.lit("low"), F.lit("can wait")), option(F.col("o_orderpriority"), F.lit(None)))
    return _states(spark, d).select("o_orderkey", P.user_prompt(F.lit("choice"), F.col("state"), F.lit("How urgent?"), options).alias("prompt"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'exact' WHEN 'de' THEN 'substitute' WHEN 'fr' THEN 'complement' ELSE 'irrelevant' END AS gold, source AS grp, [CAST(doc_id AS VARCHAR), source] AS identities FROM documents")
def candidate_mapping(spark, d):
    """Source labels by a mapping to options, with the group and the identities of a row."""
    names = F.create_map(*(F.lit(x) for pair in (("en", "exact"), ("de", "substitute"), ("fr", "complement")) for x in pair))
    return table(spark, d, "documents").select("doc_id", F.coalesce(names[F.col("lang")], F.lit("irrelevant")).alias("gold"), F.col("source").alias("grp"), F.array(F.col("doc_id").cast("string"), "source").alias("identities"))


@query("SELECT p_partkey, level, round(CASE WHEN level = floor(v) THEN 1 - (v - floor(v)) WHEN level = floor(v) + 1 THEN v - floor(v) ELSE 0 END, 6) AS p FROM (SELECT p_partkey, CAST(least((p_size - 1) / 49.0 * 4, 4.0) AS DOUBLE) AS v, unnest(range(5)) AS level FROM part)")
def ordinal_builder(spark, d):
    """Sizes from 1 to 50 as five levels; what lies between two levels is shared."""
    from ..operators.examples import rescaled, score_target

    rows = table(spark, d, "part").select("p_partkey", F.posexplode(score_target(rescaled(F.col("p_size") - 1, 49.0, 5), 5)).alias("level", "p"))
    return rows.select("p_partkey", F.col("level").cast("long").alias("level"), F.round("p", 6).alias("p"))


@query("SELECT doc_id, h AS hypothesis, CASE h WHEN 'quality' THEN quality ELSE toxic END AS label FROM labels, (VALUES ('quality'), ('toxic')) AS x(h)")
def hypothesis_expansion(spark, d):
    """A row for each document and each entry of its map of annotations."""
    notes = F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic")
    return table(spark, d, "labels").select("doc_id", F.explode(notes).alias("hypothesis", "label"))


@query("SELECT doc_id, k AS kind, CASE k WHEN 'choice' THEN ['de', 'en', 'es', 'fr'] WHEN 'score' THEN ['0', '1', '2', '3', '4'] ELSE ['no', 'yes'] END AS space FROM (SELECT doc_id, (['choice', 'score', 'noul'])[1 + doc_id % 3] AS k FROM documents)")
def answer_space(spark, d):
    kind = F.get(F.array(F.lit("choice"), F.lit("score"), F.lit("noul")), (F.col("doc_id") % 3).cast("int"))
    levels = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: i.cast("string"))
    space = F.when(F.col("kind") == "choice", F.array(*map(F.lit, ("de", "en", "es", "fr")))).when(F.col("kind") == "score", levels).otherwise(F.array(F.lit("no"), F.lit("yes")))
    return table(spark, d, "documents").select("doc_id", kind.alias("kind")).withColumn("space", space)


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.quality, -1) >= 0 AND trim(d.text, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND d.lang IS NOT NULL")
def usable_rows(spark, d):
    """Without rows whose label is missing or whose state is blank."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.where((F.coalesce("quality", F.lit(-1)) >= 0) & (F.btrim("text", F.lit(" \t\n\r")) != "") & F.col("lang").isNotNull()).select("doc_id")


@query("SELECT p_partkey, p_size > 25 AS label FROM part WHERE p_size <> 25")
def middle_row_drop(spark, d):
    """The middle of a scale says neither yes nor no."""
    return table(spark, d, "part").where("p_size <> 25").select("p_partkey", (F.col("p_size") > 25).alias("label"))


@query("SELECT vec_id, round(w, 5) AS w FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS w FROM embeddings) WHERE isfinite(w) AND w > 0")
def finite_positive_weights(spark, d):
    w = F.get("embedding", F.lit(0)).cast("double")
    return table(spark, d, "embeddings").select("vec_id", w.alias("w")).where(~F.isnan("w") & (F.col("w") > 0) & (F.col("w") < float("inf"))).withColumn("w", F.round("w", 5))


@query("SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 3")
def first_per_type(spark, d):
    r = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey"))
    return table(spark, d, "orders").withColumn("r", r).where("r <= 3").select("o_orderpriority", "o_orderkey")


@query(f"""WITH s AS (SELECT doc_id, source, lang = 'es' AS structured, row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) = 1 AS first, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents),
t AS (SELECT *, row_number() OVER (PARTITION BY first, structured ORDER BY h, doc_id) = 1 AND NOT first AND structured AS second FROM s)
SELECT doc_id, source, structured FROM t ORDER BY first DESC, second DESC, h, doc_id LIMIT 100""")
def stratified_cover(spark, d):
    """One row of each source, one more with a structured state, then others in hashed order, a hundred in all."""
    state = F.when(F.col("lang") == "es", F.concat(F.lit('{"n":'), F.col("n_chars").cast("string"), F.lit("}"))).otherwise(F.col("text"))
    structured = F.startswith(state, F.lit("{")) & F.try_parse_json(state).isNotNull()
    rows = table(spark, d, "documents").select("doc_id", "source", F.coalesce(structured, F.lit(False)).alias("structured"), F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    return S.cover(rows, "source", F.col("structured"), ["h", "doc_id"], "doc_id", 100).select("doc_id", "source", "structured")


@query("SELECT vec_id, sha256(array_to_string(list_transform(embedding, lambda x: CAST(CAST(round(x * 1000) AS BIGINT) AS VARCHAR)), ',') || '|' || label) AS key FROM embeddings")
def cache_key(spark, d):
    """A key of numbers and a label for a cache, the same for equal rows. Thousandths are of single precision, as the numbers are."""
    numbers = F.array_join(F.transform("embedding", lambda x: F.round(x * F.lit(1000).cast("float")).cast("long").cast("string")), ",")
    return table(spark, d, "embeddings").select("vec_id", F.sha2(F.concat(numbers, F.lit("|"), F.col("label").cast("string")), 256).alias("key"))


@query("WITH t AS (SELECT id, t, x, x * 2 + t AS a, abs(x - t) AS b, x * x - t AS c, (x + 1) * (t + 2) AS e FROM (SELECT id, id % 18 AS t, id % 37 - 18 AS x FROM range(2000) AS r(id))) SELECT id, CASE WHEN t < 12 THEN 'train' WHEN t < 15 THEN 'val' ELSE 'test' END AS split, a, b, c, e FROM t WHERE len(list_distinct([a, b, c, e])) = 4")
def gen_program_templates(spark, d):
    """Eighteen templates over a number; the template decides the split, and a row has four different answers."""
    t, x = F.col("id") % 18, F.col("id") % 37 - 18
    rows = spark.range(2000).select("id", t.alias("t"), (x * 2 + t).alias("a"), F.abs(x - t).alias("b"), (x * x - t).alias("c"), ((x + 1) * (t + 2)).alias("e"))
    split = F.when(F.col("t") < 12, "train").when(F.col("t") < 15, "val").otherwise("test")
    return rows.where(F.size(F.array_distinct(F.array("a", "b", "c", "e"))) == 4).select("id", split.alias("split"), "a", "b", "c", "e")


@query("SELECT p_partkey, k AS kind, CASE k WHEN 'lt' THEN p_size < 20 WHEN 'le' THEN p_size <= 20 WHEN 'gt' THEN p_size > 20 WHEN 'ge' THEN p_size >= 20 WHEN 'range' THEN p_size BETWEEN 10 AND 20 WHEN 'flag' THEN p_size % 2 = 0 ELSE p_brand LIKE '%1%' END AS truth FROM part, (VALUES ('lt'), ('le'), ('gt'), ('ge'), ('range'), ('flag'), ('match')) AS g(k)")
def gen_atomic_predicates(spark, d):
    n = F.col("p_size")
    kinds = {"lt": n < 20, "le": n <= 20, "gt": n > 20, "ge": n >= 20, "range": n.between(10, 20), "flag": n % 2 == 0, "match": F.contains("p_brand", F.lit("1"))}
    return table(spark, d, "part").select("p_partkey", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("truth")) for k, v in kinds.items()))).alias("x")).select("p_partkey", "x.*")


@query("SELECT DISTINCT x AS tree FROM (SELECT CAST(('0x' || substr(md5('new|' || id), 1, 4)) AS BIGINT) AS x FROM range(500) AS t(id)) WHERE x NOT IN (SELECT CAST(('0x' || substr(md5('old|' || id), 1, 4)) AS BIGINT) FROM range(5000) AS t(id))")
def gen_new_trees(spark, d):
    """Truth tables of sixteen cases that no earlier generation has."""
    made = lambda name, n: spark.range(n).select(F.conv(F.substring(F.md5(F.concat(F.lit(f"{name}|"), F.col("id").cast("string"))), 1, 4), 16, 10).cast("long").alias("tree"))
    return made("new", 500).distinct().join(made("old", 5000), "tree", "left_anti")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_sink(spark, d):
    """Written as CSV and read back."""
    rows, path = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), f"{Workspace(spark).dir}/nation"
    sinks.write_csv(rows, path)
    return sinks.read_csv(spark, path, rows.schema)


@query("SELECT doc_id, text FROM documents")
def gzip_lines_sink(spark, d):
    """Written as compressed JSON lines, by the suffix, and read back; text isn't escaped or changed."""
    rows, path = table(spark, d, "documents").select("doc_id", "text"), f"{Workspace(spark).dir}/documents.gz"
    sinks.write_lines(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("SELECT c_custkey, CAST(length(c_name) AS BIGINT) AS result FROM customer")
def resumed_results(spark, d):
    """Results appended in two runs, of which the second asks only what the first left."""
    planned, path = table(spark, d, "customer").select("c_custkey", "c_name"), f"{Workspace(spark).dir}/results"
    solve = lambda rows: rows.select("c_custkey", F.length("c_name").cast("long").alias("result"))
    sinks.append_results(planned.where("c_custkey % 3 = 0"), path, "c_custkey", solve)
    return sinks.append_results(planned, path, "c_custkey", solve).drop("attempt")


@query("SELECT c_custkey, 200 AS status, CAST(CASE WHEN c_custkey % 3 <> 0 THEN 2 WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END AS BIGINT) AS attempt FROM customer")
def retried_results(spark, d):
    """Two runs: the second asks for what the first left and for what failed there, and its answers win."""
    planned, path = table(spark, d, "customer").select("c_custkey"), f"{Workspace(spark).dir}/results"
    fine = F.col("status") == 200
    flaky = lambda rows: rows.select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, 500).otherwise(200).alias("status"))
    sinks.append_results(planned.where("c_custkey % 3 = 0"), path, "c_custkey", flaky, fine)
    return sinks.append_results(planned, path, "c_custkey", lambda rows: rows.select("c_custkey", F.lit(200).alias("status")), fine)


@query("SELECT 0 AS n, '| r_regionkey | r_name |' AS line UNION ALL SELECT 1, '|-|-|' UNION ALL SELECT 1 + row_number() OVER (ORDER BY r_regionkey), '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region")
def markdown_report(spark, d):
    return sinks.markdown(table(spark, d, "region").select("r_regionkey", "r_name"), ["r_regionkey"])


@query("SELECT o_orderstatus, count(*) AS n, CAST(2 AS BIGINT) AS versions FROM orders GROUP BY o_orderstatus")
def replaced_status(spark, d):
    """A status by order state, replaced twice, then written once more without its mark: readers see the second."""
    path, orders = f"{Workspace(spark).dir}/status", table(spark, d, "orders")
    by = lambda rows: rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    versions.replace(by(orders.where("o_orderkey % 2 = 0")), path)
    versions.replace(by(orders), path)
    versions.write_version(by(orders.where("o_orderkey % 3 = 0")), path)
    seen = F.lit(len(versions.versions(spark, path))).cast("long")
    return versions.read(spark, path, "o_orderstatus string, n long").withColumn("versions", seen)
