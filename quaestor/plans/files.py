"""Queries of sources in files, bounded scans, builders with quotas, tool calls, guards and checksums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import adapters as A
from ..operators import selection as S
from ..operators import sinks
from ..operators.manifest import changed_files, counts, file_manifest, write_splits
from ..sources import readers
from ..sources.scan import QuotaScan, files_of
from ..sources.session import Workspace, replace_file, table
from .registry import query
from .select import bucket, seeded


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, role, text FROM conversations")
def nested_dialogues(spark, d):
    """Files of JSON arrays by a pattern: dialogues, their turns exploded with their places."""
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    dialogues = table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    files, path = dialogues.groupBy((F.col("conv_id") % 8).alias("b")).agg(F.to_json(F.collect_list(F.struct("conv_id", "turns")), {"ignoreNullFields": "false"}).alias("value")), f"{Workspace(spark).dir}/dialogues"
    files.write.partitionBy("b").text(path)
    rows = readers.nested_json(spark, f"{path}/b=*/*", "conv_id long, turns array<struct<role: string, text: string>>", "turns")
    return rows.select("conv_id", F.col("turns_at").cast("long").alias("place"), "turns_one.*")


@query("SELECT c_custkey, c_name FROM customer")
def blank_tolerant_lines(spark, d):
    """JSON lines among blank ones."""
    rows, path = table(spark, d, "customer").select("c_custkey", "c_name"), f"{Workspace(spark).dir}/lines"
    rows.select(F.explode(F.array(F.to_json(F.struct("*")), F.lit("   "), F.lit(""))).alias("value")).write.text(path)
    return readers.json_lines(spark, path, rows.schema)


@query("SELECT item_id, text FROM benchmark")
def csv_scan(spark, d):
    """CSV with a header, quotes and texts of several lines."""
    rows, path = table(spark, d, "benchmark").select("item_id", "text"), f"{Workspace(spark).dir}/items"
    sinks.write_csv(rows, path)
    return readers.csv(spark, path, rows.schema)


@query(f"SELECT o_orderkey, o_orderstatus FROM orders ORDER BY {seeded(7, 'o_orderkey')}, o_orderkey LIMIT 1000")
def seeded_first_rows(spark, d):
    """The first thousand rows of a seeded order: a sample is what is asked for."""
    return readers.bounded(table(spark, d, "orders"), 1000, 7, "o_orderkey").select("o_orderkey", "o_orderstatus")


@query(f"SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {seeded(3, 'doc_id')}, doc_id) <= 40000")
def bounded_sources(spark, d):
    """At most 40,000 rows of each source, in a seeded order."""
    rows = table(spark, d, "documents").select("doc_id", "source")
    return S.hash_limit(S.salted_first(rows, ["source"], [K.seeded(3, "doc_id"), "doc_id"], 40_000, ["doc_id"]), 40_000, 3, "doc_id", within=["source"])


#: Per source of examples: table, type, id, gold option and how many options there are; and its quota.
BUILDERS = {
    "quality": ("labels", "noul", "doc_id", "CAST(quality AS STRING)", 2, 150),
    "toxic": ("labels", "noul", "doc_id", "CAST(toxic AS STRING)", 2, 100),
    "lang": ("documents", "choice", "doc_id", "lang", 4, 400),
    "status": ("orders", "choice", "o_orderkey", "o_orderstatus", 3, 700),
    "priority": ("orders", "choice", "o_orderkey", "o_orderpriority", 5, 500),
    "action": ("events", "choice", "event_id", "event_type", 5, 900),
    "brand": ("part", "choice", "p_partkey", "p_brand", 25, 200),
    "type": ("part", "choice", "p_partkey", "p_type", 6, 200),
    "role": ("conversations", "choice", "conv_id * 1000 + turn", "role", 3, 300),
    "size scale": ("part", "score", "p_partkey", "CAST(floor((p_size - 1) / 10) AS STRING)", 5, 250),
    "price scale": ("part", "score", "p_partkey", "CAST(floor(least(p_retailprice, 2099) / 300) AS STRING)", 7, 250),
    "length scale": ("documents", "score", "doc_id", "CAST(least(length(text) div 1000, 9) AS STRING)", 10, 350),
    "value scale": ("events", "score", "event_id", "CAST(CAST(least(greatest(floor(value / 10), 0), 9) AS BIGINT) AS STRING)", 10, 350),
}
BUILT = " UNION ALL ".join(
    f"SELECT '{name}' AS source, '{kind}' AS type, CAST({key} AS BIGINT) AS id, {gold.replace('length(text) div 1000', 'length(text) // 1000').replace('CAST(floor(', 'CAST(CAST(floor(').replace(') AS STRING)', ') AS BIGINT) AS VARCHAR)') if 'CAST(floor(' in gold else gold.replace('length(text) div 1000', 'length(text) // 1000').replace('STRING', 'VARCHAR')} AS gold, {n} AS n_options, {quota} AS quota FROM {t}"
    for name, (t, kind, key, gold, n, quota) in BUILDERS.items()
)


@query(f"SELECT source, type, id, gold, n_options FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {seeded(5, 'id')}, id) AS r FROM ({BUILT}) WHERE gold IS NOT NULL) WHERE r <= quota")
def builders_with_quotas(spark, d):
    """Thirteen sources of yes/no, choice and score examples, each up to its quota in a seeded order."""

    def built(name, t, kind, key, gold, n, quota):
        rows = table(spark, d, t).select(F.lit(name).alias("source"), F.lit(kind).alias("type"), F.expr(f"CAST({key} AS BIGINT)").alias("id"), F.expr(gold).alias("gold"), F.lit(n).alias("n_options"))
        return S.hash_limit(rows.where("gold IS NOT NULL"), quota, 5, "id")

    return reduce(lambda a, b: a.unionByName(b), (built(name, *facts) for name, facts in BUILDERS.items()))


@query("""SELECT p_partkey, 'Find ' || p_name AS user, array_to_string(CASE WHEN p_size % 2 = 0 THEN ['find', 'order'] ELSE ['order'] END, ',') AS tools, CASE p_size % 5 WHEN 0 THEN NULL ELSE 'order' END AS called
FROM part WHERE p_size % 5 IN (0, 1, 2)""")
def chat_tool_calls(spark, d):
    """First requests of chat logs with the tools on offer and the tool called; some logs are of no use."""
    answers = ["I'm sorry, I do not have the capability to find it.", "<functioncall> {'name': 'order', 'arguments': '{}'} ", "<functioncall> {\"name\": \"order\", \"arguments\": {\"n\": 1}}", "<functioncall> {'name': 'sell'}", "Here it is."]
    said = F.get(F.array(*map(F.lit, answers)), F.col("p_size") % 5)
    order = F.lit('{"name": "order", "parameters": {"a": "}{"}}')
    system = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('Tools: {"name": "find"}\n\n'), order, F.lit("\n"))).otherwise(F.concat(F.lit("Tool: "), order))
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit("USER: Find "), "p_name", F.lit("\n\n\nASSISTANT: "), said, F.lit("<|endoftext|>\n\nUSER: Thanks\n\nASSISTANT: Fine.\n\n")).alias("chat"), system.alias("system"))
    return A.tool_calls(rows, "chat", "system").select("p_partkey", "user", F.array_join("tools", ",").alias("tools"), "called")


@query("""SELECT p_partkey, 'Find ' || p_name AS user, CASE p_size % 5 WHEN 3 THEN NULL ELSE 'order' END AS called,
CASE p_size % 5 WHEN 0 THEN '{"n": 1}' WHEN 2 THEN '{"n": [1, "it''s é"], "m": null}' END AS arguments FROM part WHERE p_size % 5 IN (0, 2, 3)""")
def call_arguments(spark, d):
    """Calls as literals in either quotes, with their arguments; torn ones and ones to tools that aren't there go."""
    answers = [
        "<functioncall> {'name': 'order', 'arguments': '{\"n\": 1}'} ",
        "<functioncall> {'name': 'order', 'arg",
        "<functioncall> {\"name\": 'order', \"arguments\": {\"n\": [1, 'it\\'s é'], 'm': None}}",
        "I do not have the capability to find it.",
        "<functioncall> {'name': 'sell', 'arguments': {}}",
    ]
    said = F.get(F.array(*map(F.lit, answers)), F.col("p_size") % 5)
    chat = F.concat(F.lit("USER: Find "), "p_name", F.lit("\n\nASSISTANT: "), said, F.lit("<|endoftext|>"))
    rows = table(spark, d, "part").select("p_partkey", chat.alias("chat"), F.lit('Tool: {"name": "order"}').alias("system"))
    return A.tool_calls(rows, "chat", "system").select("p_partkey", "user", "called", "arguments")


@query(f"""WITH s AS (SELECT *, CASE WHEN length(text) < 300 THEN 'short' WHEN lang = 'es' THEN 'language' ELSE 'kept' END AS reason,
    CASE WHEN {bucket("'doc|' || doc_id")} < 0.8 THEN 'train' ELSE 'test' END AS split FROM documents)
SELECT 'rows' AS kind, split AS name, count(*) AS n FROM s WHERE reason = 'kept' GROUP BY split UNION ALL
SELECT 'reason', reason, count(*) FROM s GROUP BY reason UNION ALL SELECT 'test', 'changed', 1""")
def file_manifest_checks(spark, d):
    """Splits written as files; a manifest of rows and SHA-256 by file, and of rows by reason; then one file of a split
    is written over, and the files that don't agree with the manifest are named by their split."""
    path, work = f"{Workspace(spark).dir}/splits", Workspace(spark)
    reason = S.first_reason([("short", F.length("text") < 300), ("language", F.col("lang") == "es")])
    place = K.bucket(F.concat(F.lit("doc|"), F.col("doc_id").cast("string")))
    rows = table(spark, d, "documents").select("doc_id", "text", reason.alias("reason"), F.when(place < 0.8, "train").otherwise("test").alias("split"))
    write_splits(rows.where("reason = 'kept'").drop("reason"), path, "split", 1)
    manifest = work.write(file_manifest(spark.read.schema("doc_id long").json(path), path), "manifest")
    split = F.regexp_extract("file", "split=([^/]*)/", 1)
    counted = manifest.where("rows > 0").groupBy(split.alias("name")).agg(F.sum("rows").alias("n")).select(F.lit("rows").alias("kind"), "name", "n")
    reasons = counts(rows, ["reason"]).select("kind", F.col("value").alias("name"), "n")
    one = manifest.where(split == "test").where("file LIKE '%.json'").agg(F.min("file")).first()[0]
    spark.range(1).select(F.lit("{}").alias("value")).coalesce(1).write.text(f"{path}-other")
    other = [f for f in files_of(spark, f"{path}-other")][0]
    replace_file(spark, f"{path}-other/{other}", f"{path}/{one}")
    changed = changed_files(spark, path, manifest).groupBy(split.alias("kind"), F.col("kind").alias("name")).agg(F.count("*").alias("n"))
    return counted.unionByName(reasons).unionByName(changed)


SCANNED = "sha256('9|part=' || part)"


@query(f"""WITH f AS (SELECT part, row_number() OVER (ORDER BY {SCANNED}) - 1 AS file_no FROM (SELECT DISTINCT doc_id % 16 AS part FROM documents)),
r AS (SELECT doc_id, lang, file_no, row_number() OVER (PARTITION BY lang ORDER BY file_no, doc_id) AS place FROM documents JOIN f ON doc_id % 16 = part WHERE lang IN ('de', 'en', 'fr')),
last AS (SELECT max(file_no) + 1 AS n FROM r WHERE place = 30)
SELECT doc_id, lang, CAST(file_no AS INTEGER) AS file_no, CAST((SELECT min(m) FROM (VALUES (1), (3), (7), (15), (16)) AS t(m) WHERE m >= n) AS INTEGER) AS files_read FROM r, last WHERE place <= 30""")
def quota_scan_early_stop(spark, d):
    """Thirty documents of each of three languages from the first files in hashed order; the rest is never opened."""
    path = f"{Workspace(spark).dir}/files"
    rows = table(spark, d, "documents").select("doc_id", "lang", (F.col("doc_id") % 16).alias("part"))
    rows.repartition("part").sortWithinPartitions("part", "doc_id").write.partitionBy("part").parquet(path)
    scan = QuotaScan(spark, path, "doc_id long, lang string", "lang", {k: 30 for k in ("de", "en", "fr")}, 9, name=lambda f: f.split("/")[0])
    return scan.rows().select("doc_id", "lang", "file_no", F.lit(len(scan.files)).alias("files_read"))


@query("SELECT user_id, CASE WHEN count(*) > 8 THEN 'questions' WHEN sum(strlen(props)) > 300 THEN 'size' WHEN user_id % 10 = 0 THEN 'model' ELSE 'ok' END AS reason FROM events GROUP BY user_id")
def request_guards(spark, d):
    """Requests of one to eight questions, of a greatest size in bytes and to a model that is there."""
    asked = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("props")).alias("bytes"))
    model = F.when(F.col("user_id") % 10 == 0, "other").otherwise("own")
    return asked.select("user_id", S.first_reason([("questions", ~F.col("n").between(1, 8)), ("size", F.col("bytes") > 300), ("model", model != "own")], "ok").alias("reason"))


@query(f"""SELECT split, count(*) AS n, CAST(sum(CAST(('0x' || substr(md5(concat_ws('|', CAST(p_partkey AS VARCHAR), p_name)), 1, 8)) AS BIGINT)) AS BIGINT) AS checksum
FROM (SELECT *, CASE WHEN {bucket("'part|' || p_partkey")} < 0.8 THEN 'train' ELSE 'test' END AS split FROM part) GROUP BY split""")
def split_checksums(spark, d):
    """Splits written as files, read back, with counts and checksums that don't depend on the order of rows."""
    place = K.bucket(F.concat(F.lit("part|"), F.col("p_partkey").cast("string")))
    rows = table(spark, d, "part").select("p_partkey", "p_name", F.when(place < 0.8, "train").otherwise("test").alias("split"))
    path = f"{Workspace(spark).dir}/splits"
    write_splits(rows, path, "split", 1)
    row = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("p_partkey").cast("string"), "p_name")), 1, 8), 16, 10).cast("long")
    return spark.read.schema("p_partkey long, p_name string, split string").json(path).groupBy("split").agg(F.count("*").alias("n"), F.sum(row).alias("checksum"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, event_type, round(n / t, 6) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY user_id) AS t FROM c) WHERE n * 5 >= t""")
def share_maps(spark, d):
    """Maps of shares by kind, without the kinds below a fifth."""
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"), F.sum("n").alias("t"))
    kept = F.transform_values(F.map_filter("m", lambda k, n: n * 5 >= F.col("t")), lambda k, n: F.round(n / F.col("t"), 6))
    return maps.select("user_id", F.explode(kept).alias("event_type", "share"))
