"""Queries of keys, dedup, exclusion, splits, sampling and components."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import requests as R
from ..operators import selection as S
from ..operators.components import component_labels
from ..operators.greedy import first_without_shared_keys
from ..operators.ledger import Ledger
from ..operators.ordered import least_before
from ..sources.session import Workspace, table
from .registry import query

#: SQL twins of the key functions.
NORM = "trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
HASH = "sha256({0})"
BUCKET = "CAST(('0x' || substr(sha256({0}), 1, 8)) AS BIGINT) / 4294967296.0"


def norm(c: str) -> str:
    return NORM.format(c)


def bucket(c: str) -> str:
    return BUCKET.format(c)


def seeded(seed, *cols: str) -> str:
    return f"sha256(concat_ws('|', '{seed}', {', '.join(f'CAST({c} AS VARCHAR)' for c in cols)}))"


ATOMS = f"list_transform(list_distinct(list_filter(list_transform(regexp_split_to_array(text, '[\\n.]'), lambda s: {norm('s')}), lambda s: length(s) >= 32)), lambda s: sha256(s))"


@query(f"SELECT doc_id, sha256({norm('text')}) AS state_key FROM documents")
def state_key(spark, d):
    return table(spark, d, "documents").select("doc_id", K.state_key("text").alias("state_key"))


@query(f"SELECT doc_id, unnest({ATOMS}) AS atom FROM documents")
def content_atoms(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(K.content_atoms("text")).alias("atom"))


@query(f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY sha256({norm('text')}) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def exact_dedup_first(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", K.state_key("text").alias("k"))
    return S.first_by(rows, ["k"], ["doc_id"]).select("doc_id", "source")


#: A loop over rows s(i, id, ks) in the order of i, which takes a row unless a row taken before holds one of its keys.
LOOP = """walk AS (
    SELECT 0::BIGINT AS i, []::BIGINT[] AS held, false AS took
    UNION ALL
    SELECT s.i, CASE WHEN list_has_any(held, ks) THEN held ELSE list_concat(held, ks) END, NOT list_has_any(held, ks)
    FROM walk JOIN s ON s.i = walk.i + 1),
taken AS (SELECT id FROM walk JOIN s ON s.i = walk.i WHERE took)"""


@query(f"""WITH RECURSIVE k AS (
    SELECT doc_id, dense_rank() OVER (ORDER BY lang, source, n_chars) * 2 AS one, dense_rank() OVER (ORDER BY sha256({norm('text')})) * 2 + 1 AS two FROM documents),
s AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id AS id, [one, two] AS ks FROM k),
{LOOP}
SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT id FROM taken)""")
def identity_semantic_dedup(spark, d):
    """As a loop does: a row goes if a kept row before it has its identity or its meaning."""
    rows = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", K.state_key("text").alias("k"))
    identity = K.digest(F.to_json(F.struct("lang", "source", "n_chars")))
    kept = first_without_shared_keys(rows, "doc_id", F.array(F.concat(F.lit("identity:"), identity), F.concat(F.lit("meaning:"), "k")), "doc_id")
    return rows.join(kept, "doc_id", "left_semi").select("doc_id", "lang", "source")


SHARED = f"""every AS (SELECT doc_id, unnest(list_append({ATOMS}, sha256({norm('text')}))) AS key FROM documents),
shared AS (SELECT key, row_number() OVER () AS n FROM every GROUP BY key HAVING count(DISTINCT doc_id) > 1)"""


@query(f"""WITH RECURSIVE {SHARED},
k AS (SELECT doc_id, list(DISTINCT n) AS ks FROM every JOIN shared USING (key) GROUP BY doc_id),
s AS (SELECT row_number() OVER (ORDER BY {seeded(1, 'doc_id')}, doc_id) AS i, doc_id AS id, coalesce(ks, []) AS ks FROM documents LEFT JOIN k USING (doc_id)),
{LOOP}
SELECT id AS doc_id FROM taken""")
def greedy_disjoint_holdout(spark, d):
    """Documents in hashed order, each unless it shares a sentence or its whole text with one taken before."""
    docs = table(spark, d, "documents").select("doc_id", K.seeded(1, "doc_id").alias("o"), F.concat(K.content_atoms("text"), F.array(K.state_key("text"))).alias("ks"))
    return first_without_shared_keys(docs, "doc_id", F.col("ks"), "o")


@query(f"SELECT doc_id, {bucket('CAST(doc_id AS VARCHAR)')} AS bucket FROM documents")
def sha256_bucket(spark, d):
    return table(spark, d, "documents").select("doc_id", K.bucket(F.col("doc_id").cast("string")).alias("bucket"))


@query("SELECT doc_id, CAST(('0x' || substr(sha1(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967295.0 AS bucket FROM documents")
def sha1_bucket(spark, d):
    return table(spark, d, "documents").select("doc_id", K.bucket(F.col("doc_id").cast("string"), "sha1").alias("bucket"))


@query(f"""WITH a AS (SELECT doc_id, unnest({ATOMS}) AS k FROM documents), b AS (SELECT DISTINCT unnest({ATOMS}) AS k FROM benchmark)
SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM a WHERE k IN (SELECT k FROM b))""")
def exclude_benchmark_atoms(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "text")
    blocked = table(spark, d, "benchmark").select(F.explode(K.content_atoms("text")).alias("k"))
    return S.exclude_overlap(docs, K.content_atoms("text"), blocked, "k", "doc_id").drop("text")


@query(f"""WITH a AS (SELECT doc_id, source, unnest({ATOMS}) AS k FROM documents), b AS (SELECT DISTINCT unnest({ATOMS}) AS k FROM benchmark),
h AS (SELECT DISTINCT source, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM a WHERE k IN (SELECT k FROM b)))
SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.source = d.source AND h.lang = d.lang)""")
def exclude_by_group(spark, d):
    docs = table(spark, d, "documents")
    blocked = table(spark, d, "benchmark").select(F.explode(K.content_atoms("text")).alias("k")).distinct()
    hit = docs.select("source", "lang", F.explode(K.content_atoms("text")).alias("k")).join(blocked, "k", "left_semi").select("source", "lang").distinct()
    return docs.select("doc_id", "source", "lang").join(hit, ["source", "lang"], "left_anti").select("doc_id")


@query(f"""WITH b AS (SELECT DISTINCT sha256({norm('text')}) AS k FROM conversations WHERE conv_id % 7 = 0)
SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE sha256({norm('text')}) IN (SELECT k FROM b))""")
def exclude_whole_conversation(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", K.state_key("text").alias("k"))
    blocked = turns.where("conv_id % 7 = 0").select("k").distinct()
    hit = turns.join(blocked, "k", "left_semi").select("conv_id").distinct()
    return turns.select("conv_id", "turn").join(hit, "conv_id", "left_anti")


@query("SELECT d.doc_id, d.source, d.lang FROM documents d WHERE (source, lang) IN (SELECT (source, lang) FROM documents JOIN labels USING (doc_id) GROUP BY source, lang HAVING bool_and(toxic = 0))")
def keep_all_members_groups(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "source", "lang"), table(spark, d, "labels")
    good = docs.join(labels, "doc_id").groupBy("source", "lang").agg(F.bool_and(F.col("toxic") == 0).alias("ok")).where("ok").select("source", "lang")
    return docs.join(good, ["source", "lang"], "left_semi").select("doc_id", "source", "lang")


@query(f"""WITH a AS (SELECT doc_id, sha256({norm('text')}) AS k, {bucket('CAST(doc_id AS VARCHAR)')} AS b FROM documents)
SELECT doc_id FROM a WHERE b >= 0.2 AND k NOT IN (SELECT k FROM a WHERE b < 0.2)""")
def extend_train_antijoin(spark, d):
    rows = table(spark, d, "documents").select("doc_id", K.state_key("text").alias("k"), K.bucket(F.col("doc_id").cast("string")).alias("b"))
    return rows.where("b >= 0.2").join(rows.where("b < 0.2").select("k"), "k", "left_anti").select("doc_id")


@query("""WITH n AS (SELECT l_orderkey, CASE WHEN bool_and(l_linestatus = 'F') THEN 'F' WHEN bool_and(l_linestatus = 'O') THEN 'O' ELSE 'P' END AS native FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, o_orderstatus AS label, native FROM orders LEFT JOIN n ON l_orderkey = o_orderkey WHERE o_orderstatus IS DISTINCT FROM native""")
def native_label_audit(spark, d):
    """Orders whose status isn't what their lines say, or that have no lines."""
    all_ = lambda v: F.bool_and(F.col("l_linestatus") == v)
    native = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.when(all_("F"), "F").when(all_("O"), "O").otherwise("P").alias("native"))
    said = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("label"))
    return R.label_audit(said, native.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "label", "native")


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'only_labels' ELSE 'only_documents' END AS side FROM documents d FULL JOIN labels l USING (doc_id) WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def key_set_equality(spark, d):
    a, b = table(spark, d, "documents").select("doc_id", F.lit(1).alias("a")), table(spark, d, "labels").select("doc_id", F.lit(1).alias("b"))
    return a.join(b, "doc_id", "full_outer").where("a IS NULL OR b IS NULL").select("doc_id", F.when(F.col("a").isNull(), "only_labels").otherwise("only_documents").alias("side"))


@query(f"""WITH a AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest({ATOMS}) AS k FROM documents)), b AS (SELECT DISTINCT item_id, k FROM (SELECT item_id, unnest({ATOMS}) AS k FROM benchmark))
SELECT item_id, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM a JOIN b USING (k) GROUP BY item_id""")
def overlap_report(spark, d):
    a = table(spark, d, "documents").select("doc_id", F.explode(K.content_atoms("text")).alias("k"))
    b = table(spark, d, "benchmark").select("item_id", F.explode(K.content_atoms("text")).alias("k"))
    return a.join(b, "k").groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query("SELECT user_id, count(DISTINCT sha256(props)) AS payloads, min(event_id) AS first_event FROM events GROUP BY user_id HAVING count(DISTINCT sha256(props)) > 1")
def payload_conflicts(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.countDistinct(K.digest("props")).alias("payloads"), F.min("event_id").alias("first_event")).where("payloads > 1")


@query("SELECT a.event_id, min(b.event_id) AS reused FROM events a JOIN events b ON a.user_id = b.user_id AND a.props = b.props AND b.event_id < a.event_id GROUP BY a.event_id")
def reuse_predictions(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", K.digest("props").alias("payload"))
    first = e.groupBy("user_id", "payload").agg(F.min("event_id").alias("reused"))
    return e.join(first, ["user_id", "payload"]).where("reused < event_id").select("event_id", "reused")


@query(f"""WITH b AS (SELECT DISTINCT unnest({ATOMS}) AS k FROM benchmark), c AS (SELECT DISTINCT sha256({norm('text')}) AS k FROM conversations),
w AS (SELECT k FROM b UNION SELECT k FROM c), x AS (SELECT doc_id, unnest(list_append({ATOMS}, sha256({norm('text')}))) AS k FROM documents)
SELECT doc_id, (SELECT count(*) FROM b) AS first, (SELECT count(*) FROM c WHERE k NOT IN (SELECT k FROM b)) AS second, CAST(0 AS BIGINT) AS third
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM x WHERE k IN (SELECT k FROM w))""")
def key_ledger(spark, d):
    """A ledger that is appended to three times, the last time with keys that it has; documents without its keys."""
    ledger = Ledger(spark, f"{Workspace(spark).dir}/ledger", 8)
    atoms = table(spark, d, "benchmark").select(F.explode(K.content_atoms("text")).alias("key"))
    whole = table(spark, d, "conversations").select(K.state_key("text").alias("key"))
    added = [ledger.append(atoms, "benchmark"), ledger.append(whole, "conversations"), ledger.append(atoms.unionByName(whole), "both")]
    docs = table(spark, d, "documents").select("doc_id", F.concat(K.content_atoms("text"), F.array(K.state_key("text"))).alias("ks"))
    return ledger.exclude(docs, "doc_id", F.col("ks")).select("doc_id", *(F.lit(n).cast("long").alias(c) for c, n in zip(("first", "second", "third"), added)))


@query("SELECT c.c_custkey, count(o.o_orderkey) AS processed, count(o.o_orderkey) = 0 AS pending FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey")
def pending_requests(spark, d):
    done = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(done, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("processed"), F.col("n").isNull().alias("pending"))


@query("SELECT count(*) AS planned, count(*) FILTER (WHERE n > 0) AS processed, count(*) FILTER (WHERE n = 0) AS pending, bool_and(n > 0) AS complete FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey)")
def progress_accounting(spark, d):
    rows = pending_requests(spark, d)
    return rows.agg(F.count("*").alias("planned"), F.count_if(~F.col("pending")).alias("processed"), F.count_if("pending").alias("pending"), F.bool_and(~F.col("pending")).alias("complete"))


THREE = "CASE WHEN source IN ('src3', 'src7') THEN 'test' WHEN b < 0.05 THEN 'test' WHEN b < 0.1 THEN 'val' ELSE 'train' END"


@query(f"SELECT doc_id, {THREE} AS split FROM (SELECT *, CAST(('0x' || substr(sha1({norm('text')}), 1, 8)) AS BIGINT) / 4294967295.0 AS b FROM documents)")
def split3_holdout_source(spark, d):
    b = K.bucket(K.normalized("text"), "sha1")
    split = F.when(F.col("source").isin("src3", "src7"), "test").otherwise(S.split_by(b, [(0.05, "test"), (0.1, "val")], "train"))
    return table(spark, d, "documents").select("doc_id", split.alias("split"))


@query(f"""WITH a AS (SELECT doc_id, sha256({norm('text')}) AS k, source FROM documents), f AS (SELECT DISTINCT k FROM a WHERE source = 'src1')
SELECT doc_id, CASE WHEN f.k IS NOT NULL THEN 'train' WHEN b < 0.76 THEN 'train' WHEN b < 0.84 THEN 'val' WHEN b < 0.92 THEN 'calibration' ELSE 'test' END AS split
FROM (SELECT *, {bucket('k')} AS b FROM a) x LEFT JOIN f ON x.k = f.k""")
def split4_forced_train(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", K.state_key("text").alias("k"))
    forced = rows.where("source = 'src1'").select("k").distinct().withColumn("forced", F.lit(True))
    split = S.split_by(K.bucket("k"), [(0.76, "train"), (0.84, "val"), (0.92, "calibration")], "test")
    return rows.join(forced, "k", "left").select("doc_id", F.when(F.col("forced"), "train").otherwise(split).alias("split"))


@query("SELECT doc_id, CASE WHEN CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 2 = 0 THEN 'selection' ELSE 'calibration' END AS part FROM documents")
def parity_split(spark, d):
    n = F.conv(F.substring(K.digest(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long")
    return table(spark, d, "documents").select("doc_id", F.when(n % 2 == 0, "selection").otherwise("calibration").alias("part"))


@query("SELECT doc_id, CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 20 = 0 AS is_val FROM documents")
def modulo_split(spark, d):
    n = F.conv(F.substring(K.digest(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long")
    return table(spark, d, "documents").select("doc_id", (n % 20 == 0).alias("is_val"))


@query("""WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages), o AS (SELECT host, row_number() OVER (ORDER BY sha256(host), host) AS r FROM (SELECT DISTINCT host FROM h))
SELECT page_id, host, CASE WHEN r <= 2 THEN 'val' WHEN r <= 4 THEN 'calibration' WHEN r <= 6 THEN 'test' ELSE 'train' END AS split FROM h JOIN o USING (host)""")
def domain_split(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))
    # the first six hosts in hashed order are a top-k, so no window over all hosts is needed
    top = pages.select("host").distinct().orderBy(K.digest("host"), "host").limit(6)
    ranked = top.withColumn("r", F.row_number().over(Window.orderBy(K.digest("host"), "host")))
    split = F.when(F.col("r") <= 2, "val").when(F.col("r") <= 4, "calibration").when(F.col("r") <= 6, "test").otherwise("train")
    return pages.join(F.broadcast(ranked), "host", "left").select("page_id", "host", split.alias("split"))


OWNED = f"SELECT sha256({norm('text')}) AS k, CASE WHEN {bucket('CAST(doc_id AS VARCHAR)')} < 0.8 THEN 'train' ELSE 'test' END AS split FROM documents"


def _owned(spark, d):
    split = F.when(K.bucket(F.col("doc_id").cast("string")) < 0.8, "train").otherwise("test")
    return table(spark, d, "documents").select(K.state_key("text").alias("k"), split.alias("split"))


@query(f"SELECT k FROM ({OWNED}) GROUP BY k HAVING count(DISTINCT split) > 1")
def split_ownership_audit(spark, d):
    return S.owned_twice(_owned(spark, d), "k", "split")


@query(f"SELECT count(*) AS n_keys, count(*) FILTER (WHERE c > 1) AS n_shared FROM (SELECT k, count(DISTINCT split) AS c FROM ({OWNED}) GROUP BY k)")
def split_overlap_counts(spark, d):
    per = _owned(spark, d).groupBy("k").agg((F.min("split") != F.max("split")).alias("shared"))
    return per.agg(F.count("*").alias("n_keys"), F.count_if("shared").alias("n_shared"))


REASONS = f"""WITH a AS (SELECT doc_id, n_chars, lang, sha256({norm('text')}) AS k FROM documents), b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS r FROM a),
c AS (SELECT *, CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'locale' WHEN r > 1 THEN 'duplicate' WHEN n_chars > 5000 THEN 'capacity' ELSE 'kept' END AS reason FROM b)"""


def _reasons(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars", "lang", K.state_key("text").alias("k"))
    r = F.row_number().over(Window.partitionBy("k").orderBy("doc_id"))
    return rows.withColumn("r", r).withColumn("reason", S.first_reason([("locale", ~F.col("lang").isin("en", "de", "fr")), ("duplicate", F.col("r") > 1), ("capacity", F.col("n_chars") > 5000)]))


@query(REASONS + " SELECT doc_id, reason FROM c")
def exclusion_reasons(spark, d):
    return _reasons(spark, d).select("doc_id", "reason")


@query(REASONS + " SELECT reason, count(*) AS n FROM c GROUP BY reason")
def filter_stage_counts(spark, d):
    return _reasons(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""WITH a AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY source, lang ORDER BY {seeded(7, 'doc_id')}, doc_id) AS t FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY t, lang) AS p FROM a WHERE t <= 12) SELECT doc_id, lang, source FROM b WHERE p <= 12""")
def round_robin_balanced(spark, d):
    return S.round_robin(table(spark, d, "documents").select("doc_id", "lang", "source"), ["source"], "lang", 12, 7, "doc_id")


@query(f"""WITH a AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY {seeded(3, 'l_orderkey', 'l_linenumber')}, l_orderkey, l_linenumber) AS t FROM lineitem),
b AS (SELECT *, row_number() OVER (ORDER BY t, l_returnflag) AS p FROM a WHERE t <= 800) SELECT l_orderkey, l_linenumber, l_returnflag FROM b WHERE p <= 800""")
def round_robin_retention(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").withColumn("all", F.lit(0))
    return S.round_robin(rows, ["all"], "l_returnflag", 800, 3, "l_orderkey", "l_linenumber").drop("all")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents) WHERE r <= 2")
def first_two_per_track(spark, d):
    r = F.row_number().over(Window.partitionBy("source").orderBy(K.digest(F.col("doc_id").cast("string")), "doc_id"))
    return table(spark, d, "documents").select("doc_id", "source").withColumn("r", r).where("r <= 2").drop("r")


@query("""WITH g AS (SELECT DISTINCT event_type, user_id FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY sha256(CAST(user_id AS VARCHAR)), user_id) AS r FROM g)
SELECT event_type, user_id FROM r ORDER BY r, event_type LIMIT 100""")
def track_round_robin_groups(spark, d):
    groups = table(spark, d, "events").select("event_type", "user_id").distinct()
    r = F.row_number().over(Window.partitionBy("event_type").orderBy(K.digest(F.col("user_id").cast("string")), "user_id"))
    return groups.withColumn("r", r).where("r <= 100").orderBy("r", "event_type").limit(100).drop("r")


@query(f"""WITH a AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY {seeded(5, 'doc_id')}, doc_id) AS r FROM documents)
SELECT doc_id, lang FROM a WHERE r <= 40 ORDER BY {seeded(5, 'doc_id')}, doc_id LIMIT 100""")
def per_label_caps(spark, d):
    capped = S.hash_limit(table(spark, d, "documents").select("doc_id", "lang"), 40, 5, "doc_id", within=["lang"])
    return S.hash_limit(capped, 100, 5, "doc_id")


@query(f"""WITH a AS (SELECT doc_id, toxic FROM labels), t AS (SELECT * FROM a WHERE toxic = 1 ORDER BY {seeded(9, 'doc_id')}, doc_id LIMIT 30),
c AS (SELECT *, row_number() OVER (ORDER BY {seeded(9, 'doc_id')}, doc_id) AS r FROM a WHERE toxic = 0) SELECT doc_id, toxic FROM t UNION ALL SELECT doc_id, toxic FROM c WHERE r <= 60 - (SELECT count(*) FROM t)""")
def stratified_threshold_sample(spark, d):
    rows = table(spark, d, "labels").select("doc_id", "toxic")
    hot = S.hash_limit(rows.where("toxic = 1"), 30, 9, "doc_id")
    clean = S.hash_limit(rows.where("toxic = 0"), 60, 9, "doc_id").withColumn("r", F.row_number().over(Window.orderBy(K.seeded(9, "doc_id"), "doc_id")))
    clean = clean.join(F.broadcast(hot.agg(F.count("*").alias("n"))), F.col("r") <= 60 - F.col("n")).select("doc_id", "toxic")
    return hot.unionByName(clean)


@query(f"SELECT doc_id, n_chars FROM documents ORDER BY (n_chars < 4000), {seeded(2, 'doc_id')}, doc_id LIMIT 50")
def priority_quota(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.col("n_chars") < 4000, K.seeded(2, "doc_id"), "doc_id").limit(50)


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 32")
def longest_topk(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(32)


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def latest_response_wins(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"))


@query("SELECT event_id, user_id, value, value < coalesce(min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e308) AS improved FROM events")
def running_best_checkpoint(spark, d):
    before = F.min("value").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    return table(spark, d, "events").select("event_id", "user_id", "value", (F.col("value") < F.coalesce(before, F.lit(1e308))).alias("improved"))


@query("SELECT event_id, value, min(value) OVER w AS best, value < coalesce(min(value) OVER w, 1e308) AS improved FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def running_best_of_log(spark, d):
    """The least value before each row of one log."""
    rows = least_before(table(spark, d, "events").select("event_id", "value"), "value", ["event_id"])
    return rows.withColumn("improved", F.col("value") < F.coalesce("best", F.lit(1e308)))


@query("SELECT user_id, min_by(event_id, struct_pack(v := value, e := event_id)) AS best_event, min(value) AS best FROM events GROUP BY user_id")
def arg_best_row(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct("value", "event_id")).alias("best_event"), F.min("value").alias("best"))


@query("SELECT s.s_suppkey, min(t.s_suppkey) AS component FROM supplier s JOIN supplier t ON s.s_nationkey = t.s_nationkey GROUP BY s.s_suppkey")
def components_min_label(spark, d):
    s = table(spark, d, "supplier")
    hub = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("hub"))
    edges = s.join(hub, "s_nationkey").select(F.col("s_suppkey").alias("src"), F.col("hub").alias("dst"))
    labels = component_labels(edges)
    return s.select("s_suppkey").join(labels, F.col("s_suppkey") == F.col("node"), "left").select("s_suppkey", F.coalesce("component", "s_suppkey").alias("component"))


LINKS = f"""RECURSIVE e AS MATERIALIZED (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest({ATOMS}) AS k FROM documents)), h AS (SELECT k, min(doc_id) AS hub FROM e GROUP BY k),
l AS MATERIALIZED (SELECT DISTINCT doc_id AS a, hub AS b FROM e JOIN h USING (k) WHERE doc_id <> hub), u AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, label) USING KEY (node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.a, min(r.label) FROM r JOIN u ON u.b = r.node JOIN recurring.r AS o ON o.node = u.a WHERE r.label < o.label GROUP BY u.a)"""


def _text_components(spark, d):
    """Documents linked by shared sentences. Sentences are cut once; each has a star to its least document in each of
    sixteen parts, and one from those to the least of all, so that no sentence's documents meet in one join key."""
    docs = table(spark, d, "documents")
    e = docs.select("doc_id", F.explode(K.content_atoms("text")).alias("k")).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(16)))
    e = Workspace(spark).write(e, "sentences")
    near = Workspace(spark).write(e.groupBy("k", "part").agg(F.min("doc_id").alias("near"), F.count("*").alias("n")), "near")
    hub = near.groupBy("k").agg(F.min("near").alias("hub"), F.sum("n").alias("n")).where("n > 1").drop("n")
    inner = e.join(near.where("n > 1").drop("n"), ["k", "part"]).select(F.col("doc_id").alias("src"), F.col("near").alias("dst"))
    outer = near.join(hub, "k").select(F.col("near").alias("src"), F.col("hub").alias("dst"))
    edges = inner.unionByName(outer).where("src <> dst")
    return docs.select("doc_id").join(component_labels(edges), F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))


@query(f"WITH {LINKS} SELECT node AS doc_id, label AS component FROM r")
def text_components(spark, d):
    return _text_components(spark, d)


@query(f"WITH {LINKS} SELECT node AS doc_id, CASE WHEN {bucket('CAST(label AS VARCHAR)')} < 0.76 THEN 'train' WHEN {bucket('CAST(label AS VARCHAR)')} < 0.84 THEN 'val' WHEN {bucket('CAST(label AS VARCHAR)')} < 0.92 THEN 'calibration' ELSE 'test' END AS split FROM r")
def component_split_isolation(spark, d):
    split = S.split_by(K.bucket(F.col("component").cast("string")), [(0.76, "train"), (0.84, "val"), (0.92, "calibration")], "test")
    return _text_components(spark, d).select("doc_id", split.alias("split"))


@query(f"""WITH {LINKS}, g AS (SELECT DISTINCT r.label FROM r JOIN documents d ON d.doc_id = r.node
    WHERE sha256({norm('text')}) IN (SELECT sha256({norm('text')}) FROM documents WHERE source = 'src1' AND lang = 'en'))
SELECT node AS doc_id, label IN (SELECT label FROM g) AS forced, CASE WHEN label IN (SELECT label FROM g) OR {bucket('CAST(label AS VARCHAR)')} < 0.76 THEN 'train'
    WHEN {bucket('CAST(label AS VARCHAR)')} < 0.84 THEN 'val' WHEN {bucket('CAST(label AS VARCHAR)')} < 0.92 THEN 'calibration' ELSE 'test' END AS split FROM r""")
def component_split_forced_train(spark, d):
    """Splits by component; one member whose text was trained on before puts its whole component into training."""
    docs = table(spark, d, "documents").select("doc_id", K.state_key("text").alias("k"), ((F.col("source") == "src1") & (F.col("lang") == "en")).alias("old"))
    legacy = docs.where("old").select("k").distinct()
    found = _text_components(spark, d)
    forced = docs.join(legacy, "k", "left_semi").join(found, "doc_id").select("component").distinct().withColumn("forced", F.lit(True))
    split = S.split_by(K.bucket(F.col("component").cast("string")), [(0.76, "train"), (0.84, "val"), (0.92, "calibration")], "test")
    rows = found.join(forced, "component", "left").withColumn("forced", F.coalesce("forced", F.lit(False)))
    return rows.select("doc_id", "forced", F.when(F.col("forced"), "train").otherwise(split).alias("split"))


@query(f"WITH {LINKS} SELECT doc_id FROM (SELECT node AS doc_id, row_number() OVER (PARTITION BY label ORDER BY {seeded(1, 'node')}, node) AS r FROM r) WHERE r = 1 ORDER BY {seeded(1, 'doc_id')}, doc_id LIMIT 60")
def disjoint_holdout_by_component(spark, d):
    one = S.first_by(_text_components(spark, d), ["component"], [K.seeded(1, "doc_id"), "doc_id"])
    return S.hash_limit(one.select("doc_id"), 60, 1, "doc_id")
