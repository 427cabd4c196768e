"""Queries that build whole examples from registered sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.builders import Source, build
from ..sources.session import table
from .registry import query

LANGUAGES = (("de", "written in German"), ("en", "written in English"), ("es", "written in Spanish"), ("fr", "written in French"))
PRIORITIES = tuple((p, f"handled as {p[2:].lower()}") for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))
levels = lambda *names: tuple((n, n) for n in names)
CHOICE = "SELECT {key} AS id, {state} AS state, {gold} AS gold, CAST(NULL AS DOUBLE) AS value FROM {table}"
MEASURED = "SELECT {key} AS id, {state} AS state, CAST(NULL AS STRING) AS gold, {value} AS value FROM {table}"

TEXT, LABELLED = "text", "{{documents}} JOIN {{labels}} USING (doc_id)"
PART = """'{{"name":"' || p_name || '","brand":"' || p_brand || '"}}'"""
EVENT = "'On ' || substr(CAST(ts AS STRING), 1, 10) || ': ' || props"


def choice(**parts) -> str:
    return CHOICE.format(**{k: v.replace("{{", "{").replace("}}", "}") for k, v in parts.items()})


def measured(**parts) -> str:
    return MEASURED.format(**{k: v.replace("{{", "{").replace("}}", "}") for k, v in parts.items()})


# braces of JSON states are doubled once more, as the query is a template
JSON_PART = PART.replace("{{", "{{{{").replace("}}", "}}}}")
SIZES = levels("tiny", "small", "medium", "large", "huge")

SOURCES = (
    Source("quality", "noul", "Is this text of good quality?", (), measured(key="doc_id", state=TEXT, value="quality", table=LABELLED), 150),
    Source("toxic", "noul", "Is this text toxic?", (), measured(key="doc_id", state=TEXT, value="toxic", table=LABELLED), 100),
    Source("language", "choice", "Which language is it?", LANGUAGES, choice(key="doc_id", state=TEXT, gold="lang", table="{{documents}}"), 400),
    Source("role", "choice", "Who says this?", levels("assistant", "system", "user"), choice(key="conv_id * 1000 + turn", state=TEXT, gold="role", table="{{conversations}}"), 300),
    Source("status", "choice", "What became of the order?", levels("F", "O", "P"), choice(key="o_orderkey", state="'Order of ' || substr(CAST(o_orderdate AS STRING), 1, 10)", gold="o_orderstatus", table="{{orders}}"), 700),
    Source("priority", "choice", "How urgent is the order?", PRIORITIES, choice(key="o_orderkey", state="'Order ' || CAST(o_orderkey AS STRING)", gold="o_orderpriority", table="{{orders}}"), 500),
    Source("action", "choice", "What did the user do?", levels("click", "error", "purchase", "scroll", "view"), choice(key="event_id", state=EVENT, gold="event_type", table="{{events}}"), 900),
    Source("segment", "choice", "Which market is the customer in?", levels("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"), choice(key="c_custkey", state="c_name", gold="c_mktsegment", table="{{customer}}"), 300),
    Source("region", "choice", "Which part of the world is it in?", levels("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"), choice(key="n_nationkey", state="n_name", gold="r_name", table="{{nation}} JOIN {{region}} ON n_regionkey = r_regionkey"), 20),
    Source("size", "score", "How large is the part?", SIZES, measured(key="p_partkey", state=JSON_PART, value="(p_size - 1) / 49e0 * 4", table="{{part}}"), 250),
    Source("price", "score", "How dear is the part?", levels("cheap", "fair", "dear"), measured(key="p_partkey", state="p_name", value="(p_retailprice - 900) / 1200e0 * 2", table="{{part}}"), 250),
    Source("length", "score", "How long is the text?", levels("short", "middling", "long", "very long"), measured(key="doc_id", state=TEXT, value="length(text) / 1e4 * 3", table="{{documents}}"), 350),
    Source("value", "score", "How much is it worth?", levels(*"0123456789"), measured(key="event_id", state=EVENT, value="value / 1e1", table="{{events}}"), 350),
)
HELD_OUT = (
    Source("size", "score", "How large is the part?", SIZES, measured(key="p_partkey", state=JSON_PART, value="(p_size - 1) / 49e0 * 4", table="{{part}} WHERE p_partkey % 3 = 0"), 600),
    Source("total", "score", "How much does the order cost?", levels("little", "some", "much"), measured(key="o_orderkey", state="'Order ' || CAST(o_orderkey AS STRING)", value="o_totalprice / 5e5 * 2", table="{{orders}} WHERE o_orderkey % 3 = 0"), 600),
    Source("worth", "score", "How much was spent?", levels("little", "some", "more", "most"), measured(key="event_id", state=EVENT, value="value / 3e1", table="{{events}} WHERE event_id % 3 = 0"), 600),
    Source("balance", "score", "How good is the account?", levels("in debt", "even", "good"), measured(key="c_custkey", state="c_name", value="(c_acctbal + 1000) / 11e3 * 2", table="{{customer}} WHERE c_custkey % 3 = 0"), 600),
)


def rows_sql(s: Source, seed) -> str:
    """One row for each option of a source's examples."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    keys = "[" + ", ".join(text(k) for k, _ in s.options) + "]"
    named = "map {" + ", ".join(f"{text(k)}: {text(d)}" for k, d in s.options) + "}"
    rows = s.rows.format(**{t: t for t in ("documents", "labels", "conversations", "orders", "events", "customer", "nation", "region", "part")})
    if s.kind == "choice":
        fine, place, option = f"gold IN {keys.replace('[', '(').replace(']', ')')}", "list_position(o, k) - 1", "k"
        shown = f"list_transform(list_sort(list_transform({keys}, lambda k: sha256(concat_ws('|', '{seed}|{s.name}', CAST(id AS VARCHAR), k)) || k)), lambda x: substr(x, 65))"
        p, desc = "CASE WHEN k = gold THEN 1.0 ELSE 0.0 END", f"{named}[k]"
    elif s.kind == "score":
        fine, place, option, shown = f"value BETWEEN 0 AND {len(s.options) - 1}", "list_position(o, k) - 1", "k", keys
        p, desc = f"greatest(0, 1 - abs(value - (list_position({keys}, k) - 1)))", f"{named}[k]"
    else:
        fine, place, option, shown = "value BETWEEN 0 AND 1", "CASE k WHEN 'no' THEN 0 ELSE 1 END", "NULL", "['no', 'yes']"
        p, desc = "CASE k WHEN 'no' THEN 1 - value ELSE value END", "NULL"
    return f"""SELECT '{s.name}' AS source, '{s.kind}' AS type, id, state, {text(s.instructions)} AS instructions, CAST({place} AS BIGINT) AS place,
        CAST({option} AS VARCHAR) AS option, CAST({desc} AS VARCHAR) AS description, round(CAST({p} AS DOUBLE), 6) AS p
    FROM (SELECT *, {shown} AS o, unnest({shown}) AS k
        FROM (SELECT CAST(id AS BIGINT) AS id, state, gold, CAST(value AS DOUBLE) AS value FROM ({rows})
            WHERE state IS NOT NULL AND id IS NOT NULL AND {fine}
            QUALIFY row_number() OVER (ORDER BY sha256(concat_ws('|', '{seed}|{s.name}', CAST(id AS VARCHAR))), id) <= {s.quota}))"""


def _rows(spark, d, sources, seed):
    names = ("documents", "labels", "conversations", "orders", "events", "customer", "nation", "region", "part")
    built = build(spark, sources, {n: table(spark, d, n) for n in names}, seed)
    each = built.select("source", "type", "id", "state", "instructions", "options", F.posexplode("target").alias("place", "p"))
    option = F.get("options", F.col("place"))
    return each.select("source", "type", "id", "state", "instructions", F.col("place").cast("long").alias("place"), option["key"].alias("option"), option["desc"].alias("description"), F.round("p", 6).alias("p"))


@query(" UNION ALL ".join(rows_sql(s, 6) for s in SOURCES))
def built_examples(spark, d):
    """Whole examples of thirteen sources, with quotas: state, question, options in their order, and target."""
    return _rows(spark, d, SOURCES, 6)


@query(" UNION ALL ".join(rows_sql(s, 8) for s in HELD_OUT))
def ordinal_sources(spark, d):
    """Held-out examples of four sources on scales; what lies between two levels is shared."""
    return _rows(spark, d, HELD_OUT, 8)
