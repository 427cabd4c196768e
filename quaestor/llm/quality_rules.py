"""Quality rules with adaptive thresholds.

Each measure of a document is a whole number of ten-thousandths. For each language and source a sketch counts
documents by the measure's leading BITS binary digits (relative error under 2 to the power 1 - BITS); sketches are
plain counts, so they merge by adding, up to a language's and to the whole table's. A sketch's threshold is its
upper quartile plus SPREADS times the distance of the quartiles (at least the measure's least spread). A language's is
drawn towards the whole table's as by PRIOR documents of that, and one of a language and source likewise towards its
language's, so each group's own sketch counts for more, the more documents it has. Documents above a threshold are
rejected; the thresholds are joined to them. All of it is built-in functions.

Null texts have no words. A null language or source is a value of its own. Repeated rows are measured each; columns
besides those named are not read and are kept by filter_documents; a table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.session import Workspace

BITS, SPREADS, PRIOR, MIN_WORDS = 7, 3, 200, 50
#: Least spreads, in ten-thousandths: symbols a word, characters a word, repeated lines a line with a word.
MEASURES = {"symbols": 300, "length": 2000, "lines": 1500}
#: Thresholds of that many groups at most are broadcast; more are joined with salt.
BROADCAST_ROWS, SALTS = 50_000, 32

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def measure(df: DataFrame, repeats: bool = True) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and, unless told otherwise, n_repeat_words.

    Three-word windows are told apart by 64-bit hashes within their text; a text without two equal ones, which a
    hash set shows, isn't sorted.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(_without(x, SPACES)) > 0)
    df = df.withColumns({"_w": F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != ""), "_l": lines, "word_chars": F.length(_without(text, SPACES)).cast("long"), "n_symbols": (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long")})
    df = df.withColumns({"n_words": F.size("_w").cast("long"), "n_lines": F.size("_l").cast("long"), "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")})
    if not repeats:
        return df.drop("_w", "_l")
    n, at = F.size("_w"), lambda i: F.get(F.col("_w"), i)
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))).otherwise(F.array().cast("array<long>"))
    df = df.withColumn("_h", hashes)
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, k: F.get(F.col("_s"), k)["h"] == x["h"]
    found = F.filter("_s", lambda x, k: F.coalesce(same(x, k + 1), F.lit(False)) | ((k > 0) & same(x, F.greatest(k - 1, F.lit(0)))))
    df = df.withColumn("_p", F.sort_array(F.transform(found, lambda x: x["i"])))
    gaps = F.transform("_p", lambda x, k: F.least(F.lit(3), F.coalesce(F.get(F.col("_p"), k + 1) - x, F.lit(3))))
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("_w", "_l", "_h", "_s", "_p")


def _values() -> dict[str, Column]:
    share = lambda a, b: F.coalesce(F.expr(f"try_divide(10000 * {a}, {b})"), F.lit(0.0)).cast("long")
    return {"symbols": share("n_symbols", "n_words"), "length": share("word_chars", "n_words"), "lines": share("n_dup_lines", "n_lines")}


def leading(x: Column) -> Column:
    """The least whole number with the same leading digits."""
    drop = F.greatest(F.length(F.bin(x)) - BITS, F.lit(0))
    power = F.pow(F.lit(2.0), drop).cast("long")
    return (x - x % power).cast("long")


def thresholds(measured: DataFrame) -> DataFrame:
    """_lang, _source and a column for each measure. Only documents of MIN_WORDS words or more are counted."""
    long = measured.where(F.col("n_words") >= MIN_WORDS).select("_lang", "_source", F.explode(F.array(*(F.struct(F.lit(m).alias("m"), leading(v).alias("x")) for m, v in _values().items()))).alias("e"))
    sketch = long.groupBy("_lang", "_source", F.col("e.m").alias("m"), F.col("e.x").alias("x")).agg(F.count("*").alias("n"))
    levels = sketch.groupBy("_lang", "_source", "m").agg(*_quartiles()), sketch.groupBy("_lang", "m", "x").agg(F.sum("n").alias("n")).groupBy("_lang", "m").agg(*_quartiles()), sketch.groupBy("m", "x").agg(F.sum("n").alias("n")).groupBy("m").agg(*_quartiles())
    floor = F.create_map(*(x for m, v in MEASURES.items() for x in (F.lit(m), F.lit(v))))
    cut = lambda df, name: df.select(*(c for c in df.columns if c not in ("total", "q1", "q3")), F.col("total").alias(f"n_{name}"), (F.col("q3") + SPREADS * F.greatest(F.col("q3") - F.col("q1"), floor[F.col("m")])).cast("long").alias(name))
    own, lang, every = (cut(df, name) for df, name in zip(levels, ("own", "by_lang", "by_all")))
    joined = own.join(lang.withColumnRenamed("_lang", "_l").withColumnRenamed("m", "_m"), F.col("_lang").eqNullSafe(F.col("_l")) & (F.col("m") == F.col("_m"))).join(F.broadcast(every), "m")  # a row for each measure
    drawn = lambda n, x, to: f"(n_{n} * {x} + {PRIOR} * {to}) div (n_{n} + {PRIOR})"
    chosen = F.expr(drawn("own", "own", f"({drawn('by_lang', 'by_lang', 'by_all')})"))
    return joined.groupBy("_lang", "_source").agg(*(F.max(F.when(F.col("m") == m, chosen)).alias(f"_{m}") for m in MEASURES))


def _quartiles() -> list[Column]:
    """From the counts of one sketch, which has a few hundred entries at most: its total and quartiles."""
    entries = F.sort_array(F.collect_list(F.struct("x", "n")))
    total = F.sum("n")

    def quantile(percent: int) -> Column:
        step = lambda acc, e: F.struct((acc["seen"] + e["n"]).alias("seen"), F.when(acc["seen"] * 100 < total * percent, e["x"]).otherwise(acc["at"]).alias("at"))
        return F.aggregate(entries, F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("at")), step)["at"]

    return [total.alias("total"), quantile(25).alias("q1"), quantile(75).alias("q3")]


def judged(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", fixed: DataFrame | None = None) -> DataFrame:
    """df with its measures, base_failed and kept. `fixed`: thresholds found before, in place of this table's own."""
    named = df.withColumns({"_text": F.col(text_col), "_lang": F.col(lang_col), "_source": F.col(source_col)})
    if fixed is None:
        found = thresholds(measure(named.select("_text", "_lang", "_source"), repeats=False))
        fixed = Workspace(df.sparkSession).write(found, "thresholds")
    return verdicts(measure(named).drop("_text"), fixed)


def verdicts(measured: DataFrame, fixed: DataFrame) -> DataFrame:
    """Measured rows with _lang and _source, which go, with base_failed and kept."""
    limits = fixed.withColumnsRenamed({"_lang": "_of_lang", "_source": "_of_source"})
    rows = measured.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    same = F.col("_lang").eqNullSafe(F.col("_of_lang")) & F.col("_source").eqNullSafe(F.col("_of_source"))
    if len(limits.take(BROADCAST_ROWS + 1)) <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(limits), same, "left")
    else:
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("n_words", "word_chars", "n_symbols"), F.lit(SALTS)))
        joined = rows.join(limits.withColumn("_of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), same & (F.col("_salt") == F.col("_of_salt")), "left").drop("_salt", "_of_salt")
    high = [F.coalesce(v > F.col(f"_{m}"), F.lit(False)) for m, v in _values().items()]
    verdict = ~F.col("base_failed") & ~(high[0] | high[1] | high[2])
    return joined.withColumn("kept", verdict).drop("_lang", "_source", "_of_lang", "_of_source", *(f"_{m}" for m in MEASURES))


def filter_documents(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of df that are kept, with df's columns."""
    packed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    # a number that isn't known beforehand keeps the verdict from being put in place of its name over and over
    return judged(packed).withColumn("_n", F.monotonically_increasing_id()).where("kept AND _n >= 0").select("row.*")


def quality_rules(df: DataFrame) -> DataFrame:
    """The measures of each document and its verdict. Texts are read once: measures are written, and both the sketches
    and the verdicts come from them."""
    named = df.select("doc_id", F.col("text").alias("_text"), F.col("lang").alias("_lang"), F.col("source").alias("_source"))
    work = Workspace(df.sparkSession)
    rows = work.write(measure(named).drop("_text"), "measures")
    out = verdicts(rows, work.write(thresholds(rows), "thresholds"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls
  FROM documents),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid),
m AS (
  SELECT w.rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(length(regexp_replace(t, '[ \t-\r]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid)),
v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CASE WHEN n_words > 0 THEN 10000 * n_symbols // n_words ELSE 0 END AS symbols,
         CASE WHEN n_words > 0 THEN 10000 * word_chars // n_words ELSE 0 END AS length,
         CASE WHEN n_lines > 0 THEN 10000 * n_dup_lines // n_lines ELSE 0 END AS lines
  FROM m),
e AS (
  SELECT lang, source, f.m, f.x - f.x % CAST(pow(2, greatest(length(bin(f.x)) - 7, 0)) AS BIGINT) AS x, f.spread
  FROM v, unnest([{'m': 'symbols', 'x': symbols, 'spread': 300}, {'m': 'length', 'x': length, 'spread': 2000},
                  {'m': 'lines', 'x': lines, 'spread': 1500}]) AS u(f)
  WHERE n_words >= 50),
c AS (
  SELECT 2 AS level, lang, source, m, spread, x, count(*) AS n FROM e GROUP BY ALL
  UNION ALL SELECT 1, lang, NULL, m, spread, x, count(*) FROM e GROUP BY ALL
  UNION ALL SELECT 0, NULL, NULL, m, spread, x, count(*) FROM e GROUP BY ALL),
s AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, m ORDER BY x) AS upto,
         sum(n) OVER (PARTITION BY level, lang, source, m) AS total FROM c),
q AS (
  SELECT level, lang, source, m, any_value(total) AS total, any_value(spread) AS spread,
         min(x) FILTER (WHERE upto * 100 >= total * 25) AS q1, min(x) FILTER (WHERE upto * 100 >= total * 75) AS q3
  FROM s GROUP BY level, lang, source, m),
h AS (SELECT level, lang, source, m, CAST(total AS BIGINT) AS total, q3 + 3 * greatest(q3 - q1, spread) AS top FROM q),
lim AS (
  SELECT a.lang, a.source, a.m, (a.total * a.top + 200 * ((b.total * b.top + 200 * z.top) // (b.total + 200))) // (a.total + 200) AS top
  FROM h a JOIN h b ON b.level = 1 AND a.lang IS NOT DISTINCT FROM b.lang AND a.m = b.m JOIN h z ON z.level = 0 AND a.m = z.m
  WHERE a.level = 2),
p AS (
  SELECT lang, source, max(top) FILTER (WHERE m = 'symbols') AS a, max(top) FILTER (WHERE m = 'length') AS b,
         max(top) FILTER (WHERE m = 'lines') AS c FROM lim GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (coalesce(symbols > a, false) OR coalesce(length > b, false) OR coalesce(lines > c, false)) AS kept
FROM v LEFT JOIN p ON v.lang IS NOT DISTINCT FROM p.lang AND v.source IS NOT DISTINCT FROM p.source
"""
