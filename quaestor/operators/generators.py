"""Synthetic rows whose labels follow from them. All randomness is hash bits of a row's number."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bits(name: str, key="id") -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{name}|"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")


def digit(x: Column, below: int, base: int) -> Column:
    """The digit of x in a mixed base: x div below mod base."""
    return F.pmod(F.floor(x / below), F.lit(base))


def _combined(op: Column, a: Column, b: Column) -> Column:
    return F.when(op == 0, a & b).when(op == 1, a | b).otherwise(a != b)


def boolean_rules(spark: SparkSession, n: int) -> DataFrame:
    """Rules of two operators over three facts, with their truth."""
    rows = spark.range(n).withColumn("x", bits("rule"))
    facts = {c: digit(F.col("x"), 2**i, 2) == 1 for i, c in enumerate("abc")}
    rows = rows.withColumns(facts | {"op1": digit(F.col("x"), 8, 3), "op2": digit(F.col("x"), 24, 3)})
    return rows.withColumn("truth", _combined(F.col("op2"), _combined(F.col("op1"), F.col("a"), F.col("b")), F.col("c")))


def arithmetic(spark: SparkSession, n: int) -> DataFrame:
    """Sums, products, floored quotients and remainders; wrong answers lie one or a divisor away."""
    x = bits("sum")
    rows = spark.range(n).select("id", (F.pmod(x, F.lit(199)) - 99).alias("a"), (digit(x, 199, 12) + 1).alias("b"), digit(x, 2388, 4).alias("op"))
    a, b = F.col("a"), F.col("b")
    result = F.when(F.col("op") == 0, a + b).when(F.col("op") == 1, a * b).when(F.col("op") == 2, F.floor(a / b)).otherwise(F.pmod(a, b))
    return rows.withColumn("result", result.cast("long")).withColumn("distractors", F.array_except(F.array(*(F.col("result") + k for k in (1, -1, 2)), F.col("result") + b), F.array("result")))


def counterfactual_pairs(spark: SparkSession, trees: int) -> DataFrame:
    """For each random truth table over four facts, a true and a false case with the fewest facts between them."""
    cases = spark.range(trees).withColumnRenamed("id", "tree").select("tree", F.explode(F.expr("sequence(0L, 15L)")).alias("x"))
    truth = F.pmod(F.floor(bits("tree", "tree") / F.pow(F.lit(2.0), F.col("x"))), F.lit(2)) == 1
    cases = cases.withColumn("truth", truth)
    yes, no = cases.where("truth").drop("truth"), cases.where("NOT truth").select("tree", F.col("x").alias("y"))
    pairs = yes.join(no, "tree").withColumn("dist", F.bit_count(F.col("x").bitwiseXOR(F.col("y"))))
    best = pairs.groupBy("tree").agg(F.min(F.struct("dist", "x", "y")).alias("m"))
    return best.select("tree", "m.x", "m.y", F.col("m.dist").cast("int").alias("dist"))


def deadline_label(days_after: Column) -> Column:
    return F.when(days_after > 0, "late").when(days_after == 0, "due").otherwise("early")


def deadlines(df: DataFrame, key: str, date: str, offsets: list[int]) -> DataFrame:
    """Whether a date some days on keeps to the end of the first date's month."""
    day = F.col(date).cast("date")
    rows = df.select(key, day.alias("day"), F.last_day(day).alias("due"), F.explode(F.array(*map(F.lit, offsets))).alias("n"))
    late = F.datediff(F.date_add("day", F.col("n")), F.col("due"))
    return rows.select(key, "n", deadline_label(late).alias("label"), F.date_format("due", "dd.MM.yyyy").alias("shown"))


def programs(spark: SparkSession, n: int) -> DataFrame:
    """What four one-line programs give for small numbers."""
    x = F.pmod(F.col("id"), F.lit(41)) - 20
    results = F.array(x * x, x + 3, F.abs(x) % 7, F.greatest(x, F.lit(10)))
    return spark.range(n).select("id", F.posexplode(results).alias("k", "v")).select("id", F.col("k").cast("long").alias("k"), F.col("v").cast("long").alias("v"))


def deep_rule() -> tuple[Column, Column]:
    """A rule of two to four operators over five facts, in words, and its truth, by the row's number."""
    x, names = bits("deep"), "abcde"
    facts, depth = F.array(*(digit(x, 2**i, 2) == 1 for i in range(5))), digit(x, 32, 3) + 2
    rule = truth = None
    for i in range(5):
        y = bits(f"leaf{i}")
        fact, negated = digit(y, 1, 5).cast("int"), digit(y, 5, 10) < 3
        word = F.concat(F.when(negated, "not ").otherwise(""), F.get(F.array(*map(F.lit, names)), fact))
        said = F.get(facts, fact) != negated
        if rule is None:
            rule, truth = word, said
            continue
        both = digit(y, 50, 2) == 0
        rule = F.when(depth >= i, F.concat(F.lit("("), rule, F.when(both, " and ").otherwise(" or "), word, F.lit(")"))).otherwise(rule)
        truth = F.when(depth >= i, F.when(both, truth & said).otherwise(truth | said)).otherwise(truth)
    return rule, truth


def list_programs(spark: SparkSession, n: int) -> DataFrame:
    """What six one-line programs over a list and two numbers give, lists as text."""
    numbers = F.transform(F.sequence(F.lit(0).cast("long"), 2 + F.col("id") % 5), lambda i: (F.col("id") * 7 + i * i * 5 + i) % 26 - 10)
    rows = spark.range(n).select("id", (F.col("id") % 21 - 8).alias("k"), (F.col("id") % 7 + 2).alias("m"), numbers.alias("x"))
    k, m, x = F.col("k"), F.col("m"), F.col("x")
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)
    size = F.size(x).cast("long")
    last = F.slice(x, F.greatest(size - m + 1, F.lit(1)).cast("int"), m.cast("int"))
    listed = lambda a: F.array_join(a.cast("array<string>"), ",")
    results = [
        total(F.transform(F.filter(x, lambda v: v % m != 0), lambda v: v + k)).cast("string"),
        listed(F.filter(F.transform(x, lambda v: v * k), lambda v, i: i % m == 0)),
        listed(F.slice(F.array_sort(F.array_distinct(F.concat(x, F.array(k)))), F.lit(1), m.cast("int"))),
        (total(last) + k).cast("string"),
        listed(F.reverse(F.filter(x, lambda v: v > k))),
        F.size(F.filter(x, lambda v: F.pmod(v, m) == F.pmod(k, m))).cast("string"),
    ]
    return rows.select("id", F.posexplode(F.array(*results)).alias("body", "result")).select("id", F.col("body").cast("long").alias("body"), "result")


def grace_deadlines(df: DataFrame, key: str, date: str, graces: list[int]) -> DataFrame:
    """Receipts around a due date and the end of its days of grace: 0 on time, 1 late but accepted, 2 rejected."""
    which = F.pmod(F.col(key), F.lit(3)).cast("int")
    rows = df.select(key, F.col(date).cast("date").alias("due"), F.get(F.array(*map(F.lit, graces)), F.pmod(F.col(key), F.lit(len(graces))).cast("int")).alias("grace"))
    rows = rows.select(key, "due", "grace", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1), F.col("grace"), F.col("grace") + 1)).alias("days"))
    day = F.date_add("due", F.col("days"))
    shown = F.when(which == 0, F.date_format(day, "yyyy-MM-dd")).when(which == 1, F.date_format(day, "MMMM dd, yyyy")).otherwise(F.date_format(day, "dd MMMM yyyy"))
    label = F.when(F.col("days") <= 0, 0).when(F.col("days") <= F.col("grace"), 1).otherwise(2)
    return rows.select(key, "grace", "days", label.alias("label"), shown.alias("received"))


def length_scores(prompts: list[str], counts: list[int]) -> list[list[float]]:
    """A batch scorer for tests."""
    return [[float(len(p) % (i + 2)) for i in range(n)] for p, n in zip(prompts, counts)]


def letter_counts(state: str) -> tuple[int, Counter]:
    """A state prepared for questions about its letters."""
    return len(state), Counter(state)


def share_logits(prepared: tuple[int, Counter], questions: list[str], counts: list[int]) -> list[list[float]]:
    """For each option of a question, how often it stands in the state for each of its letters."""
    size, found = prepared
    return [[found[k] / (1 + size) for k in q.split(" ")] for q in questions]
