"""Rows of foreign layouts as examples and answers."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

PAIR = r"'([^']*)': '([^']*)'"


def map_pairs(literal: Column) -> Column:
    """Pairs of a single-quoted map literal; null where they don't make up the whole literal again."""
    keys, values = (F.regexp_extract_all(literal, F.lit(PAIR), F.lit(i)) for i in (1, 2))
    pairs = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    again = F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(F.lit("'"), p["key"], F.lit("': '"), p["value"], F.lit("'"))), ", "), F.lit("}"))
    return F.when(again == literal, pairs)


def first_exchange(log: Column) -> Column:
    """The first user text and the first assistant text of a log with a line for each turn."""
    said = lambda who: F.trim(F.regexp_extract(log, rf"(?s)(?:^|\n){who}: (.*?)(?:\n(?:user|assistant|system): |$)", 1))
    return F.struct(said("user").alias("user"), said("assistant").alias("assistant"))


def described(key: Column, description: Column) -> Column:
    """A missing description is the key."""
    return F.coalesce(F.nullif(F.trim(description), F.lit("")), key)


def foreign_question(kind: Column, instructions: Column, yes: Column, no: Column) -> Column:
    """Instructions of a foreign question; what yes and no mean is said after those of a yes/no question that has both."""
    both = F.concat(instructions, F.lit("\nyes: "), yes, F.lit("\nno: "), no)
    return F.when(kind == "noul", F.coalesce(both, instructions)).otherwise(instructions)


def foreign_target(kind: Column, keys: Column, label: Column) -> Column:
    """All mass on the label: a choice's key, a score's level as a number, or true and false as yes and no."""
    chosen = F.transform(keys, lambda k: (k == label).cast("double"))
    level = F.transform(F.sequence(F.lit(0), F.size(keys) - 1), lambda i: (i == label.try_cast("int")).cast("double"))
    yes = (F.lower(label) == "true").cast("double")
    return F.when(kind == "choice", chosen).when(kind == "score", level).otherwise(F.array(1 - yes, yes))


def answer_distribution(answer: Column, keys: list[str]) -> Column:
    """A JSON answer's probabilities in the order of the keys: from `probabilities`, else all on `choice`."""
    probability = lambda k: F.coalesce(F.get_json_object(answer, f"$.probabilities.{k}").cast("double"), F.when(F.get_json_object(answer, "$.choice") == k, 1.0).otherwise(0.0))
    return F.array(*(probability(k) for k in keys))


# How an assistant says that it can't.
REFUSAL = r"(?i)(don't|do not) have (the )?(capability|function|ability)|only (have|allows|function)|cannot (assist|help|perform)"


@F.pandas_udf(ArrayType(StringType()))
def tool_names(system: pd.Series) -> pd.Series:
    """Names of the JSON objects that stand one after another in a text; null where they aren't such objects."""
    read = json.JSONDecoder().raw_decode

    def names(text):
        at, out = text.find("{") if text else -1, []
        if at < 0:
            return None
        try:
            while at < len(text):
                tool, at = read(text, at)
                out.append(tool["name"])
                while at < len(text) and text[at].isspace():
                    at += 1
        except (ValueError, KeyError, TypeError):
            return None
        return out if all(isinstance(x, str) for x in out) else None

    return system.map(names)


@F.pandas_udf(StructType().add("name", StringType()).add("arguments", StringType()))
def call_literals(said: pd.Series) -> pd.DataFrame:
    """The name and arguments (JSON, or the text that stands there) of a call that is written as a literal of strings
    in either quotes, numbers, lists and maps; nulls for a torn one or other than a map with a name."""

    def call(text):
        try:
            made = ast.literal_eval(text.strip())
            arguments = made.get("arguments")
            as_text = arguments if arguments is None or isinstance(arguments, str) else json.dumps(arguments, ensure_ascii=False)
            return (made["name"], as_text) if isinstance(made["name"], str) else (None, None)
        except (ValueError, SyntaxError, KeyError, TypeError, AttributeError, RecursionError, MemoryError):
            return None, None

    return pd.DataFrame([call(t) for t in said], columns=["name", "arguments"])


CALL, ENDS = "<functioncall>", r"<\|endoftext\|>|\n\n"


def first_turns(chat: Column) -> tuple[Column, Column]:
    """What the first user turn asks, and what stands from there to the end of the assistant's answer: null where
    either isn't there or the answer has no end."""
    at = F.instr(chat, "USER:")
    turns = F.split(F.substring(chat, at + 5, F.length(chat)), r"\n+ASSISTANT:", 2)
    answer = F.split(F.regexp_replace(F.get(turns, F.lit(1)), r"^\s+", ""), ENDS, 2)
    whole = (at > 0) & (F.size(turns) == 2) & (F.size(answer) == 2)
    return F.when(whole, F.regexp_replace(F.get(turns, F.lit(0)), r"^\s+", "")), F.when(whole, F.get(answer, F.lit(0)))


def tool_calls(df: DataFrame, chat: str, system: str, longest: int = 1800) -> DataFrame:
    """Rows with the first request (user), the tools on offer (tools), the tool called (called; null: none fits) and its
    arguments.

    Left out are rows without such a pair, of repeated or unreadable tools, of a call that is torn or to a tool that
    isn't there, of an answer that neither calls nor declines, and of requests longer than `longest`.
    """
    user, said = first_turns(F.col(chat))
    parts = df.withColumns({"user": user, "_said": said}).where("_said IS NOT NULL").where(F.length("user") <= longest)
    parts = parts.withColumn("tools", tool_names(system)).where("tools IS NOT NULL AND size(array_distinct(tools)) = size(tools)")
    calls = F.startswith("_said", F.lit(CALL))
    parts = parts.withColumn("_call", call_literals(F.when(calls, F.substring("_said", len(CALL) + 1, 1 << 30)).otherwise("")))
    parts = parts.withColumns({"user": F.trim("user"), "called": F.when(calls, F.col("_call.name")), "arguments": F.when(calls, F.col("_call.arguments"))})
    fine = F.when(calls, F.array_contains("tools", F.col("called"))).otherwise(F.col("_said").rlike(REFUSAL))
    return parts.where(F.coalesce(fine, F.lit(False))).drop("_said", "_call")
