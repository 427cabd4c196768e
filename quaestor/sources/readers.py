"""Sources beside Parquet: JSON lines, JSON arrays, nested JSON, CSV and members of ZIP files; and resumable results."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import seeded


def json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """Blank lines are passed over; compressed files are read as they are."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def json_array(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def nested_json(spark: SparkSession, glob: str, schema, *lists: str) -> DataFrame:
    """Files of JSON arrays by a pattern, their nested lists exploded in turn, with each element's place."""
    rows = spark.read.option("multiLine", True).schema(schema).json(glob)
    for path in lists:
        name = path.split(".")[-1]
        rows = rows.select("*", F.posexplode(path).alias(f"{name}_at", f"{name}_one"))
    return rows


def csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.options(header=True, quote='"', escape='"', multiLine=True)
    return (reader.schema(schema) if schema else reader).csv(path)


def zip_members(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """path, member, content (text) of the members with that suffix."""

    def run(batches):
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for member in sorted(m for m in z.namelist() if m.endswith(suffix)):
                        yield pd.DataFrame({"path": [name], "member": [member], "content": [z.read(member).decode("utf-8")]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, member string, content string")


def bounded(df: DataFrame, n: int, seed, *keys: str) -> DataFrame:
    """The n first rows in hashed order."""
    return df.orderBy(seeded(seed, *keys), *keys).limit(n)


def pending(planned: DataFrame, results: DataFrame, key: str, done=None) -> DataFrame:
    """Planned rows without a finished result; results may be appended to and asked for again."""
    finished = results if done is None else results.where(done)
    return planned.join(finished.select(key).distinct(), key, "left_anti")
