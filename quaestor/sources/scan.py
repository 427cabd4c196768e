"""A scan that stops early: files in hashed order, in growing groups, until every class has its quota."""

from __future__ import annotations

from collections import Counter
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def files_of(spark: SparkSession, path: str) -> list[str]:
    """Names of the files under a path, relative to it, without opening them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    top, found, walk = fs.makeQualified(place).toString().rstrip("/"), [], fs.listFiles(place, True)
    while walk.hasNext():
        name = walk.next().getPath().toString().removeprefix(top + "/")
        if not any(part.startswith(("_", ".")) for part in name.split("/")):
            found.append(name)
    return found


class QuotaScan:
    """The first `quota` rows of each class, in the order of hashed file names and then of places inside files.

    `name` says what of a file's relative name is hashed; files of one name follow each other by their whole names.
    Files are read in groups of 1, 2, 4 ... until all classes are full, so what lies behind isn't opened. A file's
    counts by class pass through the driver. Each of the final windows is one class of one file. `files` are those
    that were read, in order.
    """

    def __init__(self, spark: SparkSession, path: str, schema, cls: str, quotas: dict[str, int], seed, keep: Column | None = None, name=lambda f: f):
        self.path, self.schema, self.cls, self.quotas = path.rstrip("/"), schema, cls, quotas
        self.spark, self.keep = spark, F.lit(True) if keep is None else keep
        order = sorted(files_of(spark, path), key=lambda f: (sha256(f"{seed}|{name(f)}".encode()).hexdigest(), f))
        counts: Counter = Counter()
        self.files: list[str] = []
        self.wanted: list[tuple[str, str, int]] = []  # file, class, rows to take
        step = 1
        while len(self.files) < len(order) and any(counts[c] < n for c, n in quotas.items()):
            group = order[len(self.files) : len(self.files) + step]
            found = {(r["_file"], r[cls]): r["n"] for r in self._read(group).groupBy("_file", cls).agg(F.count("*").alias("n")).collect()}
            for f in group:
                for c, quota in quotas.items():
                    if take := min(found.get((f, c), 0), quota - counts[c]):
                        self.wanted.append((f, c, take))
                        counts[c] += take
            self.files += group
            step *= 2

    def _read(self, files: list[str]) -> DataFrame:
        """Rows that count, with the file and the place inside it."""
        rows = self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in files))
        depth = 1 + max(f.count("/") for f in files)  # as many last parts of a path tell files apart
        tail = lambda parts: F.array_join(F.slice(parts, -depth, depth), "/")
        known = F.create_map(*(F.lit(x) for f in files for x in ("/".join(f"{self.path}/{f}".split("/")[-depth:]), f)))
        name = tail(F.split(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), "/"))
        rows = rows.select("*", known[name].alias("_file"), F.col("_metadata.row_index").alias("_row"))
        return rows.where(self.keep & F.col(self.cls).isin(*self.quotas))

    def rows(self) -> DataFrame:
        """The chosen rows with their file's number (`file_no`, from 0) in the order."""
        if not self.wanted:
            return self.spark.createDataFrame([], self.schema).withColumn("file_no", F.lit(0))
        number = {f: i for i, f in enumerate(self.files)}
        wanted = self.spark.createDataFrame([(f, c, n, number[f]) for f, c, n in self.wanted], f"_file string, {self.cls} string, _take long, file_no int")
        needed = sorted({f for f, _, _ in self.wanted}, key=number.get)
        place = F.row_number().over(Window.partitionBy("_file", self.cls).orderBy("_row"))
        rows = self._read(needed).join(F.broadcast(wanted), ["_file", self.cls]).withColumn("_place", place)
        return rows.where(F.col("_place") <= F.col("_take")).drop("_file", "_row", "_take", "_place")
