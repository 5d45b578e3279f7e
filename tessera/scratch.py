"""Tables that cut the lineage of iterative queries, in the folder that the cluster shares. Only a session on one machine may go without one."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Tables:
    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            base = "file://" + tempfile.mkdtemp(prefix="tessera-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.root = f"{base.rstrip('/')}/tessera-{label}-{uuid.uuid4().hex}"
        self.n = 0
        self.schemas: dict = {}

    def keep(self, df: DataFrame) -> DataFrame:
        """Write df and return it read back: lost executors cost a task, not the loop."""
        self.n += 1
        path = f"{self.root}/{self.n:05d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.kept_at = path
        return out

    def append(self, name: str, df: DataFrame, turn: int) -> DataFrame:
        """Add df to the table `name` as the part of one round; the whole table is returned, one scan whatever the number of rounds."""
        df.write.mode("append").parquet(f"{self.root}/{name}/turn={turn}")
        self.schemas[name] = df.schema
        return self.appended(name)

    def appended(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.root}/{name}").select(*self.schemas[name].names)

    def part(self, name: str, turn: int) -> DataFrame:
        """What append() added in one round."""
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.root}/{name}/turn={turn}")

    def by_predicate(self, facts: DataFrame) -> DataFrame:
        """Facts (p, a) written once, a folder for each predicate, so that a scan for one predicate reads its rows only."""
        self.n += 1
        path = f"{self.root}/{self.n:05d}"
        facts.select("p", "a").write.partitionBy("p").parquet(path)
        return self.spark.read.schema("a array<int>, p int").parquet(path).select("p", "a")

    def drop(self, df: DataFrame) -> None:
        if path := getattr(df, "kept_at", None):
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
