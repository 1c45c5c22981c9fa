"""Stored inputs: JSON lines, datasets, transcripts, binary payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def ndjson(spark: SparkSession, path: str, schema: StructType | str, malformed: str = "skip") -> DataFrame:
    """JSON lines: malformed ones are skipped, or fail the read (``fail``). A schema keeps it to one pass."""
    return spark.read.schema(schema).option("mode", {"skip": "DROPMALFORMED", "fail": "FAILFAST"}[malformed]).json(path)


def ndjson_all_or_nothing(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """All rows, or none if any line is malformed: the bad lines are counted, not collected."""
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    raw = spark.read.text(path)
    read = raw.select(F.from_json("value", kind.add("_bad", "string"), {"columnNameOfCorruptRecord": "_bad"}).alias("r"), "value").where("trim(value) <> ''")
    bad = read.where("r._bad is not null").limit(1).count()
    return read.select(*[f"r.{f.name}" for f in kind.fields if f.name != "_bad"]).where(F.lit(not bad))


def tail(df: DataFrame, order: str, limit: int = 50) -> DataFrame:
    """Last rows by order, in order."""
    return df.orderBy(F.desc(order)).limit(limit).orderBy(order)


def lookup(df: DataFrame, **key) -> DataFrame:
    for k, v in key.items():
        df = df.where(F.col(k) == v)
    return df.limit(1)


def listing(df: DataFrame, by: str, limit: int = 100, without: tuple[str, ...] = ()) -> DataFrame:
    return df.drop(*without).orderBy(F.desc(by)).limit(limit)


def kv_record(df: DataFrame) -> DataFrame:
    """Value as VARIANT where the content type says JSON."""
    return df.withColumn("json", F.when(F.lower("content_type").contains("application/json"), F.expr("try_parse_json(value)")))


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("payload"))


def sqlite_table(path: str, table: str):
    """A Python data source over a SQLite table: one partition for each range of rowids."""
    import sqlite3

    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Part(InputPartition):
        def __init__(self, lo, hi):
            self.lo, self.hi = lo, hi

    class Reader(DataSourceReader):
        def partitions(self):
            lo, hi = sqlite3.connect(path).execute(f'select coalesce(min(rowid), 0), coalesce(max(rowid), -1) from "{table}"').fetchone()
            step = max(1, -(-(hi - lo + 1) // 8))
            return [Part(a, min(hi, a + step - 1)) for a in range(lo, hi + 1, step)] or [Part(0, -1)]

        def read(self, part):
            yield from sqlite3.connect(path).execute(f'select * from "{table}" where rowid between ? and ?', (part.lo, part.hi))

    kinds = {"INTEGER": "bigint", "REAL": "double", "BLOB": "binary"}

    class SqliteSource(DataSource):
        @classmethod
        def name(cls):
            return f"sqlite_{table}"

        def schema(self):
            return ", ".join(f"`{r[1]}` {kinds.get(r[2].upper(), 'string')}" for r in sqlite3.connect(path).execute(f'pragma table_info("{table}")'))

        def reader(self, schema):
            return Reader()

    return SqliteSource
