"""The state on disk: versioned directories of Parquet tables and one pointer.

Parquet tables have no MERGE or UPDATE, so a step reads one version and writes the
next; the pointer changes last and by a rename, so a reader sees a whole version or
the one before.  Nothing is written where the same plan reads.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

from memloom.sources import schema


def _fs(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


@dataclass
class State:
    """Frames by table name; tables that are missing count as empty where a schema is known."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    version: int = 0

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def changed(self, **tables: DataFrame) -> State:
        return State(self.tables | tables, self.version)


def current(spark: SparkSession, root: str) -> int:
    """Number of the version that the pointer names; 0 if there is none."""
    fs, pointer = _fs(spark, f"{root}/CURRENT")
    if not fs.exists(pointer):
        return 0
    return int(spark.read.text(f"{root}/CURRENT").first()[0])


def load(spark: SparkSession, root: str, version: int | None = None) -> State:
    n = current(spark, root) if version is None else version
    fs, folder = _fs(spark, f"{root}/v{n}")
    if not fs.exists(folder):
        return State({"memories": spark.createDataFrame([], schema.MEMORIES)}, 0)
    names = [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()]
    return State({name: spark.read.parquet(f"{root}/v{n}/{name}") for name in names}, n)


def save(state: State, spark: SparkSession, root: str, partition: dict[str, list[str]] | None = None) -> int:
    """Write the next version and let the pointer name it."""
    n = max(current(spark, root), state.version) + 1
    for name, df in state.tables.items():
        writer = df.write.mode("error")
        if partition and name in partition:
            writer = writer.partitionBy(*partition[name])
        writer.parquet(f"{root}/v{n}/{name}")
    fs, new = _fs(spark, f"{root}/CURRENT.{n}")
    out = fs.create(new, True)
    out.write(bytearray(str(n).encode()))
    out.close()
    _, old = _fs(spark, f"{root}/CURRENT")
    # One step replaces the pointer, so a reader sees the old version or the new one.
    jvm = spark.sparkContext._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(new, old, options)
    return n


def plain_unions(spark: SparkSession) -> None:
    """Let a union claim no partitioning.

    Spark 4.1 passes on the partitioning of a union's branches and drops a following
    repartition; adaptive execution then changes the branches one by one, and rows of one
    key end in different tasks.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Tables of a folder of Parquet files or directories."""
    plain_unions(spark)
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]
