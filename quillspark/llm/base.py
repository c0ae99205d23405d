"""What the operators share: reading tables, the shared folder, and sending this package's code to executors."""

from __future__ import annotations

import importlib
import os
import pkgutil
import re
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Whether Spark deletes a query's shuffle files at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship_by_value() -> None:
    """Pickle this package's functions by value, so that executors need no copy of the package on their path."""
    package = importlib.import_module(__package__)
    for module in pkgutil.iter_modules(package.__path__):
        cloudpickle.register_pickle_by_value(importlib.import_module(f"{__package__}.{module.name}"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_value(thing) -> bytes:
    """thing pickled by value, for a broadcast: executors need only ``pickle`` and pyspark to load it."""
    ship_by_value()
    return cloudpickle.dumps(thing)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it from clashing with a column's name."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only where that is unset and all runs in this process, as in tests, is a temporary folder made and remembered in the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder as Parquet and read it again: lineage is cut, and a lost executor costs no recomputation.

    What the write shuffled is deleted with its end, as nothing else reads it. The folder goes with :func:`drop_materialized`,
    or else when the driver's process ends.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"quillspark-{uuid.uuid4().hex}")
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(held)
    return spark.read.schema(df.schema).parquet(path)


def marks(ids: DataFrame, column: str, words: int = 1 << 18) -> DataFrame:
    """A bitmap of hashes of a column of longs, to be broadcast: rows (mark_word, mark_bits), at most ``words`` of 64 bits each."""
    h = F.xxhash64(F.col(column).cast("long"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    return ids.select(_word(h, words).alias("mark_word"), bit.alias("mark_bit")).groupBy("mark_word").agg(F.bit_or("mark_bit").alias("mark_bits"))


def _word(h: Column, words: int) -> Column:
    return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(words - 1))


def split_by_marks(df: DataFrame, column: str, ids: DataFrame, words: int = 1 << 18) -> tuple[DataFrame, DataFrame]:
    """df's rows whose long in ``column`` may be among ``ids`` (one column of longs), and those where it is not or null.

    Few more than the rows that are among them come first, so that a join with ids need not shuffle the rest. ids is read once
    for each part; with very many ids for ``words`` the first part grows, and stays right.
    """
    held = F.broadcast(marks(ids, ids.columns[0], words))
    h = F.xxhash64(F.col(f"`{column}`").cast("long"))
    own = df.select(F.struct("*").alias("row"), _word(h, words).alias("own_word"), h.bitwiseAND(F.lit(63)).cast("int").alias("own_bit"), F.col(f"`{column}`").isNotNull().alias("own_known"))
    joined = own.join(held, (F.col("own_word") == F.col("mark_word")) & F.col("own_known"), "left")
    may = F.coalesce(F.getbit("mark_bits", "own_bit") == 1, F.lit(False))
    return joined.filter(may).select("row.*"), joined.filter(~may).select("row.*")


def range_prefix(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """df in order of the columns ``order``, with running sums: name -> column that is summed up to and with the row.

    Rows are dealt out by sorted ranges and written with their range's number; sums over ranges, a row each, go through the
    driver, and each range adds up its own rows after what lies before it. Nulls in summed columns count as 0. Equal rows
    in all of ``order`` are summed in any order, so ``order`` should tell rows apart.
    """
    spark = df.sparkSession
    part, *before = fresh(df.columns + list(sums), "part", *[f"before_{k}" for k in range(len(sums))])
    ranged = materialize(df.repartitionByRange(shuffle_partitions(spark), *order).withColumn(part, F.spark_partition_id()))
    totals = ranged.groupBy(part).agg(*[F.sum(c).alias(b) for b, c in zip(before, sums.values(), strict=True)]).orderBy(part).collect()  # a row for each range
    held, at = [], [0] * len(sums)
    for row in totals:
        held.append((row[0], *at))
        at = [a + (x or 0) for a, x in zip(at, row[1:], strict=True)]
    kinds = [F.sum(c) for c in sums.values()]
    kinds = [f.dataType.simpleString() for f in ranged.agg(*kinds).schema]
    offsets = spark.createDataFrame(held, ", ".join([f"`{part}` int", *[f"`{b}` {k}" for b, k in zip(before, kinds, strict=True)]]))
    own = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({name: F.sum(F.coalesce(F.col(c), F.lit(0))).over(own) for name, c in sums.items()})
    return local.join(F.broadcast(offsets), part).withColumns({name: F.col(name) + F.col(b) for name, b in zip(sums, before, strict=True)}).drop(part, *before)


def drop_materialized(*frames: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for these frames; call it only when nothing reads them any more."""
    for df in frames:
        spark = df.sparkSession
        for name in {os.path.dirname(f) for f in df.inputFiles()}:
            if os.path.basename(name).startswith("quillspark-"):
                path = spark._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
