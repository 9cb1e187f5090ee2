"""Two tables against each other in blocks: each block of one meets each block of the other in a cell of its own.

The rows of a cell are all that a task holds, whatever the sizes of the tables; what the cells return is merged behind.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows below which a block is not cut further for the sake of more cells.
LEAST_ROWS = 1024


def blocks(df: DataFrame, rows: int, most: int) -> int:
    """How many blocks: of `most` rows at most on average; more where cores would idle and blocks stay large enough."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-rows // most), min(cores, rows // LEAST_ROWS))


def dealt(df: DataFrame, key: Sequence[str], n: int, name: str) -> DataFrame:
    """df with the number of its rows' block: a hash of the key, so that rows that share only part of it are spread."""
    return df.withColumn(name, F.pmod(F.xxhash64(*key), F.lit(n)).cast("int"))


def meet(left: DataFrame, right: DataFrame, n_left: int, n_right: int, run: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    """run(left rows, right rows) of every cell: left holds its block in `l`, right in `r`.

    A row goes to as many cells as the other side has blocks, so bytes moved are left * n_right + right * n_left.
    """
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    a = left.select("*", every(n_right, "r")) if n_right > 1 else left.withColumn("r", F.lit(0))
    b = right.select("*", every(n_left, "l")) if n_left > 1 else right.withColumn("l", F.lit(0))
    return cogrouped(a, b, ["l", "r"], run, schema, n_left * n_right)


def cogrouped(a: DataFrame, b: DataFrame, key: list[str], run: Callable[[pa.Table, pa.Table], pa.Table], schema, cells: int | None = None) -> DataFrame:
    """run(rows of a, rows of b) of each key. Partitions are as many as shuffles have, or as cells where those are fewer:
    set by number, since a cell's work is far more than its bytes tell."""
    spark = a.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    n = min(n, cells) if cells else n
    a, b = (df.toDF(*df.columns) for df in (a, b))  # columns of their own, where one side comes from the other
    return a.repartition(n, *key).groupBy(*key).cogroup(b.repartition(n, *key).groupBy(*key)).applyInArrow(run, schema)
