"""Helpers shared by the document operators: stored steps and a distributed total order.

Steps lie in a folder of the application inside the shared one; ``session.remove_run`` removes them
when all results that rest on them are written.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import run_folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a step to the shared folder and read it back: lineage is cut, nothing is computed twice."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


_held: list[Any] = [None, None]


def worker_tables(key: Hashable = None, make: Callable[[], Any] = lambda: None) -> Any:
    """A worker's tables named ``key``, made once; it drops those of the operator before. No key: it keeps none.

    Workers live on from stage to stage, so what one operator keeps would add to what the next needs.
    """
    if _held[0] != key:
        _held[:] = None, None
        give_back()
        _held[:] = key, make()
    return _held[1]


def give_back() -> None:
    """Free memory of a worker goes back to the system, at the end of a task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def in_blocks(df: DataFrame, *order: Column | str) -> DataFrame:
    """Rows dealt by range of ``order`` with their ``block`` number, stored.

    Blocks follow the order, so a global running value is a per-block one plus the totals of
    the blocks before. Only narrow rows should come here. The sampled bounds are fixed by
    storing the rows, so every later read sees the same blocks.
    """
    return stored(df.repartitionByRange(*order).withColumn("block", F.spark_partition_id()), "blocks")


def before_blocks(totals: DataFrame, *sums: str) -> DataFrame:
    """Per block, the sums of all earlier blocks (``<name>_before``) and of all blocks (``<name>_all``).

    One row a block, so the single ordered window holds as many rows as there were partitions.
    """
    earlier = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy("block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return totals.select(
        "block",
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in sums],
        *[F.sum(c).over(every).alias(f"{c}_all") for c in sums],
    )
