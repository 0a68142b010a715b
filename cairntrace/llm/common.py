"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairntrace.session import shared_folder

#: A word is a longest run of characters other than ASCII white space.
WHITE = r"[\x20\x09-\x0D]+"

#: Stands for a null id inside joins and orders: smaller than every other id.
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: computed once, kept if executors are lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts_for(df: DataFrame, amount: Column, each: float, least: int = 12) -> int:
    """Number of partitions that hold about `each` of the summed amount."""
    total = df.agg(F.sum(amount)).first()[0] or 0
    return max(least, int(total / each) + 1)


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id's text leaves the remainder `fold`; a null id has the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == fold
