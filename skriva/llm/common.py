"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, shared_path  # noqa: F401


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def placed(df: DataFrame) -> DataFrame:
    """df with its columns named by their places, so that names which are equal or differ by case only can't clash."""
    return df.toDF(*[f"__{k}" for k in range(len(df.columns))])


def at(df: DataFrame, name: str) -> str:
    """The name in placed(df) of the first column that is called exactly so."""
    return f"__{df.columns.index(name)}"


def restored(rows: DataFrame, df: DataFrame) -> DataFrame:
    """rows of placed(df) with the names of df."""
    return rows.select(*[F.col(f"__{k}").alias(c) for k, c in enumerate(df.columns)])


def exact(df: DataFrame, *names: str) -> DataFrame:
    """df with only these columns, each that of exactly this name."""
    return placed(df).select(*[F.col(at(df, c)).alias(c) for c in dict.fromkeys(names)])


def packed(df: DataFrame, **names: str) -> DataFrame:
    """df as the struct `row`, with some of its columns beside it under the names given; `row.*` gives df back, whatever its columns are called."""
    whole = F.struct(*[F.col(f"__{k}").alias(c) for k, c in enumerate(df.columns)])
    return placed(df).select(whole.alias("row"), *[F.col(at(df, c)).alias(n) for n, c in names.items()])


@contextmanager
def session_conf(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Settings of the session for the plans that are made within."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hash_order(col: Column) -> list[Column]:
    """Order by a pseudo-random but repeatable key; ties go by the column itself."""
    return [F.xxhash64(col), col]
