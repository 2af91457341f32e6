"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import shutil
import tempfile

import proofcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofcast.session import fresh_folder


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once for each application.

    The archive lies with the driver, which serves it to the executors as it does
    any file of addPyFile; no executor looks for it on a disk of its own.
    """
    context = spark.sparkContext
    if getattr(context, "_proofcast_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(proofcast.__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="proofcast-code-"), "proofcast_code")
    context.addPyFile(shutil.make_archive(archive, "zip", root, "proofcast"))
    context._proofcast_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a frame below the shared folder and read it back.

    Lineage ends here: a lost executor costs a read of this table, not the work
    above it. Column types survive, partitioning does not, so a join above a cut
    has an exchange of its own on either side and adaptive execution may split
    its hot keys.
    """
    path = fresh_folder(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from."""
    return remainder(doc_id) == 2
