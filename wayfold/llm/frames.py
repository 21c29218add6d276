"""Small helpers that the operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.session import saved, shared_folder

__all__ = ["WORD", "let_go", "lower_ascii", "partitions", "remainder", "saved", "shared_folder", "text_batches", "words"]

#: A word: a run of anything but blanks, tabs and line ends (fixed value of the contracts).
WORD = r"[^\x20\x09-\x0D]+"


def text_batches(frame: DataFrame, rows: int = 1000) -> DataFrame:
    """The frame, as it is; operators on texts call this so that their session hands texts to Python workers in batches of at most so many rows.

    The setting stays for the session: Spark reads it when a query runs, after the operator has returned.
    """
    conf, name = frame.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= rows:
        conf.set(name, rows)
    return frame


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The words of a text as an array; null counts as empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0)


def remainder(id_col: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo a number."""
    return F.crc32(id_col.cast("string").cast("binary")) % mod


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def let_go() -> None:
    """Give freed memory back to the system at a task's end; Python workers outlive it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not with every C library
        ctypes.CDLL(None).malloc_trim(0)
