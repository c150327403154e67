"""What the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"
PIECE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z, all else as it is. `lower` does the same, and faster, where a text has only ASCII characters."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that `df` does not have yet, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def with_result(df: DataFrame, udf: Callable[[Column], Column], text: str = "text") -> tuple[DataFrame, str]:
    """`df` with the struct that `udf` makes of each whole text, under a name that clashes with no column."""
    name = free_name(df, "_result")
    return df.withColumn(name, udf(whole_text(text))), name


def word_lists(text: str | None, separators: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time, so that a very long text is never a list of all its words.

    `separators` maps each byte to what a word has in its place, or to a blank.
    """
    data = (text or "").encode("utf-8", "replace").translate(separators)
    start = 0
    while start < len(data):
        stop = start + PIECE_BYTES
        if stop < len(data):
            cut = data.rfind(b" ", start, stop)
            cut = cut if cut >= 0 else data.find(b" ", stop)
            stop = cut if cut >= 0 else len(data)
        if words := data[start:stop].split():
            yield words
        start = stop + 1


def give_back() -> None:
    """Returns to the system what a task has freed, before the worker waits for the next one."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        # Another C library keeps its own counsel.
        pass
