"""What several of the operators need: written tables, words, Arrow maps."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunestrata.session import shared_path
from tunestrata.sources import checkpoint

#: Bytes of one text that are looked at together.
BLOCK = 1 << 20
_SPACE = b" \t\n\r\x0b\x0c"


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application, by Spark's own means.

    The archive is made on the driver, and Spark sends it to every executor that runs a task.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Store a frame in the folder all executors share and go on from the stored rows."""
    return checkpoint(df, shared_path(df.sparkSession, label))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet."""
    while name.lower() in (c.lower() for c in df.columns):
        name = f"_{name}"
    return name


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_blocks(text: str, block: int = BLOCK) -> Iterator[list[bytes]]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as lists, one for each stretch of ``block`` bytes.

    ``bytes.split`` parts at exactly these six characters. A stretch ends at one of them, so no
    word is cut, and the words of a very long text never exist all at once.
    """
    data = text.encode()
    if len(data) <= block:
        yield data.split()
        return
    start = 0
    while start < len(data):
        end = start + block
        while end < len(data) and data[end : end + 1] not in _SPACE:
            end += 1
        yield data[start:end].split()
        start = end
