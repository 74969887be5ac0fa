"""What the operators of this subpackage share: lineage cuts, text normalisation, safe column names."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlsplit
from urllib.request import url2pathname

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapgauge.functions.lineage import cut, shared_dir

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a few numbers that make a file of a small table.
ROWS_A_FILE = 250_000
#: Hadoop's local file system starts a process (chmod) for each folder, file, file of checksums and mark of success, and
#: until that process has begun, the JVM's memory seems to be there twice. So only the files themselves are written; other
#: file systems heed the last line alone.
RAW = {
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
    "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stored(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The same rows, written as a table into the shared folder: like cut, but Spark knows the table's size, so joins with a
    small one need no shuffle. rows: a bound on their number, if one is known, so that few rows make few files."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    few = df if rows is None else df.coalesce(1 + rows // ROWS_A_FILE)
    if at.startswith("file:"):
        # the folders that Hadoop would make, as RAW says; an append takes them as they are
        os.makedirs(f"{url2pathname(urlsplit(at).path)}/_temporary/0/_temporary")
    few.write.mode("append").options(**RAW).parquet(at)
    done = spark.read.schema(df.schema).parquet(at)
    done.stored_at = at
    return done


def discard(*tables: DataFrame | None) -> None:
    """Deletes stored tables that nothing will read again."""
    for df in tables:
        at = getattr(df, "stored_at", None)
        if at:
            sc = df.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def text_of(name: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z only. Pure ASCII takes the faster built-in, which does the same there."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def n_words(text: Column) -> Column:
    """Number of words, as a long."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't use, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(names: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in names]
