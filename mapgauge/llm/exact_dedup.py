"""Exact duplicates by a tree-merge of sorted digest runs, in DataFrame operations only.

Each input partition makes one run: its digests in order, one entry each. Many runs are first merged, several ways at once,
into ROOTS; these then meet in binomial rounds: in round r the runs whose numbers differ in bit r alone. Every merge is a
sorted aggregate on (run, digest), so an entry meets one other in a round however many copies its text has, and it keeps the
identifier that stays and the number of copies. Entries are taken for equal only if their lengths and a second, independent
digest agree too. What the root holds then goes down the same tree: no step gathers the copies of one text in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapgauge.llm.common import ascii_lower, discard, fresh, quoted, stored, text_of

#: Runs that binomial rounds begin with, at most.
ROOTS = 64
#: A text's identity: SHA-256 of the normalised text, verified at each merge by its length and an xxHash.
DIGEST = ("digest", "n_bytes", "check")


def _identity(text_col: str) -> list:
    norm = ascii_lower(text_of(text_col)).cast("binary")
    return [F.unhex(F.sha2(norm, 256)).alias("digest"), F.octet_length(norm).alias("n_bytes"), F.xxhash64(norm).alias("check")]


def _decide(rows: DataFrame, roots: int) -> DataFrame:
    """rows: run, DIGEST, tag (struct, its first field the identifier). Adds best (tag) and size, the number of copies."""
    level = stored(rows.groupBy("run", *DIGEST).agg(F.max("tag").alias("best"), F.count(F.lit(1)).alias("size")))
    runs = (level.agg(F.max("run")).first()[0] or 0) + 1
    levels, fans = [level], []
    while runs > 1:
        fan = 2 if runs <= roots else -(-runs // roots)
        up = level.withColumn("run", F.floor(F.col("run") / fan).cast("int"))
        level = stored(up.groupBy("run", *DIGEST).agg(F.max("best").alias("best"), F.sum("size").alias("size")))
        levels.append(level)
        fans.append(fan)
        runs = -(-runs // fan)
    top = levels.pop()
    for low, fan in zip(reversed(levels), reversed(fans), strict=True):
        up = top.withColumnRenamed("run", "up")
        found = low.select("run", *DIGEST, F.floor(F.col("run") / fan).cast("int").alias("up")).join(up, ["up", *DIGEST]).drop("up")
        was, top = top, stored(found)
        discard(was, low)
    return rows.join(top, ["run", *DIGEST])


def _tagged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row a document without its text, written once so that run and row number are data from here on."""
    others = F.xxhash64(*quoted(docs.columns))
    tag = F.struct(F.col(f"`{id_col}`").alias("id"), others.alias("others"), F.monotonically_increasing_id().alias("row"))
    return stored(docs.select(F.spark_partition_id().alias("run"), *_identity(text_col), tag.alias("tag")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", roots: int = ROOTS) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the largest identifier stays; a null
    identifier is smaller than any other; of rows that share it (repeated rows) exactly one stays, by a hash of the whole
    row and then by position. Null text is empty text. Empty tables give empty results; other columns are not read beyond
    that hash.
    """
    done = _decide(_tagged(docs, id_col, text_col), roots)
    return done.select(
        F.col("tag.id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("tag") == F.col("best")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", roots: int = ROOTS) -> DataFrame:
    """The rows of docs that stay, all columns. Rows equal in every column are told apart only by number: one is kept."""
    done = _decide(_tagged(docs, id_col, text_col), roots)
    row, key = fresh(docs, "row_key", "digest_key")
    stay = done.where("tag = best").select(F.col("tag.others").alias(row), F.col("digest").alias(key))
    # more rows of the table may be equal to a kept one in every column
    same = done.where("tag.others = best.others AND tag <> best").select(F.col("tag.others").alias(row), F.col("digest").alias(key)).distinct()
    marked = docs.withColumns({row: F.xxhash64(*quoted(docs.columns)), key: _identity(text_col)[0]})
    if same.isEmpty():
        return marked.join(stay, [row, key], "left_semi").drop(row, key)
    once = marked.join(stay.join(same, [row, key], "left_anti"), [row, key], "left_semi")
    many = marked.join(same, [row, key], "left_semi").dropDuplicates([row, key])
    return once.unionByName(many).drop(row, key)
