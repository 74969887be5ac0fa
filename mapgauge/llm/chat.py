"""Chat formatting: collapses cumulative snapshots of one conversation and renders what remains, in DataFrame operations only.

A logged conversation that is a prefix of a longer one is found by rolling hashes: after each turn, the XOR of the hashes of
(position, role, text) so far. Turns are ordered by one range partitioning over (conversation, turn), so a conversation of
any length is spread over tasks; counts and hashes of earlier partitions are carried over by a window of one row a
partition and conversation. Of a prefix hash, more occurrences than conversations that end there mean that one goes on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapgauge.llm.common import cut, table

TURNS_PER_PART = 256


def _carried(rows: DataFrame, agg: dict, zero: dict) -> DataFrame:
    """For each conversation and partition, aggregates over its earlier partitions."""
    per = rows.groupBy("conv", "pid").agg(*[f.alias(k) for k, f in agg.items()])
    before = Window.partitionBy("conv").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    over = {k: F.coalesce((F.sum(k) if k == "n" else F.bit_xor(k)).over(before), F.lit(zero[k])) for k in agg}
    return per.select(F.col("conv").alias("c_conv"), F.col("pid").alias("c_pid"), *[v.alias(f"c_{k}") for k, v in over.items()])


def _with(rows: DataFrame, carried: DataFrame) -> DataFrame:
    return rows.join(carried, rows["conv"].eqNullSafe(F.col("c_conv")) & (rows["pid"] == F.col("c_pid"))).drop("c_conv", "c_pid")


def prefix_hashes(turns: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """Every turn: conv, pos (from 1), role, text, h1, h2 (of the turn) and p1, p2 (of the prefix that it ends)."""
    col = lambda c: F.col(f"`{c}`")
    rows = turns.select(
        col(conv_col).alias("conv"), col(turn_col).alias("turn"),
        F.coalesce(col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    order = ["turn", "role", "text"]
    rows = cut(rows.repartitionByRange("conv", *order).withColumn("pid", F.spark_partition_id()))
    within = Window.partitionBy("conv", "pid").orderBy(*order)
    rows = rows.withColumn("rn", F.row_number().over(within))
    rows = _with(rows, _carried(rows, {"n": F.count(F.lit(1))}, {"n": 0})).withColumn("pos", F.col("rn").cast("long") + F.col("c_n"))
    rows = rows.withColumns({"h1": F.xxhash64("pos", "role", "text"), "h2": F.xxhash64(F.lit(29), "text", "role", "pos")}).drop("rn", "c_n")
    rows = cut(rows)
    sofar = Window.partitionBy("conv", "pid").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({"l1": F.bit_xor("h1").over(sofar), "l2": F.bit_xor("h2").over(sofar)})
    done = _with(local, _carried(rows, {"x1": F.bit_xor("h1"), "x2": F.bit_xor("h2")}, {"x1": 0, "x2": 0}))
    done = done.withColumns({"p1": F.col("l1").bitwiseXOR(F.col("c_x1")), "p2": F.col("l2").bitwiseXOR(F.col("c_x2"))})
    return done.select("conv", "pos", "role", "text", "h1", "h2", "p1", "p2")


def maximal_conversations(hashed: DataFrame) -> DataFrame:
    """conv, copies: of equal conversations the one with the smallest identifier, of prefixes of longer ones none."""
    ends = hashed.groupBy("conv").agg(F.count(F.lit(1)).alias("pos"), F.bit_xor("h1").alias("p1"), F.bit_xor("h2").alias("p2"))
    ends = ends.groupBy("pos", "p1", "p2").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("copies"))
    passes = hashed.groupBy("pos", "p1", "p2").agg(F.count(F.lit(1)).alias("seen"))
    longer = ends.join(passes, ["pos", "p1", "p2"]).where("seen > copies").select("pos", "p1", "p2")
    return ends.join(longer, ["pos", "p1", "p2"], "left_anti").select("conv", "copies")


def escaped(text):
    """Text in which <| can't occur, so no turn can look like the end of itself: <| becomes <\\|, and <\\ becomes <\\\\."""
    return F.replace(F.replace(text, F.lit("<\\"), F.lit("<\\\\")), F.lit("<|"), F.lit("<\\|"))


def format_chats(turns: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", turns_per_part=TURNS_PER_PART) -> DataFrame:
    """Renders maximal conversations: conv_id, part, turns, copies, rendered.

    Turns are ordered by turn (null first), then role, then text; null role and text are empty. Rows without conversation
    identifier are one conversation. A conversation of more than turns_per_part turns comes in parts, which concatenate to
    its text. Role and text are escaped, so a rendering can be parsed back. An empty table gives no rows; other columns are ignored.
    """
    hashed = cut(prefix_hashes(turns, conv_col, turn_col, role_col, text_col))
    keep = maximal_conversations(hashed).select(F.col("conv").alias("k_conv"), "copies")
    part = F.floor((F.col("pos") - 1) / turns_per_part).cast("long")
    said = F.concat(F.lit("<|im_start|>"), escaped(F.col("role")), F.lit("\n"), escaped(F.col("text")), F.lit("<|im_end|>\n"))
    rows = hashed.join(keep, hashed["conv"].eqNullSafe(F.col("k_conv")))
    parts = rows.groupBy("conv", part.alias("part"), "copies").agg(F.count(F.lit(1)).alias("turns"), F.array_sort(F.collect_list(F.struct("pos", said.alias("said")))).alias("all"))
    return parts.select(F.col("conv").alias(conv_col), "part", "turns", "copies", F.array_join(F.col("all.said"), "").alias("rendered"))


def op7_chat(spark, sf_dir):
    return format_chats(table(spark, sf_dir, "conversations"))


def _escaped_sql(column: str) -> str:
    return f"replace(replace({column}, '<' || chr(92), '<' || chr(92) || chr(92)), '<|', '<' || chr(92) || '|')"


ORACLE = f"""
    WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations),
    s AS (SELECT conv_id, string_agg(md5(role || chr(1) || text), '' ORDER BY pos) AS s FROM t GROUP BY conv_id),
    e AS (SELECT s, min(conv_id) AS conv_id, count(*) AS copies FROM s GROUP BY s),
    k AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM e b WHERE left(b.s, 32) = left(e.s, 32) AND length(b.s) > length(e.s) AND starts_with(b.s, e.s)))
    SELECT k.conv_id, CAST((pos - 1) // {TURNS_PER_PART} AS BIGINT) AS part, count(*) AS turns, k.copies,
        string_agg('<|im_start|>' || {_escaped_sql("role")} || chr(10) || {_escaped_sql("text")} || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
    FROM t JOIN k ON t.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY ALL"""
