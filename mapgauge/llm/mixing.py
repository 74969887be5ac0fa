"""Mixing of sources to target weights by capped water-filling.

Targets: sources share a total by weight; whatever exceeds `max_epochs` times a source's size is clamped there and its
excess goes to the others in proportion to their weights, until none is above. That fixed point is min(cap, level * weight)
for one level, found in one pass over the sources in order of cap / weight.

Sampling: a source's target in words is so many whole passes over it and one fractional pass. The fractional pass takes its
documents in a seeded random order until the words are spent; the last of them is taken in part (its first words). The
order of a source of n documents is cut into about sqrt(n) buckets, so a source with a third of all rows is many small
windows, and one small window over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapgauge.llm.common import cut, fresh, n_words, stored, text_of

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = 17
CHUNK = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def _order(id_col: str, size: Column, seed: int) -> Column:
    """A document's place in the seeded order: the MD5 of seed, identifier and size."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), size.cast("string")).cast("binary"))


def _bucket(order: Column, buckets: Column) -> Column:
    """Buckets follow the order: leading 32 bits, scaled."""
    return F.floor(F.conv(F.substring(order, 1, 8), 16, 10).cast("long") * buckets / F.lit(2**32)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """sources: source, source_size, docs. Adds weight and target. One row a source; the windows run over sources only."""
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    picked = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("weight", picked).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    filled = capped.withColumns(
        {
            "all_words": F.sum("source_size").over(everything).cast("double"),
            "below": F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "open": F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    level = (F.col("all_words") - F.col("below")) / F.col("open")
    # levels only rise until the first feasible one; that is the lowest cap / weight at which it holds
    first = F.min(F.when(level <= F.col("cap") / F.col("weight"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("rank").alias("r"), level.alias("v")))).over(everything)
    return filled.withColumn("level", F.coalesce(first["v"], F.max(F.col("cap") / F.col("weight")).over(everything))).select("source", "source_size", "docs", "weight", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def _plan(light: DataFrame, weights, max_epochs) -> tuple[DataFrame, DataFrame]:
    """light: source, size, place. Returns a row a source, and a row a source and bucket with the words before it."""
    sources = light.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    sources = targets(sources, weights, max_epochs)
    whole = F.round("target").cast("long")
    sources = sources.withColumn("buckets", F.ceil(F.sqrt("docs"))).withColumns(
        {
            "passes": F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long"),
            "quota": F.when(F.col("source_size") > 0, whole % F.col("source_size")).otherwise(F.lit(0)).cast("long"),
        }
    )
    sources = cut(sources)
    known = sources.select(F.col("source").alias("s_source"), "buckets")
    sums = light.join(known, light["source"].eqNullSafe(F.col("s_source"))).groupBy("source", _bucket(F.col("place"), F.col("buckets")).alias("bucket")).agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sources, cut(sums.select("source", "bucket", before.alias("before")))


def _taken(rows: DataFrame, sources: DataFrame, buckets: DataFrame, ties: list[str]) -> DataFrame:
    """rows: source, size, place, ... . Adds source_size, target, passes, extra (words of the fractional pass), taken."""
    s = sources.select(F.col("source").alias("s_source"), "source_size", "target", "buckets", "passes", "quota")
    b = buckets.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), "before")
    rows = rows.join(s, rows["source"].eqNullSafe(F.col("s_source"))).withColumn("bucket", _bucket(F.col("place"), F.col("buckets")))
    rows = rows.join(b, rows["source"].eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    within = Window.partitionBy("source", "bucket").orderBy("place", *ties).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    rows = rows.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - start)).cast("long"))
    return rows.withColumn("taken", F.col("passes") * F.col("size") + F.col("extra"))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, max_epochs=MAX_EPOCHS, seed=SEED) -> DataFrame:
    """A row a document: id, size, source_size, target, taken, and passes and extra that make up taken.

    Size is the number of words (null text: 0). Sources in code point order, null last, take the weights in turn. The words
    taken of a source add up to its target, rounded; no document is taken more than max_epochs times. Rows with equal
    identifier and size are interchangeable. Sources without words have target 0. Other columns are ignored.
    """
    size = n_words(text_of(text_col))
    light = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), size.alias("size"))
    light = cut(light.withColumn("place", _order("id", F.col("size"), seed)))
    sources, buckets = _plan(light, weights, max_epochs)
    done = _taken(light, sources, buckets, ["id", "size"])
    return done.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "passes", "extra")


def sample_mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, max_epochs=MAX_EPOCHS, seed=SEED) -> DataFrame:
    """The mix itself: each row of docs as many times as it is taken, its last copy with the first words only where the
    fractional pass ends inside it. Columns as in docs; n_chars, if there, follows a shortened text. What is taken is decided
    on rows without texts; documents are moved once. Texts without words are repeated with each whole pass over their source."""
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    row, taken = fresh(docs, "row_key", "taken_as")
    marked = docs.withColumn(row, F.xxhash64(doc))
    light = marked.select(F.col(row).alias("tie"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), n_words(text_of(text_col)).alias("size"))
    light = stored(light.withColumn("place", _order("id", F.col("size"), seed)))
    sources, buckets = _plan(light, weights, max_epochs)
    done = _taken(light, sources, buckets, ["id", "size", "tie"])
    # rows that are equal in every column are interchangeable: their whole copies add up, and one of them at most is cut
    part = (F.col("extra") > 0) & (F.col("extra") < F.col("size"))
    whole = F.col("passes") + F.when((F.col("extra") > 0) & ~part, 1).otherwise(0)
    wanted = done.groupBy("tie").agg(F.sum(whole).cast("int").alias("whole"), F.max(F.when(part, F.col("extra"))).cast("int").alias("part"), F.count(F.lit(1)).alias("n"))
    wanted = stored(wanted.where("whole > 0 OR part IS NOT NULL").select(F.col("tie").alias(row), F.struct("whole", "part", "n").alias(taken)))
    chosen = marked.join(wanted, row)
    if not wanted.where(F.col(f"{taken}.n") > 1).isEmpty():
        chosen = chosen.where(F.col(f"{taken}.n") == 1).unionByName(chosen.where(F.col(f"{taken}.n") > 1).dropDuplicates([row]))
    text = F.col(f"`{text_col}`")
    cut_text = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0)), 1, F.col(f"{taken}.part")), "")
    copies = F.concat(F.array_repeat(text, F.col(f"{taken}.whole")), F.when(F.col(f"{taken}.part").isNotNull(), F.array(cut_text)).otherwise(F.array().cast("array<string>")))
    (copy,) = fresh(chosen, "copy")
    out = chosen.withColumn(copy, F.explode(copies))
    kept = {c: F.col(f"`{c}`") for c in docs.columns} | {text_col: F.col(copy)}
    if "n_chars" in kept:
        kept["n_chars"] = F.when(F.col(copy) == text, F.col("n_chars")).otherwise(F.length(copy).cast(docs.schema["n_chars"].dataType))
    return out.select(*[v.alias(c) for c, v in kept.items()])
