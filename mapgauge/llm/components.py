"""Connected components, and candidate pairs from buckets without emitting all pairs of a bucket at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapgauge.llm.common import discard, stored

#: Nodes of one key that are compared with one another in one place.
BLOCK = 1000
#: So many of its keys each node takes along, so that a pair that meets in several is found in one of them.
LOWEST = 16


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. node, comp for every node of an edge; comp is the smallest node it is connected with.

    Each round points every node at the smallest of itself and its neighbours, follows the pointers to their roots by
    doubling, and contracts the edges; the nodes left at least halve. All steps are joins and aggregates over edges.
    """
    both = edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.distinct())
    # no table below has more rows
    n = both.count()
    labels = None
    while True:
        to = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), n)
        while True:
            up = to.select(F.col("a").alias("p"), F.col("p").alias("q"))
            was, to = to, stored(to.join(up, "p").select("a", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")), n)
            discard(was)
            if to.where("moved").isEmpty():
                break
        to, found = to.select("a", "p"), to
        was_labels, was_both = labels, both
        if labels is None:
            labels = stored(to.select(F.col("a").alias("node"), F.col("p").alias("comp")), n)
        else:
            labels = stored(labels.join(to, F.col("comp") == F.col("a"), "left").select("node", F.coalesce("p", "comp").alias("comp")), n)
        one = both.join(to, "a").select("b", F.col("p").alias("ra"))
        both = stored(one.join(to.withColumnRenamed("a", "b"), "b").where("ra <> p").select(F.col("ra").alias("a"), F.col("p").alias("b")).distinct(), n)
        discard(was_labels, was_both, found)
        if both.isEmpty():
            discard(both)
            return labels


def labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """members (key, node, ...) with comp: the node's component so far, or itself."""
    if labels is None:
        return members.withColumn("comp", F.col("node"))
    known = labels.select(F.col("node").alias("l_node"), F.col("comp").alias("l_comp"))
    return members.join(known, F.col("node") == F.col("l_node"), "left").withColumn("comp", F.coalesce("l_comp", "node")).drop("l_node", "l_comp")


def _several(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The members of keys that still join different components, with comp."""
    now = labelled(members, labels)
    keys = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    return now.join(keys, "key")


def _star(open_: DataFrame, turn: int, band: DataFrame | None = None) -> DataFrame:
    """One pair for each node at most: with the representative, of another component, that it shares the most keys with.

    In even turns a key's representative is the node that shares the most with others: copies of one text that differ from
    one another by more than they may are still close to that text, and it holds what they have in common. Odd turns draw. A
    key with a weight counts as so many keys. band (node, band): each band of a key has a representative of its own.
    """
    by = ["key"]
    if band is not None:
        open_, by = open_.join(band, "node"), ["key", "band"]
    weight = F.col("weight") if "weight" in open_.columns else F.lit(1)
    if turn % 2:
        order = F.xxhash64(F.lit(turn), "node")
    else:
        sizes = open_.groupBy(*by).agg(F.count(F.lit(1)).alias("size"))
        central = stored(open_.drop("comp").join(sizes, by).groupBy("node").agg((-F.sum(F.col("size") * weight)).alias("order")))
        open_, order = open_.join(central, "node"), F.col("order")
    first = F.min(F.struct(order.alias("o"), "node", "comp"))
    reps = open_.groupBy(*by).agg(first.alias("r")).select(*by, F.col("r.node").alias("rep"), F.col("r.comp").alias("r_comp"))
    met = open_.join(reps, by).where("comp <> r_comp").groupBy("node", "rep").agg(F.sum(weight).alias("shared"))
    best = met.groupBy("node").agg(F.max(F.struct("shared", "rep")).alias("best"))
    return best.select(F.least("node", "best.rep").alias("a"), F.greatest("node", "best.rep").alias("b"), "best.shared")


def _rarest(open_: DataFrame, slack: DataFrame) -> DataFrame:
    """open_ without each node's `slack` most frequent keys.

    All nodes order keys alike, by frequency and key. Two linked nodes share more keys than either may drop, and of those the
    rarest is dropped by neither: it would be among a node's `slack` last only if all shared keys were.
    """
    sizes = open_.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    ranked = open_.join(sizes, "key").withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("size"), "key")))
    return ranked.join(slack, "node").where(F.col("rank") > F.col("slack")).select("key", "node", "comp")


def _once(open_: DataFrame) -> DataFrame:
    """open_ with one key of all that have the same nodes, and none that has a single node.

    Nodes that share many keys, as near copies do, would meet again in each of them. Sets of nodes are told apart by their
    number and 128 bits of hashes; a key's nodes are distinct. weight: how many keys the one stands for.
    """
    sets = open_.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")).where("n > 1")
    return open_.join(sets.groupBy("n", "x", "y").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("weight")).select("key", "weight"), "key")


def _meetings(open_: DataFrame, facts: DataFrame, near: Callable[[str, str], Column]) -> DataFrame:
    """Pairs of nodes of different components that share a key and whose facts don't rule a link out.

    A key of more than BLOCK nodes is cut into blocks of about BLOCK, and its pairs into cells of two blocks, so a cell's work
    is bounded; facts are compared inside the join, and only pairs that pass leave it. Each node takes its LOWEST lowest keys
    along: nodes that have some of these in common leave the join in the lowest of them alone, others in each key they share.
    """
    names = [c for c in facts.columns if c != "node"]
    ranked = open_.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("key"))).where(F.col("rank") <= LOWEST)
    facts = facts.join(ranked.groupBy("node").agg(F.collect_list("key").alias("low")), "node")
    sizes = open_.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = open_.join(sizes, "key").join(facts, "node")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    end = lambda e: [F.col("node").alias(e), F.col("comp").alias(f"{e}_comp"), *[F.col(c).alias(f"{e}_{c}") for c in ["low", *names]]]
    one = rows.select("key", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), *end("a"))
    other = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"), *end("b"))
    met = one.join(other, ["key", "i", "j"]).where("a_comp <> b_comp AND (i < j OR a < b)").where(near("a_", "b_"))
    met = met.where("coalesce(array_min(array_intersect(a_low, b_low)) = key, true)")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def link_buckets(members: DataFrame, verify: Callable[[DataFrame], DataFrame], facts: DataFrame, near: Callable[[str, str], Column], slack: DataFrame | None = None, stars: int = 3, once: bool = False, left: float = 1.0, last: Callable[[DataFrame], DataFrame] | None = None, bands: Callable[[int], Column] | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """Finds links between nodes that share a key, up to the links that join what is joined already.

    members: key, node, distinct. verify takes pairs (a, b, and in star rounds shared: the number of keys they share of those
    that join different components, null later) and returns the true links (a, b). Star rounds first verify each node against
    one representative of its keys and contract what is linked, so a large group of near copies costs about a pair for each
    of its nodes and round. Then the pairs of different components in each key are compared by their facts (a row a node),
    inside the key: near gives the condition that all links fulfil, on columns with the prefixes a_ and b_. slack (node,
    slack) says how many of a node's keys may be dropped while it still shares a remaining key with each of its links; its
    most frequent ones are. once: verify's answer depends on a and b alone (not on shared), so it gets no pair again that it
    was given in an earlier round, and of keys with the same nodes one is taken from the start. After a star round, but the
    first, that leaves more than a share `left` of the rows open there is no other. last verifies in verify's stead after the
    star rounds, where nothing is contracted any more, and may leave links to the caller. bands gives, for a star round, a
    column of facts by which each key's nodes are divided: each part has a representative of its own, so that nodes aren't
    spent on one that their facts rule out.

    Returns the links and the component labels (node, comp), None if there are no links.
    """
    links = None
    labels = None
    tried: list[DataFrame] = []

    def untried(pairs: DataFrame) -> DataFrame:
        if not once:
            return pairs
        for done in tried:
            pairs = pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")
        tried.append(stored(pairs))
        return tried[-1]

    open_ = stored(_once(members).withColumn("comp", F.col("node")) if once else _several(members, labels))
    rows = open_.count() if left < 1 else 0
    for turn in range(stars):
        if open_.isEmpty():
            break
        new = stored(verify(untried(_star(open_, turn, None if bands is None else facts.select("node", bands(turn).alias("band"))))))
        if new.isEmpty():
            break
        links = new if links is None else links.unionByName(new)
        was_labels, labels = labels, components(links)
        discard(was_labels)
        was, open_ = open_, stored(_several(open_.drop("comp"), labels))
        discard(was)
        if left < 1:
            before, rows = rows, open_.count()
            if turn and rows > left * before:
                break
    if open_.isEmpty():
        discard(*tried)
        return links, labels
    if slack is not None:
        was, open_ = open_, stored(_rarest(open_, slack))
        discard(was)
    if not once:
        was, open_ = open_, stored(_once(open_))
        discard(was)
    pairs = _meetings(open_, facts, near).distinct()
    pairs = untried(pairs) if once else stored(pairs)
    discard(open_)
    new = stored((last or verify)(pairs.withColumn("shared", F.lit(None).cast("long"))))
    if not new.isEmpty():
        links = new if links is None else links.unionByName(new)
        was_labels, labels = labels, components(links)
        discard(was_labels)
    discard(*tried)
    return links, labels
