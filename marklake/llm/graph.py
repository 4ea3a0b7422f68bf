"""Connected components, and linking the members of buckets without comparing all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklake.llm.common import BROADCAST_ROWS, discard, materialize


def _round(edges: DataFrame) -> DataFrame:
    """A large-star and a small-star step over edges (u, v), u > v."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    return large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of links (a, b): comp is the smallest node reachable.

    Alternates the large-star and small-star steps: every node passes its larger (smaller) neighbours to the smallest
    node it knows, until nothing changes. Each step is a min with map-side combining and a join that Spark can split,
    so hubs are no bottleneck. Only counters reach the driver. A graph of at most BROADCAST_ROWS links is counted first
    and then solved in one partition, where no step shuffles.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "cc")
    small = edges.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    before = None
    while True:  # every round brings nodes nearer to their smallest, so it ends
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before or not now.n:
            break
        before = now
        after = materialize(_round(edges.coalesce(1)).coalesce(1) if small else _round(edges), "cc")
        discard(edges)
        edges = after
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return ends.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


#: The table of shared buckets' bits has 2^SHARED_BITS of them in rows of 2^ROW_BITS: 8 MB, whatever the corpus.
SHARED_BITS, ROW_BITS = 26, 15


def shared_members(rows: DataFrame, name: str) -> DataFrame:
    """(bucket, node, ...) of the buckets that different nodes share, each node once in a bucket.

    rows: (bucket, node, ...), bucket a hash; rows of one bucket and node may repeat and are alike. Most buckets have a
    single node: what is shared is found by an aggregate with map-side combining, and a broadcast table of bits, of
    fixed size, lets nearly all other rows go before they are shuffled for the join that decides.
    """
    shared = rows.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least <> most").select("bucket")
    shared = materialize(shared, f"{name}-shared")
    place = F.col("bucket").bitwiseAND(F.lit((1 << SHARED_BITS) - 1))
    at, bit = F.shiftright(place, ROW_BITS).cast("int"), place.bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    bits = shared.groupBy(at.alias("at")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    byte = F.ascii(F.decode(F.substring(F.col("bits"), F.shiftright(bit, 3).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
    likely = rows.withColumn("at", at).join(F.broadcast(bits), "at").filter(F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1)
    rest = [c for c in rows.columns if c not in ("bucket", "node")]
    found = likely.groupBy("bucket", "node").agg(*(F.first(c).alias(c) for c in rest)).join(shared, "bucket")
    found = materialize(found.select(*rows.columns), f"{name}-members")
    discard(shared)
    return found


def link_buckets(members: DataFrame, near: Callable[[Callable[[str], Column], Callable[[str], Column]], Column], verify: Callable[[DataFrame], DataFrame], name: str) -> tuple[DataFrame, DataFrame]:
    """All components of the graph whose links are the verified pairs that share a bucket.

    members: (bucket, node, rank, ...), a node at most once in a bucket. near(a, b): cheap necessary condition on two
    members, as a Column from accessors of their columns. verify: keeps the true links of pairs (a, b).
    Returns (node, comp) of the linked nodes, and the links found.

    Round one compares every member with its bucket's pivot (one of the lowest rank): one pair per member at most.
    What that connects needs no further comparing. Round two compares, in buckets that still hold several components,
    every member outside the bucket's largest component with all members of other components, so no link between
    components is missed. Pivots and component sizes are aggregates; the joins on buckets can be split.
    """
    pivots = members.groupBy("bucket").agg(F.count("*").alias("n_members"), F.min_by("node", "rank").alias("pivot")).filter("n_members > 1").select("bucket", "pivot")
    shared = materialize(members.join(pivots, "bucket"), f"{name}-buckets")
    a, b = shared.filter("node = pivot").alias("a"), shared.filter("node <> pivot").alias("b")
    at = lambda side: lambda c: F.col(f"{side}.{c}")
    first = a.join(b, (at("a")("bucket") == at("b")("bucket")) & near(at("a"), at("b"))).select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()
    first = materialize(first, f"{name}-pairs")
    links = materialize(verify(first), f"{name}-links")
    comps = materialize(components(links), f"{name}-comps")
    m = shared.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sizes = m.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("comps")).filter("comps > 1").select("bucket", F.col("top.comp").alias("main"))
    m = materialize(m.join(mixed, "bucket"), f"{name}-mixed")
    discard(shared)
    a, b = m.filter("comp <> main").alias("a"), m.alias("b")
    apart = (at("a")("comp") != at("b")("comp")) & ((at("b")("comp") == at("b")("main")) | (at("a")("node") < at("b")("node")))
    second = a.join(b, (at("a")("bucket") == at("b")("bucket")) & apart & near(at("a"), at("b"))).select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()
    second = materialize(second.join(first, ["a", "b"], "left_anti"), f"{name}-pairs")
    discard(first)
    discard(m)
    more = materialize(verify(second), f"{name}-links")
    discard(second)
    links = links.unionAll(more)
    return (comps if more.isEmpty() else materialize(components(links), f"{name}-comps")), links
