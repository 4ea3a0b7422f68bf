"""Operator 10, n-gram Jaccard join: prefix filtering under several global orders.

Documents are sets of distinct three-word shingles; equal sets are one class. Two sets of a Jaccard similarity of 0.9
or more share a token among the first few of either under every total order of the tokens. All orders here put
shingles of rare hash buckets first, counted over all documents, and break ties by different hashes. Classes that
share a prefix token of the first order, at places and with sizes that still allow the similarity, are candidates only
if their prefixes under the other orders meet, too. What is left is verified on the whole sets.

Shingles are known by 64-bit hashes, and a class by two of them. Large groups are linked through pivots (see
graph.link_buckets), never by all their pairs. Only the first order's prefix is kept of every document; the prefixes
under the other orders and the whole sets are made of the texts again, for documents that are still candidates.

Defined results: a null text or one without words has an empty set and is its own component, as has a text with fewer
than three words only equals. Rows with a null doc_id have a null component and link nothing. Repeated rows and
equal doc_ids with different texts are classes like any other; a component is named by its smallest doc_id. An empty
table gives no rows. Other columns are not looked at. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklake.llm.common import discard, let, materialize, maybe_broadcast, own_name, words
from marklake.llm.graph import link_buckets, shared_members

#: Words of a shingle, similarity in hundredths, orders, and hash buckets in which shingles are counted.
WORDS, PERCENT, ORDERS, BUCKETS = 3, 90, 3, 1 << 18
#: The bits of a key that come from the hash.
MASK = (1 << 52) - 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingles(text: Column, n: int = WORDS) -> Column:
    """Hashed shingles of a text, each as often as it occurs; the whole sequence as one if it has fewer words."""
    text = F.coalesce(text, F.lit(""))
    # A text of as many bytes as characters is ASCII, where lower() changes A to Z only.
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))

    def over(h: Column) -> Column:
        many = F.transform(F.slice(h, n, F.greatest(F.size(h) - n + 1, F.lit(0))), lambda x, i: F.xxhash64(*(F.get(h, i + k) for k in range(n - 1)), x))
        return F.when(F.size(h) >= n, many).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words(low), lambda w: F.xxhash64(w)), over)


def levels(sets: DataFrame) -> bytes:
    """A byte for each hash bucket: how often its shingles occur in all documents, on a logarithmic scale.

    16 steps an octave over the rarest bucket, 127 at most; BUCKETS bytes, whatever the corpus.
    """
    # An outer explode: the filter that is inferred for an inner one would make the shingles twice.
    each = sets.select(F.explode_outer("s").alias("h")).filter("h is not null")
    counted = each.groupBy(F.col("h").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")).agg(F.count("*").alias("n"))
    found = counted.select("bucket", F.log2("n").alias("n")).collect()
    least = min((r.n for r in found), default=0)
    out = bytearray(BUCKETS)
    for r in found:
        out[r.bucket] = min(127, round(16 * (r.n - least)))
    return bytes(out)


def prefix_size(n: Column, percent: int = PERCENT) -> Column:
    """Tokens of a set of n that a similar set must meet: n less the least overlap, and one."""
    return (n - F.ceil(n * percent / 100) + 1).cast("int")


def keys(s: Column, level: bytes) -> Column:
    """Tokens of a set as numbers, in the first order: the level of their bucket, then 52 bits of their hash."""

    def key(table: Column, h: Column) -> Column:
        at = F.substring(table, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int") + 1, F.lit(1))
        return F.coalesce(F.shiftleft(F.ascii(at.cast("string")).cast("bigint"), 52).bitwiseOR(F.shiftrightunsigned(h, 12)), F.lit(0).cast("bigint"))

    return F.sort_array(let(F.lit(level), lambda table: F.transform(s, lambda h: key(table, h))))


def prefixes(ordered: Column, percent: int = PERCENT, orders: int = ORDERS) -> Column:
    """The first tokens of a set under each order: rare ones first; by hash; by the hash's complement; by its rotations.

    ordered: the set's keys in the first order. All other orders follow from the hash that the keys carry.
    """

    def other(v: Column, k: int) -> Column:
        low = F.lit(MASK)
        if k == 1:
            moved = F.transform(v, lambda x: x.bitwiseAND(low))
        elif k == 2:
            moved = F.transform(v, lambda x: F.bitwise_not(x).bitwiseAND(low))
        else:
            moved = F.transform(v, lambda x: F.shiftleft(x.bitwiseAND(low), 11 * (k - 2)).bitwiseAND(low).bitwiseOR(F.shiftrightunsigned(x.bitwiseAND(low), 52 - 11 * (k - 2))))
        return F.slice(F.sort_array(moved), F.lit(1), prefix_size(F.size(v), percent))

    first = lambda v: F.slice(v, F.lit(1), prefix_size(F.size(v), percent))
    return let(ordered, lambda v: F.struct(first(v).alias("p0"), *(other(v, k).alias(f"p{k}") for k in range(1, orders))))


def jaccard_at_least(a: Column, b: Column, percent: int = PERCENT) -> Column:
    return let(F.size(F.array_intersect(a, b)), lambda both: 100 * both >= percent * (F.size(a) + F.size(b) - both))


def link(docs: DataFrame, percent: int = PERCENT, orders: int = ORDERS, n: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h, n, h1, h2: the text's hash, the set's size and name) and (node, comp) of the linked classes. node: the class's h1."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    found = d.select("doc_id", F.xxhash64("text").alias("h"), shingles(F.col("text"), n).alias("s"))
    level = levels(found.filter(F.col("doc_id").isNotNull()))
    named = found.select("doc_id", "h", keys(F.array_distinct("s"), level).alias("s"))
    first = F.slice("s", F.lit(1), prefix_size(F.size("s"), percent)).alias("p0")
    whole = materialize(named.select("doc_id", "h", F.size("s").alias("n"), F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(7), "s").alias("h2"), first), "join-whole")
    rows = whole.select("doc_id", "h", "n", "h1", "h2")
    full = whole.filter("n > 0 and doc_id is not null")

    def sides(pairs: DataFrame, of: DataFrame, columns: list[str]) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(of.select(F.col("node").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns)), side)
        return pairs

    def again(pairs: DataFrame, made) -> DataFrame:
        """node and what is made of the shingles of the first document of every node of the pairs."""
        nodes = maybe_broadcast(pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct())
        heads = full.select("doc_id", "h", F.col("h1").alias("node")).join(nodes, "node").groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("at")).select("node", "at.*")
        texts = d.withColumn("h", F.xxhash64("text")).join(maybe_broadcast(heads), ["doc_id", "h"])
        return texts.select("node", *made(F.array_distinct(shingles(F.col("text"), n)))).dropDuplicates(["node"])

    order = [f"p{k}" for k in range(1, orders)]

    def verify(pairs: DataFrame) -> DataFrame:
        """Intersects the filters of the other orders, then compares the whole sets of what is left."""
        if pairs.isEmpty():
            return pairs
        some = materialize(again(pairs, lambda s: [prefixes(keys(s, level), percent, orders).alias("p")]).select("node", *(F.col(f"p.{c}") for c in order)), "join-prefixes")
        meet = F.lit(True)
        for c in order:
            meet = meet & F.arrays_overlap(f"a_{c}", f"b_{c}")
        left = materialize(sides(pairs, some, order).filter(meet).select("a", "b"), "join-candidates")
        discard(some)
        if left.isEmpty():
            return left
        sets = materialize(again(left, lambda s: [s.alias("s")]), "join-sets")
        linked = materialize(sides(left, sets, ["s"]).filter(jaccard_at_least(F.col("a_s"), F.col("b_s"), percent)).select("a", "b"), "join-verified")
        discard(sets)
        return linked

    members = shared_members(full.select(F.posexplode("p0").alias("rank", "bucket"), F.col("h1").alias("node"), "n").select("bucket", "node", "rank", "n"), "join")

    def near(a, b) -> Column:
        need = F.ceil(percent * (a("n") + b("n")) / (100 + percent))
        sized = percent * F.greatest(a("n"), b("n")) <= 100 * F.least(a("n"), b("n"))
        return sized & (F.least(a("n") - a("rank"), b("n") - b("rank")) >= need)

    comps, _ = link_buckets(members, near, verify, "join")
    return rows, comps


def grouped(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """The rows with a set and a doc_id, with g1 and g2, which name their component."""
    full = rows.filter("n > 0 and doc_id is not null").join(maybe_broadcast(comps.withColumnRenamed("node", "h1")), "h1", "left")
    return full.select("doc_id", "h", F.coalesce("comp", "h1").alias("g1"), F.coalesce(F.when(F.col("comp").isNull(), F.col("h2")), F.lit(0).cast("bigint")).alias("g2"))


def join(docs: DataFrame, percent: int = PERCENT, orders: int = ORDERS, n: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    rows, comps = link(docs, percent, orders, n)
    smallest = grouped(rows, comps).groupBy("g1", "g2").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")).filter("n > 1")
    r = rows.join(maybe_broadcast(comps.withColumnRenamed("node", "h1")), "h1", "left").withColumns({"g1": F.coalesce("comp", "h1"), "g2": F.coalesce(F.when(F.col("comp").isNull(), F.col("h2")), F.lit(0).cast("bigint"))})
    out = r.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), "g1", "g2").join(smallest.drop("n"), ["g1", "g2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT, orders: int = ORDERS, n: int = WORDS) -> DataFrame:
    """The documents with one row left of each component: that of the smallest doc_id, then of the lowest text hash.

    Rows with an empty set or a null doc_id all stay. Repeated rows are one group like any other copies.
    """
    rows, comps = link(docs.select("doc_id", "text"), percent, orders, n)
    found = grouped(rows, comps)
    at = F.struct("doc_id", "h")
    best = found.groupBy("g1", "g2").agg(F.min(at).alias("best"), F.max(at).alias("last"), F.count("*").alias("n")).filter("n > 1")
    doc, text, place = (own_name(docs, x) for x in ("doc", "text_hash", "place"))
    same = found.join(best.select("g1", "g2", "best"), ["g1", "g2"]).filter(at != F.col("best")).select("doc_id", "h").distinct()
    gone = materialize(same.select(F.col("doc_id").alias(doc), F.col("h").alias(text)), "join-gone")
    repeated = materialize(found.groupBy("doc_id", "h").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias(doc), F.col("h").alias(text)), "join-repeated")
    d = docs.withColumns({doc: F.col("doc_id").cast("bigint"), text: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    d = d.join(maybe_broadcast(gone), [doc, text], "left_anti")
    if not repeated.isEmpty():
        again = maybe_broadcast(repeated)
        d = d.join(again, [doc, text], "left_anti").unionByName(d.join(again, [doc, text], "left_semi").dropDuplicates([doc, text]))
    return d.select(*(d[c] for c in docs.columns))
