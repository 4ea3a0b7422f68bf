"""Operator 3, PII: fixed patterns, and bootstrapped contextual extraction.

Valid matches of the fixed patterns are seeds. The two words in front of a seed, and the two behind it, are lexical
patterns; other tokens with digits that stand behind (in front of) the same words are instances. Patterns and instances form a graph on which Spark repeats:
a pattern's confidence is the mean score of its instances, and an instance's score is the noisy-or of its patterns.
Instances of high-confidence patterns that no fixed pattern covers are reported as kind `context`.
DataFrame functions only; the graph is joined and aggregated, never collected.

Defined results: a null or empty text has no spans, and its digest is that of the empty string. Repeated rows each get
the same spans; a null doc_id is kept. An empty table gives no rows. Other columns are not looked at. Spans count code
points; each pattern reads a text in time linear in its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklake.llm.common import SPACE, let, materialize

KINDS = ("email", "ip", "card", "phone")
# A run of local or digit characters is only tried from its start, or from the end of the match before it: what fails
# there fails from every later place of the run, too.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True))
#: Tokens of six and more characters with a digit.
TOKEN = r"(?<![A-Za-z0-9_.@+/-])(?=[A-Za-z_.@+/-]*+[0-9])[A-Za-z0-9_.@+/-]{5,}+[A-Za-z0-9]?"
#: Groups of digits, of which none goes on as a token; only tried from the start of a run.
GROUP = r"[0-9]++(?:-[0-9]++)*+(?![.-]*+[A-Za-z0-9_@+/])"
DIGITS = rf"(?<![0-9])(?<![0-9]-){GROUP}(?:\x20{GROUP})*+"
#: An IP before the digits in it, and digits with letters behind them as one token.
MENTION = f"{EMAIL}|{PHONE}|{IP}(?![A-Za-z_])|{DIGITS}|{TOKEN}"
OCTET = r"^0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"
#: Rounds of scoring; what an accepted pattern must have: confidence, and distinct instances and seeds among them.
ROUNDS, LEAST_CONFIDENCE, LEAST_INSTANCES, LEAST_SEEDS = 3, 0.6, 5, 3
CHUNK = 256


def located(text: Column, pattern: str) -> Column:
    """Matches as an array of (s, e, m, before, after): start and end in code points, the match, and the text since the last one and up to the next.

    What lies between the matches gives their places. Finished parts of the list are set aside every CHUNK matches, so
    that long lists aren't copied for every match.
    """
    entry = "array<struct<s:int,e:int,m:string,before:string,after:string>>"

    def fold(gaps: Column, found: Column) -> Column:
        pairs = F.transform(found, lambda m, i: F.struct(m.alias("m"), F.get(gaps, i).alias("g"), F.left(F.get(gaps, i + 1), F.lit(80)).alias("n")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(entry).alias("part"), F.array().cast(f"array<{entry}>").alias("parts"))

        def step(a: Column, x: Column) -> Column:
            s = a.at + F.length(x.g)
            e = s + F.length(x.m)
            new = F.array(F.struct(s.alias("s"), e.alias("e"), x.m.alias("m"), F.right(x.g, F.lit(80)).alias("before"), x.n.alias("after")))
            full = F.size(a.part) >= CHUNK
            return F.struct(e.alias("at"), F.when(full, new).otherwise(F.concat(a.part, new)).alias("part"), F.when(full, F.concat(a.parts, F.array(a.part))).otherwise(a.parts).alias("parts"))

        return F.aggregate(pairs, start, step, lambda a: F.concat(F.flatten(a.parts), a.part))

    all_of = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: let(F.split(text, pattern, -1), lambda gaps: fold(gaps, found)))
    return F.when(text.rlike(pattern), all_of).otherwise(F.array().cast(entry))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(r: Column, i: Column) -> Column:
        d = F.substring(r, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return let(F.reverse(digits), lambda r: F.aggregate(F.sequence(F.lit(1), F.length(r)), F.lit(0), lambda a, i: a + value(r, i))) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """Whether a match of the kind's pattern stands."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda x: x.rlike(OCTET))
    if kind == "card":
        return let(_digits(m), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _written(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x.s, x.e))


def base(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), text and one array of valid spans for each kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    standing = lambda kind, found: F.filter(found, lambda x: valid(kind, x.m))
    return d.select("doc_id", F.xxhash64("text").alias("h"), "text", *(standing(k, located(F.col("text"), p)).alias(k) for k, p in PATTERNS.items()))


def mentions(docs: DataFrame) -> DataFrame:
    """doc_id, h, s, e, instance, pattern, seed of everything that may be an identifier, for the words in front of it and those behind it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("h"), located(text, MENTION).alias("found"))
    # An outer explode: the filter that is inferred for an inner one would look for the mentions twice.
    d = d.select("doc_id", "h", F.explode_outer("found").alias("x")).filter("x is not null")
    m = F.col("x.m")
    seed = (
        F.when(m.rlike(f"^(?:{EMAIL})$"), True)
        .when(m.rlike(r"^\+"), valid("phone", m))
        .when(m.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), valid("ip", m))
        .when(m.rlike(r"^[0-9]+(?:[\x20-][0-9]+)*$"), valid("card", m))
        .otherwise(False)
    )
    front = F.regexp_extract(F.lower(F.col("x.before")), r"(?:^|[\x20\x09-\x0D])((?:[^\x20\x09-\x0D]+[\x20\x09]+)?[^\x20\x09-\x0D]+)[\x20\x09]*$", 1)
    behind = F.regexp_extract(F.lower(F.col("x.after")), r"^[\x20\x09]*+([^\x20\x09-\x0D]++[\x20\x09]++[^\x20\x09-\x0D]++)[\x20\x09-\x0D]", 1)
    one = lambda c: F.when(c != "", F.regexp_replace(c, SPACE, " "))
    d = d.select("doc_id", "h", F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.lower(m).alias("instance"), seed.alias("seed"), F.concat(one(front), F.lit(" <")).alias("front"), F.concat(F.lit("> "), one(behind)).alias("behind"))
    d = d.filter(F.col("seed") | ((F.col("e") - F.col("s") >= 6) & F.col("instance").rlike("[0-9]")))
    return d.select("doc_id", "h", "s", "e", "instance", F.explode(F.array("front", "behind")).alias("pattern"), "seed").filter("pattern is not null")


def confident(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Accepted patterns with their confidence, from the graph of distinct (pattern, instance) edges."""
    edges = materialize(found.groupBy("pattern", "instance").agg(F.max(F.col("seed").cast("int")).alias("seed")), "pii-graph")
    scored = edges.select("pattern", "instance", "seed", F.col("seed").cast("double").alias("score"))
    for k in range(rounds):
        patterns = scored.groupBy("pattern").agg(F.avg("score").alias("confidence"), F.count("*").alias("instances"), F.sum("seed").alias("seeds"))
        if k == rounds - 1:
            break
        # Patterns with too few instances say nothing about others; log1p keeps the product of the doubts as a sum.
        doubt = F.when(F.col("instances") >= LEAST_INSTANCES, F.log1p(-F.least(F.col("confidence"), F.lit(0.999)))).otherwise(0.0)
        instances = edges.join(patterns.select("pattern", doubt.alias("doubt")), "pattern").groupBy("instance").agg(F.sum("doubt").alias("doubt"), F.max("seed").alias("known"))
        score = F.when(F.col("known") == 1, 1.0).otherwise(1 - F.exp("doubt"))
        scored = materialize(edges.join(instances, "instance").select("pattern", "instance", "seed", score.alias("score")), "pii-scores")
    return patterns.filter((F.col("confidence") >= LEAST_CONFIDENCE) & (F.col("instances") >= LEAST_INSTANCES) & (F.col("seeds") >= LEAST_SEEDS))


def find_pii(docs: DataFrame) -> DataFrame:
    """Counts, digest of the fixed kinds' spans, and all spans of every document, as kind:start:end."""
    d = base(docs)
    spans = F.array_join(F.concat(*(_written(k, F.col(k)) for k in KINDS)), ",")
    covered = F.concat(*(F.transform(k, lambda x: F.struct(x.s.alias("s"), x.e.alias("e"))) for k in KINDS))
    d = d.select("doc_id", "h", *(F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS), spans.alias("base"), covered.alias("covered"))
    found = materialize(mentions(docs), "pii-mentions")
    new = found.filter(~F.col("seed")).join(confident(found).select("pattern"), "pattern", "left_semi").groupBy("doc_id", "h").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("new"))
    near = (d["doc_id"].eqNullSafe(new["doc_id"])) & (d["h"] == new["h"])
    d = d.join(new, near, "left").select(d["doc_id"], *(f"n_{k}" for k in KINDS), "base", "covered", F.coalesce("new", F.array().cast("array<struct<s:int,e:int>>")).alias("new"))
    free = F.filter("new", lambda x: ~F.exists("covered", lambda b: (x.s < b.e) & (b.s < x.e)))
    d = d.withColumn("free", free)
    return d.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.size("free") > 0, F.array_join(_written("context", F.col("free")), ","))).alias("spans"), F.size("free").cast("bigint").alias("n_context"))


def mask(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Documents with every span replaced by [KIND]; needs doc_id to be a key."""
    pieces = F.sort_array(F.transform(F.filter(F.split("spans", ","), lambda x: x != ""), lambda x: let(F.split(x, ":"), lambda p: F.struct(p[1].cast("int").alias("s"), p[2].cast("int").alias("e"), F.upper(p[0]).alias("k")))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, x: F.when(x.s < a.at, a).otherwise(F.struct(F.concat(a.out, F.substring(F.col("text"), a.at + 1, x.s - a.at), F.lit("["), x.k, F.lit("]")).alias("out"), x.e.alias("at")))
    d = docs.join(found.select("doc_id", "spans"), "doc_id", "left").withColumn("_m", F.aggregate(pieces, start, step))
    return d.withColumn("text", F.coalesce(F.concat(F.col("_m.out"), F.expr("substring(text, _m.at + 1)")), F.col("text"))).drop("_m", "spans")

