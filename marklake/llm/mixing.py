"""Operator 2, mixing sources to target weights: iterative proportional fitting and calibrated sampling.

Tokens are counted by cell of source, language and topic. Raking scales the cells' weights to the target of each
marginal in turn, ROUNDS times. A document is kept with the probability keep * raked / counted of its cell, at most 1,
by a hash of its doc_id; its weight is what the probability could not express, and `sample` makes up for it with
copies. DataFrame functions only.

Targets are shares by value of a dimension. Where none are given they are the observed ones to the power POWER: large
sources, languages and topics are damped, small ones raised.

Defined results: a null source or language is the empty string. A null or empty text has no tokens and topic -1. A
cell without tokens has ratio 1. A value without a target has target 0. Repeated rows and equal doc_ids share their
fate; a null doc_id hashes like the empty string. An empty table gives no rows. All columns of the input are kept by
`sample`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marklake.llm.common import BROADCAST_ROWS, let, materialize, maybe_broadcast, words

DIMENSIONS = ("source", "lang", "topic")
#: Topics, least length of a word that counts for one, rounds of raking, power of observed shares, share of tokens to keep.
TOPICS, TOPIC_LETTERS, ROUNDS, POWER, KEEP = 8, 4, 12, 0.5, 0.5


def topic(w: Column) -> Column:
    """Lexical class that most words of four and more characters belong to, the lowest of equals; -1 without any.

    A stand-in that every engine can compute; give a column of a real topic model instead where there is one.
    """
    classes = F.sort_array(F.transform(F.filter(w, lambda x: F.length(x) >= TOPIC_LETTERS), lambda x: (F.ascii(x) + 5 * F.length(x)).bitwiseAND(F.lit(TOPICS - 1))))

    def most(c: Column) -> Column:
        def best(r: Column) -> Column:
            # In sorted order a class begins at its first place and ends at its first place from behind.
            counted = [F.struct(F.when(F.array_position(c, F.lit(k)) > 0, F.size(c) + 2 - F.array_position(c, F.lit(k)) - F.array_position(r, F.lit(k))).otherwise(0).alias("n"), F.lit(-k).alias("k")) for k in range(TOPICS)]
            return -F.array_max(F.array(*counted)).getField("k")

        return F.when(F.size(c) > 0, let(F.reverse(c), best)).otherwise(-1)

    return let(classes, most)


def strata(docs: DataFrame, topic_column: str | None = None) -> DataFrame:
    """row (the document's columns), source, lang, topic and tokens. topic_column: a column of topics' numbers that takes the place of the lexical classes."""
    of = lambda c: F.col("row").getField(c)
    d = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    d = d.select("row", F.coalesce(of("source").cast("string"), F.lit("")).alias("source"), F.coalesce(of("lang").cast("string"), F.lit("")).alias("lang"), words(of("text").cast("string")).alias("w"))
    known = topic(F.col("w")) if topic_column is None else F.coalesce(of(topic_column).cast("int"), F.lit(-1))
    return d.select("row", "source", "lang", known.alias("topic"), F.size("w").cast("bigint").alias("tokens"))


def rake(cells: DataFrame, targets: dict[str, dict] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """cells: source, lang, topic, tokens. Adds ratio: raked over counted tokens.

    Cells are few against the documents. Up to BROADCAST_ROWS of them are raked in one partition; beyond that a round is
    three aggregates with a join back, written after each.
    """
    spark = cells.sparkSession
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    wanted = {}
    for d in DIMENSIONS:
        if targets and d in targets:
            kind = dict(cells.dtypes)[d]
            shares = spark.createDataFrame([(k, float(v)) for k, v in targets[d].items()], f"{d} {kind}, share double")
        else:
            shares = cells.groupBy(d).agg(F.pow(F.sum("tokens").cast("double"), F.lit(POWER)).alias("share"))
        norm = shares.agg(F.sum("share")).first()[0] or 1.0
        wanted[d] = materialize(shares.select(d, (F.col("share") / norm * total).alias("target")), "mixing-targets")
    w = cells
    for d in DIMENSIONS:
        w = w.join(wanted[d].withColumnRenamed("target", f"_{d}"), d, "left")
    w = w.withColumn("w", F.col("tokens").cast("double"))
    few = cells.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    w = w.coalesce(1) if few else w
    for _ in range(rounds):
        for d in DIMENSIONS:
            if few:  # in one partition already, so no window moves a row
                have = F.sum("w").over(Window.partitionBy(d))
                w = w.withColumn("w", F.when(have > 0, F.col("w") * F.coalesce(f"_{d}", F.lit(0.0)) / have).otherwise(0.0))
            else:
                have = w.groupBy(d).agg(F.sum("w").alias("have"))
                w = w.join(have, d).withColumn("w", F.when(F.col("have") > 0, F.col("w") * F.coalesce(f"_{d}", F.lit(0.0)) / F.col("have")).otherwise(0.0)).drop("have")
        w = w if few else materialize(w, "mixing-cells")
    w = materialize(w, "mixing-cells")
    return w.select(*DIMENSIONS, "tokens", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(1.0).alias("ratio"))


def assign(docs: DataFrame, targets: dict[str, dict] | None = None, keep: float = KEEP, topic_column: str | None = None) -> DataFrame:
    """row (the document's columns), source, lang, topic, tokens, wanted (copies), u (hash), p (probability), weight and kept."""
    d = strata(docs, topic_column)
    cells = materialize(d.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")), "mixing-counts")
    ratio = rake(cells, targets).select("source", "lang", "topic", (F.lit(keep) * F.col("ratio")).alias("wanted"))
    d = d.join(maybe_broadcast(ratio), ["source", "lang", "topic"])
    u = F.conv(F.substring(F.md5(F.coalesce(F.col("row.doc_id").cast("bigint").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / 2**32
    p = F.least(F.lit(1.0), F.col("wanted"))
    return d.withColumns({"u": u, "p": p, "weight": F.when(F.col("wanted") > 0, F.col("wanted") / p).otherwise(0.0), "kept": u < p})


def mix(docs: DataFrame, targets: dict[str, dict] | None = None, keep: float = KEEP) -> DataFrame:
    """Stratum, probability and weight in millionths, and fate of every document."""
    d = assign(docs.select("doc_id", "text", "source", "lang"), targets, keep)
    ppm = lambda c: F.round(F.col(c) * 1_000_000).cast("bigint")
    return d.select(F.col("row.doc_id").cast("bigint").alias("doc_id"), "source", "lang", F.col("topic").cast("bigint").alias("topic"), F.col("tokens").alias("n_tokens"), ppm("p").alias("p_ppm"), ppm("weight").alias("weight_ppm"), "kept")


def sample(docs: DataFrame, targets: dict[str, dict] | None = None, keep: float = KEEP, topic_column: str | None = None) -> DataFrame:
    """The kept documents, with the columns of the input, each as often as its cell asks for.

    A cell that has to give more tokens than it holds (keep * ratio above 1) emits every document floor(keep * ratio)
    times, and once more by the hash with the probability that is left, so the expected tokens are those of the targets.
    """
    times = (F.floor("wanted") + (F.col("u") < F.col("wanted") - F.floor("wanted")).cast("bigint")).cast("int")
    found = assign(docs, targets, keep, topic_column).withColumn("copy", F.explode(F.array_repeat(F.lit(1), times)))
    return found.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def oracle_sql(table: str = "documents", rounds: int = ROUNDS, keep: float = KEEP) -> str:
    """DuckDB SQL for the rows of mix over a table."""
    counts = ", ".join(f"len(list_filter(cs, lambda c: c = {k}))" for k in range(TOPICS))
    steps, last = [], "w0"
    for i in range(rounds):
        for d in DIMENSIONS:
            now = f"w{i + 1}_{d}"
            steps.append(f"{now} AS MATERIALIZED (SELECT source, lang, topic, tokens, w * (SELECT t.target FROM t_{d} t WHERE t.{d} = x.{d}) / sum(w) OVER (PARTITION BY x.{d}) AS w FROM {last} x)")
            last = now
    targets = ", ".join(f"t_{d} AS MATERIALIZED (SELECT {d}, pow(sum(tokens)::double, {POWER}) / sum(pow(sum(tokens)::double, {POWER})) OVER () * (SELECT sum(tokens) FROM cells) AS target FROM cells GROUP BY {d})" for d in DIMENSIONS)
    return f"""WITH a AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM {table}),
b AS (SELECT doc_id, source, lang, len(ws)::bigint AS n_tokens, list_transform(list_filter(ws, lambda x: length(x) >= {TOPIC_LETTERS}), lambda x: (ascii(x) + 5 * length(x)) & {TOPICS - 1}) AS cs FROM a),
c AS (SELECT doc_id, source, lang, n_tokens, len(cs) AS k, [{counts}] AS ns FROM b),
d AS MATERIALIZED (SELECT doc_id, source, lang, n_tokens, (CASE WHEN k = 0 THEN -1 ELSE list_position(ns, list_max(ns)) - 1 END)::bigint AS topic FROM c),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::bigint AS tokens FROM d GROUP BY ALL),
{targets},
w0 AS (SELECT source, lang, topic, tokens, tokens::double AS w FROM cells),
{', '.join(steps)},
r AS (SELECT source, lang, topic, {keep} * (CASE WHEN tokens > 0 THEN w / tokens ELSE 1.0 END) AS ratio FROM {last}),
e AS (SELECT d.*, ratio, least(1.0, ratio) AS p, ('0x' || substr(md5(coalesce(doc_id::bigint::varchar, '')), 1, 8))::bigint / 4294967296.0::double AS u FROM d JOIN r USING (source, lang, topic))
SELECT doc_id, source, lang, topic, n_tokens, round(p * 1000000)::bigint AS p_ppm, round(CASE WHEN ratio > 0 THEN ratio / p ELSE 0 END * 1000000)::bigint AS weight_ppm, u < p AS kept FROM e"""
