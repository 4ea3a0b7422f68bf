"""Identities of records: derivation, collisions and lookups."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Status and diagnostic names.
STATUSES = ("available", "missing", "invalid", "duplicate")
CODES = (
    "identity.existing.missing", "identity.logical-path.missing", "identity.frontmatter.invalid-path", "identity.frontmatter.missing", "identity.frontmatter.invalid", "identity.frontmatter.unsupported-value",
    "identity.frontmatter.invalid-integer", "identity.frontmatter.invalid-uuid", "identity.frontmatter.invalid-slug", "identity.primary.duplicate", "identity.logical-path.duplicate",
)
SLUGS = {"strictASCII": r"^[a-z0-9]+(?:-[a-z0-9]+)*$", "preserve": r"^[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*$", "unicode": r"^[\p{L}\p{N}]+(?:[-_][\p{L}\p{N}]+)*$"}
UUID = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"


@dataclass(frozen=True)
class Policy:
    """source: existing, path or frontmatter; path and form (string, integer, uuid, slug:NAME) are those of frontmatter."""

    source: str = "path"
    path: tuple[str, ...] = ()
    form: str = "string"
    path_fallback: bool = True


def _at(path: tuple[str, ...]) -> tuple[Column, Column]:
    """(kind, text) of a value inside the user's frontmatter; null counts as missing."""
    v = F.try_variant_get(F.try_parse_json("user_json"), "$" + "".join(f"['{p}']" for p in path), "variant")
    s = F.schema_of_variant(v)
    kind = F.when(v.isNull() | (s == "VOID"), None).when(s == "STRING", "string").when(s.isin("BIGINT", "LONG", "INT"), "integer").when(s.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number").when(s == "BOOLEAN", "boolean").when(s.startswith("ARRAY"), "array").otherwise("object")
    return kind, F.try_variant_get(v, "$", "string")


def derive(policy: Policy, columns: list[str]) -> tuple[Column, Column]:
    """Identity and code of what is wrong with it, for an analyzed record with these columns; duplicates are not known here."""
    if policy.source == "existing":
        ident = F.col("identity") if "identity" in columns else F.lit(None).cast("string")
        return ident, F.when(ident.isNull(), CODES[0])
    if policy.source == "path":
        return F.col("path"), F.when(F.col("path").isNull(), CODES[1])
    if not policy.path or not all(policy.path):
        return F.lit(None).cast("string"), F.lit(CODES[2])
    kind, text = _at(policy.path)
    form, _, slug = policy.form.partition(":")
    ok = {"string": kind == "string", "integer": kind == "integer", "uuid": (kind == "string") & text.rlike(UUID), "slug": (kind == "string") & text.rlike(SLUGS.get(slug or "strictASCII")) & ((F.lower(text) == text) if slug == "unicode" else F.lit(True))}[form]
    typed = kind.isin("integer", "number") if form == "integer" else kind == "string"
    wrong = {"string": CODES[5], "integer": CODES[6], "uuid": CODES[7], "slug": CODES[8]}[form]
    code = F.when(F.size("parse_diagnostics") > 0, CODES[4]).when(kind.isNull(), CODES[3]).when(~typed, CODES[5]).when(~ok, wrong)
    return F.when(code.isNull(), F.lower(text) if form == "uuid" else text), code


#: Partitions that an identity held by many records is dealt out to.
SALTS = 32


def judge(derived: DataFrame, keys: tuple[str, ...] = ("identity",), held: tuple[str, ...] = ("path", "identity_code")) -> DataFrame:
    """Adds identity_status and counts duplicates into identity_code. derived: path, identity, identity_code, ...

    The rows are dealt out once, by key and salt, so that counting and joining back read the same shuffle and what
    stands before it (parsing) runs once. For that both must need the same of it: the keys and `held` are one column
    that Spark does not prune (an array of one struct), and nulls are equal in the join, so that no filter is put below
    one side. If more columns than those are wanted, both sides are made. Counts are combined before they are shuffled.
    """
    whole = tuple(dict.fromkeys((*keys, *held)))
    at = lambda c: F.element_at("_r", 1)[c]
    rest = [c for c in derived.columns if c not in whole]
    d = derived.select(*rest, F.array(F.struct(*whole)).alias("_r")).repartition(*map(at, keys), F.pmod(F.xxhash64(at("path")), F.lit(SALTS)))
    same = d.groupBy(*(at(k).alias(f"_{k}") for k in keys)).agg(F.count(at("identity")).alias("_n")).filter("_n > 1")
    on = reduce(Column.__and__, (at(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    d = d.join(same, on, "left").select(*(at(c).alias(c) if c in whole else F.col(c) for c in derived.columns), "_n")
    status = F.when(F.col("_n") > 1, "duplicate").when(F.col("identity_code").isNull(), "available").when(F.col("identity_code").isin(CODES[0], CODES[1], CODES[3]), "missing").otherwise("invalid")
    return d.withColumns({"identity_status": status, "identity_code": F.when(F.col("_n") > 1, CODES[9]).otherwise(F.col("identity_code"))}).drop("_n")


def assess(analyzed: DataFrame, policy: Policy) -> DataFrame:
    """Adds identity, identity_status, identity_code and path_fallback."""
    ident, code = derive(policy, analyzed.columns)
    fallback = F.col("path") if policy.path_fallback else F.lit(None).cast("string")
    return judge(analyzed.withColumns({"identity": ident, "identity_code": code})).withColumn("path_fallback", fallback)


def collisions(assessed: DataFrame) -> DataFrame:
    """code, key, n and sorted paths of identities and paths that several records hold (A2)."""
    ids = assessed.filter("identity_status = 'duplicate'").groupBy("identity").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("path")).alias("paths")).select(F.lit(CODES[9]).alias("code"), F.col("identity").alias("key"), "n", "paths")
    paths = assessed.filter("path_fallback is not null").groupBy("path_fallback").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(CODES[10]).alias("code"), F.col("path_fallback").alias("key"), "n", F.array("path_fallback").alias("paths"))
    return ids.unionByName(paths)


def lookup(assessed: DataFrame, keys: DataFrame, by: str = "identity") -> DataFrame:
    """key, result (notFound, record, conflict) and sorted candidate paths for every key."""
    column = "identity" if by == "identity" else "path_fallback"
    held = assessed.select(F.col(column).alias("key"), "path").join(keys.select("key").distinct(), "key", "left_semi")
    found = held.groupBy("key").agg(F.array_sort(F.collect_list("path")).alias("candidates"))
    n = F.size(F.coalesce("candidates", F.array().cast("array<string>")))
    return keys.select("key").join(found, "key", "left").select("key", F.when(n == 0, "notFound").when(n == 1, "record").otherwise("conflict").alias("result"), "candidates")
