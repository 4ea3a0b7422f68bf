"""A record store over tables: compare-and-set changes and keyset pages (IO21)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STORE = "identity string, path string, content string, revision bigint"
# Outcomes of a change.
OUTCOMES = ("created", "replaced", "deleted", "alreadyExists", "notFound", "revisionMismatch")


def load(records: DataFrame) -> DataFrame:
    """Records with revision 1; an identity that occurs twice is an error of the caller, see `repeated`."""
    return records.select("identity", "path", "content", F.lit(1).cast("bigint").alias("revision"))


def repeated(records: DataFrame) -> DataFrame:
    """Identities that occur more than once."""
    return records.groupBy("identity").agg(F.count("*").alias("n")).filter("n > 1")


def get(store: DataFrame, identity: str) -> DataFrame:
    return store.filter(F.col("identity") == identity)


def page(store: DataFrame, size: int = 256, after: str | None = None) -> DataFrame:
    """The next records by identity."""
    d = store if after is None else store.filter(F.col("identity") > after)
    return d.orderBy("identity").limit(size)


def apply(store: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The store after a batch of changes, and (identity, outcome) of each.

    changes: identity, op (create, replace or delete), path, content, expected (revision), at most one per identity.
    A replace or delete holds only if the record still has the expected revision. One full outer join.
    """
    c = changes.select("identity", "op", F.col("path").alias("_path"), F.col("content").alias("_content"), "expected")
    d = store.join(c, "identity", "full_outer")
    held = F.col("revision").isNotNull()
    fits = F.col("expected").isNull() | (F.col("expected") == F.col("revision"))
    outcome = (
        F.when(F.col("op") == "create", F.when(held, "alreadyExists").otherwise("created"))
        .when(F.col("op") == "replace", F.when(~held, "notFound").when(~fits, "revisionMismatch").otherwise("replaced"))
        .when(F.col("op") == "delete", F.when(~held, "notFound").when(~fits, "revisionMismatch").otherwise("deleted"))
    )
    d = d.withColumn("outcome", outcome)
    new = F.col("outcome").isin("created", "replaced")
    after = d.filter((held | new) & ~F.coalesce(F.col("outcome") == "deleted", F.lit(False)))
    pick = lambda c: F.when(F.coalesce(new, F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    revision = F.when(F.col("outcome") == "created", 1).when(F.col("outcome") == "replaced", F.col("revision") + 1).otherwise(F.col("revision")).cast("bigint")
    return after.select("identity", pick("path"), pick("content"), revision.alias("revision")), d.filter("op is not null").select("identity", "outcome")
