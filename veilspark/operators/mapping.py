"""The mapping table: which substitute stands for which hashed value, and how often.

Every step works on one row per key. Counting happens before the shuffle (partial
aggregation), so a value that makes up a third of all spans is one row per task.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.keys import mapping_id
from ..schemas import MAX_PAGE, MAX_SUBSTITUTE

KEY = ["original_hash", "entity_type"]
COLUMNS = ["original_hash", "entity_type", "substitute", "first_seen", "last_used",
           "substitution_count", "mapping_id"]


def span_uses(cleaned: DataFrame, at: str, *keep: str, types: list[str] | None = None
              ) -> DataFrame:
    """One row per replaced span: key, substitute, time. Originals do not appear.

    ``types`` names the types that get a mapping (strategy ``replace``).
    """
    rows = (
        cleaned.select(*keep, F.col(at).alias("used_at"),
                       F.explode_outer("substitutions").alias("s"))
        .filter(F.col("s").isNotNull())
        .select(*keep, "used_at", "s.original_hash", "s.entity_type", "s.substitute")
    )
    return rows if types is None else rows.filter(F.col("entity_type").isin(*types))


def usage(uses: DataFrame) -> DataFrame:
    """Uses per key in a batch. The substitute follows from the key, so grouping by it
    as well changes nothing and keeps the aggregate on the hash path."""
    return uses.groupBy(*KEY, "substitute").agg(
        F.count("*").alias("uses"),
        F.min("used_at").alias("first_used"),
        F.max("used_at").alias("last_used"),
    )


def build(uses: DataFrame) -> DataFrame:
    """A mapping table from nothing."""
    return usage(uses).select(
        *KEY, "substitute", F.col("first_used").alias("first_seen"), "last_used",
        F.col("uses").alias("substitution_count"),
        mapping_id(F.col("original_hash")).alias("mapping_id"))


def lookup(keys: DataFrame, store: DataFrame) -> DataFrame:
    """Keys with their stored substitute, null where there is none."""
    return keys.join(store.select(*KEY, "substitute"), KEY, "left")


def new_mappings(batch: DataFrame, store: DataFrame) -> DataFrame:
    """Mappings a batch adds: keys that are not stored yet."""
    return build_from_usage(batch.join(store.select(*KEY), KEY, "left_anti"))


def build_from_usage(batch: DataFrame) -> DataFrame:
    return batch.select(
        *KEY, "substitute", F.col("first_used").alias("first_seen"), "last_used",
        F.col("uses").alias("substitution_count"),
        mapping_id(F.col("original_hash")).alias("mapping_id"))


def increment(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored mappings with the uses of a batch added; new keys are left out."""
    return store.join(batch.select(*KEY, "uses", F.col("last_used").alias("used")), KEY, "left"
                      ).select(
        *KEY, "substitute", "first_seen",
        F.greatest("last_used", "used").alias("last_used"),
        (F.col("substitution_count") + F.coalesce("uses", F.lit(0))).alias("substitution_count"),
        "mapping_id")


def merge(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Get or create for a whole batch: one full outer join on the key.

    A stored substitute wins over a computed one. ``is_new`` marks created rows.
    """
    s = store.select(*KEY, F.col("substitute").alias("old"), "first_seen",
                     F.col("last_used").alias("old_used"), "substitution_count")
    b = batch.select(*KEY, F.col("substitute").alias("made"), "uses", "first_used",
                     F.col("last_used").alias("used"))
    return s.join(b, KEY, "full").select(
        *KEY,
        F.coalesce("old", "made").alias("substitute"),
        F.coalesce("first_seen", "first_used").alias("first_seen"),
        F.greatest("old_used", "used").alias("last_used"),
        (F.coalesce("substitution_count", F.lit(0)) + F.coalesce("uses", F.lit(0)))
        .alias("substitution_count"),
        mapping_id(F.col("original_hash")).alias("mapping_id"),
        F.col("old").isNull().alias("is_new"))


def page(store: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page, newest first, with the total. Only ``limit + offset`` rows per task are sorted.

    The total is its own one-row aggregate, joined to at most ``limit`` rows.
    """
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError(f"limit must be 1 to {MAX_PAGE}, offset at least 0")
    rows = store.orderBy(F.desc("first_seen"), *KEY).offset(offset).limit(limit)
    total = store.agg(F.count("*").alias("total"))
    return rows.withColumn("total", total.scalar())


def page_after(store: DataFrame, limit: int = 100,
               after: tuple[datetime, str, str] | None = None) -> DataFrame:
    """The next page, newest first, behind the last row of the one before.

    ``after`` is that row's (first_seen, original_hash, entity_type). However far the page,
    no task sorts more than ``limit`` rows, and the test on the time reaches the files.
    """
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be 1 to {MAX_PAGE}")
    rows = store
    if after is not None:
        seen = F.lit(after[0]).cast("timestamp_ntz")
        key = (F.col("original_hash") > after[1]) | (
            (F.col("original_hash") == after[1]) & (F.col("entity_type") > after[2]))
        rows = store.filter((F.col("first_seen") <= seen) & ((F.col("first_seen") < seen) | key))
    return rows.orderBy(F.desc("first_seen"), *KEY).limit(limit)


def get(store: DataFrame, number: int | Column) -> DataFrame:
    return store.filter(F.col("mapping_id") == number)


def override(store: DataFrame, changes: DataFrame) -> DataFrame:
    """Set substitutes by hand; counts and times stay. ``changes(mapping_id, new_substitute)``."""
    checked = F.when(
        F.length("new_substitute").between(1, MAX_SUBSTITUTE), F.col("new_substitute")
    ).otherwise(F.raise_error(F.lit(f"a substitute has 1 to {MAX_SUBSTITUTE} characters"))
                .cast("string"))
    new = changes.select("mapping_id", checked.alias("new_substitute"))
    return store.join(new, "mapping_id", "left").select(
        *KEY, F.coalesce("new_substitute", "substitute").alias("substitute"), "first_seen",
        "last_used", "substitution_count", "mapping_id")


def delete(store: DataFrame, ids: DataFrame) -> DataFrame:
    """The table without the given ``mapping_id`` rows."""
    return store.join(ids.select("mapping_id"), "mapping_id", "left_anti").select(*COLUMNS)


def delete_all(store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An empty table and the number of rows it had."""
    return store.filter(F.lit(False)), store.agg(F.count("*").alias("deleted_count"))


def last_used_between(store: DataFrame, since: datetime | None = None,
                      until: datetime | None = None, entity_type: str | None = None
                      ) -> DataFrame:
    """Filter on plain columns, so that the test reaches the files. Both ends count."""
    rows = store
    if since is not None:
        rows = rows.filter(F.col("last_used") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        rows = rows.filter(F.col("last_used") <= F.lit(until).cast("timestamp_ntz"))
    if entity_type is not None:
        rows = rows.filter(F.col("entity_type") == entity_type)
    return rows


def exported(rows: DataFrame) -> DataFrame:
    """Columns of an export in order, times as ISO text."""
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    return rows.select(
        F.col("mapping_id").alias("id"), "original_hash", "substitute", "entity_type",
        F.date_format("first_seen", iso).alias("first_seen"),
        F.date_format("last_used", iso).alias("last_used"), "substitution_count")


def export_summary(rows: DataFrame, since: datetime | None = None, until: datetime | None = None,
                   entity_type: str | None = None) -> DataFrame:
    """One row about an export: the filters it was made with, null where unset, and its total."""
    iso = lambda at: None if at is None else at.strftime("%Y-%m-%dT%H:%M:%S")
    return rows.agg(F.count("*").alias("total")).select(
        F.lit(iso(since)).cast("string").alias("since"), F.lit(iso(until)).cast("string").alias("until"),
        F.lit(entity_type).cast("string").alias("entity_type"), "total")


def types(store: DataFrame) -> DataFrame:
    return store.select("entity_type").distinct().orderBy("entity_type")


def collisions(store: DataFrame) -> DataFrame:
    """Substitutes that stand for more than one value of a type."""
    return store.groupBy("entity_type", "substitute").agg(
        F.count("*").alias("values")).filter(F.col("values") > 1)


def disambiguate(store: DataFrame, skip: tuple[str, ...] = ("NRP",)) -> DataFrame:
    """Give each value of a colliding substitute its own by a number behind it.

    Opt-in. Values are numbered by day of first sight, then by hash; the first keeps
    the plain form, and values of a later day never change the numbers of earlier
    ones. A pool of a few cities means groups that grow with the data, so a group is
    numbered in pieces (day and hash prefix) that are spread over the tasks, and only
    the sizes of the pieces are summed in order. Types with placeholders for
    everything are left as they are.
    """
    group = ["entity_type", "substitute"]
    bit = [*group, "day", "bucket"]
    kept = store.filter(F.col("entity_type").isin(*skip))
    rows = store.filter(~F.col("entity_type").isin(*skip)).withColumn(
        "day", F.to_date("first_seen")).withColumn(
        "bucket", F.substring("original_hash", 1, 2))
    before = Window.partitionBy(*group).orderBy("day", "bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*bit).agg(F.count("*").alias("n")).withColumn(
        "ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy(*bit).orderBy("original_hash"))
    place = F.col("ahead") + F.col("inside")
    out = F.when(place > 1, F.concat_ws(" ", F.col("substitute"), place.cast("string"))
                 ).otherwise(F.col("substitute"))
    numbered = rows.withColumn("inside", inside).join(sizes, bit).withColumn("unique", out)
    columns = [F.col("unique").alias(c) if c == "substitute" else F.col(c)
               for c in store.columns]
    return numbered.select(*columns).unionByName(kept)


def backfill(store: DataFrame) -> DataFrame:
    """Read rows of an older layout: ``last_used`` defaults to ``first_seen``."""
    if "last_used" not in store.columns:
        return store.withColumn("last_used", F.col("first_seen"))
    return store.withColumn("last_used", F.coalesce("last_used", "first_seen"))


def document_counters(cleaned: DataFrame, uses: DataFrame, store: DataFrame, row_id: str
                      ) -> DataFrame:
    """Detected, anonymized, new and existing mappings of each text.

    A key is new in the first text that holds it, in order of ``row_id``. The first
    text is an aggregate over the key and not a window, so a hot key is one row.
    """
    first = uses.groupBy(*KEY).agg(F.min(row_id).alias(row_id))
    created = (
        first.join(store.select(*KEY), KEY, "left_anti")
        .groupBy(row_id).agg(F.count("*").alias("created"))
    )
    return cleaned.join(created, row_id, "left").select(
        row_id, "entities_detected", "entities_anonymized",
        F.coalesce("created", F.lit(0)).alias("new_mappings_created"),
        (F.col("entities_anonymized") - F.coalesce("created", F.lit(0)))
        .alias("existing_mappings_used"))
