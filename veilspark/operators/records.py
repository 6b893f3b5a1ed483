"""Structured sign-in records: which fields hold values, and how they are cleaned.

A substitute follows from the value alone, so all fields of a record are cleaned
where they stand: one array of values, one projection, no dictionary to build or
join. The dictionary is there as its own result, and a test shows that both agree.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.json_text import member, members, number_or_text, quoted, scalar, written
from ..functions.keys import mapping_key
from ..functions.substitutes import substitute
from ..sources.files import tasks
from .cleaning import CleanConfig, clean_arrays, clean_texts, computed
from .skew import keyed_join

# --- fixed values -----------------------------------------------------------
# Plain fields that hold personal values.
FIELDS = (
    "Identity", "UserDisplayName", "UserPrincipalName", "AlternateSignInName",
    "SignInIdentifier",
    "IPAddress", "IPAddressFromResourceProvider",
    "UserId", "SessionId", "CorrelationId", "Id", "OriginalRequestId", "UniqueTokenIdentifier",
)
# Keys inside fields that hold JSON text. Coordinates stand under "geoCoordinates".
JSON_FIELDS = {
    "LocationDetails": ("city", "state", "latitude", "longitude"),
    "DeviceDetail": ("deviceId", "displayName"),
}
COORDINATES = ("latitude", "longitude")
GEO = "geoCoordinates"
# Values with this start come from an earlier run.
MARK = "{PII"
# Values that a task cleans at most, repeated ones counted.
VALUES_PER_TASK = 500_000
# --- end of fixed values ----------------------------------------------------

def is_filled(value: Column) -> Column:
    return F.coalesce(value.rlike(r"\S"), F.lit(False))


def with_members(records: DataFrame, fields: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """Add the members of every JSON text, and those of its coordinates, as columns."""
    read = computed(records, **{f"_{f}": members(F.col(f)) for f in fields})
    inner = lambda f: member(F.col(f"_{f}"), GEO)
    geo = {f"_{f}_{GEO}": members(inner(f)["json"], inner(f)["digits"])
           for f, keys in fields.items() if set(keys) & set(COORDINATES)}
    return computed(read, **geo) if geo else read


def _inside(field: str, key: str) -> Column:
    """The value of a key: texts only, but numbers too for coordinates."""
    if key in COORDINATES:
        return scalar(member(F.col(f"_{field}_{GEO}"), key))
    return member(F.col(f"_{field}"), key)["text"]


def _takes_part(value: Column, key: str) -> Column:
    """Whether a value inside JSON is cleaned."""
    if key in COORDINATES:
        return value.isNotNull()
    return is_filled(value) & ~value.startswith(MARK)


def extract_values(records: DataFrame, row_id: str, fields: tuple[str, ...] = FIELDS
                   ) -> DataFrame:
    """Rows ``(row_id, field, value)`` for the filled plain fields."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value"))
                      for f in fields])
    return (
        records.select(row_id, F.explode(F.filter(pairs, lambda p: is_filled(p["value"])))
                       .alias("p"))
        .select(row_id, "p.field", "p.value")
    )


def extract_json_values(records: DataFrame, row_id: str,
                        fields: Mapping[str, tuple[str, ...]] = JSON_FIELDS) -> DataFrame:
    """The same for the keys inside JSON text, as ``Field.key``."""
    structs = with_members(records.select(row_id, *fields), fields)
    value = {(f, k): _inside(f, k) for f, keys in fields.items() for k in keys}
    pairs = F.array(*[
        F.struct(F.lit(f"{f}.{k}").alias("field"),
                 F.when(_takes_part(value[f, k], k), value[f, k]).alias("value"))
        for f, keys in fields.items() for k in keys
    ])
    return (
        structs.select(row_id, F.explode_outer(pairs).alias("p"))
        .filter(F.col("p.value").isNotNull()).select(row_id, "p.field", "p.value")
    )


def all_values(records: DataFrame, row_id: str, fields: tuple[str, ...] = FIELDS,
               json_fields: Mapping[str, tuple[str, ...]] = JSON_FIELDS) -> DataFrame:
    """The rows of both, from one pass over the records."""
    structs = with_members(records.select(row_id, *fields, *json_fields), json_fields)
    slots = {f: F.when(is_filled(F.col(f)), F.col(f)) for f in fields}
    for f, keys in json_fields.items():
        for k in keys:
            slots[f"{f}.{k}"] = F.when(_takes_part(_inside(f, k), k), _inside(f, k))
    pairs = F.array(*[F.struct(F.lit(name).alias("field"), value.alias("value"))
                      for name, value in slots.items()])
    return (
        structs.select(row_id, F.explode_outer(pairs).alias("p"))
        .filter(F.col("p.value").isNotNull()).select(row_id, "p.field", "p.value")
    )


def unique_values(values: DataFrame) -> DataFrame:
    """Values and different values by field. Counting is partial, by field and value."""
    return (
        values.groupBy("field", "value").agg(F.count("*").alias("n"))
        .groupBy("field").agg(F.sum("n").alias("values"), F.count("*").alias("unique_values"))
    )


def value_tasks(spark: SparkSession, records: int, per_task: int = VALUES_PER_TASK) -> int:
    """Over how many tasks the different values of so many records are spread."""
    most = records * (len(FIELDS) + sum(map(len, JSON_FIELDS.values())))
    return max(tasks(spark), -(-most // per_task))


def dictionary(values: DataFrame, config: CleanConfig = CleanConfig(), spread: int | None = None
               ) -> DataFrame:
    """Each different value, cleaned on its own. Holds originals: not to be stored.

    Cleaning is ``spread`` over so many tasks. Without it there are as many as the shuffle that
    finds the different values has partitions, or fewer, however many values there are.
    """
    words = values.select(F.col("value").alias("text")).distinct()
    if spread is not None:
        words = words.repartition(spread, "text")
    return clean_texts(words.withColumn("value", F.col("text")), config).select(
        "value", F.col("anonymized_text").alias("cleaned"))


def apply_dictionary(values: DataFrame, words: DataFrame, row_id: str) -> DataFrame:
    """Values with their cleaned form; a value that is not listed stays as it is.

    For dictionaries that come from elsewhere. Frequent values do not pile up.
    """
    joined = keyed_join(values, words, "value", row_id, "left")
    return joined.select(row_id, "field", "value",
                         F.coalesce("cleaned", "value").alias("cleaned"))


def clean_records(records: DataFrame, config: CleanConfig = CleanConfig(),
                  field_types: Mapping[str, str] | None = None,
                  fields: tuple[str, ...] = FIELDS,
                  json_fields: Mapping[str, tuple[str, ...]] = JSON_FIELDS) -> DataFrame:
    """Records with the listed fields cleaned, all other columns as they are.

    ``field_types`` names fields whose whole value is of a known type and is
    replaced without detection. JSON text is written anew only where a value takes part;
    its other members, known or not, stay as they are.
    """
    known = dict(field_types or {})
    slots = list(fields) + [f"{f}.{k}" for f, keys in json_fields.items() for k in keys]
    structs = with_members(records, json_fields)

    def source(slot: str) -> Column:
        field, _, key = slot.partition(".")
        if not key:
            return F.when(is_filled(F.col(field)), F.col(field))
        value = _inside(field, key)
        return F.when(_takes_part(value, key), value)

    free = [s for s in slots if s not in known]
    worked = clean_arrays(computed(structs, _values=F.array(*[source(s) for s in free])),
                          "_values", "_clean", config)

    def result(slot: str) -> Column:
        if slot in known:
            kind, value = F.lit(known[slot]), source(slot)
            return F.when(value.isNotNull(), substitute(
                value, kind, mapping_key(value, kind, config.secret), config.locale,
                [known[slot]]))
        return F.col("_clean")[free.index(slot)]

    out = {f: F.coalesce(result(f), F.col(f)).alias(f) for f in fields}
    for f, keys in json_fields.items():
        new = {k: result(f"{f}.{k}") for k in keys}
        changed = F.lit(False)
        for value in new.values():
            changed = changed | value.isNotNull()
        inner = {k: quoted(v) for k, v in new.items() if k not in COORDINATES}
        places = {k: number_or_text(v) for k, v in new.items() if k in COORDINATES}
        if places:
            geo = F.col(f"_{f}_{GEO}")
            inner[GEO] = F.when(geo.isNotNull(), written(geo, places))
        out[f] = F.when(changed, written(F.col(f"_{f}"), inner)).otherwise(F.col(f)).alias(f)
    return worked.select(*[out.get(c, F.col(c)) for c in records.columns])


def summary(records: DataFrame, values: DataFrame, words: DataFrame) -> DataFrame:
    """Records, different values, different values that changed: one row."""
    changed = words.agg(
        F.count("*").alias("unique_values"),
        F.count_if(F.col("value") != F.col("cleaned")).alias("values_anonymized"))
    return changed.withColumn("total_entries", records.agg(F.count("*")).scalar()).withColumn(
        "values", values.agg(F.count("*")).scalar())


def serializable(records: DataFrame) -> DataFrame:
    """Columns fit for JSON: times as ISO text, text, numbers, flags and nulls as they are,
    everything else as text."""

    def one(field: T.StructField) -> Column:
        c, kind = F.col(field.name), field.dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return iso(c)
        if isinstance(kind, T.DateType):
            return F.date_format(c, "yyyy-MM-dd")
        if isinstance(kind, (T.StringType, T.BooleanType, T.NullType, T.ByteType, T.ShortType,
                             T.IntegerType, T.LongType, T.FloatType, T.DoubleType)):
            return c
        if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            return F.to_json(c)
        return c.cast("string")

    return records.select(*[one(f).alias(f.name) for f in records.schema.fields])


def iso(at: Column) -> Column:
    """ISO text; microseconds only when there are any."""
    fraction = F.date_format(at, "SSSSSS")
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)))
