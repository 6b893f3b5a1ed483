"""Configuration tables: which types are cleaned, how, and from which score on."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.patterns import DEFAULT_THRESHOLD
from ..functions.pools import DEFAULT_LOCALE, language_of
from ..functions.strategies import STRATEGIES
from ..schemas import TYPE_CONFIGS
from .cleaning import CleanConfig

# --- fixed values -----------------------------------------------------------
# Types of the default configuration, all with strategy "replace".
DEFAULT_TYPES = (
    "PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "US_SSN", "IP_ADDRESS",
    "LOCATION", "STREET_ADDRESS", "DATE_TIME", "GUID", "COORDINATE",
)
DEFAULT_LANGUAGE = "en"
# --- end of fixed values ----------------------------------------------------


def active(configs: DataFrame) -> DataFrame:
    """The active configuration: the latest updated, then the smallest id."""
    return configs.filter("is_active").orderBy(F.desc("updated_at"), "id").limit(1)


def by_id(configs: DataFrame, number: int) -> DataFrame:
    return configs.filter(F.col("id") == number)


def update(configs: DataFrame, at: Column, threshold: float | None = None,
           language: str | None = None, locale: str | None = None) -> DataFrame:
    """Active rows with the given values set; what is not given stays as it is."""
    if threshold is not None and not 0.0 <= threshold <= 1.0:
        raise ValueError("confidence_threshold must be between 0.0 and 1.0")
    if locale is not None:
        language_of(locale)

    def changed(new: Any, column: str) -> Column:
        old = F.col(column)
        return old if new is None else F.when(F.col("is_active"), F.lit(new)).otherwise(old)

    return configs.select(
        "id", "name", "is_active",
        changed(threshold, "confidence_threshold").alias("confidence_threshold"),
        changed(language, "language").alias("language"),
        changed(locale, "locale").alias("locale"), "created_at",
        F.when(F.col("is_active"), at).otherwise(F.col("updated_at")).alias("updated_at"))


def upsert_types(types: DataFrame, updates: DataFrame) -> DataFrame:
    """Merge per-type rows by (config, type): null leaves a value as it is, a row without
    a type is skipped, a new row is enabled with strategy "replace" unless it says otherwise."""
    allowed = F.col("strategy").isNull() | F.col("strategy").isin(*STRATEGIES)
    new = updates.filter("coalesce(entity_type, '') <> ''").select(
        "config_id", "entity_type", F.col("enabled").alias("e"),
        F.when(allowed, F.col("strategy")).otherwise(
            F.raise_error(F.lit("unknown strategy")).cast("string")).alias("s"),
        F.col("strategy_params").alias("p"))
    return types.join(new, ["config_id", "entity_type"], "full").select(
        "config_id", "entity_type",
        F.coalesce("e", "enabled", F.lit(True)).alias("enabled"),
        F.coalesce("s", "strategy", F.lit("replace")).alias("strategy"),
        F.coalesce("p", "strategy_params").alias("strategy_params"))


def enabled_types(configs: DataFrame, types: DataFrame) -> DataFrame:
    """Enabled types of the active configuration."""
    one = F.broadcast(active(configs).select(F.col("id").alias("config_id")))
    return types.filter("enabled").join(one, "config_id").select("entity_type")


def default_types(configs: DataFrame) -> DataFrame:
    """Rows of the default configuration for every configuration that is active."""
    kinds = F.explode(F.array(*[F.lit(t) for t in DEFAULT_TYPES]))
    return configs.filter("is_active").select(
        F.col("id").alias("config_id"), kinds.alias("entity_type"), F.lit(True).alias("enabled"),
        F.lit("replace").alias("strategy"),
        F.lit(None).cast("map<string,string>").alias("strategy_params"))


def default_config(spark: SparkSession, at) -> tuple[DataFrame, DataFrame]:
    """A first configuration with its types, for a store that has none active."""
    from ..schemas import CONFIGS

    row = [(1, "default", True, DEFAULT_THRESHOLD, DEFAULT_LANGUAGE, DEFAULT_LOCALE, at, at)]
    types = [(1, t, True, "replace", None) for t in DEFAULT_TYPES]
    return spark.createDataFrame(row, CONFIGS), spark.createDataFrame(types, TYPE_CONFIGS)


def backfill_type(configs: DataFrame, types: DataFrame, entity_type: str = "STREET_ADDRESS"
                  ) -> DataFrame:
    """Add a type to active configurations that lack it."""
    have = types.filter(F.col("entity_type") == entity_type).select("config_id")
    lacking = configs.filter("is_active").select(F.col("id").alias("config_id")).join(
        have, "config_id", "left_anti")
    added = lacking.select(
        "config_id", F.lit(entity_type).alias("entity_type"), F.lit(True).alias("enabled"),
        F.lit("replace").alias("strategy"),
        F.lit(None).cast("map<string,string>").alias("strategy_params"))
    return types.unionByName(added)


def backfill_locale(configs: DataFrame) -> DataFrame:
    """Read rows of an older layout: the locale defaults to en_US."""
    if "locale" not in configs.columns:
        return configs.withColumn("locale", F.lit(DEFAULT_LOCALE))
    return configs.withColumn("locale", F.coalesce("locale", F.lit(DEFAULT_LOCALE)))


def strategies_of(types: DataFrame) -> DataFrame:
    """The strategy that applies by type: "replace" when the row is disabled."""
    return types.select(
        "config_id", "entity_type",
        F.when(F.col("enabled"), F.coalesce("strategy", F.lit("replace")))
        .otherwise(F.lit("replace")).alias("strategy"),
        F.when(F.col("enabled"), F.col("strategy_params")).alias("strategy_params"))


def request_defaults(requests: DataFrame, configs: DataFrame) -> DataFrame:
    """Threshold and locale of each request: its own, else the active configuration's,
    else the built-in ones."""
    one = active(configs).select(
        F.struct(F.col("confidence_threshold").alias("threshold"), "locale").alias("c"))
    conf = one.scalar()
    return requests.select(
        "id",
        F.coalesce("threshold", conf["threshold"], F.lit(DEFAULT_THRESHOLD)).alias("threshold"),
        F.coalesce("locale", conf["locale"], F.lit(DEFAULT_LOCALE)).alias("locale"))


_NUMBERS = ("chars_to_mask", "truncate")
_FLAGS = ("from_end", "include_type")


def _typed(params: dict[str, str] | None) -> dict[str, Any] | None:
    """Parameters are stored as text; give each its type back."""
    if params is None:
        return None
    return {k: int(v) if k in _NUMBERS else v.lower() == "true" if k in _FLAGS else v
            for k, v in params.items()}


def load_config(configs: DataFrame, types: DataFrame, secret: str = "") -> CleanConfig:
    """The active configuration as a ``CleanConfig``. Reads at most one row per type.

    None active, or none enabled, means all types: over-detection is the safe side.
    """
    row = active(configs).collect()
    if not row:
        return CleanConfig(secret=secret)
    mine = types.filter((F.col("config_id") == row[0]["id"]) & F.col("enabled")).collect()
    return CleanConfig(
        entity_types=[t["entity_type"] for t in mine] or None,
        threshold=row[0]["confidence_threshold"],
        locale=row[0]["locale"] or DEFAULT_LOCALE,
        secret=secret,
        strategies={t["entity_type"]: (t["strategy"], _typed(t["strategy_params"]))
                    for t in mine if t["strategy"] != "replace"},
    )
