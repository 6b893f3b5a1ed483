"""Origin of names by a dictionary ``(part, kind, country, score)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.arrays import let
from ..functions.keys import draw, mapping_key
from ..functions.names import is_latin
from ..functions.pools import DEFAULT_LANGUAGE
from ..functions.substitutes import person
from .skew import keyed_join


def scores_by_part(dictionary: DataFrame) -> DataFrame:
    """One row per name part with its score in every country, first and last names added up."""
    summed = dictionary.groupBy("part", "country").agg(F.sum("score").alias("score"))
    return summed.groupBy("part").agg(
        F.collect_list(F.struct("country", "score")).alias("scores"))


def name_origin(names: DataFrame, dictionary: DataFrame, row_id: str, name: str = "name"
                ) -> DataFrame:
    """The country with the highest total score over the parts of a name.

    Parts of one character are skipped; ties go to the first country code. A part
    that is in no country adds nothing; a name without any gets no row.
    """
    words = F.filter(F.split(F.trim(F.col(name)), r"\s+"), lambda w: F.length(w) >= 2)
    parts = names.select(row_id, F.explode_outer(words).alias("part")).filter(
        F.col("part").isNotNull())
    scored = keyed_join(parts, scores_by_part(dictionary), "part", row_id)
    totals = (
        scored.select(row_id, F.explode_outer("scores").alias("s"))
        .groupBy(row_id, "s.country")
        .agg(F.sum("s.score").alias("score"))
    )
    best = F.min(F.struct((-F.col("score")).alias("neg"), F.col("country")))
    return totals.groupBy(row_id).agg(best.alias("best")).select(
        row_id, F.col("best.country").alias("country"), (-F.col("best.neg")).alias("score"))


def top_names(dictionary: DataFrame, n: int = 100, latin_only: bool = False) -> DataFrame:
    """The best-scored ``n`` parts of each country and kind, best first."""
    kept = dictionary.filter(is_latin(F.col("part"))) if latin_only else dictionary
    order = Window.partitionBy("country", "kind").orderBy(F.desc("score"), "part")
    return kept.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def name_pools(dictionary: DataFrame, n: int = 100, latin_only: bool = False) -> DataFrame:
    """One row per country: at most ``n`` first and ``n`` last names, in order."""
    top = top_names(dictionary, n, latin_only)

    def pool(kind: str) -> Column:
        listed = F.collect_list(F.when(F.col("kind") == kind, F.struct("place", "part")))
        return F.transform(F.array_sort(listed), lambda x: x["part"])

    return top.groupBy("country").agg(pool("first").alias("firsts"), pool("last").alias("lasts"))


def person_substitutes(names: DataFrame, dictionary: DataFrame, row_id: str, name: str = "name",
                       n: int = 100, secret: str = "") -> DataFrame:
    """A substitute from the country of each name, Latin when the name is.

    Names without an origin, or from a country without both kinds, get a generic one.
    """
    origin = name_origin(names, dictionary, row_id, name).select(row_id, "country")
    latin = name_pools(dictionary, n, True).select(
        "country", F.col("firsts").alias("lf"), F.col("lasts").alias("ll"))
    # One row per country, each with at most 4 n names.
    pools = F.broadcast(name_pools(dictionary, n).join(latin, "country", "left"))
    key = mapping_key(F.col(name), F.lit("PERSON"), secret)
    joined = names.join(origin, row_id, "left").join(pools, "country", "left")

    def chosen(h: Column) -> Column:
        wants_latin = is_latin(F.col(name))
        firsts = F.when(wants_latin, F.col("lf")).otherwise(F.col("firsts"))
        lasts = F.when(wants_latin, F.col("ll")).otherwise(F.col("lasts"))
        take = lambda pool, k: F.element_at(
            pool, (draw(h, k) % F.size(pool) + 1).cast("int"))
        return F.when((F.size(firsts) > 0) & (F.size(lasts) > 0),
                      F.concat(take(firsts, 0), F.lit(" "), take(lasts, 1))).otherwise(
            person(h, DEFAULT_LANGUAGE))

    return joined.select(row_id, "country", let(key, chosen).alias("substitute"))


