"""Origin of names that no dictionary holds, by the letters they are made of.

Spark counts in how many parts of a dictionary ``(part, kind, country, score)`` each run of
three letters occurs, by country; a name belongs to the country under which its runs are
likeliest. Runs are kept in a fixed number of buckets and log-likelihoods as integers, so
the model has a proven size (buckets x countries) and sums do not depend on their order.
It is looked up in the row that holds the name: names in texts stay where they are.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .names import name_pools

BUCKETS = 1 << 15
#: Added to every count; likelihoods are kept in thousandths.
SMOOTHING, SCALE = 0.05, 1000

_SPACE = re.compile("[ \t\n\r\x0b\f]+")


def grams(part: Column) -> Column:
    """Runs of three letters of a part with its ends marked."""
    marked = F.concat(F.lit("^"), F.lower(part), F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(part)),
                       lambda i: F.substring(marked, i, F.lit(3)))


def bucket(gram: Column) -> Column:
    return F.conv(F.substring(F.md5(gram), 1, 4), 16, 10).cast("int") % BUCKETS


def weights(dictionary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bucket, country, more) and (country, base): a run of a country weighs ``base + more``,
    and ``base`` alone if it was never seen there."""
    parts = dictionary.filter(F.length("part") > 0).select(
        F.lower("part").alias("part"), "country").distinct()
    counted = materialize(
        parts.select("country", F.explode(grams(F.col("part"))).alias("gram"))
        .groupBy("country", bucket(F.col("gram")).alias("bucket")).agg(F.count("*").alias("n")),
        "runs")
    log = lambda n, total: F.round(SCALE * F.log(
        (n + SMOOTHING) / (total + SMOOTHING * BUCKETS))).cast("long")
    totals = counted.groupBy("country").agg(F.sum("n").alias("total"))
    base = totals.select("country", "total", log(F.lit(0), F.col("total")).alias("base"))
    more = counted.join(F.broadcast(base), "country").select(
        "bucket", "country", (log(F.col("n"), F.col("total")) - F.col("base")).alias("more"))
    return more, base.select("country", "base")


class OriginModel:
    """A fitted model and the names to choose from, sent to the tasks."""

    def __init__(self, dictionary: DataFrame, names: int = 100):
        more, base = weights(dictionary)
        bases = sorted((r["country"], r["base"]) for r in base.collect())
        countries = [c for c, _ in bases]
        table = np.zeros((BUCKETS, len(countries)), np.int32)
        at = {c: i for i, c in enumerate(countries)}
        for r in more.collect():
            table[r["bucket"], at[r["country"]]] = r["more"]
        latin = {r["country"]: r for r in name_pools(dictionary, names, True).collect()}
        pools = {r["country"]: (r["firsts"], r["lasts"], *(
            (latin[r["country"]]["firsts"], latin[r["country"]]["lasts"]) if r["country"] in latin else ([], [])))
            for r in name_pools(dictionary, names).collect()}
        self.name = uuid.uuid4().hex
        self.sent = dictionary.sparkSession.sparkContext.broadcast(
            (countries, np.array([b for _, b in bases], np.int64), table, pools))

    def __repr__(self) -> str:
        return f"OriginModel({self.name})"

    def country(self, name: Column) -> Column:
        """The likeliest country (ties: first code); null for names without a part of two letters."""
        sent = self.sent

        def told(names: pa.Array) -> pa.Array:
            return pa.array([origin_of(x.as_py(), sent.value) for x in names], pa.string())

        return F.arrow_udf(told, "string")(name)

    def names(self, values: Column, secret: str = "") -> Column:
        """For an array of names: a name of the same origin and script each, or null."""
        sent = self.sent

        def chosen(rows: pa.Array) -> pa.Array:
            return pa.array([None if row is None else [name_for(v, sent.value, secret) for v in row]
                             for row in rows.to_pylist()], pa.list_(pa.string()))

        return F.arrow_udf(chosen, "array<string>")(values)


@lru_cache(maxsize=100_000)
def _bucket(gram: str) -> int:
    return int(hashlib.md5(gram.encode()).hexdigest()[:4], 16) % BUCKETS


def origin_of(name: str | None, model: tuple) -> str | None:
    countries, base, table, _ = model
    runs = [_bucket(marked[i:i + 3]) for part in _SPACE.split(name or "") if len(part) >= 2
            for marked in (f"^{part.lower()}$",) for i in range(len(part))]
    if not runs or not countries:
        return None
    return countries[int((table[runs].sum(axis=0, dtype=np.int64) + len(runs) * base).argmax())]


def latin(name: str) -> bool:
    counted = len(re.sub(r"[\s\-'.]", "", name))
    return not counted or len(re.sub("[^A-Za-zÀ-ɏ]", "", name)) / counted > 0.8


def name_for(name: str | None, model: tuple, secret: str = "") -> str | None:
    """Drawn by the key of the name, as all substitutes are; null without names to draw from."""
    country = origin_of(name, model)
    pool = model[3].get(country)
    if pool is None:
        return None
    firsts, lasts = pool[2:] if latin(name) else pool[:2]
    if not firsts or not lasts:
        return None
    key = hashlib.sha256(f"{secret}{name}|PERSON".encode()).hexdigest()
    return f"{firsts[int(key[:8], 16) % len(firsts)]} {lasts[int(key[8:16], 16) % len(lasts)]}"


def origin_with_model(names: DataFrame, known: DataFrame, model: OriginModel, row_id: str,
                      name: str = "name") -> DataFrame:
    """``known`` (from ``name_origin``) with a row more, its score null, for each name that the
    dictionary says nothing about."""
    rest = names.join(known.select(row_id), row_id, "left_anti").select(
        row_id, model.country(F.col(name)).alias("country"))
    return known.unionByName(rest.filter("country is not null").withColumn(
        "score", F.lit(None).cast("long")))
