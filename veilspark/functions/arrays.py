"""Array building blocks that stay inside Catalyst.

Everything here is linear in the size of its input. The plain way to carry a
running value through ``aggregate`` copies the array built so far at every
step, which is quadratic; ``running`` works on blocks instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

_BLOCK = 64
_CHUNK = 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Without it an expression used inside a lambda is evaluated per element. Each
    level of nesting costs the analyzer a few rounds, so chains of steps over a
    table are columns of their own instead (see ``operators.cleaning``).
    """
    return F.transform(F.array(value), body)[0]


def by_name(name: Column, branches: dict[str, Column], last: Column, few: int = 3) -> Column:
    """The branch of a name, ``last`` for null or another one. Names are halved down to a
    ``few``: a chain of tests compares with every name ahead of the right one."""
    names = sorted(branches)
    if len(names) > few:
        low, high = names[:len(names) // 2], names[len(names) // 2:]
        return F.when(name < high[0], by_name(name, {n: branches[n] for n in low}, last, few)
                      ).otherwise(by_name(name, {n: branches[n] for n in high}, last, few))
    out = last
    for n in reversed(names):
        out = F.when(name == n, branches[n]).otherwise(out)
    return out


def running(
    values: Column, zero: Column, step: Callable[[Column, Column], Column], dtype: str
) -> Column:
    """Exclusive running fold: item ``i`` is the fold of the items before ``i``."""

    def scan(items: Column, start: Column) -> Column:
        state = F.struct(start.alias("total"), F.array().cast(f"array<{dtype}>").alias("seen"))
        return F.aggregate(
            items,
            state,
            lambda acc, item: F.struct(
                step(acc["total"], item).alias("total"),
                F.concat(acc["seen"], F.array(acc["total"])).alias("seen"),
            ),
            lambda acc: acc["seen"],
        )

    def blocked(items: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(items) - 1) / _BLOCK).cast("int")),
            lambda b: F.slice(items, b * _BLOCK + 1, F.lit(_BLOCK)),
        )
        return let(
            blocks,
            lambda bs: F.flatten(
                F.zip_with(
                    bs,
                    scan(F.transform(bs, lambda b: F.aggregate(b, zero, step)), zero),
                    scan,
                )
            ),
        )

    return let(values, lambda v: F.when(F.size(v) <= _BLOCK, scan(v, zero)).otherwise(blocked(v)))


def running_sum(values: Column) -> Column:
    return running(values, F.lit(0), lambda a, b: a + b, "int")


def running_max(values: Column) -> Column:
    return running(values, F.lit(0), lambda a, b: F.greatest(a, b), "int")


def chunks(text: Column) -> Column:
    """Cut a text into pieces of equal code point count, in one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))


def piece(parts: Column, start: Column, end: Column) -> Column:
    """``text[start:end]`` read from ``chunks(text)``.

    ``substring`` walks from the beginning of the text each time; this walks at
    most one chunk, so cutting a long text at many places stays linear.
    """
    first = F.floor(start / _CHUNK).cast("int")
    last = F.floor((end - 1) / _CHUNK).cast("int")
    near = F.array_join(F.slice(parts, first + 1, last - first + 1), "")
    whole = F.substring(F.get(parts, F.lit(0)), start + 1, end - start)  # most texts are one
    return F.when(end > start, F.when(F.size(parts) == 1, whole).otherwise(
        F.substring(near, start % _CHUNK + 1, end - start))).otherwise(F.lit(""))
