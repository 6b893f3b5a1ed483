"""What to do with a value: replace, mask, hash, redact.

A strategy is a function ``(value, entity_type, params) -> Column`` with a check
of its parameters on the driver, so its work stays inside Catalyst. Callers add
their own with ``register``; a ``pandas_udf`` may be returned as well.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, functions as F

from .keys import mapping_key
from .pools import DEFAULT_LOCALE
from .substitutes import substitute

Params = dict[str, Any]
HASH_TYPES = ("sha256", "sha512", "md5")


@dataclass(frozen=True)
class Strategy:
    name: str
    apply: Callable[[Column, Column, Params], Column]
    validate: Callable[[Params], None]


def _replace(value: Column, entity_type: Column, params: Params) -> Column:
    key = params.get("key")  # where the caller has it already
    if key is None:
        key = mapping_key(value, entity_type, params.get("secret", ""))
    return substitute(value, entity_type, key, params.get("locale", DEFAULT_LOCALE),
                      params.get("types"), params.get("unique", False), params.get("secret", ""))


def _check_replace(params: Params) -> None:
    if not isinstance(params.get("secret", ""), str):
        raise ValueError("secret must be text")
    from .pools import language_of

    language_of(params.get("locale", DEFAULT_LOCALE))


def _mask(value: Column, entity_type: Column, params: Params) -> Column:
    char = params.get("masking_char", "*")
    length = F.length(value)
    wanted = params.get("chars_to_mask")
    n = F.greatest(length - 4, F.lit(0)) if wanted is None else F.least(F.lit(wanted), length)
    stars = F.repeat(F.lit(char), n)
    if params.get("from_end", False):
        return F.concat(F.substring(value, F.lit(1), length - n), stars)
    return F.concat(stars, F.substring(value, n + 1, length))


def _check_mask(params: Params) -> None:
    n = params.get("chars_to_mask")
    if n is not None and (isinstance(n, bool) or not isinstance(n, int) or n < 0):
        raise ValueError("chars_to_mask must be a non-negative integer")
    char = params.get("masking_char", "*")
    if not isinstance(char, str) or len(char) != 1:
        raise ValueError("masking_char must be a single character")


def _hash(value: Column, entity_type: Column, params: Params) -> Column:
    kind = params.get("hash_type", "sha256")
    digest = (
        F.md5(value.cast("binary")) if kind == "md5"
        else F.sha2(value, 512 if kind == "sha512" else 256)
    )
    keep = params.get("truncate")
    return F.substring(digest, 1, keep) if keep else digest


def _check_hash(params: Params) -> None:
    if params.get("hash_type", "sha256") not in HASH_TYPES:
        raise ValueError(f"hash_type must be one of: {', '.join(HASH_TYPES)}")
    keep = params.get("truncate")
    if keep is not None and (isinstance(keep, bool) or not isinstance(keep, int) or keep <= 0):
        raise ValueError("truncate must be a positive integer or None")


def _redact(value: Column, entity_type: Column, params: Params) -> Column:
    if params.get("include_type", False):
        return F.format_string("[%s_REDACTED]", entity_type)
    return F.when(value.isNotNull(), F.lit(params.get("placeholder", "[REDACTED]")))


def _check_redact(params: Params) -> None:
    if not isinstance(params.get("placeholder", "[REDACTED]"), str):
        raise ValueError("placeholder must be text")


STRATEGIES: dict[str, Strategy] = {
    "replace": Strategy("replace", _replace, _check_replace),
    "mask": Strategy("mask", _mask, _check_mask),
    "hash": Strategy("hash", _hash, _check_hash),
    "redact": Strategy("redact", _redact, _check_redact),
}


def register(strategy: Strategy) -> None:
    STRATEGIES[strategy.name] = strategy


def apply_strategy(name: str, value: Column, entity_type: Column, params: Params | None = None
                   ) -> Column:
    """Check the parameters, then build the column."""
    if name not in STRATEGIES:
        raise ValueError(f"strategy must be one of: {', '.join(STRATEGIES)}")
    strategy = STRATEGIES[name]
    strategy.validate(params or {})
    return strategy.apply(value, entity_type, params or {})


def by_type(
    value: Column,
    entity_type: Column,
    choices: dict[str, tuple[str, Params | None]],
    replace_params: Params | None = None,
) -> Column:
    """The strategy configured for each type; ``replace`` where none is."""
    fallback = apply_strategy("replace", value, entity_type, replace_params)
    branch = None
    for name, (strategy, params) in choices.items():
        if strategy == "replace":
            continue
        out = apply_strategy(strategy, value, entity_type, params)
        branch = (F.when(entity_type == name, out) if branch is None
                  else branch.when(entity_type == name, out))
    return fallback if branch is None else branch.otherwise(fallback)
