"""Repeatable draws: values that look random but depend only on a row's key.

The same key gives the same draw on every run, partitioning and engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_RANGE = 1 << 32


def key_hash(key: Column | str, slot: int = 0) -> Column:
    """An integer in [0, 2**32) taken from the md5 of ``key``.

    One md5 holds four independent draws: slots 0 to 3 read its four 8-digit groups, and every
    further four slots hash the key once more under a new label.
    """
    key = F.col(key) if isinstance(key, str) else key
    text = key.cast("string")
    if slot >= 4:
        text = F.concat(text, F.lit(f"#{slot // 4}"))
    digits = F.substring(F.md5(text), 1 + 8 * (slot % 4), 8)
    return F.conv(digits, 16, 10).cast("bigint")


def with_draws(df: DataFrame, key: str, count: int, prefix: str) -> DataFrame:
    """Columns ``<prefix>0`` to ``<prefix><count - 1>`` with the hashes of slots 0 to ``count`` - 1.

    Each md5 becomes a column first, so four draws share one and a draw used twice is made once.
    """
    text = F.col(key).cast("string")
    digests = {
        f"{prefix}md5_{i}": F.md5(text if i == 0 else F.concat(text, F.lit(f"#{i}"))) for i in range((count + 3) // 4)
    }
    hashed = df.select("*", *[c.alias(n) for n, c in digests.items()])
    draws = [
        F.conv(F.substring(F.col(f"{prefix}md5_{i // 4}"), 1 + 8 * (i % 4), 8), 16, 10).cast("bigint").alias(f"{prefix}{i}")
        for i in range(count)
    ]
    return hashed.select(*df.columns, *draws)


def as_unit(draw: Column) -> Column:
    """A hash as a double in [0, 1)."""
    return draw.cast("double") / F.lit(float(HASH_RANGE))


def key_unit(key: Column | str, slot: int = 0) -> Column:
    """A double in [0, 1) from the key."""
    return as_unit(key_hash(key, slot))


def pick_from_array(values: Column | str, key: Column | str, slot: int = 0) -> Column:
    """One element of an array column chosen by the key; null when the array is null or empty."""
    values = F.col(values) if isinstance(values, str) else values
    size = F.size(values)
    position = (F.pmod(key_hash(key, slot), size) + 1).cast("int")
    return F.when(size > 0, F.element_at(values, position))


def pick_literal(choices: Sequence[str], draw: Column) -> Column:
    """One of a short fixed list of choices, all equally likely, by a hash."""
    position = (F.pmod(draw, F.lit(len(choices)).cast("bigint")) + 1).cast("int")
    return F.element_at(F.array(*[F.lit(c) for c in choices]), position)


def weighted_choice(choices: Sequence, weights: Sequence[float], unit: Column) -> Column:
    """A choice in proportion to its weight, for a draw ``unit`` in [0, 1)."""
    if not choices or len(choices) != len(weights):
        raise ValueError("need one weight per choice")
    if any(w < 0 for w in weights) or sum(weights) <= 0:
        raise ValueError("weights must be non-negative with a positive sum")
    total = float(sum(weights))
    bounds, running = [], 0.0
    for weight in weights:
        running += weight
        bounds.append(running / total)
    positive = [i for i, w in enumerate(weights) if w > 0]
    chosen = F.lit(choices[positive[-1]])
    for i in reversed(positive[:-1]):
        chosen = F.when(unit < F.lit(bounds[i]), F.lit(choices[i])).otherwise(chosen)
    return chosen


def weighted_from_arrays(choices: Column | str, weights: Column | str, unit: Column) -> Column:
    """Like :func:`weighted_choice` with the choices and weights in array columns of each row."""
    choices = F.col(choices) if isinstance(choices, str) else choices
    weights = F.col(weights) if isinstance(weights, str) else weights
    doubles = F.transform(weights, lambda w: w.cast("double"))
    total = F.aggregate(doubles, F.lit(0.0), lambda acc, w: acc + w)
    # Running sums are at most as long as the array; the first one above the draw wins.
    bounds = F.transform(
        F.sequence(F.lit(1), F.size(doubles)),
        lambda i: F.aggregate(F.slice(doubles, F.lit(1), i), F.lit(0.0), lambda acc, w: acc + w) / total,
    )
    before = F.size(F.filter(bounds, lambda b: b <= unit))
    return F.when(
        (F.size(choices) > 0) & (total > 0),
        F.element_at(choices, F.least(before + 1, F.size(choices)).cast("int")),
    )
