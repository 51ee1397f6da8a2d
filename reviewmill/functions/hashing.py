"""Seeded uniforms derived from row keys, equal on every run and every cluster."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_STEPS = 2**52  # 13 hex digits, exact in a double


def seeded_uniform(seed: int, *key: Column) -> Column:
    """Uniform number in (0, 1) made from the md5 of seed and key."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key]))
    step = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return (step + 1.0) / F.lit(float(_STEPS + 1))


def exponential_key(uniform: Column, weight: Column) -> Column:
    """Sampling key: the rows with the smallest keys form a weighted sample without replacement."""
    return -F.log(uniform) / weight
