"""Sums of squares and products about the mean, from whole numbers."""

from __future__ import annotations

from pyspark.sql import Column


def spread(n: Column, products: Column, one: Column, two: Column) -> Column:
    """n * products - one * two as a double, rounded once: products of two sums of whole numbers pass 64 bits from some
    hundred thousand rows on, so they are made as decimals of 38 digits."""
    a, b, c, d = (x.cast("decimal(19,0)") for x in (n, products, one, two))
    return (a * b - c * d).cast("double")
