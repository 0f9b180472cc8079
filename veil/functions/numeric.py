"""Binning, calibrated noise and perturbation of numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from veil.errors import PolicyError
from veil.functions.build import REDACTED, Build
from veil.functions.canonical import canon, is_number, is_text
from veil.functions.keyed import gaussian, laplace, uniform


def binned(b: Build, name: str, c: Column, dtype, options: dict) -> Column:
    """``low-high`` of the bin; fractions are cut off toward zero first."""
    size = F.lit(options["bin_size"]).cast("bigint")
    if isinstance(dtype, T.IntegralType):
        whole = c.cast("bigint")
    elif is_number(dtype):
        whole = c.try_cast("bigint")
    elif is_text(dtype):
        if b.lenient(options):
            return b.text(c, dtype, options)
        whole = c.try_cast("double").try_cast("bigint")
    elif b.lenient(options):
        return canon(c, dtype)
    else:
        raise PolicyError(f"{name}: cannot bin {dtype.simpleString()}")
    low = b.bind(F.try_subtract(whole, F.pmod(whole, size)))
    high = F.try_add(low, size - 1)
    label = F.concat(low.cast("string"), F.lit("-"), high.cast("string"))
    return F.when(c.isNull(), F.lit(None)).otherwise(F.coalesce(label, F.lit(REDACTED)))


def _moved(b: Build, c: Column, noise: Column, dtype: T.DataType) -> Column:
    """Value and noise added in the column's own type; null beyond its range.

    A double has 53 bits, so adding there would swallow the noise of larger
    numbers.  Whole numbers are cut off toward zero, as the exact sum would be.
    """
    if isinstance(dtype, T.IntegralType):
        drawn = b.bind(noise, 2)
        cut = drawn.try_cast("bigint")
        whole = cut.cast("double") == drawn
        low = F.try_add(c.cast("bigint"), F.when(whole | (drawn > 0), cut).otherwise(F.try_subtract(cut, F.lit(1))))
        up = (low < 0) & ~whole
        return F.when(up, low + 1).otherwise(low)
    if isinstance(dtype, T.DecimalType):
        return F.try_add(c, noise.try_cast(T.DecimalType(38, dtype.scale)))
    return c.cast("double") + noise


def _unchanged(b: Build, name: str, c: Column, dtype) -> Column:
    if b.settings.parity:
        return c
    raise PolicyError(f"{name}: noise needs a number, not {dtype.simpleString()}")


def noisy(b: Build, name: str, c: Column, dtype, options: dict) -> Column:
    """Differential privacy for one value: noise of scale sensitivity / epsilon."""
    if not is_number(dtype):
        return _unchanged(b, name, c, dtype)
    scale = float(options["sensitivity"]) / float(options["epsilon"])
    mechanism = options["mechanism"] or ("gaussian" if b.settings.parity else "laplace")
    draw = b.draw(name)
    if mechanism == "laplace":
        noise = laplace(b.bind(uniform(draw), 1), scale)
    else:
        noise = gaussian(uniform(draw), uniform(draw, 1), F.lit(scale))
    return _moved(b, c, noise, dtype).try_cast(dtype)


def perturbed(b: Build, name: str, c: Column, dtype, options: dict) -> Column:
    if not is_number(dtype):
        return _unchanged(b, name, c, dtype)
    value = c.cast("double")
    draw = b.draw(name)
    reach = F.abs(value) * F.lit(0.1) if options["range"] is None else F.lit(float(options["range"]))
    sway = F.lit(2.0) * uniform(draw) - F.lit(1.0)
    if options["type"] == "gaussian":
        noise = gaussian(uniform(draw), uniform(draw, 1), reach)
    elif options["type"] == "percentage":
        noise = sway * F.lit(float(options["percentage"]) / 100) * value
    else:
        noise = sway * reach
    moved = _moved(b, c, noise, dtype)
    return (F.abs(moved) if options["non_negative"] else moved).try_cast(dtype)
