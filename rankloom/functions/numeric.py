"""Numeric columns: click rates, estimates, vectors, saturation, token cost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom import fixed_values as fv
from rankloom.functions.binding import bind
from rankloom.settings import GapSettings, Thresholds


def half_even(value: Column, places: int = 0) -> Column:
    return F.bround(value, places)


def half_even_int(value: Column) -> Column:
    return F.bround(value, 0).cast("int")


def fixed_text(value: Column, places: int) -> Column:
    """Number text with a set number of decimals, halves going to the even digit."""
    return F.format_string(f"%.{places}f", F.bround(value.cast("double"), places))


def ctr_at(position: Column, s: GapSettings) -> Column:
    """Click rate at a position; 0 when unranked or below the published table."""
    curve = s.click_curve
    rates = F.array(*[F.lit(float(r)) for r in curve])
    inside = position.isNotNull() & (position >= 1) & (position <= len(curve))
    return F.when(inside, F.try_element_at(rates, position.cast("int"))).otherwise(F.lit(0.0))


def share_ratio(country: Column, s: GapSettings) -> Column:
    """Main-engine searches per source-engine search; null when unknown or switched off."""
    if not s.estimate_visits:
        return F.lit(None).cast("double")
    ratio = F.when(F.lit(False), F.lit(0.0))
    for code, value in s.share_ratios.items():
        ratio = ratio.when(F.upper(country) == code, F.lit(value))
    return ratio


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two unit vectors."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def unit(vector: Column) -> Column:
    def scaled(v: Column) -> Column:
        norm = F.sqrt(
            F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
        )
        scale = F.when(norm == 0, F.lit(1.0)).otherwise(norm)
        return bind(
            F.struct(v.alias("v"), scale.alias("scale")),
            lambda p: F.transform(p["v"], lambda x: x / p["scale"]),
        )

    return bind(vector, scaled)


def saturation(n: Column, k: float) -> Column:
    return n / (n + F.lit(k))


def bucket_for(share: Column, t: Thresholds) -> Column:
    return (
        F.when(share >= t.must_share, "must")
        .when(share >= t.worth_share, "worth")
        .otherwise("rare")
    )


def token_cost(model: Column, prompt: Column, cached: Column, output: Column) -> Column:
    """USD of one model call; unknown models cost nothing. Cached prompt tokens are cheaper."""
    cost = F.when(F.lit(False), F.lit(0.0))
    for name, (miss, hit, out) in fv.TOKEN_PRICES.items():
        usd = (prompt - cached) * F.lit(miss) + cached * F.lit(hit) + output * F.lit(out)
        cost = cost.when(model == name, usd / F.lit(1_000_000.0))
    return cost.otherwise(F.lit(0.0))


def ordered_sum(pairs: Column, value: str) -> Column:
    """Sum of a field over an array of structs in array order, so the result is repeatable."""
    return F.aggregate(
        F.transform(F.array_sort(pairs), lambda x: x[value].cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
