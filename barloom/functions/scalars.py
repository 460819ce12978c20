"""Per-row column expressions: candle shape, safe ratios, level facts, costs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

C = F.col


def _c(x) -> Column:
    return C(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(x))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def safe_ratio(num, den) -> Column:
    """num / den, null for a zero or non-finite part or result."""
    n, d = _c(num).cast("double"), _c(den).cast("double")
    r = F.try_divide(n, d)
    return F.when(finite(n) & finite(d) & (d != 0) & finite(r), r)


def sign_of(open_="open", close="close") -> Column:
    o, c = _c(open_), _c(close)
    return F.when(c > o, 1).when(c < o, -1).otherwise(0)


def direction_of(open_="open", close="close") -> Column:
    o, c = _c(open_), _c(close)
    return F.when(c > o, "BULLISH").when(c < o, "BEARISH").otherwise("FLAT")


def candle_geometry(o="open", h="high", l="low", c="close") -> dict[str, Column]:
    o, h, l, c = map(_c, (o, h, l, c))
    rng, body = h - l, F.abs(c - o)
    return {
        "candle_range": rng, "body_size": body, "body_ratio": F.try_divide(body, rng),
        "upper_wick": h - F.greatest(o, c), "lower_wick": F.least(o, c) - l,
        "body_midpoint": (o + c) / 2, "close_location": F.try_divide(c - l, rng), "candle_direction": sign_of(o, c),
    }


# fixed values: the three projected coordinates of the common level family
COMMON_LEVELS = (("NEG_3_0", -3.0), ("NEG_3_3", -3.3), ("NEG_3_5", -3.5))


def project_levels(open_="open", close="close", levels=COMMON_LEVELS) -> Column:
    """array<struct<level_id, coordinate, level_price>> from a block body."""
    o, c = _c(open_), _c(close)
    spec = F.array(*[F.struct(F.lit(i).alias("level_id"), F.lit(x).alias("coordinate")) for i, x in levels])
    return F.transform(spec, lambda s: F.struct(
        s["level_id"].alias("level_id"), s["coordinate"].alias("coordinate"),
        (o + s["coordinate"] * (o - c)).alias("level_price")))


def position_of(value, price) -> Column:
    v, p = _c(value), _c(price)
    return F.when(v > p, "ABOVE").when(v < p, "BELOW").otherwise("AT")


def observe_level(price="level_price", o="open", h="high", l="low", c="close") -> dict[str, Column]:
    p, o, h, l, c = map(_c, (price, o, h, l, c))
    touched = (l <= p) & (p <= h)
    body = (F.least(o, c) <= p) & (p <= F.greatest(o, c))
    return {
        "open_position": position_of(o, p), "close_position": position_of(c, p),
        "range_touched": touched, "body_touched": body, "traded_above": h > p, "traded_below": l < p,
        "straddled": (h > p) & (l < p), "body_crossed": ((o > p) & (c < p)) | ((o < p) & (c > p)),
        "wick_only": touched & ~body,
    }


def measure_level(level, atr, h="high", l="low", c="close") -> dict[str, Column]:
    p, a, h, l, c = map(_c, (level, atr, h, l, c))
    parts = {
        "close_distance": c - p,
        "range_distance": F.when(l > p, l - p).when(h < p, h - p).otherwise(0.0),
        "penetration_above": F.greatest(F.lit(0.0), h - p),
        "penetration_below": F.greatest(F.lit(0.0), p - l),
    }
    out = {}
    for name, value in parts.items():
        value = F.when(p.isNotNull(), value)
        out[f"{name}_price"] = value
        out[f"{name}_atr"] = safe_ratio(value, a)
    return out


def candle_shape(reference, o="open", h="high", l="low", c="close") -> dict[str, Column]:
    ref, o, h, l, c = map(_c, (reference, o, h, l, c))
    span = h - l
    return {
        "direction": F.when(o.isNotNull(), direction_of(o, c)),
        "range_fraction": F.try_divide(span, F.abs(ref)),
        "body_to_range": F.when(span > 0, F.abs(c - o) / span),
        "close_location": F.when(span > 0, (c - l) / span),
    }


def spread_distance(mode: str = "BAR", *, fixed: float = 0.0, bar_spread="spread", point: float = 1.0) -> Column:
    """Price distance between bid and ask: ZERO, FIXED price, or BAR points times point size."""
    return {"ZERO": F.lit(0.0), "FIXED": F.lit(float(fixed)),
            "BAR": F.greatest(F.lit(0.0), _c(bar_spread).cast("double")) * point}[mode]


def trade_costs(spread: Column, quantity="quantity", *, commission_mode: str = "ZERO", commission: float = 0.0,
                slippage: float = 0.0) -> dict[str, Column]:
    """Cash costs of one trade: spread and slippage scale with quantity, commission by mode."""
    q = _c(quantity)
    fee = {"ZERO": F.lit(0.0), "PER_TRADE": F.lit(float(commission)), "PER_LOT_SIDE": F.lit(float(commission)) * q * 2}[commission_mode]
    return {"spread_cost": spread * q, "commission_cost": fee, "slippage_cost": F.lit(float(slippage)) * q}


def posterior_scores(p: Column) -> dict[str, Column]:
    """max, top-two margin and natural entropy (0 ln 0 = 0) of a probability array."""
    top = F.sort_array(p, asc=False)
    return {
        "max_posterior": F.array_max(p), "margin": F.element_at(top, 1) - F.element_at(top, 2),
        "entropy": F.aggregate(p, F.lit(0.0), lambda acc, x: acc - F.when(x > 0, x * F.ln(x)).otherwise(0.0)),
    }


def normal_quantile(p: float) -> float:
    from statistics import NormalDist
    return NormalDist().inv_cdf(p)


def wilson_interval(wins, n, confidence: float = 0.95) -> dict[str, Column]:
    w, n = _c(wins).cast("double"), _c(n).cast("double")
    z = normal_quantile(0.5 + confidence / 2)
    p, den = w / n, 1 + z * z / n
    mid = (p + z * z / (2 * n)) / den
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / den
    ok = n > 0
    return {"wilson_low": F.when(ok, F.greatest(F.lit(0.0), mid - half)),
            "wilson_high": F.when(ok, F.least(F.lit(1.0), mid + half))}


def typed_category(kind: str, value) -> Column:
    """JSON pair [type, text], so 1, 1.0, true and "1" stay different groups."""
    return F.to_json(F.array(F.lit(kind), _c(value).cast("string")))


def canonical_json(cols) -> Column:
    return F.to_json(F.struct(*[C(c) for c in sorted(cols)]), {"ignoreNullFields": "false"})


def fingerprint(cols) -> Column:
    return F.sha2(canonical_json(cols), 256)


# fixed values of the resampling mixer: a prime modulus, three multipliers, two closing rounds
MIX_P, MIX_A, MIX_B, MIX_C = 2147483647, 1103515245, 48271, 69621
MIX_ROUNDS = (7, 11)


def mix_start(seed: int) -> int:
    return (seed * MIX_A + 12345) % MIX_P


def with_mix(df: DataFrame, name: str, seed: int, *parts) -> DataFrame:
    """Add a portable pseudo-random integer in [0, 2^31-1) derived from integer parts.

    Pure BIGINT arithmetic (products stay below 2^62), so draws depend only on their
    coordinates, never on partitioning or retries, and any SQL engine can repeat them.
    One column per round keeps the expression linear in size and inside codegen.
    """
    x = F.lit(mix_start(seed)).cast("long")
    for part in (*parts, *MIX_ROUNDS):
        df = df.withColumn("_mix", (x * MIX_B + F.pmod(_c(part).cast("long"), F.lit(MIX_P)) * MIX_C + 1) % MIX_P)
        df = df.withColumn("_mix", (C("_mix") * C("_mix") + MIX_A) % MIX_P)
        x = C("_mix")
    return df.withColumn(name, (x * MIX_B) % MIX_P).drop("_mix")
