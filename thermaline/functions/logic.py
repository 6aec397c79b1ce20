"""Column helpers shared by rules and analytics: normalisation, proof ladders, occupancy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from thermaline.functions.roles import UNOCCUPIED_TOKENS, UNOCCUPIED_TOKENS_ZONE


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(x) -> Column:
    """A double literal: Spark would otherwise type some literals as DECIMAL or INT."""
    return F.lit(float(x))


def frac(c) -> Column:
    """Command or position as 0..1: readings above 1 are percentages."""
    c = col(c)
    return F.when(c > num(1), c / num(100)).otherwise(c)


def frac15(c) -> Column:
    """As `frac`, but only readings of 1.5 and above count as percentages."""
    c = col(c)
    return F.when(c >= num(1.5), c / num(100)).otherwise(c)


def percent(c) -> Column:
    """Command or position as 0..100."""
    c = col(c)
    return F.when(c > num(1), c).otherwise(c * num(100))


def holds(pred: Column) -> Column:
    """Three-valued predicate to plain boolean: unknown is False."""
    return F.coalesce(pred, F.lit(False))


def present(*cols) -> Column:
    return reduce(lambda a, b: a & b, [col(c).isNotNull() for c in cols])


def any_of(preds) -> Column:
    """OR over predicates, unknown treated as False."""
    return holds(reduce(lambda a, b: a | b, list(preds)))


def smaller(a, b) -> Column:
    a, b = col(a), col(b)
    return F.when(a < b, a).otherwise(b)


# Proof ladders: the first mapped signal decides, `default` when none is mapped.
def fan_on(default: bool | None = True, *, command: float = 0.01) -> Column:
    return F.coalesce(F.col("fan_status") > num(0.05), frac("fan_cmd") > num(command),
                      F.lit(default).cast("boolean"))


def energized() -> Column:
    return F.coalesce(
        F.col("fan_status") > num(0.05), frac("fan_cmd") > num(0.01),
        F.col("pump_status") > num(0.05), frac("chw_pump_cmd") > num(0.05),
        F.col("chiller_status") > num(0.05), F.lit(True))


def hydronic_on(*, flow: bool = True) -> Column:
    steps = [F.col("pump_status") > num(0.05), F.col("chiller_status") > num(0.05)]
    if flow:
        steps.append(F.col("chw_flow") > num(1))
    return F.coalesce(*steps, frac("chw_pump_cmd") > num(0.05), F.lit(False))


def chiller_proof() -> Column:
    return F.coalesce(
        F.col("pump_status") > num(0.05), F.col("chiller_status") > num(0.05),
        F.col("chiller_current") > num(0.5), F.col("chiller_amps") > num(0.5),
        F.col("chiller_power") > num(0.5), F.col("chw_flow") > num(1),
        frac("chw_pump_cmd") > num(0.05), F.lit(False))


def token(c="occ_mode") -> Column:
    return F.lower(F.trim(col(c)))


def unoccupied(c="occ_mode", *, zone: bool = False) -> Column:
    """True when the text is an unoccupied token; NULL text stays NULL."""
    return token(c).isin(UNOCCUPIED_TOKENS_ZONE if zone else UNOCCUPIED_TOKENS)


def unoccupied_or_zero(c="occ_mode") -> Column:
    """Unoccupied token, or a number at or below 0.05."""
    return holds(unoccupied(c)) | holds(F.trim(col(c)).try_cast("double") <= num(0.05))


def epoch(c="timestamp_utc") -> Column:
    """Seconds since 1970 as a double with microsecond resolution."""
    return F.unix_micros(col(c)) / num(1e6)
