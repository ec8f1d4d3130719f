"""Numbers: rounding, rates, expected scores, decay and discounts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the rating rules.
INITIAL_RATING = 1500.0
K_BASE = 32.0
K_FINISH = 40.0
DECAY_PERIOD_DAYS = 180
DECAY_FLOOR = 1400.0
SIGMA_COEFFICIENT = 70.0
SEED_PER_NET_WIN = 10.0
SEED_MAX = 80.0
SEED_MIN_FIGHTS = 3
SEED_SHRINKAGE = 5.0
ELIGIBLE_MONTH_DAYS = 30.44
RECENCY_MONTH_DAYS = 30.4375


def half_up(x: Column, places: int = 0) -> Column:
    """Round halves toward plus infinity."""
    scale = 10.0**places
    return F.floor(x * scale + 0.5) / scale


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, null where there is nothing to divide by."""
    return F.when(whole > 0, F.floor(100.0 * part / whole + 0.5).cast("double"))


def expected_score(own: Column, other: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (other - own) / 400))


def recency_weight(age_days: Column, half_life_months: float) -> Column:
    months = age_days / RECENCY_MONTH_DAYS
    return F.when(months <= 0, 1.0).otherwise(F.pow(F.lit(0.5), months / half_life_months))


def decayed(rating: Column, idle_days: Column, per_period: float = 0.0, floor: float = DECAY_FLOOR) -> Column:
    """Rating after whole idle periods; the floor holds once there is one, even where a period takes nothing."""
    periods = F.floor(idle_days / DECAY_PERIOD_DAYS)
    return F.when(idle_days.isNull() | (periods <= 0), rating).otherwise(F.greatest(F.lit(floor), rating - periods * per_period))


def sigma_discount(rating: Column, fights: Column, coefficient: float = SIGMA_COEFFICIENT) -> Column:
    return F.when(fights <= 0, rating).otherwise(rating - coefficient / F.sqrt(F.greatest(fights, F.lit(2)).cast("double")))


def seed_rating(fights: Column, wins: Column, losses: Column, scoped_fights: Column) -> Column:
    net = F.greatest(F.lit(-SEED_MAX), F.least(F.lit(SEED_MAX), (wins - losses) * SEED_PER_NET_WIN))
    n = F.coalesce(scoped_fights, F.lit(0))
    return INITIAL_RATING + F.when(fights >= SEED_MIN_FIGHTS, net * (n / (n + SEED_SHRINKAGE))).otherwise(0.0)


def shrunk(x: Column, mean: Column, n: Column, k: float = 4.0) -> Column:
    return mean + (x - mean) * (n / (n + k))


def tug_share(left: Column, right: Column, low: float = 0.08, high: float = 0.92) -> Column:
    """The left side's share of a comparison bar, kept off the ends; even where both are nothing."""
    return F.when(left + right == 0, 0.5).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), left / (left + right))))


def achievement(years: Column) -> Column:
    """A title's weight, halved every two years; one still to come counts as one."""
    return F.least(F.lit(1.0), F.pow(F.lit(0.5), years / 2))
