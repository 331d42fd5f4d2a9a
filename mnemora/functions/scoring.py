"""Energy, blending and weights as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemora.errors import ValidationError
from mnemora.schemas import U32_MAX

LN2 = 0.6931471805599453


@dataclass(frozen=True)
class DecayConfig:
    half_life_s: float = 14 * 86400.0
    freq_weight: float = 0.3
    floor: float = 0.05
    weights: tuple[float, float] | None = None

    def validate(self) -> DecayConfig:
        if not self.half_life_s > 0 or not 0 <= self.freq_weight < float("inf") or not 0 <= self.floor <= 1:
            raise ValidationError("InvalidField", "decay configuration")
        return self


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def energy(importance: Column, applications: Column, last_ms: Column, now_ms: Column | int, half_life_s: Column | float, freq_weight: Column | float) -> Column:
    """Importance that decays by half each half-life and grows with the logarithm of use, in [0, 1]."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    idle = F.greatest(as_col(now_ms) - last_ms, F.lit(0).cast("long")).cast("double") / 1000
    return clamp01(importance.cast("double") * (1 + as_col(freq_weight) * F.log1p(applications.cast("double"))) * F.exp(-LN2 / as_col(half_life_s) * idle))


def total_applications(counters: Column) -> Column:
    """Sum of a counter map, saturating at 32 bits."""
    return F.least(F.aggregate(F.map_values(counters), F.lit(0).cast("long"), lambda s, x: s + x), F.lit(U32_MAX).cast("long"))


def merge_counters(a: Column, b: Column) -> Column:
    """Largest value of each key."""
    zero = F.lit(0).cast("long")
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, zero), F.coalesce(y, zero)))


def blend(similarity: Column, energy_value: Column, w_similarity: Column | float, w_energy: Column | float) -> Column:
    return w_similarity * clamp01(similarity) + w_energy * energy_value


def weights_valid(a: Column, b: Column) -> Column:
    fine = lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")) & (x >= 0)
    return F.coalesce(fine(a) & fine(b) & (F.abs(a + b - 1) <= 1e-4), F.lit(False))


def check_weights(w: tuple[float, float] | None) -> tuple[float, float] | None:
    if w is not None and not (0 <= w[0] < float("inf") and 0 <= w[1] < float("inf") and abs(w[0] + w[1] - 1) <= 1e-4):
        raise ValidationError("InvalidField", "recall weights must be finite, not negative and sum to 1")
    return w


def resolve_weights(request: tuple[float, float] | None, default: tuple[float, float] | None) -> tuple[float, float] | None:
    """The request's weights (an error if wrong), else the stored ones (ignored if wrong)."""
    if request is not None:
        return check_weights(request)
    try:
        return check_weights(default)
    except ValidationError:
        return None


def is_plain(w: tuple[float, float] | None) -> bool:
    return w is None or w[1] == 0


def backoff_ms(attempt: Column, initial: float = 500, factor: float = 2, most: float = 30_000) -> Column:
    return F.least(F.lit(float(initial)) * F.pow(F.lit(float(factor)), attempt - 1), F.lit(float(most)))
