"""Scalar expressions: safe numbers, softmax parts, chance correction, slide resolution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def safe_double(c: Column) -> Column:
    """A finite number or null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def div(a: Column, b: Column) -> Column:
    """a / b, null where undefined."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def sigmoid(z: Column) -> Column:
    """Stable on both signs."""
    return F.when(z >= 0, 1.0 / (1.0 + F.exp(-z))).otherwise(F.exp(z) / (1.0 + F.exp(z)))


def resolve_scale(temperature: Column, logit_scale: Column) -> Column:
    """A temperature if there is one (0 counts), else a logit scale other than 0, else 1 / 0.07."""
    return F.coalesce(temperature.cast("double"), F.nullif(logit_scale.cast("double"), F.lit(0.0)), F.lit(1 / 0.07))


def chance_level(classes: Column) -> Column:
    return F.when(classes < 2, F.raise_error(F.lit("chance needs two classes or more"))).otherwise(1.0 / classes)


def chance_corrected(x: Column, classes: Column) -> Column:
    chance = chance_level(classes)
    return (x - chance) / (1.0 - chance)


#: The plausible range of microns per pixel, those of objectives, and the default.
MPP_RANGE = (0.05, 50.0)
MPP_OF_OBJECTIVE = {40: 0.25, 20: 0.5, 10: 1.0, 5: 2.0}
MPP_DEFAULT = 0.5


def base_mpp(declared: Column, objective: Column) -> Column:
    """Declared microns per pixel if plausible, else the objective's, else the default."""
    d, o = safe_double(declared), safe_double(objective)
    by = F.create_map(*[F.lit(x) for k, v in MPP_OF_OBJECTIVE.items() for x in (float(k), v)])
    return F.coalesce(F.when(d.between(*MPP_RANGE), d), F.when(o.isin([float(k) for k in MPP_OF_OBJECTIVE]), F.try_element_at(by, o)), F.lit(MPP_DEFAULT))


def nearest_level(target: Column, base: Column, downsamples: Column) -> Column:
    """The pyramid level whose resolution is nearest; the first of equals."""
    gaps = F.transform(downsamples, lambda d, i: F.struct(F.abs(target - base * d).alias("gap"), i.alias("level")))
    return F.array_min(gaps)["level"]


def warmup_cosine(step: Column, total: int, warmup: int, peak: float, floor: float) -> Column:
    """Linear warm-up to `peak`, then a cosine down to `floor`."""
    part = (step - warmup) / float(max(total - warmup, 1))
    return F.when(step < warmup, peak * (step + 1) / float(max(warmup, 1))).otherwise(floor + (peak - floor) * 0.5 * (1 + F.cos(F.pi() * part)))


def offset_or_zero(c: Column) -> Column:
    """A level-0 origin: blank or missing is 0."""
    return F.coalesce(F.trim(c).try_cast("int"), F.lit(0))
