"""Band tables of the sensors, and column expressions on bands. Missing is NULL everywhere, never NaN."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Provider band -> standard band of each product.
BANDS: Mapping[str, Mapping[str, str]] = {
    "S2": {"B2": "blue", "B3": "green", "B4": "red", "B8": "nir", "B11": "swir1", "B12": "swir2", "quality_cloud_confidence": "qa_cloud", "quality_scene_classification": "qa_class"},
    "LC08": {"ref_srband2": "blue", "ref_srband3": "green", "ref_srband4": "red", "ref_srband5": "nir", "ref_srband6": "swir1", "ref_srband7": "swir2", "ref_pixelqa": "qa_cloud", "ref_sraerosol": "qa_class"},
    "LE07": {"ref_srband1": "blue", "ref_srband2": "green", "ref_srband3": "red", "ref_srband4": "nir", "ref_srband5": "swir1", "ref_srband7": "swir2", "ref_pixelqa": "qa_cloud", "ref_cloudqa": "qa_class"},
    "S1": {"VV": "VV", "VH": "VH"},
}
# Fixed values: (cloud limit, bad classes) of each product.
QUALITY: Mapping[str, tuple[int, tuple[int, ...]]] = {"S2": (9, (3,)), "LC08": (323, (16, 80, 144, 208)), "LE07": (67, (4, 12, 20, 36, 52))}
# Slope and intercept of the sensor band-pass relation.
BANDPASS: Mapping[str, tuple[float, float]] = {"blue": (0.977, -0.00411), "green": (1.005, -0.00093), "red": (0.982, 0.00094), "nir": (1.001, -0.00029), "swir1": (1.001, -0.00015), "swir2": (0.996, -0.00097)}
# The texture measures of a radar band.
TEXTURES = ("ASM", "Contrast", "Dissimilarity", "Energy", "Entropy", "GLCMCorrelation", "GLCMMean", "GLCMVariance", "Homogeneity")


def normalized_difference(a: str, b: str) -> Column:
    """(a - b) / (a + b) in double; NULL where the sum is 0."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    return F.try_divide(x - y, x + y)


def ndvi() -> Column:
    return normalized_difference("nir", "red")


def lswi() -> Column:
    return normalized_difference("nir", "swir1")


def clear(cloud: str, klass: str, limit: int, bad: Iterable[int]) -> Column:
    """A pixel is clear unless its cloud value is above the limit or its class is bad; unknown counts as clear for neither."""
    return ~((F.col(cloud) > limit) | F.col(klass).isin(*bad))


def clear_by_product(product: str = "product", cloud: str = "qa_cloud", klass: str = "qa_class", rules: Mapping[str, tuple[int, tuple[int, ...]]] = QUALITY) -> Column:
    """One CASE over the products; a product without a rule is always clear."""
    out = None
    for name, (limit, bad) in rules.items():
        value = clear(cloud, klass, limit, bad)
        out = F.when(F.col(product) == name, value) if out is None else out.when(F.col(product) == name, value)
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def where(condition: Column, value: Column) -> Column:
    """The value where the condition holds, else NULL; the row stays."""
    return F.when(condition, value)


def to_db(value: Column) -> Column:
    """Decibels of a linear backscatter; NULL where it is not positive."""
    return F.lit(10.0) * F.log10(F.when(value > 0, value))


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def harmonized(band: str) -> Column:
    """The band-pass relation solved for the reference sensor, cut to whole numbers in 0..65535."""
    slope, intercept = BANDPASS[band]
    value = F.lit(1.0 / slope) * F.col(band) + F.lit(-intercept / slope)
    return clip(value, 0.0, 65535.0).cast("int")


def with_harmonized(df: DataFrame) -> DataFrame:
    """All bands that have a relation, in place; others pass."""
    return df.withColumns({b: harmonized(b) for b in BANDPASS if b in df.columns})


def display_rgb(value: Column) -> Column:
    """0..1 for display: (value - 200) / 1600, cut at both ends."""
    return clip((value.cast("double") - 200.0) / 1600.0, 0.0, 1.0)


def relative_name(variable: str, days: Column) -> Column:
    """``NDVI_n16`` for -16 days, ``NDVI_16`` for 16."""
    return F.concat(F.lit(variable + "_"), F.replace(days.cast("string"), F.lit("-"), F.lit("n")))


def relative_names(variable: str, days: Iterable[int]) -> list[str]:
    return [f"{variable}_{str(d).replace('-', 'n')}" for d in days]


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def every(days: Column, step: int) -> Column:
    """Whole multiples of ``step``, also below 0."""
    return days % step == 0


def half_even_share(n: Column, share: float) -> Column:
    """n * share as a whole number; halves go to the even one."""
    return F.bround(n * F.lit(share), 0)
