"""Operators by name, and pipelines of them as plain functions for ``DataFrame.transform``."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame

Operator = Callable[..., DataFrame]


class Registry:
    """Names of operators; each takes a DataFrame first and gives one.

    >>> out = OPERATORS.create("search", catalogue, product="S2", start="1998-01-01")
    >>> steps = OPERATORS.pipeline(("search", {"product": "S2"}), ("with_bands", {}))
    >>> catalogue.transform(steps)
    """

    def __init__(self) -> None:
        self._known: dict[str, Operator] = {}

    def add(self, name: str, operator: Operator) -> Operator:
        """A name stands for one operator; giving it to another one is an error."""
        if self._known.get(name, operator) is not operator:
            raise ValueError(f"{name} is taken")
        self._known[name] = operator
        return operator

    def names(self) -> list[str]:
        return sorted(self._known)

    def parameters(self, name: str) -> list[str]:
        """What an operator takes beside its DataFrame."""
        return list(inspect.signature(self[name]).parameters)[1:]

    def __getitem__(self, name: str) -> Operator:
        if name not in self._known:
            raise KeyError(f"no operator {name}; known: {', '.join(self.names())}")
        return self._known[name]

    def create(self, name: str, df: DataFrame, *more, **params) -> DataFrame:
        """The operator on ``df``; unknown names and parameters fail before a plan is made."""
        inspect.signature(self[name]).bind(df, *more, **params)
        return self[name](df, *more, **params)

    def pipeline(self, *steps: tuple[str, dict]) -> Callable[[DataFrame], DataFrame]:
        """One function of all steps, each the name of an operator and its parameters."""
        for name, _ in steps:
            self[name]

        def run(df: DataFrame) -> DataFrame:
            for name, params in steps:
                df = self.create(name, df, **params)
            return df

        return run


def _operators() -> Registry:
    from cropcube.operators import cube, dates, features, geometry, metrics, numbering, texture, timeseries
    from cropcube.sources import catalog, raster

    out = Registry()
    for module, names in (
        (catalog, "search with_bands batches positions"),
        (cube, "within at by_position with_suffix bands_as_rows align_left merge first_wins mosaic_rows collocate refine translate"),
        (dates, "clear_fraction best_date best_dates_spaced nearest trend trend_between nearest_cube"),
        (features, "pivoted stratified_split holdout_split looked_up class_tagged lot_features date_features"),
        (geometry, "places_in_lots rasterized"),
        (metrics, "confusion overall_accuracy cohen_kappa user_producer boxplot correlations"),
        (numbering, "numbered"),
        (raster, "pixels write_cube"),
        (texture, "raster_rows rows_raster glcm glcm_windows sobel slic watershed lee_sigma zonal_mean"),
        (timeseries, "as_arrays interpolated speckle_filtered"),
    ):
        for name in names.split():
            out.add(name, getattr(module, name))
    return out


OPERATORS = _operators()
