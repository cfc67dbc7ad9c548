"""The nine selection methods behind one call."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import require_columns, require_rows, require_size
from ..errors import ColumnError, SamplingError
from ..functions import seed_draw
from ..operators.autoencoder import autoencoder_sample
from ..operators.clustering import kmeans_sample
from ..operators.density import density_cluster_sample
from ..operators.features import MAX_LEVELS, SKEW_THRESHOLD, FeaturePlan, fit_features
from ..operators.isolation import isolation_forest_sample
from ..operators.monetary import mus_sample
from ..operators.outlier_factor import lof_sample
from ..operators.random_sampling import fraction_subsample, random_sample, systematic_sample, systematic_step
from ..operators.ranking import with_row_key
from ..operators.stratified import stratified_sample
from ..operators.summaries import method_summary, sampling_report, strata_comparison

VECTOR = "features"


@dataclass
class MethodResult:
    """What one run returns; everything but ``seed`` and ``warning`` is a lazy table."""

    method: str
    population: DataFrame
    summary: DataFrame
    seed: int
    trials: DataFrame | None = None
    comparison: DataFrame | None = None
    features: FeaturePlan | None = None
    warning: str = ""
    settings: dict[str, object] = field(default_factory=dict)

    @property
    def sample(self) -> DataFrame:
        return self.population.where("is_sample = 1")

    def report(self) -> DataFrame:
        """``section, item, value`` rows describing preparation and selection."""
        row = self.summary.first().asDict()
        sections = {"method": [(k, v) for k, v in row.items() if v is not None]}
        if "is_anomaly" in self.population.columns:
            sections["method"].append(("anomalies", self.population.agg(F.sum("is_anomaly")).first()[0]))
        sections["settings"] = list(self.settings.items())
        if self.comparison is not None:  # one row per stratum, a small table
            names = self.comparison.columns
            sections["strata"] = [
                (str(r[names[0]]), ", ".join(f"{n} {r[n]:.3f}" for n in names[1:])) for r in self.comparison.collect()
            ]
        if self.trials is not None:
            sections["trials"] = [(str(r["trial"]), r["value"]) for r in self.trials.select("trial", "value").collect()]
        if self.features is not None:
            sections = {"preparation": self.features.describe(), **sections}
        if self.warning:
            sections["warning"] = [("text", self.warning)]
        return sampling_report(self.population.sparkSession, sections)


@dataclass(frozen=True)
class Method:
    number: int
    name: str
    call: Callable
    uses_features: bool = False
    needs: Sequence[str] = field(default=())
    takes_numbers: bool = False  # of levels, for categories that are too many for columns


def _one_key(call: Callable) -> Callable:
    """For operators that join points on a single key column."""

    def run(df, vector, sample_size, key, **params):
        if len(key) != 1:
            raise ColumnError("this method needs a single key column; with_row_key builds one")
        return call(df, vector, sample_size, key[0], **params)

    run.__signature__ = inspect.signature(call)
    return run


METHODS = {
    m.number: m
    for m in (
        Method(1, "Random Sampling", random_sample),
        Method(2, "Systematic Sampling", systematic_sample, needs=("order_by",)),
        Method(3, "Stratified Sampling", stratified_sample, needs=("strata",)),
        Method(4, "Monetary Unit Sampling", mus_sample, needs=("value",)),
        Method(5, "Isolation Forest", isolation_forest_sample, True, takes_numbers=True),
        Method(6, "Local Outlier Factor", _one_key(lof_sample), True, takes_numbers=True),
        Method(7, "K-Means Clustering", kmeans_sample, True),
        Method(8, "Autoencoder", autoencoder_sample, True),
        Method(9, "HDBSCAN", _one_key(density_cluster_sample), True),
    )
}


def find_method(method: int | str) -> Method:
    for m in METHODS.values():
        if method == m.number or (isinstance(method, str) and method.lower().replace("_", " ") == m.name.lower()):
            return m
    raise SamplingError(f"unknown method {method!r}; choose one of {[m.name for m in METHODS.values()]}")


def run_method(
    df: DataFrame,
    method: int | str,
    sample_size: int,
    key: Sequence[str] | None = None,
    numerical: Sequence[str] = (),
    categorical: Sequence[str] = (),
    seed: int | None = None,
    created: str | None = None,
    max_rows: int | None = None,
    nulls: str = "error",
    sample_fraction: float = 1.0,
    skew_threshold: float = SKEW_THRESHOLD,
    max_levels: int = MAX_LEVELS,
    **params,
) -> MethodResult:
    """Validate, prepare features where the method needs them, select, and describe the selection.

    ``sample_fraction`` below 1 prepares, and selects from, a uniform part of the rows; ``skew_threshold`` sends
    numeric features above it through the logarithm. Both apply to methods that use features. Categories with more
    than ``max_levels`` values are held as numbers where the method takes them (forest, outlier factor), else refused.
    """
    chosen = find_method(method)
    require_size(sample_size)
    missing = [p for p in chosen.needs if not params.get(p)]
    if missing:
        raise SamplingError(f"{chosen.name} needs {missing}")
    known = inspect.signature(chosen.call).parameters
    unknown = [p for p in params if p not in known]
    if unknown and not any(p.kind is p.VAR_KEYWORD for p in known.values()):
        raise SamplingError(f"{chosen.name} has no parameters {unknown}")
    require_rows(df, max_rows)
    if key is None:
        df, key = with_row_key(df), ["row_key"]
    require_columns(df, *key)
    seed = seed_draw() if seed is None else seed
    plan, trials, warning = None, None, ""
    if "seed" in known:
        params["seed"] = seed
    if chosen.uses_features:
        df = fraction_subsample(df, sample_fraction, key, seed)
        df, plan = fit_features(df, numerical, categorical, skew_threshold, nulls, max_levels, chosen.takes_numbers)
        if plan.numbered:
            params["codes"] = len(plan.numbered)
        found = chosen.call(df.withColumn(VECTOR, plan.vector()), VECTOR, sample_size, key, **params)
        found = found if isinstance(found, tuple) else (found,)
        flagged = found[0].drop(VECTOR, *plan.number_columns)
        trials = found[1] if len(found) > 1 else None
        warning = found[2] if len(found) > 2 else ""
    else:
        flagged = chosen.call(df, sample_size, key=key, **params)
    strata = list(params.get("strata") or ())
    summary = method_summary(
        flagged, chosen.name, sample_size, seed, params.get("value"), params.get("threshold"),
        ", ".join(strata) or None, created,
    )
    comparison = None
    if len(strata) == 1:
        comparison = strata_comparison(flagged, strata[0], params.get("threshold"), params.get("value"))
    settings = {
        name: params.get(name, p.default)
        for name, p in known.items()
        if name not in ("df", "vector", "sample_size", "key", "seed") and (name in params or p.default is not p.empty)
    }
    if chosen.number == 2 and settings["interval"] == "integer":
        settings["step"], settings["start"] = systematic_step(df, sample_size, seed)
    return MethodResult(chosen.name, flagged, summary, seed, trials, comparison, plan, warning, settings)
