"""Feature preparation: a plan fitted in two aggregations, applied as one projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import attach, require_columns, stored
from ..errors import ColumnError, EmptyPopulationError
from .ranking import global_rank

SKEW_THRESHOLD = 0.75
MAX_LEVELS = 1_000


def column_catalog(df: DataFrame) -> list[tuple[str, str, bool]]:
    """(name, type, is_numeric) of every column; booleans count as numeric."""
    numeric = (T.NumericType, T.BooleanType)
    return [(f.name, f.dataType.simpleString(), isinstance(f.dataType, numeric)) for f in df.schema]


def table_shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def resolve_features(columns: Sequence[str], features: Sequence[str]) -> list[str]:
    """Requested names that exist; for the others every column named ``<feature>_...``."""
    found = [f for f in features if f in columns]
    for f in features:
        if f not in columns:
            found += [c for c in columns if c.startswith(f"{f}_")]
    return list(dict.fromkeys(found))


def drop_null_labels(df: DataFrame, *labels: str) -> DataFrame:
    return df.na.drop(subset=list(labels))


def distinct_levels(df: DataFrame, columns: Sequence[str], max_levels: int = MAX_LEVELS) -> dict[str, list]:
    """Sorted distinct non-null values per categorical column; a column with more than ``max_levels`` is refused."""
    if not columns:
        return {}
    require_columns(df, *columns)
    levels = {}
    for c in columns:
        found = df.select(c).where(F.col(c).isNotNull()).distinct().limit(max_levels + 1).sort(c).collect()
        if len(found) > max_levels:
            raise ColumnError(f"more than {max_levels} distinct values in {c}; a forest and the outlier factor take any number")
        levels[c] = [r[0] for r in found]
    return levels


def number_levels(df: DataFrame, column: str, name: str) -> tuple[DataFrame, int]:
    """(``df`` with ``name``, number of levels): the place of the row's level in ascending order, -1 for null.

    Levels are ranked as a table and joined back; a few are broadcast, more meet the rows in a shuffle. None of them
    reaches the driver.
    """
    require_columns(df, column)
    levels = stored(df.select(F.col(column).alias("__level")).where("__level IS NOT NULL").distinct(), "levels")
    count = levels.count()
    if not count:
        return df.withColumn(name, F.lit(-1).cast("long")), 0
    ranked = stored(global_rank(levels, ["__level"], ["__level"], rows=count), "numbered-levels").withColumnRenamed("position", name)
    known = df.where(F.col(column).isNotNull()).withColumn("__level", F.col(column))
    placed = attach(known, ranked, "__level").drop("__level")
    unknown = df.where(F.col(column).isNull()).withColumn(name, F.lit(-1).cast("long"))
    return placed.select(*df.columns, name).unionByName(unknown), count


def sparse_one_hot(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add ``name``: a sparse vector with a one at the row's level (levels in ascending order of their text).

    Any number of levels; null gives a vector of zeros.
    """
    text = df.withColumn("__text", F.col(column).cast("string"))
    placed, count = number_levels(text, "__text", "__number")
    # Null takes the index after the last level, which the encoder drops.
    nominal = {"ml_attr": {"type": "nominal", "num_vals": count + 1, "name": "__index"}}
    index = F.when(F.col("__number") < 0, F.lit(count)).otherwise(F.col("__number")).cast("double")
    placed = placed.withColumn("__index", index.alias("__index", metadata=nominal))
    encoder = OneHotEncoder(inputCol="__index", outputCol=name, dropLast=True)
    return encoder.fit(placed).transform(placed).drop("__text", "__number", "__index")


def skewness(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Population skewness g1 of the non-null values; None for a constant column."""
    row = df.agg(*[F.skewness(c).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns}


def log1p_positive(x: Column) -> Column:
    return F.when(x > 0, F.log1p(x)).otherwise(x)


def minmax_scaled(x: Column, low, high) -> Column:
    """(x - low) / (high - low); a constant column becomes 0 and null stays null."""
    return F.when(x.isNotNull(), F.coalesce(F.try_divide(x - low, F.lit(high) - low), F.lit(0.0)))


def standard_scaled(x: Column, mean, deviation) -> Column:
    """(x - mean) / population deviation; a constant column becomes 0 and null stays null."""
    return F.when(x.isNotNull(), F.coalesce(F.try_divide(x - mean, F.lit(deviation)), F.lit(0.0)))


def one_hot(column: str, levels: Sequence) -> list[Column]:
    """One 0/1 column ``<column>_<level>`` per level; null gives all zeros."""
    c = F.col(column)
    return [F.when(c == F.lit(v), 1).otherwise(0).cast("int").alias(f"{column}_{v}") for v in levels]


@dataclass(frozen=True)
class FeaturePlan:
    """Fitted routes, statistics and levels; plain values, reusable on later data."""

    log_route: dict[str, tuple[float, float]]
    standard_route: dict[str, tuple[float, float]]
    order: tuple[str, ...]
    levels: dict[str, list]
    medians: dict[str, float]
    # Columns of more levels than may become columns: the vector ends with the level's number (-1 for null), which
    # stands for its one-hot columns in every distance and split.
    numbered: dict[str, int] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [*self.order, *[f"{c}_{v}" for c, vs in self.levels.items() for v in vs], *self.numbered]

    @property
    def number_columns(self) -> list[str]:
        """Columns that ``fit_features`` added to the rows."""
        return [f"__level_{c}" for c in self.numbered]

    def value(self, name: str) -> Column:
        x = F.col(name).cast("double")
        if name in self.medians:
            x = F.coalesce(x, F.lit(self.medians[name]))
        if name in self.log_route:
            return minmax_scaled(log1p_positive(x), *self.log_route[name])
        return standard_scaled(x, *self.standard_route[name])

    def columns(self) -> list[Column]:
        scaled = [self.value(n).alias(n) for n in self.order]
        return scaled + [c for name, levels in self.levels.items() for c in one_hot(name, levels)]

    def apply(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep`` columns and the prepared features."""
        return df.select(*keep, *self.columns())

    def vector(self) -> Column:
        """All features as one ``array<double>``."""
        parts = [self.value(n) for n in self.order]
        parts += [c.cast("double") for name, levels in self.levels.items() for c in one_hot(name, levels)]
        return F.array(*parts, *[F.col(c).cast("double") for c in self.number_columns])

    def describe(self) -> list[tuple[str, str]]:
        lines = [(n, "log1p of positive values, scaled to 0..1") for n in self.log_route]
        lines += [(n, "centred, divided by population deviation") for n in self.standard_route]
        lines += [(c, f"one column per value ({len(v)})") for c, v in self.levels.items()]
        return lines + [(c, f"one column per value ({n}), held as the value's number") for c, n in self.numbered.items()]


def fit_features(
    df: DataFrame,
    numerical: Sequence[str],
    categorical: Sequence[str],
    skew_threshold: float = SKEW_THRESHOLD,
    nulls: str = "error",
    max_levels: int = MAX_LEVELS,
    numbered: bool = False,
) -> tuple[DataFrame, FeaturePlan]:
    """Fit a plan; returns the rows it applies to (fewer only with ``nulls='drop'``) and the plan.

    A categorical column with more than ``max_levels`` values is refused, or with ``numbered`` held as the number of
    its level, which the rows then carry as a further column.
    """
    if not numerical and not categorical:
        raise ColumnError("no feature columns chosen")
    require_columns(df, *numerical, *categorical)
    kinds = {name: is_numeric for name, _, is_numeric in column_catalog(df)}
    text = [c for c in numerical if not kinds[c]]
    if text:
        raise ColumnError(f"not numeric: {text}")
    if nulls == "drop":
        df = df.na.drop(subset=list(numerical))

    medians: dict[str, float] = {}
    if nulls == "median" and numerical:
        row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, 10_000).alias(c) for c in numerical]).first()
        medians = {c: row[c] for c in numerical if row[c] is not None}

    def number(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.coalesce(x, F.lit(medians[c])) if c in medians else x

    stats = []
    for i, c in enumerate(numerical):
        x = number(c)
        logged = log1p_positive(x)
        stats += [
            F.skewness(x).alias(f"skew{i}"), F.avg(x).alias(f"mean{i}"), F.stddev_pop(x).alias(f"sd{i}"),
            F.min(logged).alias(f"low{i}"), F.max(logged).alias(f"high{i}"),
            F.count_if(x.isNull()).alias(f"null{i}"),
        ]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *stats).first()
    if not row["rows"]:
        raise EmptyPopulationError("no rows to prepare")
    if nulls == "error":
        holes = [c for i, c in enumerate(numerical) if row[f"null{i}"]]
        if holes:
            raise ColumnError(f"null values in {holes}; choose nulls='drop' or 'median'")
    log_route, standard_route = {}, {}
    for i, c in enumerate(numerical):
        skew = row[f"skew{i}"]
        if skew is not None and abs(skew) > skew_threshold:
            log_route[c] = (row[f"low{i}"], row[f"high{i}"])
        else:
            standard_route[c] = (row[f"mean{i}"], row[f"sd{i}"])
    many = [c for c in categorical if numbered and df.select(c).where(F.col(c).isNotNull()).distinct().limit(max_levels + 1).count() > max_levels]
    levels = distinct_levels(df, [c for c in categorical if c not in many], max_levels)
    counts = {}
    for c in many:
        df, counts[c] = number_levels(df, c, f"__level_{c}")
    plan = FeaturePlan(log_route, standard_route, tuple(numerical), levels, medians, counts)
    lower = [n.lower() for n in plan.names]  # column names do not tell cases apart
    twice = sorted({n for n in plan.names if lower.count(n.lower()) > 1})
    if twice:
        raise ColumnError(f"two features would be named {twice}; rename a column")
    return df, plan
