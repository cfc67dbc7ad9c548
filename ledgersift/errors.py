"""Errors raised while a plan is being built, before population-size work starts."""


class SamplingError(ValueError):
    """Base class of every error this package raises."""


class SampleSizeError(SamplingError):
    """The sample size is not positive, or exceeds the population."""


class ColumnError(SamplingError):
    """A named column is missing or has an unusable type."""


class EmptyPopulationError(SamplingError):
    """No row is left after a threshold or null rule."""


class NegativeValueError(SamplingError):
    """Monetary-unit selection met values below zero."""


class NoAnomaliesError(SamplingError):
    """A density model labelled no row as noise."""


class RowLimitError(SamplingError):
    """The population exceeds the ``max_rows`` the caller allows."""


class SourceError(SamplingError):
    """A file could not be read with any supported dialect."""


class SharedFolderError(SamplingError):
    """A cluster session names no folder that all executors share."""
