"""Errors raised on the driver, before or while a model is fitted or queried."""


class CdfloomError(ValueError):
    """Base of all errors of the regression engine."""


class ConfigParseError(CdfloomError):
    """A setting has an unknown name or value."""


class CovariateDimensionMismatch(CdfloomError):
    """Queries and model differ in the number of covariates."""


class CovariateOrderInconsistency(CdfloomError):
    """A column is named twice, or not at all, in the covariate order."""


class EmptyInput(CdfloomError):
    """No rows to fit."""


class IncompatibleShapes(CdfloomError):
    """Arrays or columns do not fit together."""


class NonFiniteFloats(CdfloomError):
    """A covariate, response or weight is null, NaN or infinite."""


class NegativeWeights(CdfloomError):
    """A weight is below zero."""


class NotImplementedCombination(CdfloomError):
    """The combination of options has no defined estimator."""


class OrderMismatch(CdfloomError):
    """Rows or columns that must ascend do not."""


class ShapeMismatch(CdfloomError):
    """A literal model's matrix does not match its covariates and thresholds."""


class SubaggingParameterInconsistency(CdfloomError):
    """Subsample options contradict each other."""


class TooLarge(CdfloomError):
    """An exact kernel would need more than its documented size."""
