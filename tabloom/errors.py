"""Exceptions raised by the library, one per area."""


class TabloomError(Exception):
    """Base class: every error raised on purpose derives from it."""


class DataError(TabloomError):
    """A dataset cannot be read, written or split as asked."""


class ValidationError(TabloomError):
    """A target or a dataset does not meet its expectations."""


class ConfigError(TabloomError, ValueError):
    """An option has a value outside its allowed set."""


class ModelError(TabloomError):
    """A model name, parameter set or saved model is unusable."""


class EvaluationError(TabloomError):
    """Metrics cannot be computed for the given inputs."""


class RunError(TabloomError):
    """A recorded run does not exist or cannot be stored."""
