"""Errors that users of the engine can cause, each with its own type."""


class EngineError(Exception):
    """Base of all errors that the command line reports without a traceback."""


class ConfigError(EngineError):
    """An experiment's declaration is incomplete or names something unknown."""


class DataError(EngineError):
    """Input data cannot be read as a labelled frame."""


class ValidationError(EngineError):
    """Rows cannot be dealt into folds as asked."""


class ClassifierError(EngineError):
    """A classifier's parameters or inputs do not fit."""
