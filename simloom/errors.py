"""Errors of the engine."""


class SimloomError(Exception):
    """Base of all errors raised here."""


class ConfigError(SimloomError):
    """A configuration file that cannot be read or understood."""


class PathNotFoundError(SimloomError):
    """A path to scan that does not exist."""


class NoFilesError(SimloomError):
    """Nothing to scan below the given paths."""


class RangeError(SimloomError, ValueError):
    """A number outside its range."""
