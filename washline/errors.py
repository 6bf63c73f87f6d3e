"""Exceptions raised by the library."""

from __future__ import annotations


class WashlineError(Exception):
    """Base class of every error raised on purpose."""


class DependencyError(WashlineError):
    """An optional package is needed and not installed."""


class DataLoadError(WashlineError):
    """A table cannot be read or written."""


class DataCleaningError(WashlineError):
    """A cleaning step cannot do its work."""


class ValidationError(WashlineError):
    """A configuration, a schema spec or a table breaks its rules."""


class InvalidInputError(WashlineError):
    """The input table or an argument is unusable."""


class CleanIOError(WashlineError):
    """A file operation failed."""
