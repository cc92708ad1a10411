"""Errors that callers can tell apart."""


class TidewrightError(Exception):
    """hint says what to do about it."""

    def __init__(self, message: str, hint: str | None = None):
        super().__init__(message if not hint else f"{message} {hint}")
        self.hint = hint


class SpecError(TidewrightError):
    pass


class UnsafeSqlError(TidewrightError):
    pass


class MissingDependencyError(TidewrightError):
    pass


class SourceError(TidewrightError):
    pass


class LoadError(TidewrightError):
    pass


class QueryTimeoutError(TidewrightError):
    pass
