"""What callers handle differently: input that will never do, and a source or table that may do later."""


class InvalidInput(ValueError):
    """Arguments, settings or data that an operation cannot work with, however often it is repeated."""


class SourceFailure(RuntimeError):
    """A provider or a stored table failed; the reason is chained as the cause."""
