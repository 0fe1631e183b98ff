"""Errors raised when an operation is built, before any Spark job."""


class LatticaError(Exception):
    pass


class DimensionMismatch(LatticaError):
    pass


class DomainMismatch(LatticaError, TypeError):
    pass


class IndexOutOfBound(LatticaError, IndexError):
    pass


class InvalidValue(LatticaError, ValueError):
    pass


class OutputNotEmpty(LatticaError):
    pass


class EmptyObject(LatticaError):
    pass


class NoValue(LatticaError):
    """No entry where one was asked for."""


class InvalidIndex(LatticaError, IndexError):
    """An index that no collection of this shape has."""


class InvalidObject(LatticaError):
    pass


class UninitializedObject(LatticaError):
    pass


class NullPointer(LatticaError):
    pass


class OutOfMemory(LatticaError):
    pass


class InsufficientSpace(LatticaError):
    pass


class Panic(LatticaError):
    pass


class JitError(LatticaError):
    pass


class UdfParseError(LatticaError):
    """A user function that does not turn columns into a column."""


class NoJITWarning(UserWarning):
    pass


class NotImplementedException(LatticaError, NotImplementedError):
    pass
