"""One exception family for whatever callers may want to catch."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from contextlib import contextmanager

log = logging.getLogger("tessella")


class TessellaError(Exception):
    """Any failure of the engine."""


class SourceError(TessellaError, OSError):
    """A file that is missing, empty, cut short or not Parquet."""


class SchemaError(TessellaError, ValueError):
    """A schema that cannot be compiled."""


class ArgumentError(TessellaError, ValueError):
    """An argument outside its domain."""


class EncodingError(TessellaError, ValueError):
    """Text that is not UTF-8."""


class CoercionError(TessellaError, TypeError):
    """A value that its column's type cannot hold."""


_SOURCE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "FAILED_READ_FILE", "CANNOT_READ_FILE_FOOTER", "not a Parquet file", "Could not read footer")
_VALUE = ("CAST_INVALID_INPUT", "CAST_OVERFLOW", "NUMERIC_VALUE_OUT_OF_RANGE", "ARITHMETIC_OVERFLOW", "USER_RAISED_EXCEPTION", "CANNOT_PARSE")


@contextmanager
def explained(what: str) -> Iterator[None]:
    """Raises Spark's errors inside as members of the family, with ``what`` for context."""
    try:
        yield
    except TessellaError:
        raise
    except Exception as e:
        said = str(e)
        kind = EncodingError if "UTF8" in said or "UTF-8" in said else SourceError if any(k in said for k in _SOURCE) else CoercionError if any(k in said for k in _VALUE) else TessellaError
        log.error("%s failed: %s", what, kind.__name__)
        raise kind(f"{what}: {said.splitlines()[0] if said else type(e).__name__}") from e
