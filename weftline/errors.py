"""Errors with stable codes. Query and Schema errors are ValueErrors, the others RuntimeErrors."""

from __future__ import annotations


class GraphError(Exception):
    code = "E_INTERNAL"
    label = "internal error"
    recoverable = False

    def __str__(self) -> str:
        return f"{self.label}: {super().__str__()}"


class StorageError(GraphError, RuntimeError):
    code, label = "E_STORAGE", "storage error"


class FormatError(GraphError, RuntimeError):
    code, label = "E_FORMAT", "format error"


class QueryError(GraphError, ValueError):
    code, label, recoverable = "E_QUERY", "query error", True


class SchemaError(GraphError, ValueError):
    code, label, recoverable = "E_SCHEMA", "schema error", True


class NotFoundError(GraphError, RuntimeError):
    code, label, recoverable = "E_NOT_FOUND", "not found", True


class InternalError(GraphError, RuntimeError):
    code, label = "E_INTERNAL", "internal error"


class IoError(GraphError, RuntimeError):
    code, label = "E_IO", "io error"
