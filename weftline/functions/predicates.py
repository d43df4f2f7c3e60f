"""WHERE terms as Columns over edge tables. Fields and literal kinds are checked when the query is compiled."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError
from .timeutil import MAX_NS, parse_ns

COMPARE = {"=": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
TEXT = {"type": "edge_type", "edge_type": "edge_type", "source": "source"}
TIME = {"valid_from": "valid_from_ns", "valid_to": "valid_to_ns", "observed_at": "observed_at_ns"}
FIELDS = ("type", "edge_type", "source", "confidence", "valid_from", "valid_to", "observed_at")


def term(field: str, op: str, value: str | int | float) -> Column:
    """One comparison. Confidence is compared in single precision; an open end counts as the last instant."""
    compare = COMPARE[op]
    if field in TEXT:
        if not isinstance(value, str):
            raise QueryError(f"{field} is compared with a string")
        return compare(F.col(TEXT[field]), F.lit(value))
    if field == "confidence":
        if isinstance(value, str):
            raise QueryError("confidence is compared with a number")
        return compare(F.col("confidence"), F.lit(float(value)).cast("float"))
    if field in TIME:
        if not isinstance(value, str):
            raise QueryError(f"{field} is compared with a time string")
        held = F.col(TIME[field])
        return compare(F.coalesce(held, F.lit(MAX_NS)) if field == "valid_to" else held, F.lit(parse_ns(value)))
    raise QueryError(f"unknown field {field!r}; expected one of {', '.join(FIELDS)}")


def conjunction(terms) -> Column | None:
    """All of (field, op, value); None for none."""
    columns = [term(*t) for t in terms]
    return reduce(operator.and_, columns) if columns else None
