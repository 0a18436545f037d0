"""Row-level status: ``struct<code, message>``, null when all is well."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OK = "cast(null as struct<code:string,message:string>)"

# Codes that speak of the service, not of the request.
INFRASTRUCTURE = ("INTERNAL", "UNAVAILABLE", "UNKNOWN")

# Status code to HTTP status; every other code is 500.
HTTP = {
    "OK": 200, "CANCELED": 499, "INVALID_ARGUMENT": 400, "FAILED_PRECONDITION": 400, "OUT_OF_RANGE": 400,
    "DEADLINE_EXCEEDED": 504, "NOT_FOUND": 404, "ALREADY_EXISTS": 409, "ABORTED": 409, "PERMISSION_DENIED": 403,
    "UNAUTHENTICATED": 401, "RESOURCE_EXHAUSTED": 429, "UNIMPLEMENTED": 501, "UNAVAILABLE": 503,
}


def ok() -> Column:
    return F.expr(OK)


def status(code: str | Column, message: str | Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(code).alias("code"), lit(message).alias("message"))


def is_infrastructure_error(s: Column) -> Column:
    return F.coalesce(s["code"].isin(*INFRASTRUCTURE), F.lit(False))


def wrap(s: Column, prefix: str, code: str | None = None) -> Column:
    """Prefix the message, and replace the code if one is given; null stays null."""
    return F.when(s.isNotNull(), status(F.lit(code) if code else s["code"], F.concat(F.lit(prefix + ": "), s["message"])))


def http_status(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in HTTP.items() for x in kv])
    return F.coalesce(F.element_at(table, code), F.lit(500))
