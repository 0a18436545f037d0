"""Authorization: verdicts per tenant, combined and applied to requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import names
from lodestack.functions.status import ok, status

DENIED = "PERMISSION_DENIED"


def allow_all() -> Column:
    return ok()


def deny_all() -> Column:
    return status(DENIED, "Permission denied")


def allowed_prefixes(requests: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Requests whose name lies under an allowed prefix: a semi join on ancestors."""
    unique = requests.select("instance_name").distinct()
    under = unique.select("instance_name", F.explode(names.ancestors(F.col("instance_name"))).alias("prefix"))
    good = under.join(prefixes.select("prefix").distinct(), "prefix", "left_semi").select("instance_name").distinct()
    return requests.join(good, "instance_name", "left_semi")


def any_of(statuses: list[Column]) -> Column:
    """OK as soon as one is OK; only PERMISSION_DENIED passes on to the next, any
    other error ends the search. All denied: the last denial."""
    out = statuses[-1]
    for s in reversed(statuses[:-1]):
        out = F.when(s.isNull(), ok()).when(s["code"] != DENIED, s).otherwise(out)
    return out


def cached_verdict(requests: DataFrame, verdicts: DataFrame, key: str, now: Column) -> DataFrame:
    """Requests with the stored verdict of their key that has not run out; null asks anew."""
    live = verdicts.where(F.col("expires_at") > now).select(key, "allowed")
    return requests.join(live, key, "left")


def find_missing_failfast(requests: DataFrame, verdicts: DataFrame, request: str) -> DataFrame:
    """Per request OK, or the denial of its first denied name in order: a request that
    touches one forbidden tenant fails as a whole. Names without a verdict are denied."""
    pairs = requests.select(request, "instance_name").distinct()
    judged = pairs.join(verdicts.select("instance_name", "allowed"), "instance_name", "left")
    denied = F.min(F.when(~F.coalesce("allowed", F.lit(False)), F.col("instance_name"))).alias("denied")
    return judged.groupBy(request).agg(denied, F.count(F.lit(1)).alias("names"))
