"""Signed bearer tokens: parsing, validity and HMAC signatures."""

from __future__ import annotations

import base64
import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BEARER = r"^Bearer\s+([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)$"
# HMAC algorithms by name.
HMAC = {"HS256": hashlib.sha256, "HS384": hashlib.sha384, "HS512": hashlib.sha512}


def _part(header: Column, i: int) -> Column:
    """A part as text; null for other headers and for bytes that are no base64 or UTF-8."""
    text = F.translate(F.regexp_extract(header, BEARER, i), "-_", "+/")
    data = F.try_to_binary(F.rpad(text, F.ceil(F.length(text) / 4).cast("int") * 4, "="), F.lit("base64"))
    return F.when(header.rlike(BEARER), F.try_validate_utf8(data.cast("string")))


def parse(header: Column) -> Column:
    """``struct<alg, kid, claims, nbf, exp, signed, signature>``, null for other headers."""
    head, claims = _part(header, 1), _part(header, 2)
    at = lambda doc, name: F.get_json_object(doc, f"$.{name}")
    return F.when(
        head.isNotNull() & claims.isNotNull(),
        F.struct(at(head, "alg").alias("alg"), at(head, "kid").alias("kid"), claims.alias("claims"), at(claims, "nbf").try_cast("long").alias("nbf"), at(claims, "exp").try_cast("long").alias("exp"),
                 F.concat_ws(".", F.regexp_extract(header, BEARER, 1), F.regexp_extract(header, BEARER, 2)).alias("signed"), F.regexp_extract(header, BEARER, 3).alias("signature")),
    )


def in_window(token: Column, now: Column) -> Column:
    """nbf <= now < exp, each only where present."""
    return token.isNotNull() & (token["nbf"].isNull() | (token["nbf"] <= now)) & (token["exp"].isNull() | (now < token["exp"]))


def hmac_valid(token: Column, keys: dict[str | None, bytes]) -> Column:
    """Whether a configured key signed the token: the one its ``kid`` names, any without one."""

    @F.pandas_udf("boolean")
    def run(alg: pd.Series, kid: pd.Series, signed: pd.Series, signature: pd.Series) -> pd.Series:
        def one(alg: str | None, kid: str | None, signed: str | None, signature: str | None) -> bool:
            if alg not in HMAC or signed is None or signature is None:
                return False
            try:
                given = base64.urlsafe_b64decode(signature + "=" * (-len(signature) % 4))
            except ValueError:
                return False
            own = [keys[kid]] if kid in keys and kid is not None else list(keys.values()) if kid is None else []
            return any(hmac.compare_digest(hmac.new(k, signed.encode(), HMAC[alg]).digest(), given) for k in own)

        return pd.Series([one(*x) for x in zip(alg, kid, signed, signature)])

    return run(token["alg"], token["kid"], token["signed"], token["signature"])
