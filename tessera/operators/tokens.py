"""Signed tokens (JSON web tokens with RSA signatures), checked in batches.

Headers and claims are read with Spark's JSON functions; keys meet tokens by issuer and key id, so one issuer's key
never vouches for another's token.  The signature check itself is a small function over Arrow batches.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import small

#: The algorithms that are accepted, with their hash and the prefix of its digest (DigestInfo).
ALGORITHMS = {
    "RS256": ("sha256", bytes.fromhex("3031300d060960864801650304020105000420")),
    "RS384": ("sha384", bytes.fromhex("3041300d060960864801650304020205000430")),
    "RS512": ("sha512", bytes.fromhex("3051300d060960864801650304020305000440")),
}
LEEWAY_S = 60
LEAST_KEY_BITS = 2048


def _decoded(part: Column) -> Column:
    """The bytes of a base64url part; null if it is none."""
    fine = F.regexp_like(part, F.lit("^[A-Za-z0-9_-]*$"))
    plain = F.translate(part, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / F.lit(4)) * 4).cast("int"), "=")
    return F.when(fine & (F.length(part) % 4 != 1), F.try_to_binary(padded, F.lit("base64")))


def _text(part: Column) -> Column:
    return F.when(F.is_valid_utf8(_decoded(part).cast("string")), _decoded(part).cast("string"))


def parsed(tokens: DataFrame, token: str = "token") -> DataFrame:
    """Adds alg, kid, claims (JSON), iss, sub, exp, nbf, aud (array), signed (the signed part) and signature; nulls where a
    token has none."""
    parts = F.split(F.col(token), r"\.")
    there = F.size(parts) == 3
    part = lambda i: F.when(there, parts[i])
    rows = tokens.withColumns({"_header": _text(part(0)), "claims": _text(part(1)), "signed": F.when(there, F.concat_ws(".", parts[0], parts[1])), "signature": _decoded(part(2))})
    claim = lambda name: F.get_json_object("claims", f"$.{name}")
    listed = F.from_json(claim("aud"), "array<string>")
    return rows.withColumns({
        "alg": F.get_json_object("_header", "$.alg"), "kid": F.get_json_object("_header", "$.kid"), "iss": claim("iss"), "sub": claim("sub"),
        "exp": claim("exp").try_cast("double"), "nbf": claim("nbf").try_cast("double"),
        "aud": F.when(F.startswith(F.trim(claim("aud")), F.lit("[")), listed).otherwise(F.array_compact(F.array(claim("aud")))),
    }).drop("_header")


def verified_signature(alg: str | None, signed: bytes, signature: bytes, n: int, e: int) -> bool:
    """RSASSA-PKCS1-v1_5: the signature raised to e is the padded digest, byte for byte."""
    if alg not in ALGORITHMS or n.bit_length() < LEAST_KEY_BITS or e < 3 or not e & 1:
        return False
    size = (n.bit_length() + 7) // 8
    value = int.from_bytes(signature, "big")
    if len(signature) != size or value >= n:
        return False
    name, prefix = ALGORITHMS[alg]
    digest = prefix + hashlib.new(name, signed).digest()
    want = b"\x00\x01" + b"\xff" * (size - 3 - len(digest)) + b"\x00" + digest
    return hmac.compare_digest(pow(value, e, n).to_bytes(size, "big"), want)


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("alg", "signed", "signature", "key_n", "key_e")), strict=True)
        good = [verified_signature(alg, signed.encode(), signature, int.from_bytes(n, "big"), int.from_bytes(e, "big")) if None not in (signed, signature, n, e) else False for alg, signed, signature, n, e in rows]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(good, pa.bool_())], names=[*batch.schema.names, "good"])


def signing_keys(documents: DataFrame) -> DataFrame:
    """(issuer, kid, n, e) of ``documents(issuer, jwks)``: the RSA keys of each issuer's published key set; keys of other
    kinds or without an id or components are left out."""
    kind = "struct<keys:array<struct<kty:string,kid:string,n:string,e:string>>>"
    rows = documents.select("issuer", F.explode(F.from_json("jwks", kind)["keys"]).alias("k")).select("issuer", "k.*")
    n, e = _decoded(F.col("n")), _decoded(F.col("e"))
    return rows.where("kty = 'RSA' and kid is not null").select("issuer", "kid", n.alias("n"), e.alias("e")).where("n is not null and e is not null").dropDuplicates(["issuer", "kid"])


def validated(tokens: DataFrame, keys: DataFrame, issuer: str, audience: str, now: Column, groups_claim: str = "groups", token: str = "token") -> DataFrame:
    """Each token with sub, iss, groups and ``error`` (null if it is good).

    ``keys(issuer, kid, n, e)`` are ``signing_keys``.  A token must name an accepted algorithm and a key of the issuer,
    carry that key's signature over its own bytes, come from the issuer, be meant for the audience, not have expired
    and be in force (with ``LEEWAY_S`` seconds), and name a subject.
    """
    rows = parsed(tokens, token)
    known = small(keys.select(F.col("issuer").alias("key_issuer"), F.col("kid").alias("key_kid"), F.col("n").alias("key_n"), F.col("e").alias("key_e")))
    met = rows.join(known, (F.col("kid") == F.col("key_kid")) & (F.col("key_issuer") == issuer), "left")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in met.schema), "good boolean"])
    checked = met.mapInArrow(_checked, schema)
    seconds = F.unix_micros(now).cast("double") / 1e6
    error = (
        F.when(F.col("alg").isNull() | F.col("claims").isNull() | F.col("signature").isNull(), "the token is not readable")
        .when(~F.col("alg").isin(*ALGORITHMS), F.concat(F.lit("unsupported algorithm: "), "alg"))
        .when(F.col("kid").isNull(), "the token names no key")
        .when(F.col("key_n").isNull(), F.concat(F.lit("no key "), "kid"))
        .when(~F.col("good"), "invalid signature")
        .when(F.col("exp").isNull(), "the token has no expiry")
        .when(F.col("exp") < seconds - LEEWAY_S, "the token has expired")
        .when(F.col("nbf") > seconds + LEEWAY_S, "the token is not in force yet")
        .when(~F.col("iss").eqNullSafe(F.lit(issuer)), "another issuer")
        .when(~F.coalesce(F.array_contains("aud", audience), F.lit(False)), "another audience")
        .when(F.col("sub").isNull(), "the token names no subject")
    )
    raw = F.from_json(F.get_json_object("claims", f"$['{groups_claim}']"), "array<string>")
    told = checked.withColumn("error", error).withColumn("groups", F.coalesce(raw, F.array().cast("array<string>")))
    fine = F.col("error").isNull()
    return told.select(*tokens.columns, *(F.when(fine, F.col(c)).alias(c) for c in ("sub", "iss", "groups")), "error")
