import base64
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import requests as Q
from tessera.operators import tokens as T

NOW, ISS, AUD = 1_700_000_000, "https://issuer.example", "api"


def b64(data):
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def prime(bits, r):
    while True:
        n = r.getrandbits(bits) | 1 | 3 << (bits - 2)
        if any(n % p == 0 for p in (3, 5, 7, 11, 13, 17, 19, 23, 29, 31)) or n % 65537 == 1:
            continue
        odd, twos = n - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        if all((x := pow(r.randrange(2, n - 1), odd, n)) in (1, n - 1) or any((x := x * x % n) == n - 1 for _ in range(twos - 1)) for _ in range(12)):
            return n


class Signer:
    def __init__(self, seed, bits=2048):
        r = random.Random(seed)
        p, q = prime(bits // 2, r), prime(bits // 2, r)
        self.n, self.e, self.d = p * q, 65537, pow(65537, -1, (p - 1) * (q - 1))

    def jwk(self, kid, **more):
        size = lambda x: x.to_bytes((x.bit_length() + 7) // 8, "big")
        return {"kty": "RSA", "kid": kid, "n": b64(size(self.n)), "e": b64(size(self.e))} | more

    def token(self, claims, kid="k1", alg="RS256", **header):
        head = {"alg": alg, "typ": "JWT"} | ({"kid": kid} if kid else {}) | header
        signed = f"{b64(json.dumps(head).encode())}.{b64(json.dumps(claims).encode())}"
        prefix = {"256": "3031300d060960864801650304020105000420", "384": "3041300d060960864801650304020205000430", "512": "3051300d060960864801650304020305000440"}[alg[2:]]
        digest = bytes.fromhex(prefix) + hashlib.new(f"sha{alg[2:]}", signed.encode()).digest()
        size = self.n.bit_length() // 8
        padded = int.from_bytes(b"\x00\x01" + b"\xff" * (size - len(digest) - 3) + b"\x00" + digest, "big")
        return f"{signed}.{b64(pow(padded, self.d, self.n).to_bytes(size, 'big'))}"


def claims(**more):
    return {"iss": ISS, "sub": "user-1", "aud": AUD, "exp": NOW + 600, "groups": ["a", "b"]} | more


def test_published_example(spark):
    """The RS256 example of RFC 7515, appendix A.2."""
    signed = "eyJhbGciOiJSUzI1NiJ9.eyJpc3MiOiJqb2UiLA0KICJleHAiOjEzMDA4MTkzODAsDQogImh0dHA6Ly9leGFtcGxlLmNvbS9pc19yb290Ijp0cnVlfQ"
    signature = "cC4hiUPoj9Eetdgtv3hF80EGrhuB__dzERat0XF9g2VtQgr9PJbu3XOiZj5RZmh7AAuHIm4Bh-0Qc_lF5YKt_O8W2Fp5jujGbds9uJdbF9CUAr7t1dnZcAcQjbKBYNX4BAynRFdiuB--f_nZLgrnbyTyWzO75vRK5h6xBArLIARNPvkSjtQBMHlb1L07Qe7K0GarZRmB_eSN9383LcOLn6_dO--xi12jzDwusC-eOkHWEsqtFZESc6BfI7noOPqvhJ1phCnvWh6IeYI2w9QOYEUipUTI8np6LbgGY9Fs98rqVt5AXLIhWkWywlVmtVrBp0igcN_IoypGlUPQGe77Rw"
    n = "ofgWCuLjybRlzo0tZWJjNiuSfb4p4fAkd_wWJcyQoTbji9k0l8W26mPddxHmfHQp-Vaw-4qPCJrcS2mJPMEzP1Pt0Bm4d4QlL-yRT-SFd2lZS-pCgNMsD1W_YpRPEwOWvG6b32690r2jZ47soMZo9wGzjb_7OMg0LOL-bSf63kpaSHSXndS5z5rexMdbBYUsLA9e-KXBdQOS-UTo7WTBEMa2R2CapHg665xsmtdVMTBQY4uDZlxvb3qCo5ZwKh9kG4LT6_I5IhlJH7aGhyxXFvUK-DWNmoudF8NAco9_h9iaGNj8q2ethFkMLs91kzk2PAcDTW9gb54h4FRWyuXpoQ"
    raw = lambda x: base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))
    number = int.from_bytes(raw(n), "big")
    assert T.verified_signature("RS256", signed.encode(), raw(signature), number, 65537)
    assert not T.verified_signature("RS384", signed.encode(), raw(signature), number, 65537)
    assert not T.verified_signature("RS256", signed.encode() + b"x", raw(signature), number, 65537)
    got = T.parsed(spark.createDataFrame([(f"{signed}.{signature}",)], "token string")).first()
    assert (got.alg, got.kid, got.iss, got.exp, got.sub) == ("RS256", None, "joe", 1300819380.0, None) and bytes(got.signature) == raw(signature)


def test_signed_and_altered(spark):
    one, two, short = Signer(1), Signer(2), Signer(3, 1024)
    documents = [(ISS, json.dumps({"keys": [one.jwk("k1"), short.jwk("short"), one.jwk("ec", kty="EC"), {"kty": "RSA", "kid": "half"}, {"kty": "RSA", "n": "AQAB", "e": "AQAB"}]})), ("https://other.example", json.dumps({"keys": [two.jwk("k1"), two.jwk("k2")]}))]
    keys = T.signing_keys(spark.createDataFrame(documents, "issuer string, jwks string"))
    assert {(r.issuer, r.kid) for r in keys.collect()} == {(ISS, "k1"), (ISS, "short"), ("https://other.example", "k1"), ("https://other.example", "k2")}
    good = one.token(claims())
    head, body, sign = good.split(".")
    flipped = ("A" if sign[10] != "A" else "B").join((sign[:10], sign[11:]))
    cases = {
        "good": (good, None), "rs384": (one.token(claims(), alg="RS384"), None), "rs512": (one.token(claims(aud=["x", AUD]), alg="RS512"), None),
        "just expired": (one.token(claims(exp=NOW - 30)), None), "fraction": (one.token(claims(exp=NOW + 0.5, nbf=NOW - 1.5)), None),
        "other claims": (f"{head}.{b64(json.dumps(claims(sub='admin')).encode())}.{sign}", "invalid signature"), "flipped": (f"{head}.{body}.{flipped}", "invalid signature"),
        "cut": (f"{head}.{body}.{sign[:-4]}", "invalid signature"), "empty": (f"{head}.{body}.", "invalid signature"), "another key": (two.token(claims()), "invalid signature"), "short key": (short.token(claims(), kid="short"), "invalid signature"),
        "no algorithm": (f"{b64(json.dumps({'alg': 'none', 'kid': 'k1'}).encode())}.{body}.", "unsupported algorithm: none"), "secret": (f"{b64(json.dumps({'alg': 'HS256', 'kid': 'k1'}).encode())}.{body}.{sign}", "unsupported algorithm: HS256"),
        "swapped": (f"{b64(json.dumps({'alg': 'RS512', 'kid': 'k1'}).encode())}.{body}.{sign}", "invalid signature"), "no key id": (one.token(claims(), kid=None), "the token names no key"), "other issuer's key": (two.token(claims(), kid="k2"), "no key k2"),
        "expired": (one.token(claims(exp=NOW - 61)), "the token has expired"), "no expiry": (one.token({"iss": ISS, "sub": "s", "aud": AUD}), "the token has no expiry"), "early": (one.token(claims(nbf=NOW + 100)), "the token is not in force yet"),
        "issuer": (one.token(claims(iss="https://other.example")), "another issuer"), "audience": (one.token(claims(aud="web")), "another audience"), "no audience": (one.token({k: v for k, v in claims().items() if k != "aud"}), "another audience"),
        "no subject": (one.token({k: v for k, v in claims().items() if k != "sub"}), "the token names no subject"), "no token": ("a.b", "the token is not readable"), "junk": ("!.?.=", "the token is not readable"), "null": (None, "the token is not readable"), "blank": ("", "the token is not readable"),
    }
    rows = spark.createDataFrame([(name, t) for name, (t, _) in cases.items()], "name string, token string")
    got = {r.name: r for r in T.validated(rows, keys, ISS, AUD, F.timestamp_seconds(F.lit(NOW))).collect()}
    assert {name: r.error for name, r in got.items()} == {name: error for name, (_, error) in cases.items()}
    assert (got["good"].sub, got["good"].iss, got["good"].groups) == ("user-1", ISS, ["a", "b"]) and got["other claims"].sub is None
    none = T.validated(rows.where("name = 'good'"), keys, ISS, AUD, F.timestamp_seconds(F.lit(NOW)), groups_claim="roles").first()
    assert none.groups == [] and none.error is None


def test_key_cache_keeps_issuers_apart():
    now, asked, sets = [0.0], [], {"i": {"k1": 1}, "j": {"k1": 2, "k2": 3}}

    def fetch(issuer):
        asked.append(issuer)
        return sets[issuer]

    cache = Q.KeyCache(fetch, 10, lambda: now[0])
    assert [cache.key("k1", i) for i in ("i", "j", "i", "j")] == [1, 2, 1, 2] and asked == ["i", "j"]
    with pytest.raises(KeyError):
        cache.key("k2", "i")  # the other issuer's key
    assert cache.key("k1", "j") == 2 and asked == ["i", "j", "i"]
    now[0] = 11.0
    sets["j"] = {"k9": 9}
    assert cache.key("k9", "j") == 9
    with pytest.raises(KeyError):
        cache.key("k1", "j")
