import base64
import json
import random
import re
import time

from pyspark.sql import functions as F
from weftline.llm import secrets as S

BASE = {
    "assign": r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def plain(text):
    out = []
    for n, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            if {"assign": lambda: len(m[2]) >= 8, "access": lambda: len(m[0]) >= 16, "hex": lambda: len(m[0]) >= 32}[kind]():
                out.append((m.start(), n, m.end(), kind))
    return [(k, s, e) for s, _, e, k in sorted(out)]


def tlv(tag, *parts):
    data = b"".join(parts)
    n = len(data)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82, n >> 8, n & 255])) + data


ONE = lambda n=1: tlv(2, b"\x01" + b"\xab" * (n - 1))
PKCS1 = tlv(0x30, tlv(2, b"\0"), *[ONE(60) for _ in range(8)])
PKCS8 = tlv(0x30, tlv(2, b"\0"), tlv(0x30, tlv(6, b"\x2a\x86\x48"), tlv(5)), tlv(4, PKCS1))
SEC1 = tlv(0x30, ONE(), tlv(4, b"\x07" * 32))
PUBLIC = tlv(0x30, tlv(0x30, tlv(6, b"\x2a\x86"), tlv(5)), tlv(3, b"\0" * 80))
SSH = b"openssh-key-v1\0" + b"\0\0\0\4none" * 2 + b"\0\0\0\0" + b"\0\0\0\1" + b"\0" * 60
b64 = lambda x: base64.b64encode(x).decode()


def token(head, body):
    return ".".join(base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in (head, body)) + ".c2ln"


def test_base_equals_plain_search():
    rnd = random.Random(4)
    bits = ["password", "PassWD", "toKen", "api_key", "APIKEY", "secret", "ſecret", "toKen", '"', "'", " ", "=", ":", "abcdefgh", "AKIA", "AKIAABCDEFGH12345", "0123456789abcdef" * 2, "f", "é", "\n", "x.y/"]
    for _ in range(3000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randrange(14)))
        assert [s for s in S.scan(text) if s[0] in S.BASE_KINDS] == plain(text), text


def test_structures():
    for good in (PKCS1, PKCS8, SEC1):
        assert S.is_private_key(good)
        assert not S.is_private_key(good[:-1]) and not S.is_private_key(good + b"\0")
    assert not S.is_private_key(PUBLIC) and not S.is_private_key(b"") and not S.is_private_key(b"\x30\x80")
    assert S.is_ssh_key(SSH) and not S.is_ssh_key(SSH[:30])
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{b64(PKCS1)}\n-----END RSA PRIVATE KEY-----"
    kinds = lambda t: [k for k, _, _ in S.scan(t)]
    assert S.scan(f"é {pem} z")[0] == ("pem", 2, 2 + len(pem))
    assert "pem" not in kinds(pem.replace(b64(PKCS1), b64(PUBLIC))) and "pem" not in kinds(pem[:-30])
    assert kinds(f"k {b64(PKCS8)} z") == ["key"] and kinds(b64(PUBLIC)) == []
    assert "key" in kinds(PKCS1.hex().upper()) and kinds(PKCS1.hex()) == ["hex", "key"]
    assert kinds(b64(SSH)) == ["ssh"]
    jwt = token({"alg": "HS256"}, {"sub": 1})
    assert S.scan("a " + jwt) == [("jwt", 2, 2 + len(jwt))]
    assert kinds(token({"typ": "JWT"}, {})) == [] and kinds(token({"alg": "x"}, [1])) == [] and kinds("eyJhbGci.eyJ.x") == []


def test_redaction():
    text = 'a token = "0123456789abcdef0123456789abcdef" z'
    assert S.redact(text) == 'a [SECRET]" z'
    assert S.redact(None) is None and S.redact("") == "" and S.redact("token = short") == "token = short"


def test_long_texts_are_linear():
    begun = time.time()
    for bit in ("eyJ", "token ", "AKIA", "M", "MI", "30", "-----BEGIN PRIVATE KEY-----", "token" + " " * 50, "a.ey", "f"):
        S.scan(bit * (600_000 // len(bit)))
    assert time.time() - begun < 20


def test_rows(spark):
    rows = [(1, None, "c"), (2, "", "c"), (3, "TOKEN: abcdefgh", "c"), (3, "TOKEN: abcdefgh", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Secrets string")
    out = S.find_secrets(df)
    assert out.columns == ["doc_id", "text", "secrets"]
    got = out.select("doc_id", S.listed(F.col("secrets")).alias("s")).orderBy("doc_id").collect()
    assert [r.s for r in got] == ["", "", "assign:0:15", "assign:0:15"]
    clean = S.redact_secrets(df)
    assert clean.columns == df.columns
    assert sorted(str(r.text) for r in clean.collect()) == ["", "None", "[SECRET]", "[SECRET]"]
    assert S.find_secrets(df.limit(0)).count() == 0


def test_tokens_by_their_json_and_keys_within_base64():
    code = lambda b: base64.urlsafe_b64encode(b).rstrip(b"=").decode()
    head = code(b'{"alg":"HS256"}')
    for first, claims in ((head, b"{}"), (head, b'{\n  "sub": "x"\n}'), (code(b' {"alg": "HS256"}'), b"{}"), (code(json.dumps({"alg": "none"}, indent=1).encode()), b'{"a":1}')):
        token = f"{first}.{code(claims)}.c2ln"
        for before in ("", "see ", "www.", "a.b."):
            assert S.scan(f"{before}{token} end") == [("jwt", len(before), len(before) + len(token))]
    assert S.scan("www.example.org and 1.2.3.4") == []
    body = base64.b64encode(bytes(range(96))).decode()
    lines = ["-----BEGIN RSA PRIVATE KEY-----", "Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,00", "", body[:64], body[64:], "-----END RSA PRIVATE KEY-----"]
    for end in ("\n", "\r\n", "\\n", "\\r\\n"):
        pem = end.join(lines)
        assert S.scan(f"a {pem} b") == [("pem", 2, 2 + len(pem))]
        packed = base64.b64encode(pem.encode()).decode()
        assert S.scan(f"client-key-data: {packed} b") == [("pem", 17, 17 + len(packed))]
    assert S.scan(base64.b64encode(b"-----BEGIN CERTIFICATE-----" + b"x" * 99).decode()) == []


def test_encrypted_keys_are_whole_blocks_of_a_known_cipher():
    def pem(info, size, end="\n"):
        body = base64.b64encode(bytes(range(size))).decode()
        return end.join(["-----BEGIN RSA PRIVATE KEY-----", "Proc-Type: 4,ENCRYPTED", info, "", body, "-----END RSA PRIVATE KEY-----"])

    for info, size in (("DEK-Info: AES-256-CBC,0123456789ABCDEF0123456789ABCDEF", 64), ("DEK-Info: DES-EDE3-CBC,0123456789ABCDEF", 72)):
        assert [k for k, _, _ in S.scan(pem(info, size)) if k == "pem"] == ["pem"]
    for info, size in (("DEK-Info: AES-256-CBC,0123456789ABCDEF0123456789ABCDEF", 72), ("DEK-Info: ROT-13,00", 64), ("DEK-Info: AES-256-CBC,XY", 64), ("", 64)):
        assert not [k for k, _, _ in S.scan(pem(info, size)) if k == "pem"]
    words = base64.b64encode(b"not a key at all, only words").decode()
    assert S.scan(f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\n{words}\n-----END RSA PRIVATE KEY-----") == []


def test_wrapped_base64_of_a_key():
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{b64(PKCS1)}\n-----END RSA PRIVATE KEY-----\n"
    packed = b64(pem.encode())
    for end in ("\n", "\r\n", "\n  "):
        lines = end.join(packed[i : i + 64] for i in range(0, len(packed), 64))
        assert ("pem", 6, 6 + len(lines)) in S.scan(f"data: {lines}\n")


def test_candidates_leave_nothing_out(spark):
    rnd = random.Random(6)
    jwt, pem = token({"alg": "HS256"}, {"sub": 1}), f"-----BEGIN PRIVATE KEY-----\n{b64(PKCS8)}\n-----END PRIVATE KEY-----"
    bits = [jwt, pem, b64(pem.encode()), b64(SSH), PKCS1.hex(), PKCS1.hex().upper(), "AKIAABCDEFGH12345", "toKen = abcdefgh", "ſecret: abcdefgh", "0123456789abcdef" * 2,
            "xy", " ", "é", "\n", "www.example.org", "a" * 31, "-" * 40, "token"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randrange(5)))) for i in range(400)]
    got = S.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: [tuple(s) for s in r.secrets] for r in got} == {i: S.scan(t) for i, t in rows}
