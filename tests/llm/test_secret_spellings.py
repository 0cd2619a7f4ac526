"""Keys in the spellings in which they are met are decoded, reported and redacted."""

import base64
import json

import pytest

from cohortflow.llm import secrets


def tlv(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else b"\x82" + n.to_bytes(2, "big")) + body


def string(x):
    return len(x).to_bytes(4, "big") + x


NOISE = bytes((i * 89 + 7) % 251 + 1 for i in range(700))
RSA = tlv(0x30, tlv(0x02, b"\x00"), *[tlv(0x02, b"\x01" + NOISE[k * 60 : k * 60 + n]) for k, n in enumerate((64, 3, 64, 32, 32, 32, 32, 32))])
KEYS = {
    "pkcs1": ("der", RSA),
    "pkcs8": ("der", tlv(0x30, tlv(0x02, b"\x00"), tlv(0x30, tlv(0x06, NOISE[:9]), b"\x05\x00"), tlv(0x04, RSA))),
    "ed25519": ("der", tlv(0x30, tlv(0x02, b"\x00"), tlv(0x30, tlv(0x06, b"\x2b\x65\x70")), tlv(0x04, tlv(0x04, NOISE[:32])))),
    "sec1": ("der", tlv(0x30, tlv(0x02, b"\x01"), tlv(0x04, NOISE[:32]), tlv(0xA0, tlv(0x06, NOISE[:8])))),
    "openssh": ("openssh", secrets.OPENSSH_MAGIC + string(b"none") * 2 + string(b"") + b"\0\0\0\1" + string(NOISE[:51]) + string(NOISE[:137])),
}
KEYS["openssh of 20 keys"] = ("openssh", secrets.OPENSSH_MAGIC + string(b"none") * 2 + string(b"") + b"\0\0\0\x14" + string(NOISE[:51]) * 20 + string(NOISE[:137]))


def wrapped(x, n, mark="\n"):
    return mark.join(x[i : i + n] for i in range(0, len(x), n))


def kinds(text):
    return [(secrets.KINDS[k], text[s:e]) for s, k, e in secrets.all_spans(text) if k >= len(secrets.BASE_KINDS)]


@pytest.mark.parametrize("name", KEYS)
def test_base64_spellings(name):
    kind, data = KEYS[name]
    code = base64.b64encode(data).decode()
    for key in (code, code.rstrip("="), base64.urlsafe_b64encode(data).decode()):
        for text in (f"{key}", f"PRIVATE_KEY={key}", f"key={key}\nPATH=x", f'key="{key}"', f"a\\n{key}\\nEND"):
            assert kinds(text) == [(kind, key)], text
    for n in (32, 64, 70, 76):
        for mark in ("\n", "\r\n", "\n    ", "\\n", "\\r\\n", " "):
            key = wrapped(code, n, mark)
            assert kinds(f"Here: {key}\nand more words") == [(kind, key)]
            assert kinds(f"PRIVATE_KEY={key}") == [(kind, key)]
    assert kinds(code[:-8]) == kinds(f"{code.rstrip('=')}AAAA") == kinds("M" + code[2:]) == []


@pytest.mark.parametrize("name", [k for k in KEYS if not k.startswith("openssh")])
def test_hex_spellings(name):
    low = KEYS[name][1].hex()
    mixed = "".join(c.upper() if i % 3 else c for i, c in enumerate(low))
    for key in (low, low.upper(), mixed, wrapped(mixed, 64)):
        for text in (key, f"key=0x{key};", f"0X{key}", f"key={key}"):
            assert kinds(text) == [("der", key)]
    assert kinds(f"a{low}") == kinds(f"{low}a") == []


@pytest.mark.parametrize("name", KEYS)
def test_pem_spellings(name):
    code = base64.b64encode(KEYS[name][1]).decode()
    for mark in ("\n", "\r\n", " ", "\t", "\\n", "\\r\\n", "\n  "):
        text = mark.join(("-----BEGIN PRIVATE KEY-----", wrapped(code, 64, mark), "-----END PRIVATE KEY-----"))
        assert kinds(f"x {text} y") == [("pem", text)], mark
        text = text.replace("-----" + mark, f"-----{mark}Proc-Type: 4,ENCRYPTED{mark}DEK-Info: AES-128-CBC,0011{mark}", 1)
        assert kinds(f"x {text} y") == [("pem", text)], mark
    assert kinds("-----BEGIN PRIVATE KEY-----\nnot a key\n-----END PRIVATE KEY-----") == []


def test_token_spellings(spark):
    head, claims = (base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in ({"alg": "HS256"}, {"sub": "1"}))
    token = f"{head}.{claims}.c2lnbmVk"
    for text in (token, f"jwt={token}", f"Bearer {token}", f'"{token}"'):
        assert kinds(text) == [("jwt", token)]
    key = base64.b64encode(RSA).decode()
    texts = [f"PRIVATE_KEY={key}", f"k 0x{RSA.hex().upper()}.", f"see\n{wrapped(key, 64)}\nend", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["text"] for r in secrets.redact_secrets(docs).orderBy("doc_id").collect()] == ["PRIVATE_KEY=[der]", "k 0x[der].", "see\n[der]\nend", None]
    assert [r["n_der"] for r in secrets.report(secrets.find_secrets(docs)).orderBy("doc_id").collect()] == [1, 1, 1, 0]
