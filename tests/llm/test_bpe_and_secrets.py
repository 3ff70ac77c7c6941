import base64
import hashlib
import json
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
from odd import TEXTS, counted, no_documents, odd_documents
from tokenizers import Tokenizer

from promptloom.llm import bpe
from promptloom.llm import secret_scan as S

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_library():
    rng = random.Random(5)
    alphabet = ["a", "b", "th", "e", " ", " ", "\n", "\t", "'s", "'LL", "9", "é", "日", "😀", "!", "--", "\x85", " ", "<|endoftext|>", "ՙ", "\x1c"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(400)] + [t or "" for _, t in TEXTS]
    encoder, own = bpe.BlockEncoder(bpe.Codec(open(PATH, "rb").read())), library()
    for part in (texts[:200], texts[200:]):
        for text, ids in zip(part, encoder.encode(part)):
            want = own.encode(text, add_special_tokens=False).ids
            assert ids.tolist() == want
            assert encoder.codec.decode(ids) == own.decode(want, skip_special_tokens=False)


def test_files_that_ask_for_more_are_refused():
    spec = json.load(open(PATH))
    assert bpe.unsupported(spec) == []
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": None}, {"decoder": None}, {"model": spec["model"] | {"dropout": 0.1}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}):
        try:
            bpe.Codec(json.dumps(spec | change).encode())
        except ValueError as refused:
            assert next(iter(change)) in str(refused)
        else:
            raise AssertionError(change)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_PIECES", 5)
    encoder, own = bpe.BlockEncoder(bpe.Codec(open(PATH, "rb").read())), library()
    for text in ("one two three four five six seven", "eight nine one two", "<|endoftext|>", "", "one"):
        assert next(encoder.encode([text])).tolist() == own.encode(text, add_special_tokens=False).ids


def test_invalid_bytes_decode_like_the_library():
    codec, own = bpe.Codec(open(PATH, "rb").read()), library()
    for ids in ([220, 164], [99, 100, 101, 200], [50256, 98], list(range(150, 256))):
        assert codec.decode(np.array(ids)) == own.decode(ids, skip_special_tokens=False)


def test_odd_rows_bpe(spark):
    own = library()
    want = []
    for k, t in TEXTS:
        ids = own.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert counted(bpe.encode_digests(odd_documents(spark), PATH).collect()) == counted(want)
    assert bpe.encode_digests(no_documents(spark), PATH).count() == 0
    ids = bpe.encode_ids(odd_documents(spark), PATH)
    assert counted(bpe.decode_ids(ids, PATH).collect()) == counted((k, t or "") for k, t in TEXTS)


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


RSA = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([7 + i]) * 40) for i in range(8)))
PKCS8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2b\x65\x70")) + der(4, der(4, b"k" * 32)))
EC = der(0x30, der(2, b"\1") + der(4, b"k" * 32) + der(0xA0, der(6, b"\x2b\x65\x70")))


def field(b):
    return len(b).to_bytes(4, "big") + b


SSH = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"pub" * 9) + field(b"priv" * 9)


def b64(data, url=False):
    return (base64.urlsafe_b64encode(data).rstrip(b"=") if url else base64.b64encode(data)).decode()


def token(head, claims, signature=b"s" * 32):
    return ".".join([b64(json.dumps(head).encode(), True), b64(json.dumps(claims).encode(), True), b64(signature, True)])


def test_structures_are_told_from_lookalikes():
    assert all(map(S.is_private_key, (RSA, PKCS8, EC))) and S.is_ssh_key(SSH)
    for good in (RSA, PKCS8, EC):
        assert not S.is_private_key(good[:-1]) and not S.is_private_key(good + b"x") and not S.is_private_key(b"")
        assert not S.is_private_key(bytes([good[0]]) + bytes([good[1] ^ 1]) + good[2:])
    assert not S.is_ssh_key(SSH[:-1]) and not S.is_ssh_key(SSH + b"x")
    assert S.is_token(token({"alg": "HS256"}, {"sub": 1})) and not S.is_token(token({"typ": "JWT"}, {})) and not S.is_token("ey!!.eyJ9.x")


def test_confirmed_spans():
    for data, kind in ((RSA, "der"), (PKCS8, "der"), (EC, "der"), (SSH, "ssh")):
        text = f"é before {b64(data)} after"
        assert S.confirmed_spans(text) == [(9, kind, 9 + len(b64(data)))]
        assert S.confirmed_spans(f"before {b64(data)[:-8]} after") == []
    body = b64(RSA)
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(body[i : i + 64] for i in range(0, len(body), 64)) + "\n-----END RSA PRIVATE KEY-----"
    assert S.confirmed_spans(f"a {pem} b") == [(2, "der", 2 + len(pem))]
    assert S.confirmed_spans(pem.replace(body[:6], "AAAAAA")) == []
    assert [s[1] for s in S.spans(f"key {PKCS8.hex()} end")] == ["hex", "der"]
    jwt = token({"alg": "RS256"}, {"sub": "x"})
    assert S.confirmed_spans(f"auth {jwt}, and {jwt[:-60]}!")[0] == (5, "jwt", 5 + len(jwt))


def brute_base(text):
    out = []
    for kind, pattern, least, group in (("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12, 2), ("access", r"AKIA[A-Z0-9]+", 18, 0), ("hex", r"[0-9a-f]+", 16, 0)):
        out += [(m.start(), ("assign", "access", "hex").index(kind), m.end(), kind) for m in re.finditer(pattern, text, re.A) if len(m[group]) >= least]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_base_spans_against_brute_force():
    rng = random.Random(8)
    parts = ["token", "PassWord", "api_key", "APIKEY", "ſecret", "secret", "=", ":", " ", '"', "'", "AKIA", "Z9", "deadbeef", "0123456789abcdef", "x-y_z.=", "é", "\n"]
    for _ in range(500):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        base = [s for s in S.spans(t) if s[1] in S.BASE]
        assert ",".join(f"{k}:{a}:{b}" for a, k, b in base) == brute_base(t)


def test_odd_rows_secrets(spark):
    rows = S.scan(odd_documents(spark)).collect()
    assert len(rows) == len(TEXTS)
    want = counted((k, hashlib.sha256(brute_base(t or "").encode()).hexdigest()) for k, t in TEXTS)
    assert counted((r["doc_id"], r["base_sha256"]) for r in rows) == want
    five = next(r for r in rows if r["doc_id"] == 5)
    assert (five["n_assign"], five["n_access"], five["n_hex"]) == (1, 1, 1) and five["spans"].count(":") == 6
    assert S.scan(no_documents(spark)).count() == 0


def test_redaction_keeps_rows_and_columns(spark):
    docs = odd_documents(spark)
    clean = S.redact(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    five = clean.where("doc_id = 5").first()
    assert "abcdef0123456789" not in five["text"] and "AKIA" not in five["text"] and five["text"].count("[secret]") == 2 and five["n_chars"] == len(five["text"])
    assert counted((r["doc_id"], r["text"]) for r in clean.where("doc_id is null or doc_id <> 5").collect()) == counted((k, t) for k, t in TEXTS if k != 5)
    assert S.redact(no_documents(spark)).count() == 0


def lines(text, n=64, by="\n"):
    return by.join(text[i : i + n] for i in range(0, len(text), n))


def test_keys_in_other_clothes():
    for data, kind in ((RSA, "der"), (PKCS8, "der"), (EC, "der"), (SSH, "ssh")):
        h = data.hex()
        mixed = "".join(c.upper() if i % 3 else c for i, c in enumerate(h))
        forms = [
            lines(b64(data), 40), lines(b64(data), 40, "\r\n  "), lines(b64(data), 40, "\\n"), lines(b64(data), 40, '" +\n    "'), b64(data, True),
            h, h.upper(), mixed, "0x" + h, ":".join(h[i : i + 2] for i in range(0, len(h), 2)), ", ".join("0x" + h[i : i + 2] for i in range(0, len(h), 2)),
            lines(h, 32), "".join("\\x" + h[i : i + 2] for i in range(0, len(h), 2)),
        ]
        for form in forms:
            text = f"é = '{form}' and more"
            assert S.confirmed_spans(text) == [(5, kind, 5 + len(form))], form
            assert S.confirmed_spans(f"é = '{form[:-12]}' and more") == []
    sealed = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF00FF\n\n" + lines(b64(bytes(range(7, 207)))) + "\n-----END RSA PRIVATE KEY-----"
    assert S.confirmed_spans(f"a {sealed} b") == [(2, "der", 2 + len(sealed))]
    assert S.confirmed_spans(sealed.replace("DEK-Info", "Other")) == []


def hostile():
    """Texts of a million characters each, made to send a pattern or a key's reader back over what it has passed."""
    ssh, many = b64(SSH)[:28], 1_000_000
    long = b64(b"\x30\x83\x07\x00\x00\x02\x01\x00\x30\x83\x06\x00\x00\x06\x00")
    yield "line ends after a head", b64(RSA)[:16] + "\n" * many + "!"
    yield "blanks after a head", b64(RSA)[:16] + " " * many + "!"
    yield "a quote after a head", b64(RSA)[:16] + '"' + " " * many + "!"
    yield "many heads", (b64(RSA)[:16] + "\n") * (many // 17)
    yield "many long heads", (long + "\n") * (many // (len(long) + 1))
    yield "many heads of the other kind", (ssh + "\n") * (many // 29)
    yield "heads in hex", "308307000002010030830600000600 " * (many // 31)
    yield "a hex head and quotes", '30"' + " " * many
    yield "begins in headers", "-----BEGIN PRIVATE KEY-----\n" + "A:-----BEGIN PRIVATE KEY-----\n" * (many // 30)
    yield "headers of encryption", "-----BEGIN PRIVATE KEY-----\n" + "Proc-Type: 4,ENCRYPTED\n" * (many // 23) + "A" * 20 + "-----END PRIVATE KEY-----"
    yield "half of a block", "-----BEGIN PRIVATE KEY-----" + "A \n" * (many // 3)
    yield "token heads", "eyAAAAAAAAAA." * (many // 13)
    yield "assignments without end", "token " * (many // 6) + "=" * 9


@pytest.mark.parametrize("name,text", list(hostile()), ids=lambda v: v if len(v) < 40 else "")
def test_hostile_texts_take_linear_time(name, text):
    began = time.process_time()
    S.spans(text)
    assert time.process_time() - began < 4, name


def test_keys_after_false_heads_are_found():
    key = b64(PKCS8)
    text = (b64(RSA)[:16] + "\n") * 3 + lines(key, 40) + " end"
    at = text.index(key[:40])
    assert S.confirmed_spans(text) == [(at, "der", len(text) - 4)]
    parted = "30 83 07 00 00 02 01 00 " + " ".join(PKCS8.hex()[i : i + 2] for i in range(0, 2 * len(PKCS8), 2)) + " zz"
    assert (24, "der", len(parted) - 3) in S.confirmed_spans(parted)
    inner = "-----BEGIN PRIVATE KEY-----\nA:-----BEGIN PRIVATE KEY-----\n" + lines(key) + "\n-----END PRIVATE KEY-----"
    assert [s[1:] for s in S.confirmed_spans(inner)] == [("der", len(inner))]
