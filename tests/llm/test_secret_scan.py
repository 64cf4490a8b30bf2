import base64
import bz2
import gzip
import hashlib
import lzma
import random
import time
import urllib.parse
import zlib

import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_texts import ODD

from loam.llm import secret_scan
from loam.llm.secret_scan import scan_secrets, scan_text

KEY = "AKIA" + "Q7XZ" * 4
PLAIN = f"before {KEY} after"


def url(s):
    return "".join(f"%{b:02X}" for b in s.encode())


def escapes(s):
    return "".join(f"\\u{ord(c):04x}" for c in s)


def entities(s):
    return "".join(f"&#{ord(c)};" for c in s)


def b64(raw):
    return base64.b64encode(raw if isinstance(raw, bytes) else raw.encode()).decode()


def b64url(s):
    return base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")


PACKERS = {"gzip": gzip.compress, "zlib": zlib.compress, "bzip2": bz2.compress, "xz": lzma.compress, "zstd": lambda b: zstandard.ZstdCompressor().compress(b)}
TEXTUAL = {"url": url, "unicode": escapes, "base64": b64}


def test_plain_span_and_digest():
    (f,) = scan_text(PLAIN)
    assert PLAIN[f["start"] : f["end"]] == KEY and f["layers"] == "" and f["rule"] == "cloud_key_id"
    assert f["digest"] == hashlib.sha256(KEY.encode()).hexdigest()


def test_every_order_of_three_encodings():
    for a in TEXTUAL:
        for b in TEXTUAL:
            for c in TEXTUAL:
                hidden = TEXTUAL[a](TEXTUAL[b](TEXTUAL[c](PLAIN)))
                text = f"see {hidden} there"
                found = [f for f in scan_text(text) if f["rule"] == "cloud_key_id"]
                assert found, (a, b, c)
                assert all(4 <= f["start"] < f["end"] <= 4 + len(hidden) for f in found)


def test_spans_point_at_the_encoded_secret():
    text = "x " + url("0123456789 ") + url(KEY) + url(" tail") + " y"
    (f,) = scan_text(text)
    assert text[f["start"] : f["end"]] == url(KEY)
    text = "é " + escapes("ab ") + escapes(KEY)
    (f,) = scan_text(text)
    assert text[f["start"] : f["end"]] == escapes(KEY)
    assert [f["rule"] for f in scan_text("&lt; " + entities(KEY))] == ["cloud_key_id"]


def test_packed_layers_round_trip():
    for name, pack in PACKERS.items():
        found = scan_text("data: " + b64(pack(PLAIN.encode())))
        assert [f["rule"] for f in found] == ["cloud_key_id"] and found[0]["layers"] == f"base64>{name}", name
        twice = scan_text("data: " + b64(gzip.compress(b64(pack(PLAIN.encode())).encode())))
        assert [f["layers"] for f in twice] == [f"base64>gzip>base64>{name}"]
    assert scan_text("u " + "".join(f"%{b:02x}" for b in gzip.compress(PLAIN.encode())))[0]["layers"] == "url>gzip"


def test_false_heads_of_streams_cost_little():
    text = url("é 漢") + " x^2 + x^3" * 100_000 + url(" end")
    began = time.process_time()
    assert scan_text(text) == [] and time.process_time() - began < 20
    assert [f["rule"] for f in scan_text("".join(f"%{b:02x}" for b in "漢 x^2 ".encode() + b"\xff") + b64(zlib.compress(PLAIN.encode())))] == ["cloud_key_id"]


def test_both_base64_alphabets():
    secret = 'password = "ÿþý?>~~~ööö"'.replace(" ", "_") + ' token="abcdefgh12345"'
    assert {f["rule"] for f in scan_text("q=" + b64url(secret))} == {"assigned_secret"}


def test_depth_has_no_limit_and_cycles_end():
    hidden = PLAIN
    for _ in range(12):
        hidden = url(hidden) if len(hidden) < 4000 else b64(zlib.compress(hidden.encode(), 9))
    assert [f["rule"] for f in scan_text(hidden)] == ["cloud_key_id"]
    assert scan_text("%25" * 50 + "%2541") == []


def test_streams_of_any_size_are_scanned_in_windows(monkeypatch):
    monkeypatch.setattr(secret_scan, "WINDOW", 40_000)
    monkeypatch.setattr(secret_scan, "OVERLAP", 200)
    for at in (39_790, 39_990, 79_800, 300_000):
        raw = ("é0 " * 200_000)[:at].encode() + f" {KEY} ".encode() + b"0 " * 900_000
        for name, pack in PACKERS.items():
            found = scan_text("x " + b64(pack(raw)))
            assert [(f["rule"], f["layers"]) for f in found] == [("cloud_key_id", f"base64>{name}")], (at, name)


def test_bytes_of_other_kinds():
    for name in ("utf-16-le", "utf-16-be", "utf-16"):
        (f,) = scan_text("see " + b64(f"pass: é {KEY} ok".encode(name)))
        assert f["layers"] == "base64" and f["rule"] == "cloud_key_id"
    assert [f["rule"] for f in scan_text(b64(b"\x00\xfe\x17\x80" * 9 + KEY.encode() + b"\xff\x00\x01"))] == ["cloud_key_id"]
    assert [f["rule"] for f in scan_text("password=&quot;abcd1234efgh&quot;") if f["layers"] == "unicode"] == ["assigned_secret"]


@settings(deadline=None, max_examples=150)
@given(st.lists(st.sampled_from(["url", "escapes", "entities", "b64", "b64url", "wrapped", "utf16", *PACKERS]), max_size=5), st.text("abc é漢\n", max_size=40), st.integers(0, 2**32))
def test_any_nesting_is_unwrapped(kinds, around, seed):
    """Brute force: a secret is put under any encodings; it must be found, by its digest, within the span of what hides it."""
    r = random.Random(seed)
    key = "AKIA" + "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16))
    hidden = f"{around} {key} {around}"
    for kind in kinds:
        if kind in PACKERS:
            hidden = b64(PACKERS[kind](hidden.encode()))
        elif kind == "wrapped":
            whole = b64(hidden)
            hidden = "\n".join(whole[i : i + 76] for i in range(0, len(whole), 76))
        else:
            hidden = {"url": url, "escapes": escapes, "entities": entities, "b64": b64, "b64url": b64url, "utf16": lambda s: b64(s.encode("utf-16-le"))}[kind](hidden)
        if len(hidden) > 30_000:
            break
    text = f"seen ( {hidden} ) here"
    digest = hashlib.sha256(key.encode()).hexdigest()
    found = [f for f in scan_text(text) if f["digest"] == digest]
    assert found and all(7 <= f["start"] < f["end"] <= 7 + len(hidden) for f in found)


def test_rules_and_clean_text():
    cases = {
        "assigned_secret": 'aws_secret_access_key: "abcd1234efgh"', "private_key": "-----BEGIN RSA PRIVATE KEY-----", "forge_token": "ghp_" + "a1" * 20, "chat_token": "xoxb-1234567890-abc",
        "api_key": "AIza" + "b" * 35, "signed_token": "eyJhbGciOi.eyJzdWIiOiIx.c2lnbmF0dXJl", "payment_key": "sk_live_" + "9z" * 10, "url_password": "postgres://user:hunter22@db.example.com/x",
    }
    for rule, text in cases.items():
        assert rule in [f["rule"] for f in scan_text(f"a {text} b")], rule
    r = random.Random(2)
    for _ in range(200):
        assert scan_text(" ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(1, 30))) for _ in range(40)) + ' say "hello there" 100% sure') == []


def test_in_spark_with_odd_rows(docs):
    d = docs([*ODD, PLAIN, (None, PLAIN), (7, PLAIN), (7, PLAIN)]).withColumnRenamed("lang", "rule")
    got = sorted(((r.doc_id, r.rule, r.start, r.end) for r in scan_secrets(d).collect()), key=str)
    assert got == sorted([(i, "cloud_key_id", 7, 27) for i in (len(ODD), None, 7, 7)], key=str)
    assert scan_secrets(docs([])).collect() == []


def test_base64_over_lines_is_one_layer():
    r = random.Random(5)
    filler = "".join(r.choices("abcdefghijklmnopqrstuvwxyz 0123456789", k=600))
    for pack in (lambda b: b, *PACKERS.values()):
        raw = pack(f"{filler} {KEY} {filler[:57]}".encode())
        for width, join in ((76, "\n"), (64, "\r\n"), (76, "\n  "), (64, "\\n")):
            lines = [b64(raw)[i : i + width] for i in range(0, len(b64(raw)), width)]
            for text in (join.join(lines), "see\n" + join.join(lines) + "\nthanks for all", "file: " + join.join(lines)):
                found = scan_text(text)
                assert [f["rule"] for f in found] == ["cloud_key_id"], (width, join, found)
                assert 0 <= found[0]["start"] < found[0]["end"] <= len(text)
    text = join.join([b64(f"{KEY} a")[:20], b64(f"{KEY} a")[20:]])
    (f,) = scan_text(text)
    assert (f["start"], f["end"]) == (0, text.index(b64(f"{KEY} a")[20:]) + 7)


def test_streams_that_end_too_early_are_reported():
    raw = bytes(random.Random(3).choices(b"abcdefghijklmnop \n", k=4000))
    for name, pack in PACKERS.items():
        whole = pack(raw)
        assert scan_text(b64(whole)) == [], name
        if name in ("gzip", "zlib"):
            assert [f["rule"] for f in scan_text(b64(whole[:-300]))] == ["stream_incomplete"], name


def test_unquoted_values_more_names_and_long_secrets():
    for text, secret in (
        ("password=hunter2hunter2 next", "hunter2hunter2"), ("DB_PASSWORD=abcd1234efgh\nX=1", "abcd1234efgh"), ("/cb?access_token=abc123def456&x=1", "abc123def456"), ('SECRET_KEY = "abcd1234efgh"', "abcd1234efgh"),
        ("private_key: abcd1234efgh;", "abcd1234efgh"), ("pwd=abcd1234efgh", "abcd1234efgh"), ("password" + " " * 20 + "= 'abcd&efgh;1234'", "abcd&efgh;1234"), ("token='" + "a1" * 400 + "'", "a1" * 400),
    ):
        found = [f for f in scan_text(text) if f["rule"] == "assigned_secret" and f["layers"] == ""]
        assert [text[f["start"] : f["end"]] for f in found] == [secret], text
    assert "assigned_secret" in [f["rule"] for f in scan_text("go " + url("?access_token=abc123def456&x=1"))]
    for rule, text in {"signed_token": "eyJ" + "a" * 5000 + ".eyJ" + "b" * 5000 + "." + "c" * 5000, "forge_token": "ghp_" + "a1" * 300, "url_password": "redis://:" + "p" * 300 + "@h", "chat_token": "xoxb-" + "1" * 400, "payment_key": "sk_live_" + "9" * 400}.items():
        (f,) = [f for f in scan_text(f"a {text} b") if f["rule"] == rule]
        assert f["end"] - f["start"] >= 300, rule


def test_open_bounds_stay_linear():
    began = time.process_time()
    for part in ("-eyJ", "token", "token=", "auth ", "://a:", "xoxb-", "ghp_"):
        scan_text(part * 100_000)
    assert time.process_time() - began < 30
