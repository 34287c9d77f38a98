"""Secrets in layers that repeat, and behind the first member or 64 MB of compressed data."""

import base64
import bz2
import gzip
import lzma
import re
import urllib.parse
import zlib

import pytest

from heddle.llm import secrets

TOKEN = "token=abcdef123456"
b64 = lambda b: base64.b64encode(b if isinstance(b, bytes) else b.encode()).decode()


@pytest.mark.parametrize("hidden", [b64(b64(TOKEN)), b64(b64(b64(TOKEN))), b64(urllib.parse.quote("token = abcdef123456")), b64("".join(f"\\u{ord(c):04x}" for c in TOKEN)), urllib.parse.quote(b64(b64(TOKEN)) + "=")])
def test_each_place_is_descended(hidden):
    one = secrets.scan(hidden)[1]
    two = secrets.scan(f"{hidden} and {hidden}")[1]
    shift = len(hidden) + 5
    assert one and set(two) >= {*one, *((a + shift, b + shift, k) for a, b, k in one)}


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress])
def test_all_members_are_read(pack):
    hidden = b64(pack(b"nothing here, only words ") + pack(TOKEN.encode()))
    assert secrets.scan(hidden)[1] == [(0, len(hidden), 0)]


def test_content_behind_64_mb_is_read():
    hidden = b64(gzip.compress(b"plain words " * ((68 << 20) // 12) + TOKEN.encode(), 1))
    assert secrets.scan(hidden)[1] == [(0, len(hidden), 0)]


def spans_of(text):
    return secrets.joined(secrets.scan(text)[1])


@pytest.mark.parametrize("made", [
    lambda s: "see %ff" + "".join(f"%{b:02x}" for b in s.encode()) + " end",
    lambda s: "x " + base64.b64encode(s.encode("utf-16")).decode() + " y",
    lambda s: "x " + base64.b64encode(s.encode("utf-16-be")).decode() + " y",
    lambda s: "path/x/" + base64.b64encode(s.encode()).decode().rstrip("="),
    lambda s: "ab" + base64.b64encode(s.encode()).decode(),
    lambda s: "x\n" + "\n".join(re.findall(".{1,20}", base64.b64encode(s.encode()).decode())) + "\n",
    lambda s: "x " + base64.b64encode(bytes(range(128, 250)) + b" " + s.encode() + b" " + bytes(range(128, 250))).decode(),
    lambda s: "x " + base64.b64encode(gzip.compress(b"first member ") + gzip.compress(s.encode())).decode(),
    lambda s: "x " + base64.b64encode(bz2.compress(b"first " * 9) + bz2.compress(s.encode())).decode(),
])
def test_hidden_secrets_are_found(made):
    text = made("here password=abcdef123456 there")
    found = spans_of(text)
    assert found.startswith("assign:")
    start, end = map(int, found.split(",")[0].split(":")[1:])
    assert 0 <= start < end <= len(text)


def test_a_bad_byte_alone_ends():
    assert spans_of("%ff%fe %ff") == "" and spans_of("%") == ""
