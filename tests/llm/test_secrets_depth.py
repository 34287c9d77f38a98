"""Escapes inside escapes: linear in the text, with the same spans; secrets in layers of mixed data."""

import base64
import bz2
import gzip
import time
import tracemalloc
import zlib

import pytest

from heddle.llm import secrets as S


def nested(text, n):
    for _ in range(n):
        text = text.replace("%", "%25")
    return text


@pytest.mark.parametrize("n", [1, 7, 8, 9, 12, 40])
def test_deep_percent_escapes_are_found(n):
    text = "x " + nested("password%3Dhunter2222 é", n) + " y"
    _, every = S.scan(text)
    assert any(text[a:b].startswith("password%") and text[a:b].endswith("hunter2222") for a, b, k in every if k == 0)


def test_long_runs_take_linear_time():
    for text in ("%" + "25" * 500_000, "\\" + "u005c" * 200_000, "\\" + "x5c" * 300_000, "%255" * 250_000):
        began = time.process_time()
        S.scan(text)
        assert time.process_time() - began < 12


def test_the_fixpoint_equals_the_levels():
    for text in ("%25252525252525252541b", "a%2525252525252525252525C3%25A9z", "\\u005cu005cu005cu005cu005cu005cu005cu005cu005cx41", "%5cu0025" * 3 + "41", "%25zz%2", "%FF%25FF", "\\U0000005cu{41}"):
        one, level = S._Layer(text, [0], [(0, len(text))], [True]), None
        whole = S._fixpoint(one)
        level = one
        for _ in range(60):
            new = (S._rewritten(level, S._PERCENT, S._percent) if "%" in level.text else None) or S._rewritten(level, S._ESCAPE, S._escape)
            if new is None:
                break
            level = new
        assert (whole or one).text == level.text
        for k in range(len(level.text) if "FF" not in text else 0):  # a byte that is no UTF-8 is one piece in a level, three signs in the fixpoint
            assert (whole or one).back(k, k + 1) == level.back(k, k + 1)


def test_secrets_nested_in_mixed_data():
    inner = base64.b64encode(b"password = hunter2222")
    for around in (bytes(range(0x80, 0xBC)), b"plain text around it, plain text "):
        text = "see " + base64.b64encode(around + b" " + inner + b" " + around).decode() + " end"
        _, every = S.scan(text)
        assert [(k, text[a:b].count(" ")) for a, b, k in every if k == 0] == [(0, 0)]


def bomb(size: int, inner: bytes, fill: bytes = b"\0") -> bytes:
    """Gzip data of `size` megabytes of one sign with some bytes near the end."""
    d = zlib.compressobj(9, zlib.DEFLATED, 31)
    block = fill * (1 << 20)
    return b"".join([*(d.compress(block) for _ in range(size - 1)), d.compress(inner), d.compress(block), d.flush()])


def test_a_bomb_is_read_through_without_holding_it():
    secret = b" password = hunter2222 "
    for fill in (b"\0", b"A"):
        text = "see " + base64.b64encode(bomb(200, secret, fill)).decode()
        tracemalloc.start()
        spans = S.scan(text)[1]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert spans == [(4, len(text), 0)] and peak < 100 << 20


def test_secrets_across_the_border_of_windows_are_found(monkeypatch):
    monkeypatch.setattr(S, "WINDOW", 4096)
    monkeypatch.setattr(S, "OVERLAP", 1024)
    secret = base64.b64encode(b"say password = hunter2222 now").decode().encode()
    for before in range(4096 - 60, 4096 + 20, 7):
        for inner in (b"token=abcdefgh", secret):
            content = b"." * before + b" " + inner + b" " + b"." * 9000
            text = base64.b64encode(bz2.compress(gzip.compress(content))).decode()
            assert S.scan(text)[1] == [(0, len(text), 0)], before


def test_what_stands_behind_members_and_what_only_looks_compressed():
    secret = b"password = hunter2222"
    for raw in (gzip.compress(b"abc") + b"\0\0" + secret, b"BZh is here " + secret, b"x^2 and " + secret, gzip.compress(secret)[:-4], gzip.compress(b"a") + gzip.compress(secret)):
        text = base64.b64encode(raw).decode()
        assert S.scan(text)[1] == [(0, len(text), 0)]
    deep = secret
    for k in range(400):
        deep = (gzip, bz2, zlib)[k % 3].compress(deep)
    text = base64.b64encode(deep).decode()
    assert S.scan(text)[1] == [(0, len(text), 0)]
