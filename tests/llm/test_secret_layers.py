"""Secrets in later members, over line ends, behind odd characters and in layers too large to hold."""

import base64
import bz2
import gzip
import io
import lzma
import random
import tracemalloc
import urllib.parse
import zipfile
import zlib

import pytest

from dossier.llm import secret_scan

SECRET = 'password: "hunter2hunter2"'


def kinds(text):
    base, more, _, closed = secret_scan.findings(text)
    return {(k, text[s:e]) for k, s, e in more}, closed


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress, zlib.compress])
def test_secret_in_a_later_member(pack):
    token = base64.b64encode(pack(b"first member") + pack(b"second") + pack(SECRET.encode())).decode()
    assert kinds(f"see {token} end") == ({("assign", token)}, 0)
    tail = base64.b64encode(pack(b"first member") + SECRET.encode()).decode()
    assert kinds(f"see {tail} end")[0] == {("assign", tail)}


@pytest.mark.parametrize("end", ["\n", "\r\n", "\n  "])
@pytest.mark.parametrize("after", ["", "\nplain words follow", " tail"])
def test_secret_over_line_ends(end, after):
    r = random.Random(3)
    noise = "".join(chr(r.randrange(97, 123)) for _ in range(1500))
    block = end.join(base64.encodebytes(gzip.compress(f"{noise} {SECRET}".encode())).decode().split())
    assert ("assign", block) in kinds(f"-----BEGIN\n{block}{after}")[0] | {(k, t.removesuffix("\nplain")) for k, t in kinds(f"-----BEGIN\n{block}{after}")[0]}
    plain = base64.encodebytes(f"{noise[:45]} {SECRET} {noise[:60]}".encode()).decode().split()
    spans = [t for k, t in kinds(f"mail\n\n{end.join(plain)}{after}")[0] if k == "assign"]
    assert spans and all(end in t for t in spans)
    assert base64.b64decode("".join(plain)).decode()[46 : 46 + len(SECRET)] == SECRET


@pytest.mark.parametrize("odd", [" ", "﻿", "​", "\x00", "�"])
def test_odd_characters_do_not_hide_a_secret(odd):
    token = base64.b64encode(f"note{odd} {SECRET}".encode()).decode()
    assert any(k == "assign" for k, _ in kinds(token)[0])
    assert any(k == "assign" for k, _ in kinds("caf%E9%3Fpassword%3Dhunter2hunter2")[0])


def test_large_layers_are_scanned_in_pieces(monkeypatch):
    monkeypatch.setattr(secret_scan, "MAX_LAYER_BYTES", 1 << 16)
    monkeypatch.setattr(secret_scan, "PIECE", 1 << 12)
    inner = base64.b64encode(gzip.compress(SECRET.encode())).decode()
    for place in (0, 30_000, 65_530, 150_000):
        words = ("some words " * 20_000)[:place] + f" {SECRET} " + "other words " * 9_000
        for raw in (words, words.replace(SECRET, inner)):
            for data in (gzip.compress(raw.encode()), bz2.compress(gzip.compress(raw.encode()))):
                token = base64.b64encode(data).decode()
                assert kinds(f"a {token} b") == ({("assign", token)}, 0)


@pytest.mark.parametrize("front", ["abc-", "data/", "key_", "x-", "ab/c+d_", "Zm9v-", "seven77-"])
@pytest.mark.parametrize("back", ["", "-tail", "/x/y"])
def test_characters_in_front_do_not_hide_a_layer(front, back):
    plain = base64.b64encode(f"noise {SECRET} noise".encode()).decode().rstrip("=")
    assert any(k == "assign" for k, _ in kinds(f"see {front}{plain}{back} end")[0])
    (text,) = [t for k, t in kinds(f"see {front}{plain}{back} end")[0] if k == "assign"]
    assert text in plain and len(text) <= len(SECRET) * 8 // 6 + 3
    for pack in (gzip.compress, bz2.compress, lzma.compress, zlib.compress):
        packed = base64.urlsafe_b64encode(pack(SECRET.encode())).decode().rstrip("=")
        if not back:
            assert any(k == "assign" for k, _ in kinds(f"see {front}{packed} end")[0])


@pytest.mark.parametrize("code", ["utf-16-le", "utf-16-be", "utf-16", "latin-1", "utf-8"])
def test_bytes_of_other_encodings(code):
    token = base64.b64encode(f"caf\xe9 {SECRET} \xdcber".encode(code)).decode()
    assert any(k == "assign" for k, _ in kinds(f"a {token} b")[0])
    assert any(k == "assign" for k, _ in kinds(f"a pre-{token} b")[0])
    twice = base64.b64encode(f"\xe9 {token} \xe9".encode(code)).decode()
    assert any(k == "assign" for k, _ in kinds(f"a {twice} b")[0])


def zipped(*members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for i, m in enumerate(members):
            z.writestr(f"f{i}.txt", m)
    return out.getvalue()


def test_members_of_a_zip():
    token = base64.b64encode(zipped(b"nothing here", gzip.compress(SECRET.encode()))).decode()
    assert kinds(f"a {token} b") == ({("assign", token)}, 0)
    hurt = bytearray(zipped(SECRET.encode(), b"second " * 90))
    hurt[hurt.index(b"f1.txt") + 8] ^= 0xFF
    token = base64.b64encode(bytes(hurt)).decode()
    assert kinds(f"a {token} b") == ({("assign", token)}, 1)
    assert kinds(f"a {base64.b64encode(b'PK' + bytes((3, 4)) + b'x' * 40).decode()} b")[1] >= 1


def test_ordinary_text_opens_nothing():
    r = random.Random(8)
    words = ["/".join("".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(5)) for _ in range(400)]
    assert kinds(" ".join(words))[0] == set()
    noise = base64.b64encode(r.randbytes(30_000)).decode()
    assert kinds(f"{noise} {urllib.parse.quote(noise[:3000])}")[0] == set()


def test_offsets_of_a_large_token_take_little_room():
    token = base64.b64encode((("some words \xe9 " * 120_000) + SECRET).encode()).decode()
    tracemalloc.start()
    assert any(k == "assign" for k, _ in kinds(token)[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(token) > 2_000_000 and peak < 30 * len(token)
