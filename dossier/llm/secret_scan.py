"""Secret scan through nested encodings.

Each text is a work list of layers. A layer is scanned; every URL-escaped, Unicode-escaped or base64 token in it
(compressed data and ZIP members unpacked) becomes a further layer, until none is left. Every decoded character knows
which characters of the layer above it came from, so a find is reported where it stands in the document.

A run of base64 characters may begin with others that are not part of the data (`abc-`, `data/`): it is read at all four
phases, so that what stands in front only becomes a few odd bytes, and packed data is looked for behind each separator.
Bytes that are no UTF-8 are read one by one and without zeros, which shows Latin-1 and UTF-16 alike.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import io
import itertools
import lzma
import re
import zipfile
import zlib
from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
#: Unpacked data is held up to this size; larger layers go through the scan in pieces of about PIECE characters.
MAX_LAYER_BYTES = 64 << 20
PIECE = 4 << 20
#: Characters that two pieces share where a piece of MAX_LAYER_BYTES has no place to cut; counted in n_closed.
OVERLAP = 1 << 20
#: Packings inside each other of a layer that is too large to hold; more are left, and counted in n_closed.
MAX_STREAMS = 64

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16 and more is what the maximal runs of that length are
#: Tokens begin where their run does, so a long run without escapes is passed once.
URL = re.compile(r"(?<![^\s%])[^\s%]*+(?:%[0-9A-Fa-f]{2}[^\s%]*+)+")
URL_BYTES = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPED = re.compile(r"(?<![^\s\\&])(?:[^\s\\&]*+(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});))+[^\s\\&]*")
ESCAPE = re.compile(r"((?:\\u[0-9A-Fa-f]{4})+)|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over several lines, as MIME and PEM write it.
LINES64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}")
LINE64 = re.compile(r"[A-Za-z0-9+/_-]+")
#: How gzip, bz2, xz, ZIP and zlib data begin in base64, behind a separator.
PACKED64 = re.compile(r"(?<=[-_/+])(?:H4sI|Qlpo|/Td6|UEsD|e[AFJN])")
#: Base64 characters that are unpacked on trial.
TRIAL = 4096
#: Places that no find and no encoded token spans.
CUT = re.compile(r"(?<![:=\s])[\x20\t](?![:=\s])|\n\n|(?<![A-Za-z0-9+/_=:\s-])\n(?![:=\s])")
_BARE = str.maketrans("-_", "+/", "\r\n\x20\t")
OUT = "array<struct<kind:string,start:long,end:long>>"


def scan(text: str):
    """(kind, start, end) of one layer; leftmost matches per kind, those that fail their test dropped."""
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if len(m[1]) >= 12:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 18:
                yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


class _Same:
    """A sequence that has the same item everywhere."""

    def __init__(self, item):
        self.item = item

    def __getitem__(self, i):
        return self.item


class _Based:
    """Source range of each byte of decoded base64; pos: places of the characters, n: end of the token."""

    def __init__(self, pos, n: int):
        self.pos, self.n = pos, n

    def __getitem__(self, i):
        last = ((i + 1) * 8 + 5) // 6 - 1
        return self.pos[i * 8 // 6], self.n if last >= len(self.pos) else self.pos[last] + 1


class _Chars:
    """Source range of each character; starts: its first byte, with an end; at: source range per byte."""

    def __init__(self, starts, at):
        self.starts, self.at = starts, at

    def __getitem__(self, i):
        return self.at[self.starts[i]][0], self.at[self.starts[i + 1] - 1][1]


class _Inside:
    """Places in the document of the characters of a layer that was decoded from the one above it, from a on."""

    def __init__(self, outer, a: int, at):
        self.outer, self.a, self.at = outer, a, at

    def __getitem__(self, i):
        x, y = self.at[i]
        return (self.outer[self.a + x][0], self.outer[self.a + y - 1][1]) if self.outer else (self.a + x, self.a + y)


def _decoded(raw: bytes, at):
    """Characters of UTF-8 bytes with the source range of each; at: source range per byte. Other bytes stay alone."""
    text = raw.decode("utf-8", "surrogateescape")
    if len(text) == len(raw):
        return text, at
    starts = array("q", [0])
    for c in text:
        k = ord(c)
        starts.append(starts[-1] + (1 if k < 0x80 or 0xDC80 <= k <= 0xDCFF else 2 if k < 0x800 else 3 if k < 0x10000 else 4))
    return text, _Chars(starts, at)


def unquoted(token: str):
    text, at, last = [], [], 0
    for m in URL_BYTES.finditer(token):
        text.append(token[last : m.start()])
        at += [(i, i + 1) for i in range(last, m.start())]
        raw = bytes.fromhex(m[0].replace("%", ""))
        got = _decoded(raw, [(m.start() + 3 * i, m.start() + 3 * i + 3) for i in range(len(raw))])
        text.append(got[0])
        at += [got[1][i] for i in range(len(got[0]))]
        last = m.end()
    return "".join(text) + token[last:], at + [(i, i + 1) for i in range(last, len(token))]


def unescaped(token: str):
    text, at, last = [], [], 0
    for m in ESCAPE.finditer(token):
        text.append(token[last : m.start()])
        at += [(i, i + 1) for i in range(last, m.start())]
        if m[1]:
            units = [int(m[1][i + 2 : i + 6], 16) for i in range(0, len(m[1]), 6)]
            got = b"".join(u.to_bytes(2, "little") for u in units).decode("utf-16-le", "replace")
            i = m.start()
            for c in got:
                n = 12 if ord(c) > 0xFFFF else 6
                at.append((i, i + n))
                i += n
        else:
            code = int(m[2], 16) if m[2] else int(m[3]) if m[3] else int(m[4], 16)
            got = chr(code) if code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else "�"
            at.append(m.span())
        text.append(got)
        last = m.end()
    return "".join(text) + token[last:], at + [(i, i + 1) for i in range(last, len(token))]


def _opener(raw: bytes):
    """A fresh decompressor for data that starts so, or None."""
    if raw[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] * 256 + raw[1]) % 31 == 0:
        return zlib.decompressobj()
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _members(chunks):
    """Unpacked bytes of compressed data, piece by piece, member after member; what follows the last one comes as it is.

    Damaged or cut data gives what can be read before the damage.
    """
    chunks, d, rest = iter(chunks), None, b""
    while True:
        if d is None:
            # Zeros may stand between members; six bytes tell what follows.
            rest = rest.lstrip(b"\0")
            while len(rest) < 6 and (more := next(chunks, None)) is not None:
                rest = (rest + more).lstrip(b"\0")
            if not rest:
                return
            if (d := _opener(rest)) is None:
                yield rest
                yield from chunks
                return
        try:
            if isinstance(d, bz2.BZ2Decompressor | lzma.LZMADecompressor):
                out = d.decompress(rest, 1 << 16)
                wants = d.needs_input
                rest = b""
            else:
                out = d.decompress(rest, 1 << 16)
                rest = d.unconsumed_tail
                wants = not rest and len(out) < 1 << 16
        except (zlib.error, OSError, lzma.LZMAError, EOFError):
            return
        if out:
            yield out
        if d.eof:
            rest, d = d.unused_data, None
        elif wants:
            if (more := next(chunks, None)) is None:
                return
            rest = more


def _started(chunks):
    """(first bytes, all chunks again)."""
    chunks, head = iter(chunks), b""
    while len(head) < 6 and (more := next(chunks, None)) is not None:
        head += more
    return head, itertools.chain([head], chunks)


def _zipped(raw: bytes):
    """Bytes of the members of a ZIP one after the other, compressed ones unpacked. Raises OverflowError at the end if one could not be read."""
    failed = False
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for info in z.infolist():
                try:
                    with z.open(info) as f:
                        yield from _members(iter(lambda: f.read(1 << 16), b""))
                except (zipfile.BadZipFile, zlib.error, OSError, lzma.LZMAError, EOFError, RuntimeError, NotImplementedError):
                    failed = True
                yield b"\n\n"
    except (zipfile.BadZipFile, OSError, ValueError):
        failed = True
    if failed:
        raise OverflowError


def _unpacked(raw: bytes):
    """What compressed data holds, or an iterator over it if that is MAX_LAYER_BYTES and more; None if it isn't compressed.

    A ZIP always comes as an iterator, so what can be read of it is scanned also where a member is damaged or locked.
    """
    if raw[:4] == b"PK\x03\x04":
        return _zipped(raw)
    if _opener(raw) is None:
        return None
    chunks, held, size = _members([raw]), [], 0
    for c in chunks:
        held.append(c)
        size += len(c)
        if size >= MAX_LAYER_BYTES:
            return itertools.chain(held, chunks)
    return b"".join(held) if held else None


def _pieces(chunks):
    """Text of a stream in pieces that are cut where nothing spans the cut. Raises OverflowError at its end if there was no such place, or if the stream ends so."""
    decoder, held, cut_anywhere = codecs.getincrementaldecoder("utf-8")("surrogateescape"), "", False
    new, size = [], 0

    def whole():
        nonlocal cut_anywhere
        try:
            yield from chunks
        except OverflowError:
            cut_anywhere = True
        yield None

    for c in whole():
        new.append(decoder.decode(c or b"", final=c is None))
        size += len(new[-1])
        if c is not None and size < PIECE:
            continue
        held += "".join(new)
        new, size, at = [], 0, None
        if c is None:
            break
        for m in CUT.finditer(held, max(0, len(held) - PIECE)):
            # Both sides of a cut must be known.
            at = m.start() + 1 if m.end() < len(held) else at
        if at:
            yield held[:at]
            held = held[at:]
        elif len(held) >= MAX_LAYER_BYTES:
            cut_anywhere = True
            yield held
            held = held[-OVERLAP:]
    if held:
        yield held
    if cut_anywhere:
        raise OverflowError


def _bare(token: str):
    """(base64 characters of a token in one alphabet, their places)."""
    if token.isascii() and not token.count("\n"):
        return token.rstrip("=").translate(_BARE), range(len(token.rstrip("=")))
    bare = token.rstrip("=")
    return bare.translate(_BARE), array("q", [i for i, c in enumerate(bare) if c not in "\r\n\x20\t"])


def _raw(bare: str) -> bytes:
    return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)


def unbased(token: str):
    """Text behind a base64 token, over one line or several, or None; a compressed one is unpacked as often as it is compressed.

    Bytes that are not UTF-8 give None, see hidden. A layer too large to hold comes as an iterator over its texts.
    """
    bare, pos = _bare(token)
    if len(bare) % 4 == 1:
        return None
    try:
        raw = _raw(bare)
    except binascii.Error:
        return None
    seen, packed = set(), False
    while (inner := _unpacked(raw)) is not None:
        packed = True
        if not isinstance(inner, bytes):
            return _pieces(_opened(inner))
        if (h := hashlib.sha256(inner).digest()) in seen:
            return None
        seen.add(h)
        raw = inner
    n = len(token)
    if packed:
        text = raw.decode("utf-8", "surrogateescape")
        return text.replace("\0", "") if "\0" in text else text, _Same((0, n))
    try:
        raw.decode()
    except UnicodeDecodeError:
        return None
    # UTF-16 of plain letters is UTF-8 with zeros in it.
    return odd_bytes(token, 0) or _decoded(raw, _Based(pos, n)) if b"\0" in raw else _decoded(raw, _Based(pos, n))


def odd_bytes(token: str, phase: int):
    """Bytes of a base64 token from character `phase` on, one character each, zeros left out; None unless a secret or a token shows there."""
    bare, pos = _bare(token)
    bare = bare[phase:]
    bare = bare[: len(bare) - (len(bare) % 4 == 1)]
    try:
        raw = _raw(bare)
    except binascii.Error:
        return None
    text = raw.decode("latin-1")
    starts = array("q", [i for i, b in enumerate(raw) if b]) if b"\0" in raw else None
    text = text.replace("\0", "") if starts else text
    if next(scan(text), None) is None and not BASE64.search(text) and not URL_BYTES.search(text) and not ESCAPE.search(text):
        return None
    at = _Based(pos[phase : phase + len(bare)], len(token))
    if starts:
        starts.append(starts[-1] + 1)
        return text, _Chars(starts, at)
    return text, at


def packed_parts(run: str):
    """Starts inside a run of base64 characters, behind a separator, where packed data begins."""
    for m in PACKED64.finditer(run, 1):
        part = run[m.start() : m.start() + TRIAL].rstrip("=").translate(_BARE)
        try:
            head = _raw(part[: len(part) - (len(part) % 4 == 1)])
            d = _opener(head)
            if head[:4] == b"PK\x03\x04" or d is not None and (d.decompress(head) or not d.eof):
                yield m.start()
        except (binascii.Error, zlib.error, OSError, lzma.LZMAError, EOFError):
            continue


def hidden(run: str):
    """(start, layer) of what a run holds that is no base64 of text or packed data from its first character on."""
    found = [(i, got) for i in packed_parts(run) if (got := unbased(run[i:]))]
    # Packed data goes on to the end; its bytes say nothing by themselves.
    yield from found or [(0, got) for phase in range(4) if (got := odd_bytes(run, phase))]


def _opened(chunks):
    """The bytes of a stream, unpacked as often as it is compressed."""
    for _ in range(MAX_STREAMS):
        head, chunks = _started(chunks)
        if _opener(head) is None:
            return chunks
        chunks = _members(chunks)
    raise OverflowError


def over_lines(text: str):
    """(start, end) of base64 that goes over line ends.

    Lines of one width with a last one that is not wider belong together; so may all lines that follow each other.
    The last line may be a word of the text after them, so each run is tried without it, too.
    """
    for m in LINES64.finditer(text):
        lines = [x.span() for x in LINE64.finditer(text, m.start(), m.end())]
        runs, at = {(0, len(lines))}, 0
        while at < len(lines):
            width, end = lines[at][1] - lines[at][0], at + 1
            while end < len(lines) and lines[end][1] - lines[end][0] == width:
                end += 1
            runs.add((at, min(len(lines), end + 1) if end < len(lines) and lines[end][1] - lines[end][0] < width else end))
            at = end
        for a, b in sorted(runs | {(a, b - 1) for a, b in runs} | {(1, len(lines))}):
            if b - a > 1 and sum(y - x for x, y in lines[a:b]) >= 16:
                yield lines[a][0], m.end() if b == len(lines) else lines[b - 1][1]


def tokens(text: str):
    """Encoded tokens of a layer: (start, end, decoder)."""
    if "%" in text:
        for m in URL.finditer(text):
            yield *m.span(), unquoted
    if "\\" in text or "&#" in text:
        for m in ESCAPED.finditer(text):
            yield *m.span(), unescaped
    for m in BASE64.finditer(text):
        yield *m.span(), unbased
    if "\n" in text:
        for a, b in over_lines(text):
            yield a, b, unbased


def findings(text: str):
    """(base spans, further spans, layers opened, layers left closed) of one document."""
    base = set(scan(text))
    more, layers, closed = set(), 0, 0
    work = [(text, None, frozenset())]
    while work:
        layer, outer, chain = work.pop()
        if not isinstance(layer, str):
            # A layer in pieces: the next one goes first, the others wait.
            try:
                inner = next(layer, None)
            except OverflowError:
                closed += 1
                continue
            if inner is None:
                continue
            work.append((layer, outer, chain))
            digest = hashlib.blake2b(inner.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            if digest in chain:
                continue
            more |= {(kind, *outer.item) for kind, _, _ in scan(inner)}
            layer, chain = inner, chain | {digest}
        opened = []
        for a, b, decode in tokens(layer):
            try:
                got = decode(layer[a:b])
                inside = [(0, got)] if got else hidden(layer[a:b]) if decode is unbased else ()
                opened += [(a + i, b, got) for i, got in inside]
            except OverflowError:
                closed += 1
        for a, b, got in opened:
            if not isinstance(got, tuple):
                layers += 1
                work.append((got, _Same((outer[a][0], outer[b - 1][1]) if outer else (a, b)), chain))
                continue
            if got[0] == layer[a:b]:
                continue
            inner, at = got
            digest = hashlib.blake2b(inner.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            if digest in chain or not inner:
                continue  # a layer that holds itself
            if isinstance(at, _Same):
                x, y = at.item
                place = _Same((outer[a + x][0], outer[a + y - 1][1]) if outer else (a + x, a + y))
            else:
                place = _Inside(outer, a, at)
            layers += 1
            more |= {(kind, place[s][0], place[e - 1][1]) for kind, s, e in scan(inner)}
            work.append((inner, place, chain | {digest}))
    return base, more - base, layers, closed


def secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, further, n_layers, n_closed) per row of docs.

    base holds the spans of the text itself, further those of decoded layers, placed in the text; both are
    sorted by start, kind and end, count code points and end exclusive. A null text is empty. Null and repeated
    keys and repeated rows are scanned like others; an empty table gives no rows; other columns are not read.
    """
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    rows = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in sorted(spans, key=order)]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            found = [findings(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([rows(f[0]) for f in found], kind), pa.array([rows(f[1]) for f in found], kind), pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int64())],
                names=[key, "base", "further", "n_layers", "n_closed"],
            )

    t = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {t}, base {OUT}, further {OUT}, n_layers long, n_closed long")


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined in array order."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def in_order(spans: Column, kinds=KINDS) -> Column:
    """Spans by start, then kind as listed, then end."""
    listed = F.array(*[F.lit(k) for k in kinds])
    keyed = F.transform(spans, lambda x: F.struct(x.start.alias("start"), F.array_position(listed, x.kind).alias("o"), x.end.alias("end"), x.kind.alias("kind")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x.kind.alias("kind"), x.start.alias("start"), x.end.alias("end")))
