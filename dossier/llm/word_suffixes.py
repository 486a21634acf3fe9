"""Words of a column of texts as arrays, and a multikey three-way quicksort of pointers to their suffixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: 0 letter of a word, 1 blank, 2 end of a piece. A-Z become a-z. Fixed values of the word rules.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
DEPTH = 4
#: Below this many pointers a partition is put in order by one direct sort.
DIRECT = 4096


def slices(batch: pa.RecordBatch, text: int, max_bytes: int):
    """Cuts a batch into runs of rows whose texts have about max_bytes together; a longer text is a run of its own."""
    size = pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False).astype(np.int64)
    run = np.cumsum(size) // max_bytes
    cuts = (np.flatnonzero(np.diff(run)) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, len(batch)]):
        if b > a:
            yield batch.slice(a, b - a)


class Words:
    """All words of some texts: `code` per word in text order, `names` per code, `row` and `piece` per word."""

    def __init__(self, texts: pa.Array):
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        body = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        kind = _KIND[body]
        letter = kind == 0
        begins = letter.copy()
        begins[1:] &= ~letter[:-1]
        # A text's first letter begins a word even if the text before it ends in one.
        edge = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[edge] = letter[edge]
        first = np.flatnonzero(begins)
        self.row = np.searchsorted(offsets, first, side="right") - 1
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[first] + self.row
        inner = np.cumsum(letter, dtype=np.int32)
        lengths = np.append(inner[first] - 1, inner[-1] if len(inner) else 0)
        flat = pa.StringArray.from_buffers(len(first), pa.py_buffer(lengths.astype(np.int32)), pa.py_buffer(_LOWER[body[letter]]))
        coded = flat.dictionary_encode()
        self.code = coded.indices.to_numpy()
        self.names = coded.dictionary

    def keyed(self, langs: list[str], lang: np.ndarray, seed: int) -> None:
        """Sets per distinct (language, word): of_lang, of_word, count and a 64-bit key, which is never 0; `place` is each word's index in these."""
        n = max(len(self.names), 1)
        both, self.place, self.count = np.unique(lang[self.row].astype(np.int64) * n + self.code, return_inverse=True, return_counts=True)
        self.of_lang, self.of_word = both // n, both % n
        names, heads = self.names.to_pylist(), [f"{x}\0" for x in langs]
        pairs = zip(self.of_lang.tolist(), self.of_word.tolist())
        self.key = np.fromiter((xxhash.xxh64_intdigest(heads[g] + names[w], seed) or 1 for g, w in pairs), dtype=np.uint64, count=len(both))

    def suffixes(self, known: np.ndarray) -> np.ndarray:
        """Suffixes from each known word on: (m, DEPTH) of place + 1, within the piece and before the first word not known, then zeros. known: flag per distinct word."""
        ok = known[self.place]
        out = np.zeros((len(ok), DEPTH), dtype=np.int64)
        out[:, 0] = np.where(ok, self.place + 1, 0)
        for k in range(1, min(DEPTH, len(ok))):
            goes_on = (out[:-k, k - 1] != 0) & ok[k:] & (self.piece[k:] == self.piece[:-k])
            out[:-k, k] = np.where(goes_on, self.place[k:] + 1, 0)
        return out


def packed(suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct suffixes (of places, each under 2**31), and how often each occurs."""
    if not len(suffix):
        return suffix, np.zeros(0, dtype=np.int64)
    high, low = suffix[:, 0] << 32 | suffix[:, 1], suffix[:, 2] << 32 | suffix[:, 3]
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    heads = np.flatnonzero(np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])))
    return suffix[order[heads]], np.diff(np.append(heads, len(order)))


def frequent(suffix: np.ndarray, weight: np.ndarray, least: int, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Prefixes (rest zero) of weighted suffixes that weigh `least` and more, and their weights.

    Multikey three-way quicksort: pointers are parted by one key into less, equal and greater. The weight of an equal
    part is the count of its prefix, and it is parted further by the next key. Parts that weigh too little are
    abandoned, as no prefix in them can reach `least`. Small parts are sorted directly.
    """
    prefixes, counts = [], []
    work = [(np.arange(len(suffix)), 0)] if len(suffix) else []
    while work:
        at, d = work.pop()
        if d >= depth or weight[at].sum() < least:
            continue
        if len(at) <= DIRECT:
            for p, c in _direct(suffix[at], weight[at], least, d, depth):
                prefixes.append(p)
                counts.append(c)
            continue
        key = suffix[at, d]
        probe = np.sort(key[np.linspace(0, len(key) - 1, 9).astype(np.int64)])
        pivot = probe[4]
        less, equal = key < pivot, key == pivot
        same = at[equal]
        if pivot:  # zero ends a suffix
            n = weight[same].sum()
            if n >= least:
                p = np.zeros((1, suffix.shape[1]), dtype=np.uint64)
                p[0, : d + 1] = suffix[same[0], : d + 1]
                prefixes.append(p)
                counts.append(np.array([n]))
                work.append((same, d + 1))
        work.append((at[less], d))
        work.append((at[~less & ~equal], d))
    if not prefixes:
        return np.zeros((0, suffix.shape[1]), dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(prefixes), np.concatenate(counts)


def _direct(s: np.ndarray, w: np.ndarray, least: int, d: int, depth: int):
    """Frequent prefixes of a small part that agrees before key d."""
    order = np.lexsort(s[:, d:].T[::-1])
    s, w = s[order], w[order]
    differs = np.zeros(len(s), dtype=bool)
    differs[0] = True
    for k in range(d, depth):
        differs[1:] |= s[1:, k] != s[:-1, k]
        heads = np.flatnonzero(differs)
        n = np.add.reduceat(w, heads)
        on = (n >= least) & (s[heads, k] != 0)
        if not on.any():
            return
        p = s[heads[on]].copy()
        p[:, k + 1 :] = 0
        yield p, n[on]
