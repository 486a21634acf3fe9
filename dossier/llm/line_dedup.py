"""Fuzzy line dedup.

Lines are normalised (lower case, single spaces) and fingerprinted by SimHash over their words. Fingerprints that
differ in at most MAX_BITS bits agree in two of MAX_BITS + 2 blocks, so lines meet on pairs of blocks; edit
similarity of the texts decides. Of each connected group one occurrence stays, the first by document and line.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.llm.base import BROADCAST_KEYS, fits, materialize, some
from dossier.llm.components import components

MIN_WORDS = 5
MIN_SIMILARITY = 0.8
MAX_BITS = 3
#: Lines of one bucket whose pairs are listed; in larger buckets chunks of as many lines meet two by two.
CHUNK = 64
#: Lines of a large bucket that meet in one task.
LARGE_CHUNK = 2_000
#: Columns after which the edit distance looks whether it can still be small enough.
LOOK = 64
#: Text that is hashed at a time in a worker, in bytes.
PIECE = 1 << 20
#: Powers are kept for lengths in steps of so many bytes.
_STEP = 1 << 18
_ODD = 0x9E3779B97F4A7C15


#: Bytes of words: letters, digits and all that is not ASCII.
_LETTERS = np.array([b > 127 or chr(b).isalnum() for b in range(256)])


def normal(line: str) -> bytes:
    raw = line.lower().encode("utf-8", "surrogatepass")
    bare = raw.strip()
    return b" ".join(bare.split()) if any(x in bare for x in (b"  ", b"\t", b"\r", b"\x0b", b"\x0c", b"\n")) else bare


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_ODD, pow(_ODD, -1, 1 << 64)):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def line_fingerprints(lines: list[bytes]) -> np.ndarray:
    """SimHash over the words of each line (single-spaced, not empty), for all lines at once.

    A word's hash is a polynomial of its bytes, taken from prefix sums over the joined lines. Signs that stand
    alone (table bars, dashes) do not count: a line full of them would look like any other such line. A line of
    nothing else has fingerprint 0.
    """
    raw = np.frombuffer(b" ".join(lines) + b" ", dtype=np.uint8)
    up, down = _powers((len(raw) // _STEP + 1) * _STEP)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    ends = np.flatnonzero(raw == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    counts = np.bitwise_or.reduceat(_LETTERS[raw], starts)
    hashes = _mixed((sums[ends] - sums[starts]) * down[starts])[counts]
    edges = np.cumsum([0, *map(len, lines)]) + np.arange(len(lines) + 1)
    first = np.searchsorted(starts[counts], edges)
    n = np.diff(first)
    if not len(hashes):
        return np.zeros(len(lines), dtype="<i8")
    # Byte lanes hold up to 255 words; runs are cut there.
    runs = -(-n // 255)
    owner = np.repeat(np.arange(len(lines)), runs)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    cuts = first[owner] + 255 * nth
    words = np.stack([np.add.reduceat((hashes >> np.uint64(k)) & np.uint64(0x0101010101010101), cuts) for k in range(8)], axis=1)
    lanes = words.view(np.uint8).reshape(-1, 8, 8).swapaxes(1, 2).reshape(-1, 64)
    ones = np.zeros((len(lines), 64), dtype=np.int64)
    heads = np.flatnonzero(nth == 0)
    ones[owner[heads]] = np.add.reduceat(lanes, heads, axis=0, dtype=np.int64) if len(heads) < len(owner) else lanes
    bits = np.packbits((2 * ones > n[:, None]).astype(np.uint8), axis=1, bitorder="little")
    return bits.view("<i8").ravel()


def occurrences(docs: DataFrame, key: str, text: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, line, lid, chk, fp) per line of at least min_words words: two hashes of the normalised line, and its fingerprint."""

    def flush(held):
        lines = [x[2] for x in held]
        h = [xxhash.xxh3_128_intdigest(x) for x in lines]
        lid = np.array([x & 0xFFFFFFFFFFFFFFFF for x in h], dtype=np.uint64).view(np.int64)
        chk = np.array([x >> 64 for x in h], dtype=np.uint64).view(np.int64)
        return [pa.array([x[1] for x in held], pa.int32()), pa.array(lid), pa.array(chk), pa.array(line_fingerprints(lines))]

    def run(batches):
        names = ["doc", "line", "lid", "chk", "fp"]
        for b in batches:
            held, size = [], 0
            for i, t in enumerate(b.column(1)):
                for k, line in enumerate((t.as_py() or "").split("\n")):
                    bare = normal(line)
                    if bare.count(b" ") >= min_words - 1 and bare:
                        held.append((i, k, bare))
                        size += len(bare)
                if size >= PIECE:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([x[0] for x in held])), *flush(held)], names=names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([x[0] for x in held])), *flush(held)], names=names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc"), F.col(text).cast("string")).mapInArrow(run, f"doc {kind}, line int, lid long, chk long, fp long")


def _least_in_column(plus: int, minus: int, size: int, at: int, left: int) -> int:
    """Least distance that a way through a column can come to: its value there and what the lengths left differ by."""
    steps = [np.unpackbits(np.frombuffer(x.to_bytes(size // 8 + 1, "little"), np.uint8), count=size, bitorder="little") for x in (plus, minus)]
    values = np.concatenate(([at], at + np.cumsum(steps[0].astype(np.int32) - steps[1])))
    return int((values + np.abs(np.arange(size, -1, -1) - left)).min())


@functools.lru_cache(maxsize=1)
def _places(a: str) -> dict[str, int]:
    """The places of every character as bits; kept for the next text that meets the same one."""
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    return at


def edit_similarity(a: str, b: str, least: float = 0.0) -> float:
    """1 - Levenshtein distance / longer length, by Myers' bit-parallel columns over what is left between common ends.

    0 as soon as it is sure to be below least.
    """
    longest = max(len(a), len(b))
    if not longest:
        return 1.0
    allowed = (1 - least) * longest + 1e-9
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    i = 0
    while i < min(len(a), len(b)) and a[-1 - i] == b[-1 - i]:
        i += 1
    if i:
        a, b = a[:-i], b[:-i]
    if not a or not b:
        return 1 - max(len(a), len(b)) / longest
    at = _places(a)
    n, top, full = len(a), 1 << (len(a) - 1), (1 << len(a)) - 1
    plus, minus, distance = full, 0, n
    for j, c in enumerate(b):
        if least and j and not j % LOOK and _least_in_column(plus, minus, n, j, len(b) - j) > allowed:
            return 0.0
        eq = at.get(c, 0)
        d0 = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        hp = minus | (full & ~(d0 | plus))
        hm = plus & d0
        if hp & top:
            distance += 1
        elif hm & top:
            distance -= 1
        hp = (hp << 1 | 1) & full
        hm = hm << 1 & full
        plus = hm | (full & ~(d0 | hp))
        minus = hp & d0
    return 1 - distance / longest


def similar(a: str, b: str, least: float) -> bool:
    """edit_similarity(a, b) >= least, settled by cheap bounds where they suffice."""
    longest = max(len(a), len(b))
    allowed = (1 - least) * longest + 1e-9
    if abs(len(a) - len(b)) > allowed:
        return False
    x, y = a.split(" "), b.split(" ")
    # Replacing each differing word costs at most its length.
    if len(x) == len(y) and sum(max(len(v), len(w)) for v, w in zip(x, y) if v != w) <= allowed:
        return True
    return edit_similarity(a, b, least) >= least - 1e-12


def _blocks(max_bits: int) -> list[tuple[int, int]]:
    n = max_bits + 2
    edges = [round(64 * k / n) for k in range(n + 1)]
    return list(zip(edges, edges[1:]))


def block_keys(fp, max_bits: int = MAX_BITS):
    """Pairs of blocks as numbers: fingerprints within max_bits share at least one."""
    cuts = _blocks(max_bits)
    block = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")) for a, b in cuts]
    keys = []
    for number, (i, j) in enumerate(itertools.combinations(range(len(cuts)), 2)):
        keys.append(F.shiftleft(block[i], cuts[j][1] - cuts[j][0]).bitwiseOR(block[j]).bitwiseOR(F.lit(number << 40).cast("long")))
    return F.array(*keys)


def first_key(x, max_bits: int = MAX_BITS):
    """Number of the first key that two fingerprints share; x: their exclusive or."""
    cuts = _blocks(max_bits)
    equal = [F.shiftrightunsigned(x, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")) == 0 for a, b in cuts]
    number = F.lit(None).cast("int")
    for n, (i, j) in reversed(list(enumerate(itertools.combinations(range(len(cuts)), 2)))):
        number = F.when(equal[i] & equal[j], n).otherwise(number)
    return number


def line_texts(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """(lid, words) for wanted lines (lid, doc): normalised texts, read again from the documents that have them."""
    lists = materialize(wanted.groupBy("doc").agg(F.collect_set("lid").alias("lids")), "wanted")
    lists = F.broadcast(lists) if fits(lists, BROADCAST_KEYS) else lists

    def run(batches):
        for b in batches:
            out = {}
            for t, lids in zip(b.column(0), b.column(1)):
                want = set(lids.as_py())
                for line in (t.as_py() or "").split("\n"):
                    bare = normal(line)
                    lid = int(np.uint64(xxhash.xxh3_128_intdigest(bare) & 0xFFFFFFFFFFFFFFFF).astype(np.int64))
                    if lid in want:
                        out[lid] = bare
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array([v.decode("utf-8", "replace") for v in out.values()], pa.string())], names=["lid", "words"])

    own = docs.select(F.col(text).cast("string").alias("text"), F.col(key).alias("own"))
    got = own.join(lists, F.col("own").eqNullSafe(F.col("doc"))).select("text", "lids").mapInArrow(run, "lid long, words string")
    return got.dropDuplicates(["lid"])


def _verified(min_similarity: float):
    def run(batches):
        for b in batches:
            keep = [similar(x.as_py(), y.as_py(), min_similarity) for x, y in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _chunk_pair(min_similarity: float, max_bits: int):
    """Links inside a pair of chunks of one bucket; pairs that are connected already are not compared.

    Of the buckets that two lines share, only the first one compares them.
    """
    cuts = _blocks(max_bits)
    pairs = list(itertools.combinations(range(len(cuts)), 2))

    def run(pdf):
        import pandas as pd

        a, b = pdf[pdf.side == 0], pdf[pdf.side == 1]
        nodes = np.unique(np.concatenate([a.lid.to_numpy(np.int64), b.lid.to_numpy(np.int64)]))
        group = np.arange(len(nodes))
        left, right = np.searchsorted(nodes, a.lid), np.searchsorted(nodes, b.lid)
        p, q = pairs[int(pdf.k.iloc[0]) >> 40]
        fps, own, others, links = b.fp.to_numpy(np.int64), a.words.tolist(), b.words.tolist(), []
        for at in range(0, len(a), 256):
            x = (a.fp.to_numpy(np.int64)[at : at + 256, None] ^ fps[None, :]).view(np.uint64)
            i, j = np.nonzero(np.bitwise_count(x) <= max_bits)
            equal = np.stack([(x[i, j] >> np.uint64(s)) & np.uint64((1 << (e - s)) - 1) == 0 for s, e in cuts])
            nth = np.cumsum(equal, axis=0)
            first = equal[p] & equal[q] & (nth[p] == 1) & (nth[q] == 2)
            for i, j in zip((i[first] + at).tolist(), j[first].tolist()):
                u, v = left[i], right[j]
                if group[u] != group[v] and similar(own[i], others[j], min_similarity):
                    group[group == group[v]] = group[u]
                    links.append((nodes[u], nodes[v]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _near_members(max_bits: int):
    """Lines of a pair of chunks that have another line within max_bits there, by fingerprints alone."""

    def run(pdf):
        import pandas as pd

        a, b = pdf[pdf.side == 0], pdf[pdf.side == 1]
        lids, fps = b.lid.to_numpy(np.int64), b.fp.to_numpy(np.int64)
        in_a, in_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        for at in range(0, len(a), 256):
            part = slice(at, at + 256)
            x = (a.fp.to_numpy(np.int64)[part, None] ^ fps[None, :]).view(np.uint64)
            near = (np.bitwise_count(x) <= max_bits) & (a.lid.to_numpy(np.int64)[part, None] != lids[None, :])
            in_a[part], in_b = near.any(axis=1), in_b | near.any(axis=0)
        return pd.concat([a[in_a], b[in_b]])[["k", "lid", "fp", "n"]].drop_duplicates("lid")

    return run


def _dealt(rows: DataFrame, *carried: str) -> DataFrame:
    """Rows (k, lid, fp, n) of large buckets, once for every pair of chunks (k, x, y) and side that they are in."""
    parts = F.ceil(F.col("n") / LARGE_CHUNK).cast("int")
    own, cols = F.pmod(F.xxhash64("lid"), parts).cast("int").alias("own"), ["lid", "fp", "n", *carried]
    rows = rows.select("k", *cols, own, F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    as_left = rows.filter("own <= other").select("k", F.col("own").alias("x"), F.col("other").alias("y"), F.lit(0).alias("side"), *cols)
    as_right = rows.filter("other <= own").select("k", F.col("other").alias("x"), F.col("own").alias("y"), F.lit(1).alias("side"), *cols)
    return as_left.unionByName(as_right)


def fuzzy_links(docs: DataFrame, lines: DataFrame, key: str, text: str, max_bits: int = MAX_BITS, min_similarity: float = MIN_SIMILARITY, chunk: int = CHUNK) -> DataFrame:
    """(a, b) links between different normalised lines. lines: written table of (lid, fp, doc), one row per line."""
    keyed = lines.select("lid", "fp", F.explode(block_keys(F.col("fp"), max_bits)).alias("k")).filter("k is not null")
    met = keyed.withColumn("n", F.count("*").over(W.partitionBy("k"))).filter("n > 1")
    # Both sides and the large buckets come from one exchange by key; nothing is dealt out a second time.
    left, right = met.filter(F.col("n") <= chunk).alias("l"), met.filter(F.col("n") <= chunk).alias("r")
    x = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    near = (F.col("l.lid") < F.col("r.lid")) & (F.bit_count(x) <= max_bits) & (first_key(x, max_bits) == F.shiftright("l.k", 40))
    close = left.join(right, F.col("l.k") == F.col("r.k")).filter(near).select(F.col("l.lid").alias("lid"), F.col("r.lid").alias("lid2"), F.col("l.k").alias("k"), F.col("l.fp").alias("fp"), F.col("l.n").alias("n"))
    large = met.filter(F.col("n") > chunk).select("lid", F.lit(None).cast("long").alias("lid2"), "k", "fp", "n")
    both = materialize(close.unionByName(large), "met")
    pairs = both.filter("lid2 is not null").select("lid", "lid2")
    big = both.filter("lid2 is null").drop("lid2")
    if some(big):
        # Texts are fetched only for lines that have a near fingerprint in their bucket.
        near = _dealt(big).groupBy("k", "x", "y").applyInPandas(_near_members(max_bits), "k long, lid long, fp long, n long")
        big = materialize(near.dropDuplicates(["k", "lid"]), "near")
    wanted = pairs.select("lid").unionByName(pairs.select(F.col("lid2").alias("lid"))).unionByName(big.select("lid")).distinct()
    words = materialize(line_texts(docs, lines.select("lid", "doc").join(wanted, "lid"), key, text), "words")
    left = pairs.join(words.withColumnRenamed("words", "w1"), "lid")
    both = left.join(words.select(F.col("lid").alias("lid2"), F.col("words").alias("w2")), "lid2").select("lid", "lid2", "w1", "w2")
    links = both.mapInArrow(_verified(min_similarity), "a long, b long")
    if some(big):
        met_again = _dealt(big.join(words, "lid"), "words").groupBy("k", "x", "y")
        links = links.unionByName(met_again.applyInPandas(_chunk_pair(min_similarity, max_bits), "a long, b long"))
    return links


def dropped_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, max_bits: int = MAX_BITS, min_similarity: float = MIN_SIMILARITY, chunk: int = CHUNK) -> DataFrame:
    """(key, dropped) per key that loses lines: the numbers of the lines to drop, from 0 and ascending.

    Lines are split at newlines. Lines with fewer than min_words words always stay, and are all that null and
    blank texts have. Rows that repeat a key are one document: what the first occurrence keeps stays in each of
    them. A null key sorts first and is a document like others. An empty table gives no rows. Other columns are
    not read.
    """
    occ = materialize(occurrences(docs, key, text, min_words), "lines")
    lines = materialize(occ.groupBy("lid", "chk").agg(F.min(F.struct("doc", "line")).alias("first"), F.count("*").alias("n"), F.first("fp").alias("fp")), "distinct")
    nodes = lines.select("lid", "fp", F.col("first.doc").alias("doc"))
    roots = materialize(components(fuzzy_links(docs, nodes, key, text, max_bits, min_similarity, chunk), "a", "b"), "roots")
    grouped = lines.join(roots.withColumnRenamed("node", "lid"), "lid")
    firsts = grouped.groupBy("root").agg(F.min("first").alias("stay"))
    linked = roots.join(firsts, "root").select(F.col("node").alias("lid"), "stay")
    repeated = lines.filter("n > 1").join(roots.select(F.col("node").alias("lid")), "lid", "left_anti").select("lid", F.col("first").alias("stay"))
    stay = linked.unionByName(repeated)
    place = F.struct("doc", "line")
    gone = occ.select("doc", "line", "lid").join(stay, "lid").filter(~place.eqNullSafe(F.col("stay")))
    return gone.groupBy("doc").agg(F.sort_array(F.collect_set("line")).alias("dropped")).withColumnRenamed("doc", key)


def lines_left(docs: DataFrame, dropped: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the dropped lines cut out of text, with its own columns. A text without dropped lines is unchanged."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    gone = dropped.select(F.col(key).alias("_k"), F.col("dropped").alias("_gone"))
    gone = F.broadcast(gone) if fits(gone, BROADCAST_KEYS) else gone
    d = own.join(gone, F.col(names[key]).eqNullSafe(F.col("_k")), "left")
    t = F.col(names[text])
    rest = F.array_join(F.filter(F.split(t, "\n"), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    return d.withColumn(names[text], F.when(F.col("_gone").isNull(), t).otherwise(rest)).select(*[F.col(n).alias(c) for c, n in names.items()])


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without repeated lines; documents that lose all their words go."""
    gone = materialize(dropped_lines(docs, key, text), "dropped")
    left = lines_left(docs, gone, key, text)
    return left.filter(F.coalesce(F.col(f"`{text}`"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
