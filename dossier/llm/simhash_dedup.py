"""SimHash near-duplicates, found through a generalised pigeonhole.

The 64 bits are put into m groups of correlated bits. If two fingerprints
differ in at most T bits, then for any thresholds t_1 .. t_m with
sum(t_i) = T - m + 1 some group differs in at most t_i bits. A dynamic program
picks m and the t_i with the fewest estimated probes and candidates: a
threshold of -1 leaves a group out, 0 is an exact match, 1 and more probe the
neighbouring values.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.base import materialize, some, without
from dossier.llm.components import components

BITS = 64
#: Members of one bucket that are compared in one task; larger buckets are cut into pairs of chunks.
CHUNK = 2_000
#: Cost of one compared candidate, in probes sent through the shuffle.
CANDIDATE_COST = 0.05
MAX_RADIUS = 2


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of word shingles, as a signed 64-bit number; no words: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), (ends[-n:] - 1).tolist())], dtype="<u8")
    lanes = np.uint64(0x0101010101010101)
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(8):  # byte lanes count bit k of each byte, at most 255 hashes at a time
        spread = (hashes >> np.uint64(k)) & lanes
        sums = np.add.reduceat(spread, np.arange(0, n, 255))
        ones[k::8] = sums.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    bits = np.packbits((2 * ones > n).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int = 3) -> DataFrame:
    """(key, fp) per row of docs; null and blank texts have fingerprint 0."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=[key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, fp long")


@dataclass(frozen=True)
class Plan:
    """Bit groups and their thresholds."""

    groups: tuple[tuple[int, ...], ...]
    radii: tuple[int, ...]


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and how often bits i and j are both set: one 64 x 64 matrix, summed per task first."""

    def run(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            for part in np.array_split(v, max(1, len(v) // 4096)):
                m = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += m.T @ m
            n += len(v)
        i, j = np.indices((BITS, BITS))
        rows = [np.append(i.ravel(), -1), np.append(j.ravel(), -1), np.append(total.ravel(), n)]
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.float64())], names=["i", "j", "n"])

    # 4,097 rows, whatever the input.
    got = fps.select("fp").mapInArrow(run, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, rows = np.zeros((BITS, BITS)), 0
    for r in got:
        if r.i < 0:
            rows = int(r.n)
        else:
            both[r.i, r.j] = r.n
    return rows, both


def correlated_groups(rows: int, both: np.ndarray, m: int) -> tuple[tuple[int, ...], ...]:
    """m groups of about equal width; each starts with the first free bit and takes the bits most correlated with it."""
    p = np.diag(both) / max(rows, 1)
    var = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    cor = np.abs(both / max(rows, 1) - np.outer(p, p)) / np.outer(var, var)
    free, groups = list(range(BITS)), []
    for k in range(m):
        width = -(-len(free) // (m - k))
        group = [free.pop(0)]
        while len(group) < width:
            best = max(free, key=lambda b: (cor[b, group].mean(), -b))
            free.remove(best)
            group.append(best)
        groups.append(tuple(sorted(group)))
    return tuple(groups)


def _within(disagree: np.ndarray, radius: int) -> np.ndarray:
    """P(at most e bits differ), e = 0 .. radius, for independent bits."""
    at = np.zeros(radius + 1)
    at[0] = 1.0
    for q in disagree:
        at[1:] = at[1:] * (1 - q) + at[:-1] * q
        at[0] *= 1 - q
    return np.cumsum(at)


def gathered(fp, group):
    """The bits of one group side by side, as a number."""
    out = F.lit(0).cast("long")
    for k, b in enumerate(group):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, b).bitwiseAND(F.lit(1).cast("long")), k))
    return out


def best_radii(cost: list[list[float]], total: int) -> tuple[float, tuple[int, ...]]:
    """Dynamic program: radii >= -1 with the given sum and the least cost; cost[i][e + 1] is for radius e."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for row in cost:
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for spent, (c, radii) in best.items():
            for e, extra in enumerate(row, start=-1):
                at = (c + extra, (*radii, e))
                if spent + e not in step or at < step[spent + e]:
                    step[spent + e] = at
        best = step
    return best.get(total, (float("inf"), ()))


def allocate(fps: DataFrame, max_bits: int, sizes=(2, 3, 4)) -> Plan:
    """Groups and thresholds with the least estimated cost over this corpus."""
    rows, both = bit_counts(fps)
    if rows < 2:
        return Plan(tuple(tuple(range(k * 16, k * 16 + 16)) for k in range(4)), (0, 0, 0, 0)) if max_bits == 3 else Plan((tuple(range(BITS)),), (max_bits,))
    layouts = {m: correlated_groups(rows, both, m) for m in sizes}
    marked = [F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), gathered(F.col("fp"), g).alias("v")) for m, gs in layouts.items() for i, g in enumerate(gs)]
    counts = fps.select(F.inline(F.array(*marked))).groupBy("m", "i", "v").agg(F.count("*").alias("n"))
    same = {(r.m, r.i): r.pairs for r in counts.groupBy("m", "i").agg(F.sum(F.col("n") * (F.col("n") - 1.0) / 2).alias("pairs")).collect()}
    p = np.diag(both) / rows
    disagree = 2 * p * (1 - p)
    best = (float("inf"), None)
    for m, groups in layouts.items():
        cost = []
        for i, g in enumerate(groups):
            near = _within(disagree[list(g)], MAX_RADIUS)
            # At least what independent bits would give; a measured excess of equal values counts for the neighbours too.
            excess = max(1.0, same[m, i] / max(near[0] * rows * (rows - 1) / 2, 1e-9))
            ball = np.cumsum([1.0, len(g), len(g) * (len(g) - 1) / 2])
            cost.append([0.0] + [rows * ball[e] + CANDIDATE_COST * excess * near[e] * rows * (rows - 1) / 2 for e in range(MAX_RADIUS + 1)])
        c, radii = best_radii(cost, max_bits - m + 1)
        if radii and c < best[0]:
            best = (c, Plan(groups, radii))
    if best[1] is None:
        raise ValueError(f"no layout of {sizes} groups serves {max_bits} bits")
    return best[1]


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in c) for e in range(radius + 1) for c in itertools.combinations(range(width), e)]


def _neighbours(i: int, v, masks: list[int]):
    ball = F.array(*[F.lit(x).cast("long") for x in masks])
    return F.transform(ball, lambda x: F.struct(F.lit(i).alias("i"), v.bitwiseXOR(x).alias("v")))


def spanning(values: np.ndarray, others: np.ndarray, max_bits: int):
    """Links inside one pair of chunks that suffice to connect what is connected there (a spanning forest)."""
    nodes = np.unique(np.concatenate([values, others]))
    left, right = np.searchsorted(nodes, values), np.searchsorted(nodes, others)
    parent = np.arange(len(nodes))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, v in zip(left, values):
        for j in right[np.bitwise_count((others ^ v).view(np.uint64)) <= max_bits]:
            a, b = root(k), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                yield nodes[k], nodes[j]


def chunked_links(rows: DataFrame, max_bits: int, chunk: int = CHUNK) -> DataFrame:
    """Links in large buckets. rows: (i, v, side, fp, n), side 0 the members and 1 those that look for them.

    A bucket of n rows is cut into n / chunk parts by hash; one group of rows per pair of parts holds two
    chunks at most, whatever the bucket, and gives a spanning forest, not all its pairs.
    """
    parts = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    sent = rows.select("i", "v", "side", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    sent = sent.select("i", "v", F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")).alias("x"), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")).alias("y"), "side", "fp")

    def run(pdf):
        import pandas as pd

        a, b = (np.unique(pdf.fp[pdf.side == s].to_numpy(dtype=np.int64)) for s in (0, 1))
        return pd.DataFrame(list(spanning(a, b, max_bits)), columns=["a", "b"], dtype="int64")

    return sent.groupBy("i", "v", "x", "y").applyInPandas(run, "a long, b long")


def hamming_links(fps: DataFrame, max_bits: int = 3, plan: Plan | None = None, chunk: int = CHUNK) -> DataFrame:
    """(a, b) links between distinct fingerprints that differ in at most max_bits bits; what is connected stays so.

    fps: one column fp, distinct, read more than once (pass a written table).
    """
    plan = plan or allocate(fps, max_bits)
    fp = F.col("fp")
    own, probes = [], []
    for i, (g, e) in enumerate(zip(plan.groups, plan.radii)):
        if e >= 0:
            v = gathered(fp, g)
            own.append(F.struct(F.lit(i).alias("i"), v.alias("v")))
            probes.append(_neighbours(i, v, _masks(len(g), e)))
    index = fps.select("fp", F.inline(F.array(*own)))
    asked = fps.select(fp.alias("fp2"), F.inline(F.flatten(F.array(*probes))))
    hot = materialize(index.groupBy("i", "v").agg(F.count("*").alias("n")).filter(F.col("n") > chunk), "hot")
    near = (F.col("fp") < F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= max_bits)
    if not some(hot):
        return index.join(asked, ["i", "v"]).filter(near).select(F.col("fp").alias("a"), F.col("fp2").alias("b"))
    cool = index.join(hot, ["i", "v"], "left_anti").join(asked, ["i", "v"]).filter(near).select(F.col("fp").alias("a"), F.col("fp2").alias("b"))
    rows = index.select("i", "v", F.lit(0).alias("side"), "fp").unionByName(asked.select("i", "v", F.lit(1).alias("side"), F.col("fp2").alias("fp")))
    return cool.unionByName(chunked_links(rows.join(hot, ["i", "v"]), max_bits, chunk))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = 3, shingle: int = 3) -> DataFrame:
    """(key, fp, component_id) per row of docs; component_id is the smallest key of the row's component.

    Equal fingerprints are one node, so copies never make pairs. A null key has a fingerprint and a
    component like any row but never names one (a component of null keys only has a null id). Null and
    blank texts share fingerprint 0. Repeated keys and rows are kept. An empty table gives no rows. Other
    columns are not read.
    """
    fps = materialize(fingerprints(docs, key, text, shingle), "fps")
    nodes = materialize(fps.groupBy("fp").agg(F.min(key).alias("least")), "nodes")
    links = hamming_links(nodes.select("fp"), max_bits)
    roots = materialize(components(links, "a", "b"), "roots")
    least = nodes.join(roots.withColumnRenamed("node", "fp"), "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.join(roots.join(least, "root").select(F.col("node").alias("fp"), "component_id"), "fp", "left")
    named = named.select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return fps.join(named, "fp").select(key, "fp", "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = 3, shingle: int = 3) -> DataFrame:
    """docs without the rows whose component has a smaller key. Rows with a null key stay."""
    found = near_duplicates(docs, key, text, max_bits, shingle)
    gone = materialize(found.filter(F.col(key) != F.col("component_id")).select(key).distinct(), "gone")
    return without(docs, gone, key)
