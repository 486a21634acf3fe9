"""Merkle manifest of a table: one tree per group of rows, and one tree over the groups' roots.

A node is the SHA-256 of its (at most two) children's hex digests. Each node keeps the hash state before either
child slot: the start state, and the state after its left child. Folding a changed leaf resumes the state of the slot
it came from and feeds the replacement and what stands to the right of it; left siblings are not read again.

Trees are built in blocks of consecutive nodes, several levels at a time: blocks of leaves, blocks of their roots, and
so on, so the number of rounds grows with the logarithm to base BLOCK. The way from a leaf block to the root is one
short row per block. Leaves meet it once, and fold within their block and then along that row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.llm.base import materialize
from dossier.llm.sha256_states import START, closing_block, hex_block, raw, resumed, starts, words

LEVELS = 10
BLOCK = 1 << LEVELS
#: Rows that one call of the numeric code should see; it works on all of a bin's blocks at once.
BIN_ROWS = 8192
#: A step of a way up: slot (0 alone, 1 left of a sibling, 2 right of one), the sibling's digest, the state before the slot.
STEP = 65
ALONE, LEFT, RIGHT = 0, 1, 2


def field(c: Column) -> Column:
    """`-` for null, else the UTF-8 bytes of the value, a colon and the value."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*columns: Column) -> Column:
    """Binary SHA-256 of the fields one after the other."""
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]), 256))


def _levels(n: Column) -> Column:
    """Levels over n nodes: the bits of n - 1."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(F.lit(0)).cast("int")


def ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Adds idx (0, 1 .. within group) and n (rows of the group); nulls first. Groups are cut into ranges, so none meets in one task."""
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    parts = materialize(rows.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = parts.groupBy(F.col(group).alias("_g"), F.col("_p").alias("_q")).agg(F.count("*").alias("_c"))
    of = W.partitionBy("_g")
    before = F.sum("_c").over(of.orderBy("_q").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("_g", "_q", F.coalesce(before, F.lit(0)).alias("_b"), F.sum("_c").over(of).alias("n"))
    place = F.row_number().over(W.partitionBy(group, "_p").orderBy(*keys[1:])) - 1
    both = parts.withColumn("_i", place).join(counts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q")))
    return both.withColumn("idx", F.col("_i") + F.col("_b")).drop("_g", "_q", "_p", "_b", "_i")


def _binned(rows: DataFrame, idx: Column, n: int) -> DataFrame:
    return rows.withColumn("bin", F.pmod(F.xxhash64("grp", idx), F.lit(max(1, -(-n // BIN_ROWS)))))


class Forest:
    """Trees over the blocks of one bin, built level by level; each level keeps the states before the right slots."""

    def __init__(self, grp: np.ndarray, idx: np.ndarray, digests: np.ndarray, left: np.ndarray):
        """grp, idx: nodes sorted by both, the indices of a block without gaps. left: levels that the node's group still has."""
        self.steps = []
        node = np.arange(len(idx))
        g, p, d, left = grp, idx, digests, left
        for level in range(LEVELS):
            on = left > level
            if not on.any():
                break
            first = ~on | (p & 1 == 0)
            heads = np.flatnonzero(first)
            parent = np.cumsum(first) - 1
            up = d[heads].copy()
            active = on[heads]
            pair = active & np.append(~first[1:], False)[heads]
            state = np.zeros((len(heads), 8), dtype=np.uint32)
            state[active] = resumed(starts(int(active.sum())), hex_block(d[heads[active]]))
            alone = active & ~pair
            if alone.any():
                up[alone] = resumed(state[alone], closing_block(1))
            if pair.any():
                up[pair] = resumed(resumed(state[pair], hex_block(d[heads[pair] + 1])), closing_block(2))
            # What a node needs to go up from here, for every node of this level.
            slot = np.where(first, np.where(pair[parent], LEFT, ALONE), RIGHT)
            beside = d[np.clip(np.arange(len(d)) + np.where(slot == LEFT, 1, np.where(slot == RIGHT, -1, 0)), 0, len(d) - 1)]
            before = np.where((slot == RIGHT)[:, None], state[parent], START[None, :])
            self.steps.append((on[node], slot[node].astype(np.uint8), beside[node], before[node]))
            node, g, p, d, left = parent[node], g[heads], p[heads] >> 1, up, left[heads]
        self.roots = d[node]

    def ways(self) -> list[bytes]:
        """The way from every node to the root of its block, as STEP bytes per level."""
        parts = []
        for on, slot, beside, before in self.steps:
            beside = np.where((slot != ALONE)[:, None], raw(beside), 0).astype(np.uint8)
            parts.append((on, np.concatenate([slot[:, None], beside, raw(before)], axis=1)))
        return [b"".join(rec[i].tobytes() for on, rec in parts if on[i]) for i in range(len(self.roots))]


def _sorted(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The table by group and index, and the groups' codes."""
    codes = t["grp"].combine_chunks().dictionary_encode(null_encoding="encode")
    codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((t["idx"].to_numpy(), codes))
    return t.take(pa.array(order)), codes[order]


def _forest(t: pa.Table, codes: np.ndarray) -> Forest:
    return Forest(codes, t["idx"].to_numpy(), words(t["digest"].to_pylist()), t["left"].to_numpy())


def _block_roots(t: pa.Table) -> pa.Table:
    t, codes = _sorted(t.drop_columns(["bin"]))
    roots = raw(_forest(t, codes).roots)
    heads = np.flatnonzero(t["idx"].to_numpy() % BLOCK == 0)
    t = t.take(pa.array(heads))
    out = {"grp": t["grp"], "idx": pa.array(t["idx"].to_numpy() // BLOCK), "digest": pa.array([roots[i].tobytes() for i in heads], pa.binary())}
    return pa.table(out | {"left": pa.array(np.maximum(t["left"].to_numpy() - LEVELS, 0), pa.int32())})


def _block_ways(t: pa.Table) -> pa.Table:
    t, codes = _sorted(t.drop_columns(["bin"]))
    forest = _forest(t, codes)
    roots = raw(forest.roots)
    return pa.table({"grp": t["grp"], "idx": t["idx"], "left": t["left"], "way": pa.array(forest.ways(), pa.binary()), "root": pa.array([r.tobytes() for r in roots], pa.binary())})


def climbed(items: DataFrame, group_type: str) -> tuple[DataFrame, DataFrame]:
    """Ways (grp, idx, way) from every item to its group's root, and the roots (grp, root). items: grp, idx, digest, left."""
    rounds = []
    while True:
        size = items.agg(F.count("*").alias("n"), F.max("left").alias("left")).first()
        done = _binned(items, F.shiftright("idx", LEVELS), size.n).groupBy("bin").applyInArrow(_block_ways, f"grp {group_type}, idx long, left int, way binary, root binary")
        done = materialize(done, "ways")
        rounds.append(done)
        heads = done.filter(F.col("idx") % BLOCK == 0).select("grp", F.shiftright("idx", LEVELS).alias("idx"), F.col("root").alias("digest"), F.greatest(F.col("left") - LEVELS, F.lit(0)).alias("left"))
        if (size.left or 0) <= LEVELS:
            break
        items = heads
    ways = rounds[-1].select("grp", "idx", "way")
    for done in reversed(rounds[:-1]):
        up = ways.select(F.col("grp").alias("_g"), F.col("idx").alias("_i"), F.col("way").alias("_w"))
        joined = done.join(up, F.col("grp").eqNullSafe(F.col("_g")) & (F.shiftright("idx", LEVELS) == F.col("_i")))
        ways = materialize(joined.select("grp", "idx", F.concat("way", "_w").alias("way")), "ways")
    return ways, heads.select("grp", F.col("digest").alias("root"))


def _moved(digests: np.ndarray, slot: np.ndarray, beside: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Parents of replaced nodes: each resumes the state before its slot with the replacement and right siblings only."""
    out = np.empty_like(digests)
    state = resumed(before, hex_block(digests))
    left = slot == LEFT
    if left.any():
        out[left] = resumed(resumed(state[left], hex_block(beside[left])), closing_block(2))
    right, alone = slot == RIGHT, slot == ALONE
    if right.any():
        out[right] = resumed(state[right], closing_block(2))
    if alone.any():
        out[alone] = resumed(state[alone], closing_block(1))
    return out


def _hex(states: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes().hex() for r in raw(states)], pa.string())


def folded(leaves: pa.Table, upper: pa.Table) -> pa.Table:
    """Folds the leaves of one bin. leaves: id, grp, idx, digest, changed (null: as it is), left. upper: grp, blk, way, subroot."""
    if not leaves.num_rows:
        return pa.table({"id": leaves["id"], **{c: pa.array([], pa.string()) for c in ("leaf", "subroot", "proof_sha256", "folded_root")}})
    t, codes = _sorted(leaves.drop_columns(["bin"]))
    forest = _forest(t, codes)
    old = words(t["digest"].to_pylist())
    new = words([c or d for c, d in zip(t["changed"].to_pylist(), t["digest"].to_pylist())])
    proof, n_proof = starts(len(old)), np.zeros(len(old), dtype=np.uint64)

    def step(on, slot, beside, before):
        at = np.flatnonzero(on)
        new[at] = _moved(new[at], slot[at], beside[at], before[at])
        at = at[slot[at] != ALONE]
        proof[at] = resumed(proof[at], hex_block(beside[at]))
        n_proof[at] += np.uint64(1)

    for s in forest.steps:
        step(*s)
    # The rest of the way is one row per block.
    rows = {(g, b): i for i, (g, b) in enumerate(zip(upper["grp"].to_pylist(), upper["blk"].to_pylist()))}
    mine = np.array([rows[(g, b)] for g, b in zip(t["grp"].to_pylist(), (t["idx"].to_numpy() // BLOCK).tolist())])
    ways = [np.frombuffer(w, dtype=np.uint8).reshape(-1, STEP) for w in upper["way"].to_pylist()]
    for k in range(max(map(len, ways))):
        has = np.array([len(w) > k for w in ways])
        rec = np.stack([w[k] if len(w) > k else np.zeros(STEP, dtype=np.uint8) for w in ways])
        as_words = lambda a: np.ascontiguousarray(a).view(">u4").astype(np.uint32)
        step(has[mine], rec[mine, 0], as_words(rec[:, 1:33])[mine], as_words(rec[:, 33:])[mine])
    subroots = [upper["subroot"][i].as_py().hex() for i in range(upper.num_rows)]
    proof = resumed(proof, closing_block(n_proof))
    return pa.table({"id": t["id"], "leaf": _hex(old), "subroot": pa.array([subroots[i] for i in mine], pa.string()), "proof_sha256": _hex(proof), "folded_root": _hex(new)})


def manifest(leaves: DataFrame) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) per row of leaves; digests as lower-case hex.

    leaves: id, grp, digest (binary), and changed (binary, null for an unchanged leaf). Leaves ascend by id within a
    group, nulls first, rows of equal id by digest; groups ascend, null first. proof_sha256 hashes the siblings of the
    way up; folded_root is recomputed from the changed leaf and these siblings. An empty table gives no rows. Rows hold
    no texts, so their length does not matter; other columns are not read.
    """
    group_type = leaves.schema["grp"].dataType.simpleString()
    id_type = leaves.schema["id"].dataType.simpleString()
    placed = ranked(leaves.select("id", "grp", "digest", "changed"), "grp", "id", "digest")
    placed = materialize(placed.withColumn("left", _levels(F.col("n"))).drop("n"), "leaves")
    size = placed.agg(F.count("*").alias("n"), F.max("left").alias("left")).first()
    binned = _binned(placed, F.shiftright("idx", LEVELS), size.n)
    roots = binned.select("bin", "grp", "idx", "digest", "left").groupBy("bin").applyInArrow(_block_roots, f"grp {group_type}, idx long, digest binary, left int")
    roots = materialize(roots, "blocks")
    if (size.left or 0) > LEVELS:
        ways, subroots = climbed(roots, group_type)
    else:
        ways, subroots = roots.select("grp", "idx", F.lit(b"").alias("way")), roots.select("grp", F.col("digest").alias("root"))
    subroots = materialize(subroots, "subroots")
    tops = ranked(subroots.withColumn("one", F.lit(0)), "one", "grp").select(F.col("one").alias("grp"), F.col("grp").alias("name"), "idx", F.col("root").alias("digest"), _levels(F.col("n")).alias("left"))
    tops = materialize(tops, "tops")
    top_ways, top = climbed(tops.select("grp", "idx", "digest", "left"), "int")
    row = top.first()
    root = row.root.hex() if row else None
    above = tops.join(top_ways.select("idx", F.col("way").alias("top_way")), "idx").select(F.col("name").alias("_n"), "top_way", F.col("digest").alias("subroot"))
    upper = ways.join(above, F.col("grp").eqNullSafe(F.col("_n")))
    upper = _binned(upper.select("grp", F.col("idx").alias("blk"), F.concat("way", "top_way").alias("way"), "subroot"), F.col("blk"), size.n)
    found = binned.groupBy("bin").cogroup(upper.groupBy("bin")).applyInArrow(folded, f"id {id_type}, leaf string, subroot string, proof_sha256 string, folded_root string")
    return found.select("id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root).cast("string")).alias("verified"))


def document_leaves(docs: DataFrame, key: str = "doc_id", group: str = "lang", source: str = "source", size: str = "n_chars", text: str = "text") -> DataFrame:
    """Leaves of documents: key, source, group, size and text. Where 7 divides the CRC-32 of the key, `changed` has a size greater by one; a null size stays."""
    c = lambda name: F.col(f"`{name}`")
    fields = [c(key), c(source), c(group), c(size), c(text)]
    larger = [*fields[:3], c(size).cast("decimal(20,0)") + 1, c(text)]
    marked = (F.crc32(c(key).cast("string").cast("binary")) % 7 == 0) & c(size).isNotNull()
    return docs.select(c(key).alias("id"), c(group).cast("string").alias("grp"), leaf_digest(*fields).alias("digest"), F.when(marked, leaf_digest(*larger)).alias("changed"))
