"""Mixing sources to target weights by pivotal dependent rounding. Column expressions only.

Each document of a source should appear target / size times on average. The whole part of that is certain; the
fractions are rounded in pairs: word mass moves between two documents, in a random direction with the chances
that keep both expectations, until one of them appears a whole number of times. The other goes on. Blocks of
documents do this side by side, and what is left of each block meets in the next level of a tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.functions.text import let
from dossier.llm.base import materialize, some, word_count

ARITY = 32
WEIGHTS = 3
MAX_REPEATS = 3
SEED = 17
EPS = 1e-9


def source_weights(sources: DataFrame, source: str = "source", weights: int = WEIGHTS) -> DataFrame:
    """Adds weight 1, 2 .. weights, repeating, by code point with null last. sources: one row per source.

    Sources are sorted in ranges; the counts of the earlier ranges, one row per range, give the offset.
    """
    order = F.col(source).asc_nulls_last()
    parts = materialize(sources.repartitionByRange(order).withColumn("_p", F.spark_partition_id()), "sources")
    before = F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    offsets = parts.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(before, F.lit(0)).alias("_off"))
    place = F.row_number().over(W.partitionBy("_p").orderBy(order)) - 1 + F.col("_off")
    return parts.join(offsets, "_p").withColumn("weight", (F.pmod(place, F.lit(weights)) + 1).cast("long")).drop("_p", "_off")


def targets(sources: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds target: the total of source_size shared by weight, stopped at max_repeats times a source's size.

    sources: source_size and weight, one row per source; it is read a few times (pass a written table). Each
    round stops the sources above their limit and shares the rest anew; a round sends one row to the driver.
    """
    limit = F.col("source_size") * max_repeats
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) >= limit
        r = sources.agg(F.sum(F.when(full, limit).otherwise(0)).alias("held"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open"), F.sum(full.cast("int")).alias("n")).first()
        if not r.open or r.n == stopped:
            break
        level, stopped = max(level, (total - r.held) / r.open), r.n
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(float(level)), limit.cast("double")))


def _unit_random(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns alone, so a repeated task draws the same."""
    return F.pmod(F.xxhash64(F.lit(SEED), *cols), F.lit(1 << 52)).cast("double") / float(1 << 52)


def _snapped(p: Column) -> Column:
    return F.when(p < EPS, 0.0).when(p > 1 - EPS, 1.0).otherwise(p)


def _moved(a: Column, b: Column) -> Column:
    """Two units after one transfer: struct (a, b), at least one of them with p 0 or 1."""
    gain = F.least((1 - a.p) * a.words, b.p * b.words)
    loss = F.least(a.p * a.words, (1 - b.p) * b.words)
    up = _unit_random(a.h, a.dup, b.h, b.dup) * (gain + loss) < loss
    mass = F.when(up, gain).otherwise(-loss)
    unit = lambda x, p: F.struct(x.words.alias("words"), x.h.alias("h"), x.dup.alias("dup"), x.doc.alias("doc"), _snapped(p).alias("p"))
    return let(mass, lambda m: F.struct(unit(a, a.p + m / a.words).alias("a"), unit(b, b.p - m / b.words).alias("b")))


def _folded(units: Column, unit_type: str) -> Column:
    """Pivotal rounding along an array: struct (cur, out), cur the unit still open or null, out the settled ones."""
    start = F.struct(F.lit(None).cast(unit_type).alias("cur"), F.array().cast(f"array<{unit_type}>").alias("out"))

    def merge(acc: Column, x: Column) -> Column:
        settled = lambda u: (u.p == 0) | (u.p == 1)
        step = lambda m: F.struct(
            F.when(~settled(m.a), m.a).when(~settled(m.b), m.b).alias("cur"),
            F.concat(acc.out, F.filter(F.array(m.a, m.b), settled)).alias("out"),
        )
        return F.when(acc.cur.isNull(), F.struct(x.alias("cur"), acc.out.alias("out"))).otherwise(let(_moved(acc.cur, x), step))

    return F.aggregate(units, start, merge)


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(key, row_hash, source, size, source_size, target, copies) per row of docs; copies is how often the mix has it.

    size is the number of words (null text: 0). A document without words gets no copies. Rows equal in all
    columns are rounded one by one, and which of them gets a copy does not matter. Null keys and a null source
    are values like others; other columns only serve to tell rows apart. An empty table gives no rows. Copies
    depend on the rows alone, not on how they are dealt out.
    """
    s, k = F.col(f"`{source}`"), F.col(f"`{key}`")
    rows = docs.select(s.cast("string").alias("source"), k.alias("doc"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("h"), word_count(F.col(f"`{text}`").cast("string")).alias("words"))
    rows = materialize(rows.groupBy("source", "doc", "h", "words").agg(F.count("*").alias("n")), "rows")
    sources = rows.groupBy("source").agg(F.sum(F.col("words") * F.col("n")).alias("source_size"), F.sum(F.when(F.col("words") > 0, F.col("n")).otherwise(0)).alias("units"))
    sources = materialize(targets(materialize(source_weights(sources), "weights"), max_repeats), "targets")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    p = _snapped(times - F.floor(times))
    src = F.struct("source", "source_size", "target", (F.floor(times) + (p == 1).cast("long")).alias("base"))
    plan = sources.select(F.col("source").alias("_s"), src.alias("src"), F.when(p == 1, 0.0).otherwise(p).alias("p"), F.ceil(F.col("units") / ARITY).cast("long").alias("blocks"))
    known = rows.join(plan, F.col("source").eqNullSafe(F.col("_s"))).select("src", "p", "blocks", "doc", "h", "words", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("dup"))
    part = (F.col("p") > 0) & (F.col("words") > 0)
    whole = known.filter(~part).select("src", "doc", "h", "words", F.when(F.col("words") > 0, F.col("src.base")).otherwise(0).alias("copies"))
    open_ = known.filter(part).withColumn("blk", F.pmod(F.xxhash64(F.lit(SEED), "h", "dup"), F.col("blocks")))
    level = open_.select("src", "blocks", "blk", F.struct("words", "h", "dup", "doc", "p").alias("u"))
    unit_type = level.schema["u"].dataType.simpleString()
    most = sources.agg(F.max(F.ceil(F.col("units") / ARITY))).first()[0] or 0
    settled = [whole]
    while most:
        # Large documents first, so that what stays open shrinks as the fold goes on.
        units = F.reverse(F.array_sort(F.collect_list("u")))
        done = materialize(level.groupBy("src", "blocks", "blk").agg(units.alias("us")).select("src", "blocks", "blk", _folded(F.col("us"), unit_type).alias("r")), "level")
        settled.append(done.select("src", F.inline("r.out")).select("src", "doc", "h", "words", (F.col("src.base") + F.col("p").cast("long")).alias("copies")))
        rest = done.filter(F.col("r.cur").isNotNull()).select("src", "blocks", "blk", F.col("r.cur").alias("u"))
        if most == 1:
            drawn = (_unit_random(F.col("u.h"), F.col("u.dup")) < F.col("u.p")).cast("long")
            settled.append(rest.select("src", F.col("u.doc").alias("doc"), F.col("u.h").alias("h"), F.col("u.words").alias("words"), (F.col("src.base") + drawn).alias("copies")))
            break
        level = rest.select("src", F.ceil(F.col("blocks") / ARITY).cast("long").alias("blocks"), F.floor(F.col("blk") / ARITY).cast("long").alias("blk"), "u")
        most = -(-most // ARITY)
    out = settled[0]
    for d in settled[1:]:
        out = out.unionByName(d)
    return out.select(F.col("doc").alias(key), F.col("h").alias("row_hash"), "src.source", F.col("words").alias("size"), "src.source_size", "src.target", F.col("copies").cast("long").alias("copies"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with each row repeated as often as the mix takes it (0: gone), with its own columns.

    Rows equal in all columns are gathered first and repeated as often as all of them together.
    """
    copies = mixed(docs, key, text, source).groupBy(F.col(key).alias("_k"), F.col("row_hash").alias("_h"))
    copies = materialize(copies.agg(F.sum("copies").alias("_copies"), F.count("*").alias("_n")), "copies")
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    same = (F.xxhash64(*names.values()) == F.col("_h")) & F.col(names[key]).eqNullSafe(F.col("_k"))
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))
    back = [F.col(n).alias(c) for c, n in names.items()]
    out = own.join(copies.filter("_n = 1 and _copies > 0"), same).withColumn("_i", again).select(*back)
    repeated = copies.filter("_n > 1 and _copies > 0")
    if some(repeated):
        out = out.unionByName(own.join(repeated, same).dropDuplicates().withColumn("_i", again).select(*back))
    return out
