"""Phrase collocations: frequent phrases of two to four words per language, scored by their weakest cut.

Words are counted first; each (language, word) gets a 64-bit key, and the keys of frequent words are checked to be
unique (with another seed if not). Then every place in the texts is a suffix of up to four frequent words. Suffixes are
routed by their leading word; where that word is very frequent, by two, three or four leading words, so no route
gets more than its share. At the end of a route a multikey three-way quicksort counts all prefixes at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.llm.base import materialize
from dossier.llm.word_suffixes import DEPTH, Words, frequent, packed, slices

MIN_COUNT = 30
TOP = 2000
#: A longer phrase takes the place of one inside it if it occurs this many per cent as often.
COVER_PERCENT = 80
SCORE_SCALE = 2_000_000
#: Flags for frequent words: 8 MB whatever the input. Words that share a flag only cost a longer route.
FLAGS = 1 << 26
#: Bytes of text that a task takes up at a time, for counts and for suffixes, which take about 40 times their text.
COUNT_BYTES = 8 << 20
SUFFIX_BYTES = 4 << 20
ROUTE_SUFFIXES = 1_000_000
#: A prefix is routed by one more word if it has over ROUTE_SUFFIXES places and over this share of all.
HOT_SHARE = 4096
UNKNOWN = "und"


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    of = lambda c, default: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(default))
    return docs.select(of(lang, UNKNOWN).alias("lang"), of(text, "").alias("text"))


def _read(batches, seed: int, size: int):
    """Words of each slice of (lang, text) batches, keyed."""
    for batch in batches:
        for part in slices(batch, 1, size):
            langs = part.column(0).dictionary_encode()
            words = Words(part.column(1).cast(pa.string()))
            words.langs = langs.dictionary.to_pylist()
            words.keyed(words.langs, langs.indices.to_numpy(), seed)
            yield words


def _signed(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.int64)


def word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """(lang, word, key, n) of texts (lang, text)."""

    size = COUNT_BYTES

    def counted(batches):
        for w in _read(batches, seed, size):
            if len(w.key):
                langs = pa.array(w.langs, pa.string()).take(pa.array(w.of_lang))
                yield pa.RecordBatch.from_arrays([langs, w.names.take(pa.array(w.of_word)), pa.array(_signed(w.key)), pa.array(w.count.astype(np.int64))], names=["lang", "word", "key", "n"])

    rows = texts.mapInArrow(counted, "lang string, word string, key long, n long")
    return rows.groupBy("key", "lang", "word").agg(F.sum("n").alias("n"))


def _flags(keys: DataFrame) -> np.ndarray:
    """A bit per FLAGS remainder of a key, as 64-bit words."""
    slot = keys.select(F.col("key").bitwiseAND(F.lit(FLAGS - 1)).alias("s"))
    bits = slot.groupBy(F.shiftright("s", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("b")).toArrow()
    out = np.zeros(FLAGS // 64, dtype=np.uint64)
    out[bits["w"].to_numpy()] = bits["b"].to_numpy().view(np.uint64)
    return out


def _flagged(flags: np.ndarray, keys: np.ndarray) -> np.ndarray:
    s = keys & np.uint64(64 * len(flags) - 1)
    return (flags[(s >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63))) & np.uint64(1) == 1


def _row_keys(a: np.ndarray) -> np.ndarray:
    """Rows of keys as one comparable value each."""
    return np.ascontiguousarray(a).view([("", a.dtype)] * a.shape[1]).reshape(-1)


def _within(a: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Rows of a that stand in hot."""
    return np.isin(_row_keys(a), _row_keys(hot)) if len(hot) and len(a) else np.zeros(len(a), dtype=bool)


def hot_prefixes(texts: DataFrame, seed: int, hot: list[np.ndarray], over: int) -> np.ndarray:
    """Prefixes one word longer than hot[-1] with over `over` places. At most all places / over of them exist.

    Both the prefix and the rest of such a prefix are themselves hot, so only few are counted.
    """
    d, size = len(hot) + 1, SUFFIX_BYTES

    def counted(batches):
        for w in _read(batches, seed, size):
            s, n = packed(w.suffixes(_within(w.key[:, None], hot[0])))
            s, n = s[s[:, d - 1] > 0], n[s[:, d - 1] > 0]
            full = np.append(np.uint64(0), w.key)[s[:, :d]]
            on = _within(full[:, :-1], hot[-1]) & _within(full[:, 1:], hot[-1])
            if on.any():
                yield pa.RecordBatch.from_arrays([pa.array(_signed(full[on]).tolist(), pa.list_(pa.int64())), pa.array(n[on].astype(np.int64))], names=["g", "n"])

    rows = texts.mapInArrow(counted, "g array<long>, n long").groupBy("g").agg(F.sum("n").alias("n")).filter(F.col("n") > over)
    found = rows.collect()
    return np.array([[*r.g, r.n] for r in found], dtype=np.int64).reshape(-1, d + 1)


def _lead(suffix: np.ndarray, hot: list[np.ndarray]) -> np.ndarray:
    """One number per suffix from its leading word, and from each next one while what leads is hot."""
    mix = lambda x, key: ((x ^ key) * np.uint64(0x9E3779B97F4A7C15)) ^ (x >> np.uint64(29))
    out = mix(np.uint64(1), suffix[:, 0])
    is_hot = np.ones(len(suffix), dtype=bool)
    for d, h in enumerate(hot, 1):
        is_hot &= _within(suffix[:, :d], h)
        out[is_hot] = mix(out[is_hot], suffix[is_hot, d])
    return out ^ (out >> np.uint64(32))


def routed(texts: DataFrame, seed: int, flags, hot: list[np.ndarray], routes: int) -> DataFrame:
    """(route, body): packed suffixes with their counts, those of one slice and route in one row."""

    size = SUFFIX_BYTES

    def cut(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for w in _read(batches, seed, size):
            s, n = packed(w.suffixes(_flagged(flags.value, w.key)))
            more = s[:, 1] > 0
            full, n = np.append(np.uint64(0), w.key)[s[more]], n[more]
            if not len(full):
                continue
            route = (_lead(full, hot) % np.uint64(routes)).astype(np.int64)
            order = np.argsort(route, kind="stable")
            route, full, n = route[order], full[order], n[order]
            heads = np.flatnonzero(np.append(True, route[1:] != route[:-1]))
            ends = np.append(heads[1:], len(route))
            bodies = [pack.compress(np.ascontiguousarray(full[a:b].T).tobytes() + n[a:b].astype(np.uint32).tobytes()) for a, b in zip(heads, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(route[heads]), pa.array(bodies, pa.binary())], names=["route", "body"])

    return texts.mapInArrow(cut, "route long, body binary")


def counted_routes(rows: DataFrame, hot: list[np.ndarray], least: int) -> DataFrame:
    """(g, n): keys and count of each phrase of two and more words with `least` places; phrases in hot are left out."""
    width = 8 * DEPTH + 4

    def count(t: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        bodies = [b.as_py() for b in t["body"]]
        sizes = [zstandard.frame_content_size(b) // width for b in bodies]
        suffix, weight, at = np.empty((sum(sizes), DEPTH), np.uint64), np.empty(sum(sizes), np.int64), 0
        for body, m in zip(bodies, sizes):
            raw = unpack.decompress(body)
            suffix[at : at + m] = np.frombuffer(raw, dtype=np.uint64, count=DEPTH * m).reshape(DEPTH, m).T
            weight[at : at + m] = np.frombuffer(raw, dtype=np.uint32, offset=8 * DEPTH * m)
            at += m
        g, n = frequent(suffix, weight, least)
        size = (g != 0).sum(axis=1)
        keep = size > 1
        for d, h in enumerate(hot[1:], 2):
            keep &= ~((size == d) & _within(g[:, :d], h))
        lists = [r[:k] for r, k in zip(_signed(g[keep]).tolist(), size[keep].tolist())]
        return pa.table({"g": pa.array(lists, pa.list_(pa.int64())), "n": pa.array(n[keep], pa.int64())})

    return rows.groupBy("route").applyInArrow(count, "g array<long>, n long")


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = MIN_COUNT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts of all phrases up to DEPTH words that occur `least` times: (g, n) by word keys, (key, lang, word, n) of their words, (lang, total).

    A null text is empty, a null language UNKNOWN. A text of any length is cut at its row; other columns are not read.
    """
    spark = docs.sparkSession
    texts = _texts(docs, text, lang)
    seed = 1
    while True:
        words = materialize(word_counts(texts, seed), "words")
        clash = words.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("n")).filter((F.col("c") > 1) & (F.col("n") >= least))
        if clash.isEmpty():
            break
        seed += 1
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    common = words.filter(F.col("n") >= least)
    whole = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    over = max(ROUTE_SUFFIXES, whole // HOT_SHARE)
    hot = [np.array([r.key for r in words.filter(F.col("n") > over).select("key").collect()], dtype=np.int64).reshape(-1, 1)]
    hot = [h.view(np.uint64) for h in hot]
    extra = []
    while len(hot) < DEPTH - 1 and len(hot[-1]):
        more = hot_prefixes(texts, seed, hot, over)
        extra += [(r[:-1], r[-1]) for r in more.tolist()]
        hot.append(np.ascontiguousarray(more[:, :-1]).view(np.uint64))
    flags = spark.sparkContext.broadcast(_flags(common.select("key")))
    rows = routed(texts, seed, flags, hot, max(1, -(-whole // ROUTE_SUFFIXES)))
    grams = counted_routes(rows, hot, least).unionByName(common.select(F.array("key").alias("g"), "n"))
    if extra:
        grams = grams.unionByName(spark.createDataFrame(extra, "g array<long>, n long"))
    return materialize(grams, "grams"), common, totals


def _score(a: Column, rest: Column) -> Column:
    """floor(SCORE_SCALE * a / rest) in decimals, as products may pass 64 bits."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", F.lit(SCORE_SCALE).cast("decimal(10,0)") * wide(a), wide(rest))


def scored(grams: DataFrame) -> DataFrame:
    """(g, a, l, r, score) of each phrase (g, n) of two words and more: the lowest score over its cuts, ties by the earliest cut."""
    many = grams.filter(F.size("g") > 1).select("g", F.col("n").alias("a"))
    cuts = many.select("g", "a", F.explode(F.expr("sequence(1, size(g) - 1)")).alias("k"))
    cuts = cuts.select("*", F.expr("slice(g, 1, k)").alias("x"), F.expr("slice(g, k + 1, size(g) - k)").alias("y"))
    both = cuts.join(grams.select(F.col("g").alias("x"), F.col("n").alias("l")), "x").join(grams.select(F.col("g").alias("y"), F.col("n").alias("r")), "y")
    best = both.select("g", F.struct(_score(F.col("a"), F.col("l") + F.col("r")).alias("score"), "k", "a", "l", "r").alias("c")).groupBy("g").agg(F.min("c").alias("c"))
    return best.select("g", "c.a", "c.l", "c.r", "c.score")


def uncovered(phrases: DataFrame, percent: int = COVER_PERCENT) -> DataFrame:
    """Phrases (g, a, ..) without those inside a longer one that occurs at least `percent` per cent as often."""
    inner = phrases.filter(F.size("g") > 2).select("a", F.explode(F.expr("flatten(transform(sequence(2, size(g) - 1), m -> transform(sequence(1, size(g) - m + 1), i -> slice(g, i, m))))")).alias("g"))
    longest = inner.groupBy("g").agg(F.max("a").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    d = phrases.join(longest, "g", "left")
    return d.filter(F.col("longer").isNull() | (100 * wide("longer") < percent * wide("a"))).drop("longer")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = MIN_COUNT, top: int = TOP, percent: int = COVER_PERCENT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language.

    Phrases do not cross the ends of pieces. Ties of score go by count, then by the phrase's bytes. Repeated rows
    count as often as they occur. An empty table, or one where no phrase occurs `least` times, gives no rows.
    """
    grams, words, totals = phrase_counts(docs, text, lang, least)
    found = materialize(uncovered(materialize(scored(grams), "scored"), percent), "phrases")
    spelt = found.select("*", F.posexplode("g").alias("i", "key")).join(words.select("key", "lang", "word"), "key")
    spelt = spelt.groupBy("g", "a", "l", "r", "score").agg(F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("i", "word"))).alias("w"))
    spelt = spelt.withColumn("phrase", F.concat_ws(" ", F.transform("w", lambda x: x.word)))
    first = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = spelt.select("lang", F.row_number().over(first).alias("rank"), "phrase", "a", "l", "r", "score").filter(F.col("rank") <= top)
    cast = lambda *names: [F.col(c).cast("long").alias(c) for c in names]
    return best.join(totals, "lang").withColumnRenamed("total", "n").select("lang", *cast("rank"), "phrase", *cast("a", "l", "r", "n", "score"))
