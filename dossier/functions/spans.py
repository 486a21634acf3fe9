"""Positions inside one text: cut at markers, cut by size, coverage by spans."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from dossier.functions.session import map_slices

CUT = "\u0001"
PIECE = T.ArrayType(
    T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())])
)
COVERAGE = T.StructType(
    [
        T.StructField("source", T.LongType()),
        T.StructField("covered", T.LongType()),
        T.StructField("uncovered", T.LongType()),
        T.StructField("ranges", T.LongType()),
        T.StructField("first_ranges", PIECE),
    ]
)
# The marks a window or a part may end at.
WINDOW_STOPS = "。；;.\n"
PART_STOPS = "。；;. "


def segments(text: Column, pattern: str) -> Column:
    """Cuts a text before every match; piece 0 is what precedes the first match.

    Gives array<struct<start, text>> with 0-based starts.
    """
    pieces = F.split(F.regexp_replace(text, f"({pattern})", CUT + "$1"), CUT)
    empty = F.array().cast("array<struct<start:int,text:string>>")
    return F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p)).alias("at"),
            F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), p.alias("text")))).alias("out"),
        ),
        lambda a: a["out"],
    )


def cut_text(text: str, size: int, overlap: int | None, stops: str) -> list[dict]:
    """Cuts one text into pieces of at most `size` characters, preferably after a stop in the second half.

    With an overlap the next piece starts that many characters before the end
    of the last; without one it starts at the next non-blank character.
    """
    if len(text) <= size:
        body = text.strip()
        lead = len(text) - len(text.lstrip())
        return [{"start": lead, "end": lead + len(body), "text": body}] if body else []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at_stop = np.flatnonzero(np.isin(codes, [ord(c) for c in stops]))
    n, at, out = len(codes), 0, []
    while at < n:
        end = min(n, at + size)
        if end < n:
            last = np.searchsorted(at_stop, end) - 1
            if last >= 0 and at_stop[last] > at + size // 2:
                end = int(at_stop[last]) + 1
        raw = text[at:end]
        body = raw.strip()
        if body:
            lead = at + len(raw) - len(raw.lstrip())
            out.append({"start": lead, "end": lead + len(body), "text": body})
        if end >= n:
            break
        if overlap is None:
            rest = text[end : end + size]
            at = end + len(rest) - len(rest.lstrip())
        else:
            at = max(end - overlap, at + 1)
    return out


def check_sizes(size: int, overlap: int | None) -> None:
    if size <= 0:
        raise ValueError("size must be positive")
    if overlap is not None and not 0 <= overlap < size:
        raise ValueError("overlap must be non-negative and smaller than size")


def cutter(size: int, overlap: int | None, stops: str):
    """An Arrow function text -> pieces."""
    check_sizes(size, overlap)

    @F.pandas_udf(PIECE)
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([cut_text(t or "", size, overlap, stops) for t in texts])

    return cut


def covered(text: str, ss, es) -> tuple[int, int, int, int, list[dict]]:
    """The fields of COVERAGE for one text and the starts and ends of its spans."""
    n = len(text)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.clip(np.asarray(ss, np.int64), 0, n), 1)
    np.add.at(edge, np.clip(np.maximum(np.asarray(es, np.int64), np.asarray(ss, np.int64)), 0, n), -1)
    inside = np.cumsum(edge[:-1]) > 0
    solid = np.fromiter((not c.isspace() for c in text), bool, n)
    open_ = solid & ~inside
    flips = np.flatnonzero(np.diff(np.concatenate(([0], open_.astype(np.int8), [0]))))
    first = [
        {"start": int(a), "end": int(b), "text": " ".join(text[a:b].split())[:120]}
        for a, b in zip(flips[0:40:2], flips[1:40:2])
    ]
    return int(solid.sum()), int((solid & inside).sum()), int(open_.sum()), len(flips) // 2, first


@F.pandas_udf(COVERAGE)
def coverage(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    """Non-blank characters of a text inside any span, and the first 20 uncovered runs."""
    rows = [covered(*r) for r in zip(texts, starts, ends)]
    return pd.DataFrame(rows, columns=["source", "covered", "uncovered", "ranges", "first_ranges"])


def covered_rows(df: DataFrame, keys: list[str], text: str, spans: str, out: str) -> DataFrame:
    """keys and the coverage of each row's text by its array of spans, as struct `out`, a few rows at a time."""
    d = df.select(*keys, F.col(text).alias("_t"), F.col(spans)["start"].alias("_s"), F.col(spans)["end"].alias("_e"))
    schema = T.StructType([*(d.schema[k] for k in keys), T.StructField(out, COVERAGE)])
    kind = to_arrow_type(COVERAGE)

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = zip(*(batch[c].to_pylist() for c in ("_t", "_s", "_e")))
        found = [dict(zip(COVERAGE.names, covered(*r))) for r in rows]
        return pa.RecordBatch.from_arrays([*(batch[k] for k in keys), pa.array(found, kind)], names=schema.names)

    return map_slices(d, made, schema)


RANGES = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))


@F.pandas_udf(RANGES)
def elements_under(element_starts: pd.Series, element_ends: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    """Numbers (from 1) of the first and last element that overlap each span; first > last where none does.

    The elements of a row are sorted and disjoint, so one sweep over both ends finds the elements of all its spans.
    A span with its ends exchanged counts as the span between them.
    """
    out = []
    for es, ee, ss, se in zip(element_starts, element_ends, starts, ends):
        a, b = np.asarray(ss, np.int64), np.asarray(se, np.int64)
        low, high = np.minimum(a, b), np.maximum(a, b)
        first = np.searchsorted(np.asarray(ee, np.int64), low, side="right") + 1
        last = np.searchsorted(np.asarray(es, np.int64), high, side="left")
        out.append([{"first": int(f), "last": int(t)} for f, t in zip(first, last)])
    return pd.Series(out)


def overlap_join(
    left: DataFrame, right: DataFrame, keys: list[str], width: int, how_left: tuple[str, str] = ("start", "end"),
    how_right: tuple[str, str] = ("r_start", "r_end"),
) -> DataFrame:
    """Pairs of rows with equal keys whose half-open spans overlap.

    Each span is listed once per bucket of `width` positions it touches, so the
    join key is (keys, bucket) and one long document spreads over many tasks.
    A pair is kept only in the bucket where the later of both spans starts.
    """
    ls, le = how_left
    rs, re = how_right

    def bucketed(d: DataFrame, s: str, e: str) -> DataFrame:
        last = F.greatest(F.col(e) - 1, F.col(s))
        return d.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(last / width))))

    pairs = bucketed(left, ls, le).join(bucketed(right, rs, re), [*keys, "_bucket"])
    return pairs.filter(
        (F.col(rs) < F.col(le)) & (F.col(re) > F.col(ls))
        & (F.col("_bucket") == F.floor(F.greatest(F.col(ls), F.col(rs)) / width))
    ).drop("_bucket")
