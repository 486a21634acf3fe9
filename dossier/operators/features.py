"""Small deterministic text vectors: term features and hashed characters."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions.text import drop_blanks, let
from dossier.functions.vectors import unit

# The term features of the offline embedding, in order.
TERM_FEATURES = (
    ("annual_leave", ("年假", "年休假", "带薪年休假", "休假")),
    ("late_or_early", ("迟到", "早退")),
    ("absence", ("旷工", "矿工", "缺勤")),
    ("disciplinary_action", ("处罚", "处分", "处理", "记过", "辞退", "扣除", "工资")),
    ("violation_class", ("一类违规", "二类违规", "三类违规", "违规", "纪律", "破坏学校管理秩序")),
    ("expense", ("报销", "差旅", "票据", "费用", "虚假")),
    ("security", ("数据", "外传", "账号", "凭证", "保密", "待遇", "薪酬")),
    ("employee", ("员工", "老师", "教师", "学校")),
)
BUCKETS = 8
CHAR_WEIGHT = 0.15
INPUT_TYPES = ("query", "document")


def compact(text) -> Column:
    return F.lower(drop_blanks(text))


def term_features(text: Column, features=TERM_FEATURES) -> Column:
    """Per feature the characters covered by its terms: occurrences times term length, summed."""
    def covered(t: Column, term: str) -> Column:
        return F.length(t) - F.length(F.replace(t, F.lit(term.lower()), F.lit("")))

    return let(
        text, lambda t: F.array(*[sum((covered(t, term) for term in terms), F.lit(0)).cast("double") for _, terms in features])
    )


def _blake_bucket(code: int) -> int:
    digest = hashlib.blake2b(chr(code).encode("utf-8", "surrogatepass"), digest_size=2).digest()
    return int.from_bytes(digest, "big") % BUCKETS


def bucket_counts(text: Column, hashing: str = "blake2b") -> Column:
    """How many characters of the text fall into each bucket.

    Each distinct character of a text is hashed once per worker; counting is
    vectorized over the code points of the whole text.
    """
    if hashing not in ("blake2b", "code_point"):
        raise ValueError(f"unknown hashing {hashing}")

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def count(texts: pd.Series) -> pd.Series:
        known: dict[int, int] = {}
        out = []
        for t in texts:
            codes, n = np.unique(np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
            if hashing == "code_point":
                at = codes % BUCKETS
            else:
                at = np.array([known.setdefault(c, _blake_bucket(c)) if c not in known else known[c] for c in codes.tolist()], np.int64)
            out.append(np.bincount(at.astype(np.int64), weights=n, minlength=BUCKETS).astype(np.int64))
        return pd.Series(out)

    return count(text)


def checked_input_type(input_type: Column) -> Column:
    """The input type, or an error for anything but query and document."""
    return F.when(
        input_type.isin(*INPUT_TYPES), input_type
    ).otherwise(F.raise_error(F.concat(F.lit("unsupported input_type: "), F.coalesce(input_type, F.lit("null")))))


def embed(df: DataFrame, text: str, out: str = "embedding", features=TERM_FEATURES, hashing: str = "blake2b") -> DataFrame:
    """Adds the unit vector of term features and hashed characters."""
    t = compact(F.col(text))
    d = df.withColumn("_n", bucket_counts(t, hashing))
    chars = F.transform("_n", lambda n: n.cast("double") * CHAR_WEIGHT)
    return d.withColumn(out, unit(F.concat(term_features(t, features), chars))).drop("_n")


def token_table(df: DataFrame, keys: list[str], text: str, limit: int = 128, skip_blanks: bool = False) -> DataFrame:
    """First `limit` characters as rows with code point, next to the token count of the whole text."""
    t = drop_blanks(F.col(text)) if skip_blanks else F.col(text)
    d = df.select(*keys, F.length(t).alias("token_count"), F.substring(t, F.lit(1), F.lit(limit)).alias("_t"))
    d = d.select(*keys, "token_count", F.posexplode(F.split("_t", "")).alias("token_index", "token")).filter("token <> ''")
    return d.withColumn("token_id", F.ascii("token"))
