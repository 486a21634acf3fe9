"""Personal data, and the words that give it away. Column expressions only.

Base kinds are patterns. Beyond them, all words of the documents with a found value are weighed by how much they
tell about it: with document counts over the corpus, the pointwise mutual information of word and value, as a share of the
value's own information content. 1 means that the word occurs with this value only. From REMOVE on a word is
removed, from GENERALISE on it is replaced by a general one, wherever it stands in the documents of the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import let
from dossier.llm.base import BROADCAST_KEYS, fits, materialize

KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds.
FURTHER = ("removed", "generalised")
ALL_KINDS = KINDS + FURTHER
REMOVE, GENERALISE = 0.9, 0.6
#: A word must stand in so many documents of a value to tell something about it.
MIN_SUPPORT = 2
#: Letters and digits, with a letter among them.
TERM = r"(?<![\p{L}\p{N}])\p{N}*+\p{L}[\p{L}\p{N}]*+"

# Repeats are possessive where nothing follows that could need them back; matches are the same, and a long run
# costs neither stack nor a second pass. The first class starts at the beginning of its run or where a match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def located(text: Column, pattern: str | Column) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches; code points, end exclusive.

    The gaps between the matches (split) and the matches themselves give the places.
    """
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))

    def step(acc: Column, x: Column) -> Column:
        begin = acc.pos + F.length(x.gap)
        end = begin + F.length(x.hit)
        more = F.array(F.struct(begin.alias("start"), end.alias("end"), x.hit.alias("value")))
        return F.when(x.hit.isNull(), acc).otherwise(F.struct(end.alias("pos"), F.concat(acc.out, more).alias("out")))

    return F.aggregate(parts, start, step, lambda acc: acc.out)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Luhn's test of a string of digits."""
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: let(c.cast("int") * (1 + i % 2), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(each, F.lit(0), lambda a, v: a + v) % 10 == 0


def _ip_parts(value: Column) -> Column:
    bare = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(bare, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end, value>> of one text, sorted by start and kind. A kind is looked for only where its mark occurs."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    card = lambda x: let(digits(x.value), lambda d: F.length(d).between(14, 19) & luhn(d))
    tests = {
        "email": (text.contains("@"), EMAIL, lambda x: F.lit(True)),
        "ip": (text.rlike(r"[0-9]\.[0-9]+\.[0-9]"), IP, lambda x: _ip_parts(x.value)),
        "card": (text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), CARD, card),
        "phone": (text.contains("+"), PHONE, lambda x: F.length(digits(x.value)).between(10, 15)),
    }
    found = []
    for number, (kind, (mark, pattern, test)) in enumerate(tests.items()):
        named = F.transform(F.filter(located(text, pattern), test), _named(number, kind))
        found.append(F.when(mark, named).otherwise(F.transform(none, _named(number, kind))))
    return F.transform(F.array_sort(F.concat(*found)), lambda x: F.struct(x.kind.alias("kind"), x.start.alias("start"), x.end.alias("end"), x.value.alias("value")))


def _named(number: int, kind: str):
    return lambda x: F.struct(x.start.alias("start"), F.lit(number).alias("o"), x.end.alias("end"), F.lit(kind).alias("kind"), x.value.alias("value"))


def outside(text: Column, spans: Column) -> Column:
    """The text with a space for each span, of overlapping ones for what the ones before leave."""
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc.pos + 1, F.greatest(x.start - acc.pos, F.lit(0)))
        return F.struct(F.greatest(acc.pos, x.end).alias("pos"), F.concat(acc.out, gap, F.lit(" ")).alias("out"))

    rest = F.aggregate(spans, start, step, lambda acc: F.concat(acc.out, F.substring(text, acc.pos + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(rest)


def revealing(valued: DataFrame, own: DataFrame) -> DataFrame:
    """(entity, term, action) for words that tell enough about a value.

    valued: written rows (rid, entities, forms) of the documents with values; own: written rows (t), the text
    outside the values, of all documents. Counts are of documents on all sides. A value or a word in fewer than
    MIN_SUPPORT documents cannot have that many together and is left out before words and values are paired.
    """
    entities = valued.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    entities = materialize(entities.filter(F.col("n_entity") >= MIN_SUPPORT), "entities")
    small = fits(entities, BROADCAST_KEYS)
    kept = valued.select("forms", F.explode("entities").alias("entity")).join(F.broadcast(entities) if small else entities, "entity")
    together = kept.select("entity", "n_entity", F.explode(F.array_distinct(F.transform("forms", F.lower))).alias("term"))
    together = together.groupBy("entity", "term").agg(F.first("n_entity").alias("n_entity"), F.count("*").alias("n_both")).filter(F.col("n_both") >= MIN_SUPPORT)
    together = materialize(together, "together")
    terms = materialize(together.select("term").distinct(), "terms")
    words = own.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all("t", F.lit(TERM), F.lit(0)), F.lower))).alias("term"))
    if fits(terms, BROADCAST_KEYS):
        words = words.join(F.broadcast(terms), "term", "left_semi")
    counts = words.groupBy("term").agg(F.count("*").alias("n_term"))
    total = F.lit(float(max(own.count(), 1)))
    d = together.join(counts, "term")
    told = F.log2(F.col("n_both") * total / (F.col("n_entity") * F.col("n_term")))
    own_bits = F.log2(total / F.col("n_entity"))
    share = F.when(own_bits > 0, told / own_bits).otherwise(0.0)
    action = F.when(share >= REMOVE, FURTHER[0]).when(share >= GENERALISE, FURTHER[1])
    return d.select("entity", "term", action.alias("action")).filter("action is not null")


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_hash, base, further) per row of docs.

    base: array<struct<kind, start, end, value>> sorted by start and kind; further: array<struct<kind, start, end>>
    of revealing words, kind removed or generalised, in no order. Places count code points, end exclusive. A null text
    is empty. Null and repeated keys and repeated rows are looked through like others, and each row counts as a
    document; an empty table gives no rows; other columns are not read.
    """
    own = docs.select(F.col(f"`{key}`").alias("doc"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    found = own.select("doc", F.xxhash64("t").alias("text_hash"), "t", base_spans(F.col("t")).alias("base"))
    found = materialize(found.withColumn("rid", F.monotonically_increasing_id()), "found")
    rest = found.select("rid", "base", outside(F.col("t"), F.col("base")).alias("t"))
    forms = F.array_distinct(F.regexp_extract_all("t", F.lit(TERM), F.lit(0)))
    entities = F.array_distinct(F.transform("base", lambda x: F.lower(x.value)))
    valued = materialize(rest.filter(F.size("base") > 0).select("rid", entities.alias("entities"), forms.alias("forms")), "valued")
    told = materialize(revealing(valued, rest.select("t")), "revealing")
    few = fits(told, BROADCAST_KEYS)
    named = told.select("entity").distinct()
    pairs = valued.select("rid", "forms", F.explode("entities").alias("entity")).join(F.broadcast(named) if few else named, "entity", "left_semi")
    pairs = pairs.select("rid", "entity", F.explode("forms").alias("form")).withColumn("term", F.lower("form"))
    marked = pairs.join(F.broadcast(told) if few else told, ["entity", "term"]).groupBy("rid", "form").agg(F.max("action").alias("kind"))  # removed goes before generalised
    marked = materialize(marked.groupBy("rid").agg(F.collect_list(F.struct("form", "kind")).alias("marks")), "marked")
    whole = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform("marks", lambda m: m.form), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    d = found.join(marked, "rid", "left").withColumn("hits", F.when(F.col("marks").isNotNull(), located(F.col("t"), whole)))
    free = F.filter("hits", lambda x: ~F.exists("base", lambda b: (b.start < x.end) & (x.start < b.end)))
    kinds = F.map_from_entries(F.transform("marks", lambda m: F.struct(m.form, m.kind)))
    further = F.transform(free, lambda x: F.struct(F.element_at(kinds, x.value).alias("kind"), x.start.cast("long").alias("start"), x.end.cast("long").alias("end")))
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    base = F.transform("base", lambda x: F.struct(x.kind.alias("kind"), x.start.cast("long").alias("start"), x.end.cast("long").alias("end"), x.value.alias("value")))
    return d.select(F.col("doc").alias(key), "text_hash", base.alias("base"), F.coalesce(further, empty).alias("further"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets (removed ones by nothing). spans: sorted by start; of overlapping ones the first counts."""
    start = F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        label = F.when(x.kind == FURTHER[0], "").when(x.kind == FURTHER[1], "[WORD]").otherwise(F.concat(F.lit("["), F.upper(x.kind), F.lit("]")))
        cut = F.concat(acc.out, F.substring(text, (acc.pos + 1).cast("int"), (x.start - acc.pos).cast("int")), label)
        return F.when(x.start < acc.pos, acc).otherwise(F.struct(x.end.alias("pos"), cut.alias("out")))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc.out, F.substring(text, (acc.pos + 1).cast("int"), F.length(text))))


def sanitised(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with `clean`, the text without what personal_data finds; null stays null."""
    found = personal_data(docs, key, text).filter((F.size("base") > 0) | (F.size("further") > 0))
    slim = F.transform("base", lambda x: F.struct(x.kind.alias("kind"), x.start.alias("start"), x.end.alias("end")))
    spans = found.select(F.col(key).alias("_k"), F.col("text_hash").alias("_h"), F.array_sort(F.concat(slim, "further"), lambda a, b: F.when(a.start < b.start, -1).when(a.start > b.start, 1).otherwise(b.end.cast("int") - a.end.cast("int"))).alias("_spans"))
    spans = materialize(spans.dropDuplicates(["_k", "_h"]), "spans")
    t = F.col(f"`{text}`").cast("string")
    d = docs.join(spans, F.col(f"`{key}`").eqNullSafe(F.col("_k")) & (F.xxhash64(t) == F.col("_h")), "left")
    return d.withColumn("clean", F.when(F.col("_spans").isNull(), t).otherwise(redacted(t, F.col("_spans")))).drop("_k", "_h", "_spans")
