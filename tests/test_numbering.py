from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.operators.numbering import carry_forward, number_within
from dossier.operators import numbering, tree
from dossier.sources import raw


def skewed(spark):
    d = spark.range(600).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 17).alias("k"), (F.col("id") * 37 % 1009).alias("o"))
    return d.dropDuplicates(["k", "o"])


def test_numbers_equal_row_number_with_many_ranges(spark):
    d = skewed(spark)
    got = number_within(d, "k", "o", "n", ranges=20)
    want = d.withColumn("w", F.row_number().over(W.partitionBy("k").orderBy("o")))
    assert got.join(want, ["k", "o"]).filter("n <> w").count() == 0 and got.count() == d.count()


def test_carry_forward_equals_window(spark):
    d = skewed(spark).withColumn("v", F.when(F.col("o") % 5 == 0, F.col("o")))
    got = carry_forward(d, "k", "o", {"c": "v"}, ranges=15)
    w = W.partitionBy("k").orderBy("o").rowsBetween(W.unboundedPreceding, -1)
    want = d.withColumn("w", F.last("v", ignorenulls=True).over(w))
    assert got.join(want, ["k", "o"]).filter("not (c <=> w)").count() == 0


def test_paging_caps_follow_listing_order(spark):
    d = spark.createDataFrame([(1, i) for i in range(10)] + [(2, 5)], "c int, i int")
    rows = raw.paged_listing(d, "c", "i", 3, max_pages=2, max_docs=5).orderBy("c", "i").collect()
    assert [(r.c, r.i, r.page_num, r.total_pages) for r in rows] == [(1, 0, 1, 4), (1, 1, 1, 4), (1, 2, 1, 4), (1, 3, 2, 4), (1, 4, 2, 4), (2, 5, 1, 1)]


def test_missing_ordinals_over_several_blocks(spark):
    d = spark.createDataFrame([("a", 1), ("a", 2), ("a", 9), ("a", 9), ("b", 4)], "p string, o int")
    assert sorted(r.ordinal for r in tree.missing_ordinals(d, "p", "o", block=3).collect()) == [3, 4, 5, 6, 7, 8]
    r = {x.parent: x for x in tree.ordinal_continuity(d, "p", "o").collect()}
    assert (r["a"].missing_count, r["a"].duplicate_count, r["a"].status) == (6, 1, "incomplete") and r["b"].status == "complete"


def test_null_keys_and_null_order_stay(spark):
    from dossier.operators.numbering import number_within

    rows = [("a", 5), ("a", None), (None, 2), (None, 1)]
    got = number_within(spark.createDataFrame(rows, "k string, i long"), "k", "i", "n").collect()
    assert sorted((r.k or "", r.i or 0, r.n) for r in got) == [("", 1, 1), ("", 2, 2), ("a", 0, 1), ("a", 5, 2)]


def range_sizes(d, ranges=16):
    return [r["count"] for r in numbering.ranged(d, ["k"], "o", ranges).groupBy("k", "_r").count().collect()]


def test_far_and_constant_orders_are_spread(spark):
    n, mean = 8000, 8000 / 16
    far = spark.range(n).select(F.lit(1).alias("k"), F.when(F.col("id") == 5, 10**15).otherwise(F.col("id")).alias("o"))
    same = spark.range(n).select(F.lit(1).alias("k"), F.lit(7).cast("long").alias("o"), "id")
    for d in (far.repartition(4), same.repartition(4)):
        sizes = range_sizes(d)
        assert sum(sizes) == n and max(sizes) <= 2 * mean
        got = number_within(d, "k", "o", "n", ranges=16)
        assert sorted(r.n for r in got.select("n").collect()) == list(range(1, n + 1))
    assert number_within(far, "k", "o", "n").filter("o = 1000000000000000").first().n == n


def test_ties_get_the_same_numbers_however_rows_are_dealt(spark):
    d = spark.range(500).select((F.col("id") % 3).alias("k"), (F.col("id") % 2).alias("o"), "id")
    one, other = ({(r.id, r.n) for r in number_within(d.repartition(p), "k", "o", "n", ranges=r_).collect()} for p, r_ in ((2, 5), (7, 11)))
    assert one == other


def test_preparing_columns_are_computed_once_per_row(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(x):
        calls.add(1)
        return x if x % 3 == 0 else None

    d = spark.range(300).select(F.lit("a").alias("k"), F.col("id").alias("o"))
    got = carry_forward(d, "k", "o", {"c": "v"}, prepare=lambda x: x.withColumn("v", seen("o")))
    assert [r.c for r in got.orderBy("o").collect()][:5] == [None, 0, 0, 0, 3] and calls.value == 300
