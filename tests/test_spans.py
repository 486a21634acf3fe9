import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dossier.functions import spans


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab。；. \n", max_size=120), st.integers(5, 30), st.integers(0, 4))
def test_windows_cover_the_text(text, size, overlap):
    pieces = spans.cut_text(text, size, overlap, spans.WINDOW_STOPS)
    seen = set()
    for p in pieces:
        assert text[p["start"] : p["end"]] == p["text"] and 0 < len(p["text"]) <= size
        seen |= set(range(p["start"], p["end"]))
    assert all(i in seen or text[i].isspace() for i in range(len(text)))


def test_second_window_starts_with_the_overlap():
    pieces = spans.cut_text("abcdefghijklmnopqrstuvwxyz", 12, 4, spans.WINDOW_STOPS)
    assert pieces[1]["text"].startswith(pieces[0]["text"][-4:])


def test_parts_do_not_overlap():
    text = "one two. three four; five six seven eight"
    pieces = spans.cut_text(text, 12, None, spans.PART_STOPS)
    assert all(a["end"] <= b["start"] for a, b in zip(pieces, pieces[1:]))


def test_coverage_matches_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for i in range(40):
        text = "".join(rng.choice("ab  c") for _ in range(rng.randint(0, 60)))
        cuts = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(rng.randint(0, 4))]
        rows.append((i, text, [(min(c), max(c)) for c in cuts]))
    d = spark.createDataFrame(rows, "id int, text string, s array<struct<start:int,end:int>>")
    got = {r.id: r.c for r in d.select("id", spans.coverage("text", F.col("s")["start"], F.col("s")["end"]).alias("c")).collect()}
    for i, text, cuts in rows:
        inside = {p for a, b in cuts for p in range(a, min(b, len(text)))}
        solid = [p for p, ch in enumerate(text) if not ch.isspace()]
        open_ = [p for p in solid if p not in inside]
        runs = sum(1 for j, p in enumerate(open_) if j == 0 or open_[j - 1] != p - 1)
        assert (got[i].source, got[i].covered, got[i].uncovered, got[i].ranges) == (len(solid), len(solid) - len(open_), len(open_), runs)


def test_overlap_join_matches_brute_force_on_a_hot_document(spark):
    rng = random.Random(3)
    span = lambda: (lambda a: (a, a + rng.randint(1, 40)))(rng.randint(0, 400))
    left = [(0 if i % 3 else i, i, *span()) for i in range(60)]
    right = [(0 if i % 3 else i, i, *span()) for i in range(60)]
    ld = spark.createDataFrame(left, "doc int, l int, start int, end int")
    rd = spark.createDataFrame(right, "doc int, r int, r_start int, r_end int")
    got = {(x.l, x.r) for x in spans.overlap_join(ld, rd, ["doc"], 16).select("l", "r").collect()}
    n = spans.overlap_join(ld, rd, ["doc"], 16).count()
    want = {(a[1], b[1]) for a in left for b in right if a[0] == b[0] and b[2] < a[3] and b[3] > a[2]}
    assert got == want and n == len(want)
