"""What op10 spends on a line: comparisons end early, fingerprints count every word once."""

import random

import pytest

from dossier.llm import line_dedup, queries


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_unlike_lines_are_given_up_early(monkeypatch):
    draw, look, columns = random.Random(1), line_dedup._least_in_column, []
    monkeypatch.setattr(line_dedup, "_least_in_column", lambda *x: (columns.append(x[3]), look(*x))[1])
    a, b = ("".join(draw.choice("abcdefgh ") for _ in range(1200)) for _ in range(2))
    assert line_dedup.edit_similarity(a, b, 0.8) == 0.0
    assert 0 < columns[-1] < len(b) / 1.5
    assert line_dedup.edit_similarity(a, b) == 1 - distance(a, b) / len(a)


@pytest.mark.parametrize("least", [0.5, 0.8, 0.9])
def test_giving_up_changes_no_verdict(least):
    draw = random.Random(2)
    for n in [70, 130, 200] * 20:
        a = "".join(draw.choice("abcd ") for _ in range(n))
        b = list(a)
        for _ in range(int(n * draw.choice([0.05, 0.1, 0.2, 0.22, 0.4, 0.6]))):
            i, how = draw.randrange(len(b)), draw.random()
            b[i : i + (how < 0.7)] = draw.choice(["", "a", "b"]) if how < 0.4 else draw.choice("abcd")
            b = b or ["x"]
        b = "".join(b)
        assert line_dedup.similar(a, b, least) == (1 - distance(a, b) / max(len(a), len(b)) >= least - 1e-12)


def test_fingerprints_do_not_depend_on_the_lines_beside():
    draw = random.Random(3)
    lines = [b" ".join(draw.choice([b"a", b"|", b"wort", "été".encode()]) for _ in range(n)) for n in (1, 5, 254, 255, 256, 511, 900)] + [b"| -"]
    together = line_dedup.line_fingerprints(lines).tolist()
    assert together == [line_dedup.line_fingerprints([x]).tolist()[0] for x in lines]
    # Repeating a line's words as often as one likes leaves every majority as it is.
    assert together == line_dedup.line_fingerprints([b" ".join([x] * 300) for x in lines]).tolist()


def test_lines_are_single_spaced():
    assert [line_dedup.normal(x) for x in ("A\tb", " a  B ", "a b", "a\x0bb\rc", "", " \t", "a b")] == [b"a b", b"a b", "a b".encode(), b"a b c", b"", b"", b"a b"]


def test_newlines_are_counted_without_a_pattern(spark):
    d = queries.op10_line_dedup(spark, "/root/testdata/sf0.001")
    assert "regexp_count" not in d._jdf.queryExecution().optimizedPlan().toString()
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert {r.doc_id: r.n_lines for r in d.collect()} == {r.doc_id: 0 if r.text is None else r.text.count("\n") + 1 for r in texts}
