"""Revealing words anywhere in the documents of a value, short names and codes included."""

from dossier.llm import pii


def test_words_far_from_a_value_are_weighed_and_marked_everywhere(spark):
    far = " and then some more of the same " * 20
    texts = [f"Zorblatt met Li in A17.{far}Write to spy@mail.example.com.{far}zorblatt left A17, Li stayed" for _ in range(3)]
    texts += [far] * 30
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(d).collect()}
    words = sorted(texts[0][s.start : s.end] for s in got[0].further)
    assert {w: words.count(w) for w in ("Zorblatt", "zorblatt", "Li", "A17")} == {"Zorblatt": 1, "zorblatt": 1, "Li": 2, "A17": 2}
    assert "same" not in words and not got[10].further
    assert not any(b.start < s.end and s.start < b.end for s in got[0].further for b in got[0].base)
    clean = pii.sanitised(d).filter("doc_id = 1").first().clean
    assert "orblatt" not in clean and "A17" not in clean and "[EMAIL]" in clean
