from pyspark.sql import functions as F

from dossier.operators import parsing


def elements(spark, html):
    d = parsing.html_elements(spark.createDataFrame([(1, html)], "id int, html string"))
    return [(r.kind, r.text, list(r.path), r.start, r.end) for r in d.select(F.inline("elements")).collect()]


def kinds_and_texts(spark, html):
    return [(k, t) for k, t, *_ in elements(spark, html)]


def test_blocks_table_and_script(spark):
    html = "<h1>Title</h1><p>One&nbsp;<b>two</b><br>three</p><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2 &amp; 3</td></tr></table><script>var a='</p>';</script>"
    assert kinds_and_texts(spark, html) == [("title", "Title"), ("paragraph", "One two three"), ("table", "A | B 1 | 2 & 3")]


def test_new_block_closes_old_and_unfinished_last_block_goes(spark):
    assert kinds_and_texts(spark, "lost<p>a<li>b</li>lost</p><p>c<p>never closed") == [("paragraph", "a"), ("paragraph", "b"), ("paragraph", "c")]


def test_heading_levels_reset(spark):
    got = elements(spark, "<h1>A</h1><h2>B</h2><h3>C</h3><p>x</p><h2>D</h2><p>y</p><h1>E</h1><p>z</p>")
    assert [p for _, _, p, *_ in got] == [["A"], ["A", "B"], ["A", "B", "C"], ["A", "B", "C"], ["A", "D"], ["A", "D"], ["E"], ["E"]]


def test_table_inside_paragraph_comes_first_and_keeps_cell_text_out(spark):
    html = "<p>before <table><tr><td>cell</td></tr><tr><td> </td></tr></table>after</p>"
    assert kinds_and_texts(spark, html) == [("table", "cell"), ("paragraph", "before after")]


def test_quoted_angle_bracket_and_double_escape(spark):
    assert kinds_and_texts(spark, '<p title="a>b">x &amp;lt; y</p>') == [("paragraph", "x < y")]


def test_plain_fallback_and_empty(spark):
    assert kinds_and_texts(spark, "第一段。 第二段\n\nthird <i>one</i>") == [("paragraph", "第一段。"), ("paragraph", "第二段"), ("paragraph", "third one")]
    assert elements(spark, "<p> </p>") == [] and elements(spark, None) == []


def test_offsets_point_into_joined_text(spark):
    got = elements(spark, "<p>ab</p><p>cde</p><p>f</p>")
    text = " ".join(t for _, t, *_ in got)
    assert all(text[s:e] == t for _, t, _, s, e in got)


def test_english_title_has_nine_words_in_front_whatever_their_length(spark):
    from pyspark.sql import functions as F

    from dossier.operators.chunking import english_tail_start

    words = ["L" + "o" * 70] * 8
    text = "正文 " + " ".join(words) + " Employee Disciplinary Rules rest"
    assert spark.createDataFrame([(text,)], "t string").select(english_tail_start(F.col("t"))).first()[0] == 3
