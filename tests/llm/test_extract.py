import random

import pytest

from quillstone.llm import extract


def test_held_out_pages():
    rng = random.Random(123)
    right = total = 0
    field = extract.model()
    import numpy as np

    for _ in range(120):
        page, labels = extract.labelled_blocks(rng)
        got = field.viterbi(np.vstack([extract.features(page)]), np.array([len(page)]))
        right += int((got == np.array(labels)).sum())
        total += len(labels)
    assert right >= 0.95 * total


PAGE = '<html><head><title>T</title><script>var x = "<p>no</p>";</script></head><body><nav><ul><li><a href="/">Home page</a></li><li><a href="/b">About us</a></li></ul></nav><article><h1>The long story</h1><p>It was a fine morning in the valley, and all the people were out.<p>Then the rain came &amp; went, and nobody minded it at all.</article><footer>© 2024 all rights</footer></body></html>'


def test_blocks():
    assert [b[0] for b in extract.blocks(PAGE)] == ["T", "Home page", "About us", "The long story", "It was a fine morning in the valley, and all the people were out.", "Then the rain came & went, and nobody minded it at all.", "© 2024 all rights"]


def test_main_text(spark):
    text = extract.extract(spark.createDataFrame([(1, PAGE)], "page_id long, html string")).first()["text"]
    assert "fine morning" in text and "rain came & went" in text and "Home page" not in text and "©" not in text


@pytest.mark.parametrize("html", ["<", "<p", "</p></p>", "<div><div><div>", "<!-- never closed", "<script>never closed", "a < b > c", "<p class='x", "&#0; &nbsp; &bogus;", "<a><b></a></b>text", "\x00<br/>\x00"])
def test_broken_html(html):
    extract.extract_pages(extract.model(), [html])


def test_hard_rows(spark):
    rows = [(1, PAGE), (1, PAGE), (2, ""), (3, None), (None, PAGE), (4, "only text"), (5, "<p>" + "very long text. " * 50_000 + "</p>"), (6, "<div>" * 20_000 + "deep" + "</div>" * 20_000)]
    df = spark.createDataFrame([(*r, "mine", "mine") for r in rows], "page_id long, html string, id string, text string")
    got = extract.extract(df).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(rows) and by[3]["text"] is None and (by[2]["text"], by[2]["blocks"]) == ("", 0) and by[4]["blocks"] == 1
    assert by[None]["text"] == by[1]["text"] and extract.extract(df.limit(0)).count() == 0
