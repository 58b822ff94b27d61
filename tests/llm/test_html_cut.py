"""The cut decides where the classifier alone would be wrong, and the classifier is fitted."""

from lorebank.llm import html_text


def blocks(source):
    found, keep = html_text.labelled_blocks(source)
    return [(b.text, b.score > 0, k) for b, k in zip(found, keep, strict=True)]


STORY = "<p>The first paragraph of the text has a number of words in it.</p>{}<p>And here the text goes on for a while, with more words.</p>"


def test_neighbours_outvote_a_doubtful_name_and_a_poor_block():
    page = "<body><div id='x'>" + STORY.format("<p class='legal'>The legal question</p>") + "</div></body>"
    assert [x for x in blocks(page) if x[1] != x[2]] == [("The legal question", False, True)]
    page = "<body><div id='x'>" + STORY.format("<p>+</p>") + "</div></body>"
    assert [x for x in blocks(page) if x[1] != x[2]] == [("+", False, True)]
    page = "<article>" + STORY.format("<div class='related-work'><p>Earlier work on this is rare.</p></div>") + "<p>All rights reserved.</p></article>"
    assert [k for _, _, k in blocks(page)] == [True] * 4 and not blocks(page)[-1][1]


def test_a_page_without_telling_names():
    page = "<body><div><a href='/'>Home</a> <a href='/b'>Blog</a></div><div><p>Some real text of the page, with several words in it.</p><p>And more of it.</p></div><div>All rights reserved.</div><div>&copy; 2024 The Site</div></body>"
    assert html_text.main_text(page) == "Some real text of the page, with several words in it.\nAnd more of it."


def test_boilerplate_stays_out_of_reach_of_its_neighbours():
    page = "<article>" + STORY.format("<div class='ad'><p>Buy this wonderful thing now. It is the best thing that you can buy.</p></div><section class='comments'><p>I liked this article a lot.</p></section>") + "</article>"
    assert [t for t, _, k in blocks(page) if not k] == ["Buy this wonderful thing now. It is the best thing that you can buy.", "I liked this article a lot."]


def test_weights_are_fitted_on_pages_that_label_themselves():
    page = "<nav><p>One two three four five six seven eight.</p><p>Nine ten eleven twelve, and so on.</p></nav><article><h1>Go</h1><p>x y</p></article>"
    found = html_text.fit_weights([page] * 20)
    at = html_text.TEXT_FEATURES.index("words")
    assert found != html_text.TEXT_WEIGHTS and found[at] < html_text.TEXT_WEIGHTS[at]
    assert html_text.fit_weights([]) == html_text.fit_weights(["<p>no labels</p>"]) == html_text.TEXT_WEIGHTS
    assert html_text.fit_weights([page]) == html_text.fit_weights([page] * 7)


def test_the_sample_is_bounded_and_distinct(spark, monkeypatch):
    monkeypatch.setattr(html_text, "SAMPLE_PAGES", 5)
    rows = [(k, f"<p>{k % 30}</p>") for k in range(90)] + [(99, "x" * 70_000), (98, None), (97, "")]
    pages = spark.createDataFrame(rows, "page_id long, html string").repartition(5)
    found = html_text.training_sample(pages)
    assert len(found) == len(set(found)) == 5 and found == html_text.training_sample(pages.repartition(2))
