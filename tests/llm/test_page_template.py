"""Template words, and article text that looks like the site's."""

from fleetscope.llm import html_text


def test_words_of_the_template_are_no_text(spark):
    page = "<html><body><div>Home Shop About</div>{}<div>All rights <b>reserved</b> by us</div></body></html>"
    bodies = [f"<article><p>story {w} begins</p><div>Read our other stories today</div><p>and {w} ends</p></article>" for w in ("one", "two", "three")]
    bodies += ["<div><p>plain four</p></div>", "<div><p>plain five</p></div>"]
    rows = [(k, f"http://h.org/{k}", page.format(b)) for k, b in enumerate(bodies)] + [(9, "http://alone.org/", page.format(bodies[3]))]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {
        0: "story one begins\nand one ends", 1: "story two begins\nand two ends", 2: "story three begins\nand three ends", 3: "plain four", 4: "plain five",
        9: "Home Shop About\nplain four\nAll rights reserved by us",
    }


def test_equal_pages_are_one_page(spark):
    rows = [(k, f"http://h.org/{k}", "<p>the only story") for k in range(5)]
    assert {r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"the only story"}


def test_article_text_with_names_like_the_site_stays():
    article = "<article><h2 id='search-methods'>Search</h2><section id='social-history'>history</section><p class='notice'>notice</p><div class='ad-hoc'>ad hoc</div><div class='share-buttons'>no</div></article>"
    assert html_text.main_text(article) == "Search\nhistory\nnotice\nad hoc"


def test_a_teaser_is_not_the_region():
    body = "this body has many more words than the teaser card which stands next to it"
    assert html_text.main_text(f"<main><p>{body}</p><article>teaser</article></main>") == f"{body}\nteaser"
    assert html_text.main_text(f"<div><p>{body}</p></div><article>teaser</article>") == f"{body}\nteaser"
    assert html_text.main_text(f"<div>short</div><article><p>{body}</p></article>") == body
