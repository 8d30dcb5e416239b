"""What an article holds stays whole: constant headings, named containers, listings, words in buttons and labels."""

import random

import pytest

from rankweave.llm import html_text


def words(rnd, n):
    return " ".join(rnd.choice("abcdefghij") * rnd.randrange(2, 7) for _ in range(n))


def texts_of(spark, page, n=20):
    rows = [(i, f"http://r.example/{i}", page(i)) for i in range(n)]
    return {r.page_id: (r.text, r.by_wrapper) for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}


def test_constant_headings_of_articles_stay(spark):
    """Headings alike on all pages of a host, at the start of the article too; a constant line at its end is template."""
    rnd = random.Random(2)
    parts = {i: [words(rnd, 15), words(rnd, 25)] for i in range(20)}

    def page(i):
        one, two = parts[i]
        return f"<body><div>Our kitchen</div><article><h2>Ingredients</h2><p>{one}</p><h2>Method</h2><p>{two}</p><p>More on our pages</p></article><div>All rights</div></body>"

    got = texts_of(spark, page)
    assert all(got[i] == (f"Ingredients\n\n{one}\n\nMethod\n\n{two}", True) for i, (one, two) in parts.items())


def test_constant_blocks_between_varying_ones_stay_without_an_article(spark):
    rnd = random.Random(3)
    parts = {i: [words(rnd, 15), words(rnd, 25)] for i in range(20)}
    got = texts_of(spark, lambda i: "<body><div>Welcome</div><div><p>Read on</p><p>{}</p><p>Then:</p><p>Note: <b>{}</b></p><p>Go back</p></div></body>".format(*parts[i]))
    assert all(got[i][0] == f"{one}\n\nThen:\n\nNote: {two}" for i, (one, two) in parts.items())


@pytest.mark.parametrize(
    "opened",
    ['<div class="content-sidebar-wrap"><main>', '<div id="sidebar-content"><section class="widget-area"><main role="main">', '<form id="login"><div class="main banner"><main>', '<div role="dialog"><main>'],
)
def test_what_holds_the_main_element_is_not_beside_it(opened):
    page = f'<body><nav>Menu</nav>{opened}<article><p>One two</p></article></main></div><div class="sidebar"><p>Beside</p></div></body>'
    assert html_text.extract(page) == "One two"
    assert html_text.extract(page.replace("<main", "<div").replace("</main", "</div").replace("One two", "One two " * 20)) == ("One two " * 20).strip()


def test_cards_beside_the_text_are_not_the_main_text():
    page = '<body><div class="text"><p>{}</p></div><div class="related"><article>Card one</article><article>Card two</article></div></body>'
    assert html_text.extract(page.format("long " * 30)) == ("long " * 30).strip()


def test_listings_keep_their_comments():
    page = '<article><p>See:</p><pre><code>x = 1 <span class="token comment"># the notice</span>\ny = <span class="nav">2</span></code></pre><div class="comments">R</div></article>'
    assert html_text.extract(page) == "See:\n\nx = 1 # the notice y = 2"


def test_words_of_sentences_stay():
    page = '<article><h2>The <span class="promo">great</span> one</h2><p>Press <button>Save</button>, the <label>name</label>, <i role="note">or so</i> <span class="notice">then</span> go <b hidden>x</b>.</p><p><button>Share</button></p><p><span class="ad">Buy</span></p><button>Like</button></article>'
    assert html_text.extract(page) == "The great one\n\nPress Save, the name, or so then go ."


def test_a_very_long_page(spark):
    """All of 200,000 paragraphs."""
    page = "<body><article>" + "".join(f"<p>word{i} and <b>more</b>" for i in range(200_000)) + "</article></body>"
    text = html_text.extract(page)
    assert text == "\n\n".join(f"word{i} and more" for i in range(200_000))


def test_trees_of_patterns_are_bounded_by_their_characters(monkeypatch):
    monkeypatch.setattr(html_text, "BROADCAST_BYTES", 1000)
    held = html_text.Patterns()
    for i in range(50):
        assert held(f"<p>{i}{'x' * 95}").texts[1].startswith(str(i))
    assert held.chars <= 1000 and len(held.held) == 10 and held.chars == sum(map(len, held.held))
