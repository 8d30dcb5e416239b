"""Alignment of long flat pages."""

import random

import pytest

from rankweave.llm import html_text


@pytest.mark.parametrize("n", [40, 66, 200])
def test_a_notice_at_the_end_of_a_long_page_is_matched(n):
    trees = [html_text.shape(html_text.parse("<body>" + "".join(f"<p>{side}{i} <b>x{side}{i}</b></p>" for i in range(m)) + "<p>the <b>same</b> notice</p></body>")) for side, m in (("a", n), ("b", n + 4))]
    assert "the notice" in [trees[1].texts[j] for j in html_text.constant_nodes(*trees, html_text.match(*trees))]


def test_alignments_weigh_most():
    rnd = random.Random(3)
    for _ in range(300):
        xs, ys = ([rnd.randrange(6) for _ in range(rnd.randrange(0, 9))] for _ in range(2))
        weights = {(i, j): rnd.choice([0.0, 1.0, 1.5, 3.0]) for i in range(6) for j in range(6)}

        def best(i, j):
            return max(best(i - 1, j), best(i, j - 1), best(i - 1, j - 1) + weights[xs[i - 1], ys[j - 1]]) if i and j else 0.0

        got = html_text.align(xs, ys, lambda i, j: weights[i, j])
        assert got == sorted(got, reverse=True) and len({p for p, _ in got}) == len({q for _, q in got}) == len(got)
        assert sum(weights[xs[p], ys[q]] for p, q in got) == best(len(xs), len(ys)) if len(xs) * len(ys) < 30 else True


def slow_match(a, b, i=0, j=0):
    """The weight of simple tree matching by its definition, all nodes kept."""
    if a.tags[i] != b.tags[j]:
        return 0.0
    xs, ys = a.children[i], b.children[j]
    table = [[0.0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for p, x in enumerate(xs):
        for q, y in enumerate(ys):
            table[p + 1][q + 1] = max(table[p][q + 1], table[p + 1][q], table[p][q] + slow_match(a, b, x, y))
    return 1 + 0.5 * (a.texts[i] == b.texts[j] != "") + table[-1][-1]


def test_tree_matching_against_its_definition():
    rnd = random.Random(4)

    def tree(depth):
        return "".join(f"<{t}>{rnd.choice('abc')}{tree(depth - 1) if depth else ''}</{t}>" for t in rnd.choices(["div", "span", "section"], k=rnd.randrange(1, 4)))

    for _ in range(200):
        a, b = (html_text.shape(html_text.parse(f"<body>abc<span>a</span><span>b</span><span>c</span>{tree(2)}</body>")) for _ in range(2))
        pairs = html_text.match(a, b)
        assert all(a.tags[i] == b.tags[j] for i, j in pairs)
        assert sum(1 + 0.5 * (a.texts[i] == b.texts[j] != "") for i, j in pairs) == slow_match(a, b)


def test_names_inside_an_article_that_only_look_like_marks():
    for name in ("share-price", "social-history", "comment-on-policy", "ad-hoc", "notice-board"):
        assert html_text.extract(f"<article><p>a<div class='{name}'>b</div></article>") == "a\n\nb"
    for name in ("share", "share-buttons", "comments-list", "ad-300x250", "newsletterSignup", "x related_posts"):
        assert html_text.extract(f"<article><p>a<div class='{name}'>b</div></article>") == "a"


def test_two_layouts_and_a_menu_without_marks(spark):
    rnd = random.Random(5)

    def words(n):
        return " ".join("".join(rnd.choices("abcdefghij", k=rnd.randrange(2, 7))) for _ in range(n))

    rows, want = [], {}
    for i in range(60):
        parts = [words(30) for _ in range(rnd.randrange(2, 7))]
        menu = "<div>" + "".join(f"<a href='/'>{words(1)}</a>" for _ in range(12)) + "</div>"
        text = "".join(f"<p>{p}</p>" for p in parts)
        want[i] = "\n\n".join(parts)
        page = f"<body>{menu}<div><div>{text}</div></div></body>" if i % 5 < 3 else f"<body><section><section><div>Our best</div>{text}</section><section><section>Bye now</section></section></section></body>"
        rows.append((i, "http://two.example/x", page))
    got = {r.page_id: r for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    served = [i for i in want if got[i].by_wrapper]
    assert len(served) >= 24
    assert all(got[i].text == want[i] for i in served)


def test_most_pages_of_the_table_have_a_wrapper(spark, data):
    rows = html_text.op8_html(spark, data.replace("sf0.01", "sf0.1")).collect()
    assert sum(r.by_wrapper for r in rows) > 0.8 * len(rows)
