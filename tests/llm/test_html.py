"""Main text: planted pages in many layouts, and markup that would cost too much."""

import random
import time
from collections import Counter

import pytest

from pairloom.llm.html_extraction import main_text, with_main_text

REFERENCES = "".join(f"<li><a href=/{k}>Source {k}</a></li>" for k in range(4))


@pytest.mark.parametrize(
    "page,want",
    [
        ("<p>One, two.</p><!--><p>Three, four.</p>", "One, two. Three, four."),
        ("<p>One, two.</p><!---><p>Three, four.</p><!-- <p>no</p> --!><p>Five.</p>", "One, two. Three, four. Five."),
        (f"<article><p>Text, one.</p><ol>{REFERENCES}</ol></article>", "Text, one. Source 0 Source 1 Source 2 Source 3"),
        ("<div><h1>T</h1><p>First, para.</p></div><div><p>Second, a long one, with commas.</p><p>Third, a long one, with commas.</p></div>", "T First, para. Second, a long one, with commas. Third, a long one, with commas."),
        ('<main><p>One, two.</p><div class="legal-news"><p>Court, news.</p></div><div class="legal">Terms, all.</div></main>', "One, two. Court, news."),
        ('<article><p title="a hidden gem">In, text.</p><p hidden>Out, text.</p><p style="display: none">Out.</p></article>', "In, text."),
        ('<article><p>a, <math><mi>x</mi></math></p><div class="comment-list"><p>No, no.</p></div></article>', "a, x"),
        (f"<div><ul>{REFERENCES}</ul></div><div><p>Body, text.</p></div>", "Body, text."),
    ],
)
def test_what_stays(page, want):
    assert main_text(page) == want


LAYOUTS = [
    "{nav}<article><h1>{t}</h1>{p}</article>{junk}", "{nav}<main><h1>{t}</h1><div class=body>{p}</div></main>{junk}", "<div id=page>{nav}<div id=content><h1>{t}</h1>{p}</div>{junk}</div>",
    "{nav}<div class=post><div><h1>{t}</h1></div><div>{p}</div></div>{junk}", "<div class='wrap has-sidebar'>{nav}<section><h2>{t}</h2>{p}</section>{junk}</div>",
    "<header><h1>Site</h1></header>{nav}<main><article><header><h1>{t}</h1></header>{p}</article>{junk}</main>", "<table><tr><td><h1>{t}</h1>{p}</td></tr></table>{junk}",
]
JUNK = ["<footer>{w}</footer>", "<div class=ad>{w}</div>", "<aside>{w}</aside>", "<section id=comments><article class=comment><p>{w}</p></article></section>", "<div class='cookie-notice'><p>{w}</p></div>", "<form><label>{w}</label><input></form>", "<div class='related-posts'><ul><li><a>{w}</a></ul></div>", "<script>var x = '<p>{w}</p>';</script>", "<div class=sidebar-left><p>{w}</p></div>"]


def planted(rng):
    """A page and the words of its article."""

    def words(n, stem):
        return " ".join(f"{stem}{rng.randrange(1000)}{',' if rng.random() < 0.1 else ''}" for _ in range(n))

    title, paragraphs = words(5, "a"), [words(rng.randint(4, 60), "a") for _ in range(rng.randint(1, 8))]
    body = "".join(f"<p>{p}" if rng.random() < 0.3 else f"<blockquote>{p}</blockquote>" if rng.random() < 0.1 else f"<p>{p}</p>" for p in paragraphs)
    nav = "<nav><ul>" + "".join(f"<li><a href=x>{words(1, 'z')}</a>" for _ in range(5)) + "</ul></nav>"
    junk = "".join(rng.choice(JUNK).replace("{w}", words(rng.randint(3, 40), "z")) for _ in range(4))
    return "<html><body>" + rng.choice(LAYOUTS).format(nav=nav, t=title, p=body, junk=junk) + "</body></html>", f"{title} {' '.join(paragraphs)}".split()


def test_planted_pages():
    rng, found, given, both = random.Random(5), 0, 0, 0
    for _ in range(600):
        page, want = planted(rng)
        got = main_text(page).split()
        found, given, both = found + len(got), given + len(want), both + (Counter(got) & Counter(want)).total()
    print(f"precision {both / found:.4f}, recall {both / given:.4f}")
    assert both == given and both / found > 0.995


@pytest.mark.parametrize("made", [lambda n: "<span>" * n + "<hr>" * n, lambda n: "<span>" * n + "<p>x, y" * n, lambda n: '<a "x>"' * n + "'", lambda n: "<ul><li>" * n, lambda n: "<b>" * n + "</i>" * n + "</b>" * n, lambda n: "<table><tr><td>" * n + "x"])
def test_work_grows_with_the_page(made):
    def took(n):
        page, start = made(n), time.process_time()
        main_text(page)
        return time.process_time() - start

    took(1000)
    assert took(32_000) < 8 * max(took(8_000), 0.05)


def test_tables(spark):
    df = spark.createDataFrame([(1, "<p>x, y</p>", "mine"), (1, "<p>x, y</p>", "mine"), (2, None, None), (3, "<p>" + "word, " * 200_000, "")], "page_id bigint, html string, main_text string")
    out, name = with_main_text(df)
    assert name == "_main_text" and out.columns == [*df.columns, name]
    got = sorted((r["page_id"], len(r[name]), r["main_text"]) for r in out.collect())
    assert got[:2] == [(1, 4, "mine")] * 2 and got[2] == (2, 0, None) and got[3][1] == 1_199_999
    assert with_main_text(df.limit(0))[0].count() == 0
