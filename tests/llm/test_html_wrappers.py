"""Pages whose wrappers are named like what is no article, and links inside an article."""

import pytest

from skyweave.llm.html_text import main_text

FIRST = "First paragraph, with some commas, that is long enough to count, really."
SECOND = "Second paragraph, with some more commas, which is long enough, too."
BODY = f"<p>{FIRST}</p><p>{SECOND}</p>"
SIDE = "<div class=sidebar><p>Sidebar words, many of them, not to keep, at all.</p></div>"


@pytest.mark.parametrize("wrapper", ["div class='site has-sidebar'", "div class=with-sidebar", "div class=no-sidebar", "div class=nav-fixed", "div id=search-results", "div class=search", "form id=aspnetForm"])
@pytest.mark.parametrize("body", [f"<article>{BODY}</article>", f"<div class=content>{BODY}</div>"])
def test_wrappers(wrapper, body):
    page = f"<html><body><{wrapper}>{body}{SIDE}</{wrapper.split()[0]}></body></html>"
    assert main_text(page) == f"{FIRST} {SECOND}"


def test_comments_and_forms_still_go():
    comments = "<div id=comments>" + "<article><p>I think, as a reader, that this is nonsense, honestly, all of it.</p></article>" * 5 + "</div>"
    assert main_text(f"<body><article>{BODY}<form><p>Sign up here, please, for our letter, now and then.</p></form></article>{comments}") == f"{FIRST} {SECOND}"
    assert main_text(f"<body><div>{BODY}</div><div class=site-nav><p>Menu words, many of them, not to keep, at all.</p></div>") == f"{FIRST} {SECOND}"


def test_inline_words_stay():
    assert main_text("<article><p>A word <span class=search-highlight>found</span> here, with <span class=tags>some</span> more text.</p></article>") == "A word found here, with some more text."


def test_links_inside_the_article_stay():
    one, two = "<p><a href=x>The whole report as a file</a></p>", "<ol><li><a href=a>Reference one, of a book</a></li><li><a href=b>Reference two, of a paper</a></li></ol>"
    page = f"<body><article>{BODY}{one}<p>Closing words, which are not links.</p><h2>References</h2>{two}</article>"
    assert main_text(page) == f"{FIRST} {SECOND} The whole report as a file Closing words, which are not links. References Reference one, of a book Reference two, of a paper"


def test_every_article_and_section_stays():
    short = "A shorter text, which stands beside it, and has to stay."
    for tag in ("article", "section"):
        assert main_text(f"<body><div><{tag}>{BODY * 4}</{tag}><{tag}><p>{short}</p></{tag}></div></body>") == f"{' '.join([FIRST, SECOND] * 4)} {short}"
    teaser = "<article><a href=x>Another story of this site, told at some length</a></article>"
    assert main_text(f"<body><article>{BODY}</article>{teaser}</body>") == f"{FIRST} {SECOND}"


def test_formulas_stay_and_unclosed_scripts_go():
    formula = "<math><mi>x</mi><mo>+</mo><mn>1</mn><annotation>x+1</annotation></math>"
    assert main_text(f"<article><p>{FIRST} Here {formula} is a sum.</p></article>") == f"{FIRST} Here x+1 is a sum."
    assert main_text(f"<article>{BODY}</article><script>var a = 'words, that are code, and no text at all, really';") == f"{FIRST} {SECOND}"
    assert main_text(f"<article><svg>{BODY}</article>") == f"{FIRST} {SECOND}"


def test_deep_pages():
    deep = main_text("<div>" * 20_000 + BODY + "</section>" * 20_000)
    assert deep == f"{FIRST} {SECOND}"
    many = main_text("<body>" + "<div><svg>" * 5_000 + BODY * 2_000)
    assert many == " ".join([FIRST, SECOND] * 2_000)
