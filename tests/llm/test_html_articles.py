"""Pages made by hand, with the text that the contract asks for: the article, whole, and nothing that is around it.

Lines marked ``|`` are the article's blocks in order; what a page must not give is any other text of it.
"""

import re

import pytest

from tessera.llm import html_text


def words(seed, n=4):
    """A paragraph of n sentences that holds no markup."""
    return " ".join(f"Sentence {seed}{i} says something about the matter at hand, at some length." for i in range(n))


A, B, C, D = (words(x) for x in "abcd")
SHORT = "Short one."
NAV = "<ul><li><a href=/1>Home</a></li><li><a href=/2>News</a></li><li><a href=/3>About us</a></li></ul>"
SIX = [words(x) for x in "uvwxyz"]
P6 = "".join(f"<p>{x}</p>" for x in SIX)
LI = "".join(f"<li>Point number {i} of the list, which is one line long</li>" for i in range(10))
POINTS = [f"Point number {i} of the list, which is one line long" for i in range(10)]

PAGES = {
    "heading and short parts beside the dense one": (f"<div id=content><h1>Head</h1><div class=intro>{SHORT}</div><div><h2>Part</h2><p>Short two.</p></div><div>{P6}</div></div>", ["Head", SHORT, "Part", "Short two.", *SIX]),
    "main of three sections": (f"<main><section><h2>One</h2><p>{A}</p></section><section><h2>Two</h2>{P6}</section><section><h2>Three</h2><p>{SHORT}</p></section></main>", ["One", A, "Two", *SIX, "Three", SHORT]),
    "list between lines": (f"<div><h1>Head</h1><p>A line first.</p><ul>{LI}</ul><p>A last line.</p></div>", ["Head", "A line first.", *POINTS, "A last line."]),
    "quotation between lines": (f"<p>Said he:</p><blockquote>{P6}</blockquote><p>And left.</p>", ["Said he:", *SIX, "And left."]),
    "comments beside main": (f"<main><h1>Head</h1><p>{A}</p></main><ol class=commentlist><li><p>{B}</p><li><p>{C}</p></ol>", ["Head", A]),
    "signup and footer inside an article": (f"<article><h1>Head</h1><p>{A}</p><div class=newsletter-signup>Get our mail.</div><p>{B}</p><div class=entry-footer>Filed under x</div></article>", ["Head", A, B]),
    "quotation in a block, menu before": (f"{NAV}<div><p>Said he:</p><blockquote>{P6}</blockquote><p>And left.</p></div>", ["Said he:", *SIX, "And left."]),
    "menu without names at both ends": (f"{NAV}<div><h1>Head</h1><p>{A}</p><p>{B}</p></div>{NAV}", ["Head", A, B]),
    "menu inside the wrapper": (f"<div><div>{NAV}</div><h1>Head</h1><div><p>{A}</p><p>{B}</p></div></div>", ["Head", A, B]),
    "reader comments longer than the text": (f"<div><h1>Head</h1><p>{A}</p></div><div class=comments>{P6}{P6}</div>", ["Head", A]),
    "comment list inside the content": (f"<div id=content><h1>Head</h1><p>{A}</p><p>{B}</p><ul id=comment-list><li>{C}</li></ul></div>", ["Head", A, B]),
    "comments as articles": (f"<article><h1>Head</h1><p>{A}</p></article><div id=comments><article class=comment><p>{B}</p><p>{C}</p></article></div>", ["Head", A]),
    "comments as articles inside the article": (f"<article><h1>Head</h1><p>{A}</p><article class='comment even'><p>{B}</p></article></article>", ["Head", A]),
    "comments in a section": (f"<main><p>{A}</p><p>{B}</p></main><section class=respond><p>{P6}</p></section>", [A, B]),
    "heading before the named content": (f"<h1>Head</h1><div class=content><p>{A}</p><p>{B}</p></div>", ["Head", A, B]),
    "heading before the article in main": (f"<main><h1>Head</h1><article><p>{A}</p></article></main>", ["Head", A]),
    "sections of which the page names none": (f"<div><h1>Head</h1><p>{A}</p></div><div><h2>Two</h2><p>{B}</p></div><div><h2>Three</h2>{P6}</div>", ["Head", A, "Two", B, "Three", *SIX]),
    "flat body": (f"<h1>Head</h1><p>{A}</p><p>{SHORT}</p><p>{B}</p>", ["Head", A, SHORT, B]),
    "flat body with menu and notice": (f"{NAV}<h1>Head</h1><p>{A}</p><p>{B}</p><div class=cookie-notice>We use cookies.</div>", ["Head", A, B]),
    "table of figures in the text": (f"<div class=post><h1>Head</h1><p>{A}</p><table><tr><td>x</td><td>1</td></tr><tr><td>y</td><td>2</td></tr></table><p>{B}</p></div>", ["Head", A, "x", "1", "y", "2", B]),
    "list of references with links": (f"<div class=article-body><h1>Head</h1>{P6}<h2>References</h2><ol><li><a href=x>First work</a></li><li><a href=y>Second work</a></li></ol></div>", ["Head", *SIX, "References", "First work", "Second work"]),
    "preformatted lines": (f"<div id=main><p>{A}</p><pre>one   two\nthree</pre><p>{B}</p></div>", [A, "one two three", B]),
    "sidebar and share buttons": (f"<div class=container><div class=sidebar><p>{C}</p></div><div class=story><h1>Head</h1><p>{A}</p><div class=share-buttons>Share this</div><p>{B}</p></div></div>", ["Head", A, B]),
    "role of main": (f"<div class=promo>Buy now.</div><div role=main><p>{SHORT}</p><div><p>{A}</p><p>{B}</p></div></div><p>After the end.</p>", [SHORT, A, B]),
    "empty main": (f"<main></main><div><h1>Head</h1><p>{A}</p></div>", ["Head", A]),
    "small article in a sidebar": (f"<div><h1>Head</h1>{P6}</div><div class=sidebar><article><p>{SHORT}</p></article></div>", ["Head", *SIX]),
    "small article outside of any sidebar": (f"<div><h1>Head</h1>{P6}</div><div><article><a href=z>A teaser of another text</a></article></div>", ["Head", *SIX]),
    "article in parts": (f"<article><p>{A}</p></article><article><p>{B}</p></article><article><p>{C}</p></article>", [A, B, C]),
    "definition list": (f"<div><h1>Head</h1><dl><dt>Term<dd>{A}<dt>Other<dd>{B}</dl></div>", ["Head", "Term", A, "Other", B]),
    "line breaks and characters": (f"<div id=text><h1>A &amp; B</h1>{SHORT}<br>caf&eacute;&nbsp;&#8211; &#x2014;<p>{A}</p></div>", ["A & B", SHORT, "café – —", A]),
    "related links after the text": (f"<div class=post><h1>Head</h1><p>{A}</p><p>{B}</p></div><div class=related><h3>More</h3>{NAV}</div>", ["Head", A, B]),
    "related links without a name": (f"<div><h1>Head</h1><p>{A}</p><p>{B}</p></div><div><h3>More</h3>{NAV}</div>", ["Head", A, B]),
    "article header of a div": (f"<div class=post><div class=post-header><h1>Head</h1></div><p>{A}</p><p>{B}</p></div>", ["Head", A, B]),
    "headed by h2 only": (f"<div><h2>Head</h2><p>{A}</p><p>{SHORT}</p></div>{NAV}", ["Head", A, SHORT]),
    "form around the page": (f"<form><div id=content><h1>Head</h1><p>{A}</p><input value=x><button>Go</button></div></form>", ["Head", A]),
    "figure with caption": (f"<main><p>{A}</p><figure><img src=x><figcaption>What it shows.</figcaption></figure><p>{B}</p></main>", [A, "What it shows.", B]),
    "copyright line": (f"<div class=content><p>{A}</p><p>{B}</p></div><div class=copyright>All rights reserved.</div>", [A, B]),
    "advert in the middle": (f"<div class=content><p>{A}</p><div class=ad-slot>Buy.</div><p>{B}</p></div>", [A, B]),
    "nested wrappers": (f"<div><div><div><h1>Head</h1></div><div><div><p>{SHORT}</p></div><div>{P6}</div></div></div></div>", ["Head", SHORT, *SIX]),
    "breadcrumbs and tags": (f"<div class=breadcrumbs><a href=/>Home</a> / <a href=/x>X</a></div><div class=entry-content><p>{A}</p><p>{B}</p></div>", [A, B]),
}


@pytest.mark.parametrize("name", PAGES)
def test_article(name):
    body, blocks = PAGES[name]
    html = f"<!doctype html><html><head><title>t</title><style>p{{}}</style></head><body><header>Site name</header><nav>{NAV}</nav>{body}<footer>Imprint</footer></body></html>"
    assert html_text.extract(html) == "\n".join(blocks)


def test_articles_in_one_line_or_indented():
    """White space between tags means nothing."""
    for body, blocks in PAGES.values():
        if "<pre>" not in body:
            assert html_text.extract(re.sub(r">(?=<(?!/?(?:a|b)\b))", ">\n  ", f"<body>{body}</body>")) == "\n".join(blocks)
