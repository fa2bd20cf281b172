"""Main text of generated pages whose article is known, and of pages that once went wrong."""

import html as escaping
import random

import pytest

from tidemark.llm.html_main import extract_main_text

WORDS = "river stone garden winter market engine letter morning island copper valley teacher window harbour silver bridge".split()


def sentence(rng, n):
    words = [rng.choice(WORDS) + ("," if rng.random() < 0.15 else "") for _ in range(n)]
    return " ".join(words).strip(",").capitalize() + "."


def prose(rng, paragraphs):
    return [" ".join(sentence(rng, rng.randint(8, 16)) for _ in range(rng.randint(2, 4))) for _ in range(paragraphs)]


P = "<p>{}</p>".format


@pytest.mark.parametrize("name", ["sidebar-wrapper", "page-footer", "layout-sidebar", "footer-container", "newsletter", "ad-box", "cookie-notice page"])
def test_named_parts_go_whatever_their_size(name):
    rng = random.Random(name)
    article, other = prose(rng, 3), prose(rng, 8 if name in ("newsletter", "ad-box") else 2)
    page = f"<body><article>{''.join(map(P, article))}</article><div class='{name}'>{''.join(map(P, other))}</div></body>"
    assert extract_main_text(page) == "\n".join(article)
    inside = f"<body><div class='post-content'>{P(article[0])}<div class='{name}'>{''.join(map(P, other))}</div>{P(article[1])}{P(article[2])}</div></body>"
    assert extract_main_text(inside) == "\n".join(article)


@pytest.mark.parametrize("name", ["has-sidebar", "layout-sidebar-left", "share-enabled", "no-ads"])
def test_names_of_layout_keep_the_article_within(name):
    article = prose(random.Random(1), 4)
    body = "".join(map(P, article))
    for inner in (body, f"<article>{body}</article>", f"<div class='entry-content'>{body}</div>"):
        assert extract_main_text(f"<body><div class='{name}'>{inner}</div><footer>All rights reserved by the owner.</footer></body>") == "\n".join(article)


def test_lists_of_links_in_the_article_stay():
    rng = random.Random(2)
    article = prose(rng, 3)
    links = [f"Source number {i} of the report" for i in range(4)]
    items = "".join(f"<li><a href='/{i}'>{x}</a></li>" for i, x in enumerate(links))
    body = "".join(map(P, article))
    assert extract_main_text(f"<body><article>{body}<ul>{items}</ul></article></body>") == "\n".join(article + links)
    assert extract_main_text(f"<body><div class='x'>{body}<ul>{items}</ul></div></body>") == "\n".join(article + links)
    # a list before all prose of a container that nothing calls an article is a menu
    assert extract_main_text(f"<body><div class='x'><ul>{items}</ul>{body}</div></body>") == "\n".join(article)


CHROME = [
    lambda rng: "<nav><ul>" + "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in rng.sample(WORDS, 5)) + "</ul></nav>",
    lambda rng: f"<header class='site-header'><a href='/'>{sentence(rng, 3)}</a></header>",
    lambda rng: f"<footer><p>{sentence(rng, 10)}</p></footer>",
    lambda rng: f"<div class='sidebar-wrapper'><h3>{sentence(rng, 3)}</h3>{''.join(map(P, prose(rng, rng.randint(1, 3))))}</div>",
    lambda rng: f"<aside>{''.join(map(P, prose(rng, 1)))}</aside>",
    lambda rng: f"<div id='cookie-banner'><p>{sentence(rng, 14)}</p><button>Accept</button></div>",
    lambda rng: f"<div class='advert top'>{''.join(map(P, prose(rng, rng.randint(1, 9))))}</div>",
    lambda rng: f"<section class='comments'><h2>Comments</h2>{''.join(map(P, prose(rng, rng.randint(1, 6))))}</section>",
    lambda rng: f"<form><label>{sentence(rng, 3)}</label><input name='q'><button>Send</button></form>",
    lambda rng: f"<script>var x = '<p>{sentence(rng, 12)}</p>';</script><style>p {{ color: red }}</style><!-- {sentence(rng, 9)} -->",
    lambda rng: f"<div class='newsletter-signup'><p>{sentence(rng, 20)}</p></div>",
]


def _block(rng):
    """(markup, text) of one block of an article."""
    kind = rng.randrange(6)
    text = " ".join(sentence(rng, rng.randint(8, 16)) for _ in range(rng.randint(1, 3)))
    if kind == 0:
        shown = text + " & <b> é"
        return P(escaping.escape(shown).replace(" ", "\n  ", 3)), shown
    if kind == 1:
        return f"<h2>{text[:30].strip()}</h2>", text[:30].strip()
    if kind == 2:
        first, _, rest = text.partition(" ")
        return f"<p><em>{first}</em> <a href='#x'>{rest.split(' ')[0]}</a> {' '.join(rest.split(' ')[1:])}", text
    if kind == 3:
        return f"<blockquote><p>{text}</p></blockquote>", text
    if kind == 4:
        return f"<ul><li>{text}</li></ul>", text
    return P(text), text


@pytest.mark.parametrize("seed", range(60))
def test_generated_pages(seed):
    rng = random.Random(seed)
    title, blocks = sentence(rng, 5), [_block(rng) for _ in range(rng.randint(4, 14))]
    body = f"<h1>{title}</h1>" + "".join(m for m, _ in blocks)
    article = rng.choice(["<article>{}</article>", "<main><article class='post'>{}</article></main>", "<div class='entry-content'>{}</div>", "<main>{}</main>", "<div class='has-sidebar'><article>{}</article></div>"]).replace("{}", body)
    around = rng.sample(CHROME, rng.randint(2, len(CHROME)))
    cut = rng.randint(0, len(around))
    page = "<html><head><title>T</title></head><body>" + "".join(c(rng) for c in around[:cut]) + article + "".join(c(rng) for c in around[cut:]) + "</body></html>"
    assert extract_main_text(page) == "\n".join([title] + [t for _, t in blocks]), page
