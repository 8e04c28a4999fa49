"""Articles of generated pages, and of pages whose attributes and names mislead."""

from __future__ import annotations

import random

import pytest

from tidewell.llm.extract import hinted, main_text, talked

PROSE = "Prose that goes on, and on, with words; and more. " * 6
LAST = "The hidden costs are real, and large."
SAID = "I think this is great, thanks; really, it is."


@pytest.mark.parametrize(
    "part",
    [
        f'<article data-headline="The hidden costs"><p>{PROSE}<p>{LAST}</article>',
        f'<article><p>{PROSE}<section title="A hidden valley"><p>{PROSE}<p>{LAST}</section></article>',
        f"<article><p>{PROSE}<p hidden-print>{LAST}</article>",
        f'<article><p>{PROSE}<div data-x="see id=comment now"><p>{PROSE}<p>{LAST}</div></article>',
        f"<article><p>{PROSE}<div data-x='class=\"ad\"' class=body><p>{LAST}</div></article>",
        f'<article><p>{PROSE}<figure title="role hidden"><figcaption>{LAST}</figcaption></figure></article>',
        f"<article><p>{PROSE}<p data-hidden=1 x-class=ad aria-hidden=false>{LAST}</article>",
        f'<div class="post has-comments comments-open"><h1>T</h1><p>{PROSE}<p>{LAST}</div>',
        f'<h1>T</h1><div class="thread"><p>{PROSE}<p>{LAST}</div>',
        f"<article><p>{PROSE}<h2 id=how-to-comment>How to comment</h2><p>{LAST}</article>",
        f"<article><p>{PROSE}<p>Copyright law is old. {LAST}</article>",
        f"<article><h1>T</h1><p>{PROSE}<div class=qa><p>Why?<p>{LAST}</div><div class=qa><p>How?<p>{LAST}</div></article>",
    ],
)
def test_kept(part):
    assert LAST in main_text(f"<body><nav>Menu</nav>{part}<footer>Foot</footer></body>") and "Menu" not in main_text(part)


TALK = f"<div><b>Ann</b><p>{SAID}{PROSE}</div><div><b>Bob</b><p>{SAID}{PROSE}</div>"


@pytest.mark.parametrize(
    ("page", "gone"),
    [
        *[(f"<main><article><h1>T</h1><p>{LAST}<p>{PROSE}<div class={name}>{TALK}</div></article></main>", "great") for name in ("reader-comments", "user-feedback", "thread", "comments")],
        *[(f"<body><div><h1>T</h1><p>{LAST}<p>{PROSE}</div><div id={name}>{TALK}</div></body>", "great") for name in ("readerComments", "user-feedback", "thread", "comments")],
        (f"<article><h1>T</h1><div class=cookie-notice><p>We use cookies, and more things, to make this better.</div><p>{PROSE}<p>{LAST}</article>", "cookies"),
        (f"<main><article><h1>T</h1><p>{LAST}<p>{PROSE}<p>{PROSE}" + "<article class=card><h3><a href=x>Other story</a></h3><p>Short teaser, here.</article>" * 2 + "</article></main>", "teaser"),
        (f"<article><ul><li><a href=a>Home</a><li><a href=b>About</a></ul><h1>T</h1><p>{PROSE}<p>{LAST}</article>", "Home"),
        (f"<article><h1>T</h1><p>{LAST}<p>{PROSE}<p>&copy; 2024 Some Company. All rights reserved.</article>", "rights"),
        (f"<div><div class=col8><h1>T</h1><p>{LAST}<p>{PROSE}<p>{PROSE}</div><div class=col4><h3>Weather</h3><p>Rain, wind, and more rain; cold.</div></div>", "Rain"),
    ],
)
def test_gone(page, gone):
    text = main_text(page)
    assert gone not in text and LAST in text and text.startswith("T")


def test_names():
    assert hinted("ad") == hinted("comment-list") == hinted("cookie-banner") == 2 and hinted("top-menu") == 1 and hinted("comment-guide") == hinted("menu-planning") == 0
    assert talked("reader-comments") and talked("x userFeedback") and not talked("comments-open") and not talked("feedback-theory")


@pytest.mark.parametrize("seed", range(60))
def test_generated(seed):
    """Pages of several layouts around known blocks."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwyz") for _ in range(rng.randrange(2, 9)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + rng.choice([".", ", " + word() + "."])
    blocks, inner = [sentence(4).rstrip(".")], []
    inner.append(f"<h1>{blocks[0]}</h1>")
    for _ in range(rng.randrange(4, 12)):
        text = " ".join(sentence(rng.randrange(8, 16)) for _ in range(rng.randrange(3, 7)))
        blocks.append(text)
        inner.append(f"<p>{text.replace(' ', rng.choice([' ', '  ', chr(10)]), 3)}</p>")
        if rng.random() < 0.3:
            blocks.append(sentence(3).rstrip("."))
            inner.append(f"<h2>{blocks[-1]}</h2>")
            blocks.append(sentence(30))
            inner.append(f"<p>{blocks[-1]}</p>")
    body = "".join(inner)
    links = lambda n: "".join(f"<li><a href=/{word()}>{word()}</a></li>" for _ in range(n))
    around = {
        "menu": f"<nav><ul>{links(6)}</ul></nav>",
        "list": f"<div class=top><ul>{links(8)}</ul></div>",
        "cookie": f"<div class=cookie-banner><p>{sentence(20)}</p></div>",
        "ad": f"<div class=ad-box><p>{sentence(15)}</p></div>",
    }
    behind = {
        "comments": f"<section class={rng.choice(['comments', 'reader-comments', 'user-feedback'])}>" + "".join(f"<div><b>{word()}</b><p>{sentence(20)}</p></div>" for _ in range(3)) + "</section>",
        "related": f"<div class=related-links><ul>{links(5)}</ul></div>",
        "foot": f"<footer><p>{sentence(12)}</p></footer>",
    }
    before = "".join(rng.sample(list(around.values()), rng.randrange(4)))
    after = "".join(rng.sample(list(behind.values()), rng.randrange(4)))
    shape = rng.choice(["<article>{}</article>", "<main>{}</main>", "<div class=post>{}</div>", "<main><article>{}</article></main>", "<div><div id=content>{}</div></div>"])
    assert main_text(f"<html><head><title>x</title></head><body>{before}{shape.format(body)}{after}</body></html>") == "\n".join(blocks)
