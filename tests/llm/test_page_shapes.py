"""Page shapes whose names look like boilerplate, and comments as HTML ends them."""

from __future__ import annotations

import time

import pytest

from tallymark.llm.main_text import main_text

P = "<p>One, two, three, four, five.</p><p>Six, seven, eight, nine.</p>"
W = "One, two, three, four, five.\nSix, seven, eight, nine."
NICE = "<p>Nice, very, nice, indeed, this, is.</p>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><div class=site-title>My Site, a tagline</div><div class='content-sidebar-wrap'><article>{P}</article><aside class=sidebar><p>Side, bar.</p></aside></div></body>", W),
        (f"<body><div class='content-sidebar-wrap'><div class=entry>{P}</div><div class=sidebar><p>Side, bar.</p></div></div></body>", W),
        (f"<body><form id=aspnetForm><div class=nav><a href=1>x</a></div><div class=content>{P}</div></form></body>", W),
        (f"<body><form><fieldset>{P}</fieldset></form></body>", W),
        (f"<article><h1>T</h1>{P}<section id=search><h2>Search</h2><p>Found, it.</p></section><section id=related-work><h2>Related work</h2><p>Others, too.</p></section></article>", f"T\n{W}\nSearch\nFound, it.\nRelated work\nOthers, too."),
        (f"<article><h2 id=login>Login</h2>{P}<h2 id=menu>Menu</h2><p>Soup, salad.</p></article>", f"Login\n{W}\nMenu\nSoup, salad."),
        (f"<article><!-->{P}<!-- x --!><p>More, text.</p><!---><p>End.</p></article>", f"{W}\nMore, text.\nEnd."),
        (f"<article>{P}<div class=share-price-history><p>Up, down.</p></div><p class=share-price-history>Flat, now.</p></article>", f"{W}\nUp, down.\nFlat, now."),
        (f"<article>{P}</article><div id=comments>{NICE * 30}</div>", W),
        (f"<div>{P}</div><div id=comments>{NICE * 30}</div>", W),
        (f"<article>{P}</article><div class=sidebar>{NICE * 10}</div>", W),
        (f"<article>{P}<form><p>name, please</p></form><div class=newsletter><p>Join, us.</p></div><div class=related-posts><a href=1>Another, one</a></div></article>", W),
    ],
)
def test_page_shapes(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("page", ["<form>" * 30_000 + "x", "<div class=sidebar>" * 30_000 + "x, y", "<div class=sidebar>x, y" * 20_000])
def test_nested_names_take_linear_time(page):
    began = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - began < 20
