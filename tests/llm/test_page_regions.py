"""Page extraction: the best region against all regions, wrappers whose names sound like boxes, layouts written by hand."""

import random

import pytest

from memlake.llm import extraction

P = [f"Paragraph {k} of this piece has a good number of words in it, as the text of a page that someone wrote would have, and it ends in {k}." for k in range(5)]
BODY = "".join(f"<p>{p}</p>" for p in P)
TITLE = "On the making of things"
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/b">All our posts</a></li></ul></nav>'
FOOT = "<footer><p>Copyright of the owners, all rights reserved.</p></footer>"
WANT = "\n".join([TITLE, *P])
STATES = ["has-sidebar", "no-sidebar", "single comments-open", "search-enabled", "menu-closed", "ad-free", "social-share-on", "widget-page", "navbar-fixed", "popup-enabled", "notice-board", "page"]


@pytest.fixture(scope="module")
def model():
    return extraction.train_pages()


@pytest.mark.parametrize("name", STATES)
def test_what_encloses_the_content_says_nothing_against_it(model, name):
    inner = f"<h1>{TITLE}</h1>{BODY}"
    for page in (
        f'<body class="{name}">{NAV}<article>{inner}</article>{FOOT}</body>', f'<body id="{name}">{NAV}<div class="content">{inner}</div>{FOOT}</body>', f'<body>{NAV}<main class="{name}">{inner}</main>{FOOT}</body>',
        f'<body>{NAV}<main><article class="post {name}">{inner}</article></main>{FOOT}</body>', f'<body>{NAV}<article class="post {name}">{inner}</article>{FOOT}</body>',
        f'<body><div id="{name}" class="{name}">{NAV}<div class="content">{inner}</div>{FOOT}</div></body>', f'<body><form id="{name}">{NAV}<div class="content">{inner}</div>{FOOT}</form></body>',
    ):
        assert model.extract(f"<html>{page}</html>") == WANT


def test_ids_of_headings_and_paragraphs_are_anchors(model):
    for extra in ("<h2 id='login'>Logging in</h2>", "<h2 id='search-tips'>Tips</h2>", "<p id='share'>A share of it is yours.</p>"):
        got = model.extract(f"<body>{NAV}<article><h1>{TITLE}</h1>{BODY}{extra}<p>{P[0]}</p></article>{FOOT}</body>")
        assert got == "\n".join([WANT, extra.split(">")[1].split("<")[0], P[0]])


COMMENTS = '<section id="comments" class="comments-area"><h2>3 replies</h2>' + "".join(f'<article class="comment"><p>I think that number {k} is quite right about all of this, thank you.</p></article>' for k in range(3)) + "</section>"
LAYOUTS = {
    "blog with widgets": f'<body class="home blog logged-in"><div id="page" class="site"><header id="masthead" class="site-header"><a href="/">The site</a></header>{NAV}<div id="primary" class="content-area"><main id="main"><article id="post-1" class="post type-post"><header class="entry-header"><h1 class="entry-title">{TITLE}</h1></header><div class="entry-content">{BODY}</div></article>{COMMENTS}</main></div><aside id="secondary" class="widget-area"><section class="widget"><h2>Recent</h2><ul><li><a href="/1">One</a></li></ul></section></aside>{FOOT}</div></body>',
    "news with a side column": f'<body class="with-sidebar"><div class="navbar">Menu <a href="/a">A</a></div><div class="row"><div class="story"><h1>{TITLE}</h1>{BODY}<div class="share">Share this on all networks</div></div><div class="sidebar"><h3>Most read</h3><ol><li><a href="/1">First thing</a></li><li><a href="/2">Second thing</a></li></ol></div></div>{FOOT}</body>',
    "notice on top": f'<body><div class="cookie-notice" role="dialog">We use cookies on this site to make it better for you. <button>Fine</button></div>{NAV}<article><h1>{TITLE}</h1>{BODY}</article>{FOOT}</body>',
    "advert inside": f'<body>{NAV}<article><h1>{TITLE}</h1><p>{P[0]}</p><p>{P[1]}</p><div class="advert"><p>Buy two of them today and pay for one of them only</p></div>' + "".join(f"<p>{p}</p>" for p in P[2:]) + f"</article>{FOOT}</body>",
    "old tables": f'<body><table><tr><td><ul class="menu"><li><a href="/">Home</a></li></ul></td><td><h1>{TITLE}</h1>{BODY}</td></tr></table>{FOOT}</body>',
    "one form around all": f'<body><form id="aspnetForm">{NAV}<div class="content"><h1>{TITLE}</h1>{BODY}</div>{FOOT}</form></body>',
    "newsletter in the midst": f'<body>{NAV}<main class="no-menu"><h1>{TITLE}</h1><p>{P[0]}</p><form class="newsletter"><p>Give us your address and get all news each week</p></form>' + "".join(f"<p>{p}</p>" for p in P[1:]) + f"</main>{COMMENTS}{FOOT}</body>",
    "hidden paragraphs": f'<body>{NAV}<article class="has-related"><h1>{TITLE}</h1>{BODY}<p style="display:none">Not to be seen by anyone at all</p></article><div class="related"><article><h3>Another piece</h3></article><article><h3>One more of them</h3></article></div>{FOOT}</body>',
    "bare": f"<h1>{TITLE}</h1>{BODY}",
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layouts_written_by_hand(model, name):
    assert model.extract(f"<html>{LAYOUTS[name]}</html>") == WANT


def test_the_scan_finds_the_best_of_all_regions(model):
    r = random.Random(3)
    for trial in range(400):
        scored = [(r.choice((-1, 1)) * r.random() * r.randint(1, 9), -0.1 * r.randint(0, 6), 1.0) for _ in range(r.randint(0, 14))]
        if trial < 100:  # of pages
            page = extraction.labelled_pages(1, trial)[0][0]
            scored = model.scores(extraction.settle(list(extraction.stream(page))))[:40]
        low, high = extraction.best_region(scored)
        worth = lambda a, b: sum(s[0] for s in scored[a:b]) + sum(s[1] for s in scored[a + 1 : b])
        best = max([worth(a, b) for a in range(len(scored)) for b in range(a + 1, len(scored) + 1)], default=0)
        assert worth(low, high) == pytest.approx(max(best, 0))


def test_unseen_made_pages(model):
    pages = extraction.labelled_pages(200, 99)
    assert sum(model.extract(page) == "\n".join(blocks) for page, blocks in pages) >= 0.98 * len(pages)
