import random

import pytest

from nimbostrat.llm.html_text import HOLDS, NESTED, NEXT, blocks_of, extract, main_text, minimum_cut

LONG = "This paragraph has a good many words in it, so that it reads like prose. "


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<html><nav><ul><li><a href='/x'>Menu</a></li></ul></nav><article><h1>Title</h1><p>One  &amp; two\n three.<p>Four &lt;b&gt;</article><footer>&copy; me</footer>", "Title\nOne & two three.\nFour <b>"),
        (f"<body><header><a href=/>Home</a></header><div class='sidebar'><p>{LONG}</p></div><div id=content><p>{LONG}</p><p>{LONG}</p></div><div id='comments'><p>{LONG}</p></div></body>", "\n".join([LONG.strip()] * 2)),
        (f"<article><p>{LONG}</p><form><label>Mail</label><input></form><aside>Related things</aside><p>End.</p></article>", f"{LONG.strip()}\nEnd."),
        (f"<div class='cookie-notice'>{LONG}</div><main><p>{LONG}<br>and more</main><script>var t='<p>no</p>';</script><style>p{{}}</style>", f"{LONG}and more"),
        (f"<article><p>{LONG}<!-- <p>gone</p> --> kept <b>bold</b>er</p><div class='ad'>Buy now</div></article>", f"{LONG}kept bolder"),
        (f"<article><p class='social-history'>{LONG}</p><p class='ad'>Buy</p></article>", LONG.strip()),
        (f"<p>{LONG}unclosed <b", f"{LONG}unclosed <b"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


BLOCK = f"<p>{LONG}</p>"


@pytest.mark.parametrize("name", ["page-with-sidebar", "content no-ads", "comments-open", "layout-sidebar-left", "hasComments", "widget", "sidebar"])
@pytest.mark.parametrize("inner", ["{}", "<div class='text'>{}</div>", "<div><article><h1>Title</h1>{}</article></div>"])
def test_wrappers_are_not_set_apart_by_a_name(name, inner):
    page = "<body><nav><a href=/>Home</a></nav>" + f"<div class='{name}'>{inner.format(BLOCK * 3)}</div><div class=sidebar>{BLOCK}</div><footer>Me</footer>"
    assert main_text(page) == "Title\n" * ("Title" in inner) + "\n".join([LONG.strip()] * 3)


def test_named_parts_are_set_apart():
    article = f"<div id=content>{BLOCK * 2}</div>"
    for name in ("sidebar", "comment-list", "related-posts", "adSlot", "cookie_banner", "newsletter-signup"):
        for page in (f"{article}<div class='{name}'>{BLOCK * 4}</div>", f"<div class='{name}'>{BLOCK}</div>{article}", f"<main>{BLOCK * 2}<div class='x {name}'>{BLOCK}</div></main>"):
            assert main_text(page) == "\n".join([LONG.strip()] * 2), name


def test_the_cut_decides_what_scores_leave_open():
    page = f"<div>{BLOCK}<p>Hi.</p>{BLOCK}</div><div><p>Hi.</p></div>"
    blocks = blocks_of(page)
    assert [b.score > 0 for b in blocks] == [True, False, True, False]
    assert main_text(page).split("\n")[:3] == [LONG.strip(), "Hi.", LONG.strip()]


SENTENCES = [f"Sentence number {k} of this article has enough words to be read as prose by anyone. " for k in ("one", "two", "three", "four")]
PROSE_OF = "".join(f"<p>{x}</p>" for x in SENTENCES)
WHOLE = "\n".join(x.strip() for x in SENTENCES)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><div data-hidden='false'>{PROSE_OF}</div></article>", WHOLE),
        (f"<article><div data-role='form'>{PROSE_OF}</div></article>", WHOLE),
        (f"<article><h1>T</h1><div title='Hidden gems of Rome, id=ad class=ad'>{PROSE_OF}</div></article>", f"T\n{WHOLE}"),
        (f"<article><div hidden>{PROSE_OF}</div><div style='color:red; display : none'>x</div><p>{LONG}</p></article>", LONG.strip()),
        (f"<form id='aspnetForm'><nav><a href=/>Home</a></nav><article>{PROSE_OF}</article></form>", WHOLE),
        (f"<form id='aspnetForm'><nav><a href=/>Home</a></nav><div>{PROSE_OF}</div><footer>Me</footer></form>", WHOLE),
        (f"<details open><summary>More</summary>{PROSE_OF}</details>", WHOLE),
        (f"<div role='form'><fieldset>{PROSE_OF}</fieldset></div>", WHOLE),
        (f"<article>{PROSE_OF}<form><label>Your mail</label><p>Subscribe to our letter and never miss a thing that we write.</p></form></article>", WHOLE),
        (f"<article><p>{LONG}</p><section id='related-work'>{PROSE_OF}</section></article>", f"{LONG.strip()}\n{WHOLE}"),
        (f"<article><p>{LONG}</p><section class='privacy-law'>{PROSE_OF}</section></article>", f"{LONG.strip()}\n{WHOLE}"),
        (f"<article><p>{LONG}</p><div class='meta-analysis'>{PROSE_OF}</div></article>", f"{LONG.strip()}\n{WHOLE}"),
        (f"<article>{PROSE_OF}<div class='related-posts'><p>{LONG}</p></div><div class='share-buttons'>Tell it</div></article>", WHOLE),
        (f"<article>{PROSE_OF}<address>Write to the desk, Long Street 5, Old Town.</address></article>", f"{WHOLE}\nWrite to the desk, Long Street 5, Old Town."),
        ("<body><nav><a href=/>Home</a> <a href=/b>About</a></nav><h1>A title</h1><p>First short one.</p><p>Second short one.</p><footer>Me</footer>", "A title\nFirst short one.\nSecond short one."),
    ],
)
def test_names_and_wrappers(page, text):
    assert main_text(page) == text


def brute_text(page):
    """The labelling of least cost over all labellings of blocks and elements."""
    blocks = blocks_of(page)
    elements = []
    for b in blocks:
        e = b.holder
        while e is not None:
            if e not in elements:
                elements.append(e)
            e = e.parent
    nodes = len(blocks) + len(elements)
    best, chosen = None, None
    for k in range(2**nodes):
        side = [bool(k >> i & 1) for i in range(nodes)]
        of = lambda e: side[len(blocks) + elements.index(e)]  # noqa: E731, B023
        cost = sum(max(b.score, 0) if not s else max(-b.score, 0) for b, s in zip(blocks, side, strict=False))
        cost += sum(NEXT / max(b.depth_change, 1) for i, b in enumerate(blocks) if i and side[i] != side[i - 1])
        cost += sum(HOLDS for b, s in zip(blocks, side, strict=False) if s != of(b.holder))
        cost += sum(NESTED for e in elements if e.parent is not None and of(e) != of(e.parent))
        if best is None or cost < best - 1e-9:
            best, chosen = cost, side
    return "\n".join(b.text for b, s in zip(blocks, chosen, strict=False) if s)


@pytest.mark.parametrize(
    "page",
    [
        f"<div>{BLOCK}<p>Hi.</p>{BLOCK}</div><div><a href=/>Home</a></div>",
        f"<ul><li><a href=/>a</a><li>bb</ul><article><h1>T</h1>{BLOCK}<p>End</article>",
        f"<div class=sidebar><p>{LONG}</p></div><div><p>Short one.</p><p>{LONG}</p></div><footer>x</footer>",
    ],
)
def test_whole_pages_match_all_labellings(page):
    assert main_text(page) == brute_text(page)


def test_deep_nesting_takes_linear_time():
    assert main_text("<div>" * 20_000 + LONG + "</div>" * 20_000 + "</b>" * 20_000) == LONG.strip()


def test_minimum_cut_matches_all_labellings():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 8)
        gain = [rng.uniform(-3, 3) for _ in range(n)]
        edges = {(a, b): rng.uniform(0, 2) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5}

        def cost(side):
            return sum(max(g, 0) if not s else max(-g, 0) for g, s in zip(gain, side, strict=True)) + sum(c for (a, b), c in edges.items() if side[a] != side[b])

        best = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(2**n))
        assert cost(minimum_cut(gain, edges)) == pytest.approx(best)


def test_tables(spark):
    rows = [(1, "u", "<article><p>Hi there, all of you.</p></article>"), (2, None, None), (3, "u", ""), (3, "u", "")]
    out = extract(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in out.collect()) == [(1, "Hi there, all of you.", 21), (2, "", 0), (3, "", 0), (3, "", 0)]
    assert extract(spark.createDataFrame([], "page_id bigint, text string, html string")).count() == 0
    clash = extract(spark.createDataFrame([(1, 7, "x", "<article><p>Hi there, all of you.</p></article>")], "page_id bigint, n_chars int, text string, html string")).first()
    assert (clash["text"], clash["n_chars"]) == ("Hi there, all of you.", 21)
    big = main_text("<article>" + f"<p>{LONG}</p>" * 3000 + "</article><div>" * 50)
    assert big.count("\n") == 2999
