"""Marked pages: what the minimum cut keeps, and what it changes against the costs alone."""

import os

import pytest

from talkloom.llm import html_extraction as hx

A = "The river had risen overnight, and by noon the lower road was under water."
B = "Nobody could say how long the repairs would take, since the old plans were lost in the move to the new building."
C = "In the end the council voted for a second bridge. It will be paid for over thirty years."
D = "A short note."
E = "Measure the flour, sift it twice, and leave it to rest."
NAV = "<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li></ul>"


def marked():
    """(html, the lines that are its content), 64 pages: sixteen layouts in four dresses."""
    for k in range(4):
        pick = lambda *of, k=k: of[k % len(of)]
        nav = pick(f"<nav>{NAV}</nav>", f"<div class=navbar>{NAV}</div>", f'<div id="menu">{NAV}</div>', f'<header><p>The Daily</p></header><nav class="g7">{NAV}</nav>')
        foot = pick("<footer><p>&copy; 2024 The Daily, all rights reserved</p></footer>", '<div class="footer">&copy; The Daily <a href=/i>Imprint</a></div>', "<footer><a href=/i>Imprint</a> <a href=/p>Privacy</a></footer>", '<div id="footer"><p>The Daily</p><p><a href=/i>Imprint</a></p></div>')
        box = pick("<article>{}</article>", "<main>{}</main>", '<div class="post">{}</div>', '<div class="article-body">{}</div>')
        story = f"<h1>The flood</h1><p>{A}</p><p>{B}</p><p>{C}</p>"
        lines = ["The flood", A, B, C]
        odd = pick("zq-thread", "k12", "u-list", "fb_wrap")
        said = pick("<p>Bob: great post, thanks!</p>", "<b>Ann says:</b><p>I agree with you, this is great!</p>", "<p>@carl you are wrong!!</p>", "<p>Dan: I like it. Thanks!</p><div><a href=#>reply</a></div>")
        page = lambda inside, before="", after="", nav=nav, foot=foot: f"<html><body>{nav}{before}{inside}{after}{foot}</body></html>"
        yield page(box.format(story)), lines
        yield page(box.format(story + f'<div class="{odd}">{said}</div>')), lines  # comments under a name that says nothing
        yield page(box.format(story), after=f'<section class="{odd}"><div class=c>{said}</div><div class=c>{said}</div><div class=c>{said}</div></section>'), lines
        yield page(box.format(f"<h1>The flood</h1><p>{A}</p><ul class='menu-items'><li>{E}</li><li>{D}</li></ul><p>{B}</p>")), ["The flood", A, E, D, B]
        yield page(box.format(f"<h1>The flood</h1><p>{D}</p><p>{A}</p><div class='{pick('ad', 'advert', 'sponsored', 'promo')}'>{E} Buy now.</div><p>{B}</p>")), ["The flood", D, A, B]
        yield page(box.format(story + f"<div class='{pick('share', 'social', 'related', 'teaser')}'>{NAV}</div>")), lines
        yield page(box.format(f"<h1>The flood</h1><div class='{odd}'><p>{A}</p><p>{B}</p></div><h2>After it</h2><p>{C}</p>")), ["The flood", A, B, "After it", C]
        yield page(box.format(f"<h1>The flood</h1><p>{A}</p><blockquote><p>{D}</p></blockquote><p>{B}</p><p>{D}</p>")), ["The flood", A, D, B, D]
        yield page(box.format(story), before=f"<div class='{pick('cookie-notice', 'consent', 'newsletter', 'banner')}'><p>We use cookies to make this site better for you.</p><button>Fine</button></div>"), lines
        yield page(box.format(story), after=f"<aside><h4>Most read</h4><p>{E}</p></aside>"), lines
        yield page(box.format(story), after=f"<div class='sidebar'><p>{E}</p>{NAV}</div>"), lines
        yield page(f"<div class='{odd}'>{story}</div>"), lines  # no name tells
        yield page(f"<div>{story}</div>"), lines
        yield page(box.format(f"<form><label>Search</label><input><button>Go</button></form>{story}")), lines
        yield page(f"<table><tr><td class='{odd}'>{NAV}</td><td class='content'>{story}</td></tr></table>"), lines
        yield page(box.format(f"<header><h1>The flood</h1></header><p>{A}</p><ol><li>{E}</li><li>{B}</li></ol><p>{C}</p>") + "<p hidden>never seen</p>"), ["The flood", A, E, B, C]


def scores(labelled):
    hit = sum(on and right for on, right in labelled)
    kept, wanted = sum(on for on, _ in labelled), sum(right for _, right in labelled)
    return 2 * hit / max(1, kept + wanted)


def test_marked_pages():
    """F1 over the blocks of the marked pages; the labels that the cut changes are what makes it."""
    weights, cut, alone, exact = hx.default_weights(), [], [], 0
    pages = [*marked()]
    assert len(pages) >= 50
    for html, lines in pages:
        page, left = hx.Page(html), list(lines)
        rights = []
        for b in page.blocks:
            rights.append(bool(left) and b.text == left[0])
            if rights[-1]:
                left.pop(0)
        assert not left, (html, left)
        labels, costs = hx.label(page, weights), hx.costs(page, weights)
        cut += zip(labels, rights, strict=True)
        alone += zip((c > 0 for c in costs[: len(rights)]), rights, strict=True)
        exact += labels == rights
    changed = sum(a != b for (a, _), (b, _) in zip(cut, alone, strict=True))
    mended = sum(a == right != b for (a, right), (b, _) in zip(cut, alone, strict=True))
    print(f"F1 {scores(cut):.3f}, by costs alone {scores(alone):.3f}; {changed} of {len(cut)} labels changed, {mended} of them mended; {exact} of {len(pages)} pages exact")
    assert scores(cut) >= 0.97 and scores(cut) > scores(alone) + 0.05 and mended >= 0.9 * changed > 0 and exact >= 0.8 * len(pages)


def test_composed_pages_that_were_not_learnt_from():
    from talkloom.llm import html_lessons

    weights, cut = hx.default_weights(), []
    for html, content in html_lessons.pages(150, seed=91):
        page = hx.Page(html)
        cut += zip(hx.label(page, weights), (b.text in content for b in page.blocks), strict=True)
    assert scores(cut) >= 0.95


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/pages.parquet"), reason="the test tables are not here")
def test_the_cut_decides_on_the_given_pages(spark):
    """Every block inside the article and none outside, and many only by the cut."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = hx.train(df)
    changed = total = 0
    for r in df.where("html IS NOT NULL").collect():
        page = hx.Page(r.html)
        inside = {i for i, e in enumerate(page.elements) if e.tag == "article"}
        for i, p in enumerate(page.parent):
            if p in inside:
                inside.add(i)
        labels, costs = hx.label(page, weights), hx.costs(page, weights)
        assert labels == [b.node in inside for b in page.blocks], r.page_id
        changed += sum(on != (c > 0) for on, c in zip(labels, costs, strict=False))
        total += len(labels)
    print(f"{changed} of {total} labels changed by the cut")
    assert changed > 0.02 * total
