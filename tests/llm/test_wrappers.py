import random
import time

import pytest

from cuelake.llm import wrappers

HEAD = '<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body>'


def page(k, n=3, article=True, tail="</body></html>"):
    paragraphs = "".join(f"<p>Page {k} says in its paragraph number {i} what nobody else says&hellip; <b>x{k}</b>&nbsp;&lt;y</p>\n" for i in range(n))
    body = f"<h1>Title {k}</h1>{paragraphs}<div class='note-box'>Always the same words under every single article.</div>"
    body = f"<article>{body}<section class=comments><p>I do not agree with this page at all, {k}!</p></section></article>" if article else f"<div>{body}</div>"
    return (HEAD + f"<nav><ul>{''.join(f'<li><a href=/{i}>menu {k} {i}</a>' for i in range(k % 4 + 1))}</ul></nav><!-- ad --><div class='ad top'>Buy {k} now, "
            f"while there is something left to buy!</div>{body}<form>Your mail <input name=m></form><aside>Side {k}</aside>"
            f"<footer>&copy; {k} &middot; somebody who writes a long footer</footer>" + tail)


def expected(k, n=3, title=True):
    return "\n\n".join([f"Title {k}"] * title + [f"Page {k} says in its paragraph number {i} what nobody else says… x{k} <y" for i in range(n)])


SCHEMA = "page_id long, url string, html string, host string, wrapper string, text string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "h", "w", "t") for r in rows], SCHEMA)


def test_pages_of_a_host(shipped):
    rows = [(k, "https://a.example.com/x", page(k, 1 + k % 5)) for k in range(30)] + [(100 + k, "http://B.example.com", page(k, article=False)) for k in range(8)]
    rows += [(200, None, None), (201, "x", ""), (202, "https://one.example.com/?q", page(7)), (203, "https://a.example.com", page(9, tail="")[:-60]),
             (0, "https://a.example.com/x", page(0, 1)), (None, "https://a.example.com/y", "no markup at all, but a sentence that is long enough")]
    got = {}
    for r in wrappers.main_texts(frame(shipped, rows)).collect():
        assert r.n_chars == len(r.text)
        got.setdefault(r.page_id, []).append(r.text)
    assert sum(map(len, got.values())) == len(rows)
    for k in range(30):
        assert set(got[k]) == {expected(k, 1 + k % 5)}
    for k in range(8):
        assert got[100 + k][0] == expected(k)
    assert got[200] == got[201] == [""] and got[203] == [expected(9)] and len(got[0]) == 2
    assert got[202][0].startswith(expected(7))  # one page of a host cannot tell which of its texts are always the same


def test_repeats_fold_and_optional_parts_align():
    w = wrappers.Wrapper(wrappers.Page("<div><ul><li>a<li>b<li>c</ul><p>text</p></div>"))
    assert ("+", ("li", "#")) in w.signs
    w.add(wrappers.Page("<div><ul><li>a</ul><h2>new</h2><p>text</p></div>"))
    assert w.pages == 2 and w.seen[w.signs.index(("+", ("li", "#")))] == 2  # the single item folded into the group
    assert w.seen[w.signs.index("h2")] == 1


def test_deep_and_broken_markup(shipped):
    rows = [(1, "https://c.example.com", "<div>" * 3000 + "deep words that go on for long enough to count" + "<p>" * 500), (2, "https://c.example.com", "<a <b '\"> &am"),
            (3, "https://d.example.com", "<article>" + "<p>The same long sentence over and over again.</p>" * 3000)]
    got = {r.page_id: r.text for r in wrappers.main_texts(frame(shipped, rows)).collect()}
    assert got[1] == "deep words that go on for long enough to count" and got[3].count("sentence") == 3000
    assert wrappers.main_texts(frame(shipped, [])).count() == 0


def test_texts_that_pages_share_are_dropped_only_as_repeats(shipped):
    body = "".join(f"<p>Every copy of this article has its paragraph number {i} in common.</p>" for i in range(3))
    copies = [(k, "https://copies.example.com", f"<nav>menu {k}</nav><article>{body}</article>") for k in range(6)]
    optional = [(100 + k, "https://some.example.com", "<article>" + "<h2>Why it matters</h2>" * (k % 4 == 0) + f"<p>What page {k} has to say is its own.</p></article>")
                for k in range(16)]
    got = {r.page_id: r.text for r in wrappers.main_texts(frame(shipped, copies + optional)).collect()}
    assert all(got[k].count("in common") == 3 and "menu" not in got[k] for k in range(6))
    assert all(("Why it matters" in got[100 + k]) == (k % 4 == 0) and f"page {k} has" in got[100 + k] for k in range(16))


def test_another_text_in_a_slot_seen_as_fixed_is_kept():
    note = "<div><h3>{}</h3><p>Own text of page {} that nobody else has at all.</p></div>"
    w = wrappers.infer([note.format("The same note on each of the pages seen.", k) for k in range(5)])
    same = next(iter(wrappers.Extractor(w).candidates(note.format("The same note on each of the pages seen.", 9))))
    e = wrappers.Extractor(w, frozenset([same]))
    assert e.text(note.format("The same note on each of the pages seen.", 9)) == "Own text of page 9 that nobody else has at all."
    assert e.text(note.format("For once there is another note on this page.", 9)).startswith("For once there is another note")


def test_marked_pages_say_nothing_about_others_and_short_paragraphs_stay(shipped):
    rows = [(k, None, f"<nav>menu</nav><article><p>Article {k} has its own words in this one.</p></article>") for k in range(6)]
    rows += [(10 + k, "not a url", f"<div><p>Sh is{k}.</p><p>Page {k} has no article element but this long text.</p><p>So {k}.</p></div><div>Log in {k}</div>")
             for k in range(4)]
    got = {r.page_id: r.text for r in wrappers.main_texts(frame(shipped, rows)).collect()}
    assert all(got[k] == f"Article {k} has its own words in this one." for k in range(6))
    assert all(got[10 + k] == f"Sh is{k}.\n\nPage {k} has no article element but this long text.\n\nSo {k}." for k in range(4))


def alone(html):
    return wrappers.Extractor(wrappers.infer([html])).text(html)


LONG = "<p>A paragraph of the article that goes on for quite a while.</p>"
TEXT = "A paragraph of the article that goes on for quite a while."


def test_pages_that_share_unmarked_articles(shipped):
    body = "".join(f"<p>Every copy of this text has its paragraph number {i} in common.</p>" for i in range(3))
    rows = [(k, "https://copies.example.com", f"<ul><li><a href=/>menu {k}</a></ul><div>{body}</div>") for k in range(6)]
    got = {r.page_id: r.text for r in wrappers.main_texts(frame(shipped, rows)).collect()}
    assert all(t.count("in common") == 3 and "menu" not in t for t in got.values()) and len(got) == 6


@pytest.mark.parametrize("html,want", [
    (f'<body class="single has-sidebar"><article>{LONG}</article></body>', TEXT),
    (f'<body class="comments-open sidebar"><div class="site with-sidebar"><article class="post comment">{LONG}</article></div></body>', TEXT),
    (f'<form id="f"><div><article>{LONG}</article></div><p>Send this form with the button below it.</p></form>', TEXT),
    (f'<form class="sidebar"><main>{LONG}</main></form>', TEXT),
    ("<div><p>It is short.</p><p>So is this.</p></div>", "It is short.\n\nSo is this."),
    ('<article><p class="ad-hoc">An ad-hoc word.</p><p class="ad">Buy it!</p></article>', "An ad-hoc word."),
    (f'<article><div class="entry-header"><h1>Title</h1></div><header><h2>Under it</h2></header>{LONG}</article>', f"Title\n\nUnder it\n\n{TEXT}"),
    (f'<header><h1>Site</h1></header><div><h1>Title</h1>{LONG}</div><div class="site-footer">Some words of the site that are long enough.</div>', f"Title\n\n{TEXT}"),
    (f'<body><h1>Title</h1><ul><li><a href=/>Home</a><li><a href=/x>About all of this here</a></ul><div><div>{LONG}</div></div>', f"Title\n\n{TEXT}"),
    (f'<div>{LONG}<p><a href="/">A paragraph that is nothing but one long link</a></p></div>', f"{TEXT}\n\nA paragraph that is nothing but one long link"),
    (f'<div>{LONG}</div><section class="comments"><article class="comment"><p>I think so too, but what do I know about it all?</p></article></section>', TEXT),
    (f'<article>{LONG}</article><aside><article><p>Another article which is only a teaser in the sidebar here.</p></article></aside>', TEXT),
    (f'<article>{LONG}</article><div class="related-posts"><article><p>Another article which is only a teaser below the text.</p></article></div>', TEXT),
    ('<div class="cookie-banner"><p>We would like to keep cookies on your machine.</p></div>', ""),
])
def test_one_page(html, want):
    assert alone(html) == want


def test_generated_pages():
    """Pages put together from blocks whose place in the main text is known."""
    rng = random.Random(3)
    words = "amber birch cedar delta ember fjord grove heath inlet juniper".split()
    say = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    for _ in range(300):
        marked, blocks, main = rng.random() < 0.5, [], []
        title = say(3)
        for _ in range(rng.randint(1, 8)):
            kind, text = rng.choice(["p", "p", "p", "short", "h2", "li", "link", "quote"]), say(rng.randint(12, 40))
            if kind in ("short", "h2"):
                text = say(2)
            inner = f"<a href='/x'>{text}</a>" if kind == "link" else text
            blocks.append({"li": f"<ul><li>{inner}</ul>", "h2": f"<h2>{inner}</h2>", "quote": f"<blockquote>{inner}</blockquote>"}.get(kind, f"<p>{inner}</p>"))
            main.append(text)
        first = say(30)
        core = f"<h1>{title}</h1><p>{first}</p>" + "\n".join(blocks)
        if marked:
            core = rng.choice(["<article>{}</article>", "<main><div>{}</div></main>", "<div class='col'><article class='post'>{}</article></div>"]).format(core)
        else:
            core = f"<div>{core}</div>"
        if marked and rng.random() < 0.4:
            core = f"<form id=aspnet>{core}</form>"
        edge = [f"<nav><ul><li><a href=/>{say(2)}</a></ul></nav>", f"<div class='cookie-notice'>{say(9)}</div>", f"<form><p>{say(8)}</p></form>",
                f"<div class=\"ad\">{say(9)}</div>", f"<aside>{say(9)}</aside>", f"<section id=comments><p>{say(20)}</p></section>", f"<footer>{say(9)}</footer>"]
        rng.shuffle(edge)
        k = rng.randint(0, len(edge))
        body = f"<body class='{rng.choice(['', 'has-sidebar single', 'comments-open', 'page'])}'>" + "".join(edge[:k]) + core + "".join(edge[k:]) + "</body>"
        assert alone("<html><head><title>T</title></head>" + body + "</html>") == "\n\n".join([title, first, *main])


def test_alignment_is_a_longest_one(monkeypatch):
    rng = random.Random(5)

    def length(x, y):
        row = [0] * (len(y) + 1)
        for a in x:
            new = [0]
            for j, b in enumerate(y):
                new.append(row[j] + 1 if a == b else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for cells in (1 << 28, 40):
        monkeypatch.setattr(wrappers, "MOST_CELLS", cells)
        for _ in range(200):
            x, y = ([rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in range(2))
            got = wrappers.align(x, y)
            assert [i for i, _ in got if i is not None] == list(range(len(x))) and [j for _, j in got if j is not None] == list(range(len(y)))
            both = [(i, j) for i, j in got if i is not None and j is not None]
            assert all(x[i] == y[j] for i, j in both) and len(both) == length(x, y)


def test_hostile_pages_take_little_time():
    rng = random.Random(6)
    start = time.time()
    tags = lambda: "".join(rng.choice(["<div>a</div>", "<p>b</p>", "<ul><li>c</ul>", "<hr>", "<h2>d</h2>"]) for _ in range(6000))
    wrappers.infer([tags(), tags(), tags()])
    assert alone("<div>" * 20_000 + "</x>" * 20_000 + "</section>" * 20_000 + LONG) == TEXT
    assert time.time() - start < 60


def test_wrappers_come_from_all_pages(shipped, monkeypatch):
    """A host whose first hundred pages have one structure and one note, and as many with another structure: both notes are known."""
    one = lambda k: f"<div><h3>The same note on each of the pages here.</h3><p>Own text of page {k} that nobody else has at all.</p></div>"
    rare = lambda k: f"<table><tr><td>Only {k} tables have this one row</td></tr></table>{one(k)}"
    rows = [(k, "https://all.example.com", one(k) if k % 40 else rare(k)) for k in range(200)]
    frames = frame(shipped, rows).repartition(3)
    wrapper = wrappers.host_wrappers(frames).first()["wrapper"]
    assert "table" in wrapper and wrapper == wrappers.infer([r[2] for r in rows])  # 5 of 200 pages have the table
    monkeypatch.setattr(wrappers, "FAN", 2)
    got = {r.page_id: r.text for r in wrappers.main_texts(frames).collect()}
    assert len(got) == 200 and all(got[k] == f"Own text of page {k} that nobody else has at all." for k in range(200) if k % 40)


def test_merging_is_the_same_in_any_order():
    rng = random.Random(8)
    pages = ["<div>" + "".join(rng.choice(["<p>a</p>", "<h2>b</h2>", "<ul><li>c<li>d</ul>", "<hr>"]) for _ in range(6)) + f"<p>{k % 2}</p></div>" for k in range(60)]
    want = wrappers.infer(pages)
    for _ in range(3):
        rng.shuffle(pages)
        assert wrappers.infer(pages) == want


def test_a_usual_text_outlives_odd_pages():
    note = "<div><h3>{}</h3><p>Own text of page {} that nobody else has at all.</p></div>"
    pages = [note.format("The same note on each of the pages seen." if k % 30 else "An odd note that one page in thirty has.", k) for k in range(90)]
    for shift in (0, 1, 7):
        e = wrappers.Extractor(wrappers.infer(pages[shift:] + pages[:shift]))
        assert e.candidates(pages[1]) == {wrappers.digest("The same note on each of the pages seen.")} and not e.candidates(pages[30])
