"""The text of pages: markup cases, hostile pages, and the suffix arrays against brute force."""

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import html_text
from lodestone.llm.html_text import LEAST, LEAST_PAGES, MAIN, SHARE, page_text, parse

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><article>no";</script></head><body class="page">
<header class=top>Site</header><nav><ul><li><a href="/">Home</a></ul></nav><div class="ad">Buy</div>
<article class="post"><header><h1>A &amp; B</h1></header><p>One <b>two<br>three <!-- hidden --> &eacute;&nbsp;x<p>Four <span class="ads">buy</span> five &lt;i&gt; &am
<aside>Side</aside><form><p>Mail<input></form><div class="comments"><article>Reader says</article></div><ul><li>L1<li>L2</ul></article>
<footer>&copy; F</footer></body></html>"""


@pytest.mark.parametrize(
    "page, text",
    [
        (PAGE, "A & B\nOne two three é x\nFour five <i> &am\nL1\nL2"),
        ("<div class='widget'><main><p>a</main></div>", "a"),
        (None, ""),
        ("  ", ""),
        ("just <b>text", "just text"),
        ("a < b <3 c", "a < b <3 c"),
        ('<article><h2 class="section-header">Results</h2><p>x</article>', "Results\nx"),
        ('<article><div class="entry-header"><h1>Title</h1></div>x</article>', "Title\nx"),
        ('<article><p class="share-price">10 up</p><a class="social-link">us</a></article>', "10 up\nus"),
        ('<article><div class="header"><h1>Title</h1></div><div class="footer">end</div></article><div class="footer">no</div>', "Title\nend"),
        ('<article><ul><li class="ad">Buy<li>Real item</ul><dl><dt class=ad>a<dd>b<dt>c</dl></article>', "Real item\nb\nc"),
        ("<article><table><tr><td class=ad>a<td>b<tr><td>c</table></article>", "b\nc"),
        ("<article><ul><li>a<ul><li class=ad>b</ul><li>c</ul></article>", "a\nc"),
        ("<main><h1>Headline</h1><p>Lead</p><article>Body</article></main><div>no</div>", "Headline\nLead\nBody"),
        ("<article>a</article><p>between<article>b</article>", "a\nb"),
        ("<article>a<br/>b<hr>c<img src='x>y'>d</article>", "a b\nc d".replace("c d", "cd")),
        ("<article>a<script>x</article>", "a"),
        ("<article>a<svg/>b</article>", "ab"),
        ("<article>a<p title='x>y\">b</article>", 'a\ny">b'),
        ("<article>a<!-- b --><!-- c", "a"),
        ("<article>a</article", "a"),
        ('<article><p>a<span class="ad">x<div>b</div></article>', "a\nb"),
    ],
)
def test_markup(page, text):
    assert page_text(parse(page)) == text


@pytest.mark.parametrize("piece, more", [("<script ", ""), ("<div>", "</p>"), ("<li><div>", "</li>"), ("<a '", ""), ("<a \"'>", ""), ("<!--", ""), ("<", ""), ("</script", ""), ("&", ""), ("<ul><li>", "<li></li>"), ("<p>", ""), ("<svg>", ""), ("<div class=ad>", "</div>"), ("<td>", "<tr>")])
def test_hostile_pages_take_linear_time(piece, more):
    took = []
    for size in (100_000, 800_000):
        half = size // (2 if more else 1)
        page = "<article>" + piece * (half // len(piece)) + (more * (half // len(more)) if more else "")
        began = time.perf_counter()
        page_text(parse(page))
        took.append(time.perf_counter() - began)
    assert took[1] < 5 and took[1] < 30 * max(took[0], 0.02)


def host_of(url):
    m = re.match(r"[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return m[1].lower() if m else ""


def slow_text(rows, least=LEAST, least_pages=LEAST_PAGES):
    """Texts of all rows, with containers and substrings looked up in plain dictionaries."""
    regions, pages_of, number = [], Counter(), Counter()
    for i, (key, url, page) in enumerate(rows):
        p, streams = parse(page), defaultdict(list)
        for r, t in p.blocks:
            streams[r] += t.split()
        windows = {}
        for r, words in streams.items():
            words = words + [None] * (least - len(words))
            windows[r] = [tuple(words[k : k + least]) for k in range(len(words) - least + 1)]
        regions.append((p, windows))
        number[host_of(url)] += 1
    places, stands, often = defaultdict(Counter), defaultdict(set), Counter()
    for (key, url, page), (p, windows) in zip(rows, regions):
        host = host_of(url)
        for w in {w for ws in windows.values() for w in ws}:
            stands[host, w].add((key, url, page))
            often[host, w] += 1
        for r, ws in windows.items():
            places[host, p.paths[r]].update(ws)
    repeats = {k for k, v in stands.items() if len(v) > 1}
    named = set()
    for (host, path), ws in places.items():
        distinct = sum((host, w) in repeats for w in ws)
        single = sum(n for w, n in ws.items() if (host, w) not in repeats)
        if distinct and distinct >= SHARE * (distinct + single):
            named.add((host, path))
    common = {k for k in repeats if often[k] >= least_pages and often[k] >= SHARE * number[k[0]]}
    out = Counter()
    for (key, url, page), (p, windows) in zip(rows, regions):
        host, declared = host_of(url), max(p.roles) >= MAIN
        own = [(r, t) for r, t in p.blocks if p.roles[r] >= (MAIN if declared else 1)]
        marks = {}
        for r, ws in windows.items():
            gone = [False] * (len(ws) + least - 1)
            for k, w in enumerate(ws):
                if (host, w) in common:
                    gone[k : k + least] = [True] * least
            marks[r] = [True] * len(gone) if (host, p.paths[r]) in named and not p.own[r] else gone
        at, kept, size, left = Counter(), [], 0, 0
        for r, t in own:
            words = t.split()
            some = [w for w, g in zip(words, marks[r][at[r] :]) if not g]
            at[r] += len(words)
            size, left = size + len(words), left + len(some)
            kept += [" ".join(some)] * bool(some)
        whole = left < ((1 - html_text.WHOLE) * size if declared else least)
        out[key, url, "\n".join(t for _, t in own) if whole else "\n".join(kept)] += 1
    return out


def random_pages(seed=1, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [prose(rng.randint(4, 25)) for _ in range(6)]
    rows = []
    for i in range(n):
        host = rng.choice(["a.org", "a.org", "A.org", "b.org", "c.org"])
        ps = "".join(f"<p>{prose(rng.randint(1, 40)) if rng.random() < 0.8 else rng.choice(shared)}</p>" for _ in range(rng.randint(1, 5)))
        extra = f'<div class="box{rng.randint(1, 3)}">{rng.choice(shared[:3])}</div>' if rng.random() < 0.7 else ""
        notice = f"<p>{shared[5]} {shared[4]}</p>" if host == "b.org" and rng.random() < 0.8 else ""
        body = f"<article>{ps}{extra}{notice}</article>" if rng.random() < 0.6 else f"<div>{ps}</div>{extra}{notice}"
        rows.append((i, f"http://{host}/{i}", f"<body><nav>{shared[0]}</nav><div class=x{i % 2}>{shared[1]}</div>{body}</body>"))
    rows += [rows[0], rows[1], (n, rows[2][1], rows[2][2]), (None, "http://b.org/x", rows[3][2]), (n + 1, None, None), (n + 2, "http://a.org", ""), (n + 3, "ftp", "<p>" + "again and again " * 30)]
    return rows


@pytest.mark.parametrize("hot, collection, few", [(100_000, 1_000_000, 10), (3, 50, 2)])
def test_suffix_arrays_of_hosts(spark, monkeypatch, hot, collection, few):
    monkeypatch.setattr(html_text, "HOT", hot)
    monkeypatch.setattr(html_text, "COLLECTION", collection)
    monkeypatch.setattr(html_text, "LEAST_PAGES", few)
    rows = random_pages()
    # columns that clash with names used inside
    d = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "page_id long, url string, html string, host string, key int, hash long").repartition(5)
    got = Counter((r.page_id, r.url, r.text) for r in html_text.extract(d).collect())
    want = slow_text(rows, least_pages=few)
    assert got == want
    plain = Counter((i, u, page_text(parse(h))) for i, u, h in rows)
    assert sum((want - plain).values()) > 20  # the arrays decide something
    assert html_text.extract(d.limit(0)).collect() == []


def test_suffix_ranks():
    rng = np.random.default_rng(3)
    tokens = np.concatenate([rng.integers(0, 3, 200), [1 << 32], rng.integers(0, 3, 50), [(1 << 32) + 1]])
    for least in (1, 3, 8):
        order, rank = html_text.suffix_ranks(tokens, least)
        suffixes = [tuple(tokens[i : i + least]) for i in range(len(tokens))]
        names = {s: k for k, s in enumerate(sorted(set(suffixes)))}
        assert rank.tolist() == [names[s] for s in suffixes] and [suffixes[i] for i in order] == sorted(suffixes)


def test_copies_and_lines_in_articles_stay(spark):
    """What repeats on a few pages is text: copies of an article, near copies, a line that several articles quote."""
    rng = random.Random(4)
    prose = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    line, own = prose(12), [prose(60) for _ in range(12)]
    page = lambda i, t: f"<nav>{prose(9)}</nav><article><h1>{i}</h1><div class=body><p>{t}</p><p>{line if i % 3 == 0 else i}</p></div><div class=more>read all our other stories about this and that here</div></article>"
    rows = [(i, f"http://h/{i}", page(i, t)) for i, t in enumerate([*own, own[0], own[0], own[1].replace("w1", "v1", 1)])]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n".join([str(i), t, line if i % 3 == 0 else str(i)]) for i, t in enumerate([*own, own[0], own[0], own[1].replace("w1", "v1", 1)])}
