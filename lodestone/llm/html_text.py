"""Main text of web pages, with boilerplate found by a suffix array over each host.

A page becomes regions: the text that stands directly in one container (an article, a section, a div, ...), block by
block. A region's text is one token stream, shorter ones filled up to ``least`` tokens. All regions of a host's pages,
in and outside articles, go into suffix arrays, which find the substrings of ``least`` tokens that stand on two or
more distinct pages. From these two decisions follow, alike for all pages of the host:

* A container, known by its path of element names and classes, is boilerplate if of the distinct substrings that
  begin in it ``SHARE`` or more stand on several pages. Copies of a page count once, so they don't make it boilerplate.
* A substring is boilerplate if it stands on ``LEAST_PAGES`` pages or more and on ``SHARE`` of all pages of the host.

A page's text is that of its article and main elements with all containers in them, else that of the whole body.
Containers that markup names as menus, headers, footers, sidebars, notices, adverts, forms or comments never belong to
it. Containers and substrings that the arrays call boilerplate are removed, and the runs between them kept, but not
an article or main element itself; and nothing is removed if that would leave fewer than a fifth of a page's article
(of a page without one: fewer than ``least`` tokens), as it is then a copy. Text that merely repeats stays.

No task gets a whole host. Every window of ``least`` tokens has an anchor, its least-hashed ``GRAM`` tokens, so equal
windows have equal anchors. Anchors that occur once are left out before, which can't lose a repeat; those of the
others are dealt by anchor, equal ones combined where pages are read, and those of an anchor that occurs more than
``HOT`` times by their own tokens. What a task gets it concatenates and sorts as one suffix array.

Null and empty pages give an empty text. Rows alike in all three columns are one page to the suffix array, and are
answered each time. Null ids and addresses are kept; pages without an address share the empty host. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest, xxh64_intdigest

from .common import bounded_batches, materialise, mixed, partitions, scratch, slices
from .hash_files import HashFiles, repeated, write_hashes

LEAST, GRAM, SHARE, LEAST_PAGES, WHOLE = 8, 5, 0.5, 10, 0.8
HOT = 100_000
COLLECTION = 1_000_000  # tokens of a suffix array; one more group of an anchor may come on top

#: Element names, and the words in class, id and role that name what isn't article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg math iframe object canvas audio video textarea select".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
REGIONS = frozenset("article aside body center details dialog div fieldset figure footer form head header main menu nav section table".split())
DROPPED = frozenset("aside button dialog footer form head menu nav title".split())
NOISE = frozenset(
    "ad ads advert advertisement advertisements adverts alert banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies"
    " disclaimer dialog disqus form login masthead menu modal nav navbar navigation newsletter notice notices notification pagination"
    " popup promo promotion related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget"
    " ad-banner ad-slot ad-container comment-list comments-area cookie-banner cookie-notice main-nav related-posts share-buttons site-nav social-share".split()
)
OUTER = frozenset("footer header site-footer site-header page-footer".split())  # inside an article these are its own
ARTICLE, MAIN, OTHER, DROP = 3, 2, 1, 0

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
NAME = re.compile(r"</?[a-zA-Z]")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
DIGITS = re.compile(r"\d+")
ENDS = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in HIDDEN}
#: An element that ends the last open one of the same kind, if no other block than a div or paragraph is between.
KIND = {"li": 0, "dt": 1, "dd": 1, "td": 2, "th": 2, "tr": 3, "p": 4}
PASSED = frozenset("div address".split())


def named(attributes: str) -> tuple[frozenset[str], str]:
    """The words in class, id and role; and the classes as they stand in a container's path."""
    words, classes = set(), ""
    for m in ATTRIBUTE.finditer(attributes):
        own = (m[2] or m[3] or m[4] or "").lower().split()
        words.update(own)
        if m[1].lower() == "class":
            classes = "".join("." + DIGITS.sub("0", w) for w in sorted(set(own)))
    return frozenset(words), classes


class Page:
    """A page's regions, and its blocks in page order. One scan; each character is looked at a bounded number of times."""

    def __init__(self, page: str, by_class: bool = True):
        self.paths: list[int] = []  # of each region: a hash of its container's path
        self.roles: list[int] = []
        self.own: list[bool] = []  # is its container an article or main element itself?
        self.blocks: list[tuple[int, str]] = []  # (region, text), white space in a block being one blank
        self.by_class = by_class
        # open elements: name, role, region, and for each kind where its last open element is
        self.stack: list[tuple[str, int, int, tuple[int, ...]]] = []
        self.open: dict[str, int] = {}
        self.text: list[str] = []
        self.where = self.region("", OTHER, False)  # of the block's text
        self.scan(page)
        self.end()

    def region(self, path: str, role: int, own: bool) -> int:
        self.paths.append(xxh64_intdigest(path)), self.roles.append(role), self.own.append(own)
        return len(self.paths) - 1

    def at(self) -> tuple[int, int, tuple[int, ...]]:
        return self.stack[-1][1:] if self.stack else (OTHER, 0, (-1,) * 5)

    def add(self, text: str) -> None:
        role, region, _ = self.at()
        if role != DROP:
            self.text.append(text)
            self.where = region

    def end(self) -> None:
        if self.text:
            words = " ".join(html.unescape("".join(self.text)).split())
            self.text.clear()
            if words:
                self.blocks.append((self.where, words))

    def cut(self, i: int) -> None:
        """Close the open elements from the i-th on."""
        for name, *_ in self.stack[i:]:
            self.open[name] -= 1
        del self.stack[i:]

    def scan(self, page: str) -> None:
        at = 0
        while (i := page.find("<", at)) >= 0:
            if i > at:
                self.add(page[at:i])
            m = TAG.match(page, i)
            if m:
                at = m.end()
                name = m[2].lower()
                if m[1]:
                    self.close(name)
                elif name in HIDDEN:
                    if not m[3].endswith("/") and (end := ENDS[name].search(page, at)):
                        at = end.end()
                    elif not m[3].endswith("/"):
                        return
                else:
                    self.start(name, m[3])
            elif page.startswith("<!--", i):
                at = page.find("-->", i + 4) + 3
                if at < 3:
                    return
            elif page.startswith(("<!", "<?"), i) or NAME.match(page, i):  # a quote that never ends: the next > ends the tag
                at = page.find(">", i) + 1
                if not at:
                    return
                if m := re.match(r"<(/?)([a-zA-Z][^\s/>]*)", page[i : i + 64]):
                    self.close(m[2].lower()) if m[1] else self.start(m[2].lower(), "")
            else:
                self.add("<")
                at = i + 1
        self.add(page[at:])

    def close(self, name: str) -> None:
        if name in BLOCKS:
            self.end()
        if not self.open.get(name):
            return
        i = len(self.stack) - 1
        while self.stack[i][0] != name:
            i -= 1
        self.cut(i)

    def start(self, name: str, attributes: str) -> None:
        block = name in BLOCKS
        if block:
            self.end()
            kinds = self.at()[2]
            last, own = kinds[4], kinds[KIND[name]] if name in KIND else -1
            i = own if last < 0 else last if own < 0 else min(last, own)
            if i >= 0:  # a paragraph ends where a block begins, a list item where the next does
                self.cut(i)
        elif name == "br":
            self.add(" ")
            return
        elif "=" not in attributes and name not in DROPPED or attributes.endswith("/"):
            return
        if name in VOID:
            return
        role, region, kinds = self.at()
        inner, classes = role, ""
        if role != DROP:
            words, classes = named(attributes) if "=" in attributes else (frozenset(), "")
            outermost = name in ("html", "body", "main") or (name == "article" and role < ARTICLE)
            if name in DROPPED or (name == "header" and role < MAIN):
                inner = DROP
            elif self.by_class and not outermost and not (NOISE.isdisjoint(words) and (role >= MAIN or OUTER.isdisjoint(words))):
                inner = DROP
            elif name == "article":
                inner = ARTICLE
            elif name == "main":
                inner = max(role, MAIN)
        if not block and inner == role:
            return
        if name in REGIONS and inner != DROP:
            region = self.region(f"{self.paths[region]}/{name}{classes}", inner, name in ("article", "main"))
        elif inner == DROP and role != DROP:
            region = self.region(f"{self.paths[region]}/{name}{classes}", DROP, False)
        n = len(self.stack)
        if block and name not in PASSED and name not in KIND:
            kinds = (-1,) * 5
        elif name in KIND:
            k = KIND[name]
            kinds = (*(kinds[:k] if k != 2 else (-1, -1)), n, *(-1,) * (4 - k))
        elif block:
            kinds = (*kinds[:4], -1)
        self.stack.append((name, inner, region, kinds))
        self.open[name] = self.open.get(name, 0) + 1


def parse(page: str | None) -> Page:
    found = Page(page or "")
    if max(found.roles) < MAIN and re.search(r"<(?:article|main)\b", page or "", re.IGNORECASE):
        again = Page(page, by_class=False)  # a container of the whole page had such a name
        return again if max(again.roles) >= MAIN else found
    return found


def page_text(page: Page, boilerplate: set[int] = frozenset(), runs: dict[int, np.ndarray] | None = None, least: int = LEAST) -> str:
    """The blocks of the article and main elements, else of all regions, without regions that are boilerplate; runs:
    of a region, which of its tokens belong to substrings that are."""
    declared = max(page.roles) >= MAIN
    own = [(r, t) for r, t in page.blocks if page.roles[r] >= (MAIN if declared else OTHER)]
    gone = {r for r in boilerplate if not page.own[r]}
    if gone or runs:
        at, out, size, left = Counter(), [], 0, 0
        for r, t in own:
            words = t.split()
            marks = runs.get(r) if runs else None
            kept = [] if r in gone else words if marks is None else [w for w, g in zip(words, marks[at[r] : at[r] + len(words)]) if not g]
            at[r] += len(words)
            size, left = size + len(words), left + len(kept)
            if kept:
                out.append(" ".join(kept))
        if left >= ((1 - WHOLE) * size if declared else least):
            return "\n".join(out)
    return "\n".join(t for _, t in own)


class Hashes(dict):
    """Tokens' hashes from 1 up (0 fills short regions); few tokens are looked at twice."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[token] = h = max(1, xxh32_intdigest(token, 42))
        return h


class Streams:
    """The token streams of a batch of pages' regions, one after another."""

    def __init__(self, pages: list[Page], hosts: list[str], known: Hashes, least: int):
        self.page, self.region, names, every, sizes = [], [], [], [], []
        for i, page in enumerate(pages):
            tokens: dict[int, list[str]] = {}
            for r, t in page.blocks:
                if r in tokens:
                    tokens[r] += t.split()
                else:
                    tokens[r] = t.split()
            for r, words in tokens.items():
                self.page.append(i), self.region.append(r), names.append(f"{hosts[i]}\0{page.paths[r]}")
                every += words
                sizes.append(len(words))
        self.paths = np.fromiter(map(xxh64_intdigest, names), np.uint64, len(names))  # of host and container
        host = np.fromiter((xxh64_intdigest(h) for h in hosts), np.uint64, len(hosts))
        self.host = host[self.page] if names else np.zeros(0, np.uint64)
        own = np.array(sizes, np.int64)
        self.sizes = np.maximum(own, least)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.tokens = np.zeros(int(self.sizes.sum()), np.uint32)
        self.tokens[np.arange(len(every)) + np.repeat(self.begins - (np.cumsum(own) - own), own)] = np.fromiter(map(known.__getitem__, every), np.uint32, len(every))
        self.n = self.sizes - least + 1  # windows
        first = np.cumsum(self.n) - self.n
        self.owner = np.repeat(np.arange(len(sizes)), self.n)
        self.windows = np.arange(int(self.n.sum())) - first[self.owner] + self.begins[self.owner] if names else np.zeros(0, np.int64)

    def grams(self, n: int) -> np.ndarray:
        """A hash of the n tokens from each place."""
        h = np.zeros(max(0, len(self.tokens) - n + 1), np.uint64)
        for k in range(n):
            h = mixed(h ^ self.tokens[k : k + len(h)].astype(np.uint64))
        return h

    def window_hashes(self, least: int) -> np.ndarray:
        """Of each window, with its host."""
        return mixed(self.grams(least)[self.windows] ^ self.host[self.owner])

    def anchors(self, least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each window: its anchor's hash, with its host, and its anchor's place."""
        h = self.grams(gram)
        near = np.stack([h[self.windows + k] for k in range(least - gram + 1)])
        k = near.argmin(axis=0)
        return mixed(near[k, np.arange(len(k))] ^ self.host[self.owner]), self.windows + k


def suffix_ranks(tokens: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a stream as far as ``least`` tokens, by prefix doubling: (order, rank of each suffix by
    its first ``least`` tokens). Tokens are numbers; page ends must be numbers of their own."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    order, span = np.argsort(rank, kind="stable"), 1
    while span < least:
        step = min(span, least - span)
        second = np.full(len(rank), -1, np.int64)
        second[: len(rank) - step] = rank[step:]
        key = rank * (len(rank) + 2) + second + 1
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.empty(len(rank), np.int64)
        new[order] = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        rank, span = new, span + step
    return order, rank


SEGMENTS = "host long, deal long, path long, tokens binary, flags binary, least_page long, most_page long, n long"


def segments(pages: DataFrame, files: HashFiles, least: int, gram: int) -> DataFrame:
    """Runs of windows with one repeated anchor, equal ones as one row: (host, deal, path, tokens, flags, least_page,
    most_page, n). flags: which windows are the first of their kind on their page. Rows without tokens tell how many
    windows a container has, and (path 0) how many pages a host has."""
    schema = [f.split() for f in SEGMENTS.split(", ")]

    def work(batches):
        known, rows, total = Hashes(), {}, Counter()

        def out():
            for i in range(0, len(rows), 50_000):
                part = list(rows.items())[i : i + 50_000]
                yield batch_of([(*k, *v) for k, v in part])
            yield batch_of([(h, p, p, b"", b"", 0, 0, n) for (h, p), n in total.items()])
            rows.clear(), total.clear()

        def batch_of(part):
            columns = zip(*part) if part else ((),) * len(schema)
            kinds = {"long": pa.int64(), "binary": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, schema)], [n for n, _ in schema])

        for batch in slices(batches, 1):
            keys = batch.column(2).to_numpy()
            s = Streams([parse(h) for h in batch.column(1).to_pylist()], batch.column(0).to_pylist(), known, least)
            signed = lambda x: x.view(np.int64).tolist()
            for h in batch.column(0).to_pylist():
                total[int(np.uint64(xxh64_intdigest(h)).view(np.int64)), 0] += 1
            if not len(s.windows):
                continue
            for h, p, n in zip(signed(s.host), signed(s.paths), s.n.tolist()):
                total[h, p] += n
            anchor, place = s.anchors(least, gram)
            kind = files.find(anchor)  # 0: never elsewhere, 1: repeated, 2: very often
            whole = s.window_hashes(least)
            page = np.array(s.page)[s.owner]
            on = np.flatnonzero(kind > 0)
            first = np.zeros(len(whole), bool)
            order = on[np.lexsort((whole[on], page[on]))]
            if not len(order):
                continue
            first[order[np.concatenate([[True], (whole[order[1:]] != whole[order[:-1]]) | (page[order[1:]] != page[order[:-1]])])]] = True
            # a segment goes on while window, region and anchor do; windows of very frequent anchors stand alone
            head = on[np.concatenate([[True], (np.diff(on) != 1) | (place[on[1:]] != place[on[:-1]]) | (s.owner[on[1:]] != s.owner[on[:-1]]) | (kind[on[1:]] == 2)])]
            count = np.diff(np.concatenate([np.searchsorted(on, head), [len(on)]]))
            deal = np.where(kind[head] == 2, whole[head], anchor[head])
            data, marks = s.tokens.astype("<u4").tobytes(), first.tobytes()
            owner = s.owner[head]
            for h, d, p, w, i, n, k in zip(signed(s.host[owner]), signed(deal), signed(s.paths[owner]), s.windows[head].tolist(), head.tolist(), count.tolist(), keys[page[head]].tolist()):
                key = (h, d, p, data[4 * w : 4 * (w + n + least - 1)], marks[i : i + n])
                old = rows.get(key)
                rows[key] = (k, k, 1) if old is None else (min(k, old[0]), max(k, old[1]), old[2] + 1)
            if len(rows) > 200_000:
                yield from out()
        yield from out()

    return pages.mapInArrow(work, SEGMENTS)


FOUND = "host long, path long, total long, distinct long, repeated long, window long, pages long"


def repeats_of_hosts(rows: DataFrame, least: int, n_tasks: int) -> DataFrame:
    """Suffix arrays over dealt segments: for each container the windows in all, the distinct ones that stand on several
    pages and their places; for substrings on LEAST_PAGES pages or more the number of pages."""

    def build(batches):
        held: dict[tuple, list[int]] = {}
        size, now, sums = 0, None, {}

        def found():
            """(path, window, pages) of frequent substrings; adds to the containers' sums."""
            names = list(held)
            tokens = [np.frombuffer(t, "<u4") for _, _, t, _ in names]
            sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
            n = sizes - least + 1
            stream = np.concatenate([x for i, t in enumerate(tokens) for x in (t.astype(np.int64), [(1 << 32) + i])])
            begins = np.cumsum(sizes + 1) - (sizes + 1)
            who = np.repeat(np.arange(len(names)), n)
            place = begins[who] + np.arange(len(who)) - (np.cumsum(n) - n)[who]
            order, rank = suffix_ranks(stream, least)
            inside = np.zeros(len(stream), bool)
            inside[place] = True
            owner = np.zeros(len(stream), np.int64)
            owner[place] = who
            order = order[inside[order]]  # the suffix array's places that begin a window
            flag = np.zeros(len(stream), bool)
            flag[place] = np.frombuffer(b"".join(f for *_, f in names), bool)
            r, w = rank[order], owner[order]
            host, path = (np.array([x[i] for x in names], np.int64) for i in (0, 1))
            numbers = np.array([held[x] for x in names], np.int64).reshape(-1, 3)
            # neighbours with a common prefix of ``least`` tokens and one host are one substring
            by = np.lexsort((path[w], host[w], r))
            r, w, order = r[by], w[by], order[by]
            new = np.concatenate([[True], (r[1:] != r[:-1]) | (host[w[1:]] != host[w[:-1]])])
            head = np.flatnonzero(new)
            many = np.minimum.reduceat(numbers[w, 0], head) < np.maximum.reduceat(numbers[w, 1], head)
            pages = np.add.reduceat(numbers[w, 2] * flag[order], head)
            group = np.cumsum(new) - 1
            on = np.flatnonzero(many[group])
            if not len(on):
                return []
            here = np.concatenate([[True], (group[on[1:]] != group[on[:-1]]) | (path[w[on[1:]]] != path[w[on[:-1]]])])
            for i, n_places, d in zip(w[on].tolist(), numbers[w[on], 2].tolist(), here.tolist()):
                own = sums.setdefault((int(host[i]), int(path[i])), [0, 0, 0])
                own[1] += d
                own[2] += n_places
            often = np.flatnonzero(many & (pages >= LEAST_PAGES))
            at = order[head[often]]
            h = np.zeros(len(at), np.uint64)
            for k in range(least):
                h = mixed(h ^ stream[at + k].astype(np.uint64))
            hosts = host[w[head[often]]]
            return list(zip(hosts.tolist(), mixed(h ^ hosts.view(np.uint64)).view(np.int64).tolist(), pages[often].tolist()))

        def batch_of(some):
            columns = [(h, None, None, None, None, x, p) for h, x, p in some]
            columns += [(h, p, *x, None, None) for (h, p), x in sums.items()]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*columns) if columns else ((),) * 7)], [f.split()[0] for f in FOUND.split(", ")])

        for batch in batches:
            for h, d, p, t, f, least_page, most_page, n in zip(*(batch.column(i).to_pylist() for i in range(8))):
                if d != now and size > COLLECTION:
                    yield batch_of(found())
                    held.clear()
                    size = 0
                now = d
                if not t:
                    sums.setdefault((h, p), [0, 0, 0])[0] += n
                    continue
                key = (h, p, t, f)
                if key in held:
                    x = held[key]
                    x[0], x[1], x[2] = min(x[0], least_page), max(x[1], most_page), x[2] + n
                else:
                    held[key] = [least_page, most_page, n]
                    size += len(t) // 4
        if held:
            yield batch_of(found())
        yield batch_of([])

    return rows.repartition(n_tasks, "deal").sortWithinPartitions("deal").mapInArrow(build, FOUND)


def boilerplate(pages: DataFrame, least: int = LEAST, gram: int = GRAM) -> tuple[HashFiles, HashFiles]:
    """Containers that are boilerplate, and substrings that are, together with their hosts; as hashes in files."""
    spark, n = pages.sparkSession, partitions(pages.sparkSession)

    def anchors(batches):
        known = Hashes()
        for batch in slices(batches, 1):
            s = Streams([parse(h) for h in batch.column(1).to_pylist()], batch.column(0).to_pylist(), known, least)
            if len(s.windows):
                anchor, place = s.anchors(least, gram)
                yield anchor[np.concatenate([[True], place[1:] != place[:-1]])]

    folder = scratch(spark, "hosts")
    files = repeated(pages, anchors, folder, n, HOT)
    out = materialise(repeats_of_hosts(segments(pages, files, least, gram), least, n), "host_repeats")
    paths = out.where("total is not null").groupBy("host", "path").agg(*(F.sum(c).alias(c) for c in ("total", "distinct", "repeated")))
    named_ = paths.where((F.col("path") != 0) & (F.col("distinct") > 0) & (F.col("distinct") >= SHARE * (F.col("distinct") + F.col("total") - F.col("repeated")))).select(F.col("path").alias("hash"))
    sizes = paths.where("path = 0").select("host", F.col("total").alias("all_pages"))
    often = out.where("window is not null").join(sizes, "host").where(F.col("pages") >= SHARE * F.col("all_pages"))
    often = often.select(F.col("window").alias("hash")).union(often.select(F.col("host").alias("hash"))).distinct()
    return write_hashes(named_, folder, "containers", n), write_hashes(often, folder, "substrings", n)


def extract(pages: DataFrame, least: int = LEAST, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text), a row for each page."""
    bounded_batches(pages.sparkSession, 1000)
    host = F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"), host.alias("host"))
    containers, substrings = boilerplate(rows.select("host", "html", F.xxhash64("page_id", "url", "html").alias("key")), least)

    def work(batches):
        known = Hashes()
        for batch in slices(batches, 2):
            found, hosts = [parse(h) for h in batch.column(2).to_pylist()], batch.column(3).to_pylist()
            texts = [page_text(p) for p in found]
            gone: dict[int, set[int]] = {}
            own = [(i, r) for i, p in enumerate(found) for r in range(len(p.paths))]
            named_ = np.fromiter((xxh64_intdigest(f"{hosts[i]}\0{found[i].paths[r]}") for i, r in own), np.uint64, len(own))
            for k in np.flatnonzero(containers.find(named_)).tolist():
                gone.setdefault(own[k][0], set()).add(own[k][1])
            runs: dict[int, dict[int, np.ndarray]] = {}
            some = np.flatnonzero(substrings.find(np.fromiter(map(xxh64_intdigest, hosts), np.uint64, len(hosts)))).tolist()
            if some:  # pages of hosts with such substrings
                s = Streams([found[i] for i in some], [hosts[i] for i in some], known, least)
                hit = substrings.find(s.window_hashes(least)) > 0
                for o in np.unique(s.owner[hit]).tolist():
                    marks = np.zeros(s.sizes[o] + 1, np.int64)
                    at = s.windows[hit & (s.owner == o)] - s.begins[o]
                    marks[at] += 1
                    np.subtract.at(marks, at + least, 1)
                    runs.setdefault(some[s.page[o]], {})[s.region[o]] = np.cumsum(marks) > 0
            for i in gone.keys() | runs.keys():
                texts[i] = page_text(found[i], gone.get(i, frozenset()), runs.get(i), least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return rows.mapInArrow(work, rows.select("page_id", "url", F.lit("").alias("text")).schema)
