"""Post extraction from raw HTML pages (S8, with S6/S7/S9/T8/T9 applied).

Each page is parsed inside an Arrow-batched ``mapInPandas`` task with the
standard library's ``html.parser``; pages are independent, so the work
spreads over all partitions of the pages table.

A selector is a comma-separated list of alternatives; an alternative is a chain
of simple selectors that must enclose each other in order (``.card-act ul li``);
a simple selector is ``tag``, ``.class``, ``#id``, ``[attribute]`` and
``[attribute*=part]`` in any combination.  Field selectors apply inside a card.
A page with one of the spec's login markers as class or id yields no rows; a
card without text (or without a link, when the spec requires one) is skipped.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import parse_count, parse_time
from . import ingest as I


@dataclass
class CardSpec:
    """Where a card's fields are.  ``text`` and ``title`` take all text inside
    their elements; ``author``, ``time`` and ``likes`` the first direct text of
    the first element that has one; ``counters`` a repeated element, of which
    the 2nd to 4th hold shares, comments and likes."""
    card: str = "article"
    text: str = "p"
    title: str | None = "h1"
    author: str | None = None
    time: str | None = None
    link: str | None = None          # element whose href is the post link
    link_base: str = ""              # put before a link that is not absolute
    counters: str | None = None
    likes: str | None = None
    require_link: bool = False
    id_from_link: str | None = None  # prefix of ids taken from the link (S7); None: content id (S6)
    platform: str = "weibo"
    login: tuple = ()
    skip: tuple = ("script", "style", "nav", "footer")


# Where the collectors found the fields of search cards.
SEARCH_CARDS = CardSpec(card=".card-wrap", text=".content .txt", title=None,
                        author=".content .name, .content a[nick-name]", time=".content .from a",
                        counters=".card-act ul li", platform="weibo")
NOTE_CARDS = CardSpec(card=".note-item", text=".desc, .note-text", title=".title, .note-title",
                      author=".author-wrapper .name, .nickname, .author .name",
                      likes=".like-wrapper .count, .engagement .like span",
                      link="a[href*=/explore/], a[href*=/discovery/item/]", link_base="https://www.xiaohongshu.com",
                      require_link=True, id_from_link="xhs_", platform="xiaohongshu",
                      login=("login-container", "qrcode-img"))
# Generic article pages (the driver's pages table).
ARTICLES = CardSpec()

_SIMPLE = re.compile(r"([.#]?)([\w-]+)|\[([\w-]+)(?:\*=([^\]]*))?\]")


def _compile(selector: str | None) -> list:
    """[[simple, ..], ..]: alternatives as chains of lists of tests."""
    out = []
    for alternative in (selector or "").split(","):
        chain = []
        for part in alternative.split():
            tests = []
            for kind, name, attr, value in _SIMPLE.findall(part):
                tests.append((("attr", attr, value) if attr else ({"": "tag", ".": "class", "#": "id"}[kind], name, "")))
            chain.append(tests)
        if chain:
            out.append(chain)
    return out


def _is(element, tests) -> bool:
    tag, attrs, classes = element
    for kind, name, value in tests:
        if kind == "tag":
            ok = tag == name
        elif kind == "class":
            ok = name in classes
        elif kind == "id":
            ok = attrs.get("id") == name
        else:
            ok = name in attrs and value in (attrs[name] or "")
        if not ok:
            return False
    return True


def _match(chains: list, path: list) -> int | None:
    """The first alternative that the last element of ``path`` (outermost first) fits."""
    for k, chain in enumerate(chains):
        if not _is(path[-1], chain[-1]):
            continue
        need = len(chain) - 2
        for element in reversed(path[:-1]):
            if need < 0:
                break
            if _is(element, chain[need]):
                need -= 1
        if need < 0:
            return k
    return None


class _CardParser(HTMLParser):
    VOID = {"br", "img", "meta", "link", "input", "hr", "area", "base", "col", "embed", "source", "wbr"}
    DEEP = ("text", "title")
    OWN = ("author", "time", "likes")

    def __init__(self, spec: CardSpec):
        super().__init__(convert_charrefs=True)
        self.spec = spec
        self.sel = {f: _compile(getattr(spec, f)) for f in ("card", "text", "title", "author", "time", "likes", "link", "counters")}
        self.cards: list[dict] = []
        self.stack: list[tuple] = []                # open elements
        self.cur: dict | None = None
        self.card_depth = -1
        self.inside: list[tuple[str, int]] = []     # (field, depth) of open elements of deep fields and counters
        self.own: dict[int, list] = {}              # depth -> [(field, alternative)]
        self.skip_depth = -1
        self.walled = False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        element = (tag, a, set((a.get("class") or "").split()))
        if self.spec.login and (element[2] | {a.get("id")}) & set(self.spec.login):
            self.walled = True
        depth = len(self.stack)
        path = [*self.stack, element]
        if tag not in self.VOID:
            self.stack.append(element)
        if self.skip_depth < 0 and tag in self.spec.skip:
            self.skip_depth = depth
        if self.cur is None:
            if _match(self.sel["card"], path) is not None:
                self.cur = {"text": [], "title": [], "counters": [], "link": None, **{f: {} for f in self.OWN}}
                self.card_depth = depth
            return
        path = path[self.card_depth:]
        for name in self.DEEP:
            if _match(self.sel[name], path) is not None:
                if name == "text" and self.cur["text"]:
                    self.cur["text"].append(" ")    # separate sibling paragraphs
                self.inside.append((name, depth))
        for name in self.OWN:
            k = _match(self.sel[name], path)
            if k is not None:
                self.own.setdefault(depth, []).append((name, k))
        if _match(self.sel["counters"], path) is not None:
            self.cur["counters"].append([])
            self.inside.append(("counters", depth))
        if self.cur["link"] is None and _match(self.sel["link"], path) is not None:
            self.cur["link"] = a.get("href")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in self.VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in self.VOID:
            return
        # pop to the matching open tag (tolerates unclosed <p>)
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                depth = k
                del self.stack[k:]
                break
        else:
            return
        self.inside = [(n, d) for n, d in self.inside if d < depth]
        self.own = {d: v for d, v in self.own.items() if d < depth}
        if self.skip_depth >= depth:
            self.skip_depth = -1
        if self.cur is not None and depth <= self.card_depth:
            self.cards.append(self.cur)
            self.cur, self.card_depth, self.inside, self.own = None, -1, [], {}

    def handle_data(self, data):
        if self.cur is None or self.skip_depth >= 0:
            return
        for name in {n for n, _ in self.inside}:
            (self.cur["counters"][-1] if name == "counters" else self.cur[name]).append(data)
        if data.strip():
            for name, k in self.own.get(len(self.stack) - 1, ()):
                self.cur[name].setdefault(k, data.strip())

    def handle_comment(self, data):
        pass


def parse_cards(html: str, spec: CardSpec) -> list[dict]:
    """Cards of one page as dicts (text, title, author, time, link, counter texts)."""
    if html is None:
        return []
    p = _CardParser(spec)
    p.feed(html)
    p.close()
    if p.walled:
        return []
    if p.cur is not None:
        p.cards.append(p.cur)
    out = []
    for c in p.cards:
        text = " ".join("".join(c["text"]).split())
        title = " ".join("".join(c["title"]).split())
        link = c["link"]
        if spec.require_link and not link:
            continue
        if link and not link.startswith("http"):
            link = spec.link_base + link
        if not text and not title:
            continue
        own = {f: c[f][min(c[f])] if c[f] else None for f in _CardParser.OWN}
        cnt = ["".join(x).strip() for x in c["counters"]]
        full = len(cnt) >= 4
        out.append({"text": text, "title": title, "author": own["author"], "time": own["time"], "link": link,
                    "shares": cnt[1] if full else None, "comments": cnt[2] if full else None,
                    "likes_text": own["likes"] or (cnt[3] if full else None)})
    return out


RAW_SCHEMA = ("page_id long, card long, url string, text string, title string, author string, "
              "time_text string, link string, shares_text string, comments_text string, likes_text string")


def extract_cards(pages: DataFrame, spec: CardSpec = ARTICLES) -> DataFrame:
    """(page_id, card, url, raw fields) for every card of every page."""
    import pandas as pd

    def run(it):
        for pdf in it:
            rows = []
            for pid, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"]):
                for k, c in enumerate(parse_cards(html, spec)):
                    rows.append((pid, k, url, c["text"], c["title"], c["author"], c["time"], c["link"],
                                 c["shares"], c["comments"], c["likes_text"]))
            yield pd.DataFrame(rows, columns=[s.split()[0] for s in RAW_SCHEMA.split(", ")])

    return pages.select("page_id", "url", "html").mapInPandas(run, RAW_SCHEMA)


def extract_posts(pages: DataFrame, as_of, spec: CardSpec = ARTICLES) -> DataFrame:
    """Posts in the collectors' item schema, defaults applied (S9), the post
    id from the link (S7) or the content (S6), time and counters parsed (T8, T9)."""
    raw = extract_cards(pages, spec)
    posts = raw.select(
        F.lit(spec.platform).alias("platform"),
        "page_id", "card",
        F.col("author"),
        F.col("text").alias("content"),
        F.col("title"),
        parse_time(F.col("time_text"), as_of).alias("publish_time"),
        parse_count(F.col("likes_text")).cast("int").alias("likes"),
        parse_count(F.col("comments_text")).cast("int").alias("comments"),
        parse_count(F.col("shares_text")).cast("int").alias("shares"),
        F.coalesce(F.col("link"), F.col("url")).alias("url"),
        F.lit(None).cast("string").alias("province"),
        F.lit(None).cast("string").alias("city"),
    )
    posts = I.with_defaults(posts)
    if spec.id_from_link is not None:
        return posts.withColumn("post_id", F.concat(F.lit(spec.id_from_link), I.note_id(F.col("url"))))
    return posts.withColumn("post_id", I.content_id(F.col("author"), F.col("content"), spec.platform))
