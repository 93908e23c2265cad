"""Main text of web pages by consensus host paths.

1. Each page is read into blocks of text, each under a chain of containers. A block that isn't in a menu,
   header, footer, sidebar, notice, advert, form, script, style or reader's comment gives its containers
   points: its characters outside links, whole to the nearest, half to the next, a quarter to the next.
   From the container with most points a page climbs to the outermost article or main around it; without
   one, to the highest ancestor that adds wanted text: text of its own, or a child with a heading or a
   SHARE-th of what is held so far, more of it outside links than in them.
2. A container's path is the tags and classes from the body down to it, generalised: no numbers, only the
   classes without digits. Each page votes for the path of the container it climbed to. Spark adds up votes
   by host and path; a host's TOP paths with most votes win, more points first among equals.
3. Each page is read again and gives the text of all its containers on the first winning path that has any;
   without one, on the path that it votes for itself.

So a page with a long sidebar or a short article follows the other pages of its host. A host's paths are few
strings; they are broadcast if there are at most MOST_HOSTS of them, and joined by a shuffle beyond.

A form is left out with what it holds, unless it wraps the page: if it holds an article or main, or at least
FORM_TEXT characters of text outside links, it counts as any other element, and only its fields go. Names that
mark what isn't main text (WORDS) count as a whole: "related" and "related-posts" go, "related-work" stays; some
(STRONG) count as a part of any name.

Containers are kept by parent, and paths as a tree, so memory and time grow with a page's length, however deep
it is nested. Null or empty pages, and pages without text, give an empty text. A page whose url is null or has no
host votes among such pages. Very long pages are read whole. Rows stay as they are, in any number; other columns
are not read. Tables without rows give none.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

TOP, MOST_HOSTS, SHARE, FORM_TEXT = 3, 200_000, 5, 500
#: Parts into which a host's pages are dealt where paths are joined by a shuffle.
SALTS = 32
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_words = lambda s: frozenset(s.split())
#: What HTML says of its elements.
RAW = _words("script style noscript template iframe noembed noframes xmp svg math")
VOID = _words("area base br col embed hr img input link meta param source track wbr")
BLOCKS = _words("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul caption")
CONTAINERS = _words("article body div main section td blockquote center table tbody tr figure dl ul ol")
CLOSES_P = BLOCKS - _words("body html head option legend caption summary td th tr tbody thead tfoot")
HEADINGS = _words("h1 h2 h3 h4 h5 h6")
ALONE = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "option": "select", "tr": "table", "td": "tr table", "th": "tr table"}
#: Elements, roles and words in a class or id of what isn't main text.
NEVER = RAW | _words("nav footer aside menu button input select textarea dialog head title search object canvas audio video datalist label")
ROLES = _words("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status")
WORDS = _words(
    "nav navbar navigation menu menubar sidebar sidenav aside footer header masthead ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus respond reply replies breadcrumb breadcrumbs pagination pager toolbar "
    "widget widgets copyright disclaimer hidden skip search searchform rail toc tags outbrain taboola"
)
STRONG = _words("ad ads advert adverts advertisement advertising adsense sponsor sponsored cookie cookies gdpr newsletter popup modal disqus outbrain taboola navbar sidebar sidenav masthead breadcrumb breadcrumbs commentlist searchform pagination pager")
#: What may stand beside WORDS in a name.
BESIDE = _words(
    "area articles bar block blocks body bottom box btn button buttons col column component container content count entry first float footer form full global grid group holder icon icons in inner item items js l last layout left link links list "
    "logo m main mini module nav outer page pane panel part pod post posts primary row s section secondary site small stories sticky strip sub text thread title top up us view wrap wrapper wide right form story media button more news"
)
KEEP = _words("has with no without")
_SPLIT = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
#: Raw elements whose tags nest, and which "/>" closes; not after an unquoted value, as the slash is part of it.
DRAWN = _words("svg math")
_ALONE_END = re.compile(r"""(?:^|[\s"'])/\Z|\s[^\s=]+/\Z""")
_CLOSING = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW | {"title", "textarea"}}


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        out.setdefault(m[1].lower(), m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or "")
    return out


def _unwanted(tag: str, a: dict[str, str], in_article: bool) -> bool:
    if tag in NEVER or tag == "header" and not in_article:
        return True
    if not a or tag in ("html", "body", "main", "article"):
        return "comment" in a.get("class", "").lower() if tag == "article" else False
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in ROLES:
        return True
    if "style" in a and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a["style"], re.I):
        return True
    for name in f"{a.get('class', '')} {a.get('id', '')}".split():
        parts = [p.lower() for p in _SPLIT.findall(name)]
        if not KEEP.isdisjoint(parts):
            continue
        if not STRONG.isdisjoint(parts) or not WORDS.isdisjoint(parts) and all(p in WORDS or p in BESIDE for p in parts):
            return True
    return False


def _name(tag: str, a: dict[str, str]) -> str:
    classes = sorted({c.lower() for c in a.get("class", "").split() if c.isidentifier() or re.fullmatch(r"[A-Za-z_-]+", c)} if a else ())
    return ".".join([tag, *(c for c in classes if not any(x.isdigit() for x in c))])


def _drawn_ends(s: str, at: int) -> dict[int, int]:
    """For each svg and math from `at` on that is closed: where it starts, and where what follows it starts."""
    out: dict[int, int] = {}
    opened: dict[str, list[int]] = defaultdict(list)
    while m := _TOKEN.search(s, at):
        at = m.end()
        tag, rest = (m[2] or m[5] or "").lower(), m[3] or m[6] or ""
        if tag in DRAWN:
            if m[1] or m[4]:
                if opened[tag]:
                    out[opened[tag].pop()] = at
            elif _ALONE_END.search(rest):
                out[m.start()] = at
            else:
                opened[tag].append(m.start())
        elif tag in _CLOSING and not (m[1] or m[4] or _ALONE_END.search(rest)):
            if e := _CLOSING[tag].search(s, at):
                at = e.start()
    return out


class Page:
    """Blocks (text, innermost container, characters outside links, whether in a heading), containers by parent, and their paths as a tree.

    Numbers of containers are in page order, so those inside a container are the ones from it up to its end.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, int, bool]] = []
        # Of each container: the one around it, how deep it is, its path, whether it is an article or main, and the end.
        self.parent, self.depth, self.path, self.named, self.end = [-1], [0], [0], [False], [1]
        # Of each path: the one it goes on from, and its last name.
        self.steps: list[tuple[int, str]] = [(-1, "body")]
        self._known = {(-1, "body"): 0}
        self.points: dict[int, float] = defaultdict(float)
        self._read(source)

    def _container(self, parent: int, tag: str, name: str) -> int:
        step = (self.path[parent], name)
        if step not in self._known:
            self._known[step] = len(self.steps)
            self.steps.append(step)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.path.append(self._known[step])
        self.named.append(tag in ("article", "main"))
        self.end.append(len(self.parent))
        return len(self.parent) - 1

    def _read(self, s: str) -> None:
        # Each open element: tag, its container, whether unwanted, whether in an article, its form.
        stack: list[tuple[str, int, bool, bool, int]] = []
        opened: Counter[str] = Counter()
        held, in_links, links = [], 0, 0
        chain, off, article, form = 0, False, False, 0
        # Of each form: characters outside links, and whether an article is in it.
        forms, blocks = [[0, True]], []
        drawn: dict[int, int] | None = None

        def flush() -> None:
            nonlocal held, in_links
            if held:
                text = " ".join("".join(held).split())
                if text:
                    plain = max(0, len(text) - in_links)
                    blocks.append((text, chain, plain, any(opened[h] for h in HEADINGS), form))
                    forms[form][0] += plain
            held, in_links = [], 0

        def close(k: int) -> None:
            """Closes the open elements from the k-th on."""
            nonlocal chain, off, article, links, form
            if any(t[0] in BLOCKS for t in stack[k:]):
                flush()
            for t in stack[k:]:
                opened[t[0]] -= 1
                links -= t[0] == "a"
            for c in {t[1] for t in stack[k:]}:
                self.end[c] = len(self.parent)
            del stack[k:]
            _, chain, off, article, form = stack[-1] if stack else ("", 0, False, False, 0)

        at, n = 0, len(s)
        while at < n:
            m = _TOKEN.search(s, at)
            end = m.start() if m else n
            if end > at and not off:
                text = s[at:end]
                if "&" in text:
                    text = entities.unescape(text)
                held.append(text)
                if links:
                    in_links += len(text)
            if not m:
                break
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                if s.startswith("<![CDATA[", m.start()) and not off:
                    held.append(m[0][9:].removesuffix("]]>"))
                continue
            tag, closing, rest = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
            if closing:
                if opened[tag]:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == tag:
                            close(k)
                            break
                        if stack[k][0] in ("td", "th", "table", "body") and tag not in ("table", "tr", "tbody", "body", "html"):
                            break
                elif tag in BLOCKS and (tag in ("table", "tr", "tbody", "body", "html") or not (opened["td"] or opened["th"] or opened["table"] or opened["body"])):
                    flush()
                if tag == "br" and not off:
                    held.append(" ")
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                elif tag in ("br", "wbr") and not off:
                    held.append(" " if tag == "br" else "")
                continue
            if tag in DRAWN:
                # Without an end only the tag is skipped: text and HTML after it are shown.
                if drawn is None:
                    drawn = _drawn_ends(s, m.start())
                at = drawn.get(m.start(), at)
                continue
            if tag in _CLOSING:
                # Their content isn't markup.
                if tag == "title":
                    flush()
                e = _CLOSING[tag].search(s, at)
                at = n if not e else (s.find(">", e.end()) + 1 or n)
                continue
            if tag in BLOCKS:
                if tag in CLOSES_P and opened["p"]:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == "p":
                            close(k)
                            break
                        if stack[k][0] in BLOCKS:
                            break
                if tag in ALONE:
                    stop = ALONE[tag].split()
                    same = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
                    if any(opened[t] for t in same):
                        for k in range(len(stack) - 1, -1, -1):
                            if stack[k][0] in same:
                                close(k)
                                break
                            if stack[k][0] in stop:
                                break
                flush()
            a = _attributes(rest) if "=" in rest or "hidden" in rest else {}
            if not off and tag not in ("html", "body"):
                off = _unwanted(tag, a, article)
            article = article or tag in ("article", "main")
            if tag in ("article", "main"):
                forms[form][1] = True
            if tag == "form" and not form:
                forms.append([0, False])
                form = len(forms) - 1
            if tag in CONTAINERS and tag != "body" and not off:
                chain = self._container(chain, tag, _name(tag, a))
            links += tag == "a"
            opened[tag] += 1
            stack.append((tag, chain, off, article, form))
        flush()
        for c in {t[1] for t in stack} | {0}:
            self.end[c] = len(self.parent)
        for text, c, plain, heading, f in blocks:
            if f and not (forms[f][1] or forms[f][0] >= FORM_TEXT):
                continue
            self.blocks.append((text, c, plain, heading))
            for k in range(3):
                if c >= 0:
                    self.points[c] += plain / (1 << k)
                    c = self.parent[c]

    def best(self) -> int | None:
        """The container with most points; articles count half as much again."""
        weight = lambda c: self.points[c] * (1.5 if self.named[c] else 1)
        return max(self.points, key=lambda c: (weight(c), -c), default=None)

    def _around(self, c: int):
        while (c := self.parent[c]) >= 0:
            yield c

    def climbed(self, c: int) -> int:
        """The container around c that holds the text beside it, or c."""
        if named := [x for x in (c, *self._around(c)) if self.named[x]]:
            return named[-1]
        start, last = self._tree()
        total = [0] * len(self.steps)  # characters outside links, by path and then by those that go on from it
        own: dict[int, list[tuple[str, int, int, bool]]] = defaultdict(list)
        for b in self.blocks:
            total[self.path[b[1]]] += b[2]
            own[b[1]].append(b)
        for p in range(len(self.steps) - 1, 0, -1):
            total[self.steps[p][0]] += total[p]
        taken = lambda x, c: start[self.path[c]] <= start[self.path[x]] < last[self.path[c]]  # noqa: E731 x is in a container on c's path
        below, rest = c, [0, 0, False]
        for above in self._around(c):
            held, direct, pieces = total[self.path[c]], [0, 0, False], [rest]
            found = False
            for text, _, plain, heading in own[above]:
                if not taken(above, c):
                    found |= 2 * plain > len(text)
                    direct = [direct[0] + len(text), direct[1] + plain, direct[2] or heading]
            x = above + 1
            while x < self.end[above]:
                if x == below:
                    x = self.end[below]
                    continue
                piece = [0, 0, False]
                for y in range(x, self.end[x]):
                    if y in own and not taken(y, c):
                        for text, _, plain, heading in own[y]:
                            piece = [piece[0] + len(text), piece[1] + plain, piece[2] or heading]
                pieces.append(piece)
                x = self.end[x]
            if found or any(2 * plain > k and (heading or SHARE * plain >= held) for k, plain, heading in pieces):
                c, rest = above, [0, 0, False]
            else:
                both = [direct, *pieces]
                rest = [sum(p[0] for p in both), sum(p[1] for p in both), any(p[2] for p in both)]
            below = above
        return c

    def _tree(self) -> tuple[list[int], list[int]]:
        """Of each path, the first number of its part of the tree of paths, and the one after it."""
        size = [1] * len(self.steps)
        for p in range(len(self.steps) - 1, 0, -1):
            size[self.steps[p][0]] += size[p]
        start, used = [0] * len(self.steps), [1] * len(self.steps)
        for p in range(1, len(self.steps)):
            q = self.steps[p][0]
            start[p] = start[q] + used[q]
            used[q] += size[p]
        return start, [x + k for x, k in zip(start, size)]

    def vote(self) -> tuple[str | None, float | None]:
        """The path of the container climbed to, and the points of the best."""
        c = self.best()
        return (None, None) if c is None else (self._said(self.path[self.climbed(c)]), float(self.points[c]))

    def _said(self, p: int) -> str:
        names = []
        while p >= 0:
            p, name = self.steps[p]
            names.append(name)
        return "/".join(reversed(names))

    def text(self, path: str | None) -> str:
        """The text of all containers on a path."""
        p = -1
        for name in path.split("/") if path else [""]:
            if (p := self._known.get((p, name), -2)) < 0:
                return ""
        own: list[bool] = []
        for q, above in zip(self.path, self.parent):
            own.append(q == p or above >= 0 and own[above])
        return " ".join(t for t, c, _, _ in self.blocks if own[c])


def extract(source: str | None, paths=()) -> str:
    page = Page(source or "")
    for p in paths:
        if found := page.text(p):
            return found
    return page.text(page.vote()[0])


def _host(url) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _vote(batches):
    for b in batches:
        path, points = [], []
        for s in b.column("html").to_pylist():
            p, n = Page(s or "").vote()
            path.append(p)
            points.append(n)
        yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(path, pa.string()), pa.array(points, pa.float64())], ["host", "path", "points"])


def host_paths(pages: DataFrame, top: int = TOP) -> DataFrame:
    """host, paths: the winning paths of each host, best first."""
    votes = pages.select(_host(F.col("url")).alias("host"), "html").mapInArrow(_vote, "host string, path string, points double").where("path is not null")
    # Points are whole eighths, so that their sum is the same in any order.
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum(F.round(F.col("points") * 8).cast("long")).alias("points"))
    order = Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("points"), "path")
    best = counted.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top)
    return best.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("k", "path"))).alias("p")).select("host", F.col("p.path").alias("paths"))


def main_texts(pages: DataFrame, top: int = TOP, most_hosts: int = MOST_HOSTS) -> DataFrame:
    """page_id, url, text, n_chars for each row."""
    paths = Scratch(pages.sparkSession, "paths").write(host_paths(pages, top))
    rows = pages.select("page_id", "url", "html", _host(F.col("url")).alias("host"))
    if paths.limit(most_hosts + 1).count() <= most_hosts:
        rows = rows.join(F.broadcast(paths), "host", "left")
    else:
        # A large host's pages are many tasks'.
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        rows = rows.withColumn("salt", salt).join(paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left")

    def run(batches):
        for b in batches:
            text = [extract(s, p or ()) for s, p in zip(b.column("html").to_pylist(), b.column("paths").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.select("page_id", "url", "html", "paths").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
