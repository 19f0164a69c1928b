"""Main text of web pages by equivalence-class template deduction.

A page is a stream of tokens: its structural tags, each with the path that it stands in, and its blocks of text. Over the
pages of one host every token has an occurrence vector, how often it is in each page. Tokens with equal vectors
are an equivalence class; a class in at least SUPPORT of the host's pages is valid. Valid classes are the host's template,
nested by the paths of their tokens; what stands between template tokens is in a slot.

Which slots are main text: not those in elements and marks that fixed lists name (menus, headers, footers, side bars,
notices, adverts, forms, comments). A mark counts if the template shows that its region repeats, and an element that
encloses the page's article never counts. If the template has an article, the slots in it are the main text, else those that
remain. Text of the template itself is no slot: it goes, class by class, the widest first, but from an article not the class
that would leave it empty (copies of one article). Vectors are compared by sums of hashes over pages, so that a host of any
size is counted where its pages are.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanmoa.llm.common import as_bytes, join_small, slices, stored

#: Share of a host's pages that a valid class is in, and the fewest pages that make text a part of the template.
SUPPORT, LEAST_PAGES = 0.5, 3

# Fixed values of HTML: elements whose content is no markup, elements that never have content, elements that flow in a line.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes")
VOID = {"area", "base", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
#: Elements that make up paths; all others only begin and end blocks.
STRUCTURE = {"html", "head", "body", "nav", "header", "footer", "aside", "main", "article", "section", "div", "form", "dialog", "menu", "button", "select", "svg", "math", "object", "figure", "table", "ul", "ol", "dl", "details", "fieldset"}
# Elements and words of class, id or role that say that a part of a page is not its main text.
NOT_CONTENT = {"head", "nav", "aside", "footer", "form", "dialog", "menu", "button", "select", "svg", "object", "header"}
WORDS_NOT_CONTENT = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disclaimer", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "overlay", "pagination", "pager", "popup", "promo", "promotion", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget"}
#: Words that may stand beside those in a mark; those of the last set leave a header in the content.
QUALIFIERS = {"site", "page", "main", "global", "left", "right", "top", "bottom", "primary", "secondary", "list", "box", "area", "bar", "block", "container", "wrapper", "section", "inner", "links", "posts", "form"}
OF_ARTICLE = {"entry", "post", "article"}
COMMENTS = {"comment", "comments", "disqus", "replies", "respond"}

_OPEN = re.compile(r"<(?:(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)|(?P<other>!--|!\[CDATA\[|[!?/]))")
#: A tag from its name to its end: a quote begins a value only behind an equals sign, else it is a character like others.
_REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+")
_LONG_NUMBER = re.compile(r"&#0*[0-9]{8,};?")
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
#: Elements deeper than this aren't told apart from the one that they are in.
DEPTH = 200
_HOST = re.compile(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    """The host that a URL names, lower-cased; empty if it names none."""
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _kind(mark: str) -> str:
    """What a whole mark names: ``c`` comments, ``h`` a header, ``o`` another part outside of content; else empty."""
    parts = {p for p in re.split(r"[-_:]+", mark) if p}
    named = parts & WORDS_NOT_CONTENT
    if not named or parts - named - QUALIFIERS - OF_ARTICLE:
        return ""
    if named & COMMENTS:
        return "c"
    if named == {"header"}:
        return "" if parts & OF_ARTICLE else "h"
    return "o"


@lru_cache(65536)
def _step_of(name: str, marks: tuple[str, ...]) -> str:
    kinds = {_kind(w) for w in marks} if name not in ("html", "body", "main") else set()
    short = "".join("." + re.sub(r"[/#.!~]", "_", w) for w in marks[:8])
    if len(marks) > 8:
        short += "~" + xxhash.xxh3_64_hexdigest(" ".join(marks).encode())
    return name + short + next((f"!{k}" for k in "coh" if k in kinds), "")


def _step(name: str, rest: str) -> str:
    """An element's step of a path: its name, its class, id and role without digits (many shortened by a hash), and what they all name."""
    marks = {w for m in _MARK.findall(rest) for w in re.sub(r"\d+", "", " ".join(m).lower()).split()} if "=" in rest else ()
    return _step_of(name, tuple(sorted(marks)))


def _behind(page: str, what: str, at: int) -> int:
    end = page.find(what, at)
    return len(page) if end < 0 else end + len(what)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, path, text): kind ``open`` for a structural element, ``text`` for a block of text, in page order.

    As browsers do, a tag, comment or raw element that isn't closed takes the rest of the page. Each character is read once.
    """
    path: list[tuple[str, str]] = [("", "")]  # name, path
    within: Counter = Counter()
    line: list[str] = []
    at = 0

    def block() -> Iterator[tuple[str, str, str]]:
        if line:
            text = " ".join(html.unescape(_LONG_NUMBER.sub("\ufffd", "".join(line))).split())
            line.clear()
            if text:
                yield "text", path[-1][1], text

    while m := _OPEN.search(page, at):
        if m.start() > at:
            line.append(page[at : m.start()])
        if other := m["other"]:
            end = {"!--": "-->", "![CDATA[": "]]>"}.get(other, ">")
            at = _behind(page, end, m.start() + 2 if other == "!--" else m.end())
            continue
        name, rest = m["name"].lower(), _REST.match(page, m.end())
        at = rest.end() + 1
        if at > len(page) or page[at - 1] != ">":
            at = len(page)
            break
        if name in RAW:
            if not m["end"]:
                end = _RAW_END[name].search(page, at)
                at = _behind(page, ">", end.end()) if end else len(page)
            continue
        if name == "br":
            line.append(" ")
        elif name not in INLINE:
            yield from block()
            if name in STRUCTURE:
                if not m["end"]:
                    if not rest[0].endswith("/"):
                        path.append((name, f"{path[-1][1]}/{_step(name, rest[0])}" if len(path) <= DEPTH else path[-1][1]))
                        within[name] += 1
                        yield "open", path[-1][1], ""
                elif within[name]:
                    closed = ""
                    while closed != name:
                        closed = path.pop()[0]
                        within[closed] -= 1
    line.append(page[at:])
    yield from block()


@lru_cache(65536)
def outside(path: str) -> tuple[tuple[str, str], ...]:
    """(path, kind) of the elements of a path that are named outside of content: ``n`` by the element, else its marks' kind.

    A header within an article is inside.
    """
    out, within, at = [], False, ""
    for step in path.split("/")[1:]:
        at += "/" + step
        name, kind = re.split(r"[.!]", step)[0], step.partition("!")[2]
        if name in NOT_CONTENT and not (within and name == "header"):
            out.append((at, "n"))
        elif kind and not (within and kind == "h"):
            out.append((at, kind))
        within = within or name in ("article", "main")
    return tuple(out)


def is_content(path: str) -> bool:
    """Whether no element of the path is named outside of content."""
    return not outside(path)


@lru_cache(65536)
def article_of(path: str) -> str:
    """The innermost kind of main element that the path is in: article, main or none."""
    names = {re.split(r"[.!]", s)[0] for s in path.split("/")}
    return "article" if "article" in names else "main" if "main" in names else ""


def _name(path: str) -> str:
    return re.split(r"[.!]", path.rpartition("/")[2])[0]


class Template:
    """What the pages of a host share: its valid classes as [pages, times, tokens], and marked paths that repeat.

    times is how often a token of the class is in all pages together. Without classes nothing is known of the host.
    """

    def __init__(self, classes: list[list], regions: list[str]):
        self.pages = max((pages for pages, _, tokens in classes if "" in tokens), default=0)
        self.once = {t for pages, times, tokens in classes if times == pages for t in tokens}
        #: Of each text of the template, its class; classes go by falling number of pages.
        ordered = sorted((c for c in classes if c[0] >= LEAST_PAGES), key=lambda c: (-c[0], c[2]))
        self.texts = {t: i for i, (_, _, tokens) in enumerate(ordered) for t in tokens if "#" in t}
        self.regions = set(regions)
        kinds = {article_of(p) for _, _, tokens in classes for p in tokens if "#" not in p and is_content(p)}
        self.main = "article" if "article" in kinds else "main" if "main" in kinds else ""

    def left_out(self, path: str) -> list[tuple[str, str]]:
        """What of ``outside`` holds here: of a host with several pages, marked regions must repeat."""
        return [(p, k) for p, k in outside(path) if k == "n" or self.pages < 2 or p in self.regions]

    def spared(self, opened: list[str], blocks: list[tuple[str, str]]) -> set[str]:
        """Elements that enclose the page's one article, where none stands free and it has more text than what does."""
        slots = [p for p in opened if _name(p) in ("article", "main")]
        found = []
        for p in slots:
            out = self.left_out(p)
            if not out:
                return set()
            alone = p in self.once or (self.pages < 2 and slots.count(p) == 1) or _name(p) == "main"
            if alone and all(_name(q) in ("form", "header", "object") if k == "n" else k != "c" for q, k in out):
                found.append((len(out), p, {q for q, _ in out}))
        if not found:
            return set()
        _, slot, out = min(found, key=lambda f: f[:2])
        inside = sum(len(t) for p, t in blocks if f"{p}/".startswith(f"{slot}/") and out.issuperset(q for q, _ in self.left_out(p)))
        return out if inside > sum(len(t) for p, t in blocks if not self.left_out(p)) else set()

    def extract(self, page: str) -> str:
        """The text of the main slots."""
        opened, blocks = [], []
        for kind, path, text in tokens(page):
            if kind == "text":
                blocks.append((path, text))
            else:
                opened.append(path)
        spared = self.spared(opened, blocks)
        blocks = [(p, t) for p, t in blocks if spared.issuperset(q for q, _ in self.left_out(p))]
        kinds = {article_of(path) for path, _ in blocks}
        main = self.main if self.main in kinds else "article" if "article" in kinds else "main" if "main" in kinds else ""
        if main:
            blocks = [(p, t) for p, t in blocks if article_of(p) == main or (main == "main" and article_of(p))]
        if self.texts:
            of = [self.texts.get(_text_token(p, t), -1) for p, t in blocks]
            stays = max(of, default=-1) if main and -1 not in of else -1  # all are the template's: the narrowest class stays
            blocks = [b for b, c in zip(blocks, of, strict=True) if c in (-1, stays)]
        return "\n\n".join(t for _, t in blocks)


def _text_token(path: str, text: str) -> str:
    return f"{path}#{xxhash.xxh3_64_hexdigest(text.encode())}"


VECTORS = "host string, token string, pages long, times long, first long, second long"


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By host and token: pages that have it, how often all do, and sums over pages of two hashes of the page and how often it is there."""
    for batch in slices(batches, "html", 4 << 20):
        out: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0, 0, 0])
        for url, page in zip(batch.column("url").to_pylist(), as_bytes(batch, "html"), strict=True):
            if page is None:
                continue
            count: dict[str, int] = defaultdict(int)
            for kind, path, text in tokens(page.decode()):
                count[path if kind == "open" else _text_token(path, text)] += 1
            count[""] = 1  # stands for the page itself
            name = xxhash.xxh3_64_digest((url or "").encode() + b"\n" + page)
            for token, n in count.items():
                h = xxhash.xxh3_64_intdigest(name + n.to_bytes(4, "big"))
                for host in {host_of(url), ""}:  # the empty host has all pages
                    v = out[host, token]
                    v[0] += 1
                    v[1] += n
                    v[2] += h & 0x7FFFFFFF
                    v[3] += h >> 33
        yield pa.record_batch(
            [
                pa.array([k[0] for k in out], pa.string()),
                pa.array([k[1] for k in out], pa.string()),
                *(pa.array([v[i] for v in out.values()], pa.int64()) for i in range(4)),
            ],
            names=["host", "token", "pages", "times", "first", "second"],
        )


def vectors(pages: DataFrame) -> DataFrame:
    """(host, token, pages, times, first, second), less texts of one page; stored."""
    seen = pages.select("url", "html").mapInArrow(_vectors, VECTORS)
    total = seen.groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in ("pages", "times", "first", "second")))
    return stored(total.where("pages >= 2 or token not like '%#%'"), "templates")


def classes(total: DataFrame) -> DataFrame:
    """(host, pages, times, tokens): a row for each valid equivalence class, tokens with one occurrence vector.

    Of tokens in at least SUPPORT of a host's pages there are at most 1 / SUPPORT times as many as a page has. The empty
    token stands for the page, so its class is what each page has once.
    """
    every = total.where("token = ''").select("host", F.col("pages").alias("all"))
    # a host may have a third of all pages, so rows aren't dealt by host
    widest = every.agg(F.max(F.octet_length("host"))).first()[0] or 0
    valid = join_small(total, every, "host", "inner", widest + 16).where(F.col("pages") >= SUPPORT * F.col("all"))
    return valid.groupBy("host", "pages", "times", "first", "second").agg(F.sort_array(F.collect_list("token")).alias("tokens")).drop("first", "second")


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): each host's valid classes, and its marked paths of two pages or more, as JSON; the empty host stands for all pages."""
    total = vectors(pages)
    valid = classes(total).select("host", F.struct("pages", "times", "tokens").alias("class"), F.lit(None).cast("string").alias("region"))
    marked = total.where("host != '' and pages >= 2 and token rlike '![a-z]$'").select("host", F.lit(None).cast(valid.schema["class"].dataType).alias("class"), F.col("token").alias("region"))
    return valid.unionAll(marked).groupBy("host").agg(
        F.to_json(F.struct(F.sort_array(F.collect_list("class")).alias("classes"), F.sort_array(F.collect_list("region")).alias("regions"))).alias("template")
    )


def _read(template: str) -> Template:
    held = json.loads(template)
    return Template([[c["pages"], c["times"], c["tokens"]] for c in held["classes"]], held["regions"])


@lru_cache(4096)
def _template(own: str | None, general: str | None) -> Template:
    """A host's template; where its pages show no main element, that of all pages tells which there is."""
    t = _read(own) if own else Template([], [])
    if not t.main and general:
        t.main = _read(general).main
    return t


def extract_text(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text (main text: blocks joined by two line feeds, empty if none), n_chars.

    Character references are decoded and white space within a block is one blank. Null html is an empty page, a
    null or odd url belongs to the empty host. Repeated rows get a row each; other columns aren't read; an empty
    table gives no rows.
    """
    made = stored(templates(pages), "templates")
    general = made.where("host = ''").select("template").collect()  # one row
    default = general[0]["template"] if general else None
    host = F.udf(host_of, "string", useArrow=True)
    rows = pages.select("page_id", "url", "html").withColumn("host", host("url"))
    own = made.where("host != ''")
    widest = own.agg(F.max(F.octet_length("host") + F.octet_length("template"))).first()[0] or 0
    rows = join_small(rows, own, "host", "left", widest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 4 << 20):
            own = batch.column("template").to_pylist()
            texts = [_template(t, default).extract(p or "") for t, p in zip(own, batch.column("html").to_pylist(), strict=True)]
            yield pa.record_batch(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.select(F.col("page_id").cast("long"), "url", "html", "template").mapInArrow(run, "page_id long, url string, text string, n_chars long")
