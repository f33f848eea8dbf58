"""Main text of web pages by wrapper induction.

Every page is parsed; the set of its block elements' paths, those of boilerplate left out, is its
layout. For each host and layout the texts at each path are counted over all its pages, copies once.
A text that nearly all pages with the path have there is constant, what else is there is a slot. The
wrapper is the element that holds most of the text of the slots, and the constant texts, which are
template. A layout without a wrapper of its own, as one with a single page, takes the element that
simple tree matching pairs with that of its host's most frequent layout. The text of a page is what
is in its wrapper's elements, without boilerplate elements and without the template. Only where no
wrapper fits are names used: article elements, else an element that is named as content, else the
body.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelflow.llm.common import slices, stored
from reelflow.llm.urls import host_and_path

#: Share of the pages of a layout with a path that must have the same text there for it to be constant.
CONSTANT = 0.9
#: An element is the wrapper's if it holds this share of the slots' text of the element around it.
SHARE = 0.6
#: Pages that must agree on a text for it to be template.
AGREE = 3

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template svg math iframe object canvas audio video title textarea xmp".split())
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote caption figcaption".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_FRAMES = (_BLOCKS | {"html"}) - _LEAVES
_BOILERPLATE = frozenset("nav footer aside menu form fieldset button select input label dialog head".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright discussion "
    "disqus footer masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion related "
    "replies respond share sharebar sharing sidebar skip social sponsor sponsored subscribe subscription toolbar widget widgets alert gdpr".split()
)
#: Words that say nothing about an element: inside content a class is boilerplate only if all its words are such or of `_NAMES`.
_PLAIN_NAMES = frozenset(
    "area article articles bar block body bottom box button buttons card container content cta end footer form group header icon icons inline inner item items label left "
    "link links list main mid middle module outer page panel placeholder post posts primary right row secondary section short signup site slot stories sub tags "
    "text thread title top unit wrap wrapper".split()
)
_HEADERS = frozenset("header topbar".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
_CONTENT = frozenset("article articlebody content entry main maincontent post story".split())
#: What an opening tag closes: an open element of the set, unless one of the second set is inside it.
_ITEM, _ROW = frozenset(("ul", "ol", "menu")), frozenset(("table",))
_CLOSES = {"li": (frozenset(("li",)), _ITEM), "dt": (frozenset(("dt", "dd")), frozenset(("dl",))), "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
           "td": (frozenset(("td", "th")), _ROW), "th": (frozenset(("td", "th")), _ROW), "tr": (frozenset(("tr",)), _ROW),
           "option": (frozenset(("option",)), frozenset(("select",)))}
_P = frozenset(("p",))
_SCOPE = frozenset("article aside body button div footer form header li main nav section table td th ul ol".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Page:
    """Elements in document order, an element's descendants right behind it, and the texts."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    label: list[str] = field(default_factory=list)
    skip: list[bool] = field(default_factory=list)
    content: list[bool] = field(default_factory=list)
    within: list[bool] = field(default_factory=list)
    texts: list[tuple[int, str]] = field(default_factory=list)

    def path(self, node: int) -> str:
        out = []
        while node >= 0:
            out.append(self.label[node])
            node = self.parent[node]
        return "/".join(reversed(out))


def _named(attributes: str) -> tuple[set[str], set[str], str, bool]:
    """Words of class, id and role names, the classes, the first one, and whether the element is hidden."""
    words, classes, first, hidden = set(), set(), "", False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "itemprop", "data-component"):
            words.update(w.lower() for w in _WORD.findall(value))
            words.update(w.lower() for w in value.split())
            if name == "class" and value.split():
                first = value.split()[0].lower()
                classes.update(value.split())
            elif name == "id" and value.lower() in _NAMES:
                classes.add(value)
        elif name == "role":
            words.update("role=" + w.lower() for w in value.split())
        elif name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            hidden = True
        elif name == "aria-hidden" and value.lower() == "true":
            hidden = True
    return words, classes, first, hidden


def _says_boilerplate(name: str) -> bool:
    """True if all words of a class or id of an element inside content are of boilerplate, and one is more than a plain name."""
    words = {w.lower() for w in _WORD.findall(name)} or {name.lower()}
    return not words.isdisjoint(_NAMES) and words <= _NAMES | _PLAIN_NAMES


def parse(html: str) -> Page:
    """Elements and texts of a page; markup errors are met as browsers do, in a simple way."""
    page, stack, at = Page(), [], 0
    still_open: dict[str, int] = defaultdict(int)
    limit = html.rfind(">") + 1  # no markup ends behind it

    def close(to: int) -> None:
        while len(stack) > to:
            node = stack.pop()
            page.end[node] = len(page.tag)
            still_open[page.tag[node]] -= 1

    def text(upto: int) -> None:
        if upto > at:
            page.texts.append((stack[-1] if stack else -1, html[at:upto]))

    while m := _TOKEN.search(html, at, limit):
        text(m.start())
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, ending, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if ending:
            for k in range(len(stack) - 1, -1, -1) if still_open[name] else ():
                if page.tag[stack[k]] == name:
                    close(k)
                    break
            if name in _BLOCKS:
                page.texts.append((stack[-1] if stack else -1, " "))
            continue
        if name in _RAW:
            stop = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
            at = at if attributes.endswith("/") else stop.end() if stop else len(html)
            continue
        if name in _BLOCKS:
            page.texts.append((stack[-1] if stack else -1, " "))
        if name in _VOID:
            continue
        closed, unless = _CLOSES.get(name, (_P if name in _BLOCKS else (), _SCOPE))
        for k in range(len(stack) - 1, -1, -1) if any(still_open[c] for c in closed) else ():
            if page.tag[stack[k]] in closed:
                close(k)
                break
            if page.tag[stack[k]] in unless:
                break
        words, classes, first, hidden = _named(attributes) if attributes else (set(), set(), "", False)
        inside = still_open["article"] > 0
        within = bool(stack) and page.within[stack[-1]]
        whole = name in ("html", "body", "article", "main")
        skip = bool(stack) and page.skip[stack[-1]] or hidden or name in _BOILERPLATE
        if not whole or (name == "article" and not words.isdisjoint(("comment", "comments", "related", "promo"))):
            # inside content a name must be boilerplate as a whole: what a page's own sections are called is not
            named = any(map(_says_boilerplate, classes)) and name not in _HEADINGS if within else not words.isdisjoint(_NAMES)
            skip = skip or named or any("role=" + r in words for r in _ROLES)
        if not inside and not whole:
            skip = skip or name == "header" or not words.isdisjoint(_HEADERS)
        page.tag.append(name)
        page.parent.append(stack[-1] if stack else -1)
        page.end.append(0)
        page.label.append(f"{name}.{first}".replace("/", "|") if first else name)
        page.skip.append(skip)
        page.content.append("role=main" in words or name == "main" or not words.isdisjoint(_CONTENT))
        page.within.append(within or inside or name == "article" or page.content[-1])
        if not (attributes.endswith("/") and name not in _BLOCKS):
            stack.append(len(page.tag) - 1)
            still_open[name] += 1
        else:
            page.end[-1] = len(page.tag)
    text(len(html))
    close(0)
    return page


def _clean(parts: list[str]) -> str:
    return " ".join(unescape("".join(parts)).split())


def _sizes(page: Page) -> list[int]:
    """Characters of unskipped text in each element."""
    size = [0] * len(page.tag)
    for node, text in page.texts:
        if node >= 0 and not page.skip[node]:
            size[node] += len(text)
    for node in range(len(size) - 1, -1, -1):
        if page.parent[node] >= 0:
            size[page.parent[node]] += size[node]
    return size


def _own_texts(page: Page) -> list[str]:
    parts = [[] for _ in page.tag]
    for node, text in page.texts:
        if node >= 0:
            parts[node].append(text)
    return [_clean(p) for p in parts]


def aligned(a: Page, b: Page) -> dict[int, int]:
    """Node of `a` -> node of `b` in a largest simple tree matching.

    Elements match if their tags are equal and their parents match; the order of children is kept.
    """
    children = []
    for page in (a, b):
        own = defaultdict(list)
        for node, parent in enumerate(page.parent):
            own[parent].append(node)
        children.append(own)

    def table(x: int, y: int):
        """Gives the pairs of children whose own tables it needs, and in the end the size and the pairs of the matching."""
        left, right = children[0][x], children[1][y]
        size = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
        pairs = {}
        for i, p in enumerate(left):
            for j, q in enumerate(right):
                w = 0
                if a.tag[p] == b.tag[q]:
                    inner, below = (yield p, q) if children[0].get(p) and children[1].get(q) else (0, [])
                    w = 1 + inner
                    pairs[i, j] = w, below
                size[i + 1][j + 1] = max(size[i][j + 1], size[i + 1][j], size[i][j] + w)
        out, i, j = [], len(left), len(right)
        while i and j:
            w, below = pairs.get((i - 1, j - 1), (0, []))
            if w and size[i][j] == size[i - 1][j - 1] + w:
                out.append((left[i - 1], right[j - 1]))
                out += below
                i, j = i - 1, j - 1
            elif size[i][j] == size[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return size[-1][-1], out

    # tables wait on a stack of their own, so trees may be of any depth
    waiting, value = [table(-1, -1)], None
    while waiting:
        try:
            x, y = waiting[-1].send(value)
            waiting.append(table(x, y))
            value = None
        except StopIteration as done:
            waiting.pop()
            value = done.value
    return dict(value[1])


def induce(htmls: list[str]) -> dict:
    """The wrapper of a few pages by aligning all of them: the path of the content element and the template texts in it.

    Pages with the same text are one example. With a single example nothing is known to vary.
    """
    pages, seen = [], set()
    for html in htmls:
        page = parse(html)
        text = _clean([t for _, t in page.texts])
        if text not in seen:
            seen.add(text)
            pages.append(page)
    if len(pages) < 2:
        return {"root": None, "template": []}
    base, others = pages[0], pages[1:]
    own = _own_texts(base)
    agree, vary = defaultdict(int), set()
    for other in others:
        texts = _own_texts(other)
        for x, y in aligned(base, other).items():
            if own[x] and own[x] == texts[y]:
                agree[x] += 1
            elif own[x] or texts[y]:
                vary.add(x)
    mass: dict[int, int] = defaultdict(int)
    for node in range(len(base.tag) - 1, -1, -1):
        if node in vary and not base.skip[node]:
            mass[node] += len(own[node])
        if base.parent[node] >= 0:
            mass[base.parent[node]] += mass[node]
    node = max((k for k, p in enumerate(base.parent) if p < 0), key=lambda k: mass[k], default=-1)
    while node >= 0:
        inner = defaultdict(int)
        for k in range(node + 1, base.end[node]):
            if base.parent[k] == node and base.tag[k] not in _LEAVES:
                inner[k] += mass[k]
        best = max(inner, key=lambda k: (inner[k], -k), default=-1)
        if best < 0 or not inner[best] or inner[best] < SHARE * mass[node]:
            break
        node = best
    if node < 0 or not mass[node] or base.tag[node] in ("html", "body"):
        return {"root": None, "template": []}
    template = [[base.path(k), own[k]] for k in range(node, base.end[node]) if agree[k] + 1 >= AGREE and agree[k] == len(others) and k not in vary]
    return {"root": base.path(node), "template": template}


def _fold(up: int, name: str) -> int:
    """The key of a path one step longer, or of a text at a path."""
    return int.from_bytes(blake2b(up.to_bytes(8, "little", signed=True) + name.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _keys(page: Page) -> list[int]:
    keys: list[int] = []
    for label, parent in zip(page.label, page.parent, strict=True):
        keys.append(_fold(keys[parent] if parent >= 0 else 0, label))
    return keys


def _key(path: str | int) -> int:
    if isinstance(path, int):
        return path
    key = 0
    for label in path.split("/"):
        key = _fold(key, label)
    return key


def observed(page: Page) -> tuple[int, int, list[tuple], list[tuple]] | None:
    """(layout, hash of the text, frames, slots) of a page; None without a frame.

    Frames are the unskipped block elements outside leaves, each path once: (key, key of the frame
    around it or 0, tag). Slots are the distinct texts at paths: (frame, path, text's key, characters,
    1 for the first text of its path).
    """
    keys = _keys(page)
    frames: dict[int, tuple] = {}
    around, leaf = [], []
    for k, parent in enumerate(page.parent):
        up, inside = (around[parent], leaf[parent]) if parent >= 0 else (0, False)
        leaf.append(inside or page.tag[k] in _LEAVES)
        if not leaf[k] and not page.skip[k] and page.tag[k] in _FRAMES:
            frames.setdefault(keys[k], (keys[k], up, page.tag[k]))
            up = keys[k]
        around.append(up)
    if not frames:
        return None
    layout = 0
    for key in sorted(frames):
        layout = _fold(layout, str(key))
    slots, paths = {}, set()
    for k, own in enumerate(_own_texts(page)):
        if own and not page.skip[k]:
            key = _fold(keys[k], own)
            slots.setdefault(key, (around[k], keys[k], key, len(own), int(keys[k] not in paths)))
            paths.add(keys[k])
    whole = _clean([t for k, t in page.texts if k < 0 or not page.skip[k]])
    return layout, _fold(0, whole), list(frames.values()), sorted(slots.values())


def content_frame(frames: list[tuple], mass: dict[int, int]) -> int | None:
    """The key of the innermost frame that holds most of the slots' text, given that right inside each."""
    whole, inner = defaultdict(int), defaultdict(list)
    for key, up, _ in frames:
        inner[up].append(key)
    for key, up, _ in reversed(frames):  # a frame stands behind the one around it
        whole[key] += mass.get(key, 0)
        whole[up] += whole[key]
    tags = {key: tag for key, _, tag in frames}
    node = max(inner[0], key=lambda k: whole[k], default=0)
    while best := max(inner[node], key=lambda k: whole[k], default=0):
        if not whole[best] or whole[best] < SHARE * whole[node]:
            break
        node = best
    return node if whole[node] and tags[node] not in ("html", "body") else None


def _as_page(frames: list[tuple]) -> Page:
    number = {key: k for k, (key, _, _) in enumerate(frames)}
    return Page(tag=[f[2] for f in frames], parent=[number.get(f[1], -1) for f in frames])


def matched_frame(frames: list[tuple], root: int, other: list[tuple]) -> int | None:
    """The frame of `other` that a largest simple tree matching pairs with `root`, one of `frames`."""
    pairs = aligned(_as_page(frames), _as_page(other))
    at = pairs.get([f[0] for f in frames].index(root))
    return None if at is None else other[at][0]


def extract(html: str | None, wrapper: dict | None, several: bool = False) -> str:
    """The main text of a page; empty if it has none.

    Of a page that no wrapper fits the longest article is taken, or all of them if `several`.
    """
    if not html:
        return ""
    page = parse(html)
    size = _sizes(page)
    options = lambda test: [k for k in range(len(page.tag)) if not page.skip[k] and size[k] and test(k)]
    largest = lambda found: [max(found, key=lambda k: (size[k], -k))] if found else []
    roots, dropped = [], set()
    if wrapper and wrapper["root"] is not None:
        keys, root = _keys(page), _key(wrapper["root"])
        roots = options(lambda k: keys[k] == root)
        template = {t if isinstance(t, int) else _fold(_key(t[0]), t[1]) for t in wrapper["template"]} if roots else set()
        if template:
            dropped = {k for k, own in enumerate(_own_texts(page)) if own and _fold(keys[k], own) in template}
    if not roots:
        roots = options(lambda k: page.tag[k] == "article")
        roots = roots if several else largest(roots)
    if not roots:
        roots = largest(options(lambda k: page.content[k])) or largest(options(lambda k: page.tag[k] == "body"))
    if not roots:
        return _clean([t for k, t in page.texts if k < 0 or not page.skip[k]])
    inside, end = [-1] * len(page.tag), 0
    for root in roots:
        inside[max(root, end) : page.end[root]] = [root] * (page.end[root] - max(root, end))
        end = max(end, page.end[root])
    parts, last = [], -1
    for k, t in page.texts:
        if k >= 0 and inside[k] >= 0 and not page.skip[k] and k not in dropped:
            parts += [t] if inside[k] == last else [" ", t]
            last = inside[k]
    return _clean(parts)


_FRAME = pa.struct([("key", pa.int64()), ("up", pa.int64()), ("tag", pa.string())])
_SLOT = pa.struct([("frame", pa.int64()), ("path", pa.int64()), ("slot", pa.int64()), ("chars", pa.int64()), ("first", pa.int64())])
_OBSERVED = (
    "host string, layout long, example long, frames array<struct<key:long,up:long,tag:string>>, "
    "slots array<struct<frame:long,path:long,slot:long,chars:long,first:long>>"
)


def _observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 256):
        rows = []
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if html and (found := observed(parse(html))):
                rows.append((host, *found))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        struct = lambda kind, own: pa.array([[dict(zip(kind.names, x, strict=True)) for x in r] for r in own], pa.list_(kind))
        arrays = [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), struct(_FRAME, columns[3]), struct(_SLOT, columns[4])]
        yield pa.RecordBatch.from_arrays(arrays, ["host", "layout", "example", "frames", "slots"])


def _tuples(frames) -> list[tuple]:
    return [(f["key"], f["up"], f["tag"]) for f in frames]


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, layout, root, template): keys of the content element and of the template texts, from all pages.

    Counts are grouped by text before they are by path and by layout, and a layout's rows are as many
    as a page has elements, so no task gets a host's pages.
    """
    host, _ = host_and_path(F.col("url"))

    @F.udf("long")
    def own_root(frames, masses):
        return content_frame(_tuples(frames), {m["frame"]: m["mass"] for m in masses or ()})

    @F.udf("long")
    def matched_root(frames, root, other):
        return matched_frame(_tuples(frames), root, _tuples(other))

    rows = pages.select(host.alias("host"), "html").mapInArrow(_observed, _OBSERVED)
    own = ["host", "layout"]
    examples = stored(rows.groupBy(*own, "example").agg(F.min("frames").alias("frames"), F.min("slots").alias("slots")))
    each = examples.select(*own, F.explode("slots").alias("s")).select(*own, "s.*")
    texts = each.groupBy(*own, "frame", "path", "slot").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("first").alias("first"))
    texts = stored(texts)
    paths = texts.groupBy(*own, "path").agg(F.sum("first").alias("of"))
    constant = texts.where("n >= 2").join(paths, [*own, "path"]).where(F.col("n") >= CONSTANT * F.col("of"))
    parts = texts.select(*own, "frame", "chars", F.lit(None).cast("long").alias("slot")).union(
        constant.select(*own, "frame", -F.col("chars"), F.when(F.col("n") >= AGREE, F.col("slot"))))
    frames = parts.groupBy(*own, "frame").agg(F.sum("chars").alias("mass"), F.collect_list("slot").alias("template"))
    masses = frames.groupBy(*own).agg(F.collect_list(F.struct("frame", "mass")).alias("masses"), F.flatten(F.collect_list("template")).alias("template"))
    seen = examples.groupBy(*own).agg(F.count("*").alias("n"), F.min("frames").alias("frames"))
    layouts = seen.join(masses, own, "left")
    layouts = stored(layouts.withColumn("root", F.when(F.col("n") >= 2, own_root("frames", "masses"))).drop("masses"))
    known = layouts.where("root is not null")
    first = known.groupBy("host").agg(F.max_by(F.struct("frames", "root", "template"), F.struct("n", "layout")).alias("first"))
    others = layouts.where("root is null").select(*own, "frames").join(first, "host")
    others = others.select(*own, matched_root("first.frames", "first.root", "frames").alias("root"), "first.template")
    return known.select(*own, "root", "template").union(others.where("root is not null"))


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of `pages`.

    Reads `page_id`, `url` and `html`; other columns may have any name. Null and empty html give an
    empty text. Null ids are kept; pages without a host are one host's. Repeated rows are extracted
    again, but count as one example. An empty table gives an empty result.
    """
    host, _ = host_and_path(F.col("url"))
    known = stored(wrappers(pages))

    # keys go to and come from pandas as text, as integers with nulls among them would be rounded
    @F.pandas_udf("string")
    def layout(html: pd.Series) -> pd.Series:
        found = [observed(parse(h)) if h else None for h in html]
        return pd.Series([f and str(f[0]) for f in found], dtype=object)

    @F.pandas_udf("string")
    def texts(html: pd.Series, root: pd.Series, template: pd.Series) -> pd.Series:
        out = []
        for h, r, t in zip(html, root, template, strict=True):
            out.append(extract(h, None if t is None else {"root": int(r), "template": [int(x) for x in t]}, several=True))
        return pd.Series(out, dtype=object)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"), layout("html").cast("long").alias("layout"))
    rows = rows.join(known, ["host", "layout"], "left")
    out = rows.select("page_id", "url", texts("html", F.col("root").cast("string"), "template").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
