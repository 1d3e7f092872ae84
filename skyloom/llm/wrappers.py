"""Main text of web pages by inferred wrappers (union-free regular expressions).

A page is a stream of text slots, each named by the elements around it.  Streams
of one host are aligned one after the other: neighbouring repetitions of any
length become repeated groups, what only some pages have becomes optional, and texts become
slots.  The merge is associative enough to run on partial groups first, so
distinct streams are counted before the shuffle and a large host is merged in
slices.  Every page is then matched against the wrapper of its host, and what the
pages have in a slot of the wrapper decides about it:

* a text that is the same wherever the slot occurs, two of these pages having
  nothing else in common, is template if it is the smaller part of the pages;
* a repeated group of links alone, outside an article, is a menu;
* all other slots are content: they vary, or nothing shows that they are template.

Elements that are never the article (nav, header, footer, aside, form, dialogs, scripts,
adverts and comments by name) are left out; of what is left a page
gives the slots of its article, else of main, of an element named as content, or all.

Edge cases: a null or empty html gives an empty text; a null url has the empty
host; unclosed and stray tags are tolerated, and time does not depend on how deep
elements are nested; repeated rows are extracted each for itself, and count once
as evidence, as near copies do; an empty table gives an empty result; whole pages are read.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import stored, table, text_or_empty
from .textnp import LOWER, SOLID, chunks, owners, shingles, span_hashes, spans

#: Slices in which the streams of one host are merged, one level after the other.
LEVELS = (256, 16, 1)
#: Salts of a host whose wrapper is joined, not broadcast.
SLICES = 16
#: Wrappers of at most so many bytes in all are broadcast, else joined.
BROADCAST_BYTES = 16 << 20
#: Smallest shingle hashes that stand for the text of a page, words of a shingle, and the share
#: of common ones from which two pages are (near) copies.
SKETCH, SHINGLE, COPIES = 16, 3, 0.5
#: A template's text is less than this share of the pages that show it.
TEMPLATE_SHARE = 0.5
#: Share of a menu's text that is links.
LINK_SHARE = 0.9

# Elements by role, and words of class, id and role that mark what is not content.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
RAW = set("script style textarea title xmp noframes".split())
DROPPED = set("head title script style noscript template nav footer aside form button select option textarea iframe object svg canvas audio video dialog menu xmp noframes".split())
MAIN = ("article", "main")
CLOSES = {
    "p": set("p".split()), "li": set("li p".split()), "dt": set("dt dd p".split()), "dd": set("dt dd p".split()),
    "tr": set("tr td th p".split()), "td": set("td th p".split()), "th": set("td th p".split()), "option": set("option".split()),
}
#: Block elements that end an open paragraph.
BLOCKS = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SCOPES = set("article aside section div main nav header footer form table body html ul ol dl blockquote td".split())
NEGATIVE = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments reply replies respond disqus discussion share sharing social "
    "related recommended recommendations teaser teasers newsletter subscribe subscription signup login search pagination pager toolbar widget hidden".split()
)
POSITIVE = set("content article post entry story".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_UNLESS = {"with", "no", "has", "without"}
#: Words after a name's first that say what part of it an element is.
PARTS = set("area bar block body bottom box col column container content group inner item items left link links list main outer panel right row section slot text title top unit wrap wrapper".split())

#: A quote opens a value only after an equals sign; elsewhere it is an ordinary character.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s/=>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*)))?")
_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str) -> str:
    m = _HOST.match(url)
    return m[1].lower() if m else ""


def _negative(name: str) -> bool:
    """Whether a class or id names something that is not content: by its last word, or by its first if the others say which part."""
    words = [w for w in re.split(r"[-_:]+", name) if w]
    if not words or _UNLESS & set(words):
        return False
    return words[-1] in NEGATIVE or (words[0] in NEGATIVE and PARTS.issuperset(words[1:]))


def _label(tag: str, attrs: str) -> tuple[str, bool]:
    """Name of an element in slot paths, and whether its attributes mark it as not content."""
    if not attrs or attrs.isspace():
        return tag, False
    found: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        found.setdefault(m[1].lower(), next((x for x in m.groups()[1:] if x is not None), ""))
    names = re.sub(r"\d+", "", f"{found.get('class', '')} {found.get('id', '')}".lower()).split()
    bad = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in ROLES or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I))
    if tag not in ("html", "body", *MAIN) and not bad:
        bad = any(map(_negative, names))
    elif tag in MAIN:
        bad = bad or any(name.rpartition("-")[2].rpartition("_")[2] in ("comment", "teaser", "related", "ad", "promo") for name in names)
    return (tag + "".join(f".{n}" for n in sorted(set(names))) if names else tag), bad


class _Open:
    """The open elements.  Closing one takes time only for what is closed."""

    def __init__(self) -> None:
        self.items: list[tuple[str, str, str, int]] = []  # tag, label, role inside it, hash of the path
        self.at: dict[str, list[int]] = {}  # places of the open elements of a tag
        self.scopes: list[int] = []
        self.blocks: list[int] = []  # places of elements that are not inline

    def push(self, tag: str, label: str, role: str) -> None:
        i = len(self.items)
        path = self.path() if tag in INLINE else zlib.crc32(f"/{label}".encode("utf-8", "replace"), self.path())
        self.items.append((tag, label, role, path))
        self.at.setdefault(tag, []).append(i)
        if tag in SCOPES:
            self.scopes.append(i)
        if tag not in INLINE:
            self.blocks.append(i)

    def path(self) -> int:
        return self.items[-1][3] if self.items else 0

    def role(self) -> str:
        return self.items[-1][2] if self.items else "o"

    def name(self) -> str:
        """Innermost block with the hash of its path."""
        return f"{self.items[self.blocks[-1]][1]}~{self.path():08x}" if self.blocks else "text"

    def cut(self, i: int) -> None:
        while len(self.items) > i:
            j = len(self.items) - 1
            tag = self.items.pop()[0]
            self.at[tag].pop()
            for places in (self.scopes, self.blocks):
                if places and places[-1] == j:
                    places.pop()

    def inside(self, tag: str) -> int | None:
        """Place of the innermost open element of this tag within the innermost scope (of any, if it is a scope itself)."""
        places = self.at.get(tag)
        if not places or (tag not in SCOPES and self.scopes and self.scopes[-1] > places[-1]):
            return None
        return places[-1]

    def close(self, tag: str) -> None:
        i = self.inside(tag)
        if i is not None and not (tag in INLINE and self.blocks and self.blocks[-1] > i):
            self.cut(i)

    def imply_end(self, tags: set[str]) -> None:
        """End all open elements of these tags within the innermost scope."""
        floor = self.scopes[-1] if self.scopes else -1
        lowest = len(self.items)
        for tag in tags:
            for i in reversed(self.at.get(tag, ())):
                if i < floor or (i == floor and tag not in SCOPES):
                    break
                lowest = min(lowest, i)
        self.cut(lowest)


def slots(page: str) -> list[tuple[str, str, str, int]]:
    """(path, role, text, characters in links) of the text slots in page order.

    role: ``x`` not content by its elements, ``a`` inside an article, ``m`` inside
    a main element, ``c`` inside one named as content, ``o`` other.  Texts are decoded, white space is one space.
    """
    out: list[tuple[str, str, str, int]] = []
    stack, parts = _Open(), []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((stack.name(), stack.role(), text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def take(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw)
        parts.append(text)
        if stack.at.get("a"):
            linked += len(text)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            take(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag not in INLINE:
                flush()
            stack.close(tag)
            continue
        if tag == "br" or (tag in VOID and tag not in ("img", "wbr")):
            flush()
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:
            flush()
            if closes := CLOSES.get(tag, set()) | ({"p"} if tag in BLOCKS else set()):
                stack.imply_end(closes)
        label, bad = _label(tag, m[3] or "")
        role = stack.role()
        if bad or tag in DROPPED or (tag == "header" and role not in ("a", "m")):
            role = "x"
        elif role != "x" and tag == "article":
            role = "a"
        elif role in ("o", "c") and tag == "main":
            role = "m"
        elif role == "o" and tag not in ("html", "body") and POSITIVE & set(re.split(r"[-_:.]+", label)[1:]):
            role = "c"
        if (m[3] or "").endswith("/") and tag not in ("p", "div", "a", "span"):
            continue
        if tag in RAW:
            end = _END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        stack.push(tag, label, role)
    if at < len(page):
        take(page[at:])
    flush()
    return out


def stream_of(found: list[tuple[str, str, str, int]]) -> tuple[str, ...]:
    """Names of the slots of a page."""
    return tuple(f"{f[1]}:{f[0]}" for f in found)


# -- union-free expressions: a list of [unit, least, repeats], unit a list of slot names


def _widths(ids: np.ndarray) -> list[int]:
    """Distances between neighbouring occurrences of a name: the lengths that a repeated unit can have."""
    order = np.argsort(ids, kind="stable")
    same = ids[order][1:] == ids[order][:-1]
    return np.unique(np.diff(order)[same]).tolist()


def placed(stream: list[str]) -> list[list]:
    """The stream with neighbouring repetitions as repeated groups, shortest units first;
    each with the places in the stream of every name of its unit."""
    items = [[[s], 1, False, [[i]]] for i, s in enumerate(stream)]
    width, ids = 0, None
    while True:
        if ids is None:
            known: dict[tuple, int] = {}
            ids = np.array([known.setdefault((tuple(x[0]), x[2]), len(known)) for x in items], dtype=np.int64)
            widths = _widths(ids)
        width = next((w for w in widths if w > width), 0)
        if not width:
            return items
        # how many items from each on equal those one width later
        equal = np.append(ids[width:] == ids[:-width], np.zeros(width, bool))
        ends = np.flatnonzero(~equal)
        if np.diff(ends, prepend=-1).max() <= width:
            continue
        run = ends[np.searchsorted(ends, np.arange(len(ids)))] - np.arange(len(ids))
        out, i = [], 0
        while i < len(items):
            n = int(run[i]) // width + 1
            if n > 1:
                unit = [s for x in items[i : i + width] for s in x[0]]
                again = [[at for x in items[k : k + width] for at in x[3]] for k in range(i, i + n * width, width)]
                out.append([unit, 1, True, [[a for one in at for a in one] for at in zip(*again, strict=True)]])
                i += n * width
            else:
                out.append(items[i])
                i += 1
        items, ids = out, None


def collapse(stream: list[str]) -> list[list]:
    """The expression of one stream: [unit, least, repeats] of its groups."""
    return [x[:3] for x in placed(stream)]


def align(a: list[list], b: list[list]) -> list[list]:
    """One expression for both: common units keep their place, others become optional."""
    x, y = ["\x00".join(u[0]) for u in a], ["\x00".join(u[0]) for u in b]
    out: list[list] = []
    for op, i0, i1, j0, j1 in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if op == "equal":
            out += [[u[0], min(u[1], v[1]), u[2] or v[2]] for u, v in zip(a[i0:i1], b[j0:j1], strict=True)]
        else:
            out += [[u[0], 0, u[2]] for u in (*a[i0:i1], *b[j0:j1])]
    merged: list[list] = []
    for u in out:  # the same unit twice in a row is a repetition
        if merged and merged[-1][0] == u[0]:
            merged[-1] = [u[0], max(merged[-1][1], u[1]), True]
        else:
            merged.append(u)
    return merged


def _places(keys: list[str], wrapper: list[list], names: list[str], strict: bool) -> list[int] | None:
    """Unit of the wrapper for every group of a page, in order; none left out that all pages have, if ``strict``."""
    needed, until = [len(names)] * (len(names) + 1), len(names)
    where: dict[str, list[int]] = {}
    for j in range(len(names) - 1, -1, -1):
        until = j if strict and wrapper[j][1] else until
        needed[j] = until
    for j, name in enumerate(names):
        where.setdefault(name, []).append(j)
    state, steps = [-1], []
    for key in keys:
        step, i, before = {}, 0, None
        for j in where.get(key, ()):
            while i < len(state) and state[i] < j:
                before, i = state[i], i + 1
            if i < len(state) and state[i] == j and wrapper[j][2]:
                step[j] = j
            elif before is not None and needed[before + 1] >= j:
                step[j] = before
        if not step:
            return None
        steps.append(step)
        state = sorted(step)
    at = next((j for j in state if needed[j + 1] == len(names)), None)
    if at is None:
        return None
    out = []
    for step in reversed(steps):
        out.append(at)
        at = step[at]
    return out[::-1]


class Matcher:
    """Matches pages against one wrapper: what stands where in it."""

    def __init__(self, wrapper: str) -> None:
        self.wrapper = json.loads(wrapper)
        self.names = ["\x00".join(u[0]) for u in self.wrapper]
        self.known: dict[tuple[str, ...], list[str | None]] = {}

    def __call__(self, stream: tuple[str, ...]) -> list[str | None]:
        """unit:name of the wrapper for every slot of a page (none: a page the wrapper does not hold)."""
        if stream not in self.known:
            if len(self.known) > 1024:
                self.known.clear()
            groups = placed(list(stream))
            keys = ["\x00".join(g[0]) for g in groups]
            units = _places(keys, self.wrapper, self.names, True) or _places(keys, self.wrapper, self.names, False) or []
            out: list[str | None] = [None] * len(stream)
            for unit, group in zip(units, groups, strict=False):
                for k, at in enumerate(group[3]):
                    for i in at:
                        out[i] = f"{unit}:{k}"
            self.known[stream] = out
        return self.known[stream]


def expression(wrapper: list[list]) -> str:
    """The wrapper as a regular expression over slot names."""
    sign = {(1, False): "", (1, True): "+", (0, False): "?", (0, True): "*"}
    return " ".join(f"({' '.join(f'<{s}>#' for s in u)}){sign[(least, again)]}" for u, least, again in wrapper)


def merge_streams(streams: list[str]) -> str:
    """Wrapper (JSON) of wrappers (JSON), the shortest first, in a fixed order."""
    out: list[list] | None = None
    for s in sorted(set(streams), key=lambda s: (len(s), s)):
        out = json.loads(s) if out is None else align(out, json.loads(s))
    return json.dumps(out or [], separators=(",", ":"), ensure_ascii=False)


def _streams(pages: DataFrame) -> DataFrame:
    """host, name, pages: streams in partial counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, ...], str] = {}
        for b in batches:
            seen: Counter = Counter()
            for url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                stream = stream_of(slots(page))
                if stream not in groups:
                    if len(groups) > 1024:
                        groups.clear()
                    groups[stream] = json.dumps(collapse(list(stream)), separators=(",", ":"), ensure_ascii=False)
                seen[host_of(url), groups[stream]] += 1
            rows = [(*k, n) for k, n in seen.items()]
            kinds = (pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)], ["host", "name", "pages"])

    source = pages.select(text_or_empty(F.col("url")).alias("url"), text_or_empty(F.col("html")).alias("html"))
    return source.mapInArrow(run, "host string, name string, pages bigint")


def _with_wrappers(rows: DataFrame, wrappers: DataFrame) -> DataFrame:
    """``rows`` (url, html and others) with host and the columns of ``wrappers``, null where it has no such host."""
    size = wrappers.agg(F.sum(sum((F.length(F.array_join(c, " ") if c == "template" else c) for c in wrappers.columns if c != "host"), F.lit(0))).alias("b")).first()["b"] or 0
    rows = rows.withColumn("host", F.lower(F.regexp_extract(text_or_empty(F.col("url")), _HOST.pattern, 1)))
    if size * 4 <= BROADCAST_BYTES:
        return rows.join(F.broadcast(wrappers), "host", "left")
    salted = rows.withColumn("slice", F.pmod(F.xxhash64(*(c for c in rows.columns if c != "host")), F.lit(SLICES)))
    return salted.join(wrappers.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))), ["host", "slice"], "left")


def _matchers() -> Callable[[str], Matcher]:
    known: dict[str, Matcher] = {}

    def get(wrapper: str) -> Matcher:
        if wrapper not in known:
            if len(known) > 256:
                known.clear()
            known[wrapper] = Matcher(wrapper)
        return known[wrapper]

    return get


def _page_sketches(texts: list[str]) -> list[list[int]]:
    """The smallest shingle hashes of every text."""
    out: list[list[int]] = []
    for c in chunks(pa.array(texts, pa.string())):
        low = LOWER[c.data]
        s, e = spans(low, SOLID)
        h, own = shingles(span_hashes(low, s, e) if len(s) else np.zeros(0, np.uint64), owners(c, s), c.n, SHINGLE)
        cut = np.searchsorted(own, np.arange(c.n + 1))
        out += [np.unique(h[a:b] >> np.uint64(1))[:SKETCH].astype(np.int64).tolist() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    return out


_SEEN = "host string, slot string, role string, again boolean, lo bigint, hi bigint, first array<bigint>, last array<bigint>, chars bigint, linked bigint, whole bigint"


def _texts(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Of every slot of the wrappers, in partial sums: its role, whether its unit repeats, the smallest and largest
    hash of its text, the smallest and largest sketch of the pages that have it, and characters of
    its texts, of links in them, and of the whole pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matchers()
        for b in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            texts: dict[tuple[str, str], list] = {}
            wrapper = b.column("wrapper").dictionary_encode()
            words = wrapper.dictionary.to_pylist()
            streams = [slots(page) for page in b.column("html").to_pylist()]
            sketches = _page_sketches([" ".join(f[2] for f in found if f[1] != "x") for found in streams])
            for host, found, sketch, code in zip(b.column("host").to_pylist(), streams, sketches, wrapper.indices.to_pylist(), strict=True):
                if not found or code is None:
                    continue
                match = matcher(words[code])
                own: dict[str, list] = {}
                whole = sum(len(f[2]) for f in found if f[1] != "x")
                for slot, (_, role, text, linked) in zip(match(stream_of(found)), found, strict=True):
                    if slot is not None and role != "x":
                        v = own.setdefault(slot, [role, 0, 0, 0])
                        v[1] = zlib.crc32(text.encode("utf-8", "replace") + b"\n", v[1])
                        v[2], v[3] = v[2] + len(text), v[3] + linked
                for slot, (role, h, chars, linked) in own.items():
                    again = match.wrapper[int(slot.split(":")[0])][2]
                    v = texts.setdefault((host, slot), [role, again, h, h, sketch, sketch, 0, 0, 0])
                    v[2], v[3], v[4], v[5] = min(v[2], h), max(v[3], h), min(v[4], sketch), max(v[5], sketch)
                    v[6], v[7], v[8] = v[6] + chars, v[7] + linked, v[8] + whole
            rows = [(*k, *v) for k, v in texts.items()]
            kinds = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)], [x.split()[0] for x in _SEEN.split(", ")])

    rows = _with_wrappers(pages.select("page_id", "url", text_or_empty(F.col("html")).alias("html")), wrappers.select("host", "wrapper"))
    return rows.select("host", "html", "wrapper").mapInArrow(run, _SEEN)


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, pages, wrapper (JSON units), template (unit:name of the slots that are no content) of every host."""
    streams = _streams(pages).groupBy("host", "name").agg(F.sum("pages").alias("pages"))

    def merge(group: pa.Table) -> pa.Table:
        return pa.table({"host": group["host"][:1], "name": pa.array([merge_streams(group["name"].to_pylist())]), "pages": pa.array([sum(group["pages"].to_pylist())], pa.int64())})

    for slices in LEVELS:
        sliced = streams.withColumn("slice", F.pmod(F.xxhash64("name"), F.lit(slices))).select("host", "slice", "name", "pages")
        streams = sliced.groupBy("host", "slice").applyInArrow(merge, "host string, name string, pages bigint")
    whole = stored(streams.select("host", "pages", F.col("name").alias("wrapper")), "wrapper-streams")
    sums = [F.sum(c).alias(c) for c in ("chars", "linked", "whole")]
    seen = _texts(pages, whole).groupBy("host", "slot").agg(F.first("role").alias("role"), F.first("again").alias("again"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("first").alias("first"), F.max("last").alias("last"), *sums)
    union = F.slice(F.array_sort(F.array_union("first", "last")), 1, SKETCH)
    alike = F.size(F.array_intersect(F.array_intersect("first", "last"), union)) >= COPIES * F.size(union)
    constant = (F.col("lo") == F.col("hi")) & ~alike & (F.col("chars") < TEMPLATE_SHARE * F.col("whole"))
    menu = F.col("again") & F.col("role").isin("o", "c") & (F.col("linked") >= LINK_SHARE * F.col("chars"))
    fixed = seen.where(constant | menu).groupBy("host").agg(F.sort_array(F.collect_set("slot")).alias("template"))
    return whole.join(fixed, "host", "left").select("host", "pages", "wrapper", F.coalesce("template", F.array().cast("array<string>")).alias("template"))


def page_text(page: str, match: Matcher | None, template: frozenset[str]) -> str:
    """The main text: what is no template of the article, else of main, of an element named as content, or the rest;
    where the wrapper leaves nothing, all of the first of these."""
    found = slots(page)
    units = match(stream_of(found)) if match and template else [None] * len(found)
    for least in (True, False):
        for role in ("a", "m", "c", "o"):
            if texts := [f[2] for f, unit in zip(found, units, strict=True) if f[1] == role and not (least and unit is not None and unit in template)]:
                return " ".join(texts)
    return ""


def extract(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), text_or_empty(F.col("html")).alias("html"))
    joined = _with_wrappers(rows, wrappers.select("host", "wrapper", "template"))
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matchers()
        for b in batches:
            texts, fixed = [], {}
            wrapper, template = b.column("wrapper").dictionary_encode(), b.column("template")
            words = wrapper.dictionary.to_pylist()
            for row, (page, host, code) in enumerate(zip(b.column("html").to_pylist(), b.column("host").to_pylist(), wrapper.indices.to_pylist(), strict=True)):
                if not page:
                    texts.append("")
                    continue
                if host not in fixed:
                    fixed[host] = frozenset(template[row].as_py() or [])
                texts.append(page_text(page, None if code is None else matcher(words[code]), fixed[host]))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "host", "wrapper", "template").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")


def op4_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, stored(infer_wrappers(pages), "wrappers"))
