"""HTML extraction with wrappers inferred from pages of one host.

A page becomes a stream of text blocks, each with the path of the elements around it. A host's wrapper is a union-free regular
expression over paths: pages are aligned one after the other (and wrappers with wrappers), neighbouring repeats fold into a
repeated group, what one side lacks becomes an optional group, and texts that differ become slots; texts that all pages of the
host share at a place stay constant. Constant texts, seen in LEAST_PAGES different articles or more, are the template's own. Near
copies of one article (by a sketch of the words outside menus, adverts and comments) are one article here, whatever else differs.

The wrapper tells what is text: a page's main text is its blocks at the host's slots, in optional and repeated groups too, wherever
they stand in the page; blocks at its constants are the template's (menus, headers, footers, notices without telling names). Where
constants are half or more of the text in the element that holds all of a page's slots, they belong to its articles and stay; so do
they on a page without any slot. What differs from page to page and yet is no article, such as an advert or a reader's comment, is
a slot for the wrapper; there element names, roles, classes and ids break the tie, and on hosts of too few pages to tell constants.

Tasks fold the pages they have into one wrapper for each host, and the few wrappers of a host are folded again, first in salted
groups; a host with a third of all pages is so no large group. What extraction needs (the constant texts of each host) is
broadcast if its size, which is checked, is within BROADCAST_BYTES; beyond it is joined by host.

A null or empty html gives an empty text; a null url has the empty host. Broken markup, also a page that ends inside a tag, is read as
far as it goes, and pages of any length are read whole. Repeated pages are extracted one by one and are aligned once; aligning one
again changes nothing. An empty table gives no rows.
"""

from __future__ import annotations

import html
import pickle
import re
import zlib
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropcube.llm.shared import Scratch
from cropcube.llm.url_rules import host_path
from cropcube.session import ship

LEAST_PAGES = 4
#: Distinct articles that an item of a wrapper remembers, to tell that there are enough of them.
SUPPORT = 6
#: Words of a shingle, and shingles that a page's sketch keeps.
SHINGLE = 3
SKETCH = 16
#: Hosts whose wrappers a task holds at once, hashes of a host's pages that it knows to be aligned, and longest repeated group of blocks.
HELD_HOSTS = 4000
SEEN_PAGES = 1000
PERIOD = 4
BROADCAST_BYTES = 32 << 20
SALTS = 32

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea|select|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/a-zA-Z][^>]*(?:>|\Z)|([^<]+|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-zA-Z:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.S)
# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
DROPPED = frozenset("nav header footer aside form button dialog menu head fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar note".split())
CLOSES = {  # an open tag ends an open element of these before it
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
#: Words of classes and ids of what is not the article.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|comments?|commentlist|disqus|replies|respond"
    r"|sidebar\w*|side|widgets?|related|recommend\w*|share|sharing|social|menus?|nav|navbar|navigation|breadcrumbs?|footer|masthead|newsletter|subscri\w*|signup|login|skip|pagination|pager|toolbar|outbrain|taboola)(?:$|[\s_-])",
    re.I,
)
SPACE = re.compile(r"\s+")


class Block:
    """A text with the path of elements around it (``!`` behind those that hold no article text) and their numbers in the page."""

    __slots__ = ("path", "text", "links", "owner")

    def __init__(self, path: str, text: str, links: int, owner: tuple[int, ...]):
        self.path, self.text, self.links, self.owner = path, text, links, owner


def blocks_of(source: str) -> list[Block]:
    """The page's blocks in order: text between block elements, white space as one space, references decoded."""
    out: list[Block] = []
    # element: (tag, signature, number)
    stack: list[tuple[str, str, int]] = []
    text: list[str] = []
    links = [0]
    serial = 0

    def flush():
        if text:
            joined = SPACE.sub(" ", "".join(text)).strip()
            if joined:
                around = [e for e in stack if e[0] not in INLINE or e[1].endswith("!")]
                out.append(Block("/".join(e[1] for e in around), joined, links[0], tuple(e[2] for e in around)))
            text.clear()
            links[0] = 0

    for m in TOKEN.finditer(source):
        words = m[5]
        if words is not None:
            decoded = html.unescape(words) if "&" in words else words
            text.append(decoded)
            if any(e[0] == "a" for e in stack):
                links[0] += len(decoded)
            continue
        tag = m[3]
        if tag is None:  # comments, declarations, and elements whose content is no text
            continue
        tag = tag.lower()
        if m[2]:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if tag not in INLINE:
                flush()
            if at is None:
                continue
            if tag in INLINE and any(e[0] not in INLINE for e in stack[at:]):
                continue  # it would close blocks inside it
            if tag in INLINE and any(e[1].endswith("!") for e in stack[at:]):
                flush()
            del stack[at:]
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in INLINE:
            flush()
            ends = CLOSES.get(tag, set()) | {"p"}
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in ends or stack[k][0] not in INLINE), None)
            while at is not None and stack[at][0] in ends:
                del stack[at:]
                at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in ends or stack[k][0] not in INLINE), None)
        attrs = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in ATTRIBUTE.finditer(m[4] or "")} if m[4] else {}
        if tag in VOID or (m[4] and m[4].rstrip().endswith("/") and tag not in INLINE and tag not in ("div", "p")):
            continue
        serial += 1
        named = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
        role = attrs.get("role", "").lower()
        dropped = (
            tag in DROPPED or role in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true"
            or "display:none" in attrs.get("style", "").replace(" ", "").lower() or bool(named and tag not in ("html", "body", "main") and NAMES.search(named))
        )
        classes = "." + ".".join(sorted(attrs["class"].replace("/", "").replace("!", "").split())) if attrs.get("class") else ""
        if dropped and tag in INLINE:
            flush()
        stack.append((tag, f"{tag}{classes}{'!' if dropped else ''}", serial))
    flush()
    return out


# ---- wrappers


class Item:
    """A group of paths at a place of the wrapper. ``common``: texts that every page has there; ``pages``: sketches of some that have
    it, no two of one article."""

    __slots__ = ("paths", "common", "pages", "optional", "repeated")

    def __init__(self, paths, common, pages, optional=False, repeated=False):
        self.paths, self.common, self.pages, self.optional, self.repeated = paths, common, pages, optional, repeated


def digest(text: str) -> int:
    return hash_64(text.encode("utf-8", "surrogatepass"))


def hash_64(data: bytes) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


def folded(paths: list[str]) -> list[tuple[int, int, int]]:
    """Runs of blocks as groups: (first, period, end); neighbouring repeats of up to PERIOD blocks are one group."""
    out, i, n = [], 0, len(paths)
    while i < n:
        best = (i, 1, i + 1)
        for p in range(1, PERIOD + 1):
            j = i + p
            while j + p <= n and paths[j : j + p] == paths[i : i + p]:
                j += p
            if j > i + p and j > best[2]:
                best = (i, p, j)
        out.append(best)
        i = best[2]
    return out


def page_hash(blocks: list[Block]) -> int:
    return hash_64("\0".join(b.text for b in blocks).encode("utf-8", "surrogatepass"))


def sketch_of(blocks: list[Block]) -> tuple[int, ...]:
    """The least hashes of the shingles of a page's text, without the blocks that hold no article text or are links."""
    words = " ".join(b.text for b in blocks if "!" not in b.path and 2 * b.links <= len(b.text)).split()
    grams = (" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1)))
    return tuple(sorted({zlib.crc32(g.encode("utf-8", "surrogatepass")) for g in grams})[:SKETCH])


def near(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Near copies: half of the shingles of both together, or more, are in both (estimated from the sketches)."""
    x, y = set(a), set(b)
    least = sorted(x | y)[:SKETCH]
    return 2 * sum(h in x and h in y for h in least) >= len(least)


def articles(a: frozenset[tuple[int, ...]], b: frozenset[tuple[int, ...]]) -> frozenset[tuple[int, ...]]:
    """``a`` and what of ``b`` is no near copy, up to SUPPORT."""
    if len(a) >= SUPPORT or b <= a:
        return a
    out = list(a)
    for x in sorted(b):
        if len(out) < SUPPORT and not any(near(x, y) for y in out):
            out.append(x)
    return frozenset(out)


def wrapper_of(blocks: list[Block]) -> list[Item]:
    paths = [b.path for b in blocks]
    page = sketch_of(blocks)
    return [
        Item(tuple(paths[a : a + p]), frozenset(digest(b.text) for b in blocks[a:e]), frozenset([page]), False, e > a + p)
        for a, p, e in folded(paths)
    ]


def merged(a: list[Item], b: list[Item]) -> list[Item]:
    """Align two wrappers: equal groups meet (their differing texts become slots), the others become optional."""
    if not a or not b:
        return a or b
    out: list[Item] = []
    both: dict[tuple, frozenset] = {}  # most items have the same pages
    for op, i, j, k, m in SequenceMatcher(None, [x.paths for x in a], [x.paths for x in b], autojunk=False).get_opcodes():
        if op == "equal":
            for x, y in zip(a[i:j], b[k:m], strict=True):
                pages = both.get((x.pages, y.pages))
                if pages is None:
                    pages = both[x.pages, y.pages] = articles(x.pages, y.pages)
                out.append(Item(x.paths, x.common & y.common, pages, x.optional or y.optional, x.repeated or y.repeated))
        else:
            for x in (*a[i:j], *b[k:m]):
                out.append(Item(x.paths, x.common, x.pages, True, x.repeated))
    return out


def expression(wrapper: list[Item]) -> str:
    """The wrapper as a regular expression over paths: groups, + for repeats, ? for optional ones, #text for slots."""
    return " ".join(f"({' '.join(w.paths)}{'' if w.common else ' #text'}){'+' if w.repeated else ''}{'?' if w.optional else ''}" for w in wrapper)


def constants(wrapper: list[Item]) -> set[int]:
    """Fingerprints of (path, text) that are the template's: shared by all pages that have the place, and by enough of them."""
    return {hash_64(f"{p}\0{t}".encode("utf-8", "surrogatepass")) for w in wrapper if len(w.pages) >= LEAST_PAGES for t in w.common for p in w.paths}


# ---- extraction


def main_text(blocks: list[Block], template: set[int] | frozenset[int] = frozenset()) -> str:
    """The page's blocks at slots; ``template``: the host's constants."""
    shown = [b for b in blocks if "!" not in b.path]
    fixed = [hash_64(f"{b.path}\0{digest(b.text)}".encode("utf-8", "surrogatepass")) in template for b in shown] if template else [False] * len(shown)
    own = [b for b, f in zip(shown, fixed, strict=True) if not f]
    if not own:
        own = shown
    elif any(fixed):
        top = around(own)
        inside = [b for b in shown if b.owner[: len(top)] == top]
        if 2 * sum(len(b.text) for b in own) <= sum(len(b.text) for b in inside):
            own = inside
    return "\n\n".join(b.text for b in own)


def around(blocks: list[Block]) -> tuple[int, ...]:
    """The elements that all blocks are in; of a single one those around its own element."""
    first, last = min(b.owner for b in blocks), max(b.owner for b in blocks)
    n = next((k for k, (x, y) in enumerate(zip(first, last, strict=False)) if x != y), min(len(first), len(last)))
    return first[: min(n, len(first) - 1)] if first else first


def wrappers(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """``(host, wrapper)`` of ``pages`` (columns host, html): pickled items."""

    def fold(batches):
        held: dict[str, list[Item]] = {}
        seen: dict[str, set[int]] = {}
        for batch in batches:
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks = blocks_of(source or "")
                if not blocks:
                    continue
                page = page_hash(blocks)
                if page in seen.setdefault(host, set()):
                    continue
                if len(seen[host]) == SEEN_PAGES:
                    seen[host].clear()
                seen[host].add(page)
                one = wrapper_of(blocks)
                held[host] = merged(held[host], one) if host in held else one
            if len(held) > HELD_HOSTS:
                yield rows(held)
                held, seen = {}, {}
        if held:
            yield rows(held)

    def rows(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([packed(w) for w in held.values()], pa.binary())], ["host", "wrapper"])

    def join(table: pa.Table) -> pa.Table:
        out: list[Item] = []
        for blob in sorted(x.as_py() for x in table.column("wrapper")):
            out = merged(out, unpacked(blob))
        return pa.table({"host": table.column("host").slice(0, 1), "wrapper": pa.array([packed(out)], pa.binary())})

    part = pages.select("host", "html").mapInArrow(fold, "host string, wrapper binary").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    part = part.groupBy("host", "salt").applyInArrow(join, "host string, wrapper binary")
    return scratch.table(part.groupBy("host").applyInArrow(join, "host string, wrapper binary"))


def packed(wrapper: list[Item]) -> bytes:
    return pickle.dumps([(w.paths, sorted(w.common), sorted(w.pages), w.optional, w.repeated) for w in wrapper])


def unpacked(blob: bytes) -> list[Item]:
    return [Item(p, frozenset(c), frozenset(s), o, r) for p, c, s, o, r in pickle.loads(blob)]


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages``' columns ``keep`` (all if None) and ``text``, ``n_chars``; columns of these names are replaced."""
    spark = pages.sparkSession
    ship(spark)
    scratch = Scratch(spark, "html")
    keep = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_chars")]
    told = pages.select(*[F.col(c) for c in keep], host_path(F.col(url_col))[0].alias("cc_host"), F.col(html_col).cast("string").alias("cc_html"))
    made = wrappers(told.select(F.col("cc_host").alias("host"), F.col("cc_html").alias("html")), scratch)

    def known(batches):
        for batch in batches:
            fixed = [[x - (1 << 64) if x >> 63 else x for x in sorted(constants(unpacked(w.as_py())))] for w in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fixed, pa.list_(pa.int64()))], ["cc_host", "cc_known"])

    template = scratch.table(made.mapInArrow(known, "cc_host string, cc_known array<long>").where(F.size("cc_known") > 0))
    size = template.agg(F.coalesce(F.sum(F.length("cc_host") + 8 * F.size("cc_known") + 64), F.lit(0))).first()[0]
    shared = None
    if size <= BROADCAST_BYTES:
        shared = spark.sparkContext.broadcast({r.cc_host: frozenset(x % (1 << 64) for x in r.cc_known) for r in template.toLocalIterator()})
    else:
        told = told.join(template, "cc_host", "left")

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            hosts, sources = batch.column(at("cc_host")).to_pylist(), batch.column(at("cc_html")).to_pylist()
            if shared is not None:
                fixed = [shared.value.get(h, frozenset()) for h in hosts]
            else:
                fixed = [frozenset(x % (1 << 64) for x in c or ()) for c in batch.column(at("cc_known")).to_pylist()]
            texts = [main_text(blocks_of(s or ""), f) for s, f in zip(sources, fixed, strict=True)]
            texts = [t.encode("utf-8", "replace").decode() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(at(c)) for c in keep] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    schema = T.StructType([pages.schema[c] for c in keep] + T.StructType.fromDDL("text string, n_chars long").fields)
    return told.mapInArrow(run, schema)
