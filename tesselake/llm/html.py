"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: its tags, each told apart by its role (the path of tags and classes down to it), and
its blocks of text, told apart by their place and words. Tokens of a host's pages that occur on the same pages,
equally often on each, form an equivalence class. Pages with the same blocks of text are copies and count as one page.
One commutative signature of the occurrence vector stands for the vector, so it is summed up without gathering a
host's pages. Classes that hold once on a page, on at least half of the host's pages and on LEAST_PAGES of them, are
valid; nested in one another, their tags are the host's template, and what a tag encloses is a slot.

The template decides twice. Which slot holds the article: from the whole page down, the slot that holds more than half
of the words outside links goes before the slots beside it, until none does, or until the next step would leave a
heading that differs from page to page, or an article or main element, behind. And which text is constant: a block of
text of the same class as a tag around it (or as the whole page) fills its slot with the same words wherever the slot is,
so it goes, inside the article as well.

Occurrences can't tell readers' comments, forms or adverts inside the article's slot from the article. There, and on
pages without a template (a host of few pages, or a page without the slot), elements whose tag or role says that they
are no article go; names of classes break ties: an element of such a name goes unless it encloses the article's slot or
an article element, or, where there is none, more than half of the page's text. Without a template, text in article or
main elements goes before other.

Blocks end at block-level tags; character references are decoded, white space inside a block becomes one space,
blocks are joined by an empty line.

Defined cases: null and empty pages give an empty text; broken, unclosed or truncated markup is read as far
as it goes, and elements are told apart however deep they are nested; a page may be of any length; a host of fewer than
LEAST_PAGES different pages has no template; ties between slots go to the smaller token; a null url is a host of its own;
repeated rows are repeated; an empty table gives an empty result; columns other than page_id, url and html are not read,
whatever their names.
"""

from __future__ import annotations

import html as _html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselake.llm.common import Shelf, release, slices

#: Share of a host's pages that a valid class is on.
SUPPORT = 0.5
#: Pages with different texts that a token has to be on before it can be told to be the host's.
LEAST_PAGES = 3
#: Share of a slot's words outside links that a slot in it needs to go before it.
DOMINANT = 0.5
#: The token that each page has once, around all others.
ROOT = 0
#: The lowest bits of a token: a text's; an h1's; an article or main element's.
TEXT, HEADING, ARTICLE = 1, 2, 4

# Element kinds of HTML, and the words that mark what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "object", "math", "canvas", "audio", "video")
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
OUT_TAGS = frozenset("nav footer aside form menu button select dialog fieldset head".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert".split())
OUT_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent notice notices popup modal newsletter subscribe subscription share sharing social comment comments disqus related recommended widget toolbar pagination pager masthead".split())
CONTAINERS = frozenset("div section ul ol dl table tbody tr td details center".split())
NOT_OUT = ("no-", "has-", "with-", "without-", "not-")
CLOSES = {"p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"})}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*)(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+")


def _mark(tag: str, rest: str) -> tuple[str, bool, bool]:
    """A tag's role among its siblings, whether it opens something that isn't article text, and whether its name says so."""
    out, named = tag in OUT_TAGS, False
    if not rest or not rest.strip():
        return tag, out, named
    names = []
    for name, *values in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), (values[0] or values[1] or values[2]).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            out = True
        elif name == "role":
            out |= value in OUT_ROLES
        elif name in ("class", "id") and tag in CONTAINERS:
            named |= any(not OUT_WORDS.isdisjoint(_WORDS.findall(x)) for x in value.split() if not x.startswith(NOT_OUT))
        if name == "class":
            names = sorted(value.split())
    return ".".join([tag, *names]), out, named


def _below(path: int, role: str, tag: str) -> int:
    """A path as 62 bits, so that its length doesn't grow with its depth."""
    kind = HEADING if tag == "h1" else ARTICLE if tag in ("article", "main") else 0
    return xxhash.xxh3_64_intdigest(f"{path:x}/{role}") >> 5 << 3 | kind


class Element:
    """An open element: its path, whether it is left out by its tag or role, in an article, in a link, and the innermost one around it (or it) that its name would leave out."""

    __slots__ = ("article", "chars", "encloses", "link", "named", "out", "parent", "path", "tag")

    def __init__(self, tag: str, path: int, parent: Element | None, out: bool, article: bool, link: bool, named: bool):
        self.tag, self.path, self.parent, self.out, self.article, self.link = tag, path, parent, out, article, link
        self.named = self if named else parent.named if parent else None
        self.encloses, self.chars = False, 0


def tokens(page: str):
    """Yields (kind, element, text): kind "open" for a tag, "text" for a run of text, "break" at the end of a block."""
    root = Element("", ROOT, None, False, False, False, False)
    stack = [root]
    opened: dict[str, int] = {}  # elements of each tag on the stack
    at = 0

    def pop():
        tag = stack.pop().tag
        opened[tag] -= 1
        return tag

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield "text", stack[-1], page[at : m.start()]
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if opened.get(tag):
                while pop() != tag:
                    pass
            if tag in BLOCK:
                yield "break", root, ""
            continue
        closed = CLOSES.get(tag)
        while closed and len(stack) > 1 and (stack[-1].tag in closed or stack[-1].tag not in BLOCK and any(s.tag in closed for s in stack[-4:])):
            if pop() in closed:
                break
        top = stack[-1]
        role, out, named = _mark(tag, m["rest"])
        out |= tag == "header" and not top.article
        article = tag in ("article", "main")
        element = Element(tag, _below(top.path, role, tag), top, out or top.out, top.article or article, top.link or tag == "a", named)
        if article:
            _enclose(top)
        yield "open", element, ""
        if tag in BLOCK:
            yield "break", root, ""
        if tag == "br":
            yield "text", top, " "
        if tag not in VOID and not m["rest"].rstrip().endswith("/"):
            opened[tag] = opened.get(tag, 0) + 1
            stack.append(element)
    if at < len(page):
        yield "text", stack[-1], page[at:]


def _enclose(element: Element) -> None:
    """The elements around an article, or around its slot, aren't left out for their names."""
    named = element.named
    while named is not None and not named.encloses:
        named.encloses = True
        named = named.parent.named


def read(page: str, slots: frozenset[int] = frozenset()) -> tuple[list[tuple[Element, str]], dict[int, list[int]], bool]:
    """(innermost element, text) of the blocks that no tag or role leaves out; (parent, count, characters outside links)
    by token of the page; whether one of the slots is there."""
    blocks: list[tuple[Element, str]] = []
    counts = {ROOT: [ROOT, 1, 0]}
    run: list[str] = []
    place, links, there = None, 0, False

    def close():
        nonlocal place, links
        text = " ".join(_html.unescape("".join(run)).split())
        if text:
            blocks.append((place, text))
            counts.setdefault(text_token(place.path, text), [place.path, 0, 0])[1] += 1
            chars, up, seen = max(0, len(text) - links), place, set()
            while up is not None:
                if up.path not in seen:
                    seen.add(up.path)
                    counts[up.path][2] += chars
                up = up.parent
        run.clear()
        place, links = None, 0

    for kind, element, text in tokens(page):
        if kind == "open":
            counts.setdefault(element.path, [element.parent.path, 0, 0])[1] += 1
            if element.path in slots:
                there = True
                _enclose(element)
        elif kind == "break":
            close()
        elif not element.out:
            if place is not None and element.article != place.article:
                close()
            if place is None and not text.isspace():
                place = element
            run.append(text)
            links += len(text) * element.link
    close()
    return blocks, counts, there


def text_token(path: int, text: str) -> int:
    """A block of text in its place."""
    return xxhash.xxh3_64_intdigest(f"{path:x}#{text}".encode("utf-8", "surrogatepass")) >> 2 | TEXT


def extract(page: str | None, template: frozenset[int]) -> str:
    """The data of the article's slot; ``template``: the token of the host's slot that holds the article, and those of its constant texts."""
    if not page:
        return ""
    slots = frozenset(t for t in template if not t & TEXT)
    blocks, _, there = read(page, slots)
    if there:
        inside = {}

        def in_slot(element: Element | None) -> bool:
            if element is None:
                return False
            if id(element) not in inside:
                inside[id(element)] = element.path in slots or in_slot(element.parent)
            return inside[id(element)]

        blocks = [(element, text) for element, text in blocks if in_slot(element)]
    total = sum(len(text) for _, text in blocks)
    for element, text in blocks:
        named = element.named
        while named is not None:
            named.chars += len(text)
            named = named.parent.named
    for_sure = any(element.article and not _left_out(element, total, True) for element, _ in blocks)
    blocks = [(element, text) for element, text in blocks if not _left_out(element, total, for_sure)]
    article = not there and any(element.article for element, _ in blocks)
    return "\n\n".join(text for element, text in blocks if element.article >= article and text_token(element.path, text) not in template)


def _left_out(element: Element, total: int, for_sure: bool) -> bool:
    """Whether the name of an element around leaves this one out; ``for_sure``: there is an article without it."""
    named = element.named
    while named is not None:
        if not named.encloses and (for_sure or 2 * named.chars <= total):
            return True
        named = named.parent.named
    return False


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def deduce(pages: DataFrame, shelf: Shelf, support: float = SUPPORT) -> DataFrame:
    """host, template of each host that has one: the token of the slot that holds the article, and those of its constant texts."""
    some = pages.select(host_of().alias("host"), "html")

    def counts_of(batches):
        release()
        for batch in slices(batches, "html"):
            rows: dict[tuple[str, bytes], tuple[bytes, bytes]] = {}
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                blocks, counts, _ = read(page or "")
                texts = xxhash.xxh3_128_digest("\0".join(t for _, t in blocks).encode("utf-8", "surrogatepass"))
                packed = np.array([(token, *x) for token, x in sorted(counts.items())], np.int64).tobytes()
                row = (xxhash.xxh3_128_digest(packed), packed)
                rows[host, texts] = min(row, rows.get((host, texts), row))
            columns = [*zip(*rows, strict=True), *zip(*rows.values(), strict=True)] if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k else pa.string()) for k, c in enumerate(columns)], names=["host", "texts", "same", "packed"])

    # of copies the tokens of one are counted, whichever comes first by its hash
    different = some.mapInArrow(counts_of, "host string, texts binary, same binary, packed binary").groupBy("host", "texts").agg(F.min(F.struct("same", "packed")).alias("one")).select("host", "texts", F.col("one.packed").alias("packed"))

    def count(batches):
        for batch in batches:
            rows: dict[tuple[str, int, int], list[int]] = {}
            for host, texts, packed in zip(*(batch.column(c).to_pylist() for c in ("host", "texts", "packed")), strict=True):
                for token, parent, n, chars in np.frombuffer(packed, np.int64).reshape(-1, 4).tolist():
                    row = rows.setdefault((host, token, parent), [0, 0, 0, 0])
                    row[0] += 1
                    row[1] += n == 1
                    row[2] += chars
                    row[3] = (row[3] + xxhash.xxh3_64_intdigest(texts, n)) & (1 << 62) - 1
            columns = [*zip(*rows, strict=True), *zip(*rows.values(), strict=True)] if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k else pa.string()) for k, c in enumerate(columns)], names=["host", "token", "parent", "pages", "once", "chars", "vector"])

    counted = different.mapInArrow(count, "host string, token long, parent long, pages long, once long, chars long, vector long").groupBy("host", "token", "parent").agg(F.sum("pages").alias("pages"), F.sum("once").alias("once"), F.sum("chars").alias("chars"), F.sum(F.col("vector").cast("decimal(38,0)")).cast("string").alias("vector"))
    counted = shelf.put(counted.where(F.col("pages") >= LEAST_PAGES), "tokens")
    on = counted.where(F.col("token") == ROOT).select("host", F.col("pages").alias("all_pages"))
    # a tag is on all pages of what it encloses, so the tags around a frequent token are here with it
    often = counted.join(on, "host").where((F.col("pages") >= F.lit(support) * F.col("all_pages")) & ((F.col("token") % 2 == 0) | (F.col("once") == F.col("pages"))))
    classes = often.groupBy("host").agg(F.collect_list(F.struct("token", "parent", "pages", "once", "chars", "vector")).alias("tokens"))

    def enclosed(batches):
        for batch in batches:
            found = [template_of({t["token"]: t for t in tokens}) for tokens in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(found, pa.list_(pa.int64()))], names=["host", "template"])

    return classes.mapInArrow(enclosed, "host string, template array<long>")


def template_of(often: dict[int, dict]) -> list[int]:
    """The slot that holds the article (unless it is the whole page), and the constant texts."""
    fixed = constant(often)
    slot = article_slot(often, {often[t]["parent"] for t in fixed})
    return [slot] * (slot != ROOT) + fixed


def article_slot(often: dict[int, dict], constant_places: set[int]) -> int:
    """From the whole page down, the slot with more than half of the words of the slot around it."""
    tags = {t: x for t, x in often.items() if not t & TEXT and x["once"] == x["pages"]}

    def around(token: int) -> int:
        """The innermost template tag around a token."""
        token = often[token]["parent"]
        while token not in tags:
            token = often[token]["parent"]
        return token

    inside: dict[int, list[int]] = {}
    for t in sorted(tags):
        if t != ROOT:
            inside.setdefault(around(t), []).append(t)
    headings = [t for t in tags if t & HEADING and t not in constant_places]
    slot = ROOT
    while not slot & ARTICLE and slot in inside:
        best = max(inside[slot], key=lambda t: (tags[t]["chars"], -t))
        if tags[best]["chars"] <= DOMINANT * tags[slot]["chars"] or best & HEADING or any(around(h) == slot for h in headings):
            break
        slot = best
    return slot


def constant(often: dict[int, dict]) -> list[int]:
    """The text tokens that have a tag of their own class, or the whole page, around them."""
    found = []
    for token, text in often.items():
        if token & TEXT:
            tag = often[text["parent"]]
            # a tag is on all pages of what it encloses; once it is on more, so are all around it
            while tag["vector"] != text["vector"] and tag["pages"] == text["pages"] and tag["token"] != ROOT:
                tag = often[tag["parent"]]
            if tag["vector"] == text["vector"]:
                found.append(token)
    return sorted(found)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; the templates (a few tokens a host) join the pages."""
    shelf = Shelf(pages.sparkSession, "main-text")
    templates = shelf.put(deduce(pages, shelf), "templates")
    shelf.keep(templates)
    some = pages.select("page_id", "url", "html", host_of().alias("host")).join(templates, "host", "left").select("page_id", "url", "html", "template")

    def texts_of(batches):
        release()
        for batch in slices(batches, "html"):
            known: dict = {}
            texts = []
            for page, template in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist(), strict=True):
                key = tuple(template or ())
                texts.append(extract(page, known.setdefault(key, frozenset(key))))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return some.mapInArrow(texts_of, "page_id long, url string, text string, n_chars long")
