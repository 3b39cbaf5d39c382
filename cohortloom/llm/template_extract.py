"""Main text of web pages by equivalence classes of template tokens.

A token is a tag with its path of open elements (and its class or id), or,
outside of articles, a block of text with its path. Tokens that occur once on a
page, and whose occurrence vectors over a host's pages are the same, form an
equivalence class. A class is valid if it has CLASS_SIZE tokens or more on SUPPORT
of the host's different pages or more; its tokens have one order, and on a page
where they stand in another the class is not used. Classes nest: each one lies in
a slot of the class around it, and one whose tokens lie in several slots is cut
up by slot. The classes with their order and nesting are the host's template.

A slot is what an element of the template holds outside of those below it. For
each slot the host's pages tell how much of it is text that changes, how much is
links, and how much lies in article elements. From the top of the template down,
the element that holds DOMINANT of the changing text of the one above it is
followed to where the text divides; slots in there are the article, but for lists
of links and what is marked as boilerplate. Other slots that change, such as an
advert or a footer that names the page, are part of it only if they hold
BESIDE as much. Where a host has article elements, the article is what changes in
them. A page's text is what its blocks in such slots say. Inside of articles a doubtful name (`share`, `related`, ...) tells
boilerplate only where the element belongs to the template; names of comments,
adverts and menus always do.

Occurrence vectors are never gathered: each page adds a hash of (page, count)
to a sum for each token, and equal sums (with equal support and total) mean
equal vectors. A host with a third of all pages therefore shuffles as one row
for each token and task.

Equal tags below one element play different roles. So div and section elements without class or id are told apart by their
number among those of their kind below one element, as their neighbours have it on the host's other pages.

Pages of a host with equal html count as one page of it, so that copies do not make their own text template. Paths of over
64 elements are their first 40 characters and a 64-bit hash.

Rules: null html is empty text. Repeated rows and repeated page_ids are pages of
their own in the result. A page without url or host, of a host with one page, or
that has nothing in the host's article slots goes by its elements and their names
alone: what article elements hold, or else all that is no boilerplate.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Container, Iterator
from itertools import pairwise
from typing import NamedTuple
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, as_batch, blocks, cut, filled, text_of, tidy

#: Share of a host's pages that a class must reach, the fewest different pages that a host with a template, or a token of one, has, and the fewest tokens of a class.
SUPPORT, LEAST_PAGES, CLASS_SIZE = 0.5, 2, 2
#: Share of an element's changing text that makes a child the article's place; text beside that place, against the text in it, that counts as well.
DOMINANT, BESIDE = 0.6, 0.3
#: Elements that are parts of a text and not its place.
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd pre blockquote figure figcaption caption hgroup address details summary".split())
#: Elements that are numbered among their kind.
ROLES = frozenset(["div", "section"])
#: A slot is a list of links if it has so many blocks of links a page, with this share of its text.
LINKS_A_PAGE, LINKED = 3, 0.8
#: Bytes of all templates up to which they are sent to every task; beyond, pages are joined to them by host.
BROADCAST_BYTES = 8 << 20

ATTRIBUTES = r"(?:\"[^\"]*\"|'[^']*'|[^'\">])*"
#: Comments; elements whose text is never shown, to the end if they are not closed; such elements if they are closed; declarations; tags.
TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|title|textarea|iframe|noscript|noframes|xmp)\b{ATTRIBUTES}>.*?(?:</\1\s*>|\Z)"
    rf"|<(template|svg|math|select|object|canvas|datalist|audio|video)\b{ATTRIBUTES}>.*?</\2\s*>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({ATTRIBUTES})>",
    re.DOTALL | re.IGNORECASE,
)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
SPACE = re.compile(r"\s+")
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text runs on with that around them; all others, and br, end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that hold no article text, and those that hold none unless an article is inside them.
ASIDE, WRAPPERS = frozenset("nav footer aside dialog menu button".split()), frozenset(["form"])
#: How sure a part is boilerplate: not; by a wrapper or a name outside of an article; by an element or a name inside one.
NOT, WEAK, SURE = 0, 1, 2
#: Elements that may be open at once; those beyond belong to the last of them, as in browsers.
DEPTH = 512
#: Words in a class, id or role that tell a part of the page that is no article.
SIGNS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr newsletter subscribe subscription "
    "sidenav menu nav navbar navigation toolbar topbar copyright comment comments commentlist disqus respond reply replies complementary contentinfo".split()
)
#: Such words that articles use in names of their own as well. Inside of one they count where the host's template has the element, or where there is no template.
DOUBTFUL = frozenset("promo promotion banner notice notification alert popup modal overlay discussion share sharing social related recommended widget login signup search searchbox pagination pager skip".split())
#: The same for beginnings and ends of words, and words that tell it only outside of an article, where they are titles.
SIGN_STARTS, SIGN_ENDS = ("advert", "sponsor", "cookie", "sidebar", "breadcrumb", "newsletter"), ("nav", "menu", "footer", "sidebar")
HEADS = frozenset("header masthead".split())
MAIN = frozenset("article main".split())
#: A new one of these ends the open one of the left side.
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Those that end an open paragraph.
BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


def host_of(url: str | None) -> str | None:
    try:
        return (urlsplit(url).hostname or "").removeprefix("www.") or None if url else None
    except ValueError:
        return None


def signs_of(attributes: str, inside: bool = False) -> tuple[str, bool, bool, bool]:
    """The element's class and id as a short label; whether they tell boilerplate (inside: of an article), or do so if the template agrees; whether the role is main or article."""
    label, off, doubt, main = [], False, False, False
    for name, value in NAMED.findall(attributes):
        value = value.strip("\"'").lower()
        words = re.split(r"[^a-z0-9]+", value)
        if name.lower() in ("class", "id"):
            label.append(value.replace("=", "~").replace("/", "|"))
        if name.lower() == "role":
            main = main or value in MAIN
        off = off or not SIGNS.isdisjoint(words) or not inside and not HEADS.isdisjoint(words) or any(w.startswith(SIGN_STARTS) or w.endswith(SIGN_ENDS) for w in words)
        doubt = doubt or not DOUBTFUL.isdisjoint(words)
    return ".".join(label), off or doubt and not inside, doubt and inside, main


class Block(NamedTuple):
    """A block of text: the path of its element; whether it is in an article and in boilerplate; the outermost element of an article around it with a doubtful name; how much is links; the tag tokens before it."""

    path: str
    text: str
    main: bool
    off: int
    doubt: str
    linked: int
    place: int


def parse(page: str) -> tuple[list[str], list[Block]]:
    """The tag tokens of a page in order, and its text blocks."""
    tokens: list[str] = []
    out: list[Block] = []
    stack: list[tuple[str, str, bool, int, str, dict[str, int]]] = []  # element, path, in an article, in boilerplate, doubtful element, numbered elements below
    top: dict[str, int] = {}
    text: list[str] = []
    links = linked = 0  # open links; characters in links of the block
    at = 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = SPACE.sub(" ", entities.unescape("".join(text))).strip()
            text.clear()
            if joined:
                path, main, off, doubt = stack[-1][1:5] if stack else ("", False, NOT, "")
                out.append(Block(path, joined, main, off, doubt, min(linked, len(joined)), len(tokens)))
        linked = 0

    def close(depth: int) -> None:
        nonlocal links
        flush()
        links -= sum(x[0] == "a" for x in stack[depth:])
        del stack[depth:]

    for m in TAG.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
            linked += (m.start() - at) * (links > 0)
        at = m.end()
        name = (m[4] or "").lower()
        if not name:
            if hidden := m[1] or m[2]:
                tokens.append(f"{stack[-1][1] if stack else ''}/{hidden.lower()}")
            continue
        if name not in INLINE:
            flush()
        if m[3]:
            depth = next((i for i in reversed(range(len(stack))) if stack[i][0] == name), None)
            if depth is not None and not (name in INLINE and any(x[0] in BLOCKS for x in stack[depth + 1 :])):
                if name not in INLINE:
                    close(depth)
                else:
                    links -= name == "a"
                    del stack[depth]
            continue
        if name in VOID or len(stack) >= DEPTH:
            continue
        ends = CLOSES.get(name, set()) | ({"p"} if name in BLOCKS else set())
        for i in reversed(range(len(stack))):
            if stack[i][0] in ends:
                close(i)
                break
            if stack[i][0] not in INLINE:
                break
        if name in INLINE:
            # inline elements keep the state of what holds them
            links += name == "a"
            stack.append((name, *(stack[-1][1:] if stack else ("", False, NOT, "", top))))
            continue
        above = stack[-1] if stack else ("", "", False, NOT, "", top)
        label, signed, doubtful, main = signs_of(m[5], above[2]) if m[5].strip() else ("", False, False, False)
        main = above[2] or name in MAIN or main
        off = above[3]
        if name in ASIDE:
            off = SURE
        elif name not in ("html", "body", *MAIN) and (signed or name in WRAPPERS or name == "header" and not main):
            off = max(off, SURE if main and name != "form" or main and above[2] else WEAK)
        path = f"{above[1]}/{name}" + (f"#{label}" if label else "")
        if name in ROLES and not label:
            above[5][name] = above[5].get(name, 0) + 1
            path += f"[{above[5][name]}]" if above[5][name] > 1 else ""
        if path.count("/") > 64:
            path = f"{path[:40]}~{xxhash.xxh64_hexdigest(path)}"
        tokens.append(path)
        stack.append((name, path, main, off, above[4] or (path if doubtful and name not in MAIN else ""), {}))
    if at < len(page):
        tail = page[at:]
        text.append(tail[: cut_at] if (cut_at := tail.rfind("<")) >= 0 and re.match(r"<[a-zA-Z/!]", tail[cut_at:]) and ">" not in tail[cut_at:] else tail)
    flush()
    return tokens, out


def text_token(path: str, text: str) -> str:
    return f"{path}={xxhash.xxh64_hexdigest(text)}"


MEASURES = "support total vector low high place chars linked inside links off".split()
COUNTED = pa.schema([("host", pa.string()), ("token", pa.string()), *((m, pa.int64()) for m in MEASURES)])


def host_column(url: str) -> Column:
    @F.pandas_udf("string")
    def host(urls: pd.Series) -> pd.Series:
        return urls.map(host_of)

    return host(url)


def without_copies(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest of the pages; of those of a host with the same html, only one of the smallest page_id."""
    wanted = pages.select("page_id", "url", "html", F.xxhash64(text_of("html")).alias("digest"))
    hosts = wanted.select("digest", host_column("url").alias("host")).where("host IS NOT NULL")
    copies = cut(hosts.groupBy("host", "digest").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    small = copies.agg(F.coalesce(F.sum(F.octet_length("host") + 32), F.lit(0))).first()[0] <= BROADCAST_BYTES
    digests = copies.select("digest").distinct()
    digests, copies = (F.broadcast(digests), F.broadcast(copies)) if small else (digests, copies)
    # most pages are no copies, and need no host for that
    joined = wanted.join(digests, "digest", "left_semi").withColumn("host", host_column("url")).join(copies, ["host", "digest"], "left")
    # a task keeps one row of each group, so copies of any number are few rows
    of_many = joined.where("copies IS NOT NULL").groupBy("host", "digest").agg(F.min(F.struct(F.col("page_id").isNull(), "page_id", "url")).alias("at"), F.first("html").alias("html"))
    columns = ["page_id", "url", "html", "digest"]
    return wanted.join(digests, "digest", "left_anti").select(columns).unionByName(joined.where("copies IS NULL").select(columns)).unionByName(of_many.select("at.page_id", "at.url", "html", "digest"))


def token_sums(pages: DataFrame) -> DataFrame:
    """Sums of a host's tokens over all pages: host, token and MEASURES.

    support: pages with it; total: how often; vector: sum of hashes of (page, count), modulo 2**62; low and high: digests of
    pages with it; place: sum of twice the tag tokens up to it (text: even, tags: odd); and of the text right inside it: chars, and those in links (linked), in
    articles (inside) and in boilerplate (off); links: blocks of links. Each task adds up its own pages of a host first. The token '' counts pages.
    """

    def measured(page: str) -> dict[str, list[int]]:
        """token to [count, place, chars, linked, inside, links, off] of a page."""
        tokens, out = parse(page)
        found: dict[str, list[int]] = {}
        for place, t in enumerate(tokens):
            found.setdefault(t, [0, 2 * place + 1, 0, 0, 0, 0, 0])[0] += 1
        for x in out:
            own = found.setdefault(x.path or "/", [0, 0, 0, 0, 0, 0, 0])
            for i, n in ((2, len(x.text)), (3, x.linked), (4, len(x.text) * x.main), (5, int(2 * x.linked > len(x.text))), (6, len(x.text) * (x.off != NOT))):
                own[i] += n
            if not x.main:
                own = found.setdefault(text_token(x.path, x.text), [0, 2 * x.place, 0, 0, 0, 0, 0])
                own[0] += 1
                own[2] += len(x.text)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "html", BLOCK_BYTES // 2):
            sums: dict[tuple[str, str], list[int]] = {}
            for key, url, page, digest in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), filled(b.column("html")).to_pylist(), b.column("digest").to_pylist(), strict=True):
                if host := host_of(url):
                    for token, (n, *more) in [("", [1, 0, 0, 0, 0, 0, 0]), *measured(page).items()]:
                        own = sums.setdefault((host, token), [0, 0, 0, digest, digest, 0, 0, 0, 0, 0, 0])
                        own[0] += 1
                        own[1] += n
                        own[2] = (own[2] + xxhash.xxh64_intdigest(f"{key}:{n}")) & (1 << 62) - 1
                        own[3], own[4] = min(own[3], digest), max(own[4], digest)
                        for i, v in enumerate(more, 5):
                            own[i] += v
            yield as_batch(COUNTED, [h for h, _ in sums], [t for _, t in sums], *([v[i] for v in sums.values()] for i in range(len(MEASURES))))

    counted = without_copies(pages).mapInArrow(tidy(run), "host string, token string, " + ", ".join(f"{m} long" for m in MEASURES))
    added = {m: F.sum(m) for m in MEASURES} | {"vector": F.expr("cast(sum(cast(vector as decimal(38,0))) % 4611686018427387904 as bigint)"), "low": F.min("low"), "high": F.max("high")}
    return counted.groupBy("host", "token").agg(*(f.alias(m) for m, f in added.items()))


def holder_of(path: str, among: Container[str], own: bool = False) -> str:
    """The nearest element around the token (own: or itself) that is among the given paths; '' if there is none."""
    text = "=" in path
    at = path.rpartition("=")[0] if text else path if own else path.rpartition("/")[0]
    while at and at not in among:
        at = at.rpartition("/")[0]
    return at


def nested(tokens: list[tuple[str, int, int, int]]) -> list[tuple[str, list[str]]]:
    """The classes of one host as (the element of another class whose slot it lies in, tokens in order), larger support first.

    tokens: (token, support, vector, place) of all that occur once a page on enough pages.
    """
    by: dict[tuple[int, int], list[tuple[int, str]]] = {}
    for token, support, vector, place in tokens:
        by.setdefault((-support, vector), []).append((place, token))
    out: list[tuple[str, list[str]]] = []
    around: set[str] = set()
    for _, own in sorted(by.items()):
        own.sort()
        inside = {t for _, t in own if "=" not in t}
        slots: dict[str, list[str]] = {}
        for _, t in own:
            top = t
            while (up := holder_of(top, inside)) and up != top:
                top = up
            slots.setdefault(holder_of(top, around), []).append(t)
        valid = [(holder, ts) for holder, ts in slots.items() if len(ts) >= CLASS_SIZE]
        out += valid
        around |= {t for _, ts in valid for t in ts if "=" not in t}
    return out


def article_place(text: dict[str, int]) -> str:
    """The element in which the article is. text: how much changing text each slot has."""
    below: dict[str, int] = {}
    for path, chars in text.items():
        while path:
            below[path] = below.get(path, 0) + chars
            path = path.rpartition("/")[0]
    here, total = "", sum(text.values())
    while True:
        inside = [p for p in below if p.rpartition("/")[0] == here and re.split(r"\W", p.rpartition("/")[2])[0] not in PARTS]
        best = max(inside, key=lambda p: (below[p], p), default=None)
        if best is None or below[best] < DOMINANT * total:
            return here
        here, total = best, below[best]


def article_slots(slots: dict[str, list[int]], n_pages: int) -> list[str]:
    """Elements whose slots are the article. slots: of each element of the template [chars besides the template's own text, linked, inside, links, off] over the host's pages."""
    changing = {k: v for k, v in slots.items() if v[0] > 0 and 2 * v[4] <= v[0]}
    pool = {k: v for k, v in changing.items() if 2 * v[2] > v[0]}
    if not pool and changing:
        text = {k: max(0, v[0] - v[1]) for k, v in changing.items()}
        place = article_place(text)
        most = sum(n for k, n in text.items() if f"{k}/".startswith(f"{place}/"))
        pool = {k: v for k, v in changing.items() if f"{k}/".startswith(f"{place}/") or text[k] >= BESIDE * most}
    if not pool:
        return []
    most = max(pool, key=lambda k: (pool[k][0] - pool[k][1], k))
    return sorted(k for k, v in pool.items() if k == most or not (v[3] >= LINKS_A_PAGE * n_pages and v[1] > LINKED * v[0]))


TEXTS = "chars linked inside links off".split()
CLASSES = "host string, n_pages long, classes array<struct<holder:string,tokens:array<string>>>"
PREFIXES = "transform(sequence(1, size(split(token, '/')) - 1), i -> concat_ws('/', slice(split(token, '/'), 1, i + 1)))"


def templates(pages: DataFrame) -> DataFrame:
    """host, n_pages, classes (holder, tokens in order) and slots (elements whose slots are the article), one row a host that has a template.

    A class has fewer than (tokens of a page) / SUPPORT tokens in all, so a host's row is bounded by its pages' markup. Elements with
    text, of which a host may have any number, meet by the element of the template that holds them.
    """
    sums = cut(token_sums(pages))
    hosts = sums.where("token = ''").select("host", F.col("total").alias("n_pages")).where(F.col("n_pages") >= LEAST_PAGES)
    wide = sums.where("token != ''").join(hosts, "host")
    once = wide.where((F.col("total") == F.col("support")) & (F.col("support") >= F.greatest(F.lit(LEAST_PAGES), F.ceil(SUPPORT * F.col("n_pages")))) & (F.col("low") != F.col("high")))

    def nest(pdf: pd.DataFrame) -> pd.DataFrame:
        classes = nested(list(zip(*(pdf[c].tolist() for c in ("token", "support", "vector", "place")), strict=True)))
        tags, chars = {t for _, ts in classes for t in ts if "=" not in t}, dict(zip(pdf["token"], pdf["chars"].tolist(), strict=True))
        fixed = [{"slot": holder_of(t, tags), "chars": chars[t]} for _, ts in classes for t in ts if "=" in t]
        return pd.DataFrame({"host": pdf["host"][:1], "n_pages": pdf["n_pages"][:1], "classes": [[{"holder": h, "tokens": ts} for h, ts in classes]], "fixed": [fixed]})

    found = cut(once.groupBy("host").applyInPandas(nest, f"{CLASSES}, fixed array<struct<slot:string,chars:long>>").where("size(classes) > 0"))
    tags = found.select("host", F.explode(F.flatten("classes.tokens")).alias("slot")).where("NOT contains(slot, '=')")
    texts = wide.where("chars > 0 AND NOT contains(token, '=')").select("host", "token", *TEXTS)
    holders = texts.select("host", "token", F.explode(F.expr(PREFIXES)).alias("slot")).join(tags, ["host", "slot"]).groupBy("host", "token").agg(F.max_by("slot", F.length("slot")).alias("slot"))
    slots = texts.join(holders, ["host", "token"], "left").groupBy("host", F.coalesce("slot", F.lit("")).alias("slot")).agg(*(F.sum(c).alias(c) for c in TEXTS))
    by_host = slots.groupBy("host").agg(F.collect_list(F.struct("slot", *TEXTS)).alias("texts"))  # one entry an element of the template

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for n_pages, texts_, fixed in zip(pdf["n_pages"], pdf["texts"], pdf["fixed"], strict=True):
                own = {r["slot"]: [int(r[c]) for c in TEXTS] for r in (texts_ if texts_ is not None else ())}
                for r in fixed:
                    if r["slot"] in own:
                        own[r["slot"]][0] -= int(r["chars"])
                out.append(article_slots(own, int(n_pages)))
            yield pdf[["host", "n_pages", "classes"]].assign(slots=out)

    return found.join(by_host, "host", "left").mapInPandas(pick, f"{CLASSES}, slots array<string>")


class Template:
    """A host's classes and article slots, ready to be laid on pages."""

    def __init__(self, classes: list[tuple[str, list[str]]], slots: list[str]):
        self.classes, self.slots = classes, frozenset(slots)

    @classmethod
    def of(cls, row) -> Template | None:
        return cls([(c["holder"], c["tokens"]) for c in row["classes"]], row["slots"]) if row is not None and row["classes"] is not None else None

    def on(self, tokens: list[str], out: list[Block]) -> frozenset[str]:
        """The template's tokens on a page: of the classes that are there whole, once a token and in their order, inside their holder."""
        places: dict[str, list[int]] = {}
        for i, t in enumerate(tokens):
            places.setdefault(t, []).append(2 * i + 1)
        for x in out:
            if not x.main:
                places.setdefault(text_token(x.path, x.text), []).append(2 * x.place)
        found: set[str] = set()
        for holder, own in self.classes:
            at = [places.get(t, ()) for t in own]
            if (not holder or holder in found) and all(len(p) == 1 for p in at) and all(p <= q for p, q in pairwise(at)):
                found.update(own)
        return frozenset(found)

    def article(self, tokens: list[str], out: list[Block]) -> list[str] | None:
        """The texts of blocks in article slots; None if the page has none."""
        there = self.on(tokens, out)
        if not there:
            return None
        inside = any(x.main and holder_of(x.path, there, own=True) in self.slots for x in out)
        kept = [
            x.text
            for x in out
            if x.main == inside and x.off == NOT and (not x.doubt or x.doubt not in there) and holder_of(x.path, there, own=True) in self.slots and (x.main or text_token(x.path, x.text) not in there)
        ]
        return kept or None


def main_text(page: str, template: Template | None, counted: list[int] | None = None) -> str:
    """The article of a page, its blocks joined by newlines. counted: gets 1 if the template gave it, else 0."""
    tokens, out = parse(page)
    kept = template.article(tokens, out) if template else None
    if counted is not None:
        counted.append(int(kept is not None))
    if kept is not None:
        return "\n".join(kept)
    out = [x for x in out if not x.doubt]
    for sure in (NOT, WEAK):  # an article inside a wrapper counts if the page has none outside
        article = [x.text for x in out if x.main and x.off == sure]
        if article:
            return "\n".join(article)
    return "\n".join(x.text for x in out if x.off == NOT)


TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_template", pa.int64()), ("by_template", pa.int64())])
TEXT_DDL = "page_id long, url string, text string, n_chars long, n_template long, by_template long"


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_template (tokens of the host's template) and by_template (1 if its slots gave the text) for each row of pages."""
    spark = pages.sparkSession
    found = cut(templates(pages))
    size = found.agg(F.coalesce(F.sum(F.expr("octet_length(to_json(struct(*)))")), F.lit(0))).first()[0]
    wanted = pages.select("page_id", "url", "html")

    def rows(b: pa.RecordBatch, templates_: list[Template | None]) -> pa.RecordBatch:
        by: list[int] = []
        texts = [main_text(x, t, by) for x, t in zip(filled(b.column("html")).to_pylist(), templates_, strict=True)]
        sizes = [sum(len(own) for _, own in t.classes) if t else 0 for t in templates_]
        return as_batch(TEXT, b.column("page_id").cast(pa.int64()), b.column("url"), texts, [len(t) for t in texts], sizes, by)

    if size <= BROADCAST_BYTES:
        by_host = spark.sparkContext.broadcast({r["host"]: r for r in found.collect()})

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[str | None, Template | None] = {}
            for b in blocks(batches, "html"):
                hosts = [host_of(u) for u in b.column("url").to_pylist()]
                for h in hosts:
                    if h not in known:
                        known[h] = Template.of(by_host.value.get(h))
                yield rows(b, [known[h] for h in hosts])

        return wanted.mapInArrow(tidy(local), TEXT_DDL)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "html"):
            classes, slots = b.column("classes").to_pylist(), b.column("slots").to_pylist()
            yield rows(b, [Template.of({"classes": c, "slots": k}) for c, k in zip(classes, slots, strict=True)])

    # the templates' side has one row a host, so Spark can split a host with very many pages
    return wanted.withColumn("host", host_column("url")).join(found.select("host", "classes", "slots"), "host", "left").mapInArrow(tidy(joined), TEXT_DDL)
