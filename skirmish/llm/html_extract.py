"""Main text of web pages by template deduction (operator 4).

Tokens are tags, told apart by their path of open elements, and blocks of words, told apart by path and words.  Over the
pages of one host each token has an occurrence vector (its count on every page); tokens with equal vectors form an
equivalence class.  A class is valid if it is on at least ``SUPPORT`` of the host's pages, and of its different pages, and
``PAGES`` at least, and if the paths of its tokens nest in those of other valid classes; the valid classes, nested by path,
are the host's template.  What lies between their tokens are slots.  The template's blocks of words are the host's own and
go wherever they stand (a notice without a telling name, say); of the slots one is extracted from every page: that under an
article or main element, or else the deepest that holds most of the text.

What varies from page to page but isn't the article (menus, adverts, reader comments) no template tells from it; such parts
are known by their elements and by names in class, id and role (``ASIDE``, ``NAMES``), as are all pages of hosts too small for
a template.

Vectors are compared by 64-bit sums of page hashes times counts, and different pages by a bitmap of 64 hash values, so both
are aggregated like any sum: no task ever holds a host, and pages are never shuffled while templates hold at most ``SENT``
tokens, which are broadcast; more are joined by host in a skewed join, which Spark splits.

Cases: null or empty html gives an empty text; a null or odd URL counts as one host; broken markup is read as browsers do
in the main (unclosed elements end with their parents); elements deeper than ``DEEPEST`` count as part of the one there;
repeated rows are treated alike and aren't different pages; an empty table gives no rows; other columns pass through
``extract``, whose result replaces a column of its name.  A page takes some 30 times its bytes.
"""
from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.llm.common import cleared, mapped, schema_of, stored, table

SUPPORT = 0.5
#: Different pages that a token of a template is on at least; elements above a path at most; tokens of templates broadcast.
PAGES = 4
DEEPEST = 100
SENT = 200_000
#: Share of the text that a slot must hold to be gone down into.
MOST = 0.8
#: Elements by their part in a page, and words in class, id and role that tell what isn't main text.
RAW = frozenset("script style noscript template textarea iframe svg math object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav header footer aside form head title button select dialog menu".split()) | RAW
BLOCK = frozenset("address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SCOPE = frozenset("html body main article section div td th table ul ol nav header footer aside form".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NAMES = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert sidebar menu nav navbar navigation breadcrumb breadcrumbs footer contentinfo complementary comment comments disqus reply replies respond share sharing social related recommended newsletter subscribe subscription signup popup modal overlay login search pager pagination copyright legal widget toolbar skip".split())
HEADERS = frozenset("header masthead topbar".split())
MAIN = frozenset("article content main post story entry maincontent articlebody body text".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<""", re.S)
NAMED = re.compile(r"""(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SPACE = re.compile(r"\s+")
LINK = re.compile(r"/a(?:[/.]|\Z)").search


class Node:
    __slots__ = ("article", "aside", "deep", "path", "tag")

    def __init__(self, tag: str, path: str, aside: bool, article: bool, deep: int) -> None:
        self.tag, self.path, self.aside, self.article, self.deep = tag, path, aside, article, deep


def _opened(tag: str, attributes: str, parent: Node) -> Node:
    label, aside, article = tag, parent.aside, parent.article
    names: set[str] = set()
    for m in NAMED.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            names.add("popup")
        elif key != "aria-hidden":
            got = {w.lower() for w in WORD.findall(value)}
            names |= got
            label += "." + "-".join(sorted(got))
    if tag not in ("html", "body", "article", "main") or names & {"comment", "comments"}:
        if tag in ASIDE and not (tag == "header" and article):
            aside = True
        elif names & NAMES and not names & MAIN or names & {"comment", "comments"}:
            aside = True
        elif names & HEADERS and not article and not names & MAIN:
            aside = True
    if not aside and tag in ("article", "main"):
        article = True
    return Node(tag, f"{parent.path}/{label}" if parent.deep < DEEPEST else parent.path, aside, article, parent.deep + 1)


def walk(page: str) -> Iterator[tuple[str, Node, str]]:
    """("open", node, tag), ("close", node, tag), ("void", parent, tag) and ("text", parent, text), in page order."""
    stack = [Node("", "", False, False, 0)]
    opened: Counter = Counter()  # open elements by tag
    at = 0
    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if not (got := m[0]).startswith("<") or got == "<":
                yield "text", stack[-1], got
            continue
        tag = tag.lower()
        if m[1]:
            if opened[tag]:
                while True:
                    node = stack.pop()
                    opened[node.tag] -= 1
                    yield "close", node, node.tag
                    if node.tag == tag:
                        break
            elif tag == "p":
                yield "void", stack[-1], "br"
            continue
        if tag in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            yield "void", stack[-1], tag
            continue
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            yield "void", stack[-1], tag
            continue
        closes = CLOSES.get(tag, {"p"} if tag in BLOCK else None)
        if closes and any(opened[c] for c in closes):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closes:
                    for node in reversed(stack[i:]):
                        opened[node.tag] -= 1
                        yield "close", node, node.tag
                    del stack[i:]
                    break
                if stack[i].tag in SCOPE:
                    break
        node = _opened(tag, m[3], stack[-1])
        stack.append(node)
        opened[tag] += 1
        yield "open", node, tag
    for node in reversed(stack[1:]):
        yield "close", node, node.tag


Events = list[tuple[str, Node, str]]


def tokens(events: Events) -> dict[str, list[int]]:
    """Of each path: its count, the characters of text (links aside) in it and below, and whether it is an article's."""
    out: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
    for what, node, text in events:
        if what == "open":
            out[node.path][0] += 1
            out[node.path][2] |= node.article
        elif what == "text" and not node.aside and not LINK(node.path) and (n := len(text.strip())):
            path = node.path
            while path:
                out[path][1] += n
                path = path[: path.rfind("/")]
    return out


def blocks(events: Events) -> Iterator[tuple[str, bool, str, list[str]]]:
    """Path, whether it is aside, words, and the paths of open elements (inner ones last) of each block of text."""
    now: list[str] = []
    first, around, inside = None, [], [""]
    for what, node, text in events:
        if what == "text":
            if not node.aside and text.strip():
                if first is None:
                    first, around = node, inside.copy()
                now.append(text)
            elif now and not node.aside:
                now.append(text)
        elif text in BLOCK and now:
            if words := SPACE.sub(" ", html.unescape("".join(now))).strip():
                yield first.path, first.aside, words, around
            now, first = [], None
        if what == "open" and node.path != inside[-1]:
            inside.append(node.path)
        elif what == "close" and len(inside) > 1 and node.path == inside[-1] and node.deep <= DEEPEST:
            inside.pop()
    if now and (words := SPACE.sub(" ", html.unescape("".join(now))).strip()):
        yield first.path, first.aside, words, around


def main_path(stats: dict[str, tuple[int, int]]) -> str | None:
    """The slot to extract, from paths with their text and whether they lie in an article."""
    article = [p for p, (n, inside) in stats.items() if inside and n]
    if article:
        return min(article, key=lambda p: (p.count("/"), -stats[p][0], p))
    rooted = {p: n for p, (n, _) in stats.items() if n and p.rsplit("/", 1)[1].split(".")[0] in SCOPE}
    if not rooted:
        return None
    below = defaultdict(list)
    for p in rooted:
        up = p
        while (up := up[: up.rfind("/")]) and up not in rooted:
            pass
        below[up].append(p)
    at = max(below[""], key=lambda p: (rooted[p], p))
    total = rooted[at]
    while below[at] and rooted[best := max(below[at], key=lambda p: (rooted[p], p))] >= MOST * total:
        at = best
    return at


def text_of(page: str, slot: str | None, host: int = 0, template: Callable[[int], bool] = lambda token: False) -> str:
    """The text of a slot, block by block, without the template's; without the slot on the page, of the page's own."""
    events = list(walk(page))
    if slot is None or not any(w == "open" and n.path == slot for w, n, _ in events):
        slot = main_path({p: (n, bool(a)) for p, (_, n, a) in tokens(events).items()})
    return " ".join(words for path, _, words, around in blocks(events) if (slot is None or slot in around) and not template(token_of(host, path, words)))


def token_of(host: int, path: str, words: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(f"{host}\0{path}\0{words}".encode("utf-8", "surrogatepass")) - (1 << 63)


def host_of(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def templates(pages: DataFrame) -> DataFrame:
    """Tokens of the hosts' templates, from pages with columns host (a hash) and html: host and, with a path, the slot of the
    host, or else the token of a block of words."""
    mask = (1 << 64) - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[int, str | None, int], list[int]] = {}
            for h, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                events = list(walk(page or ""))
                mark = hash_of(page or "")
                words = Counter(token_of(h, path, text) for path, _, text, _ in blocks(events))
                found = [((h, p, 0), x) for p, x in ({"": [1, 0, 0]} | tokens(events)).items()] + [((h, None, t), (n, 0, 0)) for t, n in words.items()]
                for name, (n, chars, inside) in found:
                    s = sums.setdefault(name, [0, 0, 0, 0, 0])
                    s[0] += 1
                    s[1] = (s[1] + mark * n) & mask
                    s[2] += chars
                    s[3] |= int(inside)
                    s[4] |= 1 << (mark & 63)
            if sums:
                hosts, paths, words = zip(*sums, strict=True)
                n, v, c, a, m = zip(*sums.values(), strict=True)
                signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array(paths, pa.string()), pa.array(words, pa.int64()), pa.array(n, pa.int64()), pa.array(np.array(v, np.uint64).view(np.int64) >> 20), pa.array(c, pa.int64()), pa.array(a, pa.int64()), signed(m)], ["host", "path", "token", "n", "vector", "chars", "article", "pages"])

    def deduce(host: pd.DataFrame) -> pd.DataFrame:
        inside = set(host["path"].dropna()) | {""}
        stats: dict[str, tuple[int, bool]] = {}
        words: list[int] = []
        for _, members in host.groupby(["n", "vector"]):
            # a class nests if the parents of its tags are in the template too, or the root
            tags = members[members["path"].notna() & (members["path"] != "")]
            if all(p[: p.rfind("/")] in inside for p in tags["path"]):
                stats |= {p: (int(c), bool(a)) for p, c, a in zip(tags["path"], tags["chars"], tags["article"], strict=True)}
                words += members.loc[members["path"].isna(), "token"].tolist()
        slot = main_path(stats) if stats else None
        rows = [(host["host"].iloc[0], slot, 0)] * (slot is not None) + [(host["host"].iloc[0], None, t) for t in words]
        return pd.DataFrame(rows, columns=["host", "path", "token"])

    schema = "host long, path string, token long, n long, vector long, chars long, article long, pages long"
    every = mapped(pages, count, schema).groupBy("host", "path", "token").agg(F.sum("n").alias("n"), F.sum("vector").alias("vector"), F.sum("chars").alias("chars"), F.max("article").alias("article"), F.bit_or("pages").alias("pages"))
    sums = stored(every.withColumn("different", F.bit_count("pages")).drop("pages").where((F.col("path") == "") | (F.col("n") >= PAGES) & (F.col("different") >= PAGES)), "tokens")
    whole = sums.where("path = ''").select("host", F.col("n").alias("total"), F.col("different").alias("all"))
    kept = sums.join(whole, "host").where((F.col("n") >= SUPPORT * F.col("total")) & (F.col("different") >= SUPPORT * F.col("all"))).drop("total", "all")
    return stored(kept.groupBy("host").applyInPandas(deduce, "host long, path string, token long"), "templates")


def hash_of(page: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(page.encode("utf-8", "surrogatepass"))


def extract(df: DataFrame, page: str = "html", url: str = "url", to: str = "text") -> DataFrame:
    """df with the main text added."""
    df = cleared(df, (to,), page, url)
    names, where = df.columns, df.columns.index(page)
    host = F.xxhash64(host_of(url))
    found = templates(df.select(host.alias("host"), F.col(page).alias("html")))
    slots = found.where("path IS NOT NULL").select(F.col("host").alias("__host"), F.col("path").alias("__slot"))
    words = found.where("path IS NULL").select("host", "token")
    few = found.count() <= SENT
    hosted = df.withColumn("__host", host)
    if few:
        known = np.sort(words.select("token").toArrow().column(0).to_numpy())
        joined = hosted.join(F.broadcast(slots), "__host", "left").withColumn("__words", F.lit(None).cast("array<bigint>"))
    else:
        known = np.empty(0, np.int64)
        own = words.groupBy(F.col("host").alias("__host")).agg(F.collect_set("token").alias("__words"))
        joined = hosted.join(slots.join(own, "__host", "full"), "__host", "left")
    joined = joined.select(*(F.col(f"`{c}`") for c in names), "__host", "__slot", "__words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = frozenset(known.tolist())
        for batch in batches:
            texts = []
            for x, h, s, own in zip(*(batch.column(i).to_pylist() for i in (where, *range(len(names), len(names) + 3))), strict=True):
                own = every if own is None else frozenset(own)
                texts.append(text_of(x or "", s, h, own.__contains__))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(texts, pa.string())], [*names, to])

    return mapped(joined, run, f"{schema_of(df)}, `{to}` string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
