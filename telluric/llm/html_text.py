"""Main text of web pages: a host suffix array over the blocks that markup leaves.

A page is cut into blocks at block-level tags. Markup that names its purpose is a prior: menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and comments (by tag, role, class or id) are dropped at once; what
stands in an article or main element is likely text, and blocks outside of it are dropped; blocks of a page without
such an element are open.

The token streams of a host's pages are concatenated, a suffix array ordered by the first ``least`` tokens finds the
substrings that occur on distinct pages, and blocks that these cover are boilerplate; blocks with unique runs stay. The
prior says how many pages it takes: two for open blocks, more than ``kept_share`` of the host's pages (``kept_pages`` at
least) for likely text, as an article's lines may well be quoted on another page.

A host with up to ``block_chars`` of text is one group. The pages of a larger one are not brought together: each task
makes suffix arrays of its own share of the host's pages, and offers the substrings that it finds often enough there.
What is on more than some share of all pages is so in one task at least, so nothing is missed; Spark adds up on
how many pages each offered substring is, by its hash, and hands the shared ones back to the pages that have them. Both
ways give the same result, so block_chars is a matter of memory only.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telluric.llm.shared import folder, saved

# Element and attribute names of HTML.
SKIPPED = frozenset("script style noscript template svg math iframe object canvas head title select textarea button option datalist".split())
DROPPED = frozenset("nav header footer aside form dialog menu fieldset".split())
KEPT = frozenset("article main".split())
WHOLE = frozenset("html body article main".split())  # their names tell of the page's layout
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {  # an opening tag ends an open element of these, as their end tags may be left out
    "p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "tr": frozenset(["tr"]),
    "option": frozenset(["option"]),
}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar".split())
NAMES = frozenset(
    "ad ads adsbox advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead menu modal nav navbar navigation "
    "newsletter notice notices pager pagination popup promo promoted promotion related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe "
    "toolbar widget".split()
)
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 span em strong b i u a li dt dd td th q cite code pre blockquote small sub sup mark abbr".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">]|['\"])*?)(?:>|$)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SPACE = re.compile(r"\s+")
RAW = {t: re.compile(rf"</{t}[\s/>]", re.IGNORECASE) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}

KEEP, OPEN, DROP = 1, 0, -1


def _named(attributes: str, whole: bool) -> bool:
    """Whether an element's attributes say that it isn't content; with whole a class has to be such a name, else a part of one (side-bar, navTop) is enough."""
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id"):
            words = {w.lower() for w in (value.split() if whole else PART.findall(value))}
            if words & NAMES or not whole and not NAMES.isdisjoint(re.split(r"[\s_-]+", value.lower())):
                return True
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
    return False


def blocks(page: str) -> list[tuple[int, str]]:
    """(KEEP, OPEN or DROP, text) of a page's blocks with text, in page order; white space made one blank."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    parts: list[str] = []
    state = OPEN

    def flush() -> None:
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append((state, text))
            parts.clear()

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            parts.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            parts.append(html.unescape(page[at : m.start()]))  # a reference ends with its piece of text
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                parts.append(m[0][9:].removesuffix("]]>"))
            continue
        name = m[2].lower()
        if m[1]:
            if name in BLOCKS or name in DROPPED:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    flush() if stack[k][1] != state else None
                    state = stack[k][1]
                    del stack[k:]
                    break
            continue
        if name in RAW:
            end = RAW[name].search(page, at)
            at = page.find(">", end.start()) + 1 or len(page) if end else len(page)
            continue
        if name in BLOCKS:
            flush()
        while stack and name in CLOSES.get(stack[-1][0], ()):
            flush() if stack[-1][1] != state else None
            state = stack.pop()[1]
        new = state
        if state != DROP:
            if name in DROPPED and not (name == "header" and state == KEEP) or name in SKIPPED or name not in WHOLE and m[3] and _named(m[3], state == KEEP and name in TEXTUAL):
                new = DROP
            elif name in KEPT:
                new = KEEP
        if name in VOID or m[3].endswith("/"):
            continue
        if new != state:
            flush()
        stack.append((name, state))
        state = new
    flush()
    return out


def ranked(x: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of the suffixes of x by their first depth values, or wholly, by prefix doubling; equal ones share a rank."""
    n, length = len(x), 1
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank)
    while n and rank[order[-1]] < n - 1 and length < min(n, depth or n):
        step = length if depth is None else min(length, depth - length)
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key)
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank, length = new, length + step
    return order, rank


def suffix_array(x: np.ndarray) -> np.ndarray:
    """The order of the suffixes of x."""
    return ranked(x)[0]


class Streams:
    """The concatenated token streams of some pages' blocks, and their windows of least tokens by their rank in the suffix array.

    No window crosses the end of a block. texts are the blocks', page their pages' numbers; a window has a place (of its first token),
    a page and a rank; hashes gives its 64-bit hash.
    """

    def __init__(self, texts: list[str], page: np.ndarray, least: int):
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = cut.flatten().dictionary_encode()
        self.tokens, self.words, self.least = coded.indices.to_numpy().astype(np.int64), coded.dictionary, least
        bounds = cut.offsets.to_numpy()
        self.begin, self.size = bounds[:-1], np.diff(bounds)
        n = np.maximum(self.size - least + 1, 0)
        self.block = np.repeat(np.arange(len(texts)), n)
        self.place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.begin[self.block]
        self.page = np.asarray(page, np.int64)[self.block]

    def ranks(self) -> np.ndarray:
        """The windows' ranks. Suffixes that run on into another block are never asked for, so the streams need no marks between."""
        return ranked(self.tokens, self.least)[1][self.place] if len(self.place) else np.zeros(0, np.int64)

    def pages_by_rank(self, rank: np.ndarray) -> np.ndarray:
        """On how many distinct pages each rank is."""
        most = int(self.page.max(initial=0)) + 1
        pairs = np.unique(rank * most + self.page)
        return np.bincount(pairs // most, minlength=int(rank.max(initial=-1)) + 1)

    def hashes(self) -> np.ndarray:
        """The windows' hashes: sums of token hashes times a factor for each place in the window."""
        known = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.words.to_numpy(zero_copy_only=False).tolist()), np.uint64, len(self.words))
        out = np.zeros(len(self.place), np.uint64)
        for k in range(self.least):
            out += known[self.tokens[self.place + k]] * np.uint64(xxhash.xxh64_intdigest(str(k)) | 1)
        return out.view(np.int64)

    def covered(self, shared: np.ndarray) -> np.ndarray:
        """How many tokens of each block lie in windows that are shared."""
        mark = np.zeros(len(self.tokens) + self.least + 1, np.int64)
        at = self.place[shared]
        np.add.at(mark, at, 1)
        np.add.at(mark, at + self.least, -1)
        self.inside = np.cumsum(mark)[: len(self.tokens)] > 0
        total = np.concatenate([[0], np.cumsum(self.inside)])
        return total[self.begin + self.size] - total[self.begin]


def covered(streams: list[list[int]], pages_of: list[int], least: int) -> list[np.ndarray]:
    """For each block's tokens, which of them lie in a substring of least tokens or more that a block of another page has too."""
    s = Streams([" ".join(map(str, x)) for x in streams], np.array(pages_of, np.int64), least)
    rank = s.ranks()
    s.covered(s.pages_by_rank(rank)[rank] > 1)
    return [s.inside[b : b + len(x)] for b, x in zip(s.begin.tolist(), streams, strict=True)]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages' likely blocks, or their open ones if none is likely."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            kept, texts = [], []
            for x in part["html"]:
                found = blocks(x.as_py() or "")
                likely = any(s == KEEP for s, _ in found)
                kept.append(likely)
                texts.append([t for s, t in found if s == (KEEP if likely else OPEN)])
            rest = [n for n in part.schema.names if n != "html"]
            yield pa.RecordBatch.from_arrays([*(part[n] for n in rest), pa.array(kept, pa.bool_()), pa.array(texts, pa.list_(pa.string()))], [*rest, "kept", "texts"])


def needed(pages: Column | int, kept: Column, kept_share: float, kept_pages: int) -> Column:
    """On how many pages of a host's so many a substring has to be."""
    return F.when(kept, F.greatest(F.lit(kept_pages), F.floor(pages * F.lit(kept_share)) + 1)).otherwise(F.lit(2)).cast("long")


def _joined(texts: list[list[str]], gone: np.ndarray) -> list[str]:
    """Each page's blocks without those that are gone (by number over all pages)."""
    flags = iter(gone.tolist())
    return ["\n\n".join([t for t in page if not next(flags)]) for page in texts]


def _unique_runs(least: int, share: float, kept_share: float, kept_pages: int):
    """The texts of one host's pages of one kind, whole."""

    def run(pages: pd.DataFrame) -> pd.DataFrame:
        texts = [list(t) for t in pages["texts"]]
        same = pd.factorize(pages["content"])[0]
        s = Streams([t for page in texts for t in page], np.repeat(same, [len(t) for t in texts]), least)
        n, rank = int(same.max(initial=-1)) + 1, s.ranks()
        need = max(kept_pages, int(np.floor(n * kept_share)) + 1) if pages["kept"].iloc[0] else 2
        gone = s.covered(s.pages_by_rank(rank)[rank] >= need) > share * s.size
        return pd.DataFrame({"page_id": pages["page_id"], "url": pages["url"], "text": _joined(texts, gone)})

    return run


def _in_pieces(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[pa.Table]:
    """The rows of a task in pieces of about so many characters of text, by host and kind (column section)."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch["texts"].nbytes
        if size >= chars:
            yield pa.Table.from_batches(held).sort_by("section")
            held, size = [], 0
    if size or held:
        yield pa.Table.from_batches(held).sort_by("section")


def _offered(least: int, chars: int):
    """(section, w, n): the windows that are on enough of a piece's distinct pages, and on how many. A kind that needs two pages offers all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _in_pieces(batches, chars):
            section = piece["section"].to_numpy()
            cuts = np.flatnonzero(np.diff(section)) + 1
            for b, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(section)], strict=True):
                if b == e:
                    continue
                own = piece.slice(b, e - b)
                texts = own["texts"].to_pylist()
                s = Streams([t for page in texts for t in page], np.repeat(np.arange(len(texts)), [len(t) for t in texts]), least)
                need, of = own["need"][0].as_py(), own["pages"][0].as_py()
                rank = s.ranks()
                n = s.pages_by_rank(rank)
                first = np.unique(rank, return_index=True)[1]
                first = first[n[rank[first]] >= (1 if need <= 2 else -(-need * len(texts) // of))]
                if len(first):
                    yield pa.RecordBatch.from_arrays([pa.array(section[b : b + 1].repeat(len(first))), pa.array(s.hashes()[first]), pa.array(n[rank[first]])], ["section", "w", "n"])

    return run


def _windows(least: int):
    """(row, section, w): all windows of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = part["texts"].to_pylist()
                s = Streams([t for page in texts for t in page], np.repeat(np.arange(len(texts)), [len(t) for t in texts]), least)
                pick = pa.array(s.page)
                yield pa.RecordBatch.from_arrays([part["row"].take(pick), part["section"].take(pick), pa.array(s.hashes())], ["row", "section", "w"])

    return run


def _without(least: int, share: float):
    """Pages' texts without the blocks that their shared windows (w, null if none) cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts, hit = part["texts"].to_pylist(), part["w"].to_pylist()
                s = Streams([t for page in texts for t in page], np.repeat(np.arange(len(texts)), [len(t) for t in texts]), least)
                shared = np.zeros(len(s.place), bool)
                if any(hit):
                    h, ends = s.hashes(), np.searchsorted(s.page, np.arange(len(texts) + 1))
                    for k, w in enumerate(hit):
                        if w:
                            shared[ends[k] : ends[k + 1]] = np.isin(h[ends[k] : ends[k + 1]], np.array(w, np.int64))
                out = _joined(texts, s.covered(shared) > share * s.size)
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(out, pa.string())], ["page_id", "url", "text"])

    return run


def _of_large_hosts(rows: DataFrame, path: str, least: int, share: float, kept_share: float, kept_pages: int, block_chars: int) -> DataFrame:
    """(page_id, url, text) of hosts whose pages aren't brought together; rows as _cut gives them, with host and content."""
    spark = rows.sparkSession
    cut = saved(rows.withColumns({"row": F.monotonically_increasing_id(), "section": F.xxhash64("host", "kept")}), f"{path}/cut")
    pages = cut.groupBy("section", "kept", "content").agg(F.min("row").alias("row"), F.count("*").alias("copies"))
    copies = saved(pages.where("copies > 1").select("section", "content", F.col("row").alias("first")), f"{path}/copies")
    once = cut.select("row", "section", "content", "texts")
    if not copies.isEmpty():
        once = once.join(copies, ["section", "content"], "left").where("first IS NULL OR first = row")
    size = saved(pages.groupBy("section", "kept").agg(F.count("*").alias("pages")).withColumn("need", needed(F.col("pages"), F.col("kept"), kept_share, kept_pages)), f"{path}/sizes").drop("kept")
    asked = once.join(size, "section").select("section", "pages", "need", "texts")
    offers = saved(asked.mapInArrow(_offered(least, block_chars), "section long, w long, n long").groupBy("section", "w").agg(F.sum("n").alias("n")), f"{path}/offers")
    # the sum is whole where two pages are enough, as everything is offered there; elsewhere pages that didn't offer are still to be counted
    some = saved(offers.join(size, "section").where("need > 2 OR n >= 2").select("section", "w", "need"), f"{path}/candidates")
    out = cut.select("page_id", "url", "row", "texts")
    if some.isEmpty():
        out = out.withColumn("w", F.lit(None).cast("array<long>"))
    else:
        found = saved(cut.select("row", "section", "texts").mapInArrow(_windows(least), "row long, section long, w long").join(some, ["section", "w"]).distinct(), f"{path}/found")
        counted = found.join(once.select("row"), "row", "left_semi").groupBy("section", "w").agg(F.count("*").alias("n"), F.max("need").alias("need"))
        shared = saved(counted.where("n >= need").select("section", "w"), f"{path}/shared")
        hits = saved(found.join(shared, ["section", "w"], "left_semi").groupBy("row").agg(F.collect_list("w").alias("w")), f"{path}/hits")
        out = out.join(hits, "row", "left")
    return out.select("page_id", "url", "texts", "w").mapInArrow(_without(least, share), "page_id long, url string, text string")


def html_text(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least: int = 5,
    share: float = 0.5,
    kept_share: float = 0.5,
    kept_pages: int = 5,
    block_chars: int = 4_000_000,
) -> DataFrame:
    """One row per row of pages: id_col, url_col, text (blocks joined by two line feeds; empty if none).

    least is the number of tokens of a long substring, share how much of a block these must cover to drop it; kept_share and
    kept_pages say on how many pages of its host a substring of an article must be. block_chars is the html that a group of
    pages may have at once, see above. Null html counts as empty, a null url has a host of its own. Exact copies of a page on
    a host count as one page and have the same text. Empty tables give empty results; other columns are ignored.
    """
    path = folder(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = rows.withColumns({"host": host, "content": F.xxhash64("html")})
    size = rows.groupBy("host").agg(F.sum(F.octet_length("html").cast("long")).alias("chars"))
    large = saved(size.where(F.col("chars") > block_chars).select("host"), f"{path}/large")
    kinds = "page_id long, url string, host string, content long, kept boolean, texts array<string>"
    names = ["page_id", "url", "host", "content", "html"]
    small = rows.join(large, "host", "left_anti").select(*names).mapInArrow(_cut, kinds)
    done = small.groupBy("host", "kept").applyInPandas(_unique_runs(least, share, kept_share, kept_pages), "page_id long, url string, text string")
    if not large.isEmpty():
        cut = rows.join(large, "host", "left_semi").select(*names).mapInArrow(_cut, kinds)
        done = done.union(_of_large_hosts(cut, path, least, share, kept_share, kept_pages, block_chars))
    return done.withColumnRenamed("page_id", id_col).withColumnRenamed("url", url_col)
