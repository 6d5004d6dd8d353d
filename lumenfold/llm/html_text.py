"""Main text of web pages: structure of the page, and a suffix array per host for what the structure leaves open.

What an element, role or class marks as menu, header, footer, sidebar, notice, advert, form, comment, script or drawing is
left out. The rest of a page is cut into blocks, inside an article or main element or open. The text of a page with an
article is its article's blocks, of another page its open blocks, both less boilerplate.

Boilerplate is found per host: the token streams of its distinct pages are concatenated, with a separator of its own after
each, their suffixes are sorted, and neighbours in that order that have RUN tokens or more in common belong to a substring
that repeats. The runs of RUN tokens that such substrings consist of are counted by the distinct pages they stand on. A
run on PAGES pages of the host or more covers its tokens in open blocks, which lose them. An article is text already: a
whole block of it goes if runs on ARTICLE_SHARE of the host's distinct pages, and on ARTICLE_PAGES, cover it; if that were
more than half of the article, the pages are versions of one another and the article stays as it is.

A host with more than SHARD_BYTES of pages is split into shards by a hash of the tokens, so that no task holds a host.
Each shard counts its runs, and the counts are added up per host, so shards decide nothing. Where every page of such a host
holds an article or main tag, a shard leaves out runs on less than half of ARTICLE_SHARE of its pages. Two bounds of a run's pages
follow: those that were counted, and as many more as the shards that left it out may have seen. If the share lies between them
for some run, or if a page turns out to have open blocks only, all runs of the host are counted again, none left out, as in other
large hosts from the start, at the cost of their texts. Pages of which the host has very
many equal copies are reduced to one before they move. The runs that decide go to all machines if they are small (counted),
else they meet their host's pages by shards.

Defined results: null html or html without text gives an empty text; a null url belongs to the empty host; text outside
any element is an open block; an unclosed comment, script or style runs to the end; a `<` that no `>` follows is text; after
a tag with an unclosed quote, tags end at the next `>`, quoted or not; rows that repeat a page_id give a row each; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, numbered_words, released, staged, text_slices

RUN, PAGES = 8, 3
ARTICLE_PAGES, ARTICLE_SHARE = 5, 0.8
SHARD_BYTES = 2 << 20
#: Copies of a page on one host from which on they are reduced before they move.
COPIES = 1000
#: Bytes of deciding runs that go to all machines.
RUN_BYTES = 16 << 20
ARTICLE, SKIPPED, OPEN = 0, 1, 2
_FACTOR = np.uint64(0x9E3779B97F4A7C15)

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/><]*)")
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_RAW = frozenset("script style textarea title iframe noembed noframes".split())
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_LEFT_OUT = frozenset("head nav header footer aside form menu dialog button label fieldset datalist object canvas audio video applet select svg template noscript".split())
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Words of class and id names, and roles, of what is no main text.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_CLOSED_BY = {"p": _BLOCKS - {"br"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}


def _left_out(name: str, attributes: str) -> bool:
    if name in _LEFT_OUT:
        return True
    if not attributes or name in ("html", "body"):
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, given = key.lower(), value.strip("\"'")
        value = given.lower()
        if key in ("class", "id"):
            # class names such as postComments or post-comments, and navBar as it is and as navbar
            if _NAMES.intersection(re.split(r"[^a-z0-9]+", f"{value} {_HUMP.sub(' ', given).lower()}")):
                return True
        elif key == "role":
            if value in _ROLES:
                return True
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def blocks(page: str) -> list[tuple[int, str]]:
    """(zone, text) of the page's blocks that have text, in page order, in time that grows with the page's length."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    unclosed: Counter[str] = Counter()
    zone, skip, held, at, look, quoted = OPEN, False, [], 0, 0, True
    last = page.rfind(">")

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append((zone, text))
            held.clear()

    def hold(end: int) -> None:
        if not skip and end > at:
            held.append(html.unescape(page[at:end]))

    def pop() -> str:
        name = stack.pop()[0]
        unclosed[name] -= 1
        return name

    while (begin := page.find("<", look)) >= 0:
        if page.startswith("<!--", begin):
            hold(begin)
            end = page.find("-->", begin + 4)
            at = look = len(page) if end < 0 else end + 3
            continue
        if begin > last:  # no tag any more; a comment may still run to the end
            look = page.find("<!--", begin)
            if look < 0:
                break
            continue
        m = _TAG.match(page, begin)
        if m is None:
            look = begin + 1
            if page.startswith(("<!", "<?", "</"), begin):
                hold(begin)
                at = look = page.find(">", begin) + 1
            continue
        rest = _REST.match(page, m.end()) if quoted else None
        quoted = rest is not None
        end = rest.end() if rest else page.find(">", m.end()) + 1
        attributes = page[m.end() : end - 1]
        hold(begin)
        at = look = end
        name = m[2].lower()
        if name in _BLOCKS and not skip:
            flush()
        if m[1]:
            if unclosed[name]:
                while pop() != name:
                    pass
        elif name in _RAW:
            found = _RAW_END[name].search(page, at)
            at = look = len(page) if found is None else found.start()
            continue
        elif name not in _VOID:
            while stack and name in _CLOSED_BY.get(stack[-1][0], ()):
                pop()
            above = stack[-1][1] if stack else OPEN
            if above == SKIPPED or _left_out(name, attributes):
                own = SKIPPED
            else:
                own = ARTICLE if above == ARTICLE or name in ("article", "main") else OPEN
            if not attributes.rstrip().endswith("/"):
                stack.append((name, own))
                unclosed[name] += 1
        now = stack[-1][1] if stack else OPEN
        skip = now == SKIPPED
        if not skip and now != zone:
            flush()
            zone = now
    hold(len(page))
    flush()
    return out


def suffix_array(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes, common): the places of stream in the order of the suffixes that begin there, and of each how many numbers
    it has in common with the one before it. By doubling, in which only suffixes that are not alone with their rank take
    part; the ranks of every step, places of the first of equals, give the common lengths."""
    n = len(stream)
    common, suffixes = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    if not n:
        return suffixes, common
    first = lambda new: np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    changes = lambda x: np.append(True, x[1:] != x[:-1])
    order = np.argsort(stream, kind="stable")
    rank, step = np.empty(n, dtype=np.int32), 1
    rank[order] = first(changes(stream[order]))
    ranks = [rank]
    while len(active := np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)):
        after = np.where(active + step < n, rank[np.minimum(active + step, n - 1)], -1)
        key = rank[active].astype(np.int64) * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        rank = rank.copy()
        rank[active] += (first(changes(key)) - first(changes(rank[active]))).astype(np.int32)
        ranks.append(rank)
        step *= 2
    suffixes[rank] = np.arange(n)
    a, b = suffixes[1:].copy(), suffixes[:-1].copy()
    for k in range(len(ranks) - 1, -1, -1):  # of 2 ** k numbers at a time
        same = (a < n) & (b < n)
        same[same] = ranks[k][a[same]] == ranks[k][b[same]]
        common[1:][same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return suffixes, common


def _token_hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.as_buffer()) for w in words.cast(pa.large_binary())), dtype=np.uint64, count=len(words))


def _run_hashes(tokens: np.ndarray, run: int) -> np.ndarray:
    """A 64-bit hash of the run that begins at each token, as far as there are enough."""
    h = np.zeros(max(0, len(tokens) - run + 1), dtype=np.uint64)
    for k in range(run):
        h = h * _FACTOR + tokens[k : k + len(h)]
    return h


def runs(texts: pa.Array, run: int = RUN) -> tuple[np.ndarray, np.ndarray, int]:
    """The distinct runs of the distinct texts, as hashes, on how many of them each stands, and how many texts there are."""
    words, number, ends = numbered_words(texts)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    distinct = list({number[lo:hi].tobytes(): (lo, hi) for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True)}.values())
    if not distinct:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    # a separator of its own after each text keeps substrings within texts
    stream = np.concatenate([np.append(number[lo:hi].astype(np.int64), len(words) + k) for k, (lo, hi) in enumerate(distinct)])
    size = np.asarray([hi - lo for lo, hi in distinct])
    of = np.repeat(np.arange(len(distinct)), size + 1)
    suffixes, common = suffix_array(stream)
    # neighbours with a run in common are occurrences of one substring; what reaches over a separator is none
    left = (np.cumsum(size + 1) - 1)[of] - np.arange(len(stream))
    group = np.cumsum(common < run)
    real = left[suffixes] >= run
    group, page, first = group[real], of[suffixes][real], suffixes[real]
    if not len(group):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), len(distinct)
    _, at, back = np.unique(group, return_index=True, return_inverse=True)
    spread = np.bincount(np.unique(back * len(distinct) + page) // len(distinct), minlength=len(at))
    tokens = np.append(_token_hashes(words), np.zeros(len(distinct), np.uint64))[stream]
    return _run_hashes(tokens, run)[first[at]], spread, len(distinct)


def covered(text: pa.Array, hot: np.ndarray, run: int = RUN) -> np.ndarray:
    """Whether each token of a text, an array of one, is covered by one of the runs in hot, which are hashes."""
    words, number, _ = numbered_words(text)
    n = len(number)
    edge = np.zeros(n + 1, dtype=np.int64)
    if n >= run:
        starts = np.flatnonzero(np.isin(_run_hashes(_token_hashes(words)[number], run), hot))
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + run, -1)
    return np.cumsum(edge[:-1]) > 0


def repeated(pages: list[list[str]], run: int = RUN, least: int = PAGES) -> list[np.ndarray]:
    """Per page, given by its tokens, whether each token is covered by a run that `least` distinct pages hold."""
    texts = [pa.array([" ".join(p)], pa.large_string()) for p in pages]
    own, n, _ = runs(pa.concat_arrays(texts), run)
    return [covered(t, own[n >= least], run) for t in texts]


def _joined(page: list[tuple[int, str]]) -> str:
    return "\n".join(t for _, t in page)


def main_text(page: list[tuple[int, str]], open_runs: np.ndarray, article_runs: np.ndarray) -> str:
    """The main text of a page from its blocks and its host's runs that decide on open blocks and in articles."""
    own = ARTICLE if any(z == ARTICLE for z, _ in page) else OPEN
    hot = article_runs if own == ARTICLE else open_runs
    if not len(hot):
        return "\n".join(t for z, t in page if z == own)
    flags, at, kept, lost, size = covered(pa.array([_joined(page)], pa.large_string()), hot), 0, [], 0, 0
    for zone, text in page:
        words = text.split(" ")
        flag = flags[at : at + len(words)]
        at += len(words)
        if zone != own:
            continue
        size += len(words)
        if own == OPEN:
            text = " ".join(w for w, c in zip(words, flag.tolist(), strict=True) if not c)
        elif flag.all():
            lost += len(words)
            continue
        if text:
            kept.append(text)
    if 2 * lost > size:
        return "\n".join(t for z, t in page if z == own)
    return "\n".join(kept)


def host(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _once(rows: DataFrame) -> DataFrame:
    """rows (host, html), with one of the copies of a page of which its host has COPIES or more."""
    mark = rows.select("host", F.xxhash64("html").alias("h1"), F.xxhash64("html", F.lit(1)).alias("h2"))
    many = staged(mark.groupBy("host", "h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= COPIES).drop("n"), "html-copies")
    if many.isEmpty():
        return rows
    key = ["host", "h1", "h2"]
    marked = rows.withColumns({"h1": F.xxhash64("html"), "h2": F.xxhash64("html", F.lit(1))})
    many = broadcast_if_small(many, 128)
    return marked.join(many, key, "left_anti").unionByName(marked.join(many, key, "left_semi").dropDuplicates(key)).select("host", "html")


def repeated_runs(rows: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """host, run, n (distinct pages of the host that hold it), pages (distinct pages of the host), for every run of PAGES
    pages or more. rows: host, html."""
    tagless = F.coalesce(~F.regexp("html", F.lit(r"(?i)<(article|main)[\s/>]")) & (F.length("html") > 0), F.lit(False))
    sizes = rows.groupBy("host").agg(F.sum(F.length("html")).alias("size"), F.max(tagless).alias("whole"))
    large = staged(sizes.select("host", F.ceil(F.col("size") / shard_bytes).alias("shards"), "whole").where("shards > 1"), "html-large")
    found = _counted(rows, large)
    hosts = _hosts(found)
    # of the runs of hosts that left some out: the pages that were counted, and the most there can be
    partial = hosts.where("rest > 0").select("host", "pages", F.col("rest").alias("hidden"))
    most = F.sum(F.col("n") - F.col("rest")) + F.first("hidden")
    bounds = found.where("run is not null").join(broadcast_if_small(partial, 128), "host").groupBy("host", "run").agg(F.sum("n").alias("n"), most.alias("most"), F.first("pages").alias("pages"))
    need = F.greatest(F.lit(float(ARTICLE_PAGES)), ARTICLE_SHARE * F.col("pages"))
    unsure = bounds.where((F.col("n") < need) & (F.col("most") >= need)).select("host")
    open_after_all = hosts.where("open and rest > 0").select("host")
    again = staged(unsure.unionByName(open_after_all).distinct(), "html-again")
    if not again.isEmpty():
        few = broadcast_if_small(again, 128)
        anew = _counted(rows.join(few, "host", "left_semi"), large.join(few, "host", "left_semi").withColumn("whole", F.lit(True)))
        found = found.join(few, "host", "left_anti").unionByName(anew)
        hosts = _hosts(found)
    hot = found.where("run is not null").groupBy("host", "run").agg(F.sum("n").alias("n")).where(F.col("n") >= PAGES)
    hot = hot.join(broadcast_if_small(hosts, 128), "host").withColumn("article", (F.col("n") >= ARTICLE_PAGES) & (F.col("n") >= ARTICLE_SHARE * F.col("pages")))
    return staged(hot.where("open or article").select("host", "run", "n", "pages", "article"), "html-hot")


def _hosts(found: DataFrame) -> DataFrame:
    """host, pages, open (whether a page's text is its open blocks), rest (of all shards), from the rows without a run."""
    about = found.where("run is null").groupBy("host").agg(F.sum("n").alias("pages"), F.max("open").alias("open"), F.sum("rest").alias("rest"))
    return staged(about, "html-hosts")


def _counted(rows: DataFrame, large: DataFrame) -> DataFrame:
    """A row per host, shard and run that the shard does not leave out: n, the shard's distinct pages that hold it, and rest, the most
    pages on which a run that it leaves out may stand; and a row per shard without a run, n being its distinct pages, open whether
    one of them has open blocks only. large: host, shards, and whether whole: nothing is left out."""

    @released
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                cut = [blocks(h) if h else [] for h in part.column("html").to_pylist()]
                texts = [_joined(b) for b in cut]
                same = [xxhash.xxh3_64_intdigest(t.replace("\n", " ").encode("utf-8", "replace")) >> 1 for t in texts]
                out = [part.column("host"), pa.array(same, pa.int64()), pa.array([bool(b) and not any(z == ARTICLE for z, _ in b) for b in cut]), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(out, names=["host", "same", "undecided", "text"])

    parsed = _once(rows).mapInArrow(parse, "host string, same long, undecided boolean, text string")
    parsed = parsed.join(broadcast_if_small(large, 128), "host", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    # pages of equal tokens meet in one shard
    dealt = parsed.select("host", F.pmod("same", "shards").alias("shard"), "shards", F.coalesce("whole", F.lit(False)).alias("whole"), "undecided", "text")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        own, n, pages = runs(pa.array(pdf["text"], pa.large_string()))
        some_open, split = bool(pdf["undecided"].any()), pdf["shards"].iloc[0] > 1
        if split:
            least = 1 if pdf["whole"].iloc[0] else max(1, math.ceil(ARTICLE_SHARE * pages / 2))
        else:
            least = PAGES if some_open else max(ARTICLE_PAGES, ARTICLE_SHARE * pages)
        own, n = own[n >= least], n[n >= least]
        out = pd.DataFrame({"run": pd.array(own.view(np.int64), dtype="Int64"), "n": n})
        about = pd.DataFrame({"run": pd.array([None], dtype="Int64"), "n": [pages]})
        return pd.concat([out, about]).assign(host=pdf["host"].iloc[0], open=some_open, rest=least - 1 if split else 0)

    return staged(dealt.groupBy("host", "shard").applyInPandas(count, "run long, n long, host string, open boolean, rest long"), "html-runs")


def extracted(pages: DataFrame, shard_bytes: int = SHARD_BYTES, run_bytes: int = RUN_BYTES) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host().alias("host"), "html")
    hot = repeated_runs(rows.select("host", "html"), shard_bytes)
    schema, names = "page_id long, url string, text string", ["page_id", "url", "text"]
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))

    def cut(batch: pa.RecordBatch, decide) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            texts = [main_text(blocks(h), *decide(w)) if h else "" for w, h in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=names)

    if hot.count() * 16 <= run_bytes:
        per: dict[str, list] = {}
        for r in hot.collect():  # run_bytes at most
            per.setdefault(r["host"], []).append((r["run"], r["article"]))
        arrays = {h: (np.asarray([x for x, _ in v], dtype=np.int64).view(np.uint64), np.asarray([x for x, a in v if a], dtype=np.int64).view(np.uint64)) for h, v in per.items()}
        shared = spark.sparkContext.broadcast(arrays)

        @released
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from cut(batch, lambda w: shared.value.get(w, none))

        out = rows.mapInArrow(run, schema)
    else:

        def meet(pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
            every = found["run"].to_numpy(np.int64).view(np.uint64), found.loc[found["article"].astype(bool), "run"].to_numpy(np.int64).view(np.uint64)
            batch = pa.RecordBatch.from_pandas(pdf[["host", "html"]].reset_index(drop=True), preserve_index=False)
            batch = batch.append_column("page_id", pa.array([None] * len(pdf), pa.int64())).append_column("url", pa.array([None] * len(pdf), pa.string()))
            texts = [t for b in cut(batch, lambda w: every) for t in b.column("text").to_pylist()]
            return pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts}, columns=names)

        # pages in parts of their host of about shard_bytes, each with all of the host's runs
        sizes = rows.groupBy("host").agg(F.sum(F.length("html")).alias("size"))
        parts = staged(sizes.select("host", F.greatest(F.ceil(F.col("size") / shard_bytes), F.lit(1)).alias("parts")), "html-parts")
        parts = broadcast_if_small(parts, 128)
        dealt = rows.withColumn("page_id", F.col("page_id").cast("string")).join(parts, "host").withColumn("part", F.pmod(F.xxhash64("page_id", "html"), F.col("parts")))
        # under names of their own: both sides come from the same tables
        own = parts.select(F.col("host").alias("w"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("p"))
        spread = hot.join(own, F.col("host") == F.col("w")).select("w", "p", "run", "article")
        dealt = dealt.select("page_id", "url", F.col("host"), F.col("part").cast("long").alias("part"), "html")
        out = dealt.groupBy("host", "part").cogroup(spread.groupBy("w", "p")).applyInPandas(meet, schema.replace("page_id long", "page_id string"))
        out = out.withColumn("page_id", F.col("page_id").cast("long"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
