"""Main text of web pages: runs of tokens that repeat across a host's pages, with the markup's declarations as evidence.

Each page is parsed once into blocks, written to the shared folder; a host's token streams are compared by runs, and
covered runs go while unique ones stay. What a block declares (article, nav, an advert's class name) sets how much
repetition it takes:

- blocks that declare something else than an article go: an advert that occurs once repeats nowhere;
- of a block that a covered run holds in part, only pieces of a run's length go;
- open blocks, on pages that declare no article, lose every token in a run of MIN_RUN tokens that two pages have, be it
  in open blocks or in blocks declared as something else; blocks that consist of links go. Copies and near copies of a
  page at a host (by the n-gram Jaccard join over open blocks) count as one page, so that they do not empty each other;
- declared articles lose every token in a run of ARTICLE_RUN tokens that at least half of the host's articles have, if
  these are MIN_PAGES or more: a share line or a notice without a mark. A passage that fewer pages share is a quotation
  and stays. An article that such runs cover for the larger part is a copy of the others and keeps all.

Of the suffix array only the answer is built: which strings of so many tokens occur on which number of pages, counted
by a shuffle over hashed runs. For articles only anchors are sent at first (the smallest of each window of grams, which
content alone decides, so pages that share a string share its anchors), then the runs around frequent anchors. No task
holds a host, and the size of a host changes nothing.

Defined results: a null or empty html gives an empty text; a page with a null url, or one without a host, is judged by
itself; repeated rows and null page_ids are extracted row by row (a page repeated under one page_id and url does not
count as two pages for open blocks); an empty table gives an empty result; extra columns are ignored; broken markup is
read as far as it goes; very long pages are read whole. White space is what Unicode calls so, no-break spaces included.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import cut, mix64, text_bytes, tune
from graphloom.llm.components import connected_components
from graphloom.llm.jaccard import similar_components
from graphloom.llm.shingles import word_hashes
from graphloom.llm.suffixes import anchors

#: Tokens that a run must have to count as repeated, in open blocks and in declared articles.
MIN_RUN = 8
ARTICLE_RUN = 10
#: Tokens of the grams among which anchors are chosen, and the places of a gram in a run.
GRAM = 4
PLACES = ARTICLE_RUN - GRAM + 1
#: Articles that a host must have before half of them can make a run a notice.
MIN_PAGES = 3
#: Bytes of frequent runs of all hosts up to which they are sent to every task; beyond, pages are joined with them by host.
SENT_BYTES = 4 << 20

CONTENT, OPEN, CHROME = 0, 1, 2
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
#: Elements that never belong to an article.
OUTSIDE = frozenset("nav footer aside form menu button select option fieldset dialog svg canvas audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img "
    "label object math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle".split()
)
#: Words of class names and ids that declare something else than an article, and words that do so in some names ("share-buttons").
#: A name declares it only if all its words are such or are of BESIDE: "ad-box" does, "ad-hoc" and "cookie-recipe" do not.
NAMES = frozenset(
    "ad ads adbox adsense adslot adv advert advertisement advertisements adverts breadcrumb breadcrumbs commentlist comments complementary consent contentinfo cookie cookies dfp disqus footer "
    "gdpr masthead modal nav navbar navi navigation newsletter outbrain pager pagination paywall popup promo promos sharebar sidebar sidenav signup sponsor sponsored sponsors subscribe taboola "
    "widget widgets".split()
)
MAYBE = frozenset(
    "advertising alert alerts banner banners comment cta dialog discussion menu menus meta notice notices overlay promoted promotion recommendation recommendations recommended related replies "
    "reply respond search share sharing social subscription tags toc toolbar".split()
)
BESIDE = frozenset(
    "a an active area article articles auto bar bars big block blocks body bottom box boxes btn button buttons by center centre closed col collapsed column container content count dark default "
    "desktop dynamic email end entries entry expanded feed field first fixed floating for form full global group head header heading hidden holder horizontal icon icons id in inline inner input "
    "inserted item items js label large last latest lazy leaderboard left light link links list loaded local main me media mid middle mini mobile module more mpu native now number of on open outer "
    "page panel placeholder popular post posts primary rail recent responsive right row second secondary section site skyscraper slot slots small static sticky stories story strip tall text the "
    "third tile tiles title to top unit units vertical visible wide wrap wrapper x zone".split()
)
#: Elements in which a header belongs to what they hold, not to the site.
HOLDERS = frozenset("article main section".split())
#: Elements that close an open element of the same set when they begin.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS_THAT_END_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
MARK = re.compile(r"<(?:!--(.*?)(?:-->|\Z)|([!?][^>]*)>?|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
PART = re.compile(r"[^\W\d_]+|[0-9]+")
YEAR = re.compile("(?:19|20)[0-9][0-9]")


def _names_chrome(name: str) -> bool:
    """Whether a class name or id says that its element is no part of an article. Numbers say nothing, but years do."""
    parts = [p.lower() for p in PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name))]
    told = [p in NAMES or p in MAYBE for p in parts]
    return any(told) and all(t or p in BESIDE or (p.isdigit() and not YEAR.fullmatch(p)) for t, p in zip(told, parts))


def _declared(tag: str, attributes: str, held: bool) -> int | None:
    """CONTENT or CHROME if the element declares what it holds, else None. held: whether it stands in one of HOLDERS."""
    found = {}
    if attributes.strip(" /\t\n\r\f"):
        for k, v in ATTRIBUTE.findall(attributes):
            found.setdefault(k.lower(), html_lib.unescape(v.strip("\"'")) if v else "")
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return CHROME
    role = found.get("role", "").lower()
    if tag in OUTSIDE or (tag == "header" and not held) or role in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form"):
        return CHROME
    if tag not in ("html", "body", "main") and any(map(_names_chrome, (found.get("class", "") + " " + found.get("id", "")).split())):
        return CHROME
    if tag in ("article", "main") or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody":
        return CONTENT
    return None


def blocks_of(html: str) -> list[tuple[str, int, float]]:
    """(text, CONTENT | OPEN | CHROME, share of its characters inside links) of each block that has text, in page order."""
    out: list[tuple[str, int, float]] = []
    stack: list[tuple[str, int]] = []
    parts: list[str] = []
    linked = total = links = holders = 0
    kind = OPEN
    opened: Counter = Counter()  # elements of each name on the stack

    def flush():
        nonlocal linked, total
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, kind, linked / total if total else 0.0))
            parts.clear()
        linked = total = 0

    def say(raw: str):
        nonlocal linked, total
        if raw and kind is not None:
            text = html_lib.unescape(raw) if "&" in raw else raw
            parts.append(text)
            n = len(text) - text.count(" ")
            total += n
            linked += n * (links > 0)

    def turn():
        nonlocal kind
        now = stack[-1][1] if stack else OPEN
        if now != kind:
            flush()
            kind = now

    def pop_to(i: int):
        nonlocal links, holders
        for t, _ in stack[i:]:
            opened[t] -= 1
            links -= t == "a"
            holders -= t in HOLDERS
        del stack[i:]
        turn()

    at, n = 0, len(html)
    while at < n:
        i = html.find("<", at)
        if i < 0:
            say(html[at:])
            break
        m = MARK.match(html, i)
        if m is None:  # a bare less-than sign
            say(html[at : i + 1])
            at = i + 1
            continue
        say(html[at:i])
        at = m.end()
        tag = m[4]
        if tag is None:
            continue
        tag = tag.lower()
        if m[3]:
            if tag not in INLINE:
                flush()
            if opened[tag]:
                pop_to(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if tag not in INLINE:
            flush()
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>?", re.I).search(html, at)
            at = end.end() if end else n
            continue
        closes = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCKS_THAT_END_P else set())
        if closes:
            for k in range(len(stack) - 1, -1, -1):  # up to the nearest block that is not closed by this one
                if stack[k][0] in closes:
                    pop_to(k)
                    break
                if stack[k][0] not in INLINE and stack[k][0] not in closes:
                    break
        if tag in VOID or m[5].endswith("/") and tag in ("svg", "path"):
            continue
        own = stack[-1][1] if stack else OPEN
        if own != CHROME:
            said = _declared(tag, m[5], holders > 0)
            own = own if said is None else said
        stack.append((tag, own))
        opened[tag] += 1
        links += tag == "a"
        holders += tag in HOLDERS
        turn()
    flush()
    return out


def run_keys(stream: np.ndarray, host: int, run: int = MIN_RUN) -> np.ndarray:
    """64-bit hashes of (host, `run` tokens), one for each place of the stream where such a run begins."""
    n = max(0, len(stream) - run + 1)
    keys = np.full(n, host & (2**64 - 1), np.uint64)
    for d in range(run):
        keys = mix64(keys * np.uint64(31) + stream[d : d + n])
    return keys


def covered(repeated: np.ndarray, run: int = MIN_RUN) -> np.ndarray:
    """Which tokens lie in a run that is repeated, given whether the run at each place is."""
    hit = np.zeros(len(repeated) + run, np.int64)
    hit[: len(repeated)] += repeated
    hit[run:] -= repeated
    return np.cumsum(hit)[:-1] > 0


def within_blocks(cover: np.ndarray, counts: np.ndarray, run: int) -> np.ndarray:
    """cover, less the pieces that hold a part of a block only and fewer than `run` tokens of it: the first words of an
    article are not boilerplate because they follow some."""
    if not cover.any():
        return cover
    ends = np.cumsum(counts)
    first = np.zeros(len(cover), bool)
    first[(ends - counts)[counts > 0]] = True
    starts = np.flatnonzero(cover & (first | ~np.concatenate(([False], cover[:-1]))))
    lengths = np.add.reduceat(cover.astype(np.int64), starts)  # a piece ends at the next one, or where the cover does
    block = np.searchsorted(ends, starts, "right")
    keep = np.repeat((lengths >= run) | (lengths == counts[block]), lengths)
    out = np.zeros(len(cover), bool)
    out[np.flatnonzero(cover)[keep]] = True
    return out


def own_anchors(stream: np.ndarray, host: int, _) -> np.ndarray:
    """Hashes of the anchors of a stream."""
    grams = run_keys(stream, host, GRAM)
    return np.unique(grams[anchors(grams, PLACES)])


def near_anchors(stream: np.ndarray, host: int, wanted: np.ndarray) -> np.ndarray:
    """Hashes of the runs of ARTICLE_RUN tokens that hold an anchor of `wanted`."""
    grams = run_keys(stream, host, GRAM)
    at = anchors(grams, PLACES)
    at = at[np.isin(grams[at].view(np.int64), wanted)]
    starts = np.unique((at[:, None] - np.arange(PLACES)).ravel())
    keys = run_keys(stream, host, ARTICLE_RUN)
    return np.unique(keys[starts[(starts >= 0) & (starts < len(keys))]])


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, number of tokens of each text); A-Z and a-z are one."""
    return word_hashes(*text_bytes(pa.array(texts, pa.string())))


def without_runs(texts: list[str], cover: np.ndarray) -> list[str]:
    """The texts without the tokens that are covered; texts of which nothing is left go."""
    if not cover.any():
        return texts
    out, at = [], 0
    for text in texts:
        words = text.split(" ")
        kept = [w for w, c in zip(words, cover[at : at + len(words)].tolist()) if not c]
        at += len(words)
        if kept:
            out.append(" ".join(kept))
    return out


BLOCKS = "texts array<string>, kinds array<int>, shares array<double>"


def parse(pages: DataFrame) -> DataFrame:
    """page_id, url, texts, kinds and shares (of links) of the blocks of every row; nothing is shuffled."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches):
        for batch in batches:
            found = [blocks_of(html or "") for html in batch.column(2).to_pylist()]
            columns = [pa.array([[b[i] for b in blocks] for blocks in found], pa.list_(t)) for i, t in enumerate((pa.string(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["page_id", "url", "texts", "kinds", "shares"])

    return pages.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, {BLOCKS}")


def _of_kind(kind: int):
    """Texts of the blocks of a kind, as an array."""
    return F.transform(F.filter(F.arrays_zip("texts", "kinds"), lambda b: b["kinds"] == kind), lambda b: b["texts"])


def _hashes(batches, make, name: str):
    """(key, name) for each hash that make(stream, key, wanted) gives for the rows (key, texts, wanted)."""
    for batch in batches:
        key = batch.column(0).to_numpy()
        found = [make(tokens_of(t)[0], int(k), np.array(w or [], np.int64)).view(np.int64) for k, t, w in zip(key, batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(key, list(map(len, found)))), pa.array(np.concatenate([np.empty(0, np.int64), *found]))], ["key", name])


def frequent_runs(articles: DataFrame) -> DataFrame | None:
    """(key, runs): the runs of ARTICLE_RUN tokens that at least half of a host's articles have; None if there are none.

    A host has at most twice as many of them as its articles have tokens on average, however many articles it has.
    """
    hosts = articles.groupBy("key").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= MIN_PAGES)

    def frequent(found: DataFrame, name: str) -> DataFrame:
        counted = found.groupBy("key", name).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").join(hosts, "key")
        return counted.filter(F.col("n") * 2 >= F.col("pages")).groupBy("key").agg(F.collect_list(name).alias("wanted"))

    nothing = F.lit(None).cast("array<long>").alias("wanted")
    sent = articles.select("key", "texts", nothing).mapInArrow(lambda b: _hashes(b, own_anchors, "anchor"), "key long, anchor long")
    likely = cut(frequent(sent, "anchor"), "anchors")
    if likely.isEmpty():
        return None
    around = with_runs(articles.select("key", "texts"), likely, "inner").mapInArrow(lambda b: _hashes(b, near_anchors, "run"), "key long, run long")
    runs = cut(frequent(around, "run"), "runs")
    return None if runs.isEmpty() else runs


def with_runs(rows: DataFrame, runs: DataFrame, how: str) -> DataFrame:
    """rows with the runs of their host, which go to every task only if they are few."""
    size = runs.agg(F.sum(8 * F.size("wanted") + 16)).first()[0] or 0
    return rows.join(F.broadcast(runs) if size <= SENT_BYTES else runs, "key", how)


def declared_texts(rows: DataFrame) -> DataFrame:
    """page_id, url, text of the pages that declare an article, less the runs that half of the host's articles have."""
    articles = rows.filter(F.exists("kinds", lambda k: k == CONTENT)).select("page_id", "url", "key", _of_kind(CONTENT).alias("texts"))
    runs = frequent_runs(articles.filter("key is not null"))
    whole = F.array_join("texts", " ").alias("text")
    if runs is None:
        return articles.select("page_id", "url", whole)
    joined = with_runs(articles, runs, "left")

    def solve(batches):
        for batch in batches:
            out = []
            for key, texts, wanted in zip(*(c.to_pylist() for c in batch.columns[2:])):
                stream, counts = tokens_of(texts)
                cover = covered(np.isin(run_keys(stream, key, ARTICLE_RUN).view(np.int64), np.array(wanted, np.int64)), ARTICLE_RUN)[: len(stream)]
                cover = within_blocks(cover, counts, ARTICLE_RUN)
                out.append(" ".join(texts if 2 * cover.sum() > len(stream) else without_runs(texts, cover)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    judged = joined.filter("wanted is not null").select("page_id", "url", "key", "texts", "wanted").mapInArrow(solve, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return judged.unionByName(joined.filter("wanted is null").select("page_id", "url", whole))


def owners(rows: DataFrame) -> DataFrame:
    """row, owner: rows of one page_id and url at a host, and pages whose open blocks are equal or near copies, count as one page."""
    page = F.xxhash64("key", "page_id", "url")
    # blocks that consist of links are never kept, so they do not tell copies apart
    kept = F.filter(F.arrays_zip("texts", "kinds", "shares"), lambda x: (x["kinds"] == OPEN) & (x["shares"] <= 0.5))
    texts = rows.filter("open").select(F.col("row").alias("doc_id"), F.array_join(F.transform(kept, lambda x: x["texts"]), " ").alias("text"))
    sets, linked = similar_components(texts)
    copies = sets.filter("n > 0").join(linked, "sid", "left").select(F.col("doc_id").alias("row"), F.coalesce("grp", "sid").alias("copy"))
    pages = rows.select("row", "key", page.alias("page"))
    edges = pages.join(copies, "row").select(F.col("page").alias("a"), F.xxhash64("key", "copy", F.lit("copy")).alias("b"))
    found = cut(connected_components(edges), "owners")
    return pages.join(found, pages["page"] == found["id"], "left").select("row", F.coalesce("component", "page").alias("owner"))


def open_texts(rows: DataFrame) -> DataFrame:
    """page_id, url, text of the pages that declare no article: their open blocks less what two pages of the host have."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    declared = F.exists("kinds", lambda k: k == CONTENT)
    rows = rows.withColumn("open", ~declared & F.exists("kinds", lambda k: k == OPEN))
    alone = rows.filter(~declared & (~F.col("open") | F.col("key").isNull())).withColumn("runs", F.lit(None).cast("array<long>"))
    if rows.filter("open and key is not null").isEmpty():
        marked = alone
    else:
        hosts = rows.filter("open and key is not null").select("key").distinct()
        outside = F.transform(F.filter(F.arrays_zip("texts", "kinds"), lambda b: b["kinds"] != CONTENT), lambda b: b["texts"])
        held = cut(rows.join(hosts, "key", "left_semi").withColumn("outside", outside), "open")
        owned = held.join(owners(held), "row")

        def runs(batches):
            for batch in batches:
                owner, keys = batch.column(0).to_numpy(), batch.column(1).to_pylist()
                found = [np.unique(run_keys(tokens_of(t)[0], k)).view(np.int64) for t, k in zip(batch.column(2).to_pylist(), keys)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *found])), pa.array(np.repeat(owner, list(map(len, found))))], ["run", "owner"])

        # the least and the largest owner of a run say whether two pages have it, and combine before the shuffle
        seen = owned.select("owner", "key", "outside").mapInArrow(runs, "run long, owner long").groupBy("run").agg(F.min("owner").alias("low"), F.max("owner").alias("high"))
        own = held.filter("open").select("row", "key", "outside").mapInArrow(runs, "run long, owner long").withColumnRenamed("owner", "row")
        found = own.join(seen.filter("low <> high").select("run"), "run", "left_semi").groupBy("row").agg(F.collect_list("run").alias("runs"))
        marked = held.filter("open").drop("outside").join(found, "row", "left").unionByName(alone)

    def solve(batches):
        for batch in batches:
            out = []
            for key, texts, kinds_, shares, marks in zip(*(c.to_pylist() for c in batch.columns[2:])):
                stream, counts = tokens_of(texts)
                cover = np.zeros(len(stream), bool)
                if marks:
                    cover = covered(np.isin(run_keys(stream, key).view(np.int64), np.array(marks, np.int64)))[: len(stream)]
                    cover = within_blocks(cover, counts, MIN_RUN)
                keep = [i for i, (k, s) in enumerate(zip(kinds_, shares)) if k == OPEN and s <= 0.5]
                at = np.cumsum(counts) - counts
                taken = np.concatenate([np.empty(0, bool), *(cover[at[i] : at[i] + counts[i]] for i in keep)])
                out.append(" ".join(without_runs([texts[i] for i in keep], taken)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return marked.select("page_id", "url", "key", "texts", "kinds", "shares", "runs").mapInArrow(solve, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages(page_id, url, html)."""
    tune(pages.sparkSession)
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))
    parsed = parse(pages.select("page_id", "url", "html")).withColumn("key", F.when(host != "", F.xxhash64(host))).withColumn("row", F.monotonically_increasing_id())
    rows = cut(parsed, "blocks")
    both = declared_texts(rows).unionByName(open_texts(rows))
    return both.withColumn("n_chars", F.length("text").cast("long"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
