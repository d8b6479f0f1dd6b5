"""Operator 4: main text of web pages, with the host's boilerplate found by a suffix array.

A page is cut into blocks. Markup says of most what they are: of the article (inside the page's main container) or
furniture (menus, headers, footers, sidebars, notices, adverts, forms, comments). Blocks of neither are undecided.
For each host with such blocks the token streams of all that is not article are concatenated; in their suffix array,
neighbours with a long common prefix are substrings that pages share. Those that enough distinct pages have
(``LEVELS``) are boilerplate and go from undecided blocks; all else is kept. Pages with nearly the same main text count
as one, whatever stands around it, so an article that is given several times is not its own boilerplate. A passage
that markup says is of the article is never removed for being repeated.

A host of more pages or text than a suffix array takes has its runs counted by their hashes, with the same outcome.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quern.llm.components import components
from quern.llm.shared import grams, materialise, mix

#: Tokens in the runs by which the main texts of pages are compared.
RUN = 5
#: Boilerplate is a run of as many tokens that at least this share, and this number, of the host's distinct pages have.
LEVELS = ((8, 0.5, 3), (32, 0.1, 5))
#: Pages of a host, and characters around their articles, that one suffix array takes at most.
SHARD_PAGES, SHARD_CHARS = 1024, 16_000_000
#: Signature of a main text, and the share of equal registers from which two pages of a host count as one.
BANDS, ROWS, SAME_PAGE = 20, 3, 0.5
ARTICLE, FURNITURE, UNDECIDED = 0, 1, 2

_NAMED = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")

RAW = frozenset("script style noscript template svg iframe textarea object canvas video audio math title".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul button".split())
CONTAINERS = frozenset("article aside body button center details dialog div dl fieldset figure footer form head header html main menu nav ol section select table ul span p".split())
FURNITURE_TAGS = frozenset("nav footer aside form button select menu dialog head fieldset".split())
FURNITURE_NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login popup modal overlay social share sharing related recommended recommendations comment comments disqus respond reply replies pagination pager copyright toolbar widget skip complementary contentinfo search".split())
ARTICLE_NAMES = frozenset("article articlebody post entry story content main".split())
#: Names of other people's texts and other pages', which have containers like an article's.
OTHERS_NAMES = frozenset("related recommended recommendations comment comments disqus respond reply replies".split())
#: Elements that hold the whole page or its main part, whatever their names say of the layout.
WHOLE_TAGS = frozenset("html body main".split())
#: A name that tells what the layout has or lacks, not what the element is.
_MODIFIER = re.compile(r"(?<![a-z])(?:has|with|without|no)[-_]\S*")


def _rank(tag: str, names: set[str], role: str) -> int:
    """How surely an element is the container of the article; 0: it isn't one."""
    if tag == "article" or "articlebody" in names:
        return 3
    if tag == "main" or role == "main":
        return 2
    return 1 if tag in ("div", "section") and names & ARTICLE_NAMES else 0


@dataclass
class _Container:
    """A ranked container inside elements that only their names make furniture (``around``: the place in the page of the
    innermost, and those around it)."""

    rank: int
    around: tuple
    others: bool
    chars: int = 0


def blocks_of(page: str | None) -> list[tuple[int, str]]:
    """(kind, text) of the blocks of a page in order; references decoded, white space single, no empty block.

    Names don't make furniture of an element that holds the page's best container: one that has more text than all
    that is outside such elements and ranks as high, or any where no container is outside them.
    """
    blocks, inside = _read(page or "", frozenset())
    best = max((r for r, _ in blocks), default=0)
    if inside:
        kept = sum(len(text) for r, text in blocks if r == max(best, 0))
        fit = [c for c in inside if c.chars and (best <= 0 and not c.others or c.rank >= best and c.chars > kept and not (c.others and best > 0))]
        if fit:
            around, places = max(fit, key=lambda c: (not c.others, c.rank, c.chars)).around, []
            while around:
                place, around = around
                places.append(place)
            blocks, _ = _read(page or "", frozenset(places))
            best = max((r for r, _ in blocks), default=0)
    return [(FURNITURE if r < 0 else ARTICLE if best > 0 and r == best else UNDECIDED, text) for r, text in blocks]


class _Tags:
    """The tags of a page, in order. Time is linear in its length, however the page is broken."""

    def __init__(self, page: str):
        self.page, self.at = page, 0
        self.open_until = 0  # tags that begin before end at the next ``>``, as quotes in them never close
        self.last = page.rfind(">")

    def _end(self, begin: int, name_end: int) -> int:
        """Where the tag ends; a ``>`` in quotes doesn't end it. The end of the page if nothing does."""
        at = name_end
        while begin >= self.open_until and (m := _STOP.search(self.page, at)):
            if m[0] == ">":
                return m.start()
            close = self.page.find(m[0], m.end())
            if close < 0:
                self.open_until = m.start() + 1
                break
            at = close + 1
        else:
            if begin >= self.open_until:
                self.open_until = len(self.page)
        end = self.page.find(">", name_end) if name_end <= self.last else -1
        return end if end >= 0 else len(self.page)

    def next(self) -> tuple[int, int, str, str, str] | None:
        """Start and end of the next tag or comment, ``/`` if it closes, lower-case name ("" for a comment), attributes."""
        page = self.page
        while (begin := page.find("<", self.at)) >= 0:
            self.at = begin + 1
            if page.startswith("<!--", begin):
                end = page.find("-->", begin + 4)
                self.at = end + 3 if end >= 0 else len(page)
                return begin, self.at, "", "", ""
            if page[begin + 1 : begin + 2] in ("!", "?"):
                if begin < self.last:
                    self.at = page.find(">", begin) + 1
                    return begin, self.at, "", "", ""
                continue
            if m := _NAMED.match(page, begin):
                end = self._end(begin, m.end())
                self.at = min(end + 1, len(page))
                return begin, self.at, m[1], m[2].lower(), page[m.end() : end]
        return None


def _read(page: str, spared: frozenset[int]) -> tuple[list[tuple[int, str]], list[_Container]]:
    """Blocks with the rank of their container (-1 for furniture, 0 outside), and the containers inside furniture.

    ``spared``: places of elements that their names don't make furniture.
    """
    out: list[tuple[int, str]] = []
    found_inside: list[_Container] = []
    # Open containers, and what holds inside them: the rank; the places of the elements that are furniture by name
    # alone, None where tags or attributes say so too; whether others' texts are among these; the container.
    stack: list[tuple[str, tuple]] = []
    pieces: list[str] = []
    outside = (0, (), False, None)
    state = outside
    rank = 0

    def flush() -> None:
        if pieces:
            text = _SPACE.sub(" ", entities.unescape("".join(pieces))).strip()
            if text:
                out.append((rank, text))
                if state[3]:
                    state[3].chars += len(text)
            pieces.clear()

    at, tags, open_names = 0, _Tags(page), Counter()
    while found_tag := tags.next():
        begin, end, closing, tag, attributes = found_tag
        if begin > at:
            pieces.append(page[at:begin])
        at = end
        if not tag:
            continue
        if tag in RAW and not closing:
            if not attributes.rstrip().endswith("/"):
                close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = tags.at = close.end() if close else len(page)
            continue
        if tag in BLOCKS:
            flush()
        if tag not in CONTAINERS or (tag in ("span", "p") and not closing and not attributes):
            continue
        if closing:
            if open_names[tag]:
                while stack:
                    name, _ = stack.pop()
                    open_names[name] -= 1
                    if name == tag:
                        break
                inner = stack[-1][1] if stack else outside
                if inner[0] != rank or inner[3] is not state[3]:
                    flush()
                state = inner
                rank = state[0]
            continue
        found = {k.lower(): _MODIFIER.sub("", v.strip("\"'").lower()) for k, v in _ATTRIBUTE.findall(attributes)} if attributes else {}
        words = " ".join(found.get(k, "") for k in ("class", "id", "role", "itemprop"))
        names = set(_NAME.findall(words))
        own = _rank(tag, names, found.get("role", ""))
        certain = tag in FURNITURE_TAGS or found.get("aria-hidden") == "true" or tag == "header" and rank < 2
        named = tag not in WHOLE_TAGS and begin not in spared and (names & FURNITURE_NAMES and not (own >= 2 and not names & {"comment", "comments", "reply"}) or "header" in names and rank < 2 and not own)
        around, others, container = state[1:]
        if rank >= 0 and not certain and not named:
            inside = (max(rank, own), around, others, container)
        elif around is None or certain:
            inside = (-1, None, others, None)
        else:
            if named:
                around, others, container = (begin, around), others or bool(names & OTHERS_NAMES), None
                if own and not any(set(_NAME.findall(w)) & ARTICLE_NAMES and not set(_NAME.findall(w)) & FURNITURE_NAMES for w in words.split()):
                    own = 0
            if own > (container.rank if container else 0):
                container = _Container(own, around, others)
                found_inside.append(container)
            inside = (-1, around, others, container)
        if inside[0] != rank or inside[3] is not state[3]:
            flush()
        stack.append((tag, inside))
        open_names[tag] += 1
        state = inside
        rank = state[0]
    pieces.append(page[at:])
    flush()
    return out, found_inside


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by prefix doubling."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        after = np.full(n, -1, dtype=np.int64)
        after[: max(0, n - width)] = rank[width:]
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, dtype=np.int64)
        new[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
        rank = new
        if n == 0 or rank[order[-1]] == n - 1 or width >= n:
            return order
        width *= 2


def repeated_starts(streams: list[np.ndarray], identity: list, run: int = RUN, least: int = 2) -> list[np.ndarray]:
    """For each page's stream the starts of the runs of ``run`` tokens that pages of ``least`` identities have."""
    lengths = [len(s) for s in streams]
    page = np.repeat(np.arange(len(streams)), [n + 1 for n in lengths])
    owner = np.unique(np.array(identity, dtype=object).astype(str), return_inverse=True)[1]
    body = np.unique(np.concatenate([*streams, np.zeros(0, dtype=np.uint64)]), return_inverse=True)[1].astype(np.int64)
    tokens = np.empty(len(page), dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum([n + 1 for n in lengths])]).astype(np.int64)
    at = np.ones(len(page), dtype=bool)
    at[starts[1:] - 1] = False
    tokens[at] = body
    tokens[~at] = -1 - np.arange(len(streams))  # ends differ, so no run reaches past one
    order = suffix_array(tokens)
    padded = np.concatenate([tokens, -1 - len(streams) - np.arange(run)])
    same = np.ones(max(0, len(order) - 1), dtype=bool)
    for k in range(run):
        same &= padded[order[:-1] + k] == padded[order[1:] + k]
    group = np.concatenate([[0], np.cumsum(~same)]) if len(order) else np.zeros(0, dtype=np.int64)
    whose = np.unique(group * (len(streams) + 1) + owner[page[order]]) // (len(streams) + 1)
    hit = np.sort(order[np.bincount(whose, minlength=len(order))[group] >= least])
    return np.split(hit - starts[page[hit]], np.searchsorted(page[hit], np.arange(1, len(streams))))


def token_hashes(texts: list[str]) -> np.ndarray:
    """Hashes of the tokens between white space, of blocks in order."""
    return np.array([int.from_bytes(blake2b(t.encode("utf-8", "replace"), digest_size=8).digest(), "little") for text in texts for t in text.split()], dtype=np.uint64)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of ``pages``: page_id, url, text, n_chars.

    A null or empty html has an empty text. Pages with a null url, or one without a host, are taken as of one
    host. Pages of a host with nearly equal main texts count as one, so a page given twice is not its own boilerplate.
    Repeated rows give a row each; other columns are not read. An empty table gives an empty result. Pages are read
    whole in time linear in their length, however long or broken they are; a page must fit in a task's memory.
    """
    kind = "array<struct<kind:int,text:string>>"
    arrow = pa.list_(pa.struct([("kind", pa.int32()), ("text", pa.string())]))

    @arrow_udf(kind)
    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([[{"kind": k, "text": t} for k, t in blocks_of(p)] for p in batch.to_pylist()], arrow)

    parsed = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), parse(F.col(html_col)).alias("blocks"))
    spoken = lambda *kinds: F.transform(F.filter("blocks", lambda b: b["kind"].isin(*kinds)), lambda b: b["text"])
    unsure = F.exists("blocks", lambda b: b["kind"] == UNDECIDED)
    parsed = parsed.select("page_id", "url", F.monotonically_increasing_id().alias("row"), F.when(unsure, F.col("blocks")).alias("blocks"), spoken(FURNITURE, UNDECIDED).alias("around"), F.when(~unsure, F.array_join(spoken(ARTICLE), " ")).alias("text"))
    parsed = materialise(parsed, "pages")
    done = parsed.where("text is not null").select("page_id", "url", "text")

    if parsed.where("text is null").isEmpty():
        return done.withColumn("n_chars", F.length("text").cast("bigint"))
    open_pages = parsed.where("text is null").select("page_id", "url", "row", "blocks")
    streams = parsed.select("row", host_of(F.col("url")).alias("host"), "around", F.when(F.col("text").isNull(), spoken(ARTICLE, UNDECIDED)).otherwise(F.array("text")).alias("main"))
    streams = streams.join(open_pages.select(host_of(F.col("url")).alias("host")).distinct(), "host", "left_semi")
    open_pages = open_pages.join(_repeated_runs(streams), "row", "left")

    @arrow_udf("string")
    def finish(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for blocks, runs in batches:
            yield pa.array([kept_text([(b["kind"], b["text"]) for b in bs or ()], [(r["start"], r["n"]) for r in rs or ()]) for bs, rs in zip(blocks.to_pylist(), runs.to_pylist(), strict=True)], pa.string())

    rest = open_pages.select("page_id", "url", finish("blocks", "runs").alias("text"))
    return done.union(rest).withColumn("n_chars", F.length("text").cast("bigint"))


def kept_text(blocks: list[tuple[int, str]], runs) -> str:
    """Article blocks whole, undecided ones without the tokens that repeated runs (start, length) cover, joined by one space."""
    covered = {k for start, n in runs for k in range(start, start + n)}
    out, at = [], 0
    for kind, text in blocks:
        if kind == ARTICLE:
            out.append(text)
            continue
        tokens = text.split(" ")
        kept = [t for k, t in enumerate(tokens, at) if k not in covered]
        at += len(tokens)
        if kind == UNDECIDED and kept:
            out.append(" ".join(kept))
    return " ".join(out)


def signature(texts: list[str]) -> tuple[list[int], bytes]:
    """Keys of the bands, and the registers, of the set of runs of a main text; an empty text has none."""
    runs = np.unique(grams(token_hashes(texts), RUN))
    if not len(runs):
        return [], b""
    registers = np.array([mix(runs ^ mix(np.array([k + 1], dtype=np.uint64))).min() for k in range(BANDS * ROWS)], dtype=np.uint64)
    keys = [int.from_bytes(blake2b(bytes([band]) + rows.tobytes(), digest_size=8).digest(), "little", signed=True) for band, rows in enumerate(registers.reshape(BANDS, ROWS))]
    return keys, registers.tobytes()


def _identities(streams: DataFrame) -> DataFrame:
    """(row, page): pages of a host with nearly the same main text have the same number.

    Main texts that are equal are one from the start, so however many copies there are they make one row. The others
    are compared with one page of each bucket of theirs. Pages without a main text are told apart by what is around it.
    """

    @arrow_udf("struct<text:binary,keys:array<bigint>,registers:binary>")
    def sign(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.struct([("text", pa.binary()), ("keys", pa.list_(pa.int64())), ("registers", pa.binary())])
        for mains, arounds in batches:
            out = []
            for main, around in zip(mains.to_pylist(), arounds.to_pylist(), strict=True):
                keys, registers = signature(main)
                words = [w for text in (main if keys else around) for w in text.split()]
                out.append({"text": blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=16).digest(), "keys": keys, "registers": registers})
            yield pa.array(out, kind)

    signed = materialise(streams.select("row", "host", sign("main", "around").alias("s")).select("row", "host", "s.*"), "main-signatures")
    texts = materialise(signed.groupBy("host", "text").agg(F.min(F.struct("row", "keys", "registers")).alias("s")).select("host", "text", "s.*"), "main-texts")
    members = texts.select("host", F.explode("keys").alias("key"), "row", "registers")
    leaders = members.groupBy("host", "key").agg(F.count("*").alias("n"), F.min_by(F.struct("row", "registers"), F.xxhash64("key", "row")).alias("leader")).where("n > 1")

    @arrow_udf("boolean")
    def same(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            x, y = (np.frombuffer(b"".join(side.to_pylist()), dtype="<u8").reshape(-1, BANDS * ROWS) for side in (left, right))
            yield pa.array((x == y).mean(axis=1) >= SAME_PAGE)

    pairs = members.join(leaders, ["host", "key"]).where(F.col("row") != F.col("leader.row"))
    links = pairs.where(same(F.col("registers"), F.col("leader.registers"))).select(F.col("row").alias("a"), F.col("leader.row").alias("b"))
    merged = texts.select("host", "text", "row").join(components(links).withColumnRenamed("node", "row"), "row", "left").select("host", "text", F.coalesce("component", "row").alias("page"))
    return signed.select("row", "host", "text").join(merged, ["host", "text"]).select("row", "page")


def _repeated_runs(streams: DataFrame) -> DataFrame:
    """(row, runs): where in a page's stream (``around``, the blocks that are not article) boilerplate begins, and its length."""
    streams = materialise(streams.join(_identities(streams), "row"), "streams")
    counts = streams.groupBy("host").agg(F.count("*").alias("rows"), F.countDistinct("page").alias("pages"), F.sum(F.length(F.array_join("around", " "))).alias("chars"))
    dealt = streams.where(F.size("around") > 0).join(counts, "host")
    needed = lambda share, least, pages: F.greatest(F.ceil(F.lit(share) * pages), F.lit(least))

    def search(table: pa.Table) -> pa.Table:
        found = [token_hashes(texts) for texts in table["around"].to_pylist()]
        runs: list[list[dict]] = [[] for _ in found]
        pages = table["pages"][0].as_py()
        for n, share, least in LEVELS:
            for into, starts in zip(runs, repeated_starts(found, table["page"].to_pylist(), n, max(least, ceil(share * pages))), strict=True):
                into += [{"start": k, "n": n} for k in starts.tolist()]
        return pa.table({"row": table["row"].cast(pa.int64()), "runs": pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())])))})

    fits = (F.col("rows") <= SHARD_PAGES) & (F.col("chars") <= SHARD_CHARS)
    small = dealt.where(fits).select("host", "row", "page", "pages", "around")
    within = small.groupBy("host").applyInArrow(search, "row bigint, runs array<struct<start:int,n:int>>")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, row, page, texts in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                tokens = token_hashes(texts)
                for level, (width, _, _) in enumerate(LEVELS):
                    if len(tokens) >= width:
                        runs = grams(tokens, width).view(np.int64)
                        n = len(runs)
                        yield pa.RecordBatch.from_arrays([pa.array([host] * n), pa.array([row] * n, pa.int64()), pa.array([page] * n, pa.int64()), pa.array([level] * n, pa.int32()), pa.array(runs), pa.array(range(n), pa.int32())], names=["host", "row", "page", "level", "run", "start"])

    large = dealt.where(~fits).select("host", "row", "page", "around").mapInArrow(windows, "host string, row bigint, page bigint, level int, run bigint, start int")
    widths = F.create_map(*[F.lit(x) for level, (width, _, _) in enumerate(LEVELS) for x in (level, width)])
    enough = F.coalesce(*[F.when(F.col("level") == level, needed(share, least, F.col("pages"))) for level, (_, share, least) in enumerate(LEVELS)])
    common = large.groupBy("host", "level", "run").agg(F.countDistinct("page").alias("support")).join(counts, "host").where(F.col("support") >= enough).select("host", "level", "run")
    across = large.join(common, ["host", "level", "run"], "left_semi").groupBy("row").agg(F.collect_list(F.struct("start", F.element_at(widths, F.col("level")).alias("n"))).alias("runs"))
    return within.union(across.select("row", "runs"))
