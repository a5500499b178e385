"""Main text of web pages, with boilerplate found as substrings repeated on a host.

A page is read into blocks of three kinds: text inside an article or main
element, text of parts whose element says what they are (navigation, footers,
forms, adverts, comments ...), and text of neither kind. A page has two token
streams: that of its blocks inside an article and that of all others. Streams
of each sort are put together for a host, and runs of ``RUN`` tokens or more
that several distinct streams of the host share are boilerplate. A page keeps
the other tokens of its articles and of its blocks of neither kind. The two
sorts are not mixed, so a teaser beside other articles takes nothing from its
own. An article of which more than half would go is a version of other
articles, not boilerplate, and is kept as it is.

The host's streams are compared as a suffix array is, suffixes by their first
``RUN`` tokens, without a row per token: every window of ``RUN`` tokens first
shows its minimiser, the smallest hash of ``LEAD`` tokens in it, with the host
and the sort. Equal windows have equal minimisers, so only windows whose
minimiser other streams share are compared as a whole. A batch of pages tells
at most as many streams of a minimiser or a run as make it boilerplate, so a
host with a third of all pages is no hot group.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from fragx.llm.common import Sieve, mix64, signed, sliding_minima, stored, token_hashes, window_sums

RUN = 8
#: Tokens of a minimiser.
LEAD = 4
#: Distinct streams of a host that share a run which counts as boilerplate.
STREAMS = 3
#: Shared runs up to which they are sent to the tasks; beyond, pages meet them in a join.
SENT = 2_000_000

#: Letters whose words are hashed together.
TOGETHER = 200_000

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
CLOSER = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
RAW = {"script", "style", "title", "textarea", "iframe", "template"}
PARTS = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "label", "fieldset", "select", "head"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set("""address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3
h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
NAMES = set("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice
notices sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus reply replies share sharing
social related recommended newsletter subscribe subscription signup popup modal overlay pagination pager widget login toolbar copyright""".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
ARTICLE_NAMES = {"article", "post", "entry", "story"}
ARTICLE, PART, OTHER = 0, 1, 2


def is_part(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element's tag or attributes say that it is not main text."""
    if name in PARTS or (name == "header" and not in_article):
        return True
    if not attributes or name in MAIN or name in ("html", "body"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key == "role" and value.strip() in ROLES:
            return True
        if key in ("class", "id"):
            words = set(re.split(r"[^a-z]+", value))
            found = words & NAMES
            if found - {"header"} or (found and not words & ARTICLE_NAMES):
                return True
    return False


def tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Position behind the tag whose name ends at ``at``; -1 if none closes. ``last``: last places of > and quotes, and ``quoting``.

    A > inside quotes does not close; a quote without a partner is an ordinary
    letter. Where no tag closes by these rules, quotes mean nothing from there on.
    """
    first = page.find(">", at) if at <= last[">"] else -1
    while first >= 0:
        m = CLOSER.search(page, at) if last["quoting"] else None
        if m is None:
            last["quoting"] = 0
            return first + 1
        if m[0] == ">":
            return m.end()
        at = page.find(m[0], m.end()) + 1 if m.start() < last[m[0]] else m.end()
    return -1


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(kind, text) of the blocks of a page in order; character references decoded, white space collapsed.

    A < that opens no tag is text. The work grows with the length of the page.
    """
    out: list[tuple[int, str]] = []
    pieces: list[str] = []
    skipped, depth, article, at = "", 0, 0, 0
    last = {c: page.rfind(c) for c in ">\"'"} | {"quoting": 1}

    def kind() -> int:
        return PART if skipped else ARTICLE if article else OTHER

    def flush() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                out.append((kind(), text))

    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            pieces.append(page[at:])
            break
        pieces.append(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), start) and start < last[">"]:
            at = page.find(">", start) + 1
            continue
        tag = NAME.match(page, start) if start < last[">"] else None
        end = tag_end(page, tag.end(), last) if tag else -1
        if end < 0:
            pieces.append("&lt;")
            at = start + 1
            continue
        name, closing, attributes, at = tag[1].lower(), page[start + 1] == "/", page[tag.end() : end - 1], end
        if name == "br":
            pieces.append(" ")
            continue
        if name in RAW and not closing:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
                at = len(page) if end is None else page.find(">", end.end() - 1) + 1 or len(page)
            continue
        if name in BLOCKS or name in PARTS:
            flush()
        if skipped:
            ends = skipped == "p" and name in BLOCKS and not (closing and name == "p")
            if closing and (name in MAIN or name in ("body", "html")) and name != skipped:
                ends = True
            if ends:
                flush()
                skipped, depth = "", 0
            elif name == skipped:
                depth += -1 if closing else 1
                if not depth:
                    flush()
                    skipped = ""
                continue
            else:
                continue
        if closing:
            if name in MAIN:
                flush()
                article = max(0, article - 1)
        elif name in MAIN:
            flush()
            article += 1
        elif name not in VOID and not attributes.endswith("/") and is_part(name, attributes, article > 0):
            flush()
            skipped, depth = name, 1
    flush()
    return out


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _streams(pages: Iterable[tuple[str, list[tuple[int, str]]]], together: int = TOGETHER) -> Iterator[tuple[str, list[tuple[int, str]], list[np.ndarray]]]:
    """(host, blocks, hashes of the words outside and inside articles) of every page; about ``together`` letters are hashed at once."""

    def out():
        joined = [" ".join([text for k, text in page if (k == ARTICLE) == inside]) for _, page in held for inside in (False, True)]
        words = token_hashes(" ".join([x for x in joined if x]).encode("utf-8", "replace"))
        parts = np.split(words, np.cumsum([x.count(" ") + 1 if x else 0 for x in joined])[:-1])
        return [(*page, parts[2 * i : 2 * i + 2]) for i, page in enumerate(held)]

    held, letters = [], 0
    for host, page in pages:
        held.append((host, page))
        letters += sum(len(text) for _, text in page)
        if letters > together:
            yield from out()
            held, letters = [], 0
    if held:
        yield from out()


class Runs:
    """Hashes of the runs of a stream, and of the minimisers of its runs, with its host and sort."""

    def __init__(self, run: int):
        self.run = run

    def __call__(self, host: str, inside: int, words: np.ndarray, leads: bool = True, runs: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
        """Runs, their minimisers (each if wanted) and the hash of the whole stream."""
        if len(words) < self.run:
            return np.empty(0, np.int64), np.empty(0, np.int64), 0
        place = np.array([xxhash.xxh3_64_intdigest(f"{inside} {host}".encode("utf-8", "replace"))], np.uint64)
        lead = min(LEAD, self.run)
        first = sliding_minima(mix64(window_sums(words, lead) + place), self.run - lead + 1) if leads else np.empty(0, np.uint64)
        whole = xxhash.xxh3_64_intdigest(words.tobytes()) - (1 << 63)
        grams = mix64(window_sums(words, self.run) + place) if runs else np.empty(0, np.uint64)
        return signed(grams), signed(first), whole


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, and kinds and texts of the blocks of every page."""

    def read(batches):
        for batch in batches:
            blocks = [blocks_of(page or "") for page in batch.column("html").to_pylist()]
            columns = [
                batch.column("page_id"), batch.column("url"), pa.array([host_of(u) for u in batch.column("url").to_pylist()], pa.string()),
                pa.array([[k for k, _ in b] for b in blocks], pa.list_(pa.int8())), pa.array([[_clean(t) for _, t in b] for b in blocks], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "host", "kinds", "texts"])

    return pages.mapInArrow(read, "page_id long, url string, host string, kinds array<byte>, texts array<string>")


def _clean(text: str) -> str:
    return text.encode("utf-8", "replace").decode()


def _blocks(batch):
    """(host, blocks) of the rows of a batch of parsed pages."""
    for host, kinds, texts in zip(*(batch.column(c).to_pylist() for c in ("host", "kinds", "texts"))):
        yield host, list(zip(kinds, texts))


def _told(blocks_of_batch, runs_of: Runs, streams: int, keep: Callable | None) -> tuple[np.ndarray, np.ndarray]:
    """Values and the streams that hold them, in order; at most ``streams`` of a value."""
    values, owners = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for host, _, parts in _streams(blocks_of_batch):
        for inside, words in enumerate(parts):
            grams, leads, whole = runs_of(host, inside, words, runs=keep is not None)
            found = np.unique(leads if keep is None else grams[keep(leads)])
            values.append(found)
            owners.append(np.full(len(found), whole, np.int64))
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((owner, value))
    value, owner = value[order], owner[order]
    new = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]))[: len(value)]
    value, owner = value[new], owner[new]
    first = np.flatnonzero(np.append(True, value[1:] != value[:-1])[: len(value)])
    nth = np.arange(len(value)) - np.repeat(first, np.diff(np.append(first, len(value))))
    return value[nth < streams], owner[nth < streams]


def shared_runs(blocks: DataFrame, run: int, streams: int, keep: Callable) -> DataFrame:
    """Runs that at least so many distinct streams hold, of windows whose minimiser ``keep`` lets through.

    A batch tells at most ``streams`` streams of a run: whether so many hold it
    can still be counted.
    """

    def read(batches):
        runs_of = Runs(run)
        for batch in batches:
            value, owner = _told(_blocks(batch), runs_of, streams, keep)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(owner)], names=["value", "stream"])

    rows = blocks.mapInArrow(read, "value long, stream long").repartition("value").distinct()
    return rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= streams).select("value")


#: Bits of a minimiser that ``shared_leads`` leaves out, and bits that tell its streams apart there.
TAG, OWNER = 24, 16
#: Pages whose minimisers make a part, about, and the fewest and most parts (as powers of two).
PART_PAGES, FEW, MANY = 5_000, 10, 20


def shared_leads(blocks: DataFrame, run: int) -> DataFrame:
    """Minimisers (without their last bits) that two streams or more hold.

    Minimisers are dealt by their first bits over parts, as many as the number
    of pages asks for. Few bits tell streams apart, so two suffice here;
    whether a run has enough is counted with whole hashes.
    """
    deal = min(max(int(blocks.count() // PART_PAGES).bit_length(), FEW), MANY)
    rest = 64 - TAG - deal

    def compare(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        low = np.concatenate([_unpacked(x) for x in group.column("leads").to_pylist()])
        told = np.sort((low.astype(np.int64) << OWNER) | np.frombuffer(b"".join(group.column("owners").to_pylist()), np.uint16))
        low = told >> OWNER
        found = np.unique(low[1:][(low[1:] == low[:-1]) & (told[1:] != told[:-1])])
        return pa.table({"value": pa.array(found | (part << rest), pa.int64())})

    return lead_rows(blocks, run, rest).groupBy("part").applyInArrow(compare, "value long")


def lead_rows(blocks: DataFrame, run: int, rest: int) -> DataFrame:
    """A row per batch of pages and part: the batch's minimisers there, as ``rest`` bits each in steps, and a few bits of their streams."""

    def read(batches):
        runs_of = Runs(run)
        for batch in batches:
            value, owner = _told(_blocks(batch), runs_of, 2, None)
            lead, owner = value.view(np.uint64) >> np.uint64(TAG), mix64(owner.view(np.uint64)).astype(np.uint16)
            order = np.argsort(lead, kind="stable")  # minimisers came in signed order
            lead, owner = lead[order], owner[order]
            twice = np.flatnonzero(lead[1:] == lead[:-1]) + 1
            owner[twice] = owner[twice - 1] ^ 1  # two streams of one batch always differ
            part = (lead >> np.uint64(rest)).astype(np.int64)
            starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
            ends, low = np.append(starts[1:], len(part)), (lead & np.uint64((1 << rest) - 1)).astype(np.uint32)
            rows = [(_packed(low[a:b]), owner[a:b].tobytes()) for a, b in zip(starts, ends)]
            columns = [pa.array(part[starts]), pa.array([x for x, _ in rows], pa.binary()), pa.array([x for _, x in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "leads", "owners"])

    return blocks.mapInArrow(read, "part long, leads binary, owners binary")


def _packed(ascending: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as steps, first bytes first: those are mostly 0, which compresses."""
    steps = np.diff(ascending, prepend=np.uint32(0)).astype(">u4")
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(">u4").ravel()
    return np.cumsum(steps, dtype=np.uint32)


def within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the known ones, in ascending order."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def covered(grams: np.ndarray, size: int, shared: np.ndarray, run: int) -> np.ndarray:
    """Which of ``size`` tokens of a stream lie in a shared run."""
    steps = np.zeros(size + 1, np.int64)
    at = np.flatnonzero(within(grams, shared))
    np.add.at(steps, at, 1)
    np.add.at(steps, at + run, -1)
    return np.cumsum(steps)[:size] > 0


def unique_text(blocks: list[tuple[int, str]], outside: np.ndarray, inside: np.ndarray) -> str:
    """The blocks of articles and of neither kind without their covered tokens."""
    if 2 * inside.sum() > len(inside):
        inside = np.zeros(len(inside), bool)
    out, cover, at = [], (outside, inside), [0, 0]
    for kind, text in blocks:
        sort, size = int(kind == ARTICLE), text.count(" ") + 1
        gone = cover[sort][at[sort] : at[sort] + size]
        at[sort] += size
        if kind == PART or gone.all():
            continue
        out.append(" ".join([w for w, g in zip(text.split(" "), gone) if not g]) if gone.any() else text)
    return "\n".join(out)


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, run: int = RUN, streams: int = STREAMS, sent: int = SENT) -> DataFrame:
    """page_id, url, text and n_chars of every page, blocks joined by a line break.

    A null or empty page has an empty text. Pages with a null or odd url share
    the empty host. ``streams`` is two or more; equal streams are one stream, so copies of a page or of
    an article do not make it boilerplate. Repeated rows stay repeated; further
    columns are ignored; an empty table gives no rows. A very long page costs
    work and memory in proportion to its length.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    blocks = stored(parsed(base).withColumn("row", F.monotonically_increasing_id()), "zstd")
    leads = blocks.sparkSession.sparkContext.broadcast(Sieve(shared_leads(blocks, run), "value"))
    shared = stored(shared_runs(blocks, run, streams, lambda found: leads.value(found >> TAG)))
    if shared.count() <= sent:
        known = blocks.sparkSession.sparkContext.broadcast(np.sort(shared.toArrow().column("value").to_numpy()))
        return blocks.mapInArrow(_assemble(run, lambda: known.value), SCHEMA)
    sieve = Sieve(shared, "value")

    def own_runs(batches):
        runs_of = Runs(run)
        for batch in batches:
            grams = []
            for host, _, parts in _streams(_blocks(batch)):
                own = np.unique(np.concatenate([runs_of(host, i, w, leads=False)[0] for i, w in enumerate(parts)]))
                grams.append(own[sieve(own)])
            rows = pa.array(np.repeat(np.arange(len(grams)), [len(g) for g in grams]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("row").take(rows), pa.array(np.concatenate([np.empty(0, np.int64), *grams]))], names=["row", "value"])

    # a page's own shared runs, as many as it has tokens
    found = blocks.select("row", "host", "kinds", "texts").mapInArrow(own_runs, "row long, value long").join(shared, "value")
    found = found.groupBy("row").agg(F.array_sort(F.collect_list("value")).alias("found"))
    return blocks.join(found, "row", "left").mapInArrow(_assemble(run), SCHEMA)


def _assemble(run: int, known: Callable | None = None) -> Callable:
    """Texts of pages from their blocks, without the runs that are known or listed with the page."""

    def read(batches):
        runs_of = Runs(run)
        for batch in batches:
            texts = []
            listed = batch.column("found").to_pylist() if known is None else None
            for at, (host, page, parts) in enumerate(_streams(_blocks(batch))):
                shared = known() if known else np.array(listed[at] or [], np.int64)
                texts.append(unique_text(page, *(covered(runs_of(host, i, w, leads=False)[0], len(w), shared, run) for i, w in enumerate(parts))))
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return read
