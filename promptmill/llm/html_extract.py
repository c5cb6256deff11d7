"""Main text of web pages, by structure and by host suffix arrays.

Markup tells articles, and parts that are never main text. Where a page marks no article, the other
pages of its host tell its boilerplate: their token streams are concatenated, a suffix array finds
runs of words that several distinct pages share, and what those cover goes; unique runs stay.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmill.llm.common import RollingHash, Words, as_doc_id, doc_key, group_starts, mix, slices_for, smallest_in_window, text_chunks
from promptmill.sources.storage import materialize

# Words of the shortest run that counts as repeated, words of the gram by which runs meet, and how many
# distinct pages of a host must share a run.
RUN, GRAM, PAGES = 6, 3, 2

# Elements whose whole content is never main text.
DROPPED = set("aside button dialog embed footer form head iframe input menu nav noscript object select style script svg template textarea title".split())
# Parts of class, id and role values that name such content.
DROPPED_NAMES = set(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer login masthead"
    " menu modal nav navbar navigation newsletter notice notices pagination popup promo related search share sharing sidebar signup social sponsor sponsored subscribe"
    " toolbar widget".split()
)
#: Of these, the ones that an article of its own may have, as each reader's comment in many templates; and words that make
#: such a name a setting of the article.
DROPPED_ARTICLES = set("comment comments disqus related".split())
SETTINGS = set("allowed closed count disabled enabled false no off on open true yes".split())
HEADER_NAMES = {"header", "site-header", "page-header"}
BLOCKS = set(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html"
    " li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that the next block ends when their end tag is missing.
OPEN_ENDED = set("dd dt li option p td th tr".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|svg|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^\"'<>]|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>"
    r"|<[!?][^>]*>"
    r"|[^<]+|<",
    re.DOTALL | re.IGNORECASE,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|display\s*:\s*none", re.IGNORECASE)


def _is_dropped(name: str, attributes: str, in_article: bool) -> bool:
    if name in DROPPED or name == "header" and not in_article:
        return True
    if not attributes:
        return False
    if name in ("html", "body", "main"):
        return False
    if name == "article":
        values = [re.split(r"[^a-z0-9]+", v) for _, a, b, c in _NAMED.findall(attributes) for v in (a or b or c).lower().split()]
        return any(not DROPPED_ARTICLES.isdisjoint(v) and SETTINGS.isdisjoint(v) for v in values)
    for _, a, b, c in _NAMED.findall(attributes):
        for value in (a or b or c).lower().split():
            if value in HEADER_NAMES and not in_article or not DROPPED_NAMES.isdisjoint(re.split(r"[^a-z0-9]+", value)):
                return True
    return bool(_HIDDEN.search(attributes))


def _closed(tags: list[tuple[str, bool, bool]]) -> set[int]:
    """Places of the start tags of `name, closing, void` that have their own end tag.

    An end tag ends the nearest open element of its name. Where one around it stays open, either may be the one
    that was left open, so none of both counts.
    """
    open_: dict[str, list[int]] = defaultdict(list)
    ended: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for k, (name, closing, void) in enumerate(tags):
        if closing and open_[name]:
            ended[name].append((open_[name].pop(), k))
        elif not closing and not void:
            open_[name].append(k)
    # an element that stays open goes around all that begins after it, up to the end
    return {a for name, own in ended.items() for a, _ in own if not open_[name] or a < open_[name][0]}


def page_blocks(page: str) -> tuple[list[str], list[str], bool]:
    """Main blocks, all other blocks, and whether the page marks its article.

    With an article, main blocks are those in it; without one, all that no mark names as something else.
    """
    found: list[tuple[str, bool, bool]] = []
    part: list[str] = []
    articles = 0
    skipped, depth, opened_inside = "", 0, False

    def end_block() -> None:
        text = " ".join(html.unescape("".join(part)).split())
        part.clear()
        if text:
            found.append((text, articles > 0, bool(skipped)))

    marked = False
    tokens = list(_TOKEN.finditer(page))
    tags = [(k, (t[3] or t[6]).lower(), bool(t[2] or t[5]), (t[4] or t[7] or "").rstrip().endswith("/")) for k, t in enumerate(tokens) if t[3] or t[6]]
    places = [k for k, *_ in tags]
    closed = {places[k] for k in _closed([(name, closing, void or name in VOID) for _, name, closing, void in tags])}
    whole = False
    for k, token in enumerate(tokens):
        name = token[3] or token[6]
        if name is None:
            raw = token[0]
            if raw[0] != "<" or raw == "<":
                part.append(raw)
            continue
        name = name.lower()
        closing = bool(token[2] or token[5])
        attributes = token[4] or token[7] or ""
        article = name in ("article", "main")
        if skipped:
            if not whole and article and name != skipped and closing == opened_inside or skipped in OPEN_ENDED and name in BLOCKS and name != skipped:
                end_block()
                skipped = ""  # an article is never inside, nor around the end of, what was left open
            elif name == skipped:
                depth += -1 if closing else 1
                if skipped in OPEN_ENDED:
                    depth = 0
                if depth <= 0:
                    end_block()
                    skipped = ""
                    if closing:
                        continue
        if name in BLOCKS:
            end_block()
        if not skipped and not closing and _is_dropped(name, attributes, articles > 0):
            end_block()
            if name not in VOID and not attributes.rstrip().endswith("/"):
                skipped, depth, opened_inside, whole = name, 1, articles > 0, k in closed
            continue
        if article and not skipped:
            articles = max(0, articles + (-1 if closing else 1))
            marked = marked or not closing
    end_block()
    if any(inside and not out for _, inside, out in found):
        return [t for t, inside, out in found if inside and not out], [t for t, inside, out in found if not inside or out], True
    return [t for t, _, out in found if not out], [t for t, _, out in found if out], False


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            own = batch.slice(lo, 256)
            texts, streams, marks = [], [], []
            for page in own.column("html").to_pylist():
                main, rest, marked = page_blocks(page or "")
                texts.append("\n".join(main) if not marked else " ".join(main))
                streams.append("\n".join(rest) if marked else "\n".join(main))
                marks.append(marked)
            yield pa.RecordBatch.from_arrays(
                [own.column("page"), own.column("url"), own.column("host"), pa.array(texts, pa.string()), pa.array(streams, pa.string()), pa.array(marks)],
                ["page", "url", "host", "text", "stream", "marked"],
            )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: token runs of its streams, by host and gram.

    A piece that PAGES streams of this task have, or one stream of several pages, is settled here (no tokens) and handed
    on once, as shared; so a run that all pages of a large host have makes few rows.
    """
    places: dict[tuple[int, bytes], list[tuple[int, int]]] = defaultdict(list)
    several: set[int] = set()
    held = 0
    for batch in batches:
        units, hosts = np.asarray(batch.column("unit")), np.asarray(batch.column("host_key")).astype(np.uint64)
        several.update(u for u, own in zip(units.tolist(), batch.column("several").to_pylist()) if own)
        for lo, _, data, offsets in text_chunks(batch, "stream"):
            words = Words(data, offsets)
            values = words.hashes(data)
            place = smallest_in_window(RollingHash(values).windows(GRAM), RUN - GRAM + 1)
            grams = RollingHash(values).windows(GRAM)
            starts = np.flatnonzero(words.whole(RUN))
            if not len(starts):
                continue
            anchor = place[starts]
            new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            first, runs = starts[new], np.diff(np.r_[new, len(starts)])
            rows = words.rows[first]
            keys = mix(grams[anchor[new]] + hosts[rows + lo]).astype(np.int64)
            raw = values.tobytes()
            for key, a, n, row in zip(keys.tolist(), first.tolist(), runs.tolist(), rows.tolist()):
                piece = raw[8 * a : 8 * (a + n - 1 + RUN)]
                places[(key, piece)].append((int(units[row + lo]), a - int(words.first[row])))
                held += 120
            if held > 32 << 20:
                yield from _settled(places, several)
                places.clear()
                held = 0
    yield from _settled(places, several)


_PIECES = "gram long, unit long, start int, runs int, shared boolean, piece binary"


def _settled(places: dict[tuple[int, bytes], list[tuple[int, int]]], several: set[int]) -> Iterator[pa.RecordBatch]:
    rows = []
    for (gram, piece), own in places.items():
        runs = len(piece) // 8 - RUN + 1
        units = {u for u, _ in own}
        shared = len(units) >= PAGES or not units.isdisjoint(several)
        for k, (unit, start) in enumerate(own):
            rows.append((gram, unit, start, runs, shared, None if shared and k else piece))
    if rows:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
        names = ["gram", "unit", "start", "runs", "shared", "piece"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def token_suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of a token sequence, ordered by their first `depth` tokens at least, by doubling."""
    order = np.argsort(tokens, kind="stable")
    rank = np.empty(len(tokens), np.int64)
    rank[order] = np.cumsum(np.r_[0, tokens[order][1:] != tokens[order][:-1]])
    length = 1
    while length < depth:
        key = (rank + 1) * (len(tokens) + 2)
        key[: len(key) - length] += rank[length:] + 1
        order = np.argsort(key, kind="stable")
        rank[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
        length *= 2
    return order


def _shared_runs(rows: pd.DataFrame) -> pd.DataFrame:
    """One slice: word ranges covered by runs that PAGES distinct pages of a host have."""
    known = rows[rows["piece"].isna()]
    found = [(known["unit"].to_numpy(np.int64), known["start"].to_numpy(np.int64), (known["start"] + known["runs"] - 1 + RUN).to_numpy(np.int64))]
    rows = rows[rows["piece"].notna()].sort_values(["gram", "unit", "start"], kind="stable")
    grams = group_starts(rows["gram"].to_numpy())
    lo = 0
    while lo < len(grams) - 1:
        hi = min(max(int(np.searchsorted(grams, grams[lo] + 20_000, "right")) - 1, lo + 1), len(grams) - 1)
        own = rows.iloc[grams[lo] : grams[hi]]
        gram_no = np.repeat(np.arange(hi - lo), np.diff(grams[lo : hi + 1]))
        lo = hi
        runs = own["runs"].to_numpy(np.int64)
        # the gram's number goes before each token, so that runs of different grams differ
        tokens = np.concatenate([np.r_[mix(np.frombuffer(p, np.uint64) + np.uint64(g)), np.uint64(k)] for k, (p, g) in enumerate(zip(own["piece"], gram_no))])
        lengths = runs + RUN
        at = np.r_[0, np.cumsum(lengths)[:-1]]
        inside = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        starts = np.repeat(at, runs) + inside
        number = np.full(len(tokens), -1, np.int64)
        number[starts] = np.arange(len(starts))
        order = token_suffix_array(tokens, RUN)
        order = order[number[order] >= 0]
        windows = np.lib.stride_tricks.sliding_window_view(tokens, RUN)[order]
        new = np.r_[True, (windows[1:] != windows[:-1]).any(axis=1)]
        group = np.cumsum(new) - 1
        piece = np.repeat(np.arange(len(own)), runs)[number[order]]
        unit = own["unit"].to_numpy(np.int64)[piece]
        several = np.zeros(group[-1] + 1, bool)
        np.logical_or.at(several, group, own["shared"].to_numpy(bool)[piece])
        pairs = np.unique(np.stack([group, unit], axis=1), axis=0)
        several |= np.bincount(pairs[:, 0], minlength=len(several)) >= PAGES
        hit = several[group]
        start = own["start"].to_numpy(np.int64)[piece] + inside[number[order]]
        found.append((unit[hit], start[hit], start[hit] + RUN))
    unit, start, end = (np.concatenate(c) for c in zip(*found))
    return pd.DataFrame({"unit": unit, "start": start, "end": end})


def boilerplate(streams: DataFrame, slices: int) -> DataFrame:
    """`unit, start, end`: word ranges of each distinct stream of `host_key, unit, stream, several` that other pages of its host share.

    `several` tells that PAGES pages with different whole texts have the stream, so all of its runs are shared.
    """
    pieces = streams.mapInArrow(_pieces, _PIECES)
    dealt = pieces.withColumn("slice", F.pmod(F.when(F.col("piece").isNull(), F.xxhash64("unit", "start")).otherwise(F.xxhash64("gram")), F.lit(slices)))
    return dealt.groupBy("slice").applyInPandas(_shared_runs, "unit long, start long, end long")


def _covered(starts: np.ndarray, n: int) -> np.ndarray:
    """For each of n words, whether a run of RUN words that begins at one of `starts` has it."""
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    edge[starts + RUN] -= 1
    return np.cumsum(edge)[:n] > 0


def _unique_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: the words of each text outside its ranges, blocks joined by one space.

    A run inside a block goes. One that goes on over the end of a block takes only blocks that are covered whole: the
    run that a template and the first words of a text happen to share is no boilerplate.
    """
    for batch in batches:
        texts = []
        for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
            blocks = [block.split() for block in text.split("\n")]
            words = [w for block in blocks for w in block]
            block = np.repeat(np.arange(len(blocks)), [len(b) for b in blocks])
            starts = np.unique([k for r in ranges or [] for k in range(r["start"], r["end"] - RUN + 1)]).astype(np.int64)
            open_ = block[~_covered(starts, len(words))]
            inside = _covered(starts[block[starts] == block[starts + RUN - 1]], len(words))
            cut = inside | ~np.isin(block, open_)
            texts.append(" ".join(w for w, c in zip(words, cut) if not c))
        yield pa.RecordBatch.from_arrays([batch.column("page"), batch.column("url"), pa.array(texts, pa.string())], ["page", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """Main text of each page; reads `page_id, url, html`.

    Returns one row per input row: `page_id, url, text, n_chars`. Null or empty html gives an empty text. A null url is a host
    of its own. Character references are decoded; white space inside a block becomes one space, and blocks are joined by
    one. Pages with equal texts count as one page of their host. Rows that repeat a page_id are pages of their own. Other columns are not
    read; an empty table gives no rows.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    read = pages.select(doc_key("page_id").alias("page"), "url", host.alias("host"), "html")
    parsed = read.mapInArrow(_parse, "page long, url string, host string, text string, stream string, marked boolean")
    keyed = parsed.withColumns({"host_key": F.xxhash64("host"), "unit": F.xxhash64("host", "stream")})
    parsed = materialize(keyed, "page-blocks")
    # Streams are compared once each; those of marked pages leave out the article, by which their pages differ.
    page_key = F.xxhash64("text")
    streams = parsed.where("stream != ''").groupBy("unit").agg(
        F.first("host_key").alias("host_key"), F.first("stream").alias("stream"), (F.min(page_key) != F.max(page_key)).alias("several")
    )
    ranges = boilerplate(streams, slices_for(pages)).groupBy("unit").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    cut = parsed.where("not marked").select("page", "url", "unit", "text").join(ranges, "unit", "left")
    cut = cut.mapInArrow(_unique_runs, "page long, url string, text string")
    every = parsed.where("marked").select("page", "url", "text").unionByName(cut)
    return every.select(as_doc_id(F.col("page")).alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
