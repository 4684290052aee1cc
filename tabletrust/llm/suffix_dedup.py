"""Suffix dedup: bytes inside 50-byte strings that a document with a smaller id also has.

1. Each 50-byte window is named by its anchor, the 24-byte string in it with the smallest hash. Equal
   windows have equal anchors. Chunks of documents and ranges of the hash space exchange packed
   anchors, so each document learns which of its anchors other documents have; all other windows are
   unique and go no further.
2. Neighbouring windows with one shared anchor make a segment. A chunk's distinct segments, each with
   the smallest doc_id that has it, go to the range of their anchor and 13 bytes beside it.
3. A range builds a run-length index of its segments: a Burrows-Wheeler transform of their suffixes
   in order of the 50 bytes that matter, by doubling of ranks, cut into runs of equal preceding byte.
   The head of each run is sampled with the smallest document in it, and only runs, samples and block
   starts are kept. Segments are streamed against them from their last window to the left: one
   step maps the block of suffixes that match for 50 bytes over the runs of the preceding byte to the
   block of the next window. A block's matching statistic in smaller documents is 50 exactly if one
   of its samples is smaller, and the smallest sample says which.
4. Each chunk hears its segments' smallest documents, marks the covered bytes and cuts them out.

The order is bounded to 50 bytes because longer matches never change the result. Repetition costs
little: copies of a segment travel once per chunk, and runs of copies are one sample. An anchor in
more than HOT_DOCS documents may stand between other bytes in each of them, so its windows travel
singly, each to the range of its own 50 bytes, where a chunk has one entry for it.

Defined results: null and empty texts, and texts of fewer than 50 bytes, lose nothing. Rows that
share a doc_id do not remove each other's bytes, nor do rows without a doc_id, which count as larger
than all others. Matches never cross documents. What is left may not be valid UTF-8, so it stays
binary. Extra columns are ignored. Empty tables give empty tables.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletrust.llm import chunks
from tabletrust.llm.chunks import found_in, short, sql_type, starts_of, table_of, texts_of
from tabletrust.llm.text import gives_back
from tabletrust.session import materialize

WINDOW, ANCHOR = 50, 24
#: Anchor positions in a window, and bytes beside an anchor that help to name a segment's range.
SPAN = WINDOW - ANCHOR + 1
BESIDE = SPAN // 2
#: Least text per chunk, windows handled at once, and text per range of segments.
CHUNK_BYTES, BLOCK, RANGE_BYTES = 4 << 20, 1 << 18, 2 << 20
#: Documents of an anchor above which its windows travel singly; 1.7 KB of a range each at most.
HOT_DOCS = 1 << 15
#: Segments of a range overlap much; packed, they take far less than the shuffle's own compression gets.
LEVEL = 6
_LAST = np.iinfo(np.int64).max
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


@dataclass
class Block:
    """Some texts, or parts of them, one behind another, and the runs of windows with one anchor.

    Run r holds the windows that start at `first[r]` to `last[r]` in `data`; their anchor starts at
    `anchor[r]`, has hash `key[r]`, and they belong to text `text[r]`, whose byte 0 would be at
    `base[r]` in `data`.
    """

    data: bytes
    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    key: np.ndarray
    text: np.ndarray
    base: np.ndarray


def _eights(data: np.ndarray, order: str = "<u8") -> np.ndarray:
    """The eight bytes from each position as a number."""
    return np.ndarray((len(data) - 7,), order, data, strides=(1,)).astype(np.uint64)


def _smallest(h: np.ndarray) -> np.ndarray:
    """For each window, the position of the leftmost smallest of its SPAN hashes.

    Hashes are compared by their upper bits; the position is below them in the same number. The bits
    are the same in every block, for equal windows must choose equal anchors.
    """
    bits = np.uint64((2 * BLOCK + WINDOW).bit_length())
    value, width = h >> bits << bits | np.arange(len(h), dtype=np.uint64), 1
    while width < SPAN:
        step = min(width, SPAN - width)
        value = np.minimum(value[:-step], value[step:])
        width += step
    return (value & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def blocks(texts: list[bytes]) -> Iterator[Block]:
    """Blocks of about BLOCK windows; a longer text is cut into parts that overlap by 49 bytes."""
    parts: list[bytes] = []
    owners: list[tuple[int, int]] = []
    held = 0
    for i, text in enumerate(texts):
        for start in range(0, len(text) - WINDOW + 1, BLOCK):
            parts.append(text[start : start + BLOCK + WINDOW - 1])
            owners.append((i, start))
            held += len(parts[-1])
            if held >= BLOCK:
                yield _block(parts, owners)
                parts, owners, held = [], [], 0
    if parts:
        yield _block(parts, owners)


def _block(parts: list[bytes], owners: list[tuple[int, int]]) -> Block:
    data = b"".join(parts)
    eight = _eights(np.frombuffer(data, np.uint8))
    h = eight[:-16] * _MIX[0]
    h ^= h >> np.uint64(31)
    h += eight[8:-8] * _MIX[1]
    h ^= h >> np.uint64(29)
    h += eight[16:] * _MIX[2]
    h *= _MIX[0]
    h ^= h >> np.uint64(32)
    place = _smallest(h)
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    windows = np.repeat(ends - sizes, sizes - WINDOW + 1) + _ramp(sizes - WINDOW + 1)
    part = np.repeat(np.arange(len(parts)), sizes - WINDOW + 1)
    place = place[windows]
    left = windows <= place - BESIDE
    change = np.concatenate(
        ([True], (place[1:] != place[:-1]) | (part[1:] != part[:-1]) | (left[1:] != left[:-1]))
    )
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(windows)) - 1
    text, start = np.array(owners).T
    part = part[first]
    return Block(
        data, windows[first], windows[last], place[first], h[place[first]], text[part],
        (ends - sizes)[part] - start[part],
    )


def _ramp(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def anchors(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The distinct anchor hashes of each text that has any."""
    open_text, found = -1, []
    for block in blocks(texts):
        for text in np.unique(block.text).tolist():
            if text != open_text and found:
                yield chunks.distinct(np.concatenate(found))
                found = []
            open_text = text
            a, b = np.searchsorted(block.text, (text, text + 1))
            found.append(block.key[a:b])
    if found:
        yield chunks.distinct(np.concatenate(found))


class Segments:
    """A chunk's segments with shared anchors: the distinct ones by range, and every occurrence."""

    def __init__(
        self, texts: list[bytes], doc_ids: np.ndarray, shared: np.ndarray, counts: np.ndarray,
        n_ranges: int, hot_docs: int = HOT_DOCS,
    ):
        # A new segment gets the next number.
        known: defaultdict[bytes, int] = defaultdict()
        known.default_factory = known.__len__
        numbers, starts, owners, names = [], [], [], []
        for block in blocks(texts):
            keep = np.flatnonzero(found_in(short(block.key), shared))
            data = block.data
            hot = counts[np.searchsorted(shared, short(block.key[keep]))] > hot_docs
            windows = np.where(hot, block.last[keep] - block.first[keep] + 1, 1)
            keep, hot = np.repeat(keep, windows), np.repeat(hot, windows)
            first, anchor = block.first[keep] + _ramp(windows), block.anchor[keep]
            last = np.where(hot, first, block.last[keep])
            side = np.where(first <= anchor - BESIDE, anchor - BESIDE, anchor)
            side, width = np.where(hot, first, side), np.where(hot, WINDOW, ANCHOR + BESIDE)
            before = len(known)
            cuts = map(slice, first.tolist(), (last + WINDOW).tolist())
            own = np.fromiter(map(known.__getitem__, map(data.__getitem__, cuts)), np.int64, len(keep))
            highest = np.maximum.accumulate(np.append(before - 1, own))[:-1]
            new = np.flatnonzero(own > highest)
            cuts = map(slice, side[new].tolist(), (side + width)[new].tolist())
            hashes = map(xxhash.xxh3_64_intdigest, map(data.__getitem__, cuts))
            names.append(np.fromiter(hashes, np.uint64, len(new)))
            numbers.append(own)
            starts.append(first - block.base[keep])
            owners.append(block.text[keep])
        self.segments = list(known)
        names = np.concatenate([np.zeros(0, np.uint64), *names])
        self.ranges = (names % np.uint64(n_ranges)).astype(np.int64)
        self.number = np.concatenate([np.zeros(0, np.int64), *numbers])
        self.start = np.concatenate([np.zeros(0, np.int64), *starts])
        self.owner = np.concatenate([np.zeros(0, np.int64), *owners])
        self.least = np.full(len(known), _LAST)
        np.minimum.at(self.least, self.number, doc_ids[self.owner])
        #: Segment numbers by range and bytes. Answers are told in this order, and a shuffle may bring
        #: a chunk's rows in another order each time, so it must not depend on theirs.
        by_bytes = np.array(sorted(range(len(known)), key=self.segments.__getitem__), np.int64)
        self.order = by_bytes[np.argsort(self.ranges[by_bytes], kind="stable")]


class RunIndex:
    """Run-length index of segments: the smallest document of every 50-byte window in them.

    Suffixes are the places of windows, in order of their 50 bytes; a block holds those of one window.
    Run r has suffixes `start[r]` and on, all in one block and preceded by one byte, and sample
    `samples[r]`. An inner suffix is one whose right neighbour is a suffix too; they are what a step to
    the left leads to, and `inner[k]` of them come before block k.
    """

    def __init__(self, segments: list[bytes], least: np.ndarray):
        sizes = np.array([len(s) for s in segments])
        data = np.frombuffer(b"".join(segments) + bytes(8), np.uint8)
        self.counts = counts = sizes - WINDOW + 1
        starts = np.repeat(np.cumsum(sizes) - sizes, counts)
        at = starts + _ramp(counts)
        # 0 where no window precedes, else one more than the byte.
        before = np.where(at > starts, data[at - 1].astype(np.int64) + 1, 0)
        docs = np.repeat(least, counts)
        ends = np.cumsum(counts) - 1
        is_inner = np.ones(len(at), bool)
        is_inner[ends] = False
        rank = _windows(data, at)
        suffixes = np.argsort(rank << np.uint64(9) | before.astype(np.uint64))
        new_block = starts_of(rank[suffixes])
        heads = np.flatnonzero(new_block | starts_of(before[suffixes]))
        self.samples = np.minimum.reduceat(docs[suffixes], heads)
        self.n_suffixes, self.n_runs = len(suffixes), len(heads)
        self.blocks = np.flatnonzero(new_block[heads])
        self.start = heads
        found = np.cumsum(is_inner[suffixes]) - is_inner[suffixes]
        self.inner = found[heads[self.blocks]]
        # Runs by preceding byte: how many inner suffixes come before those a run leads to.
        char = before[suffixes[heads]]
        by_char = np.argsort(char, kind="stable")
        lengths = np.diff(np.append(heads, len(suffixes)))[by_char]
        lengths[char[by_char] == 0] = 0
        self.leads = np.cumsum(lengths) - lengths
        self.places = char[by_char] * self.n_suffixes + heads[by_char]
        self.window_docs = self._stream(before, ends, rank[ends].astype(np.int64))

    def _stream(self, before: np.ndarray, ends: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The smallest sample of each window; a segment enters at the block of its last window."""
        smallest = np.minimum.reduceat(self.samples, self.blocks)
        out = np.empty(self.n_suffixes, np.int64)
        counts = self.counts
        while len(ends):
            out[ends] = smallest[block]
            more = counts > 1
            ends, block, counts = ends[more], block[more], counts[more] - 1
            place = before[ends] * self.n_suffixes + self.start[self.blocks[block]]
            lead = self.leads[np.searchsorted(self.places, place)]
            block, ends = np.searchsorted(self.inner, lead, side="right") - 1, ends - 1
        return out


def _ranks(values: np.ndarray) -> np.ndarray:
    """The place of each value among the distinct values."""
    order = np.argsort(values)
    ranks = np.empty(len(values), np.uint64)
    ranks[order] = np.cumsum(starts_of(values[order]), dtype=np.uint64) - np.uint64(1)
    return ranks


def _windows(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The place of each window among the distinct ones, in order of their bytes.

    Segments have many more bytes than windows, so only the eights that a window is made of are
    ranked over the bytes. A window's ranks and its last bytes are put side by side in 64 bits, and
    what fills them is ranked itself.
    """
    used = np.zeros(len(data), bool)
    for step in range(0, WINDOW - 8, 8):
        used[at + step] = True
    used = np.flatnonzero(used)
    eights = np.zeros(len(data), np.uint64)
    eights[used] = _ranks(_eights(data, ">u8")[used])
    last = WINDOW - WINDOW % 8
    fields = [eights[at + step] for step in range(0, last, 8)]
    fields += [data[at + i].astype(np.uint64) for i in range(last, WINDOW)]
    key, bits = fields[0], int(fields[0].max()).bit_length()
    for field in fields[1:]:
        width = int(field.max()).bit_length()
        if bits + width > 64:
            key = _ranks(key)
            bits = int(key.max()).bit_length()
        key, bits = key << np.uint64(width) | field, bits + width
    return _ranks(key)


_ASKED = pa.schema(
    [("range", pa.int32()), ("chunk", pa.int32()), ("bytes", pa.binary()), ("sizes", pa.binary()),
     ("docs", pa.binary())]
)
_TOLD = pa.schema(
    [("chunk", pa.int32()), ("range", pa.int32()), ("runs", pa.binary()), ("starts", pa.binary()),
     ("docs", pa.binary())]
)
_LEFT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("starts", pa.list_(pa.int64())),
     ("ends", pa.list_(pa.int64())), ("kept", pa.binary())]
)


def _ids(rows: pa.Table) -> np.ndarray:
    return np.array([_LAST if x is None else x for x in rows.column("doc_id").to_pylist()], np.int64)


def _ask(n_ranges: int, hot_docs: int = HOT_DOCS):
    """Chunk to ranges: its distinct segments with their smallest documents."""

    def ask(rows: pa.Table, shared: pa.Table) -> pa.Table:
        keys, counts = chunks.known_keys(shared)
        if not rows.num_rows or not len(keys):
            return _ASKED.empty_table()
        found = Segments(texts_of(rows), _ids(rows), keys, counts, n_ranges, hot_docs)
        ranges = found.ranges[found.order]
        chunk, out = rows.column("chunk")[0].as_py(), []
        cuts = np.flatnonzero(starts_of(ranges)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(ranges)]):
            own = found.order[a:b]
            segments = [found.segments[i] for i in own.tolist()]
            sizes = np.array([len(s) for s in segments], np.uint16)
            out.append(
                (int(ranges[a]), chunk, zstandard.compress(b"".join(segments), LEVEL),
                 sizes.tobytes(), found.least[own].tobytes())
            )
        return table_of(out, _ASKED)

    return ask


def _tell(rows: pa.Table) -> pa.Table:
    """Range to chunks: per segment, runs of windows with one smallest document."""
    index: defaultdict[bytes, int] = defaultdict()
    index.default_factory = index.__len__
    numbers, ids = [], []
    columns = (rows.column(c).to_pylist() for c in ("bytes", "sizes", "docs"))
    for data, sizes, docs in zip(*columns):
        data = zstandard.decompress(data)
        ends = np.cumsum(np.frombuffer(sizes, np.uint16), dtype=np.int64)
        cuts = map(slice, np.append(0, ends[:-1]).tolist(), ends.tolist())
        own = map(index.__getitem__, map(data.__getitem__, cuts))
        numbers.append(np.fromiter(own, np.int64, len(ends)))
        ids.append(np.frombuffer(docs, np.int64))
    least = np.full(len(index), _LAST)
    np.minimum.at(least, np.concatenate(numbers), np.concatenate(ids))
    runs = RunIndex(list(index), least)
    begins = np.cumsum(runs.counts) - runs.counts
    first = np.zeros(len(runs.window_docs), bool)
    first[begins] = True
    heads = np.flatnonzero(first | np.concatenate(([True], np.diff(runs.window_docs) != 0)))
    per = np.diff(np.searchsorted(heads, np.append(begins, len(first))))
    offset = (heads - np.repeat(begins, per)).astype(np.uint8)
    docs, at = runs.window_docs[heads], np.cumsum(per) - per
    out = []
    names = zip(rows.column("chunk").to_pylist(), rows.column("range").to_pylist(), numbers)
    for chunk, name, own in names:
        n = per[own]
        take = np.repeat(at[own], n) + _ramp(n)
        out.append(
            (chunk, name, n.astype(np.uint8).tobytes(), offset[take].tobytes(), docs[take].tobytes())
        )
    return table_of(out, _TOLD)


def _cut(n_ranges: int, hot_docs: int = HOT_DOCS):
    """Chunk, shared keys and answers to results."""

    def cut(rows: pa.Table, heard: pa.Table) -> pa.Table:
        texts, doc_ids = texts_of(rows), _ids(rows)
        is_key = heard.column("keys").is_valid()
        keys, counts = chunks.known_keys(heard.filter(is_key))
        told = heard.filter(heard.column("runs").is_valid()).sort_by("range")
        sizes = np.array([len(t) for t in texts], np.int64)
        base = np.cumsum(sizes + 1) - (sizes + 1)
        edges = np.zeros(int((sizes + 1).sum()) + 1, np.int64)
        if told.num_rows:
            found = Segments(texts, doc_ids, keys, counts, n_ranges, hot_docs)
            joined = (
                np.concatenate([np.frombuffer(x, kind) for x in told.column(c).to_pylist()])
                for c, kind in (("runs", np.uint8), ("starts", np.uint8), ("docs", np.int64))
            )
            per, start, docs = joined
            place = np.empty(len(found.order), np.int64)
            place[found.order] = np.arange(len(found.order))
            at = np.cumsum(per, dtype=np.int64) - per
            windows = np.array([len(s) for s in found.segments]) - WINDOW + 1
            number = place[found.number]
            n = per[number].astype(np.int64)
            take = np.repeat(at[number], n) + _ramp(n)
            last_of = np.cumsum(n) - 1
            stop = np.append(start[take[1:]], 0).astype(np.int64) if len(take) else start[take]
            stop[last_of] = windows[found.number]
            owner = np.repeat(found.owner, n)
            origin = np.repeat(base[found.owner] + found.start, n)
            gone = docs[take] < doc_ids[owner]
            np.add.at(edges, (origin + start[take])[gone], 1)
            np.add.at(edges, (origin + stop - 1 + WINDOW)[gone], -1)
        covered = np.cumsum(edges) > 0
        out = []
        for i, text in enumerate(texts):
            mask = covered[base[i] : base[i] + len(text) + 1]
            turns = np.flatnonzero(np.diff(np.concatenate(([False], mask))))
            starts, ends = turns[::2].tolist(), turns[1::2].tolist()
            kept = text
            if starts:
                kept = b"".join(text[a:b] for a, b in zip([0, *ends], [*starts, len(text)]))
            doc_id = rows.column("doc_id")[i].as_py()
            out.append((doc_id, len(text), starts, ends, kept))
        return table_of(out, _LEFT)

    return cut


def repeated_spans(
    docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, range_bytes: int = RANGE_BYTES,
    hot_docs: int = HOT_DOCS,
) -> DataFrame:
    """doc_id, n_bytes, starts, ends (maximal removed byte runs) and kept (binary) of every row."""
    total = chunks.text_bytes(docs)
    texts = chunks.chunked(docs, chunks.chunk_count(total, chunk_bytes))
    found = chunks.shared_keys(texts, chunks.range_count(total, 2 * chunk_bytes), anchors)
    shared = materialize(found, "shared-anchors")
    n_ranges = chunks.range_count(total, range_bytes)
    asked = texts.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(
        gives_back(_ask(n_ranges, hot_docs)), sql_type(_ASKED)
    )
    told = asked.groupBy("range").applyInArrow(gives_back(_tell), sql_type(_TOLD))
    heard = told.unionByName(shared, allowMissingColumns=True)
    both = texts.groupBy("chunk").cogroup(heard.groupBy("chunk"))
    return both.applyInArrow(gives_back(_cut(n_ranges, hot_docs)), sql_type(_LEFT))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    lengths = F.zip_with("starts", "ends", lambda a, b: b - a)
    return repeated_spans(docs).select(
        "doc_id", "n_bytes",
        F.aggregate(lengths, F.lit(0).cast("bigint"), lambda n, x: n + x).alias("n_removed"),
        F.size("starts").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
