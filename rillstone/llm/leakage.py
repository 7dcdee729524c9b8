"""Evaluation texts leaking into training text: greedy string tiling against held-out items."""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.plans.cut import cut
from rillstone.plans.spread import hot_groups, repeat, split

INLINE_TAG = re.compile(r"</?(?:a|abbr|b|big|cite|code|em|font|i|mark|small|span|strong|sub|sup|u|wbr)(?:\s[^<>]*)?/?>", re.I)
TAG = re.compile(r"<!--.*?-->|<[/!?]?[a-zA-Z][^<>]*>", re.S)
ASCII_WORD = re.compile(r"[a-z0-9]+")
WORD = re.compile(r"[^\W_]+")
BASE = np.uint64(0x9E3779B97F4A7C15)
PROBES = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))
BITS_PER_WINDOW = 64
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
SEEDS_PER_TASK = 10_000
MOST_KNOWN = 200_000
BITMAP = 1 << 15


class _Unmarked(dict):
    """Combining marks and format characters vanish, other characters stay."""

    def __missing__(self, c: int) -> int | None:
        self[c] = found = None if unicodedata.category(chr(c)) in ("Mn", "Mc", "Me", "Cf") else c
        return found


_UNMARKED = _Unmarked()


def plain_words(text: str | None) -> list[str]:
    """Runs of letters and digits after tags, entities, compatibility forms, combining marks, format characters and case.

    Tags of inline formatting vanish, other tags part words. A null text has no words.
    """
    if not text:
        return []
    if "<" in text:
        text = TAG.sub(" ", INLINE_TAG.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if text.isascii():
        return ASCII_WORD.findall(text.lower())
    return WORD.findall(unicodedata.normalize("NFKD", text).translate(_UNMARKED).lower())


class _Codes(dict):
    """64-bit codes of words; what is remembered is bounded between batches."""

    def __missing__(self, word: str) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word.encode())
        return found


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash of every window of `width` codes."""
    n = len(codes) - width + 1
    h = np.zeros(max(n, 0), np.uint64)
    for j in range(width if n > 0 else 0):
        h = h * BASE + codes[j : j + n].astype(np.uint64)
    return h


def slots(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of a filter of `bits` (a power of two) that stand for each hash."""
    shift = np.uint64(64 - (bits.bit_length() - 1))
    return [(hashes * odd) >> shift for odd in PROBES]


def tile(hits: list[tuple[int, int]], width: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from equal windows (i, j): tiles (start in document, start in item, length).

    Windows that follow each other on a diagonal are one match. The longest match is marked first, ties by position; what
    is left of a match beside marked words goes back if it still has `width` words, so tiles never overlap.
    """
    heap: list[tuple[int, int, int]] = []
    open_: dict[int, list[int]] = {}
    for i, j in sorted(hits):
        run = open_.get(i - j)
        if run is not None and run[0] + run[1] - width + 1 == i:
            run[1] += 1
        else:
            if run is not None:
                heap.append((-run[1], run[0], run[0] - (i - j)))
            open_[i - j] = [i, width]
    heap += [(-n, i, i - diagonal) for diagonal, (i, n) in open_.items()]
    heapq.heapify(heap)
    marked_i: set[int] = set()
    marked_j: set[int] = set()
    tiles = []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        free = [i + k not in marked_i and j + k not in marked_j for k in range(n)]
        if all(free):
            tiles.append((i, j, n))
            marked_i.update(range(i, i + n))
            marked_j.update(range(j, j + n))
            continue
        start = None
        for k, ok in enumerate([*free, False]):
            if ok and start is None:
                start = k
            elif not ok and start is not None:
                if k - start >= width:
                    heapq.heappush(heap, (start - k, i + start, j + start))
                start = None
    return tiles


WINDOWS = "h long, w string, id long, text_hash long, at int, words int"


def _windows(width: int, bitmap=None, bits: int = 0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of `WINDOWS` for the texts (id, text_hash, text): every window, or those whose bits are all set in `bitmap`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Codes()
        field = np.frombuffer(bitmap.value, np.uint8) if bitmap is not None else None
        for batch in batches:
            texts = [plain_words(t) for t in batch.column("text").to_pylist()]
            sizes = np.array([len(t) for t in texts], np.int64)
            flat = [w for t in texts for w in t]
            h = window_hashes(np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat)), width)
            ends = np.repeat(np.cumsum(sizes), sizes)[: len(h)]
            ok = np.arange(len(h)) + width <= ends
            if field is not None:
                for slot in slots(h, bits):
                    ok &= (field[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
            at = np.flatnonzero(ok)
            text = np.searchsorted(np.cumsum(sizes), at, "right")
            ids, hashes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "text_hash"))
            columns = [
                pa.array(h[at].view(np.int64)), pa.array([" ".join(flat[i : i + width]) for i in at.tolist()], pa.string()), pa.array(ids[text], pa.int64()),
                pa.array(hashes[text], pa.int64()), pa.array((at - (np.cumsum(sizes) - sizes)[text]).astype(np.int32)), pa.array(sizes[text].astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["h", "w", "id", "text_hash", "at", "words"])
            if len(known) > MOST_KNOWN:
                known = _Codes()

    return run


def _bitmap(windows: DataFrame, bits: int) -> bytes:
    """The filter of all windows: built in pieces where they are, at most `MOST_BITS` bits reach the driver."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(slots(h, bits)).astype(np.int64))], ["slot"])

    slot = windows.select("h").mapInArrow(places, "slot long")
    pieces = slot.groupBy((F.col("slot").bitwiseAND(~(BITMAP - 1)) / BITMAP).cast("int").alias("piece")).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(BITMAP - 1)).alias("bits"))
    field = bytearray(bits // 8)
    for r in pieces.collect():
        field[r.piece * BITMAP // 8 : (r.piece + 1) * BITMAP // 8] = r.bits
    return bytes(field)


def leaks(documents: DataFrame, items: DataFrame, least_words: int = 12, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, item_id, tiles, longest, covered, coverage): documents against the held-out items they share words with.

    `documents` has doc_id and text, `items` item_id and text. Tiles are runs of at least `least_words` words, so a pair
    comes out if and only if the document contains as many consecutive words of the item; `coverage` is the share of the item's
    words under tiles, whatever their order. A pair has one row: of an id with several texts, the pair of texts with the most
    covered words counts, and repeated rows count once. Null and empty texts and items of fewer words match nothing.

    Documents are read once, whatever the number of items, and aren't shuffled: a filter of the items' windows, of at most
    `most_bits` bits, tells which of their windows move on. The windows of both sides are joined by hash and words, so what
    the filter lets through in vain is lost there. Windows that many documents hold are joined in parts. Tiling sees one pair at a time.
    """
    spark = documents.sparkSession
    side = lambda df, i: df.where(F.col(i).isNotNull() & F.col("text").isNotNull()).select(F.col(i).cast("long").alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    theirs = cut(side(items, "item_id").distinct().mapInArrow(_windows(least_words), WINDOWS), "windows")
    bits = LEAST_BITS
    while bits < min(most_bits, theirs.count() * BITS_PER_WINDOW):
        bits *= 2
    field = spark.sparkContext.broadcast(_bitmap(theirs, bits))
    mine = cut(side(documents, "doc_id").mapInArrow(_windows(least_words, field, bits), WINDOWS), "seeds")
    hot = hot_groups(mine.groupBy("h").agg(F.count(F.lit(1)).alias("n")), ["h"], "n", SEEDS_PER_TASK, mine.count())
    left = split(mine.select("h", "w", F.col("id").alias("doc_id"), F.col("text_hash").alias("doc_text"), F.col("at").alias("i")), ["h"], hot, "doc_id", "doc_text")
    right = repeat(theirs.select("h", "w", F.col("id").alias("item_id"), F.col("text_hash").alias("item_text"), F.col("at").alias("j"), "words"), ["h"], hot)
    pair = ["doc_id", "doc_text", "item_id", "item_text"]
    hits = left.join(right, ["h", "w", "__part"]).select(*pair, "words", "i", "j")
    placed = hits.repartition(*pair).sortWithinPartitions(*pair, "i", "j")
    found = placed.mapInArrow(_tiler(least_words), "doc_id long, item_id long, tiles int, longest int, covered int, words int")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("covered", "longest", "tiles", "words")).alias("b"))
    return best.select("doc_id", "item_id", "b.tiles", "b.longest", "b.covered", (F.col("b.covered") / F.col("b.words")).alias("coverage"))


def _tiler(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Tiles of each pair of texts, from its sorted hits."""
    names = ("doc_id", "item_id", "tiles", "longest", "covered", "words")
    kinds = (pa.int64(), pa.int64(), *[pa.int32()] * 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words, hits, rows = None, 0, [], []

        def close() -> None:
            found = tile(hits, width)
            rows.append((key[0], key[2], len(found), max(n for _, _, n in found), sum(n for _, _, n in found), words))

        for batch in batches:
            for *pair, size, i, j in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "doc_text", "item_id", "item_text", "words", "i", "j")]):
                if pair != key:
                    if key is not None:
                        close()
                    key, words, hits = pair, size, []
                if not hits or hits[-1] != (i, j):
                    hits.append((i, j))
            if len(rows) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                rows = []
        if key is not None:
            close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run
