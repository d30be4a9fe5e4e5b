"""Benchmark decontamination: the q-gram lemma in diagonal bands, then banded alignment.

A benchmark item of m characters that stands in a text with at most e edits
shares at least m - q + 1 - q * e character q-grams with it, and their diagonals
(place in the text less place in the item) differ by at most e.  So shared
q-grams are counted in overlapping bands of diagonals; bands that reach the
bound are regions to verify by an alignment confined to the band.

Only the benchmark is broadcast, in blocks of at most ``BLOCK_CHARS``
characters: however large it is, each block makes one pass over the documents,
and documents are never shuffled.

Texts are compared with A-Z lower-cased and white space as spaces; characters
are code points (those over 255 are folded to a byte for the filter only).

A q-gram that an item has more than ``REPEATS`` times (indents, rules, fillers) is not
counted: the item's bound and its budget are those of an item without them; so a place in
a text meets few places of an item, whatever both repeat.  Pairs of places are made
``PAIRS`` at a time in the order of the text, and bands that the text has passed are
settled, so memory does not grow with what a text repeats.

Nulls and edge cases: null or empty texts and items match nothing; an item too
short for the budget, or with too few q-grams that count, gets the largest one
with a positive bound, and one with none must stand exactly; texts of any length are read whole; repeated
documents are separate rows, repeated items one; items may have ids of any type,
or none; of overlapping finds of an item the one with fewest edits, then the
first, stays; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ._common import table, to_batch

Q = 8
#: Edits allowed for each hundred characters of an item.
EDIT_PERCENT = 8
BLOCK_CHARS = 2_000_000
#: An item's q-grams that it has more often than this are not counted.
REPEATS = 4
#: Pairs of places made at once.
PAIRS = 2_000_000
#: Characters of text handled at once.
CHUNK_CHARS = 1 << 20
_BITS = 22
_K = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - _BITS)

_FOLD = str.maketrans({**{chr(c): chr(c + 32) for c in range(65, 91)}, **{c: " " for c in "\t\n\x0b\x0c\r"}})
_FOLD_BYTES = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def normal(text: str) -> str:
    return text.translate(_FOLD)


def folded(text: str) -> bytes:
    """One byte a character."""
    try:
        return text.encode("latin-1").translate(_FOLD_BYTES)
    except UnicodeEncodeError:
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        return np.where(points < 256, points, points ^ (points >> 8)).astype(np.uint8).tobytes().translate(_FOLD_BYTES)


def grams(data: bytes) -> np.ndarray:
    """The q-gram at each place as one integer (q is 8 bytes)."""
    n = len(data) - Q + 1
    return np.ndarray((max(n, 0),), "<u8", data, 0, (1,))


def budget(m: int, uncounted: int = 0) -> int:
    """Edits allowed in an item of ``m`` characters with so many q-grams that are not counted: the rate, of the characters
    without theirs, as far as the lemma's bound stays positive."""
    m -= uncounted
    return min(m * EDIT_PERCENT // 100, (m - Q) // Q) if m >= Q else 0


def counted_places(codes: np.ndarray) -> np.ndarray:
    """Places of the q-grams that an item does not repeat too often."""
    _, at, n = np.unique(codes, return_inverse=True, return_counts=True)
    return np.flatnonzero(n[at] <= REPEATS)


class Index:
    """q-grams of a block of items, sorted, with their places."""

    def __init__(self, items: list[tuple[object, str]]):
        self.items = [(key, normal(text)) for key, text in items]
        own = [grams(folded(text)) for _, text in self.items]
        places = [counted_places(g) for g in own]
        kept = np.array([len(p) for p in places] or [0])
        self.short = [k for k, (_, text) in enumerate(self.items) if text and not kept[k]]
        codes = np.concatenate([np.zeros(0, "<u8"), *(g[p] for g, p in zip(own, places))])
        item = np.repeat(np.arange(len(own)), kept[: len(own)])
        place = np.concatenate([np.zeros(0, np.int64), *places]).astype(np.int64)
        order = np.argsort(codes, kind="stable")
        self.codes, first, self.count = np.unique(codes[order], return_index=True, return_counts=True)
        self.first, self.item, self.place = first, item[order], place[order]
        self.known = np.zeros(1 << _BITS, bool)
        self.known[(self.codes * _K) >> _SHIFT] = True
        self.size = np.array([len(text) for _, text in self.items] or [0])
        self.edits = np.array([budget(int(m), max(0, int(m) - Q + 1 - int(n))) for m, n in zip(self.size, kept)])
        self.least = kept - Q * self.edits
        self.band = self.edits + 1

    def regions(self, data: bytes) -> list[tuple[int, int, int]]:
        """(item, lowest diagonal, highest diagonal) of the bands that reach the bound."""
        codes = grams(data)
        at = np.flatnonzero(self.known[(codes * _K) >> _SHIFT])
        if not at.size or not self.codes.size:
            return []
        found = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        real = self.codes[found] == codes[at]
        at, found = at[real], found[real]
        edges = np.searchsorted(np.cumsum(self.count[found]), np.arange(0, int(self.count[found].sum()) + PAIRS, PAIRS)[1:])
        out: list[tuple[int, int, int]] = []
        bands, counts, begin = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for end in [*(np.minimum(edges, len(at) - 1) + 1).tolist(), len(at)]:
            if end <= begin:
                continue
            new = self._bands(at[begin:end], found[begin:end])
            bands, where = np.unique(np.concatenate([bands, new]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, np.ones(len(new), np.int64)]), len(bands)).astype(np.int64)
            item = bands >> 40
            low = ((bands & ((1 << 40) - 1)) - (1 << 39)) * self.band[item]
            # A band gets no more once the text is past the end of an item on its last diagonal.
            here = int(at[end]) if end < len(at) else 1 << 62
            settled = low + 2 * self.band[item] + self.size[item] < here
            full = settled & (counts >= self.least[item])
            out += zip(item[full].tolist(), low[full].tolist(), (low[full] + 2 * self.band[item[full]] - 1).tolist())
            bands, counts, begin = bands[~settled], counts[~settled], end
        return sorted(out)

    def _bands(self, at: np.ndarray, found: np.ndarray) -> np.ndarray:
        """The bands of every pair of a place in the text and one in an item: bands are two widths wide and start at each width."""
        count = self.count[found]
        k = np.repeat(self.first[found], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        item = self.item[k]
        low = (np.repeat(at, count) - self.place[k]) // self.band[item]
        return (np.concatenate([item, item]) << 40) + (np.concatenate([low, low - 1]) + (1 << 39))


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best placing of ``item`` in ``text`` on diagonals low..high; None beyond ``most`` edits.

    Rows are characters of the item, columns diagonals; begin and end are free
    in the text.  Starts are carried along with the costs.
    """
    far = 1 << 30
    diagonals = np.arange(low, high + 1)
    step = np.arange(len(diagonals))
    n = len(text)
    cost = np.where((diagonals >= 0) & (diagonals <= n), 0, far)
    start = diagonals.copy()
    for i, c in enumerate(item):
        at = i + diagonals  # text place that is matched with item[i]
        inside = (at >= 0) & (at < n)
        match = cost + np.where(inside & (text[np.clip(at, 0, n - 1)] == c), 0, 1) if n else cost + 1
        match = np.where(inside, match, far)
        skip = np.append(cost[1:] + 1, far)  # item[i] is missing in the text
        new = np.minimum(match, skip)
        new_start = np.where(match <= skip, start, np.append(start[1:], 0))
        new = np.where((at + 1 >= 0) & (at + 1 <= n), new, far)
        # Extra characters of the text: one more diagonal each.
        best = np.minimum.accumulate(new - step)
        source = np.maximum.accumulate(np.where(new - step == best, step, 0))
        cost, start = best + step, new_start[source]
        if cost.min() > most:
            return None
    k = int(np.argmin(cost))
    return (int(start[k]), int(len(item) + diagonals[k]), int(cost[k])) if cost[k] <= most else None


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def leaks_of(index: Index, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
    """For each text its leaks: (item id, start, end, edits)."""
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    own = [folded(t) for t in texts]
    chunk: list[int] = []
    size = 0
    for k in range(len(own) + 1):
        if chunk and (k == len(own) or size + len(own[k]) > CHUNK_CHARS):
            _chunk(index, texts, own, chunk, out)
            chunk, size = [], 0
        if k < len(own):
            chunk.append(k)
            size += len(own[k])
    for k, text in enumerate(texts if index.short else []):
        ready = normal(text)
        for i in index.short:
            key, item = index.items[i]
            at = ready.find(item)
            while at >= 0:
                out[k].append((key, at, at + len(item), 0))
                at = ready.find(item, at + len(item))
    return out


def _chunk(index: Index, texts, own, chunk, out) -> None:
    gap = b"\0" * Q
    starts = np.cumsum([0] + [len(own[k]) + Q for k in chunk])
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    ready: dict[int, str] = {}
    for i, low, high in index.regions(gap.join(own[k] for k in chunk) + gap):
        _, item = index.items[i]
        # A band's region begins near its diagonals; the text is the one that holds its middle.
        d = int(np.searchsorted(starts, max(0, (low + high) // 2 + len(item) // 2), "right")) - 1
        if d >= len(chunk):
            continue
        k = chunk[d]
        text = ready.get(k)
        if text is None:
            text = ready[k] = normal(texts[k])
        lo, hi = low - int(starts[d]), high - int(starts[d])
        at = text.find(item, max(0, lo), max(0, hi + len(item)))
        if at >= 0:  # stands as it is
            got = (at, at + len(item), 0)
        else:
            left = max(0, lo - 1)
            part = _points(text[left : max(0, hi + len(item) + 1)])
            got = align(_points(item), part, lo - left, hi - left, int(index.edits[i]))
            got = got and (got[0] + left, got[1] + left, got[2])
        if got:
            found.setdefault((k, i), []).append(got)
    for (k, i), spans in found.items():
        out[k] += ((index.items[i][0], *span) for span in _apart(spans))


def _apart(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of overlapping finds the one with fewest edits, then the first."""
    kept: list[tuple[int, int, int]] = []
    for s in sorted(set(spans), key=lambda x: (x[2], x[0], x[1])):
        if all(s[1] <= o[0] or s[0] >= o[1] for o in kept):
            kept.append(s)
    return sorted(kept)


def _blocks(items: DataFrame, item_col: str, text_col: str) -> list[DataFrame]:
    """The benchmark in blocks of about ``BLOCK_CHARS`` characters: id and text of its distinct rows."""
    real = items.select(F.col(item_col).alias("k"), F.col(text_col).alias("t")).where("length(t) > 0").distinct()
    total = real.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    return [real.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == b).orderBy("k", "t") for b in range(n)]


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """One row for each place where an item stands in a document: ``doc_id, item_id, start, end, edits``."""
    spark = docs.sparkSession
    leaks = f"doc_id long, item_id {items.schema[item_col].dataType.simpleString()}, start long, end long, edits long"
    arrow = to_arrow_schema(spark.createDataFrame([], leaks).schema)
    out = spark.createDataFrame([], leaks)
    blocks = _blocks(items, item_col, item_text_col)
    for block in blocks:
        given = spark.sparkContext.broadcast([tuple(r) for r in block.collect()])

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            index = Index(given.value)
            for batch in batches:
                texts = [t or "" for t in batch.column(1).to_pylist()]
                rows = [(key, *leak) for key, found in zip(batch.column(0).to_pylist(), leaks_of(index, texts)) for leak in found]
                if rows:
                    yield to_batch(rows, arrow)

        part = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, leaks)
        if len(blocks) == 1:
            return part
        out = out.unionByName(table(part, "leaks"))  # stored, so that one block at a time is broadcast
        given.unpersist()
    return out


def drop_leaking(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents in which no item stands, with the columns that came in."""
    out = docs
    at = docs.columns.index(text_col)
    blocks = _blocks(items, item_col, item_text_col)
    for block in blocks:
        given = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in block.collect()])

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            index = Index(given.value)
            for batch in batches:
                found = leaks_of(index, [t or "" for t in batch.column(at).to_pylist()])
                yield batch.filter(pa.array([not x for x in found], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
        if len(blocks) > 1:
            out = table(out, "without-leaks")
            given.unpersist()
    return out
