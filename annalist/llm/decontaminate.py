"""Benchmark decontamination with suffix arrays over shards of the training text.

A shard is a slice of the document table. Words that no benchmark item uses cannot lie inside a match, so a shard's
suffix array holds only the suffixes that start a long enough run of benchmark words; every suffix of every item is
then binary-searched in it. Matches on one diagonal are joined to the longest verbatim matches and their locations.

The documents are read once, nothing of them is shuffled and a lost executor costs only its own slices. The items
travel in blocks of about `block_chars` characters (a longer item is in one block), one broadcast a block. A worker
takes HELD slices through one block after the other and holds one block at a time, as the driver does; the others wait
on its disk, or in its memory where Spark encrypts broadcasts.

Hits and item names are counted by distinct windows, never by pairs of occurrences and items. Only the matches, where
they are asked for, are such pairs, as they are the result; they are joined by documents and items in bounded parts.

Defined results: null or wordless texts have no words and no hits; a null or wordless item has no windows; rows of
documents are kept one by one, repeated or not; items are told apart by item_id, rows that share one are one item, and
items of equal texts are all named; a null item_id is reported as an empty string; matches that start at the same word
go by item_id, then by the item's word; a very long text is a slice of its own, scanned whole in memory linear in it; an
empty benchmark or document table gives no hits or no rows; extra columns pass through, and the columns asked for win
over columns of the same names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.arrays import ALNUM, LOWER, slices, words
from annalist.llm.shared import names_aside

WINDOW = 10
BLOCK_CHARS = 16 << 20
#: Slices that a block is loaded for, where there are several blocks.
HELD = 8

#: (occurrence, item) pairs that are held at once while matches are joined.
_PAIRS = 1 << 20

_MATCH = pa.struct([("item_id", pa.string()), ("word", pa.int64()), ("item_word", pa.int64()), ("length", pa.int64())])
_ADDED = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items": pa.list_(pa.string()), "matches": pa.list_(_MATCH)}
_SQL = {"n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items": "array<string>", "matches": "array<struct<item_id:string,word:bigint,item_word:bigint,length:bigint>>"}


class TestSuffixes:
    """The suffixes of a block of items: one fixed-width key of word numbers for each window."""

    __test__ = False

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int):
        found = words(pa.array(texts, pa.string()), ALNUM, LOWER)
        self.window = window
        self.vocabulary, number = np.unique(found.hashes, return_inverse=True)
        # items of the same words are one class, whose windows are kept once
        classes: dict[bytes, int] = {}
        self.ids: list[list[str]] = []
        rows = []
        for row, (i, a, b) in enumerate(zip(ids, found.first[:-1], found.first[1:], strict=True)):
            own = number[a:b].tobytes()
            if own not in classes:
                classes[own] = len(self.ids)
                self.ids.append([])
                rows.append(row)
            self.ids[classes[own]].append("" if i is None else i)
        self.ids = [sorted(set(i)) for i in self.ids]
        begins = found.first[:-1][rows]
        counts = np.diff(found.first)[rows]
        lengths = np.minimum(counts, window)
        windows = np.where(counts > 0, counts - lengths + 1, 0)
        item = np.repeat(np.arange(len(counts)), windows)
        at = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
        width = np.repeat(lengths, windows)
        keys = key_rows(number, np.repeat(begins, windows) + at, width, window)
        self.shortest = int(width.min()) if len(width) else window + 1
        self.parts = []  # by length of window, as a short item's window is a prefix of a longer one
        for n in np.unique(width):
            own = np.flatnonzero(width == n)
            distinct, which = np.unique(keys[own], return_inverse=True)
            order = np.argsort(which, kind="stable")  # and so by class in a key
            self.parts.append((int(n), distinct, item[own][order], at[own][order], np.searchsorted(which[order], np.arange(len(distinct) + 1))))


def key_rows(numbers: np.ndarray, starts: np.ndarray, widths: np.ndarray, window: int) -> np.ndarray:
    """Suffixes cut at `window` words as byte strings whose order is the order of their word numbers."""
    out = np.zeros((len(starts), window), dtype=">u4")
    for j in range(window):
        inside = widths > j
        out[inside, j] = numbers[starts[inside] + j] + 1
    return out.view(f"S{4 * window}").reshape(-1)


def hits_of(found, tests: TestSuffixes) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """For each length of window: the part of the tests, the words where one of its windows starts, in order, and the
    numbers of these windows."""
    if not len(tests.vocabulary) or not len(found.hashes):
        return
    number = np.searchsorted(tests.vocabulary, found.hashes)
    number[number == len(tests.vocabulary)] = 0
    known = tests.vocabulary[number] == found.hashes
    n = len(known)
    breaks = np.ones(n + 1, dtype=bool)  # where a run of benchmark words must have ended
    breaks[:n] = ~known
    breaks[found.first] = True
    stops = np.flatnonzero(breaks)
    at = np.flatnonzero(known)
    left = stops[np.searchsorted(stops, at, "right")] - at
    keep = left >= tests.shortest
    at, left = at[keep], left[keep]
    if not len(at):
        return
    keys = key_rows(number, at, np.minimum(left, tests.window), tests.window)
    order = np.argsort(keys, kind="stable")
    suffixes, positions = keys[order], at[order]
    for part in tests.parts:
        cut, probe = (_cut(x, part[0], tests.window) for x in (suffixes, part[1]))
        low, high = np.searchsorted(cut, probe, "left"), np.searchsorted(cut, probe, "right")
        hit = np.flatnonzero(high > low)
        many = (high - low)[hit]
        where = positions[np.repeat(low[hit] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))]
        in_order = np.argsort(where, kind="stable")
        if len(where):
            yield part, where[in_order], np.repeat(hit, many)[in_order]


def _cut(keys: np.ndarray, width: int, window: int) -> np.ndarray:
    """Keys cut to their first `width` words."""
    return keys if width == window else keys.view("u1").reshape(len(keys), -1)[:, : 4 * width].copy().view(f"S{4 * width}").reshape(-1)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))


def pairs_of(part: tuple, where: np.ndarray, key: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word, class, word of the class) for occurrences of windows and the classes low to high - 1 that have them, cut by
    classes to about _PAIRS pairs."""
    _, distinct, items, _, begin = part
    label = items + np.repeat(np.arange(len(distinct)), np.diff(begin)) * (items.max() + 1)  # sorted
    base = key * (items.max() + 1)
    first, last = np.searchsorted(label, base + low), np.searchsorted(label, base + min(high, items.max() + 1))
    counts = last - first
    if counts.sum() > _PAIRS and high - low > 1:
        middle = (low + high) // 2
        yield from pairs_of(part, where, key, low, middle)
        yield from pairs_of(part, where, key, middle, high)
    elif counts.sum():
        at = _ranges(first, counts)
        yield np.repeat(where, counts), items[at], part[3][at]


def longest(word: np.ndarray, item: np.ndarray, place: np.ndarray, width: int, row: np.ndarray) -> list[np.ndarray]:
    """Joins windows that follow each other on a diagonal of (document, item) to maximal matches."""
    order = np.lexsort((word, word - place, item, row))
    word, item, place, row = (x[order] for x in (word, item, place, row))
    fresh = np.ones(len(word), dtype=bool)
    fresh[1:] = (np.diff(row) != 0) | (np.diff(item) != 0) | (np.diff(word - place) != 0) | (np.diff(word) != 1)
    heads = np.flatnonzero(fresh)
    tails = np.append(heads[1:], len(word)) - 1
    return [row[heads], item[heads], word[heads], place[heads], word[tails] + width - word[heads]]


class Scanned:
    """What is known of a slice after some of the blocks."""

    def __init__(self, column: pa.Array, outputs: tuple[str, ...]):
        found = words(column, ALNUM, LOWER)
        self.hashes, self.first, self.outputs = found.hashes, found.first, outputs
        self.marks = np.zeros(len(self.hashes) + 1, dtype=np.int64)
        self.items: dict[int, set[str]] = {}
        self.found: list[tuple] = []

    def mark(self, tests: TestSuffixes) -> None:
        for part, where, key in hits_of(self, tests):
            self.marks[where] += 1
            self.marks[where + part[0]] -= 1
            row = np.searchsorted(self.first, where, "right") - 1
            if {"items", "n_items"} & set(self.outputs):
                self._name(part, row, key, tests)
            if "matches" in self.outputs:
                for a, b in _row_runs(row, np.diff(part[4])[key]):
                    for word, item, place in pairs_of(part, where[a:b], key[a:b], 0, len(tests.ids)):
                        self._join(tests, longest(word, item, place, part[0], np.searchsorted(self.first, word, "right") - 1))

    def _name(self, part: tuple, row: np.ndarray, key: np.ndarray, tests: TestSuffixes) -> None:
        _, distinct, items, _, begin = part
        own = np.unique(row * len(distinct) + key)  # a window counts once a document
        row, key = own // len(distinct), own % len(distinct)
        edges = np.append(np.flatnonzero(np.append(True, row[1:] != row[:-1])), len(row))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            names = self.items.setdefault(int(row[a]), set())
            for c in np.unique(items[_ranges(begin[key[a:b]], np.diff(begin)[key[a:b]])]).tolist():
                names.update(tests.ids[c])

    def _join(self, tests: TestSuffixes, spans: list[np.ndarray]) -> None:
        row, item, word, place, length = spans
        many = np.array([len(i) for i in tests.ids])[item]
        names = np.array([n for c in item.tolist() for n in tests.ids[c]], dtype=object)
        row, word, place, length = (np.repeat(x, many) for x in (row, word, place, length))
        self.found.append((row, word - self.first[row], names, place, length))

    def columns(self) -> list[pa.Array]:
        n = len(self.first) - 1
        covered = np.zeros(len(self.marks), dtype=np.int64)
        np.cumsum(np.cumsum(self.marks[:-1]) > 0, out=covered[1:])
        items = [sorted(self.items.get(r, ())) for r in range(n)]
        made = {
            "n_words": lambda: np.diff(self.first),
            "n_hit": lambda: covered[self.first[1:]] - covered[self.first[:-1]],
            "n_items": lambda: [len(i) for i in items],
            "items": lambda: items,
            "matches": lambda: self._matches(n),
        }
        return [x if isinstance(x := made[k](), pa.Array) else pa.array(x, _ADDED[k]) for k in self.outputs]

    def _matches(self, n: int) -> pa.Array:
        row, word, names, place, length = (np.concatenate(x) for x in zip(*self.found, strict=True)) if self.found else (np.zeros(0, np.int64),) * 5
        order = np.lexsort((place, np.unique(names, return_inverse=True)[1], word, row))
        inner = pa.StructArray.from_arrays([pa.array(names[order].tolist(), pa.string()), *(pa.array(x[order], pa.int64()) for x in (word, place, length))], fields=list(_MATCH))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[order], np.arange(n + 1)), pa.int32()), inner)


def _row_runs(row: np.ndarray, weight: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of hits of whole rows, of about _PAIRS in weight or one row each."""
    edges = np.append(np.flatnonzero(np.append(True, row[1:] != row[:-1])), len(row))
    sums = np.append(0, np.cumsum(weight))
    k = 0
    while k < len(edges) - 1:
        stop = max(k + 1, int(np.searchsorted(sums[edges], sums[edges[k]] + _PAIRS, "right")) - 1)
        yield int(edges[k]), int(edges[stop])
        k = stop


def _loaded(block) -> TestSuffixes:
    """The value of a broadcast, not kept by it; an encrypted one has no file in a worker."""
    path = getattr(block, "_path", None)
    return block.value if path is None else block.load_from_path(path)


def _blocks(spark: SparkSession, benchmark: DataFrame, window: int, block_chars: int) -> list:
    """Broadcasts of the items, each of a bounded number of characters unless a single item has more."""
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where("t is not null")
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-chars // block_chars)
    out = []
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()
        out.append(spark.sparkContext.broadcast(TestSuffixes([r.i for r in rows], [r.t for r in rows], window)))
    return out


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", block_chars: int = BLOCK_CHARS, outputs: tuple[str, ...] = tuple(_ADDED)) -> DataFrame:
    """The documents with n_words, n_hit (words inside an occurrence of a window of `window` consecutive item words;
    a shorter item is one window), n_items, items (their ids, sorted as strings) and matches (the longest verbatim
    matches, with the numbers of their first words in the document and the item, in order of word, item_id and
    item_word), or those of them asked for."""
    blocks = _blocks(documents.sparkSession, benchmark, window, block_chars)
    kept = [c for c in documents.columns if c not in outputs]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = slices(batches, text)
        while held := list(itertools.islice(parts, HELD if len(blocks) > 1 else 1)):
            scanned = [Scanned(part.column(part.schema.get_field_index(text)), outputs) for part in held]
            for block in blocks:
                tests = block.value if len(blocks) == 1 else _loaded(block)
                for own in scanned:
                    own.mark(tests)
                del tests
            for part, own in zip(held, scanned, strict=True):
                yield pa.RecordBatch.from_arrays([*part.columns, *own.columns()], names=[*part.schema.names, *outputs])

    source = documents.select(*(F.col(f"`{c}`") for c in kept))
    return source.mapInArrow(scan, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema), *(f"{k} {_SQL[k]}" for k in outputs)]))


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """The documents without a single occurrence of a benchmark window; columns stay as they were, whatever their names."""
    aside = names_aside(documents.columns, ("n_hit",))
    found = find_contamination(documents.withColumnsRenamed(aside), benchmark, window, aside.get(text, text), outputs=("n_hit",)).where("n_hit = 0")
    return found.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in documents.columns))


def oracle_sql(window: int = WINDOW) -> str:
    """The query's digests of find_contamination(documents, benchmark) for DuckDB: all windows of all items, joined."""
    folded = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return rf"""
WITH own AS (SELECT row_number() OVER () AS rid, doc_id, {folded} AS w FROM documents),
 theirs AS (SELECT item, w, least(len(w), {window}) AS width FROM (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {folded} AS w FROM benchmark) WHERE len(w) > 0),
 tests AS (SELECT DISTINCT item, width, array_to_string(w[i : i + width - 1], ' ') AS g FROM (SELECT *, unnest(generate_series(1, len(w) - width + 1)) AS i FROM theirs)),
 widths AS (SELECT DISTINCT width FROM tests),
 places AS (SELECT rid, width, i, array_to_string(w[i : i + width - 1], ' ') AS g FROM (SELECT rid, w, width, unnest(generate_series(1, len(w) - width + 1)) AS i FROM own, widths WHERE len(w) >= width)),
 found AS (SELECT rid, width, i, item FROM places JOIN tests USING (width, g)),
 hit AS (SELECT rid, count(DISTINCT i + j) AS n FROM (SELECT rid, i, unnest(generate_series(0, width - 1)) AS j FROM (SELECT DISTINCT rid, width, i FROM found)) GROUP BY rid),
 named AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(named.n, 0) AS BIGINT) AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM own LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
"""
