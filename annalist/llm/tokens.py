"""Token counts that follow edits.

A document's text is cut to pre-tokens, and a segment tree over them holds sums of characters and tokens. An edit
finds its place by descending the tree, re-cuts only the pre-tokens it touches plus the context whose cut could depend
on it, re-encodes those, and updates the sums on the paths above the leaves it touches. All sums are built anew only
after an edit has made leaves several times larger.

Documents are counted in one pass without a shuffle. Defined results: null and empty texts have no tokens; edits are
in characters of the text as it is when they are applied, and are clipped to it; rows are counted one by one, repeated
or not; a very long text has one tree, in memory linear in it; an empty table gives no rows; extra columns pass through,
and the columns added win over columns of the same names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm import vocabulary
from annalist.llm.arrays import slices

VOCABULARY = "byte_bpe_50k.tiktoken"
Edit = tuple[int, int, str]  # start, end, replacement
#: Characters beyond its end that the cut of a pre-token can depend on (a contraction looks two ahead).
_LOOK_AHEAD = 3
#: Pre-tokens whose counts a worker remembers: at least half as many of those met last.
_MEMORY = 1 << 18
#: Pre-tokens of a leaf.
_LEAF = 32
_cut = regex.compile(vocabulary.PATTERN)


class Counter:
    """Token counts of single pre-tokens. When the newer half of the memory is full, it becomes the older half."""

    def __init__(self, encode: Callable[[str], list[int]]):
        self.encode, self.known, self.older = encode, {}, {}

    def many(self, pieces: list[str]) -> list[int]:
        if len(self.known) > _MEMORY // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        out = list(map(known.get, pieces))
        if None in out:
            for i, (p, n) in enumerate(zip(pieces, out, strict=True)):
                if n is None:
                    n = known.get(p)
                    if n is None:
                        n = older.get(p)
                        if n is None:
                            n = len(self.encode(p))
                        if len(p) <= 64:
                            known[p] = n
                    out[i] = n
        return out


class DocumentTree:
    """Leaves hold runs of pre-tokens; the tree holds, for each node, the characters and tokens below it."""

    def __init__(self, text: str, counter: Counter):
        self.counter, self.reencoded = counter, 0
        pieces = _cut.findall(text)
        counts = counter.many(pieces)
        self.leaves = [(pieces[i : i + _LEAF], counts[i : i + _LEAF]) for i in range(0, len(pieces), _LEAF)]
        self._grow()

    def _grow(self) -> None:
        """Sums from the leaves to the root, level by level."""
        chars = np.array([sum(map(len, p)) for p, _ in self.leaves], np.int64)
        tokens = np.array([sum(c) for _, c in self.leaves], np.int64)
        self.levels = [(chars, tokens)]
        while len(chars) > 1:
            edges = np.arange(0, len(chars), 2)
            chars, tokens = np.add.reduceat(chars, edges), np.add.reduceat(tokens, edges)
            self.levels.append((chars, tokens))

    @property
    def n_tokens(self) -> int:
        return int(self.levels[-1][1].sum())

    @property
    def n_chars(self) -> int:
        return int(self.levels[-1][0].sum())

    @property
    def n_pieces(self) -> int:
        return sum(len(p) for p, _ in self.leaves)

    def text(self) -> str:
        return "".join(x for p, _ in self.leaves for x in p)

    def _find(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and the characters before the leaf."""
        node, before = 0, 0
        for chars, _ in self.levels[-2::-1]:
            node *= 2
            if node + 1 < len(chars) and char >= before + chars[node]:
                before += int(chars[node])
                node += 1
        return node, before

    def _update(self, leaf: int) -> None:
        """Renews the sums on the path from a leaf to the root."""
        pieces, counts = self.leaves[leaf]
        values = sum(map(len, pieces)), sum(counts)
        for level, (chars, tokens) in enumerate(self.levels):
            chars[leaf], tokens[leaf] = values
            leaf >>= 1
            if level + 1 < len(self.levels):
                values = chars[2 * leaf : 2 * leaf + 2].sum(), tokens[2 * leaf : 2 * leaf + 2].sum()

    def apply(self, start: int, end: int, new: str) -> None:
        """Replaces characters start to end."""
        size = self.n_chars
        start, end = max(0, min(start, size)), max(0, min(end, size))
        end = max(start, end)
        if not self.leaves:
            self.leaves = [([], [])]
            self._grow()
        first, before = self._find(max(0, start - _LOOK_AHEAD))
        pieces, counts = self.leaves[first]
        at, head = before, 0
        while head < len(pieces) and at + len(pieces[head]) <= start - _LOOK_AHEAD:
            at += len(pieces[head])
            head += 1
        old_from, last, tail = at, first, head  # the region to cut again, old_from up to the end of its last piece
        stop, region = at, []
        take = max(end, start) + 1
        while True:
            while stop < take and last < len(self.leaves):
                own = self.leaves[last][0]
                while tail < len(own) and stop < take:
                    region.append(own[tail])
                    stop += len(own[tail])
                    tail += 1
                if tail == len(own) and last + 1 < len(self.leaves) and stop < take:
                    last, tail = last + 1, 0
                elif tail == len(own):
                    break
            at_end = stop >= size
            old = "".join(region)
            text = old[: start - old_from] + new + old[end - old_from :]
            cut = _cut.findall(text)
            if at_end:
                break
            # what follows the edit is cut as before from an old boundary on, if the new cut has that boundary too
            shift = len(text) - len(old)
            bounds = dict(zip(accumulate(map(len, cut)), range(1, len(cut) + 1), strict=True))
            place, meets = old_from, None
            for i, piece in enumerate(region):
                if place >= end and place - old_from + shift in bounds and place - old_from + shift <= len(text) - _LOOK_AHEAD:
                    meets = i, bounds[place - old_from + shift]
                    break
                place += len(piece)
            if meets:
                cut = cut[: meets[1]]
                give_back = len(region) - meets[0]
                while give_back > tail:  # the boundary lies in an earlier leaf
                    give_back -= tail
                    last -= 1
                    tail = len(self.leaves[last][0])
                tail -= give_back
                break
            take = stop + 16
        self.reencoded += len(cut)
        fresh = self.counter.many(cut)
        rest, rest_counts = self.leaves[last]
        merged, sums = pieces[:head] + cut + rest[tail:], counts[:head] + fresh + rest_counts[tail:]
        n = last - first + 1
        if len(merged) > 8 * _LEAF * n:
            self.leaves[first : last + 1] = [(merged[i : i + _LEAF], sums[i : i + _LEAF]) for i in range(0, len(merged), _LEAF)]
            self._grow()
            return
        # the same leaves take what there is now in equal parts, so only the paths above them change
        for k in range(n):
            a, b = len(merged) * k // n, len(merged) * (k + 1) // n
            self.leaves[first + k] = merged[a:b], sums[a:b]
            self._update(first + k)


def count_tokens(documents: DataFrame, edits: Callable[[str], list[Edit]] | None = None, text: str = "text", name: str = VOCABULARY, folder: str = vocabulary.FOLDER) -> DataFrame:
    """The documents with n_tokens and n_pieces of the text, and n_tokens_edited, n_chars_edited and n_reencoded (the
    pre-tokens encoded again) after the edits that `edits` gives for a text have been applied one after the other."""
    shared = vocabulary.share(documents.sparkSession, name, folder)
    added = ["n_tokens", "n_pieces", "n_tokens_edited", "n_chars_edited", "n_reencoded"]
    source = documents.select(*(F.col(f"`{c}`") for c in documents.columns if c not in added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary.ranks_encoder(shared.value).encode_ordinary)
        for part in slices(batches, text):
            rows = []
            for t in part.column(part.schema.get_field_index(text)).to_pylist():
                tree = DocumentTree(t or "", counter)
                before = tree.n_tokens, tree.n_pieces
                for edit in edits(t or "") if edits else ():
                    tree.apply(*edit)
                rows.append((*before, tree.n_tokens, tree.n_chars, tree.reencoded))
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], names=[*part.schema.names, *added])

    return source.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema), *(f"{a} bigint" for a in added)]))
