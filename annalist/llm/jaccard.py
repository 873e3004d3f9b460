"""N-gram Jaccard join with a token-group matrix.

A document is a set of word shingles. Documents of about the same number of shingles are on a level; at a level every
set is cut by token hash into d + 1 parts, d being the most tokens by which two linked sets of that level (or of it
and the next) can differ. Two linked sets therefore agree on one whole part at least. The work goes in five steps:

1. Matrix: rows are contents of parts, columns are documents. A row that several documents share makes them a group.
   Parts of one token or none say little: as rows they would tie all documents that have a line in common. Of many
   parts the first PARTS of two tokens or more are rows: a linked pair agrees on a part with probability 1/e or more, so
   that all of those miss with probability under 1e-11; Threshold(exact=True) looks at all parts and misses nothing.
   Where a set has fewer such parts, the others are rows together with a part of a second cut with other hashes, so that
   a row holds two tokens: each with AGAIN parts of that cut, but in sets with few parts, where they may be all that two
   sets share, with all, and then those that still hold one token or none are cut again, DEPTH times in all.
2. Similar documents are partitioned: in order of size, the members of a group fall into runs where a gap in the
   sizes excludes links, each run is tied to its first member, and what is connected is a partition that no link
   leaves. Of the copies of a set one stands for all.
3. Groups: a small partition is one group. In a larger one each level is cut into groups of about GROUP documents and
   GROUP_TOKENS tokens. A task gets one group and the HUBS documents of its level, and of the level below, that all its
   groups get. It bounds each document's overlap with the token union of the others, opens those that may be linked,
   and compares them by products of token matrices. Documents of one family thus meet in their hubs, at a cost in
   proportion to the family.
4. Partitions that this leaves in one piece are done. In the others, documents that hold too few tokens of any other
   one are dropped. What is left outside a level's largest piece is a query in blocks against the groups of its level
   and the levels beside it; where the largest pieces of two levels are still apart, so are the groups of both. Each
   pair of a block and a group has its unions, bounds and products as before.
5. Links found, few a task as it needs only connections, are joined to components.

Hot keys: copies of one set are dropped before the matrix inside a task and joined to it after; keys that hold more than
a thousandth of the rows, fewer than a thousand keys, are joined by broadcast, others shuffled; a matrix row shared by
very many documents is streamed by a window, which holds none of them; large partitions are spread over their groups.
Nothing of the corpus reaches the driver. All steps are cut off by reliable checkpoints.

Defined results: null, empty and wordless texts have no shingles, link with nothing and are their own component; a
text with fewer words than a shingle is one shingle; rows that share a doc_id are one node of the link graph; a null
doc_id links with nothing and has a null component; a similarity of exactly the threshold links; a very long text is
one set, read and compared whole (products are cut by tokens, so its size is bounded by a few copies of it); an empty
table gives no rows; columns that the method adds win over columns of the same names.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.arrays import LOWER, NOT_SPACE, mix, mix_int, shingles, slices, words
from annalist.llm.components import connected_components
from annalist.llm.shared import checkpointed, join_values, released

PARTS = 64
DEPTH = 3
FEW_PARTS = 24
#: Parts of a second cut with which a part of one token, or none, is a row.
AGAIN = 4
GROUP = 256
GROUP_TOKENS = 1 << 20
HUBS = 4
#: Token matrix cells (documents x tokens) of one product.
_CELLS = 1 << 24
_U = np.uint64


@dataclass(frozen=True)
class Threshold:
    """Sets link when 100 * intersection >= percent * union. exact: all parts are looked at, however many."""

    percent: int = 90
    words: int = 3
    exact: bool = False

    def linked(self, common, a, b):
        return 100 * common >= self.percent * (a + b - common)

    def level(self, n: int) -> int:
        """Levels grow by the factor by which two linked sets can differ, so links stay on a level or go to the next."""
        level = int(math.log(n) / math.log(100 / self.percent))
        while self.begins(level + 1) <= n:
            level += 1
        while self.begins(level) > n:
            level -= 1
        return level

    def begins(self, level: int) -> int:
        """The least size of a level. A size on the next level but one is too large for a link."""
        return _begins(self.percent, level)

    def parts(self, level: int) -> int:
        """One more than the tokens by which linked sets can differ, the smaller one being on the level."""
        n = self.begins(level + 1) - 1
        return n * (100 - self.percent) // self.percent + 1


_tables: dict[int, list[int]] = {}


def _begins(percent: int, level: int) -> int:
    table = _tables.setdefault(percent, [1])
    while len(table) <= level:
        # sizes n .. m are on one level if m <= n / t; then a size linked to one of them is below the end of the next level
        table.append(max(table[-1] + 1, table[-1] * 100 // percent + 1))
    return table[level]


def signatures(tokens: np.ndarray, t: Threshold) -> list[np.ndarray]:
    """Hashes of the matrix rows of a set: its parts at its own level and at the one below."""
    level = t.level(len(tokens))
    out = []
    for at in (level, level - 1):
        if at < 0:
            continue
        n = t.parts(at)
        if n <= FEW_PARTS:
            out.append(_deep(tokens, at, n))
            continue
        looked = n if t.exact else min(n, 2 * PARTS)
        sums, held = _cut(tokens, n, looked, 1000 + at)
        used = np.arange(looked) if t.exact else np.flatnonzero(held > 1)[:PARTS]
        rows = mix(sums[used] + mix(used.astype(_U) + _U(mix_int(7 + at))))
        if not t.exact and len(used) < PARTS:
            thin = np.repeat(np.flatnonzero(held < 2), AGAIN)
            other, among = _cut(tokens, n, n, 3000 + at)
            with_ = (AGAIN * thin + np.arange(len(thin)) % AGAIN) % n
            many = (held[thin] + among[with_] > 1) & ((among[with_] > 1) | (other[with_] != sums[thin]))
            thin, with_ = thin[many], with_[many]
            rows = np.append(rows, mix(mix(sums[thin] + mix(thin.astype(_U) + _U(mix_int(7 + at)))) + mix(other[with_] + mix(with_.astype(_U) + _U(mix_int(5000 + at))))))
        out.append(rows)
    return out


def _cut(tokens: np.ndarray, n: int, looked: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the first parts of n: the sums of their tokens' hashes, and how many they hold."""
    part = ((mix(tokens + _U(mix_int(seed))) >> _U(33)) % _U(n)).astype(np.int64)
    if looked < n:
        seen = part < looked
        part, tokens = part[seen], tokens[seen]
    sums = np.zeros(looked, dtype=_U)
    np.add.at(sums, part, mix(tokens))
    return sums, np.bincount(part, minlength=looked)


def _deep(tokens: np.ndarray, level: int, n: int) -> np.ndarray:
    """Rows of all parts; those that hold one token, or none, are cut once more with other hashes, DEPTH times."""
    path, only = np.array([mix_int(level + 1)], dtype=_U), np.zeros(1, dtype=_U)  # only: the one token of a path's parts, if any
    part = np.arange(n, dtype=_U)
    out = []
    for depth in range(DEPTH + 1):
        sums, held = _cut(tokens, n, n, 2000 + 50 * level + depth)
        at, one = path[:, None], only[:, None]
        whole = (held > 1) | ((held == 1) & (one != 0) & (sums != one)) | (depth == DEPTH or n == 1)
        out.append(mix((at ^ mix(sums + part))[whole]))
        path, only = mix(at + _U(31) * part + _U(1) + sums)[~whole], np.where(one != 0, one, sums)[~whole]
        if not len(path):
            break
    return np.concatenate(out)


def token_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    found = words(column, NOT_SPACE, LOWER)
    hashes, begin = shingles(found, k)
    out = []
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        own = np.sort(hashes[a:b])
        if b - a > 1:
            own = own[np.append(True, own[1:] != own[:-1])]
        out.append(own)
    return out


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=_U).view(np.int64))


_DESCRIBED = "doc bigint, n bigint, level int, high bigint, low bigint, rows array<bigint>"
_SET = ["n", "high", "low"]


def describe(documents: DataFrame, t: Threshold, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document: the size, level and a 128-bit hash of its set, and its matrix rows (none for a copy of a set
    that the same task has met lately)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: OrderedDict[tuple[int, int], None] = OrderedDict()
        for part in slices(batches, "text"):
            sets = token_sets(part.column(1), t.words)
            highs = [int(s.sum()) if len(s) else 0 for s in sets]
            lows = [int(mix(s).sum()) if len(s) else 0 for s in sets]
            rows = []
            for own, high, low, doc in zip(sets, highs, lows, part.column(0).to_pylist(), strict=True):
                if not len(own) or doc is None or (high, low) in met:
                    rows.append(np.zeros(0, np.int64))
                    continue
                met[high, low] = None
                if len(met) > 50_000:
                    met.popitem(last=False)
                rows.append(np.concatenate(signatures(own, t)).view(np.int64))
            flat = pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)]).astype(np.int32), pa.array(np.concatenate(rows) if rows else [], pa.int64()))
            sizes, levels = pa.array([len(s) for s in sets], pa.int64()), pa.array([t.level(len(s)) if len(s) else None for s in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), sizes, levels, _signed(highs), _signed(lows), flat], names=["doc", "n", "level", "high", "low", "rows"])

    return documents.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).mapInArrow(run, _DESCRIBED)


def _sizes_link(less: Column, more: Column, t: Threshold) -> Column:
    return F.coalesce(100 * less >= t.percent * more, F.lit(False))


def partitions(described: DataFrame, t: Threshold) -> DataFrame:
    """doc and part for every document that may be linked: no link leaves a part."""
    cells = described.select("doc", "n", F.explode("rows").alias("row"))
    order = Window.partitionBy("row").orderBy("n", "doc")
    # two members whose sizes allow a link have only such neighbours between them, so a run that no gap in the sizes
    # interrupts holds every link of its members inside the row
    near = cells.withColumn("first", F.when(~_sizes_link(F.lag("n").over(order), F.col("n"), t), F.col("doc")))
    runs = near.select("doc", F.last("first", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("head"))
    pairs = runs.where("doc <> head").select(F.col("head").alias("a"), F.col("doc").alias("b")).distinct()
    return connected_components(pairs).select(F.col("node").alias("doc"), F.col("component").alias("part"))


class Links:
    """Union-find over the documents of a task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def open_groups(left: list[np.ndarray], right: list[np.ndarray] | None, t: Threshold) -> list[tuple[int, int]]:
    """Links between two groups of sets, or inside one, that connect all that is linked; right numbers follow left's."""
    sets = left + (right or [])
    if len(sets) < 2:
        return []
    sizes = np.array([len(s) for s in sets], np.int64)
    cut = len(left)
    # a link needs this much of a document in the union of the sets it may be linked with
    if right is None:
        union, times = np.unique(np.concatenate(sets), return_counts=True)
        unions = [union[times > 1]]
    else:
        unions = [np.unique(np.concatenate(g)) if g else np.zeros(0, _U) for g in (right, left)]
    able = np.array([i for i, s in enumerate(sets) if 100 * _held(s, unions[right is not None and i >= cut]) >= t.percent * len(s)], np.int64)
    ahead, behind = (able, able) if right is None else (able[able < cut], able[able >= cut])
    if not len(ahead) or not len(behind):
        return []
    tokens, number = np.unique(np.concatenate([sets[i] for i in able]), return_inverse=True)
    owner = np.repeat(np.arange(len(able)), sizes[able])
    place = np.full(len(sets), -1)
    place[able] = np.arange(len(able))
    common = np.zeros((len(ahead), len(behind)), dtype=np.float32)
    width = max(1, _CELLS // len(able))
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    for begin in range(0, len(tokens), width):
        lo, hi = np.searchsorted(number, [begin, begin + width])
        matrix = np.zeros((len(able), min(width, len(tokens) - begin)), dtype=np.float32)
        matrix[owner[lo:hi], number[lo:hi] - begin] = 1
        common += matrix[place[ahead]] @ matrix[place[behind]].T
    linked = t.linked(common.astype(np.int64), sizes[ahead][:, None], sizes[behind][None, :])
    found, out = Links(len(sets)), []
    for a, b in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
        i, j = int(ahead[a]), int(behind[b])
        if i != j and found.join(i, j):
            out.append((i, j))
    return out


def _held(tokens: np.ndarray, union: np.ndarray) -> int:
    if not len(union):
        return 0
    at = np.searchsorted(union, tokens)
    at[at == len(union)] = 0
    return int((union[at] == tokens).sum())


def able_members(own: DataFrame, t: Threshold) -> DataFrame:
    """doc and n of the rows of own (doc, part, text) of which others of the part and of sizes near theirs hold enough
    tokens for a link. Exact, as a link needs that much of a set in one other set. A token's rows are streamed by a
    window, which looks at the members next in size, as they are the ones nearest to a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = token_sets(part.column(2), t.words)
            sizes = np.array([len(s) for s in sets], np.int64)
            at = pa.array(np.repeat(np.arange(len(sets)), sizes))
            cell = mix(np.concatenate(sets) + np.repeat(mix(part.column(1).to_numpy().view(_U)), sizes))  # of the part
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array(np.repeat(sizes, sizes)), _signed(cell)], names=["doc", "n", "cell"])

    order = Window.partitionBy("cell").orderBy("n", "doc")
    cells = own.select("doc", "part", "text").mapInArrow(run, "doc bigint, n bigint, cell bigint")
    held = cells.withColumn("held", _sizes_link(F.lag("n").over(order), F.col("n"), t) | _sizes_link(F.col("n"), F.lead("n").over(order), t))
    return held.groupBy("doc", "n").agg(F.count_if("held").alias("held")).where(100 * F.col("held") >= t.percent * F.col("n")).select("doc", "n")


def _compared(texts: DataFrame, keys: list[str], t: Threshold) -> DataFrame:
    """(a, b): links between the documents of texts (keys, side, doc, text) that share all keys, enough to connect what is
    linked: those of side 0 with those of side 1, or all with all where side is null."""
    dealt = texts.select(*keys, "side", "doc", "text").repartition(*keys).sortWithinPartitions(*keys, "side", "doc")
    at_text = len(keys) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(rows):
            distinct: dict[tuple, int] = {}
            docs, sides, sets, out = [], [], [], []
            for side, doc, own in rows:
                copy = (side, len(own), own.tobytes())
                if copy in distinct:
                    out.append((distinct[copy], doc))
                else:
                    distinct[copy] = doc
                    docs.append(doc)
                    sides.append(side)
                    sets.append(own)
            cut = sides.count(0)
            found = open_groups(sets, None, t) if sides[0] is None else open_groups(sets[:cut], sets[cut:], t)
            return out + [(docs[i], docs[j]) for i, j in found]

        current, rows = None, []
        for part in slices(batches, "text"):
            sets = token_sets(part.column(at_text), t.words)
            made = []
            for *at, side, doc, own in zip(*(part.column(i).to_pylist() for i in range(at_text)), sets, strict=True):
                if at != current:
                    if rows:
                        made += close(rows)
                    current, rows = at, []
                if len(own):
                    rows.append((side, doc, own))
            if made:
                yield _pairs(made)
        if rows:
            yield _pairs(close(rows))

    return dealt.mapInArrow(run, "a bigint, b bigint").where("a <> b")


def _grouped(members: DataFrame, keys: list[str]) -> DataFrame:
    """members (doc, level, n, ...) with groups, the number of groups that their keys need, and group, their own."""
    need = F.greatest(F.ceil(F.count(F.lit(1)) / GROUP), F.ceil(F.sum("n") / GROUP_TOKENS)).cast("int")
    per = members.groupBy(*keys).agg(need.alias("groups"), F.count(F.lit(1)).alias("count"))
    return join_values(members, per, keys, "count").withColumn("group", F.pmod(F.xxhash64("doc"), "groups").cast("int"))


def verified_links(documents: DataFrame, members: DataFrame, t: Threshold, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b): enough of the links inside the parts of members (doc, part, level, n) to connect whatever is linked."""
    placed = checkpointed(_grouped(members, ["part"]))
    large = checkpointed(_grouped(placed.where("groups > 1").drop("groups", "group"), ["part", "level"]))
    draw = F.xxhash64("doc", F.lit(5))
    picked = large.groupBy("part", "level", F.pmod(draw, F.lit(HUBS)).alias("k")).agg(F.min_by("doc", draw).alias("doc")).select("part", "level", "doc", F.lit(True).alias("hub"))
    small = placed.where("groups = 1").select("doc", "part", F.lit(-1).alias("level"), "group", F.lit(None).cast("boolean").alias("hub"))
    dealt = small.unionByName(large.select("doc", "part", "level", "group").join(picked, ["part", "level", "doc"], "left"))
    own = checkpointed(documents.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).join(dealt, "doc"))

    # one group each, with the hubs of its level and of the one below
    hubs = own.where("hub").select("part", F.explode(F.array(F.col("level"), F.col("level") + 1)).alias("level"), "doc", "text")
    classes = large.select("part", "level", "groups").distinct()
    sent = hubs.join(classes, ["part", "level"]).select("part", "level", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "doc", "text")
    keys = ["part", "level", "group"]
    first = checkpointed(_compared(own.select(*keys, "doc", "text").unionByName(sent).withColumn("side", F.lit(None).cast("int")), keys, t))

    # large partitions that are still in pieces
    if not large.take(1):
        released(placed, large, own)
        return first
    found = connected_components(first).select(F.col("node").alias("doc"), F.col("component").alias("piece"))
    pieces = checkpointed(large.drop("groups", "group").join(found, "doc", "left").withColumn("piece", F.coalesce("piece", "doc")))
    broken = pieces.groupBy("part").agg(F.min("piece").alias("least"), F.max("piece").alias("most"), F.count(F.lit(1)).alias("count"))
    open_ = checkpointed(join_values(pieces, broken.where("least <> most").select("part", "count"), ["part"], "count"))
    if not open_.take(1):
        released(placed, large, own, pieces, open_)
        return first
    texts = own.select("doc", "part", "text").join(open_.select("doc", "part").distinct(), ["doc", "part"])
    able = checkpointed(able_members(texts, t))
    left = checkpointed(_grouped(open_.join(able, ["doc", "n"]), ["part", "level"]))
    mains = checkpointed(left.groupBy("part", "level", "groups", "piece").agg(F.count(F.lit(1)).alias("count")).groupBy("part", "level", "groups").agg(F.max_by("piece", F.struct("count", "piece")).alias("main"), F.sum("count").alias("count")))
    marked = checkpointed(join_values(left.drop("groups"), mains.drop("groups"), ["part", "level"], "count").withColumn("other", F.col("piece") != F.col("main")))
    blocks = marked.where("other").groupBy("part", "level").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("blocks"))
    sides = checkpointed(mains.join(blocks, ["part", "level"], "left"))
    x, y = sides.alias("x"), sides.alias("y")
    beside = x.join(y, F.col("x.part") == F.col("y.part")).where("abs(x.level - y.level) <= 1")
    same = F.col("x.main") == F.col("y.main")
    plan = beside.where((same & F.col("x.blocks").isNotNull()) | (~same & (F.col("x.level") < F.col("y.level")))).select(
        F.col("x.part").alias("part"), F.col("x.level").alias("low"), F.col("y.level").alias("high"), (~same).alias("every"), F.when(same, F.col("x.blocks")).otherwise(F.col("x.groups")).alias("blocks"), F.col("y.groups").alias("groups"))
    counts = mains.select("part", "level", "count")
    asking = _with_plan(marked, plan.withColumnRenamed("low", "level"), counts).where("every OR other")
    block = F.when(F.col("every"), F.col("group")).otherwise(F.pmod(F.xxhash64("doc", F.lit(9)), "blocks").cast("int"))
    queries = asking.select("doc", "part", F.col("level").alias("low"), "high", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.lit(0).alias("side"))
    asked = _with_plan(marked, plan.withColumnRenamed("high", "level"), counts)
    targets = asked.select("doc", "part", "low", F.col("level").alias("high"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "group", F.lit(1).alias("side"))
    second = checkpointed(_compared(texts.join(queries.unionByName(targets), ["doc", "part"]), ["part", "low", "high", "block", "group"], t))
    released(placed, large, own, pieces, open_, able, left, mains, marked, sides)
    return first.unionByName(second)


def _with_plan(marked: DataFrame, plan: DataFrame, counts: DataFrame) -> DataFrame:
    """marked members with each of the comparisons that plan has for their part and level, at most three."""
    listed = plan.groupBy("part", "level").agg(F.collect_list(F.struct(*(c for c in plan.columns if c not in ("part", "level")))).alias("plans"))
    return join_values(marked, listed.join(counts, ["part", "level"]), ["part", "level"], "count").select("*", F.inline("plans")).drop("plans")


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 2, names=["a", "b"])


def jaccard_components(documents: DataFrame, t: Threshold = Threshold(), key: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: B008
    """key, n_shingles and component_id (the least key reachable over links, itself included) for each document."""
    matrix = checkpointed(describe(documents, t, key, text))
    described = checkpointed(matrix.withColumn("known", F.size("rows") > 0).drop("rows"))
    usable = described.where("n > 0 AND doc IS NOT NULL")
    # one document stands for all copies of a set, and is one whose rows are known
    first = F.coalesce(F.min(F.when(F.col("known"), F.col("doc"))), F.min("doc"))
    sets = checkpointed(usable.groupBy(*_SET).agg(first.alias("stands"), F.min("doc").alias("least"), F.min("level").alias("level"), F.count(F.lit(1)).alias("copies")))
    members = checkpointed(partitions(matrix, t).join(sets.select(F.col("stands").alias("doc"), "level", "n").distinct(), "doc"))
    released(matrix)
    links = verified_links(documents, members, t, key, text)

    own = checkpointed(join_values(usable.select("doc", *_SET), sets.select(*_SET, "stands", "copies"), _SET, "copies"))
    again = checkpointed(described.where("doc IS NOT NULL").groupBy("doc").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc"))
    ties = own.join(again, "doc", "left_semi").select(F.col("doc").alias("a"), F.col("stands").alias("b"))
    found = connected_components(links.unionByName(ties))

    rooted = checkpointed(sets.join(found.select(F.col("node").alias("stands"), F.col("component").alias("root")), "stands", "left"))
    ids = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("id"), F.count(F.lit(1)).alias("count"))
    linked = join_values(rooted.where("root IS NOT NULL"), ids, ["root"], "count").select(*_SET, "id", "copies")
    known = checkpointed(linked.unionByName(rooted.where("root IS NULL").select(*_SET, F.col("least").alias("id"), "copies")))
    labelled = join_values(own, known, _SET, "copies").select("doc", "n", "id")
    repeated = labelled.join(again, "doc", "left_semi").select("doc", "id").distinct()
    wordless = described.where("n = 0 AND doc IS NOT NULL").select("doc", "n").join(repeated, "doc", "left").select("doc", "n", F.coalesce("id", "doc").alias("id"))
    nameless = described.where("doc IS NULL").select("doc", "n", F.lit(None).cast("bigint").alias("id"))
    return labelled.unionByName(wordless).unionByName(nameless).select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))


def one_of_each(documents: DataFrame, t: Threshold = Threshold(80, 5), key: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: B008
    """The documents without near copies: of each component the document with the least key stays, with all its rows
    if the key is repeated; documents without words or without a key all stay."""
    found = jaccard_components(documents, t, key, text).where("n_shingles > 0 AND component_id IS NOT NULL")
    drop = found.where(F.col(key) != F.col("component_id")).select(key).distinct()
    return documents.join(drop, key, "left_anti").select(*(f"`{c}`" for c in documents.columns))


def oracle_sql(t: Threshold = Threshold()) -> str:  # noqa: B008
    """jaccard_components(documents) for DuckDB: all pairs that share a shingle are counted, links followed step by step."""
    grams = " || ' ' || ".join(f"w[i + {j}]" for j in range(t.words))
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 sh AS (SELECT DISTINCT rid, hash({grams}) AS g FROM (SELECT rid, w, unnest(generate_series(1, len(w) - {t.words - 1})) AS i FROM d WHERE len(w) >= {t.words}) UNION ALL SELECT rid, hash(array_to_string(w, ' ')) FROM d WHERE len(w) BETWEEN 1 AND {t.words - 1}),
 n AS (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
 common AS (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM sh x JOIN sh y ON x.g = y.g AND x.rid < y.rid GROUP BY x.rid, y.rid),
 links AS (SELECT p.doc_id AS a, q.doc_id AS b FROM common JOIN n x ON x.rid = a JOIN n y ON y.rid = b JOIN d p ON p.rid = a JOIN d q ON q.rid = b WHERE 100 * c >= {t.percent} * (x.n + y.n - c) AND p.doc_id <> q.doc_id),
 edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
 reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM edges UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.other),
 least_ AS (SELECT doc_id, min(other) AS component FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id FROM d LEFT JOIN n USING (rid) LEFT JOIN least_ ON least_.doc_id = d.doc_id
"""
