"""Toxicity by a weighted finite-state pattern grammar.

The words of a clause become symbols: insult, threat, target, negation, report or none of them. Four transducers, given
as arcs of states, read them one after the other and are composed to one automaton (`transducers`):

* negation writes a plain symbol for insults and threats within SCOPE words after a negation;
* reported speech dampens what stands after a reporting verb;
* target guesses, for each insult or threat that no target precedes within SCOPE words, whether one follows within SCOPE
  words, writes it as aimed or aimless, and drops the path if the guess was wrong;
* matching takes aimed insults at more than their weight, aimless threats at a fraction.

The automaton has a bounded number of states and its guesses live for SCOPE words, so a clause of any length takes time
in proportion to it. The weight of its one accepted path is the clause's, and a document is scored from the weights of
its clauses, not from isolated words.

The lexicon, from words and first bytes of words to symbols with weights, starts from a few seed words; its weights, the
further insults and the final logistic model are learned from a bounded sample of labelled rows. All texts are scored
whole, in numpy slices: a word is looked up by its hash, and only the few words that carry a symbol reach Python.

Defined results: null, empty and wordless texts get the score of a text without matches; labels repeated for a
document count as toxic if one is; without labels the seed lexicon's weights are used; of a word and its stems the
heaviest entry counts; rows are scored one by one, repeated or not; a very long text, or one without an end mark, is
scored whole; an empty table gives no rows; extra columns pass through, and the columns added win over columns of the
same names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.arrays import ALNUM, LOWER, Words, slices, words
from annalist.llm.learning import MAX_TRAINING_ROWS, bounded_sample
from annalist.llm.transducers import Automaton, Transducer, compose

# The seed lexicon, one word each.
INSULTS = ["idiot", "idiots", "moron", "morons", "stupid", "dumb", "fool", "fools", "imbecile", "loser", "losers", "pathetic", "scum", "worthless", "trash", "clown", "clowns", "disgusting", "filth", "vermin", "ugly", "bastard", "coward", "liar", "freak", "creep", "garbage", "retard", "bitch", "asshole", "shit", "fuck", "fucking"]
THREATS = ["kill", "hurt", "destroy", "beat", "burn", "hang", "shoot", "stab", "strangle", "smash", "punish"]
TARGETS = ["you", "your", "yours", "youre", "u", "ur", "he", "she", "they", "them", "him", "his", "their", "these", "those", "everyone"]
NEGATIONS = ["not", "no", "never", "without", "isn", "aren", "wasn", "weren", "don", "doesn", "didn", "won", "hardly", "neither"]
REPORTS = ["said", "says", "say", "called", "calls", "wrote", "writes", "quoted", "quote", "claimed", "claims", "reported", "alleged", "according", "told"]

INSULT, THREAT, TARGET, NEGATION, REPORT, PLAIN = range(6)
#: What the target transducer writes for insults and threats.
_AIMED_INSULT, _INSULT, _AIMED_THREAT, _THREAT = range(6, 10)
SCOPE = 4
#: Factors of a word's weight.
REPORTED = 0.3
AIMED_INSULT, AIMLESS_THREAT = 1.5, 0.25
_FEATURES = 4
#: Words and stems (first bytes of words) that may be learned, the share of the sampled toxic documents that has to hold
#: one, the least log-odds, and the least number of words that it follows, as copies of one text say little.
MAX_LEARNED = 1000
STEMS = (4, 5, 6, 7, 8)
MIN_SHARE = 0.01
MIN_ODDS = 2.5
MIN_CONTEXTS = 5
_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(b".!?;:\n")] = True


def seeds() -> dict[str, tuple[int, float]]:
    out = {w: (TARGET, 0.0) for w in TARGETS} | {w: (NEGATION, 0.0) for w in NEGATIONS} | {w: (REPORT, 0.0) for w in REPORTS}
    return out | {w: (THREAT, 1.5) for w in THREATS} | {w: (INSULT, 2.0) for w in INSULTS}


@dataclass
class Grammar:
    """The lexicon (word to symbol and weight), the learned stems with their weights, which are insults too, and the
    logistic model over a document's features."""

    lexicon: dict[str, tuple[int, float]] = field(default_factory=seeds)
    stems: dict[bytes, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.5, 0.5, 0.5]))
    bias: float = -3.0

    def __post_init__(self):
        self.words = _Lookup({k.encode(): v for k, v in self.lexicon.items()})
        self.by_stem = {n: _Lookup({k: (INSULT, v) for k, v in self.stems.items() if len(k) == n}) for n in STEMS}

    def symbols(self, found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the words that carry a symbol, the symbols and their weights."""
        symbol, weight = self.words.find(found.hashes)
        for n, hashes in found.prefixes(STEMS if self.stems else ()):
            lookup = self.by_stem[n]
            if len(lookup.hashes):
                other, heavier = lookup.find(hashes)
                better = (other >= 0) & ((symbol < 0) | (heavier > weight) & (symbol <= THREAT))
                symbol, weight = np.where(better, other, symbol), np.where(better, heavier, weight)
        at = np.flatnonzero(symbol >= 0)
        return at, symbol[at], weight[at]


class _Lookup:
    """Symbols and weights by hash."""

    def __init__(self, entries: dict[bytes, tuple[int, float]]):
        names = sorted(entries)
        hashes = words(pa.array(names, pa.binary()), ALNUM, LOWER).hashes
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.symbol = np.array([entries[names[i]][0] for i in order], dtype=np.int64)
        self.weight = np.array([entries[names[i]][1] for i in order])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol (-1 if none) and weight of each hash."""
        number = np.searchsorted(self.hashes, hashes)
        number[number == len(self.hashes)] = 0
        known = self.hashes[number] == hashes
        return np.where(known, self.symbol[number], -1), np.where(known, self.weight[number], 0.0)


def _negation() -> Transducer:
    """State: words that the last negation still covers."""

    def arcs(left: int, symbol: int):
        if symbol == NEGATION:
            return [(PLAIN, 1.0, SCOPE)]
        return [(PLAIN if left and symbol <= THREAT else symbol, 1.0, max(0, left - 1))]

    return Transducer(0, arcs)


def _reported() -> Transducer:
    """State: whether a reporting verb stood before."""

    def arcs(reported: bool, symbol: int):
        if symbol == REPORT:
            return [(PLAIN, 1.0, True)]
        return [(symbol, REPORTED if reported and symbol <= THREAT else 1.0, reported)]

    return Transducer(False, arcs)


def _target() -> Transducer:
    """State: words that the last target still covers, words within which a target has to come (0: it need not), and
    words within which none may."""

    def arcs(state: tuple[int, int, int], symbol: int):
        behind, must, never = state
        if symbol == TARGET:
            return [] if never else [(PLAIN, 1.0, (SCOPE, 0, 0))]
        if must == 1:
            return []  # too late for the target that was guessed
        after = max(0, behind - 1), max(0, must - 1), max(0, never - 1)
        if symbol > THREAT:
            return [(symbol, 1.0, after)]
        aimed, aimless = (_AIMED_INSULT, _INSULT) if symbol == INSULT else (_AIMED_THREAT, _THREAT)
        if behind:
            return [(aimed, 1.0, after)]
        # a target that must come in time for this word: the earliest deadline stays
        soon = after[1] or SCOPE
        guesses = [(aimed, 1.0, (after[0], soon, after[2]))] if soon > after[2] else []
        return guesses + ([] if after[1] else [(aimless, 1.0, (after[0], 0, SCOPE))])

    return Transducer((0, 0, 0), arcs, lambda state: not state[1])


def _matching() -> Transducer:
    factors = {_AIMED_INSULT: AIMED_INSULT, _INSULT: 1.0, _AIMED_THREAT: 1.0, _THREAT: AIMLESS_THREAT}
    return Transducer(0, lambda state, symbol: [(symbol, factors.get(symbol, 0.0), 0)])


CASCADE = (_negation(), _reported(), _target(), _matching())


@functools.cache
def grammar_automaton() -> Automaton:
    return Automaton(functools.reduce(compose, CASCADE), PLAIN + 1, PLAIN, SCOPE + 1)


def features(column: pa.Array, grammar: Grammar) -> np.ndarray:
    """For each row: the heaviest clause, the log of all weight, the number of heavy clauses (log), weight a word."""
    found = words(column, ALNUM, LOWER)
    n = len(found.first) - 1
    out = np.zeros((n, _FEATURES))
    if not len(found.hashes):
        return out
    at, symbol, weight = grammar.symbols(found)
    row = np.searchsorted(found.first, at, "right") - 1
    heavy = np.zeros(n, dtype=bool)
    heavy[row[symbol <= THREAT]] = True
    keep = heavy[row]
    at, symbol, weight, row = at[keep], symbol[keep], weight[keep], row[keep]
    if not len(at):
        return out
    clause = np.searchsorted(np.flatnonzero(_ENDS[found.raw]), found.starts[at])
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = (np.diff(row) != 0) | (np.diff(clause) != 0)
    edges = np.append(np.flatnonzero(fresh), len(at))
    symbols = list(zip(at.tolist(), symbol.tolist(), weight.tolist(), strict=True))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        left = grammar_automaton().weight(symbols[a:b])
        r = row[a]
        out[r, 0] = max(out[r, 0], left)
        out[r, 1] += left
        out[r, 2] += left > 0.5
    out[:, 3] = 100 * out[:, 1] / np.maximum(np.diff(found.first), 1)
    out[:, 1:] = np.log1p(out[:, 1:])
    return out


def score(x: np.ndarray, grammar: Grammar) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ grammar.weights + grammar.bias, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps."""
    z = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(z.shape[1]), np.diag([0.05] * x.shape[1] + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge
        w = w + np.clip(np.linalg.solve(h, z.T @ (weight * (y - p)) - ridge @ w), -5, 5)
    return w[:-1], float(w[-1])


def train(documents: DataFrame, labels: DataFrame, usable: Column, rows: int = MAX_TRAINING_ROWS, text: str = "text") -> Grammar:
    """Learns from about `rows` labelled documents of each label at most, among those that are usable.

    The sampled ids are bounded and may be broadcast; word counts are summed on the executors, and the driver gets
    the words and stems found in MIN_SHARE of the sampled toxic documents and a few numbers for each sampled row.
    """
    known = labels.where(usable & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    ids = F.broadcast(bounded_sample(known, "toxic", "doc_id", rows))
    sample = documents.join(ids, "doc_id").select("toxic", F.col(text).alias("text"))
    if not totals:
        return Grammar()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, list[int]] = {}
        seen = [0, 0, -1]
        for part in slices(batches, "text"):
            found = words(part.column(1), ALNUM, LOWER)
            low = LOWER[found.raw].tobytes()
            starts, ends = found.starts.tolist(), found.ends.tolist()
            contexts = [0, *(found.hashes[:-1] & np.uint64(63)).tolist()]
            for r, toxic in enumerate(part.column(0).to_pylist()):
                seen[toxic] += 1
                own: dict[bytes, int] = {}
                for i in range(found.first[r], found.first[r + 1]):
                    w, context = low[starts[i] : ends[i]], 1 << contexts[i]
                    own[w] = own.get(w, 0) | context
                    for n in STEMS:
                        if len(w) >= n:
                            stem = b"^" + w[:n]
                            own[stem] = own.get(stem, 0) | context
                for w, mask in own.items():
                    row = counts.setdefault(w, [0, 0, 0])
                    row[toxic] += 1
                    row[2] |= mask if toxic else 0
        counts[b" "] = seen  # not a word: the number of documents
        columns = [pa.array(list(counts), pa.binary()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1)), pa.array([c[2] - (1 << 64) if c[2] >> 63 == 1 else c[2] for c in counts.values()], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "clean", "toxic", "contexts"])

    sums = sample.mapInArrow(count, "word binary, clean long, toxic long, contexts long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.bit_count(F.bit_or("contexts")).alias("contexts"))
    is_seed = F.col("word").isin([w.encode() for w in seeds()])  # those that clean texts have too lose their weight
    is_total = F.col("word") == F.lit(b" ")
    sums = sums.where(is_total | is_seed | ((F.col("toxic") >= 5) & (F.col("contexts") >= MIN_CONTEXTS) & (F.col("toxic") > 2 * F.col("clean")))).orderBy((is_total | is_seed).desc(), F.desc("toxic"), "word").limit(20 * MAX_LEARNED).collect()
    n_clean, n_toxic = next(((r.clean, r.toxic) for r in sums if bytes(r.word) == b" "), (0, 0))
    if not n_clean or not n_toxic:
        return Grammar()
    odds, stems, frequent = {}, {}, {}
    for r in sums:
        name, kind = bytes(r.word), "stem" if bytes(r.word).startswith(b"^") else "word"
        x = min(6.0, float(np.log((r.toxic + 0.5) / (n_toxic + 1)) - np.log((r.clean + 0.5) / (n_clean + 1))))
        if name != b" " and (r.toxic >= MIN_SHARE * n_toxic or kind == "word"):
            (stems if kind == "stem" else odds)[name.removeprefix(b"^") if kind == "stem" else name.decode("utf-8", "replace")] = x
            frequent[name.decode("utf-8", "replace")] = r.toxic >= MIN_SHARE * n_toxic
    lexicon = {w: (s, max(0.0, odds.get(w, x)) if s <= THREAT else x) for w, (s, x) in seeds().items()}
    learned = sorted((w for w, x in odds.items() if x > MIN_ODDS and w not in lexicon and frequent[w]), key=lambda w: (-odds[w], w))[:MAX_LEARNED]
    lexicon |= {w: (INSULT, odds[w]) for w in learned}
    best = sorted((w for w, x in stems.items() if x > MIN_ODDS), key=lambda w: (-stems[w], w))[:MAX_LEARNED]
    grammar = Grammar(lexicon, {w: stems[w] for w in best})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(c) for c in features(part.column(1), grammar).T)], names=["toxic", *(f"x{i}" for i in range(_FEATURES))])

    rows_ = sample.mapInArrow(measure, "toxic long, " + ", ".join(f"x{i} double" for i in range(_FEATURES))).toArrow()
    rows_ = np.column_stack([c.to_numpy() for c in rows_.columns])
    y = rows_[:, 0]
    share = {k: totals.get(k, 0) / max(1, (y == k).sum()) for k in (0, 1)}
    weight = np.where(y == 1, share[1], share[0])
    grammar.weights, grammar.bias = _logistic(rows_[:, 1:], y, weight * len(y) / weight.sum())
    return grammar


def score_toxicity(documents: DataFrame, grammar: Grammar, text: str = "text") -> DataFrame:
    """The documents with score (0 to 1)."""
    shared = documents.sparkSession.sparkContext.broadcast(grammar)
    source = documents.select(*(F.col(f"`{c}`") for c in documents.columns if c != "score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            x = features(part.column(part.schema.get_field_index(text)), shared.value)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score(x, shared.value), pa.float64())], names=[*part.schema.names, "score"])

    return source.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema), "score double"]))
