"""The composed automaton against all paths of its transducers and against the rules in words."""

import random
import time

import pyarrow as pa
import pytest

from annalist.llm import toxicity
from annalist.llm.toxicity import CASCADE, INSULT, NEGATION, PLAIN, REPORT, SCOPE, TARGET, THREAT, grammar_automaton


def by_paths(clause, weights):
    """The accepted cascades of paths, their factors multiplied and the weights of words added."""
    results = [(list(clause), [1.0] * len(clause))]
    for transducer in CASCADE:
        results = [(written, [f * g for f, g in zip(factors, own, strict=True)]) for read, factors in results for written, own in transducer.paths(read)]
    sums = [sum(f * w for f, w in zip(factors, weights, strict=True)) for _, factors in results]
    assert len(sums) == 1  # the grammar is unambiguous
    return sums[0]


def by_rules(clause, weights):
    total = 0.0
    for i, (s, w) in enumerate(zip(clause, weights, strict=True)):
        if s > THREAT or NEGATION in clause[max(0, i - SCOPE) : i]:
            continue
        aimed = TARGET in clause[max(0, i - SCOPE) : i + SCOPE + 1]
        w *= (toxicity.AIMED_INSULT if aimed else 1.0) if s == INSULT else (1.0 if aimed else toxicity.AIMLESS_THREAT)
        total += w * (toxicity.REPORTED if REPORT in clause[:i] else 1.0)
    return total


@pytest.mark.parametrize("length", [0, 1, 2, 3, 6, 9, 14])
def test_automaton(length):
    draw = random.Random(length)
    for _ in range(400):
        clause = [draw.choice([INSULT, INSULT, THREAT, TARGET, NEGATION, REPORT, PLAIN, PLAIN, PLAIN]) for _ in range(length)]
        weights = [draw.choice([1.0, 2.0, 5.0]) if s <= THREAT else 0.0 for s in clause]
        words = [(i, s, w) for i, (s, w) in enumerate(zip(clause, weights, strict=True)) if s != PLAIN]
        got = grammar_automaton().weight(words)
        assert got == pytest.approx(by_rules(clause, weights)) == pytest.approx(by_paths(clause, weights))


def test_automaton_is_small_and_linear():
    assert len(grammar_automaton().table) < 1500
    draw = random.Random(3)
    text = " ".join(draw.choices(["you", "idiot", "not", "said", "kill", "and", "the"], k=1_000_000))
    began = time.perf_counter()
    x = toxicity.features(pa.array([text, None, "", "fine"]), toxicity.Grammar())
    assert time.perf_counter() - began < 20
    assert x[0, 0] > 1000 and not x[1:].any()


def test_clashing_column(spark):
    rows = spark.createDataFrame([(1, "You are an idiot.", "old"), (1, "You are an idiot.", "old"), (None, None, None)], "doc_id bigint, text string, score string")
    got = toxicity.score_toxicity(rows, toxicity.Grammar()).collect()
    assert [r.score for r in got[:1]] * 2 == [r.score for r in got[:2]] and got[0].score > got[2].score and len(got) == 3
