"""Documents that have only a line in common are no partition, and those that link still meet."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_links import same

from annalist.llm import jaccard


@pytest.mark.parametrize("words", [90, 300])
def test_a_common_line_ties_few_documents(spark, words):
    draw = random.Random(words)
    line = " ".join(f"common{i}" for i in range(12))
    rows = [(i, f"{' '.join(f'w{draw.randrange(10**8)}' for _ in range(draw.randint(words, words + words // 4)))} {line}") for i in range(400)]
    rows += [(5000 + i, f"{rows[i][1]} and more") for i in range(40)]
    t = jaccard.Threshold(80, 5)
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = jaccard.partitions(jaccard.describe(documents, t), t)
    assert found.groupBy("part").count().agg(F.max("count")).first()[0] < 20
    got = same(spark, rows, t)
    assert {r.doc_id: r.component_id for r in got if r.doc_id >= 5000} == {5000 + i: i for i in range(40)}


@pytest.mark.parametrize(("percent", "sizes"), [(80, (1, 95)), (90, (1, 210))])
def test_sets_with_few_parts_always_share_a_row(percent, sizes):
    draw, t = np.random.default_rng(percent), jaccard.Threshold(percent, 3)
    for n in range(*sizes):
        for more in {0, n * 100 // percent - n, (n * 100 // percent - n) // 2}:
            # as many tokens changed as a link of sets of n and n + more allows
            common = -(-percent * (2 * n + more) // (100 + percent))
            if common > n:
                continue
            tokens = draw.integers(0, 2**63, 2 * n + more - common, dtype=np.uint64)
            a, b = tokens[:n], np.append(tokens[:common], tokens[n:])
            assert t.linked(common, len(a), len(b))
            rows = [np.concatenate(jaccard.signatures(np.sort(x), t)) for x in (a, b)]
            assert len(np.intersect1d(*rows)), (n, more)


@pytest.mark.parametrize("size", [20, 60, 90, 150, 500])
def test_one_common_token_is_no_row(size):
    draw = np.random.default_rng(size)
    sets = [np.sort(np.append(draw.integers(0, 2**63, size + size // 5 * (i % 2), dtype=np.uint64), np.uint64(77))) for i in range(400)]
    rows = [np.unique(np.concatenate(jaccard.signatures(s, jaccard.Threshold(80, 5)))) for s in sets]
    assert np.unique(np.concatenate(rows), return_counts=True)[1].max() == 1
