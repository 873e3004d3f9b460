"""Links that are easily lost: prefixes and edits of all sizes, many parts, large families, hot copies."""

import random

import pytest

from annalist.llm import components, jaccard, shared
from test_joins import plain_components

SCHEMA = "doc_id bigint, text string"


def same(spark, rows, t):
    got = jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA), t).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in got) == plain_components(rows, t)
    return got


def families(draw, count, sizes, copies):
    """Texts of distinct words, cut at either end and edited a little."""
    for f in range(count):
        n = draw.randint(*sizes)
        base = [f"f{f}w{i}" for i in range(n + n // 3)]
        for _ in range(draw.randint(*copies)):
            w = base[draw.randrange(1 + n // 20) : n + draw.randrange(1 + n // 3) - n // 6]
            for _ in range(draw.choice([0, 0, 1, 2, max(1, n // 60)])):
                w[draw.randrange(len(w))] = f"x{draw.randrange(10**7)}"
            yield " ".join(w)


@pytest.mark.parametrize("t", [jaccard.Threshold(90, 3), jaccard.Threshold(80, 5), jaccard.Threshold(90, 3, exact=True)])
@pytest.mark.parametrize(("count", "sizes", "copies"), [(120, (9, 75), (4, 20)), (8, (600, 3000), (4, 12))])
def test_families_of_prefixes_and_edits(spark, t, count, sizes, copies):
    draw = random.Random(t.percent + count)
    texts = [" ".join(f"v{i}" for i in range(n)) for n in (14, 12, 13, 11)] + list(families(draw, count, sizes, copies))
    rows = list(enumerate(draw.sample(texts, len(texts)), 1))
    got = same(spark, rows, t)
    assert len({r.component_id for r in got}) < len(rows)


def test_four_prefixes(spark):
    same(spark, [(k, " ".join(f"v{i}" for i in range(n))) for k, n in enumerate((14, 12, 13, 11), 1)], jaccard.Threshold())


@pytest.mark.parametrize("tokens", [1 << 20, 3000])
def test_large_partitions_in_pieces(spark, monkeypatch, tokens):
    """Families whose members mostly miss their hubs, so blocks are compared with groups."""
    monkeypatch.setattr(jaccard, "GROUP", 16)
    monkeypatch.setattr(jaccard, "GROUP_TOKENS", tokens)
    monkeypatch.setattr(jaccard, "HUBS", 2)
    draw = random.Random(5)
    texts = []
    for f in range(3):
        base = [f"b{f}_{i}" for i in range(130)]
        for _ in range(90):
            w = base[: draw.choice([100, 108, 116, 125, 130])]
            for _ in range(draw.randrange(5)):
                w[draw.randrange(len(w))] = f"x{draw.randrange(10**7)}"
            texts.append(" ".join(w))
    passage = " ".join(f"p{i}" for i in range(70))
    texts += [f"{passage} {' '.join(f'y{draw.randrange(10**7)}' for _ in range(60))}" for _ in range(80)]
    rows = list(enumerate(draw.sample(texts, len(texts)), 1))
    got = same(spark, rows, jaccard.Threshold())
    assert len({r.component_id for r in got}) > 90


def test_hot_copies_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT", 4)
    draw = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base)) for i in range(100, 300)] + [(i, None) for i in range(300, 380)] + [(None, " ".join(base))] * 30
    rows += [(i, " ".join([*base[:-1], f"e{i}"])) for i in range(400, 460)]
    rows += [(100, "quite another text of some words"), (7, "quite another text of some words"), (100, None), (7, ""), (5, "one more text that stands alone here"), (5, "one more text that stands alone here"), (460, None), (460, " ".join(base))]
    draw.shuffle(rows)
    got = same(spark, rows, jaccard.Threshold())
    assert {r.component_id for r in got if r.doc_id == 300} == {300}


def test_rows_of_a_large_set():
    tokens = jaccard.np.arange(1, 6000, dtype=jaccard.np.uint64)
    some, every = (jaccard.signatures(tokens, jaccard.Threshold(90, 3, exact=x)) for x in (False, True))
    assert [len(x) for x in some] == [jaccard.PARTS] * 2
    assert [len(x) for x in every] == [jaccard.Threshold().parts(jaccard.Threshold().level(5999) - k) for k in (0, 1)]
    assert set(some[0].tolist()) <= set(every[0].tolist())


def test_a_very_long_text(spark):
    words = [f"w{i % 70000}_{i % 11}" for i in range(1_000_000)]
    other = [*words[:400_000], "edited", *words[400_001:]]
    rows = [(2, " ".join(words)), (1, " ".join(other)), (3, " ".join(words[:500_000]))]
    same(spark, rows, jaccard.Threshold())


@pytest.mark.parametrize(("links", "hot"), [(10**6, 1000), (5, 1000), (5, 6)])
def test_components_with_hot_nodes(spark, monkeypatch, links, hot):
    monkeypatch.setattr(components, "LINKS", links)
    monkeypatch.setattr(shared, "HOT", hot)
    draw = random.Random(links + hot)
    pairs = [(10**6, i) for i in range(0, 300)] + [(-7, i) for i in range(250, 500)] + [(i, i + 1) for i in range(600, 700)] + [(5000 - i, 5001 - i) for i in range(90)]
    pairs += [(draw.randrange(8000, 8400), draw.randrange(8000, 8400)) for _ in range(300)] + pairs[:40]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = [tuple(r) for r in components.connected_components(spark.createDataFrame(draw.sample(pairs, len(pairs)), "a bigint, b bigint")).collect()]
    assert sorted(got) == sorted({(x, root(x)) for a, b in pairs if a != b for x in (a, b)})
