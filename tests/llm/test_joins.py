"""Operators on several documents at once against brute force."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
import plain
from annalist.llm import components, jaccard, language, licenses, mixture, pii, queries, tokens, vocabulary
from annalist.llm.learning import held_out


def fold(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_components(rows, t):
    """doc -> (sizes of its sets, least doc reachable), all pairs compared through an index of shingles."""
    sets, up = [], {}
    for doc, text in rows:
        w = fold(text)
        s = {tuple(w[i : i + t.words]) for i in range(len(w) - t.words + 1)} if len(w) >= t.words else {tuple(w)} if w else set()
        sets.append((doc, s))
        up.setdefault(doc, doc)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    index = defaultdict(list)
    for i, (doc, s) in enumerate(sets):
        common = Counter(j for x in s for j in index[x])
        for x in s:
            index[x].append(i)
        for j, n in common.items():
            if doc is not None and sets[j][0] is not None and 100 * n >= t.percent * (len(s) + len(sets[j][1]) - n):
                a, b = root(doc), root(sets[j][0])
                up[max(a, b)] = min(a, b)
    return sorted((doc is None, doc or 0, len(s), root(doc) if doc is not None else None) for doc, s in sets)


def family(draw, n, words, changes):
    base = [f"w{draw.randrange(5000)}" for _ in range(words)]
    for _ in range(n):
        w = list(base)
        for _ in range(draw.randrange(changes + 1)):
            w[draw.randrange(len(w))] = f"x{draw.randrange(10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize("t", [jaccard.Threshold(90, 3), jaccard.Threshold(80, 5)])
def test_jaccard_brute_force(spark, t, monkeypatch):
    draw = random.Random(t.percent)
    texts = [None, "", " ", "One", "one", "one two", "ONE two ", "one two three", "a b c d", "a b c d e f g h i j k", "a b c d e f g h i j"]
    for words in (6, 9, 12, 20, 35, 80, 300):
        texts += family(draw, 25, words, max(2, words // 20))
    texts += family(draw, 300, 90, 3)  # more than one group
    texts += ["same text of a copy in a hot group"] * 60
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [f"{' '.join(f'q{draw.randrange(10**5)}' for _ in range(60))} {passage}" for _ in range(40)]
    rows = [(draw.randrange(10**9), x) for x in texts]
    rows += [(rows[30][0], rows[60][1]), (None, texts[20]), (None, None), rows[40]]
    draw.shuffle(rows)
    monkeypatch.setattr(jaccard, "GROUP", 64)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), t).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in got) == plain_components(rows, t)


@pytest.mark.parametrize("t", [jaccard.Threshold(90, 3), jaccard.Threshold(80, 5)])
def test_jaccard_few_among_many(spark, t):
    """A row's first members and neighbours are of sizes that exclude a link with the few shorter ones."""
    draw = random.Random(7)
    own = iter(range(10**6))
    rows = []
    for words, more, most in ((100, 6, 14), (100, 20, 30), (10, 1, 2)):
        base = [f"b{next(own)}" for _ in range(words + t.words - 1)]
        grown = lambda n, base=base: " ".join(base + [f"o{next(own)}" for _ in range(n)])
        texts = [grown(most) for _ in range(998)]
        texts[300:300], texts[700:700] = [grown(0)], [grown(more)]
        rows += [(len(rows) + i, x) for i, x in enumerate(texts)]
    got = jaccard.jaccard_components(spark.createDataFrame(draw.sample(rows, len(rows)), "doc_id bigint, text string"), t).collect()
    assert sorted((False, r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components(rows, t)


def test_jaccard_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op2_jaccard_join(spark, sf).collect()
    assert sorted((False, r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components(rows, jaccard.Threshold())


def test_jaccard_empty_and_one_of_each(spark):
    schema = "doc_id bigint, text string, n bigint"
    assert jaccard.jaccard_components(spark.createDataFrame([], schema)).count() == 0
    rows = [(5, "a b c d e f", 1), (3, "a b c d e F", 2), (None, "a b c d e f", 3), (9, None, 4), (8, "", 5), (7, "other words in this one here", 6)]
    assert sorted(r.n for r in jaccard.one_of_each(spark.createDataFrame(rows, schema)).collect()) == [2, 3, 4, 5, 6]


def test_components(spark):
    draw = random.Random(2)
    links = [(i, i + 1) for i in range(300)] + [(1000 + draw.randrange(400), 1000 + draw.randrange(400)) for _ in range(250)] + [(5000, 5000 + i) for i in range(1, 200)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for a, b in links if a != b for x in (a, b)}


def test_levels():
    for t in (jaccard.Threshold(90, 3), jaccard.Threshold(80, 5)):
        for n in range(1, 600):
            level = t.level(n)
            assert t.begins(level) <= n < t.begins(level + 1)
            most = 100 * n // t.percent  # the largest set that links with one of n
            assert t.level(most) <= level + 1
            assert max(n + m - 2 * c for m in range(n, most + 1) for c in [-(-t.percent * (n + m) // (100 + t.percent))] if c <= n) < t.parts(level)


def test_licenses(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
        wanted = sorted(con.sql(licenses.oracle_sql()).fetchall())
        assert sorted(map(tuple, queries.op1_license_scan(spark, sf).collect())) == wanted
    assert wanted


def test_licenses_edges(spark):
    long = licenses.TEMPLATES[8][1].split()
    near = " ".join(long[:10] + ["indeed"] + long[10:])  # four of its shingles are broken
    rows = [(1, None), (2, ""), (3, "the license of"), (4, "x " * 700 + "RELEASED under the mit license! " + "y " * 9), (None, f"{near} and more"), (5, " ".join(long[: len(long) // 2])), (4, "Licensed under CC BY-NC 4.0.")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(((r.doc_id or 0), r.license) for r in licenses.scan_licenses(frame).collect()) == [(0, "MIT-grant"), (4, "CC-BY-NC-4.0"), (4, "MIT")]
    assert licenses.scan_licenses(frame.limit(0)).count() == 0
    for name, text in licenses.TEMPLATES:
        assert any(a in licenses.template_words(text) for a in licenses.anchors([(name, text)]))


def plain_targets(sizes, most=3):
    weights = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    open_, target, left = set(sizes), {}, float(sum(sizes.values()))
    while open_:
        rate = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if rate * weights[s] > most * sizes[s]}
        if not full:
            return target | {s: rate * weights[s] for s in open_}
        target |= {s: float(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return target


def check_mix(rows, got):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    target, taken = plain_targets(sizes), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    return target, taken


def test_mixture(spark, sf):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mixed = lambda: sorted(map(tuple, mixture.mix_sources(frame).collect()), key=repr)
    first = mixed()
    assert first == mixed() and len(first) == len(rows)
    target, taken = check_mix(rows, mixture.mix_sources(frame).collect())
    assert all(abs(taken[s] - target[s]) <= mixture.BLOCK_TOKENS * 1.5 for s in target)


def test_mixture_edges(spark):
    draw = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(draw.randrange(40))), draw.choice(["b", "é", "z", "Z", None])) for i in range(300)]
    rows += [(None, "x\ty\x0bz ", "b"), (1, None, "none"), (2, "", "none"), (3, "tiny one", "small"), (3, "tiny one", "small")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    target, taken = check_mix(rows, mixture.mix_sources(frame, block_tokens=8, shard_tokens=100).collect())
    assert all(abs(taken[s] - target[s]) <= 8 * 30 for s in target)
    assert mixture.mix_sources(frame.limit(0)).count() == 0


def test_apportionment(spark):
    draw = random.Random(4)
    for n, seats in ((1, 5), (7, 3), (9, 100), (40, 1000)):
        shares = [(f"p{i:02}", draw.random() ** 3) for i in range(n)] + [("zero", 0.0)]
        wanted = Counter(p for _, p in sorted(((-x / (2 * k + 1), p) for p, x in shares if x for k in range(seats)))[:seats])
        frame = spark.createDataFrame(shares, "p string, x double")
        got = mixture.apportion(frame, "x", mixture.F.lit(seats), [], ["p"], "seats").collect()
        assert {r.p: r.seats for r in got if r.seats} == wanted


def test_token_tree():
    encoder = vocabulary.ranks_encoder(open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb").read())
    counter, draw = tokens.Counter(encoder.encode_ordinary), random.Random(6)
    pieces = ["a", "b", "'l", "'", "ll", " ", "  ", "\n", "3", ".", "é", "re", "'ve", "日", "word ", " the"]
    text = lambda n: "".join(draw.choice(pieces) for _ in range(n))
    for _ in range(800):
        now = text(draw.choice([0, 3, 20, 200, 900]))
        tree = tokens.DocumentTree(now, counter)
        for _ in range(draw.randint(1, 4)):
            start = draw.randint(0, len(now))
            stop, new = min(len(now), start + draw.choice([0, 1, 2, 5, 50])), text(draw.choice([0, 1, 2, 8, 60]))
            now = now[:start] + new + now[stop:]
            tree.apply(start, stop, new)
            assert tree.text() == now and tree.n_tokens == len(encoder.encode_ordinary(now)) and tree.n_chars == len(now)


def test_token_counts(spark, sf):
    encoder = vocabulary.ranks_encoder(open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb").read())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op4_token_counts(spark, sf).collect():
        text = texts[r.doc_id]
        assert r.n_tokens == len(encoder.encode_ordinary(text))
        for start, stop, new in queries.sample_edits(text):
            text = text[:start] + new + text[stop:]
        assert (r.n_tokens_edited, r.n_chars_edited) == (len(encoder.encode_ordinary(text)), len(text))
        assert r.n_reencoded < 80 or r.n_pieces < 200
    frame = spark.createDataFrame([(1, None), (2, "")], "n_tokens bigint, text string")
    assert [r.n_tokens for r in tokens.count_tokens(frame).collect()] == [0, 0]


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = language.train(docs, ~held_out())
    left = [i for i, p in zip(rows, language.predict(model, [r.text for r in rows.values()])[0], strict=True) if p != "und"]
    found = {d: c for _, d, n, c in plain_components([(i, rows[i].text) for i in left], jaccard.Threshold(80, 5)) if n}
    left = [i for i in left if found.get(i, i) == i]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = [i for i in left if not plain.scan(rows[i].text, items)[1]]
    final = [(i, pii.redact(rows[i].text, pii.find_spans(rows[i].text)[1]), rows[i].source) for i in left]
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == set(left) and len(left) < len(rows)
    check_mix(final, got)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_empty_tables(spark, sf, tmp_path):
    for name in ("documents", "labels", "benchmark", "conversations"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == (1 if name == "op6_chat_format" else 0), name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
