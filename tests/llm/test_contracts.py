"""Edges of the operators' contracts: small sources, letters, ties of spans, long texts, clashing names."""

import math
import random
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from annalist.llm import decontaminate, language, mixture, pii, quality, queries, tokens
from annalist.llm.learning import held_out
from annalist.llm.shared import names_aside


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", queries.ORACLES)
def test_oracle(spark, name, folder):
    sf = f"/root/testdata/{folder}"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    wanted = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, sf)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    assert {c: kinds[t] for c, t in got.dtypes} == dict(zip(wanted.columns, map(str, wanted.types), strict=True))
    order = sorted(wanted.columns)
    at = [wanted.columns.index(c) for c in order]
    assert sorted(repr(tuple(r[c] for c in order)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in wanted.fetchall())


def test_names_aside():
    assert names_aside(["a", "_n", "n", "__n"], ("n", "m")) == {"n": "___n"}


def test_clashing_names_stay(spark):
    rows = spark.createDataFrame([(1, "mail a@b.cd now", "x", "y", "z", "w")], "doc_id bigint, text string, redacted string, _redacted string, lang_pred string, n_hit string")
    assert pii.redact_documents(rows).collect() == [(1, "mail [EMAIL] now", "x", "y", "z", "w")]
    model = language.train(rows.withColumn("lang", language.F.lit("en")), language.F.lit(True))
    assert language.keep_identified(rows, model).collect() == rows.collect()
    benchmark = spark.createDataFrame([("1", "other words")], "item_id string, text string")
    assert decontaminate.remove_contaminated(rows, benchmark).collect() == rows.collect()


@pytest.mark.parametrize("sources", [{"a": 2, "b": 4000, "c": 4}, {"a": 1, "b": 1, None: 90000}, {"x": 0, "y": 7}])
def test_small_sources_get_their_targets(spark, sources):
    rows = []
    for source, n in sources.items():
        while n > 0:
            size = min(n, 1 + len(rows) * 37 % 900)
            rows.append((len(rows), "w " * size, source))
            n -= size
        rows.append((len(rows), None, source))
    got = mixture.mix_sources(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    target, taken = {}, defaultdict(int)
    for r in got:
        target[r.source] = r.target
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    for source, t in target.items():
        assert abs(taken[source] - t) <= max(1.0, 0.01 * t)


def test_letters_are_of_category_l():
    model = language.Model(["a"], np.zeros((1 << language.BUCKET_BITS, 1), np.float32), np.zeros(1, np.float32))
    texts = ["²", "½", "①", "Ⅷ", "12 _", None, "", "é", "日", "x²"]
    assert language.predict(model, texts)[0] == ["und"] * 7 + ["a"] * 3


def plain_language(model, text):
    """Naive Bayes, n-gram by n-gram."""
    points = [0x20 if c < 0x41 and c != 0 or 0x5A < c < 0x61 else c for c in map(ord, f" {text.lower()} ")]
    sums = [float(p) for p in model.prior]
    for n in language.ORDERS:
        for i in range(len(points) - n + 1):
            h = 0
            for j in range(n):
                h = (h * 0x01000193 + points[i + j] + j + 1) & 0xFFFFFFFF
            bucket = (h * 2654435761 & 0xFFFFFFFF) >> (32 - language.BUCKET_BITS)
            sums = [s + float(w) for s, w in zip(sums, model.weights[bucket], strict=True)]
    best = max(range(len(sums)), key=lambda k: (sums[k], -k))
    return model.languages[best], 1 / sum(math.exp(s - sums[best]) for s in sums)


def test_language_scorer_and_prior(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.train(docs, ~held_out(), rows=20)
    known = Counter(r.lang for r in docs.where(~held_out() & language.F.col("lang").isNotNull()).collect())
    assert np.allclose(np.exp(model.prior), [known[x] / sum(known.values()) for x in model.languages])
    texts = [r.text[: 50 * i] for i, r in enumerate(docs.orderBy("doc_id").limit(40).collect())] + ["É", "x", "\x00 7a"]
    wanted = [plain_language(model, t) if any(c.isalpha() for c in t) else ("und", 0.0) for t in texts]
    langs, scores = language.predict(model, texts)
    assert langs == [w for w, _ in wanted]
    assert np.allclose(scores, [s for _, s in wanted], rtol=0.02)


@pytest.mark.parametrize(("text", "written"), [("1.2.3.4@a.bc", "email:0:12,ip:0:7"), ("4111111111111111@x.yz", "email:0:21,card:0:16"), ("+12345678901@x.yz", "email:0:17,phone:0:12")])
def test_spans_that_start_together_go_by_kind(text, written):
    base, every = pii.find_spans(text)
    assert pii.written(base) == pii.written(every) == written


def test_personal_data_of_long_disguises_takes_linear_time():
    def seconds(n):
        text = "jane (at) example (dot) com, bob at mail dot example dot org and 1.2.3.4@a.bc " * n
        began = time.perf_counter()
        spans = pii.find_spans(text)[1]
        assert len(spans) == 4 * n
        return time.perf_counter() - began

    seconds(100)
    assert seconds(13000) < 60 * max(0.02, seconds(1300))


def test_quality_of_a_long_text():
    draw = random.Random(1)
    text = "\n".join(" ".join(f"w{draw.randrange(10**6)}" for _ in range(12)) for _ in range(100_000))
    began = time.perf_counter()
    n, repeats = quality.repeated_words(pa.array([text, None]))
    row = quality.judge(text, int(n[0]), int(repeats[0]), quality.Rules())
    assert time.perf_counter() - began < 30
    assert row[0] == 1_200_000 and row[8] and n[1] == 0


def test_added_columns_win(spark):
    names = ["score", "lang_pred", "kept", "clean_text", "n_tokens", "redacted", "all_spans", "items", "n_hit"]
    rows = spark.createDataFrame([(1, "some words of a text, mail a@b.cd", *names), (1, None, *names)], "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names))
    model = language.Model(["a"], np.zeros((1 << language.BUCKET_BITS, 1), np.float32), np.zeros(1, np.float32))
    benchmark = spark.createDataFrame([("1", "words of a text")], "item_id string, text string")
    made = {
        ("score", "lang_pred"): language.identify_language(rows, model),
        ("kept", "clean_text"): quality.judge_quality(rows),
        ("n_tokens",): tokens.count_tokens(rows),
        ("redacted", "all_spans"): pii.find_personal_data(rows),
        ("items", "n_hit"): decontaminate.find_contamination(rows, benchmark),
    }
    for added, got in made.items():
        assert len(got.columns) == len(set(got.columns)) and set(names) <= set(got.columns)
        for r in got.collect():
            assert all(r[n] != n for n in added) and all(r[n] == n for n in set(names) - set(added))


def test_very_long_texts_of_mixture_and_language(spark):
    rows = [(1, "ein langer text " * 500_000, "big"), (2, "kurz", "big"), (3, "tiny one", "small"), (4, None, "small")]
    got = {r.doc_id: r for r in mixture.mix_sources(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert got[1].size == 1_500_000 and got[1].taken > 1_000_000 and got[3].taken == 6 and got[4].taken == 0
    weights = np.random.default_rng(1).normal(size=(1 << language.BUCKET_BITS, 2)).astype(np.float32)
    model = language.Model(["a", "b"], weights, np.zeros(2, np.float32))
    langs, scores = language.predict(model, [rows[0][1], "x", None])
    once = language.predict(model, [rows[0][1][: 1 << 14]])[0]
    assert langs[0] == once[0] and 0.5 <= scores[0] <= 1 and langs[2] == "und"
