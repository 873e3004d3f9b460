"""The pipeline on nulls, ties, repeated and missing ids, long texts and further columns, against plain versions."""

import corpus_pipeline
import plain
import pytest
from annalist.llm import jaccard, language, pii
from annalist.llm.learning import held_out
from test_joins import check_mix, plain_components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def plain_pipeline(rows, items, model):
    """(doc_id, text, source) of what is left before mixing."""
    known = language.predict(model, [r[1] for r in rows])[0]
    left = [r for r, lang in zip(rows, known, strict=True) if lang != "und"]
    gone = {doc for nameless, doc, n, component in plain_components([r[:2] for r in left], jaccard.Threshold(80, 5)) if not nameless and n and component != doc}
    left = [r for r in left if r[0] not in gone]
    left = [r for r in left if not plain.scan(r[1], items)[1]]
    return [(r[0], pii.redact(r[1], pii.find_spans(r[1])[1]), r[3]) for r in left]


@pytest.fixture(scope="module")
def odd_folder(spark, sf, tmp_path_factory):
    some = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(120).collect()]
    text = "the quick brown fox jumps over the lazy dog and runs back home to its den "
    long = " ".join(f"word{i % 9000}x{i % 7}" for i in range(300_000))
    rows = some + [some[3], some[3], (None, some[5][1], None, None, None), (None, None, None, None, None)]
    rows += [(-1, None, "en", "s", 0), (-2, "", None, "s", 0), (-3, "123 !!", "de", None, 6), (-4, " \t\n", None, None, 3)]
    rows += [(-5, text * 3, "en", None, None), (-6, text * 3, "en", "z", 5), (-6, "another text of the same id, mail a (at) b (dot) com", None, "z", 5), (-7, long, "en", "z", len(long)), (-8, long + " and more", "en", "z", 1)]
    items = [(1, some[7][1][:200]), (2, None), (3, ""), (4, "short item")]
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_pipeline_of_odd_rows(spark, odd_folder):
    folder, rows, items = odd_folder
    model = language.train(spark.read.parquet(f"{folder}/documents.parquet"), ~held_out())
    wanted = plain_pipeline(rows, [(str(i), t) for i, t in items], model)
    got = corpus_pipeline.run(spark, folder).collect()
    order = lambda ids: sorted(ids, key=lambda i: (i is None, i or 0))
    assert order(r.doc_id for r in got) == order(r[0] for r in wanted) and len(got) < len(rows)
    target, taken = check_mix(wanted, got)
    assert all(abs(taken[s] - target[s]) <= max(1.0, 0.02 * target[s]) for s in target)


def test_stages_keep_further_columns(spark, odd_folder):
    folder, *_ = odd_folder
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    added = ["lang_pred", "score", "component_id", "n_shingles", "n_hit", "items", "redacted", "_redacted", "component", "a", "b", "doc", "_gone"]
    for c in added:
        docs = docs.withColumn(c, language.F.lit(f"own {c}"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *added]
    assert {tuple(r) for r in docs.select(*added).distinct().collect()} == {tuple(f"own {c}" for c in added)}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()
