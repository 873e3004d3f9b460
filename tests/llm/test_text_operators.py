"""Digest queries and their operators against plain versions written from the contracts."""

import collections
import hashlib
import re

import plain
import pytest

from annalist.llm import chat, decontaminate, language, learning, pii, quality, queries, toxicity
from annalist.llm.learning import held_out

ODD = [
    (1, None, "en", "s"),
    (2, "", None, None),
    (3, " \t\n ", "en", "s"),
    (4, "x", "de", None),
    (4, "x", "de", None),
    (None, "two words", None, "s"),
    (5, "long " * 30000 + "tail", "en", "t"),
    (6, "Wörter über \x85 Straßen\n\nWörter über \x85 Straßen\na | b\n", "de", "t"),
    (7, "one two one two one two one two", "en", "s"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def plain_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    twice = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            duplicates += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), duplicates, len(twice), len(w) < 50 or 100 * len(twice) > 50 * len(w)


def test_quality_base(spark, sf, docs):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in queries.op10_quality_rules(spark, sf).collect()}
    assert got == {i: plain_quality(t) for i, t in docs.items()}


def test_quality_odd_rows(odd):
    rows = quality.judge_quality(odd).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_quality(r.text)
    assert quality.judge_quality(odd.limit(0)).count() == 0


def test_quality_lines_first():
    good = "plain words of a line that says something useful to its readers " * 6
    rules = quality.Rules()
    bad = ["Home | About | News | Contact", "Click here to log in", "#### $$$$ %%%% &&&&", "WOW!! SUCH!! DEAL!!"]
    assert [quality.bad_line(x, len(x.split()), rules) for x in bad] == ["navigation", "boilerplate", "symbols", "shout"]
    assert quality.bad_line(good, len(good.split()), rules) == ""
    mixed = "\n".join([good, *bad])
    assert quality.judge(mixed, len(mixed.split()), 0, rules)[8]
    assert not quality.judge("\n".join(["*** " * 60, "few good words"]), 63, 0, rules)[8]


def plain_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


TRICKY = [
    "a@b.c@d.e", "a@b.c._x@d.e.f-", "@a.b", "a@b", "a@.b", "x..y%@q.w.", "1.2.3.4.5.6.7.8", "1.2.3.4.5", "256.1.1.1", "00001.2.3.255", "1.2.3", "4111 1111-1111 1111", "4111  1111 1111 1111",
    "+1 (212) 555-0100", "++12345678901", "+1 2", "+1 234 567 890 123 456 7", "é+49 (30) 1234567é", "4111111111111111.4111111111111111", "12-34 +1-23456789", "１２", "me@host.example.com,1.1.1.1 +12025550100",
]


@pytest.mark.parametrize("text", TRICKY)
def test_base_spans(text):
    assert pii.written(pii.detect(text)) == plain_spans(text)


def test_base_spans_random():
    import random

    draw = random.Random(3)
    for _ in range(4000):
        text = "".join(draw.choice("ab1.12@@+--.  (3)é_") for _ in range(draw.randint(0, 60)))
        assert pii.written(pii.detect(text)) == plain_spans(text), text


@pytest.mark.parametrize(
    ("text", "kind", "piece"),
    [
        ("write to jane.doe (at) example (dot) com today", "email", "jane.doe (at) example (dot) com"),
        ("write to jane [at] mail.example.org today", "email", "jane [at] mail.example.org"),
        ("jane at example dot com", "email", "jane at example dot com"),
        ("write to jane@example dot com today", "email", "jane@example dot com"),
        ("mail аlice@exаmple.com now", "email", "аlice@exаmple.com"),
        ("from １０.0.0.7 it came", "ip", "１０.0.0.7"),
        ("call plus one two one two five five five zero one zero zero please", "phone", "plus one two one two five five five zero one zero zero"),
        ("card four one one one 1111 1111 1111", None, None),
        ("call +1 (212) 5​55-0100", "phone", "+1 (212) 5​55-0100"),
    ],
)
def test_disguises(text, kind, piece):
    base, every = pii.find_spans(text)
    assert set(base) <= set(every)
    if kind:
        assert (pii.KINDS.index(kind), piece) in [(k, text[s:e]) for s, e, k in every]
        assert piece not in pii.redact(text, every)


@pytest.mark.parametrize("address", ["jаne@example.com", "jane@mail.exаmple.com"])
def test_disguise_beside_a_base_span(address):
    base, every = pii.find_spans(f"to {address}, please")
    assert len(base) == 1 and base[0][:2] != (3, 3 + len(address))
    assert base[0] in every and (3, 3 + len(address), 0) in every
    assert pii.redact(f"to {address}, please", every) == "to [EMAIL], please"


@pytest.mark.parametrize(
    ("piece", "kind"),
    [
        ("jane at example dot dev", "email"),
        ("jane at example.com", "email"),
        ("jane.doe at example.zone", "email"),
        ("jane dot doe at example dot com", "email"),
        ("jane dot m dot doe@example.com", "email"),
        ("one nine two dot one six eight dot one dot one", "ip"),
        ("one nine two dot 168 dot 1 dot one", "ip"),
    ],
)
def test_spelled_addresses(piece, kind):
    for text in (piece, f"Contact: {piece}, or wait"):
        every = pii.find_spans(text)[1]
        assert (pii.KINDS.index(kind), piece) in [(k, text[s:e]) for s, e, k in every]
        assert pii.redact(text, every) == text.replace(piece, f"[{kind.upper()}]")


def test_prose_has_no_spelled_addresses():
    for text in ("look at the dot matrix printer", "stared at one dot on the wall", "they arrived at noon.Then she left", "John works at example.com", "look at www.example.com", "one dot two dot three"):
        assert pii.find_spans(text) == ([], [])
    assert pii.find_spans("jane@example.com dot matrix")[1] == [(0, 16, 0)]


def test_clean_text_has_no_spans():
    for text in ("one day at home", "meet at noon dot dot dot", "version 2.0 of 4 things", "un deux trois à la six"):
        assert pii.find_spans(text) == ([], [])


def test_personal_data_query(spark, sf, docs, odd):
    for r in queries.op9_personal_data(spark, sf).collect():
        plain = plain_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(plain.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [plain.count(f"{k}:") for k in pii.KINDS]
        assert set(filter(None, plain.split(","))) <= set(r.spans.split(","))
    assert pii.redact_documents(odd).columns == odd.columns
    assert sorted(map(repr, pii.redact_documents(odd).collect())) == sorted(map(repr, odd.collect()))


def test_decontamination_query(spark, sf, docs):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for r in queries.op3_decontamination(spark, sf).collect():
        n, hit, names, digest = plain.scan(docs[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(names), digest, hit > 0)


def test_decontamination_random(spark):
    import random

    draw = random.Random(5)
    text = lambda n: " ".join(draw.choice("A b c, d É.") for _ in range(n))
    items = [(str(i), text(draw.choice([0, 1, 3, 4, 10, 14, 25]))) for i in range(30)] + [("x", None), ("7", "b b b")]
    rows = [(i, text(draw.choice([0, 1, 5, 40]))) for i in range(120)] + [(None, None), (3, items[5][1])]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_hit", decontaminate.F.lit("clash"))
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    for chars in (1 << 20, 40):
        got = decontaminate.find_contamination(documents, benchmark, window=4, block_chars=chars).collect()
        assert len(got) == len(rows)
        for r in got:
            n, hit, names, _ = plain.scan(r.text, items, 4)
            assert (r.n_words, r.n_hit, r["items"]) == (n, hit, names)
            theirs = {i: plain.scan(t, [], 4)[0] for i, t in items}
            for m in r.matches:
                assert m.length >= min(4, theirs[m.item_id] if m.item_id != "7" else 3)
    assert decontaminate.find_contamination(documents, benchmark.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.remove_contaminated(documents.limit(0), benchmark).columns == documents.columns
    assert {r.n_hit for r in decontaminate.remove_contaminated(documents, benchmark, window=4).collect()} == {"clash"}


def test_decontamination_holds_one_block(spark, monkeypatch):
    import gc

    import pyarrow as pa

    documents = spark.createDataFrame([], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(str(i), f"w{i} x y z") for i in range(40)], "item_id string, text string")
    captured, live, plain_hits = [], [], decontaminate.hits_of
    monkeypatch.setattr(type(documents), "mapInArrow", lambda self, f, schema: captured.append(f))
    decontaminate.find_contamination(documents, benchmark, window=4, block_chars=80)

    def watched(found, tests):
        live.append(sum(isinstance(x, decontaminate.TestSuffixes) for x in gc.get_objects()))
        return plain_hits(found, tests)

    monkeypatch.setattr(decontaminate, "hits_of", watched)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a w3 x y z b", "w39 x y z w0 x y z"]})
    rows = [r for out in captured[0](iter([batch])) for r in out.to_pylist()]
    assert [(r["n_hit"], r["items"]) for r in rows] == [(4, ["3"]), (8, ["0", "39"])]
    assert len(live) > 3 and max(live) == 1


def test_language(spark, sf, docs, odd):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op8_language_id(spark, sf).collect()
    assert len(got) == len(docs)
    right = [r.lang_pred == langs[r.doc_id] for r in got if r.held_out]
    assert sum(right) >= 0.98 * len(right)
    assert all(0 <= r.score <= 1 for r in got)
    model = language.train(spark.read.parquet(f"{sf}/documents.parquet"), ~held_out())
    rows = {r.text: (r.lang_pred, r.score) for r in language.identify_language(odd, model).collect()}
    assert rows[None] == rows[""] == rows[" \t\n "] == ("und", 0.0)
    assert rows["x"][0] in model.languages
    kept = language.keep_identified(odd.withColumn("score", language.F.lit("clash")), model)
    assert kept.count() == len(ODD) - 3 and kept.columns[-1] == "score"
    assert set(language.identify_language(odd, language.Model([], model.weights[:, :0], model.prior[:0])).select("lang_pred").distinct().collect()[0]) == {"und"}


def test_too_many_labels_raise(spark):
    rows = spark.range(learning.MAX_LABELS).selectExpr("id", "cast(id as string) lang")
    assert learning.bounded_sample(rows.unionByName(spark.createDataFrame([(-1, None)], "id bigint, lang string")), "lang", "id").where("lang IN ('0', '1023')").count() == 2
    with pytest.raises(ValueError, match="lang"):
        learning.bounded_sample(rows.unionByName(spark.createDataFrame([(-2, "rare")], "id bigint, lang string")), "lang", "id")


def test_toxicity(spark, odd):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op5_toxicity(spark, sf).collect()
    known = [(r.predicted, labels[r.doc_id], r.score) for r in got if r.held_out and r.doc_id in labels]
    assert len(known) > 500 and sum(p == t for p, t, _ in known) >= 0.97 * len(known)
    toxic, clean = ([s for _, t, s in known if t == x] for x in (1, 0))
    assert sum((a > b) + (a == b) / 2 for a in toxic for b in clean) >= 0.95 * len(toxic) * len(clean)
    rows = toxicity.score_toxicity(odd, toxicity.Grammar()).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)


def test_toxic_clauses():
    import pyarrow as pa

    g = toxicity.Grammar()
    heavy, negated, reported, aimless = toxicity.features(pa.array(["You are an idiot.", "You are not an idiot.", "He said you are an idiot.", "They kill time. Die Sonne scheint."]), g)[:, 0]
    assert heavy > reported > negated == 0
    assert aimless < heavy


def plain_chat(turns):
    learned = "".join(t for r, t in turns if r == "assistant")
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()


def test_chat(spark, sf):
    by = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        by[r.conv_id].append((r.role, r.text or ""))
    by[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in queries.op6_chat_format(spark, sf).collect()}
    assert got.keys() == by.keys()
    for i, turns in by.items():
        assert (got[i].turns_sha256, got[i].loss_chars, got[i].loss_sha256) == plain_chat(turns)
        assert got[i].n_turns == len(turns)


def test_chat_hostile(spark, monkeypatch):
    texts = ["<|end|>", "<\\|turn|>x<\\\\|text|>", " lead", "trail ", "\n\n", "日本\U0001f600", "", None, "<|endoftext|>", "<", "|>", "<\\", "<" * 50 + "|"]
    rows = [(1, i, "assistant" if i % 2 else "user<|text|>", t) for i, t in enumerate(texts * 2)] + [(None, None, None, None), (2, 1, "assistant", "tie"), (2, 1, "assistant", "tie")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in queries.read_back(chat.format_conversations(frame)).collect()}
    turns = [(r, t or "") for _, _, r, t in rows[: 2 * len(texts)]]
    assert (got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == plain_chat(turns)
    assert got[None].n_turns == 1 and got[2].n_turns == 2 and got[2].loss_chars == 6
    assert chat.format_conversations(frame.limit(0)).count() == 0
    encoder = chat.tokenizer(open("/opt/tokenizers/byte_bpe_50k.json", "rb").read())
    whole = chat.encode(*chat.render(turns), encoder)[0].tolist()
    assert whole == [i for t in turns for i in chat.encode(*chat.render([t]), encoder)[0].tolist()]
