"""License scans of long texts, ties and repeated rows."""

import random
import time

from annalist.llm import licenses


def plain_scan(text):
    """Containment in every window."""
    words, out = licenses.template_words(text or ""), {}
    gram = lambda w: {tuple(w[i : i + licenses.SHINGLE]) for i in range(len(w) - licenses.SHINGLE + 1)}
    for name, template in licenses.TEMPLATES:
        own = licenses.template_words(template)
        size, stride = licenses.layout(len(own))
        wanted = gram(own)
        found = [s for s in range(0, len(words), stride) if 100 * len(gram(words[s : s + size]) & wanted) >= licenses.CONTAINMENT * len(wanted)]
        if found:
            out[name] = (len(found), found[0])
    return out


def test_windows_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(licenses, "CHUNK", 17)
    draw = random.Random(4)
    filler = ["license", "the", "free", "x", "y", "z", "software", "work"]
    rows = []
    for i in range(60):
        parts = [" ".join(draw.choices(filler, k=draw.randrange(40)))]
        for _ in range(draw.randrange(4)):
            parts += [draw.choice(licenses.TEMPLATES)[1], " ".join(draw.choices(filler, k=draw.randrange(60)))]
        rows.append((i, " ".join(parts)))
    got = {(r.doc_id, r.license): (r.n_windows, r.first_word) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(i, name): found for i, text in rows for name, found in plain_scan(text).items()}
    assert len(got) > 30


def test_a_long_text_of_anchors(spark):
    text = "license permission granted software conditions " * 60_000 + licenses.TEMPLATES[6][1]
    rows = spark.createDataFrame([(1, text), (1, "Released under the MIT License."), (2, "Released under the MIT License.")], "doc_id bigint, text string").repartition(2)
    began = time.perf_counter()
    got = {(r.doc_id, r.license): r.n_windows for r in licenses.scan_licenses(rows).collect()}
    assert time.perf_counter() - began < 120
    assert got == {(1, "GPL-notice"): 1, (1, "MIT"): 1, (2, "MIT"): 1} or got == {(1, "GPL-notice"): 2, (1, "MIT"): 1, (2, "MIT"): 1}
