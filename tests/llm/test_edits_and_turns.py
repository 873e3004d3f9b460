"""Token trees under long runs of edits, chats of very long turns."""

import random
import time

import pytest

import plain_chat
from annalist.llm import chat, queries, tokens, vocabulary


@pytest.fixture(scope="module")
def encoder():
    return vocabulary.ranks_encoder(open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb").read())


def test_counts_of_encoded_pieces_survive_an_empty_text(encoder):
    tree = tokens.DocumentTree("one two", tokens.Counter(encoder.encode_ordinary))
    tree.apply(0, 7, "")
    assert (tree.n_tokens, tree.reencoded) == (0, 0)
    tree.apply(0, 0, "three four")
    assert tree.reencoded == 2
    tree.apply(0, 5, "x")
    assert (tree.text(), tree.reencoded) == ("x four", 4)
    blank = tokens.DocumentTree("", tokens.Counter(encoder.encode_ordinary))
    assert (blank.n_tokens, blank.n_chars, blank.n_pieces) == (0, 0, 0)
    blank.apply(3, 1, "new text")
    assert blank.text() == "new text" and blank.n_tokens == 2


def test_many_edits_keep_the_sums(encoder):
    draw = random.Random(8)
    now = " ".join(f"word{i}" for i in range(4000))
    tree = tokens.DocumentTree(now, tokens.Counter(encoder.encode_ordinary))
    for _ in range(400):
        a = draw.randrange(len(now) + 1)
        b = min(len(now), a + draw.choice([0, 0, 3, 40, 900]))
        new = draw.choice(["", " x", "'s ", " a longer insertion " * draw.randrange(60)])
        now = now[:a] + new + now[b:]
        tree.apply(a, b, new)
    assert tree.text() == now and tree.n_chars == len(now) and tree.n_tokens == len(encoder.encode_ordinary(now))
    assert tree.n_pieces == len(tokens._cut.findall(now))


def test_an_edit_over_many_leaves_is_local(encoder, monkeypatch):
    text = "plain words " * 200_000
    tree = tokens.DocumentTree(text, tokens.Counter(encoder.encode_ordinary))
    monkeypatch.setattr(tree, "_grow", lambda: pytest.fail("all sums were built anew"))
    began = time.perf_counter()
    for k in range(50):
        tree.apply(40_000 * k, 40_000 * k + 3000, " other")
    assert time.perf_counter() - began < 5
    assert tree.n_chars == len(text) - 50 * (3000 - 6) and tree.reencoded < 50 * 20


def test_counter_forgets_the_oldest(monkeypatch):
    monkeypatch.setattr(tokens, "_MEMORY", 8)
    asked = []
    counter = tokens.Counter(lambda p: asked.append(p) or [0])
    for k in range(30):
        assert counter.many(["kept", f"p{k}"]) == [1, 1]
    assert asked.count("kept") == 1 and len(counter.known) + len(counter.older) <= 12


def test_a_very_long_turn(spark):
    rows = [(1, 0, "user", "a <|end|> b " * 150_000), (1, 1, "assistant", "c\n" * 400_000), (1, 2, "assistant", None), (2, 0, None, "alone")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in queries.read_back(chat.format_conversations(frame)).collect()}
    for conv in (1, 2):
        turns = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        assert (got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == plain_chat.digests(turns)
        assert got[conv].n_turns == len(turns)
    segments = chat.format_conversations(frame).where("conv_id = 1").select("segment", "n_turns").collect()
    assert sum(r.n_turns for r in segments) == 3 and len(segments) > 1
