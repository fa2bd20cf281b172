"""Marks at the end of a word are encoded once, whatever word they follow."""

import random

import pyarrow as pa
import pytest

from tidemark.llm import tokens

PIECES = ["a", "É", "1", "ſ", "木", "é", "'", "'s", "'ll", " ", "\n", "\x01", *"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", "&&&", "<|endoftext|>", "̸", "–"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_marked_words_have_the_ids_of_the_whole_text(name):
    rng = random.Random(41)
    texts = [" ".join("".join(rng.choice(PIECES) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    e = tokens.Encoder(tokens.tokenizer_path(name))
    ids, edges = e.encode(pa.array(texts), 0)
    whole = e.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(edges.tolist(), edges.tolist()[1:], strict=False)] == [w.ids + [0] for w in whole]


def test_words_before_different_marks_are_one_piece():
    e = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    e.encode(pa.array([" ".join(f"word{m}" for m in ("", ".", "&&&", "###", ",%%%", "_)", "***"))]), 0)
    assert sum("word" in p for p in e.known.to_pylist()) == 2  # the text's first without a space


def test_kept_pieces_are_bounded():
    e = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json"), 500)
    for k in range(4):
        e.encode(pa.array([" ".join(f"x{i}" for i in range(k * 300, k * 300 + 300))]), 0)
        assert len(e.known) <= 500
