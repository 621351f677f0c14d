"""The encoder against whole-text encoding, with and without room to remember pieces."""

import random

import numpy as np
import pytest

from dpframe.llm.tokens import END_ID, WordEncoder, stops_apart


@pytest.mark.parametrize("room", [600_000, 50, 0])
def test_ids_do_not_depend_on_remembered_pieces(room):
    rng = random.Random(3)
    texts = ["", ".", "a.", ". a", "One, two; three. Four"]
    texts += ["".join(rng.choice("aZ9,.;:!? \n\té中́<|") for _ in range(rng.randrange(14))) for _ in range(600)]
    enc = WordEncoder(max_pieces=room)
    for at in range(0, len(texts), 100):
        part = texts[at:at + 100]
        got = [np.frombuffer(b, "<u4").tolist() for b in enc.encode(part)]
        assert got == [e.ids + [END_ID] for e in enc.tok.encode_batch_fast(part, add_special_tokens=False)]
        assert len(enc.known) <= room


def test_only_closing_stops_are_set_apart():
    assert stops_apart(b"One, two.three a. .b c!! d;") == b"One , two.three a . .b c!! d ;"
    assert stops_apart(b".") == b"."
