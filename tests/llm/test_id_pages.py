"""Pages of ids and the token store: what keeps their CPU seconds a GB down, with the same ids."""

import numpy as np
import pyarrow as pa
import pytest

from rosterlens.llm.range_coder import BLOCK_IDS, SLOTS, _Mixer, decode_page, encode_page
from rosterlens.llm.tokens import Encoder, vocabulary


def test_both_predictions_lie_side_by_side():
    rng = np.random.default_rng(3)
    mixer, none = _Mixer(50), np.zeros(50, np.int32)
    for _ in range(20):
        mixer.predict(50)
        first, second = mixer.kept[1:3]
        assert (first % SLOTS == 0).all() and ((second > first) & (second < first + SLOTS)).all()
        mixer.update(rng.integers(0, 50_000, 50).astype(np.int32), none, none)


@pytest.mark.parametrize("dtype", [np.uint16, np.int64])
def test_carries_wait_for_the_next_word(dtype):
    """One id nearly always, so intervals end high and carries run over several words."""
    rng = np.random.default_rng(5)
    for most in (0, 7, 65_535):
        ids = np.where(rng.random(40 * BLOCK_IDS + 3) < 0.999, most, rng.integers(0, 1 << 16, 40 * BLOCK_IDS + 3)).astype(dtype)
        back = decode_page(encode_page(ids))
        assert back.dtype == np.uint32 and (back == ids).all()


def test_plain_words_go_straight_to_the_model(monkeypatch):
    text = "Plain words here, and some more of them.\nNext line"
    mine = Encoder(vocabulary())
    wanted = mine.library.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(Encoder, "_new", lambda self, raw: [] if raw == b"\n" else pytest.fail(f"{raw} took the long way"))
    ids, _ = mine.encode(pa.array([text]))
    newline = mine.library.encode("\n", add_special_tokens=False).ids
    assert ids.tolist() == [i for i in wanted if i not in newline]
    monkeypatch.undo()
    odd = ["two  blanks", " . .. 'tis don't", "Ġ Ġa ħ", "é à ñandú, naïve.", "a b c d", "x1 2y _z", " ", "", "end ", "日本 語."]
    fresh = Encoder(vocabulary())
    ids, places = fresh.encode(pa.array(odd))
    assert [ids[a:b].tolist() for a, b in zip(places[:-1], places[1:], strict=True)] == [
        e.ids for e in fresh.library.encode_batch(odd, add_special_tokens=False)
    ]
