"""Texts of pieces alone take no fallback, and get the ids that the general way gives."""

import random

from airflux.llm import pieces


def test_no_fallback_where_every_character_is_a_piece(monkeypatch):
    model = pieces.PieceModel([("a", -1.0, 1), ("b", -1.5, 2), ("ab", -2.5, 3), ("aba", -2.2, 4), ("bb", -3.0, 5)], {k: 100 + k for k in range(256)})
    rng, seen = random.Random(1), []
    texts = ["".join(rng.choices("ab", k=n)) for n in range(1, 40)] + ["abc", "cab", ""]
    alone = pieces.PieceModel._of_pieces
    monkeypatch.setattr(pieces.PieceModel, "_of_pieces", lambda self, text: seen.append(text) or alone(self, text))
    got = [model.segment(t) for t in texts]
    assert [t for t in texts if "c" not in t] == seen
    model.single = _Never(model.single)
    assert [model.segment(t) for t in texts] == got


class _Never(set):
    def issuperset(self, _):
        return False
