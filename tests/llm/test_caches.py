"""What tasks remember is bounded by bytes; forgetting it changes no result."""

import base64

import numpy as np
import pytest

from airflux.llm import langid, packing
from airflux.llm import pieces as pieces_of
from airflux.llm.queries import tokenizer_path

#: Texts with and without blanks: lines of the second kind are single strings.
TEXTS = ["a few words of plain text " * 40, "".join(map(chr, range(0x4E00, 0x4E00 + 900))), "", "ก็ไม่มีช่องว่าง" * 60, "x" * 5000, "one more plain text\n\n"]


def pieces(text):
    """Distinct strings, as the callers give them."""
    return list(dict.fromkeys(text[k : k + 50].encode() for k in range(0, len(text), 50)))


@pytest.mark.parametrize("kind", ["bpe", "rank"])
def test_encoder_forgets_by_bytes(kind):
    make = {"bpe": lambda: packing.bpe_encoder.__wrapped__(tokenizer_path("byte_bpe_50k.json")), "rank": lambda: packing.rank_encoder.__wrapped__(tokenizer_path("byte_bpe_50k.tiktoken"))}[kind]
    free, tight = make(), make()
    tight.most_bytes, largest = 1000, 0
    for text in TEXTS * 3:
        given = pieces(text)
        ids = []
        for encoder in (free, tight):
            start, length = encoder(given)
            ids.append([encoder.pool[a : a + n].tolist() for a, n in zip(start, length)])
        assert ids[0] == ids[1]
        assert tight.held == sum(map(len, tight.number))
        largest = max(largest, len(text.encode()))
        assert tight.held <= 1000 + largest
    assert free.held > 2 * 1000 and len(free.number) >= len(tight.number)


def test_word_scores_forget_by_bytes(spark):
    docs = spark.createDataFrame([(k, t, lang) for k in range(40) for t, lang in (("the cat sat on the mat", "en"), ("der hund und die katze", "de"))], "doc_id long, text string, lang string")
    model = langid.train(docs)
    free, tight = langid.WordScores(model), langid.WordScores(model, most_bytes=500)
    for text in TEXTS * 2:
        got = []
        for words in (free, tight):
            start, count = words(pieces(text))
            got.append([(words.scores[a : a + n].tolist(), words.letters[a : a + n].tolist()) for a, n in zip(start, count)])
        assert got[0] == got[1]
    assert tight.held < free.held


def test_ids_of_sixteen_bits_need_a_vocabulary_that_fits(spark, tmp_path):
    tokens = [bytes([a]) for a in range(256)] + [bytes(p) for p in np.stack(np.divmod(np.arange(65536), 256), 1).astype(np.uint8)]
    path = tmp_path / "wide.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate(tokens)))
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(Exception, match="65536"):
        packing.packed_matrices(docs, str(path)).count()


def test_languages_are_bounded_and_passed_on(spark, monkeypatch):
    rows = [(k, f"word{k % 7} some text of {lang}", lang) for k in range(60) for lang in ("a", "b", "c", "d", "e")]
    docs = spark.createDataFrame([*rows, (1, None, "f"), (2, "x", None)], "doc_id long, text string, lang string")
    whole = langid.train(docs)
    assert whole.langs == ["a", "b", "c", "d", "e"] and langid.train(docs.limit(0)).langs == []
    monkeypatch.setattr(langid, "HELD_LANGUAGES", 2)
    parted = langid.train(docs)
    assert parted.langs == whole.langs and (parted.logp == whole.logp).all() and (parted.allowed == whole.allowed).all()
    with pytest.raises(ValueError, match="languages"):
        langid.train(docs, most_languages=4)


def test_long_stretches_are_segmented_as_short_ones(monkeypatch):
    model = pieces_of.PieceModel([("a", -1.0, 1), ("ab", -1.5, 2), ("ba", -1.2, 3), ("aba", -1.9, 4), ("c", -0.5, 5)], {k: 100 + k for k in range(256)})
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abcdé"), 9000))
    long = model.segment(text)
    monkeypatch.setattr(pieces_of, "LONG", 10**9)
    assert model.segment(text) == long and model.segment("") == [] and len(long) > 4000
