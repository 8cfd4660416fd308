"""Language labels of spans and documents (operator 10).

Words are cut at every white space and where the script changes, so each has one script.  A word's
score in a language is half the log-likelihood of its character n-grams (orders 1-3, word ends
marked, hashed to ``BUCKETS``).  The script of the word narrows the candidates to the
languages that were learned with that script; a script that no language was learned with is no
evidence.  Viterbi over the words with a penalty for each switch labels spans; the document's
language is the one with most letters, and its score the share of letters that carry its label.

Learning: n-grams of a sample of at most ``sample`` documents of each language (a bound, documented
here) with text and lang whose crc32(doc_id as text) mod 4 is not 2, in the order of a hash of
doc_id, so a rare language is learned as well.  Only text and lang are used.  The counts that reach the driver are at most BUCKETS a language.

Prediction: tasks keep the scores of distinct words and run Viterbi for all documents of a slice
at once, step t being the t-th word of each.

Edge cases: null texts and texts without a letter are ``und`` with score 0 and no spans; with no
labelled document everything is ``und``; ties go to the language first in the alphabet; repeated
rows get equal results; texts of any length are read whole; null doc_id is not held out and not
learned from; an empty table gives an empty result; other columns, whatever their names, are not
read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import buffer_of, distinct_pieces, given_back, ranges, slices, space_cuts, text_column

SAMPLE, BUCKETS, PENALTY, TEMPER = 2048, 1 << 16, 8.0, 0.5
MOST_LANGUAGES = 256  # of a model: its table is a number for each bucket and language
HELD_LANGUAGES = 32  # of which a task keeps counts before it passes them on
LETTERS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"

#: First code points of ranges of scripts (Unicode blocks), and the script's name.
SCRIPTS = [
    (0x0000, "Latin"),
    (0x0370, "Greek"),
    (0x0400, "Cyrillic"),
    (0x0530, "Armenian"),
    (0x0590, "Hebrew"),
    (0x0600, "Arabic"),
    (0x0900, "Devanagari"),
    (0x0980, "Indic"),
    (0x0E00, "Thai"),
    (0x0E80, "Lao"),
    (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"),
    (0x10A0, "Georgian"),
    (0x1100, "Hangul"),
    (0x1200, "Ethiopic"),
    (0x13A0, "Other"),
    (0x1E00, "Latin"),
    (0x1F00, "Greek"),
    (0x2000, "Other"),
    (0x2C60, "Latin"),
    (0x2C80, "Other"),
    (0x3040, "Kana"),
    (0x3100, "Other"),
    (0x3130, "Hangul"),
    (0x3190, "Other"),
    (0x3400, "Han"),
    (0xA000, "Other"),
    (0xAC00, "Hangul"),
    (0xD7B0, "Other"),
    (0xF900, "Han"),
    (0xFB00, "Latin"),
    (0xFB50, "Arabic"),
    (0xFE00, "Other"),
    (0x20000, "Han"),
]
NAMES = sorted({name for _, name in SCRIPTS})
BOUNDS = np.array([b for b, _ in SCRIPTS])
SCRIPT_OF = np.array([NAMES.index(name) for _, name in SCRIPTS])


#: Kind of each code point that was met: 0 white space, 1 neither, 2 + s a letter of script s; -1 not met yet.
KIND = np.full(0x110000, -1, np.int8)


class Words(NamedTuple):
    """Words end to end: the code points of their letters, and the number of letters of each."""

    letters: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> Words:
        return cls(code_points(words), np.fromiter(map(len, words), np.int64, len(words)))


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


def script_of(points: np.ndarray) -> np.ndarray:
    return SCRIPT_OF[np.searchsorted(BOUNDS, points, side="right") - 1]


def kinds(points: np.ndarray) -> np.ndarray:
    """Kind of each code point, by the table ``KIND``, which learns those it has not met."""
    found = KIND[points]
    if found.min(initial=0) < 0:
        new = np.unique(points[found < 0])
        chars = list(map(chr, new))
        letter = np.array([LETTERS.match(c) is not None for c in chars])
        white = np.array([c.isspace() for c in chars])
        KIND[new] = np.where(white, 0, np.where(letter, 2 + script_of(new), 1))
        found = KIND[points]
    return found


def words_of_pieces(pieces: list[bytes]) -> tuple[Words, np.ndarray]:
    """The words of all pieces, and how many each piece has: the letters between white spaces, cut where the script changes."""
    texts = [p.decode("utf-8", "replace") for p in pieces]
    points = code_points(texts)
    kind = kinds(points)
    at = np.flatnonzero(kind > 1)
    part = np.cumsum(kind == 0, dtype=np.int32)[at]
    piece = np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter(map(len, texts), np.int64, len(texts)))[at]
    script = kind[at]
    head = np.ones(len(at), bool)
    head[1:] = (part[1:] != part[:-1]) | (piece[1:] != piece[:-1]) | (script[1:] != script[:-1])
    starts = np.flatnonzero(head)
    return Words(points[at], np.diff(np.append(starts, len(at)))), np.bincount(piece[starts], minlength=len(texts))


def words_of_piece(piece: str) -> list[str]:
    """The words of a piece of text as strings."""
    words, _ = words_of_pieces([piece.encode()])
    text, ends = words.letters.tobytes().decode("utf-32-le"), np.cumsum(words.n).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def word_grams(words: Words, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the words end to end, and the number of n-grams of each word (3 * letters + 3)."""
    n = words.n
    if not len(n):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.cumsum(n + 2) - n  # of the first letter
    joined = np.full(int(n.sum()) + 2 * len(n) + 2, 0x20, np.uint64)
    joined[ranges(start, n)] = words.letters
    mul = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
    at = ranges(start, n + 1)  # each letter, and the blank behind the word
    one = joined[at] * mul[0]
    two = one + joined[at - 1] * mul[1] + np.uint64(1)
    three = two + joined[at - 2] * mul[2] + np.uint64(1)
    mix = lambda h: ((h ^ (h >> np.uint64(31))) * mul[1] >> np.uint64(40)).astype(np.int64) % buckets
    grams = np.stack([mix(one), mix(two), mix(three)], axis=1).reshape(-1)
    return grams, 3 * (n + 1)


def script_numbers(words: Words) -> np.ndarray:
    """Script of each word: that of its first letter, as of the others."""
    return script_of(words.letters[np.cumsum(words.n) - words.n])


def words_in(part: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct lower-case pieces of a slice, the piece number of each word, and the rows' first words."""
    at = part.schema.get_field_index("text")
    low = pc.utf8_lower(text_column(part))
    raw, offs = buffer_of(part.set_column(at, "text", low))
    cuts, first = space_cuts(raw, offs)
    pieces, which = distinct_pieces(raw, cuts)
    return pieces, which, first


def held_out(doc_id="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


class Model:
    """Log-probabilities [bucket, language] and the scripts of each language."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        total = counts.sum(axis=0, keepdims=True)
        self.langs = langs
        self.logp = (np.log(counts + 0.5) - np.log(total + 0.5 * len(counts))).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(axis=0, keepdims=True), 1)
        self.allowed = share >= 0.01  # [script, language]

    def scores(self, words: Words | list[str]) -> np.ndarray:
        """[word, language]; 0 for scripts that no language has."""
        words = words if isinstance(words, Words) else Words.of(words)
        grams, n = word_grams(words, len(self.logp))
        ends = np.cumsum(n)
        sums = np.zeros((len(n), len(self.langs)), np.float64)
        for lo in range(0, len(n), 65536):
            hi = min(len(n), lo + 65536)
            a, b = (ends[lo] - n[lo]), ends[hi - 1]
            sums[lo:hi] = np.add.reduceat(self.logp[grams[a:b]], ends[lo:hi] - n[lo:hi] - a, axis=0, dtype=np.float64)
        allowed = self.allowed[script_numbers(words)]
        none = ~allowed.any(axis=1)
        sums = TEMPER * sums
        sums -= sums.max(axis=1, keepdims=True) if len(self.langs) else 0
        sums[~allowed] = -1e3
        sums[none] = 0
        return sums.astype(np.float32)


def train(docs: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS, most_languages: int = MOST_LANGUAGES) -> Model:
    """Counts of n-grams and scripts by language, from at most ``sample`` documents of each.

    The driver gets one row a language, of at most one count a bucket and script; more than ``most_languages`` raise ValueError."""
    labelled = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    keyed = labelled.select(F.xxhash64("doc_id").alias("hash"), "text", "lang")
    # One row a language: the hash up to which its sample goes.  Of its documents only the share of
    # hashes that holds the sample, with six standard deviations to spare, meets in a task.
    sizes = keyed.groupBy("lang").agg(F.count("*").alias("n"))
    spare = F.lit(sample + 6 * sample**0.5 + 20)
    near = keyed.select("lang", "hash").join(F.broadcast(sizes), "lang")
    near = near.where((F.col("hash") / F.lit(2.0**64) + 0.5) * F.col("n") <= spare)
    order = Window.partitionBy("lang").orderBy("hash")
    firsts = near.select("lang", "hash").withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample)
    bounds = firsts.groupBy("lang").agg(F.max("hash").alias("most"))
    chosen = keyed.join(F.broadcast(bounds), "lang").where("hash <= most")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part in slices(batch):
                lang = part.column(1).to_pylist()
                pieces, which, first = words_in(part)
                words, count = words_of_pieces(pieces)
                of_piece = np.cumsum(count) - count
                grams, n = word_grams(words, buckets)
                start, script = np.cumsum(n) - n, script_numbers(words)
                for row, code in enumerate(lang):
                    own = which[first[row] : first[row + 1]]
                    own = ranges(of_piece[own], count[own])
                    g, s = total.setdefault(code, (np.zeros(buckets, np.int64), np.zeros(len(NAMES), np.int64)))
                    g += np.bincount(grams[ranges(start[own], n[own])], minlength=buckets)
                    s += np.bincount(script[own], minlength=len(NAMES))
                if len(total) >= HELD_LANGUAGES:
                    yield from counted(total)
                    total.clear()
        yield from counted(total)

    def counted(total: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for code, (g, s) in total.items():
            flat = np.append(g, s)
            some = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays(
                [pa.array([code] * len(some), pa.string()), pa.array(some, pa.int64()), pa.array(flat[some], pa.int64())],
                names=["lang", "slot", "n"],
            )

    sums = chosen.select("text", "lang").mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    rows = sums.groupBy("lang").agg(F.collect_list(F.struct("slot", "n")).alias("counts")).limit(most_languages + 1).toArrow()
    if rows.num_rows > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    found = rows.column("lang").to_pylist()
    langs = sorted(found)
    flat = np.zeros((buckets + len(NAMES), len(langs)), np.int64)
    for code, counts in zip(found, (c for chunk in rows.column("counts").chunks for c in chunk)):
        flat[counts.values.field("slot").to_numpy(), langs.index(code)] = counts.values.field("n").to_numpy()
    return Model(langs, flat[:buckets], flat[buckets:])


def settled(scores: np.ndarray, penalty: float) -> int:
    """The label of all words of a document where no switch can pay, else -1.

    Gains are those of another label over the best single one, b, in a stretch of words.  A run of m
    stretches of other labels that b borders pays m switches at least, so it loses where every gain is
    under the penalty.  A path of m > 1 stretches without b pays m - 1: it loses where, besides, the
    most that a first and the most that a last stretch gain are together under the penalty.
    """
    by_label = np.ascontiguousarray(scores.T, np.float64)
    total = by_label.sum(axis=1)
    best = int(total.argmax())
    if (np.delete(total, best) > total[best] - 1e-3).any():
        return -1
    gain = np.cumsum(by_label - by_label[best], axis=1)
    low = np.minimum.accumulate(np.hstack([np.zeros((len(total), 1)), gain[:, :-1]]), axis=1)
    most, ends = (gain - low).max(), max(gain.max(), 0.0) + max((gain[:, -1] - low[:, -1]).max(), 0.0)
    return best if max(most, ends) < penalty - 1e-3 else -1


def stretches(scores: np.ndarray, penalty: float, most: int = 512) -> list[tuple[int, int, int]]:
    """Stretches (from, own, to) of a document of which Viterbi labels the words own to ``to`` as it does in the whole.

    Where all words of a run favour one label, by more than two penalties together, every best path is
    at that label at the run's end, whatever lies before and behind: a path that misses the run's label
    could pay for the way there and back.  A stretch of some ``most`` words or more ends there, and the
    next one reads the run once more, so that it starts from that label.  A document without such runs is one stretch.
    """
    n, k = scores.shape
    if n <= most or k < 2 or penalty < 0:
        return [(0, 0, n)]
    best = scores.argmax(axis=1)
    two = np.partition(scores, k - 2, axis=1)[:, k - 2 :].astype(np.float64)
    lead = np.append(0.0, np.cumsum(two[:, 1] - two[:, 0]))
    run = np.append(True, best[1:] != best[:-1])
    start = np.flatnonzero(run)[np.cumsum(run) - 1]  # of the run of each word
    sure = np.flatnonzero(lead[1:] - lead[start] > 2 * penalty + 1e-3)
    out, begin, own = [], 0, 0
    while True:
        at = np.searchsorted(sure, own + most)
        if at == len(sure) or sure[at] + 1 == n:
            return [*out, (begin, own, n)]
        end = int(sure[at])
        out.append((begin, own, end + 1))
        begin = int(np.searchsorted(lead, lead[end + 1] - 2 * penalty - 1e-3, side="left")) - 1
        begin, own = max(begin, int(start[end])), end + 1


def best_labels(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Labels of ``viterbi``, which runs for those documents only in which a switch might pay, long ones by stretches."""
    n = np.diff(first)
    single = np.array([settled(scores[a:b], penalty) if b > a else 0 for a, b in zip(first, first[1:])], np.int16)
    label = np.repeat(single, n)
    parts = [
        (first[d] + a, first[d] + own, first[d] + b)
        for d in np.flatnonzero(single < 0)
        for a, own, b in stretches(scores[first[d] : first[d + 1]], penalty)
    ]
    if parts:
        begin, own, end = np.array(parts, np.int64).T
        size = end - begin
        at = np.cumsum(size) - size
        found = viterbi(scores[ranges(begin, size)], np.append(at, size.sum()), penalty)
        label[ranges(own, end - own)] = found[ranges(at + own - begin, end - own)]
    return label


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word; rows of ``scores`` are words, ``first`` the documents' offsets in them.

    A document's path pays ``penalty`` for each switch; of equal paths the one that stays, then the
    lowest label, is taken.  Step t treats the t-th word of all documents that have one.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    start, n = first[:-1][order], n[order]
    label = np.zeros(len(scores), np.int16)
    if not len(n) or n[0] == 0:
        return label
    stay = np.ones(scores.shape, bool)
    source = np.zeros(len(scores), np.int16)
    active = np.searchsorted(-n, -np.arange(n[0]), side="left")  # documents with more than t words
    delta = np.zeros((len(n), scores.shape[1]), np.float64)
    for t in range(n[0]):
        a = active[t]
        at = start[:a] + t
        now = delta[:a]
        if t:
            top = now.argmax(axis=1)
            switched = now[np.arange(a), top] - penalty
            stay[at] = now >= switched[:, None]
            source[at] = top
            now = np.maximum(now, switched[:, None])
        delta[:a] = now + scores[at]
    state = delta.argmax(axis=1).astype(np.int16)
    for t in range(n[0] - 1, -1, -1):
        a = active[t]
        at = start[:a] + t
        label[at] = state[:a]
        state[:a] = np.where(stay[at, state[:a]], state[:a], source[at])
    return label


class WordScores:
    """Scores and letter counts of the words of distinct pieces, worked out once while they are remembered.

    All is forgotten at a call that finds over ``most`` pieces, or over ``most_bytes`` of pieces and scores, remembered."""

    def __init__(self, model: Model, most: int = 300_000, most_bytes: int = 128 << 20):
        self.model, self.most, self.most_bytes = model, most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.held = 0
        self.scores = np.zeros((0, len(self.model.langs)), np.float32)
        self.letters = np.zeros(0, np.int64)
        self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """First row in ``scores`` and ``letters``, and number of rows, of each piece's words."""
        if len(self.number) > self.most or self.held + self.scores.nbytes > self.most_bytes:
            self.clear()
        new = [p for p in pieces if p not in self.number]
        if new:
            self.held += sum(map(len, new))
            words, count = words_of_pieces(new)
            self.starts = np.append(self.starts, len(self.letters) + np.cumsum(count) - count)
            self.counts = np.append(self.counts, count)
            base = len(self.number)
            self.number.update(zip(new, range(base, base + len(new))))
            if len(words.n):
                self.scores = np.vstack([self.scores, self.model.scores(words)])
                self.letters = np.append(self.letters, words.n)
        at = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        return self.starts[at], self.counts[at]


LABELLED = "doc_id long, lang_pred string, score double, spans array<struct<lang:string,words:int>>"


def labelled_documents(docs: DataFrame, model: Model, penalty: float = PENALTY, carry: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the labelled spans (language, words) of every document;
    with ``carry`` also its row, as a struct ``row``, which goes through the tasks unchanged."""
    langs = model.langs
    span = pa.struct([("lang", pa.string()), ("words", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordScores(model)
        for batch in batches:
            for part in slices(batch):
                pieces, which, first = words_in(part)
                start, count = known(pieces)
                word = ranges(start[which], count[which])
                begin = np.append(0, np.cumsum(count[which]))[first]
                out = result(part.column(0), begin, known.scores[word], known.letters[word])
                yield out.append_column("row", part.column(2)) if carry else out
        given_back()

    def result(doc_id: pa.Array, begin: np.ndarray, scores: np.ndarray, letters: np.ndarray) -> pa.RecordBatch:
        n, rows = len(begin) - 1, np.diff(begin)
        if not langs:
            begin, rows, scores, letters = np.zeros_like(begin), np.zeros_like(rows), scores[:0], letters[:0]
        row = np.repeat(np.arange(n), rows)
        label = best_labels(scores, begin, penalty)
        size = max(1, len(langs))
        by = np.bincount(row * size + label, weights=letters, minlength=n * size).reshape(n, size)
        total = by.sum(axis=1)
        code = np.where(total > 0, by.argmax(axis=1), size)
        score = by.max(axis=1, initial=0) / np.maximum(total, 1)
        names = np.array([*langs, *[""] * (size - len(langs)), UNDETERMINED], object)
        head = np.ones(len(label), bool)
        head[1:] = (label[1:] != label[:-1]) | (row[1:] != row[:-1])
        starts = np.flatnonzero(head)
        words = np.diff(np.append(starts, len(label)))
        cut = np.append(0, np.cumsum(np.bincount(row[starts], minlength=n)))
        spans = pa.ListArray.from_arrays(
            pa.array(cut, pa.int32()),
            pa.StructArray.from_arrays([pa.array(names[label[starts]], pa.string()), pa.array(words, pa.int32())], fields=list(span)),
        )
        return pa.RecordBatch.from_arrays(
            [doc_id, pa.array(names[code], pa.string()), pa.array(score, pa.float64()), spans],
            names=["doc_id", "lang_pred", "score", "spans"],
        )

    row = F.struct(*docs.columns).alias("row")
    taken = docs.select(F.col("doc_id").cast("long"), "text", *[row] * carry)
    kind = taken.schema["row"].dataType.simpleString() if carry else ""
    out = taken.mapInArrow(run, LABELLED + f", row {kind}" * carry)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "spans", *["row"] * carry)


def language_id(docs: DataFrame, sample: int = SAMPLE, penalty: float = PENALTY, carry: bool = False) -> DataFrame:
    """Learn from a bounded sample of ``docs`` and label all of them."""
    return labelled_documents(docs, train(docs, sample), penalty, carry)
