"""Ranked lexical search by branch and bound over a hierarchical max tree (operator 13).

1. Terms of every whole text are cut and counted in Arrow batches; a document leaves one row with its length
   and the counts of those of its terms that some query asks for.  Corpus figures (documents, terms, documents
   of a term) come from all rows.
2. Index: documents, ``SHARD`` at a time as they lie in the files, form a shard.  A shard holds each
   document's postings as gains (scores but for the term's weight), and for every term a tree of maxima over
   ranges of 8, 64 and all of its documents: weight and node bound what the term can add to any document below.
3. First look: the summed bounds at the roots name the most promising shard of each query; its ten best
   scores give a threshold that already holds for the whole corpus.
4. Every shard is searched for every query: if the sum at its root reaches the threshold, best first.  The open node
   with the highest summed bound is next; ranges of 8 are scored in full.  The search ends where the highest
   bound is below the tenth best score; nodes that equal it are opened, for ties go by doc_id.  The threshold
   rises within a task from shard to shard.  Only each task's best rows are put together.

The order of shards does not matter for the result, so nothing is sorted and texts are never shuffled.
Queries are gathered ``QUERY_TERMS`` terms at a time, and a task's dense trees hold ``LOCAL_TERMS`` terms at a
time; more of either are more rounds, not fewer results.

Scores are 64-bit integers: a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), and a document adds
weight * gain, gain = 10^9 tf div (1000 tf + 8 m), m = 10 + 90 n N div L.

Edge cases: a null or empty text and one without a term are in no result and no count; a query without known
terms has no rows; a null item_id or doc_id is a value like any other (doc_id null last among ties); rows
that share an item_id are one query with the terms of all; repeated documents each have a rank; texts of any
length are read whole; empty tables give an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import buffer_of, distinct_pieces, ranges, slices
from .common import shared_dir, written

TOP, SHARD, FAN = 10, 512, 8
QUERY_TERMS = 1 << 18  # terms of queries in a round over the corpus
LOCAL_TERMS = 1 << 13  # terms of the dense trees of a shard
NO_ID = np.iinfo(np.int64).max

#: Bytes of terms: ASCII letters and digits, and all bytes of other characters.
_IN_TERM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


# --- terms -----------------------------------------------------------------------------------------


def pieces(raw: np.ndarray, offs: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct terms (A-Z lowered), the number of each term in the text order, and its document."""
    if not len(raw):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = raw + (((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5)
    black, edge = _IN_TERM[low], np.zeros(len(raw) + 1, bool)
    edge[offs] = True
    start = np.flatnonzero(black & np.append(True, ~black[:-1] | edge[1:-1]))
    stop = np.flatnonzero(black & (np.append(~black[1:], True) | edge[1:])) + 1
    if not len(start):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    # The terms end to end, so that consecutive cuts part terms and nothing else.
    sizes = stop - start
    names, number = distinct_pieces(low[ranges(start, sizes)], np.append(0, np.cumsum(sizes)))
    return names, number, np.searchsorted(offs, start, side="right") - 1


def counted(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term; ``terms`` lists those of the queries."""
    known = max(terms.values(), default=-1) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                names, number, row = pieces(*buffer_of(part))
                if not names:
                    continue
                n = np.bincount(row, minlength=part.num_rows)
                code = np.fromiter((terms.get(x, -1) for x in names), np.int64, len(names))[number]
                hit = code >= 0
                cell, tf = np.unique(row[hit] * max(known, 1) + code[hit], return_counts=True)
                at = np.searchsorted(cell, np.arange(part.num_rows + 1) * max(known, 1)).astype(np.int32)
                listed = lambda x: pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.int32)))
                out = pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), listed(cell % max(known, 1)), listed(tf)], names=["doc_id", "n", "terms", "tfs"]
                )
                yield out.filter(pa.array(n > 0))

    taken = docs.where("text is not null").select(F.col("doc_id").cast("long"), "text")
    return taken.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct (item_id, term)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                names, number, row = pieces(*buffer_of(part))
                if names:
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(names, pa.binary()).take(pa.array(number))], names=["item_id", "term"])

    return queries.where("text is not null").select("item_id", "text").mapInArrow(run, f"item_id {dict(queries.dtypes)['item_id']}, term binary").distinct()


# --- index -----------------------------------------------------------------------------------------


def gains_of(tf: np.ndarray, n: np.ndarray, all_docs: int, all_terms: int) -> np.ndarray:
    """What a term adds to a document, but for its weight; below 10^6."""
    m = 10 + (90 * n * all_docs) // all_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weights_of(df: np.ndarray, all_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * all_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def maxima(term: np.ndarray, node: np.ndarray, gain: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells term * width + node, rising, and the greatest gain of each."""
    cell = term * width + node
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
    return cell[first], np.maximum.reduceat(gain[order], first) if len(cell) else gain


#: Nodes of each level of a shard: ranges of 8 and 64 documents, and the whole shard.
WIDTHS = [SHARD // FAN, SHARD // FAN**2, 1]
ROOT = len(WIDTHS) - 1
INDEX = "shard long, doc_ids array<long>, at array<int>, terms array<int>, gains array<int>, " + ", ".join(f"cells{k} array<int>, most{k} array<int>" for k in range(ROOT + 1))
ROW_GROUP = 16 << 20  # bytes: a shard is a row of about a megabyte, and readers hold a row group


def index(rows: DataFrame, all_docs: int, all_terms: int) -> DataFrame:
    """Shards with their postings and trees; ``rows`` as ``counted`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo in range(0, batch.num_rows, SHARD):
                part = batch.slice(lo, SHARD)
                lists = part.column(2)
                at = lists.offsets.to_numpy().astype(np.int64)
                term = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                tf = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                at = at - at[0]
                doc = np.repeat(np.arange(part.num_rows), np.diff(at))
                n = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                gain = gains_of(tf, n[doc], all_docs, all_terms)
                ints = lambda x: pa.array([x.astype(np.int32)], pa.list_(pa.int32()))
                made, cells, most = [], term * SHARD + doc, gain
                node = doc
                for width in WIDTHS:
                    node = (cells % (width * FAN)) // FAN
                    cells, most = maxima(cells // (width * FAN), node, most, width)
                    made += [ints(cells), ints(most)]
                ids = part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([ids], pa.list_(pa.int64())), ints(at), ints(term), ints(gain), *made],
                    names=[x.split()[0] for x in INDEX.split(", ")],
                )
                name += 1

    return rows.mapInArrow(run, INDEX)


# --- search ------------------------------------------------------------------------------------------


class Shard:
    """One shard's arrays; dense trees of a block of terms at a time."""

    def __init__(self, batch: pa.RecordBatch, k: int, weight: np.ndarray):
        get = lambda name: batch.column(batch.schema.get_field_index(name))[k].values.to_numpy(zero_copy_only=False)
        self.ids, self.at, self.terms, self.gains = get("doc_ids"), get("at"), get("terms"), get("gains")
        self.levels, self.weight = [(get(f"cells{j}"), get(f"most{j}")) for j in range(ROOT + 1)], weight

    def dense(self, block: np.ndarray) -> None:
        """Trees of the terms in ``block`` (rising), as matrices of term by node."""
        self.place = np.full(len(self.weight) + 1, -1, np.int64)
        self.place[block] = np.arange(len(block))
        self.trees = []
        for (cells, most), width in zip(self.levels, WIDTHS):
            own = self.place[cells // width]
            tree = np.zeros((len(block), width), np.int32)
            some = own >= 0
            tree[own[some], (cells % width)[some]] = most[some]
            self.trees.append(tree)

    def best(self, terms: np.ndarray, found: list[tuple[int, int, int]], least: int, top: int, seen: list | None = None) -> None:
        """Put this shard's documents among ``found``, a heap of at most ``top`` (score, -doc_id, n), best first.

        ``least`` is a score that the last of the best has at least; equal scores are kept for ties."""
        own, weight = self.place[terms], self.weight[terms]
        bar = lambda: max(least, found[0][0] if len(found) == top else 0, 1)
        root = int(weight @ self.trees[ROOT][own, 0])
        heap = [(-root, ROOT, 0)] if root >= bar() else []
        worth = np.zeros(len(self.weight) + 1, np.int64)
        worth[terms] = weight
        while heap:
            bound, level, node = heapq.heappop(heap)
            if -bound < bar():
                return
            if seen is not None:
                seen.append((-bound, level, node))
            if level:
                lo = node * FAN
                sums = weight @ self.trees[level - 1][own, lo : lo + FAN]
                for k in np.flatnonzero(sums >= bar()).tolist():
                    heapq.heappush(heap, (-int(sums[k]), level - 1, lo + k))
                continue
            lo, hi = node * FAN, min(node * FAN + FAN, len(self.ids))
            a, b = self.at[lo], self.at[hi]
            parts = np.append(0, np.cumsum(worth[self.terms[a:b]] * self.gains[a:b]))[self.at[lo : hi + 1] - a]
            sums = np.diff(parts)
            for k in np.flatnonzero(sums >= bar()).tolist():
                entry = (int(sums[k]), -int(self.ids[lo + k]), 0)
                if len(found) < top:
                    heapq.heappush(found, entry)
                elif entry > found[0]:
                    heapq.heapreplace(found, entry)


def blocks_of(items: list[np.ndarray]) -> list[tuple[list[int], np.ndarray]]:
    """Numbers of queries, and the terms of each such block; about ``LOCAL_TERMS`` terms, one query at least."""
    out, own, terms = [], [], np.zeros(0, np.int64)
    for k, t in enumerate(items):
        both = np.union1d(terms, t)
        if own and len(both) > LOCAL_TERMS:
            out.append((own, terms))
            own, both = [], np.unique(t)
        own.append(k)
        terms = both
    return [*out, (own, terms)] if own else []


def root_bounds(shards: DataFrame, items: list[np.ndarray], weight: np.ndarray) -> DataFrame:
    """(item, shard): for each query the shard with the highest sum at the root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, where = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
        flat, at = np.concatenate(items), np.append(0, np.cumsum([len(t) for t in items]))[:-1]
        for batch in batches:
            for k in range(batch.num_rows):
                root = np.zeros(len(weight), np.int64)
                root[batch.column(1)[k].values.to_numpy(zero_copy_only=False)] = batch.column(2)[k].values.to_numpy(zero_copy_only=False)
                sums = np.add.reduceat((root * weight)[flat], at)
                more = sums > best
                best[more], where[more] = sums[more], batch.column(0)[k].as_py()
        some = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(best[some]), pa.array(where[some])], names=["item", "bound", "shard"])

    bounds = shards.select("shard", f"cells{ROOT}", f"most{ROOT}").mapInArrow(run, "item long, bound long, shard long")
    return bounds.groupBy("item").agg(F.max_by("shard", F.struct("bound", "shard")).alias("shard"))


def searched(shards: DataFrame, items: list[np.ndarray], weight: np.ndarray, least: np.ndarray, top: int, only: bool = False) -> DataFrame:
    """(item, score, doc_id): each task's best for every query (``only``: for the queries in column ``wanted``)."""
    blocks = blocks_of(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list] = [[] for _ in items]
        for batch in batches:
            for k in range(batch.num_rows):
                shard = Shard(batch, k, weight)
                wanted = set(batch.column(batch.num_columns - 1)[k].as_py()) if only else None
                for own, terms in blocks:
                    some = own if wanted is None else [q for q in own if q in wanted]
                    if some:
                        shard.dense(terms)
                    for q in some:
                        shard.best(items[q], found[q], int(least[q]), top)
        rows = [(q, score, -less) for q, heap in enumerate(found) for score, less, _ in heap]
        q, score, ids = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(score), pa.array(ids, mask=ids == NO_ID)], names=["item", "score", "doc_id"])

    return shards.mapInArrow(run, "item long, score long, doc_id long")


def best_of(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of each item with their ``rank``."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {top}")


def ranked_search(docs: DataFrame, queries: DataFrame, top: int = TOP, most_terms: int = QUERY_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score of the ``top`` highest-scoring documents of every query, scores above 0.

    ``docs`` (doc_id, text), ``queries`` (item_id, text)."""
    spark = docs.sparkSession
    asked = written(query_terms(queries), "asked")
    rounds = max(1, -(-asked.count() // most_terms))
    out = None
    for r in range(rounds):
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == r) if rounds > 1 else asked
        lists = part.groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))
        one = _round(docs, [(x["item_id"], [bytes(t) for t in x["terms"]]) for x in lists.collect()], top)
        if one is not None:
            names = spark.createDataFrame([(k, i) for k, i in enumerate(one[1])], f"item long, item_id {dict(queries.dtypes)['item_id']}")
            got = one[0].join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
            out = got if out is None else out.unionByName(got)
    if out is None:
        return spark.createDataFrame([], f"item_id {dict(queries.dtypes)['item_id']}, rank int, doc_id long, score long")
    return out


def _round(docs: DataFrame, asked: list[tuple[object, list[bytes]]], top: int) -> tuple[DataFrame, list] | None:
    """The best of the queries of a round (their terms have a bound), by number, and their names in that order."""
    if not asked:
        return None
    terms = {t: k for k, t in enumerate(sorted({t for _, ts in asked for t in ts}))}
    items, known = [np.array(sorted(terms[t] for t in ts), np.int64) for _, ts in asked], len(terms)
    rows = written(counted(docs, terms), "counted")
    sums = rows.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    if not sums["docs"]:
        return None
    df = np.zeros(known, np.int64)
    for x in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row a query term
        df[x["t"]] = x["count"]
    weight = weights_of(df, sums["docs"])
    folder = f"{shared_dir(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    index(rows, int(sums["docs"]), int(sums["terms"])).write.option("parquet.block.size", ROW_GROUP).parquet(folder)
    shards = docs.sparkSession.read.schema(INDEX).parquet(folder)
    first = root_bounds(shards, items, weight).groupBy("shard").agg(F.collect_list("item").alias("wanted"))
    look = searched(shards.join(F.broadcast(first), "shard"), items, weight, np.zeros(len(items), np.int64), top, only=True)
    least = np.zeros(len(items), np.int64)
    for x in best_of(look, top).where(f"rank = {top}").select("item", "score").collect():  # a row a query
        least[x["item"]] = x["score"]
    return best_of(searched(shards, items, weight, least, top), top), [i for i, _ in asked]


ORACLE_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
q as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
s as (select count(*)::bigint as docs, sum(len(t))::bigint as terms from d where len(t) > 0),
tf as (select doc_id, term, count(*)::bigint as tf from (select doc_id, unnest(t) as term from d) where term in (select term from q) group by 1, 2),
df as (select term, count(*)::bigint as df from tf group by 1),
w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w from df, s),
p as (select doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(t)::bigint * docs) // terms))) as part from tf join w using (term) join d using (doc_id), s),
r as (select item_id, doc_id, sum(part)::bigint as score from q join p using (term) group by 1, 2),
k as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from r where score > 0)
select item_id, rank::int as rank, doc_id, score from k where rank <= 10
"""
