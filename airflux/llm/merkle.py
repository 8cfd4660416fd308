"""Merkle manifest of a dataset in an external-memory node store (operator 11).

H is the lowercase hex SHA-256 of its inputs end to end, digests as their hex text.  A row's leaf is H of
its fields; the leaves of a key (lang), in the order of doc_id, are put together by eights, level by level,
up to a subroot; the subroots, in the order of their keys, likewise up to the root.

1. Leaf runs: rows are sorted by (key, doc_id) into ranges, and every range is written as a run whose
   leaves are numbered within it.  Counts by (run, key) give each run its first coordinate.
2. Node store: level k + 1 is made by streaming over level k as it lies in its files.  A task hashes the
   eights that it sees whole; the ragged ends of its stretches (seven nodes at most at either end) meet in a
   small shuffle.  Every level is a partition ``level=k`` of the store.  A level is an eighth of the one below.
3. Proofs by coordinate: above level ``TIER`` the siblings on the way up are gathered top-down by joins on
   the coordinate, one short row for each of the ``8 ** TIER`` leaves below.  A merge-scan (cogroup on key and
   block) then brings the leaves and stored nodes of one block of that many leaves together with the way above
   it, so a task holds some megabytes, whatever the size of a key.

Texts are read once, by SQL functions, and never shuffled: what moves is two digests a document.  All
levels and runs are tables in the shared folder, so a lost executor costs a task.

Edge cases: null fields are ``-``; a null key comes first and has a subroot of its own; a null doc_id comes
first among its key's leaves; rows that share a doc_id are ordered by their digests; repeated rows are leaves
of their own next to each other; a lone leaf is its own subroot, and a lone subroot the root; the empty table has no
leaf, no root and no row; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, written

FAN, TIER = 8, 4
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
ASCII = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, *ASCII)


def key_of(column: str) -> Column:
    """A string in the order of the column's bytes, null first, and never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit(""))


# --- leaf runs ---------------------------------------------------------------------------------


def leaf_runs(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (key, hash, ...) in sorted runs, with their coordinate ``pos`` in the key and the key's ``total``.

    Only counts by run and key are put in order by key; rows are ordered in ranges, so a key that holds most
    rows is many runs."""
    kept, kind = rows.columns, rows.schema
    sort = ["key", *order]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            keys = batch.column(0).dictionary_encode()
            names, code = keys.dictionary.to_pylist(), keys.indices.to_numpy(zero_copy_only=False)
            at = np.empty(len(code), np.int64)
            for a, b in _stretches(code, np.zeros(len(code), np.int64)):
                if names[code[a]] != last:
                    last, seen = names[code[a]], 0
                at[a:b] = np.arange(seen, seen + b - a)
                seen += b - a
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=[*batch.schema.names, "at"])

    ranged = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("run", F.spark_partition_id())
    ranged = ranged.select("key", "run", *(c for c in kept if c != "key"))
    out_kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema) + ", at long"
    runs = written(ranged.mapInArrow(numbered, out_kind), "runs")
    counts = runs.groupBy("key", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("key", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.sum("n").over(Window.partitionBy("key")).alias("total"))
    placed = runs.join(written(first, "first"), ["key", "run"]).withColumn("pos", F.col("first") + F.col("at"))
    names = [f.name for f in kind if f.name != "key"]
    return placed.select("key", "pos", "total", *names).sortWithinPartitions("key", "pos")


# --- node store ----------------------------------------------------------------------------------


def _stretches(code: np.ndarray, step: np.ndarray) -> list[tuple[int, int]]:
    """(start, stop) of runs with one code and one ``step``."""
    if not len(code):
        return []
    cuts = np.flatnonzero((code[1:] != code[:-1]) | (step[1:] != step[:-1])) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(code)]))


def _size(total: int, k: int) -> int:
    """Nodes of level ``k`` over ``total`` leaves."""
    return -(-total // FAN**k)


def next_level(nodes: DataFrame, level: int) -> DataFrame:
    """Nodes (key, pos, total, hash) of ``level`` + 1 from those of ``level``, read in the order of their files."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[tuple[str, int, int, list[str], int]] = []  # key, run of eight, total, hashes, first place

        def closed(out: list) -> None:
            for key, run, total, hashes, first in open_:
                whole = first == run * FAN and len(hashes) == min(FAN, _size(total, level) - run * FAN)
                if whole:
                    out.append((key, run, total, hashlib.sha256("".join(hashes).encode()).hexdigest(), None))
                else:
                    out.extend((key, run, total, h, first + k) for k, h in enumerate(hashes))
            open_.clear()

        def table(out: list) -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["key", "pos", "total", "hash", "child"])

        for batch in batches:
            out: list = []
            for key, pos, total, h in zip(*(batch.column(k).to_pylist() for k in range(4))):
                run = pos // FAN
                if not open_ or open_[0][0] != key or open_[0][1] != run or open_[0][4] + len(open_[0][3]) != pos:
                    closed(out)
                    open_.append((key, run, total, [h], pos))
                else:
                    open_[0][3].append(h)
            if out:
                yield table(out)
        out = []
        closed(out)
        if out:
            yield table(out)

    made = nodes.where(F.ceil(F.col("total") / FAN**level) > 1).select("key", "pos", "total", "hash")
    made = written(made.mapInArrow(fold, "key string, pos long, total long, hash string, child long"), "folded")
    ends = made.where("child is not null").groupBy("key", "pos", "total")  # eight rows of a group at most
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("child", "hash"))), lambda x: x["hash"]), "")
    ends = ends.agg(F.sha2(text, 256).alias("hash"))
    return made.where("child is null").select("key", "pos", "total", "hash").unionByName(ends)


def node_store(leaves: DataFrame, name: str = "nodes") -> tuple[str, int]:
    """Folder of the store of ``leaves`` (key, pos, total, hash), partitioned by level, and its number of levels."""
    spark = leaves.sparkSession
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    leaves.select("key", "pos", "total", "hash").write.parquet(f"{folder}/level=0")
    kind = "key string, pos long, total long, hash string"
    most = spark.read.schema(kind).parquet(f"{folder}/level=0").agg(F.max("total")).first()[0] or 0
    top = 0
    while _size(most, top) > 1:
        nodes = spark.read.schema(kind).parquet(f"{folder}/level={top}")
        next_level(nodes, top).sortWithinPartitions("key", "pos").write.parquet(f"{folder}/level={top + 1}")
        top += 1
    return folder, top


def nodes_of(spark, folder: str) -> DataFrame:
    return spark.read.schema("key string, pos long, total long, hash string, level int").parquet(folder)


# --- proofs --------------------------------------------------------------------------------------

WAY = "array<struct<l: string, r: string>>"


def roots_of(spark, folder: str) -> DataFrame:
    """(key, hash): the topmost node of every key."""
    nodes = nodes_of(spark, folder).where("pos = 0")
    last = nodes.groupBy("key").agg(F.max("level").alias("level"))
    return nodes.join(last, ["key", "level"]).select("key", "hash")


def ways_up(spark, folder: str, top: int, tier: int, above: DataFrame) -> DataFrame:
    """(key, pos, way, more columns of ``above``): what stands beside the way up from every node of level ``tier``.

    ``way`` has the hashes left and right of the way, lowest level first, and ends with the ``way`` of ``above``
    (key, way, ...), the way from the key's topmost node on.  Keys with fewer levels have one row, at 0."""
    nodes = nodes_of(spark, folder)
    high = nodes.where("pos = 0").groupBy("key").agg(F.max("level").alias("high")).join(above, "key")
    extra = [c for c in above.columns if c not in ("key", "way")]
    out = None
    for level in range(top, tier - 1, -1):
        start = high.where(F.col("high") == level if level > tier else F.col("high") <= tier)
        start = start.select("key", F.lit(0).cast("long").alias("pos"), F.col("way").cast(WAY).alias("way"), *extra)
        if out is not None:
            here = nodes.where(F.col("level") == level).select("key", "pos", "hash", F.floor(F.col("pos") / FAN).alias("up"))
            run = here.groupBy("key", "up").agg(F.array_sort(F.collect_list(F.struct("pos", "hash"))).alias("run"))
            own = run.withColumn("me", F.explode("run"))
            text = lambda f: F.array_join(F.transform(F.filter("run", f), lambda x: x["hash"]), "")
            beside = F.struct(
                text(lambda x: x["pos"] < F.col("me.pos")).alias("l"), text(lambda x: x["pos"] > F.col("me.pos")).alias("r")
            )
            own = own.select("key", "up", F.col("me.pos").alias("pos"), beside.alias("beside"))
            over = out.select("key", F.col("pos").alias("up"), "way", *extra)
            down = own.join(over, ["key", "up"]).select("key", "pos", F.concat(F.array("beside"), "way").cast(WAY).alias("way"), *extra)
            start = start.unionByName(down)
        out = written(start, f"ways{level}")
    return out


def proofs(leaves: DataFrame, folder: str, ways: DataFrame, tier: int) -> DataFrame:
    """``leaves`` (key, pos, doc_id, hash, altered) with subroot, root, proof_sha256, folded_root and verified.

    Blocks of ``FAN ** tier`` leaves: a cogroup merges the sorted leaves with the sorted nodes of the store
    and the one way above them; all that a block holds is bounded."""
    span = FAN**tier
    nodes = nodes_of(leaves.sparkSession, folder).where(F.col("level") < tier)
    # A node of a lower level belongs to the block of its leaves.
    block = F.floor(F.col("pos") * F.pow(F.lit(float(FAN)), F.col("level")).cast("long") / span).cast("long")
    side = nodes.select("key", block.alias("block"), "level", "pos", "total", "hash", F.lit(None).cast(WAY).alias("way"), F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("string").alias("root"))
    up = ways.select("key", F.col("pos").alias("block"), F.lit(-1).alias("level"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("total"), F.lit("").alias("hash"), "way", "subroot", "root")
    rows = leaves.withColumn("block", F.floor(F.col("pos") / span).cast("long"))

    def block_proofs(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        head = other[other["level"] < 0].iloc[0]
        above = [(b["l"], b["r"]) for b in head["way"]]
        store = other[other["level"] >= 0].sort_values(["level", "pos"])
        total = int(store["total"].iloc[0])
        levels, first = [], []
        for k in range(tier):
            some = store[store["level"] == k]
            levels.append(some["hash"].tolist())
            first.append(int(some["pos"].iloc[0]) if len(some) else 0)
        depth = next((k for k in range(tier) if _size(total, k) == 1), tier)
        pos, out = own["pos"].to_numpy(np.int64), []
        tail = "".join(left + right for left, right in above)
        for p, given in zip(pos.tolist(), own["altered"].tolist()):
            seen, h = [], given
            for k in range(depth):
                at, hashes = p // FAN**k - first[k], levels[k]
                lo = at - (p // FAN**k) % FAN
                left, right = "".join(hashes[lo:at]), "".join(hashes[at + 1 : lo + FAN])
                seen += (left, right)
                h = hashlib.sha256((left + h + right).encode()).hexdigest()
            for left, right in above:
                h = hashlib.sha256((left + h + right).encode()).hexdigest()
            out.append((hashlib.sha256(("".join(seen) + tail).encode()).hexdigest(), h))
        made = pd.DataFrame(out, columns=["proof_sha256", "folded_root"])
        ids = own["doc_id"]
        return pd.DataFrame(
            {"doc_id": ids.astype("Int64"), "leaf": own["hash"], "subroot": head["subroot"], "root": head["root"]}
        ).reset_index(drop=True).assign(**made)

    kind = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    both = rows.groupBy("key", "block").cogroup(side.unionByName(up).groupBy("key", "block"))
    return both.applyInPandas(block_proofs, kind).withColumn("verified", F.col("folded_root") == F.col("root"))


def merkle_manifest(docs: DataFrame, altered: Column | None = None, tier: int = TIER) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document.

    ``altered`` is the text as it is found at the time of verification (as stored, if not given): proofs
    and roots are those of the stored rows, ``folded_root`` is folded up from the leaf of the altered ones."""
    spark = docs.sparkSession
    columns = [F.col("doc_id").cast("long"), *map(F.col, FIELDS[1:])]
    again = leaf(columns) if altered is None else leaf([*columns[:-1], altered])
    rows = docs.select(key_of("lang").alias("key"), F.col("doc_id").cast("long"), leaf(columns).alias("hash"), again.alias("altered"))
    # Written first: the sampling for the ranges then reads digests, not texts.
    leaves = written(leaf_runs(written(rows, "hashed"), ["doc_id", "hash", "altered"]), "leaves")
    folder, top = node_store(leaves)
    subroots = roots_of(spark, folder).select(F.lit("").alias("key"), F.col("key").alias("name"), "hash")
    upper = written(leaf_runs(subroots, ["name"]), "subroots")
    upper_folder, upper_top = node_store(upper)
    root = roots_of(spark, upper_folder).select("key", F.lit(None).cast(WAY).alias("way"), F.col("hash").alias("root"))
    beyond = ways_up(spark, upper_folder, upper_top, 0, root.withColumn("way", F.array().cast(WAY)))
    above = upper.select("pos", F.col("name").alias("lang_key"), F.col("hash").alias("subroot")).join(beyond, "pos").select(F.col("lang_key").alias("key"), "way", "subroot", "root")
    ways = ways_up(spark, folder, max(top, tier), tier, written(above, "above"))
    return proofs(leaves, folder, ways, tier)


def manifest_check(docs: DataFrame) -> DataFrame:
    """The manifest, checked against rows of which a third (by a checksum of doc_id) had their text lower-cased."""
    third = F.crc32(F.col("doc_id").cast("long").cast("string")) % 3 == 0
    return merkle_manifest(docs, F.when(F.coalesce(third, F.lit(False)), lowered(F.col("text"))).otherwise(F.col("text")))


ORACLE_SQL = r"""
with recursive t as (
  select *, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)) as crc from documents),
e as (select doc_id, lang, text, crc, coalesce('' || length(doc_id::varchar) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
    || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(length(n_chars::varchar) || ':' || n_chars, '-') as head from t),
l as (select doc_id, lang, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) as leaf,
    sha256(head || coalesce(octet_length(encode(text)) || ':' || case when xor(crc, 4294967295) % 3 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end, '-')) as altered from e),
p as (select doc_id, coalesce('=' || lang, '') as k, leaf, altered, row_number() over (partition by lang order by doc_id) - 1 as pos, count(*) over (partition by lang) as n from l),
nodes as (select k, 0 as level, pos, n, leaf as h from p
  union all select k, level + 1, pos // 8, max((n + 7) // 8), sha256(string_agg(h, '' order by pos)) from nodes where n > 1 group by k, level, pos // 8),
subs as (select k, h, row_number() over (order by encode(k)) - 1 as pos, count(*) over () as n from nodes where n = 1),
tops as (select 0 as level, pos, n, h from subs
  union all select level + 1, pos // 8, max((n + 7) // 8), sha256(string_agg(h, '' order by pos)) from tops where n > 1 group by level, pos // 8),
steps as (
  select p.doc_id, g.level, string_agg(g.h, '' order by g.pos) filter (g.pos < p.pos // (8 ** g.level)::bigint) as lo, string_agg(g.h, '' order by g.pos) filter (g.pos > p.pos // (8 ** g.level)::bigint) as hi
  from p join nodes g on g.k = p.k and g.n > 1 and g.pos // 8 = p.pos // (8 ** (g.level + 1))::bigint group by 1, 2
  union all
  select p.doc_id, 100 + g.level, string_agg(g.h, '' order by g.pos) filter (g.pos < s.pos // (8 ** g.level)::bigint), string_agg(g.h, '' order by g.pos) filter (g.pos > s.pos // (8 ** g.level)::bigint)
  from p join subs s on s.k = p.k join tops g on g.n > 1 and g.pos // 8 = s.pos // (8 ** (g.level + 1))::bigint group by 1, 2),
ordered as (select doc_id, row_number() over (partition by doc_id order by level) as i, coalesce(lo, '') as lo, coalesce(hi, '') as hi from steps),
fold as (select doc_id, 0 as i, altered as h from p union all
  select o.doc_id, o.i::int, sha256(o.lo || f.h || o.hi) from fold f join ordered o on o.doc_id = f.doc_id and o.i = f.i + 1),
proof as (select doc_id, sha256(string_agg(lo || hi, '' order by i)) as proof_sha256, max(i) as last from ordered group by 1)
select p.doc_id, p.leaf, s.h as subroot, r.h as root, coalesce(q.proof_sha256, sha256('')) as proof_sha256, f.h as folded_root, f.h = r.h as verified
from p join subs s on s.k = p.k cross join (select h from tops where n = 1) r left join proof q on q.doc_id = p.doc_id
join fold f on f.doc_id = p.doc_id and f.i = coalesce(q.last, 0)
"""
