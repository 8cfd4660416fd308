"""Hilbert-curve sharding (operator 6), DataFrame functions only.

Several metadata dimensions are quantised to ``bits`` bits, the cell's index on the Hilbert
curve orders the rows, and runs of that order are cut into shards whose row counts differ by
one at most (law ``rows``).  Rows near each other in every dimension share a shard, so ranges
of several columns prune files.  A dimension is cut where its values, in their own order (names
alphabetically), reach equal shares of the rows, so neighbouring codes are neighbouring values; the
``2 ** bits`` bounds of each are all that comes to the driver.  Distinct sources, one row each, are
put in order in one task.

A row's global rank is (rows in earlier cells) + (rows in earlier salts of its cell) + (its
number within cell and salt).  Only counts by cell (at most ``2 ** (bits * dimensions)`` rows)
meet in one task; a cell that holds a large part of all rows is numbered in ``SALTS`` pieces.

Edge cases: null source and null doc_id have the lowest code; a null or empty text has size 1; ties on
the curve are ordered by salt, doc_id and checksum; repeated rows take places next to each
other; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

SALTS = 64


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of the cell with coordinates ``dims`` (``bits`` bits each).

    Skilling's transform (AIP Conf. Proc. 707, 2004): undo the excess turns bit by bit, Gray
    encode, and interleave the bits of all coordinates.
    """
    n = len(dims)
    if not 0 < bits * n <= 62:
        raise ValueError("bits x dimensions must be between 1 and 62")
    long = lambda v: F.lit(v).cast("long")
    power = lambda e: F.call_function("shiftleft", long(1), e.cast("int"))
    xor = lambda a, b: a.bitwiseXOR(b)
    start = F.array(*(d.cast("long") for d in dims))
    if bits > 1:

        def step(x: Column, s: Column) -> Column:
            q, k = power(F.lit(bits - 1) - F.floor(s / n)), F.pmod(s, F.lit(n))
            turned = F.transform(x, lambda v, i: F.when(i == 0, xor(v, q - 1)).otherwise(v))
            swap = xor(F.get(x, F.lit(0)), F.get(x, k)).bitwiseAND(q - 1)
            swapped = F.transform(x, lambda v, i: F.when((k > 0) & ((i == 0) | (i == k)), xor(v, swap)).otherwise(v))
            return F.when(F.get(x, k).bitwiseAND(q) != 0, turned).otherwise(swapped)

        start = F.aggregate(F.sequence(F.lit(0), F.lit((bits - 1) * n - 1)), start, step)
    gray = lambda x: F.transform(x, lambda v, i: F.aggregate(F.slice(x, F.lit(1), i + 1), long(0), xor))

    def turned_back(x: Column) -> Column:
        if bits == 1:
            return x
        turn = F.aggregate(
            F.sequence(F.lit(1), F.lit(bits - 1)),
            long(0),
            lambda t, e: F.when(F.get(x, F.lit(n - 1)).bitwiseAND(power(e)) != 0, xor(t, power(e) - 1)).otherwise(t),
        )
        return let(turn, lambda t: F.transform(x, lambda v: xor(v, t)))

    def interleaved(x: Column) -> Column:
        digit = lambda s: F.call_function(
            "shiftright", F.get(x, F.pmod(s, F.lit(n))), (F.lit(bits - 1) - F.floor(s / n)).cast("int")
        ).bitwiseAND(long(1))
        return F.aggregate(F.sequence(F.lit(0), F.lit(bits * n - 1)), long(0), lambda a, s: a * 2 + digit(s))

    return let(let(let(start, gray), turned_back), interleaved)


def ranked(df: DataFrame, dims: list[str], bits: int, order: list[str]) -> DataFrame:
    """``df`` (with columns ``dims`` and salt) plus curve, ``rank`` from 0 by (curve, salt, ``order``), and total."""
    cell = [*dims, "salt"]
    counts = df.groupBy(*cell).agg(F.count("*").alias("__n"))
    cells = counts.groupBy(*dims).agg(F.sum("__n").alias("__n"))
    cells = cells.withColumn("curve", hilbert_index([F.col(d) for d in dims], bits))
    before = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        *dims,
        "curve",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__cell"),
        F.sum("__n").over(Window.partitionBy(F.lit(0))).alias("total"),
    )
    within = Window.partitionBy(*dims).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*cell, F.coalesce(F.sum("__n").over(within), F.lit(0)).alias("__salt")).join(cells, dims)
    base = base.select(*cell, "curve", (F.col("__cell") + F.col("__salt")).alias("__base"), "total")
    number = F.row_number().over(Window.partitionBy(*cell).orderBy(*order))
    rows = df.withColumn("__number", number.cast("long") - 1).join(base, cell)
    return rows.withColumn("rank", F.col("__base") + F.col("__number")).drop("__base", "__number")


def code_of(column: Column, bounds: list) -> Column:
    """How many of the rising ``bounds`` are at or below ``column``; null: 0."""
    if not bounds:
        return F.lit(0).cast("long")
    count = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= column))
    return F.when(column.isNull(), 0).otherwise(count).cast("long")


def number_bounds(rows: DataFrame, names: list[str], bits: int) -> list[list]:
    """For each numeric column the values that part its rows into ``2 ** bits`` shares of about equal size."""
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    found = rows.agg(*(F.percentile_approx(n, shares).alias(n) for n in names)).first()
    return [sorted(set(found[n] or [])) for n in names]


def name_bounds(rows: DataFrame, name: str, bits: int) -> list[str]:
    """The same for a column of names, from the rows of each distinct one."""
    counts = rows.groupBy(name).agg(F.count("*").alias("n"))
    order = Window.orderBy(F.asc_nulls_first(name)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    middle = F.sum("n").over(order) - F.col("n") / 2
    coded = counts.withColumn("code", F.floor(middle * (1 << bits) / total)).where(F.col(name).isNotNull())
    firsts = coded.groupBy("code").agg(F.min(name).alias("first")).collect()  # 2 ** bits rows at most
    return sorted(r["first"] for r in firsts)[1:]


def hilbert_shards(docs: DataFrame, shards: int = 16, bits: int = 4) -> DataFrame:
    """Every document with its shard and slot; dimensions: source, size and doc_id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), "source"
    )
    sizes, ids = number_bounds(rows, ["size", "doc_id"], bits)
    rows = rows.select(
        "doc_id",
        "size",
        "text_crc32",
        code_of(F.col("source"), name_bounds(rows, "source", bits)).alias("source_code"),
        code_of(F.col("size"), sizes).alias("size_code"),
        code_of(F.col("doc_id"), ids).alias("id_code"),
        F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SALTS)).alias("salt"),
    )
    placed = ranked(rows, ["source_code", "size_code", "id_code"], bits, ["doc_id", "text_crc32", "size"])
    shard = F.expr(f"(rank * {shards}) div total")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.expr(f"rank - (shard * total + {shards - 1}) div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )
