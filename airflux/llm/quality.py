"""Quality rules (operator 1), DataFrame functions only.

Two multinomials over ``buckets`` hashed word n-grams (n = 1, 2) are counted: one over the raw
corpus (every document), one over trusted target documents (labels with quality 1 and toxic 0;
a sample of at most ``trusted`` of them, in the order of a hash of doc_id).  A document's score
is the log-likelihood ratio of its n-grams, target over raw, divided by their number, after
Xie et al. (2023).  Documents below ``threshold`` are rejected, as are those that fail base rules.

With ``prior`` the target is smoothed towards the raw distribution, by ``prior`` n-grams a bucket: a
bucket's weight is 0 where the two agree, at any size of target, corpus and table, and a small target
gives weights near 0, so that few labels reject nothing.  Without it one is added to every bucket on
both sides, which by itself shifts frequent n-grams when the target is small.

Counts come from all rows and are summed before the shuffle, so at most ``buckets`` rows a task
move; the weights of all buckets are one array of fixed length, read by the second pass as a
scalar.  No text is shuffled.

Edge cases: null and blank texts have no words, fail the base rules and score 0; doc_id null is
never trusted; a document listed more than once in ``labels`` is trusted if any row trusts it;
with no trusted document all weights are 0; repeated rows count as often as they occur; texts
of any length are read whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words_of, written

BUCKETS, TRUSTED, THRESHOLD, WINDOW = 1 << 16, 4096, -0.16, 5
PRIOR = 4.0  # n-grams a bucket


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def gram_buckets(hashes: Column, buckets: int) -> Column:
    """Buckets of all words and of all pairs of neighbours, from the words' hashes."""
    ones = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    pairs = F.transform(
        F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))),
        lambda h, i: F.pmod(F.xxhash64(F.get(hashes, i), h), F.lit(buckets)).cast("int"),
    )
    return F.concat(ones, pairs)


def repeated_words(hashes: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window of ``width`` words found twice or more."""
    last = F.size(hashes) - width
    windows = F.when(
        last >= 1,
        F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(width)))),
    )

    def places(rows: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(rows, j)["h"] == x["h"], F.lit(False))
        marked = F.transform(rows, lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["i"]))
        return F.array_sort(F.filter(marked, lambda p: p.isNotNull()))

    def covered(at: Column) -> Column:
        step = F.transform(at, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(at, i + 1) - p, F.lit(width))))
        return F.aggregate(step, F.lit(0), lambda a, s: a + s)

    def count(w: Column) -> Column:
        rows = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(
            let(let(rows, places), covered)
        )

    return F.coalesce(let(windows, count), F.lit(0)).cast("long")


def base_columns(docs: DataFrame) -> DataFrame:
    """doc_id, the base figures of each text, and the hashes of its words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) != "")
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text")).select(
        "doc_id",
        "text",
        words_of(F.col("text")).alias("words"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    rows = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        "n_dup_lines",
        F.xxhash64("text").alias("text_hash"),
        word_hashes(F.col("words")).alias("hashes"),
    )
    return rows.withColumn("n_repeat_words", repeated_words(F.col("hashes")))


def gram_weights(docs: DataFrame, labels: DataFrame, buckets: int, trusted: int, prior: float | None = None) -> DataFrame:
    """bucket, weight: log ratio of the target's and the raw corpus's smoothed probability."""
    target = (
        labels.where("quality = 1 and toxic = 0 and doc_id is not null")
        .select(F.col("doc_id").cast("long"))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(trusted)
        .withColumn("trusted", F.lit(1))
    )
    grams = docs.select(
        F.col("doc_id").cast("long"),
        let(word_hashes(words_of(F.col("text"))), lambda h: gram_buckets(h, buckets)).alias("grams"),
    )
    # `target` holds at most `trusted` rows, so it may be sent to all tasks.
    counts = (
        grams.join(F.broadcast(target), "doc_id", "left")
        .select(F.explode("grams").alias("bucket"), "trusted")
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.count("trusted").alias("target"))
    )
    counts = written(counts, "grams")  # one row a bucket at most
    spark = docs.sparkSession
    full = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0)
    sums = full.agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target")).first()
    if prior is None:
        share = lambda c, total: (F.col(c) + 1.0) / F.lit(float((total or 0) + buckets))
        ratio = F.log(share("target", sums["all_target"])) - F.log(share("raw", sums["all_raw"]))
    else:
        # (target + mass * raw / all_raw) / (all_target + mass) over raw / all_raw; no row has a bucket without raw.
        mass = prior * buckets
        found = F.coalesce(F.try_divide("target", "raw"), F.lit(0.0)) * F.lit(float(sums["all_raw"] or 0))
        ratio = F.log((found + F.lit(mass)) / F.lit((sums["all_target"] or 0) + mass))
    return full.select("bucket", (ratio if sums["all_target"] else F.lit(0.0)).alias("weight"))


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    buckets: int = BUCKETS,
    trusted: int = TRUSTED,
    threshold: float = THRESHOLD,
    prior: float | None = None,
) -> DataFrame:
    """doc_id, base figures, base_failed, score, kept and a hash of the text of every document."""
    weights = gram_weights(docs, labels, buckets, trusted, prior)
    rows = base_columns(docs).withColumns(
        {"row_no": F.monotonically_increasing_id(), "grams": gram_buckets(F.col("hashes"), buckets)}
    )
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_hash"]
    # A row's n-grams stay in one task, so their sum is made before the shuffle, which moves one
    # short row a document.  `weights` has `buckets` rows, so it may be sent to all tasks.
    scored = (
        rows.select("row_no", *base, F.explode_outer("grams").alias("bucket"))
        .join(F.broadcast(weights), "bucket", "left")
        .groupBy("row_no")
        .agg(*(F.any_value(c).alias(c) for c in base), F.avg("weight").alias("score"))
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return scored.withColumns({"score": F.coalesce("score", F.lit(0.0)), "base_failed": failed}).select(
        *base[:-1], "base_failed", "score", (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"), "text_hash"
    )
