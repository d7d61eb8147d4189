"""Importance resampling towards a target, with hashed runs of words whose hashes come from prefix CRCs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from dqspark.llm.common import boxed, keep, numbered, row_digest, unboxed
from dqspark.llm.crc import Prefixes

SLICE_BYTES = 4_000_000  # texts scanned together; a longer text is scanned alone
SEPARATOR = 0x20


def _plain() -> np.ndarray:
    """What each byte of a text becomes: capitals small, bytes that are in no word the separator."""
    byte = np.arange(256)
    small = np.where((byte >= 0x41) & (byte <= 0x5A), byte + 32, byte)
    word = ((small >= 0x30) & (small <= 0x39)) | ((small >= 0x61) & (small <= 0x7A)) | (small >= 0x80)
    return np.where(word, small, SEPARATOR).astype(np.uint8)


PLAIN = _plain()


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as bytes, null as empty, some at a time, with the number of texts in front."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts.cast(pa.binary())):
        raw = t.as_py() or b""
        if held and size + len(raw) > SLICE_BYTES:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield first, held


def features(raw: list[bytes], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and of all runs of one to ``longest`` words the text (by number) and the bucket.

    The texts, their words joined by one separator, are one stream that is scanned once. The bucket of a
    run is its CRC-32, derived from the registers at its two ends, modulo ``buckets``.
    """
    stream = PLAIN[np.frombuffer(b" ".join([*raw, b""]), np.uint8)]  # a separator behind each text
    word = stream != SEPARATOR
    behind = ~word
    behind[1:] &= word[:-1]
    behind[:1] = False
    ends_of_texts = np.cumsum([len(r) + 1 for r in raw])
    of = np.searchsorted(ends_of_texts, np.flatnonzero(behind), side="right")
    joined = stream[word | behind]
    end = np.flatnonzero(joined == SEPARATOR)
    start = np.concatenate([[0], end[:-1] + 1])[:len(end)]
    prefixes = Prefixes(joined)
    texts, crcs = [], []
    for n in range(1, longest + 1):
        last = np.arange(n - 1, len(end))
        last = last[of[last] == of[last - n + 1]]
        texts.append(of[last])
        crcs.append(prefixes.crc32(start[last - n + 1], end[last]) % np.uint32(buckets))
    return np.bincount(of, minlength=len(raw)), np.concatenate(texts), np.concatenate(crcs).astype(np.int64)


def bucket_counts(df: DataFrame, text: str = "text", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """``bucket`` and ``n``: features of all texts by bucket; every task sends at most one row a bucket."""
    def count(batches):
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, raw in _slices(batch.column(0)):
                held += np.bincount(features(raw, longest, buckets)[2], minlength=buckets)
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(held[found])], ["bucket", "n"])
    return df.select(df[text].alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(df: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", longest: int = 1,
          buckets: int = 10_000) -> np.ndarray:
    """A thousand times the log ratio of each bucket's share of the target to its share of all texts, rounded down.

    Both counts are smoothed by one. The result holds ``buckets`` numbers, whatever the size of the tables.
    """
    spark = df.sparkSession
    own = bucket_counts(df, text, longest, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    wanted = bucket_counts(target, target_text, longest, buckets).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    none = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), *[F.lit(0).cast("long").alias(c) for c in "st"])
    both = own.unionByName(wanted).unionByName(none).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    counted = both.toArrow().sort_by("bucket")  # one row a bucket
    s, t = (counted.column(c).to_numpy().astype(np.float64) for c in "st")
    ratio = ((t + 1) * (s.sum() + buckets)) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighted(df: DataFrame, gain: np.ndarray, text: str = "text", longest: int = 1, whole: bool = False) -> DataFrame:
    """The rows as ``row`` (without their text unless ``whole``), ``n_words``, ``n_features`` and ``weight``,
    the sum of the gains of the features."""
    buckets = len(gain)

    def weigh(batches):
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for first, raw in _slices(batch.column("text")):
                words, of, bucket = features(raw, longest, buckets)
                here = out[:, first:first + len(raw)]
                here[0] = words
                here[1] = np.bincount(of, minlength=len(raw))
                np.add.at(here[2], of, gain[bucket])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("digest"), *map(pa.array, out)],
                ["row", "digest", "n_words", "n_features", "weight"])

    own = df.select(boxed(df if whole else df.drop(text)), row_digest(df).alias("digest"), df[text].alias("text"))
    schema = StructType(own.schema.fields[:2])
    for name in ("n_words", "n_features", "weight"):
        schema = schema.add(name, "long")
    return own.mapInArrow(weigh, schema)


def gumbel(key: Column, seed: int) -> Column:
    """A thousand times a standard Gumbel draw that key and seed decide, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
              longest: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024,
              whole: bool = False) -> DataFrame:
    """All rows with ``n_features``, ``weight``, ``score`` and ``rank``; the drawn ones look like the target.

    Features are runs of one to ``longest`` words (ASCII letters without case, digits and all bytes above
    ASCII), hashed into buckets. The weight of a text is the log ratio of its features' shares in the target
    and in all texts; the score adds a Gumbel draw, so that the highest scores are a draw without
    replacement by weight. Of the texts of ``least_words`` or more, ``percent`` are drawn; ``rank`` counts
    them from the highest score, ties to the smaller key, null keys last; null for the others. The text
    itself is left out unless ``whole``.

    A null or empty text has no features, weight 0 and is not drawn. Rows without key share one draw. Rows
    that agree in score and key are taken in the order of a hash of the whole row; equal rows are
    interchangeable. An empty target counts as one word in each bucket; an empty table gives no rows. Input
    columns of the new names are replaced. Ranks come from ranges of the order, so no task sees all rows.
    """
    gain = gains(df, target, text, target_text, longest, buckets)
    found = weighted(df, gain, text, longest, whole).withColumn("key", F.col("row").getField(key))
    scored = keep(found.withColumns({
        "fit": F.col("n_words") >= least_words, "score": F.col("weight") + gumbel(F.col("key"), seed)}), "scored")
    drawn = scored.agg(F.count_if("fit").alias("n")).first().n * percent // 100
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_last("key"), F.asc("digest")]
    ranked = numbered(scored, [], order, "place").withColumn("rank", F.when(F.col("place") <= drawn, F.col("place")))
    columns = df.columns if whole else [c for c in df.columns if c != text]
    return unboxed(ranked, columns, ["n_features", "weight", "score", "rank"])
