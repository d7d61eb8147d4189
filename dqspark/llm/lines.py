"""Deletion of line runs that stood earlier, found by winnowing over line hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from dqspark.llm.common import boxed, keep, unboxed


def _windows(h: Column, w: int) -> Column:
    """For each window of ``w`` line hashes its place ``s``, its minimum ``fp`` at ``p``, and ``ends``.

    The rightmost of equal minima counts. ``ends`` hashes the lines on both sides of the fingerprint, so
    that windows agree exactly if fingerprint and ends do.
    """
    def one(s):
        part = F.slice(h, s + 1, F.lit(w))
        least = F.array_min(F.transform(part, lambda x, j: F.struct(x.alias("x"), (-j).alias("j"))))
        return F.struct(s.alias("s"), least["x"].alias("fp"), (s - least["j"]).alias("p"),
                        F.xxhash64(F.lit(5), part, least["j"]).alias("ends"))
    return F.when(F.size(h) >= w, F.transform(F.sequence(F.lit(0), F.size(h) - w), one))


def _words(line: Column) -> Column:
    bare = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+")))


def drop_repeated_runs(df: DataFrame, text: str = "text", key: str = "doc_id", min_lines: int = 3,
                       long_words: int | None = None) -> DataFrame:
    """All rows with ``n_lines``, ``n_removed``, ``removed`` (line numbers from 0) and ``kept_text``.

    A run of ``min_lines`` or more lines that stood earlier, in the same text or in one before it, is
    deleted; its first occurrence stays. Texts come in the order of their keys (null last), then of a
    digest of the text; rows equal in both are one text and lose the same lines. Blank lines (spaces
    only) are passed over when runs are compared, and go if they lie within a deleted run. In runs that
    overlap themselves all but the start goes. With ``long_words``, runs of fewer lines that together
    hold at least so many words, a single line among them, are deleted in the same way.

    Each window of ``min_lines`` lines selects its smallest hash as a fingerprint. Only fingerprints that
    occur at more than one place are followed up: what stands before and after them is compared, and a
    window that agrees with an earlier one marks its lines; marked windows that overlap make longer runs.
    Windows that agree are counted together, never paired.

    A null text has no lines, stays null and loses nothing; an empty one has one blank line. Without
    ``long_words``, texts of fewer lines than ``min_lines`` lose nothing, even if they are exact copies.
    Columns with the names of new ones are replaced.
    """
    columns = df.columns
    lines = F.split(F.col("t"), "\n")
    rows = df.select(boxed(df), df[key].alias("key"), df[text].alias("t")).withColumn("digest", F.xxhash64("t"))
    widths = range(1 if long_words else min_lines, min_lines + 1)
    numbered = F.filter(F.transform(lines, lambda x, i: F.struct(
        i.alias("i"), F.trim(x).alias("x"), F.xxhash64(x).alias("h"), (_words(x) if long_words else F.lit(0)).alias("n"))), lambda x: x["x"] != "")
    hashed = rows.where(F.size(lines) >= widths[0]).select("key", "digest", numbered.alias("lines")).select(
        "key", "digest", *[F.col("lines").getField(f).alias(f) for f in "ihn"])
    at = F.struct(F.col("key").isNull().alias("none"), "key", "digest")

    def of_width(w):
        each = hashed.select(at.alias("at"), "i", "n", F.inline(_windows(F.col("h"), w)))
        if w < min_lines:
            each = each.where(F.aggregate(F.slice("n", F.col("s") + 1, w), F.lit(0), lambda a, x: a + x) >= long_words)
        return each.select("at", F.lit(w).alias("w"), "s", "fp", "p", "ends", F.get("i", F.col("s")).alias("first"),
                           F.get("i", F.col("s") + w - 1).alias("last"))
    windows = keep(reduce(DataFrame.union, map(of_width, widths)), "line-windows")
    place = F.struct("at", "p")
    twice = windows.groupBy("w", "fp").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a < b").select("w", "fp")
    followed = windows.join(twice, ["w", "fp"], "left_semi")
    start = F.struct("at", "s")
    same = ["w", "fp", "ends"]
    firsts = followed.groupBy(*same).agg(F.min(start).alias("a"), F.max(start).alias("b")).where("a < b").select(*same, "a")
    marked = followed.join(firsts, same).where(start > F.col("a"))
    gone = marked.groupBy("at").agg(F.collect_set(F.struct("first", "last")).alias("runs")).select(
        F.col("at.key").alias("key"), F.col("at.digest").alias("digest"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"]))))).alias("removed"))
    out = rows.join(gone.withColumnsRenamed({"key": "gone_key", "digest": "gone_digest"}),
                    F.col("key").eqNullSafe(F.col("gone_key")) & F.col("digest").eqNullSafe(F.col("gone_digest")), "left")
    n = F.coalesce(F.size(lines), F.lit(0))
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    kept = F.when(F.col("removed").isNull(), F.col("t")).otherwise(F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed")), lambda i: F.get(lines, i)), "\n"))
    return unboxed(out.withColumns({
        "n_lines": F.when(F.col("t").isNull(), F.lit(0)).otherwise(n).cast("bigint"),
        "n_removed": F.size(removed).cast("bigint"), "kept_text": kept}).withColumn("removed", removed),
        columns, ["n_lines", "n_removed", "removed", "kept_text"])
