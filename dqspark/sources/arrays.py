"""Arrays of records read by many tasks: where records begin is found in pieces of the text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from dqspark.sources.work import kept

#: A quote that no string ends with: what follows it follows no value.
OPENING = re.compile(r'"(?=\s*[^\s,:\]}])')
LOOKED_AT = 200  # pieces of a split from which it is told whether the split begins within a string
CHUNKS = ("file string, split long, nth long, text string, starts long, ends long, opens long, "
          "within int, quotes long, deeper_out long, deeper_in long")


def _outside(text: Column) -> Column:
    """Text without its strings, of which the last may be open; escapes are gone already."""
    return F.regexp_replace(text, r'"[^"]*("|$)', "")


def _opened(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("{")))


def _cutter() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What tasks run, with all it uses, so that executors need no copy of this package."""
    def seems_within(pieces: list[str]) -> int:
        """Whether (1 or 0) the first of these pieces seems to begin within a string."""
        text = re.sub(r"(?s)\\.", "", "}".join(pieces))
        found = OPENING.search(text)
        return text.count('"', 0, found.start()) % 2 if found else 0

    class Split:
        """The place in one split: sums of its pieces so far and the pieces of the chunk that has not ended."""

        def __init__(self, file: str, split: int, within: int):
            self.file, self.split, self.within = file, split, within
            self.quotes = self.nth = self.depth = self.least = self.starts = self.opens = 0
            self.deeper = [0, 0]
            self.open_: list[str] = []

        def chunks(self, values: pa.Array, quotes: np.ndarray, opened: np.ndarray, opened_in: np.ndarray) -> Iterator[tuple]:
            """Whole chunks among these pieces: text, depth in front and behind (the split begins at 0), braces opened."""
            before = self.quotes + np.cumsum(quotes) - quotes
            self.quotes += int(quotes.sum())
            for within in (0, 1):
                starts_in, ends_in = (before + within) % 2 == 1, (before + quotes + within) % 2 == 1
                opens = np.where(starts_in, opened_in, opened)
                deeper = opens - ~ends_in
                self.deeper[within] += int(deeper.sum())
                if within == self.within:
                    own, depth = opens, self.depth + np.cumsum(deeper)
            least = np.minimum.accumulate(np.r_[self.least, depth])
            cuts = np.flatnonzero(depth <= least[:-1])
            self.depth, self.least = int(depth[-1]), int(least[-1])
            n, whole = len(values), len(cuts)
            edges = np.r_[0, cuts + 1]
            total = np.r_[0, np.cumsum(own)]
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values), "}").to_pylist()
            opens = np.diff(total[edges])
            if whole:
                texts[0] = "}".join([*self.open_, texts[0]])
                opens[0] += self.opens
                starts = np.r_[self.starts, depth[cuts[:-1]]]
                yield texts, starts, depth[cuts], opens
                self.open_, self.opens, self.starts = [], 0, int(depth[cuts[-1]])
            if edges[-1] < n:
                self.open_.append("}".join(values.slice(int(edges[-1])).to_pylist()))
                self.opens += int(total[-1] - total[edges[-1]])

    def row(at: Split, texts: list, starts, ends, opens) -> pa.RecordBatch:
        n = len(texts)
        none = pa.nulls(n, pa.int64())
        nth = np.arange(at.nth, at.nth + n)
        at.nth += n
        return pa.RecordBatch.from_arrays(
            [pa.array([at.file] * n), pa.array([at.split] * n, pa.int64()), pa.array(nth, pa.int64()), pa.array(texts, pa.string()),
             *[pa.array(np.asarray(x), pa.int64()) for x in (starts, ends, opens)], pa.nulls(n, pa.int32()), none, none, none], names)

    def closed(at: Split | None) -> Iterator[pa.RecordBatch]:
        if at:
            if at.open_:
                yield row(at, ["}".join(at.open_)], [at.starts], [at.depth], [at.opens])
            values = (at.file, at.split, None, None, None, None, None, at.within, at.quotes, *at.deeper)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            file, split = batch.column("file"), np.asarray(batch.column("split"))
            other = np.asarray(pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False), bool) | (split[1:] != split[:-1])
            for x, y in zip(edges := np.r_[0, np.flatnonzero(other) + 1, len(split)], edges[1:]):
                part = batch.slice(int(x), int(y - x))
                values, name, place = part.column("value"), part.column("file")[0].as_py(), int(split[x])
                if at is None or (at.file, at.split) != (name, place):
                    yield from closed(at)
                    given = part.column("given")[0].as_py()
                    at = Split(name, place, given if given is not None else seems_within(values.slice(0, LOOKED_AT).to_pylist()) if place else 0)
                for found in at.chunks(values, *[np.asarray(part.column(c)).astype(np.int64) for c in ("quotes", "opened", "opened_in")]):
                    yield row(at, *found)
        yield from closed(at)

    return run


def _chunks(pieces: DataFrame) -> DataFrame:
    """Pieces of splits, in order, as chunks that end where the depth is the least of their split so far.

    Records end there and nowhere else, wherever the split begins. A row without text holds the sums of
    each split for a begin outside and within a string. Chunks are cut for the one that is ``given`` or,
    if that is null, the one that the first pieces show (``within``).
    """
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    inside = F.regexp_replace(plain, r'^[^"]*("|$)', "")
    counted = pieces.select("file", "split", "value", "given", (F.length(plain) - F.length(F.replace(plain, F.lit('"')))).alias("quotes"),
                            _opened(_outside(plain)).alias("opened"), _opened(_outside(inside)).alias("opened_in"))

    return counted.mapInArrow(_cutter(), CHUNKS)


def _placed(chunks: DataFrame) -> DataFrame:
    """For each split how deep it begins (``ahead``) and whether ``in_string``, from the sums of those before it."""
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sums = chunks.where("text is null").select("file", "split", "within", "quotes", "deeper_out", "deeper_in")
    sums = sums.withColumn("in_string", (F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2).cast("int"))
    deeper = F.when(F.col("in_string") == 1, F.col("deeper_in")).otherwise(F.col("deeper_out"))
    return sums.select("file", "split", "within", "in_string", F.coalesce(F.sum(deeper).over(earlier), F.lit(0)).alias("ahead"))


def read_array(spark: SparkSession, src: str, schema: T.StructType | str, options: dict[str, Any] | None = None) -> DataFrame:
    """The records of files that each hold one JSON array of objects; one file is read by as many tasks as it has splits.

    The text is cut at closing braces, wherever a split begins. Whether a split begins within a string follows from
    the number of quotes in the splits in front of it, how deep it lies from the braces outside strings: both are sums,
    one row for each split. Each task puts the pieces of its split together as it reads them, up to the ends of
    records, so that only records across splits are dealt to other tasks. It takes the state in which its split
    begins from the first quotes; where the sums tell otherwise, the split is cut once more. Compressed files are one split.

    The chunks are written to the shared folder at once, so that the text is read once. A record that does not
    parse is a row of nulls. Files without records give none.
    """
    pieces = spark.read.option("lineSep", "}").text(src).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value", F.lit(None).cast("int").alias("given"))
    read = kept(_chunks(pieces), "pieces")
    places = kept(_placed(read), "places")
    chunks = read.where("text is not null").select("file", "split", "nth", "text", "starts", "ends", "opens")
    wrong = places.where("within <> in_string").select("file", "split", F.col("in_string").alias("given"))
    if not wrong.isEmpty():
        again = chunks.join(F.broadcast(wrong), ["file", "split"]).repartition("file", "split").sortWithinPartitions("file", "split", "nth")
        again = again.select("file", "split", F.explode(F.split("text", "}", -1)).alias("value"), "given")
        chunks = chunks.join(F.broadcast(wrong), ["file", "split"], "left_anti").union(
            _chunks(again).where("text is not null").select(*chunks.columns))
    depth = chunks.join(F.broadcast(places.select("file", "split", "ahead")), ["file", "split"]).select(
        "file", "split", "nth", "text", "opens", (F.col("ahead") + F.col("starts")).alias("starts"), (F.col("ahead") + F.col("ends")).alias("ends"))
    # what follows the last record opens nothing and lies in none
    used = depth.where("starts > 0 or opens > 0")
    whole = used.where("starts <= 0 and ends <= 0").select("text")
    earlier = Window.partitionBy("file").orderBy("split", "nth").rowsBetween(Window.unboundedPreceding, -1)
    across = used.where("starts > 0 or ends > 0").withColumn("record", F.coalesce(F.sum((F.col("ends") <= 0).cast("int")).over(earlier), F.lit(0)))
    parts = F.array_sort(F.collect_list(F.struct("split", "nth", "text")))
    across = across.groupBy("file", "record").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "}").alias("text")).select("text")
    text = F.regexp_replace(F.concat("text", F.lit("}")), r"^[\s,\[\x{feff}]+", "")
    records = whole.union(across).select(text.alias("text"))
    return records.select(F.from_json("text", schema, {k: str(v) for k, v in (options or {}).items()}).alias("record")).select("record.*")
