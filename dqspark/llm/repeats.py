"""Removal of repeated byte strings by suffix arrays of shards and their merging."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from dqspark.llm.common import keep, unboxed
from dqspark.llm.suffix import common_prefixes, joined, suffix_array

GRAM = 32                 # bytes of the hashes of which each string's smallest is taken
SHARD_BYTES = 2_000_000   # of the segments of one suffix array, about
CLASSES_A_RANGE = 50_000  # so few strings of split anchors are compared one by one at once
WIDTHS = (32, 4, 1)       # of the ranges of places that are compared across shards, one after another


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each place on (fewer at the end)."""
    h, width = text.astype(np.uint64) + np.uint64(1), 1
    while width < GRAM:
        ahead = np.zeros_like(h)
        ahead[:-width] = h[width:]
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (ahead * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(width))
        h ^= h >> np.uint64(31)
        width *= 2
    return h * np.uint64(0xBF58476D1CE4E5B9)


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each ``w`` neighbouring values, from running minima of blocks in both directions."""
    n = len(h) - w + 1
    padded = np.full(-(-len(h) // w) * w, np.uint64(2**64 - 1))
    padded[:len(h)] = h
    blocks = padded.reshape(-1, w)
    forward = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], forward[w - 1:w - 1 + n])


def segments(raw: bytes, length: int) -> list[tuple[int, int, int, bool]]:
    """(anchor, first, last, again): runs of places at which a ``length``-byte string starts whose smallest hash is the same.

    Equal strings have the same anchor, so they are found among the segments of one anchor. ``again``
    tells that the anchor stands more than once in the segment, which alone can make it repeat itself.
    """
    if len(raw) < length:
        return []
    h = gram_hashes(np.frombuffer(raw, np.uint8))[:len(raw) - GRAM + 1]
    m = window_minima(h, length - GRAM + 1)
    at = np.r_[0, np.flatnonzero(m[1:] != m[:-1]) + 1]
    last, w = np.r_[at[1:] - 1, len(m) - 1], length - GRAM + 1
    again = [np.count_nonzero(h[a:b + w] == x) > 1 for a, b, x in zip(at, last, m[at])]
    return list(zip(m[at].astype(np.int64).tolist(), at.tolist(), last.tolist(), again))


def _raw(t: str | None) -> bytes:
    return t.encode("utf-8", "surrogatepass") if t else b""


def cut(rows: DataFrame, length: int) -> DataFrame:
    """For rows ``rid``, ``text`` the segments: ``anchor``, ``sd`` (hash of the bytes), ``rid``, ``first``, ``last``, ``again``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(6)]
            for rid, t in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist()):
                raw = _raw(t)
                for anchor, first, last, again in segments(raw, length):
                    for column, value in zip(out, (anchor, xxhash.xxh3_64_intdigest(raw[first:last + length]) - 2**63, rid, first, last, again)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.bool_()))],
                                             ["anchor", "sd", "rid", "first", "last", "again"])
    return rows.mapInArrow(run, "anchor long, sd long, rid binary, first int, last int, again boolean")


def fetched(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of wanted segments: ``anchor``, ``sd``, ``weight``, ``parts``, ``bytes``, each once, from one of equal texts."""
    lists = wanted.groupBy(F.col("rid").alias("r")).agg(F.collect_list(F.struct("anchor", "sd", "weight", "parts", "first", "last")).alias("wanted"))

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for t, ws in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                raw = _raw(t)
                for w in ws:
                    for column, value in zip(out, (w["anchor"], w["sd"], w["weight"], w["parts"], raw[w["first"]:w["last"] + length])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                                             ["anchor", "sd", "weight", "parts", "bytes"])
    return rows.dropDuplicates(["rid"]).join(lists, F.col("rid") == F.col("r")).select("text", "wanted").mapInArrow(
        run, "anchor long, sd long, weight long, parts int, bytes binary")


def _runs(places: np.ndarray, length: int) -> list[dict]:
    """Maximal runs of the bytes of the strings that start at sorted places."""
    first = np.r_[True, places[1:] > places[:-1] + length]
    at = np.flatnonzero(first)
    ends = places[np.r_[at[1:] - 1, len(places) - 1]] + length
    return [{"from": int(a), "to": int(b)} for a, b in zip(places[at], ends)]


def in_shards(segs: DataFrame, length: int) -> DataFrame:
    """What the suffix array of each shard finds: ``anchor``, ``sd`` and ``runs`` repeated within the shard.

    An anchor that is dealt over several shards also has a row for each of its segments that holds strings to
    be compared with other shards, with its ``bytes``: ``open`` has the ranges of places (``first``, ``last``) of strings that are alone in
    the shard (``weight`` 1), and of the first of several (2).
    """
    runs_, open_ = (pa.list_(pa.struct([(n, pa.int32()) for n in names])) for names in (("from", "to"), ("first", "last", "weight")))
    kinds = (pa.int64(), pa.int64(), runs_, pa.binary(), open_)
    names = ["anchor", "sd", "runs", "bytes", "open"]

    def run(key, table):
        anchor, sd = np.array(table.column("anchor")), np.array(table.column("sd"))
        weight, parts = np.array(table.column("weight")), np.array(table.column("parts"))
        raw = table.column("bytes").to_pylist()
        text, begins, left = joined(raw)
        sa = suffix_array(text, left)
        lcp = common_prefixes(text, begins, left, sa, length, length)
        whole = left[sa] >= length
        group = np.cumsum(lcp < length)[whole]
        at = sa[whole]
        part = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(text)]))
        owner = part[at]
        # one anchor's strings only: other anchors' strings of the shard never equal them
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        total = np.add.reduceat(weight[owner], starts) if len(starts) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[starts, len(group)])
        repeated = np.repeat(total > 1, sizes)
        p = np.sort(at[repeated])  # parts lie one after another
        o = part[p]
        edges = np.flatnonzero(np.r_[True, o[1:] != o[:-1]]) if len(o) else np.empty(0, np.int64)
        runs = [_runs(p[x:y] - begins[o[x]], length) for x, y in zip(edges, np.r_[edges[1:], len(o)])]
        split = np.flatnonzero(parts[owner[starts]] > 1) if len(starts) else starts
        # of equal strings the first stands for all, so that neighbouring places stay together
        places = np.minimum.reduceat(at, starts)[split] if len(split) else split
        order = np.argsort(places)
        places, times = places[order], np.minimum(total[split], 2)[order]
        cuts = np.flatnonzero(np.r_[True, (places[1:] != places[:-1] + 1) | (times[1:] != times[:-1])]) if len(places) else places
        ranges: dict[int, list[dict]] = {}
        for x, y in zip(cuts, np.r_[cuts[1:], len(places)] - 1):
            i = int(part[places[x]])
            ranges.setdefault(i, []).append({"first": int(places[x] - begins[i]), "last": int(places[y] - begins[i]), "weight": int(times[x])})
        of, n = list(ranges), len(runs)
        columns = (np.r_[anchor[o[edges]], anchor[of]] if of else anchor[o[edges]], np.r_[sd[o[edges]], sd[of]] if of else sd[o[edges]],
                   runs + [None] * len(of), [None] * n + [raw[i] for i in of], [None] * n + list(ranges.values()))
        return pa.table([pa.array(x, k) for x, k in zip(columns, kinds)], names=names)

    return segs.groupBy("shard").applyInArrow(
        run, "anchor long, sd long, runs array<struct<from int, to int>>, bytes binary, open array<struct<first int, last int, weight int>>")


def ranges(held: DataFrame, width: int, length: int) -> DataFrame:
    """The open places of segments in ranges whose strings have the anchor equally far behind their start, or up to ``width`` - 1 bytes farther.

    Gives ``anchor``, ``sd``, ``first``, ``last``, ``weight`` and two digests: ``span`` of all bytes of the range's
    strings, so that equal ones hold the same strings, and ``core`` of the bytes that every string of a
    range ``width`` wide has, so that equal strings are always in ranges of one core.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(7)]
            for anchor, sd, raw, open_ in zip(*(batch.column(c).to_pylist() for c in ("anchor", "sd", "bytes", "open"))):
                h = gram_hashes(np.frombuffer(raw, np.uint8))[:len(raw) - GRAM + 1]
                stands = np.flatnonzero(h.view(np.int64) == anchor)
                for r in open_:
                    places = np.arange(r["first"], r["last"] + 1)
                    at = stands[np.searchsorted(stands, places)]
                    nth = (at - places) // width
                    cuts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (nth[1:] != nth[:-1])])
                    for x, y in zip(cuts, np.r_[cuts[1:], len(places)] - 1):
                        first, last, p, k = int(places[x]), int(places[y]), int(at[x]), int(nth[x])
                        near = p - k * width
                        core = struct.pack("<qi", anchor, k) + raw[near:near - width + 1 + length]
                        span = struct.pack("<qii", anchor, p - first, p - last) + raw[first:last + length]
                        for column, value in zip(out, (anchor, sd, first, last, r["weight"], xxhash.xxh3_128_digest(core), xxhash.xxh3_128_digest(span))):
                            column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["anchor", "sd", "first", "last", "weight", "core", "span"])
    return held.select("anchor", "sd", "bytes", "open").mapInArrow(
        run, "anchor long, sd long, first int, last int, weight int, core binary, span binary")


def merged(held: DataFrame, length: int) -> DataFrame:
    """Strings alone in their shard but not in all shards of their anchor: ``anchor``, ``sd``, ``runs``.

    Equal ranges hold the same strings, each several times. Ranges are done where no others share their core, and
    where each that does stands several times; what is left is cut into narrower ranges, down to single strings.
    So a segment has rows around the places where it begins to differ from others, not for each of its strings.
    """
    runs, todo = None, held
    widths = [w for w in WIDTHS if w <= length // 8]
    while widths:
        width, widths = widths[0], widths[1:]
        places = todo.select(F.aggregate("open", F.lit(0).cast("bigint"), lambda n, r: n + r["last"] - r["first"] + 1).alias("n")).agg(F.sum("n")).first()[0] or 0
        if places <= CLASSES_A_RANGE:
            width, widths = 1, []
        parts = keep(ranges(todo, width, length), "ranges")
        kinds = parts.groupBy("core", "span").agg(F.sum("weight").alias("times"), F.min(F.struct("anchor", "sd", "first", "last")).alias("at"))
        again = parts.where("weight = 1").join(kinds.where("times > 1").select("span"), "span")
        found = again.select("anchor", "sd", F.array(F.struct(F.col("first").alias("from"), (F.col("last") + length).alias("to"))).alias("runs"))
        runs = runs.union(found) if runs else found
        if widths:
            unsure = kinds.groupBy("core").agg(F.count("*").alias("n"), F.min("times").alias("least")).where("n > 1 and least = 1").select("core")
            left = kinds.join(unsure, "core").select("at.*", F.least("times", F.lit(2)).cast("int").alias("weight"))
            left = left.groupBy("anchor", "sd").agg(F.collect_list(F.struct("first", "last", "weight")).alias("open"))
            todo = keep(held.select("anchor", "sd", "bytes").join(left, ["anchor", "sd"]), "unsure")
    return runs


def repeated_spans(rows: DataFrame, length: int) -> DataFrame:
    """For rows ``rid``, ``text``: ``rid`` and ``spans``, the bytes covered by strings that start elsewhere too."""
    # equal texts have equal segments: one row, with the number of texts
    pieces = keep(cut(rows, length).groupBy("rid", "anchor", "sd", "first", "last", "again").agg(F.count("*").alias("n")), "segments")
    distinct = pieces.groupBy("anchor", "sd").agg(F.sum("n").alias("weight"), F.min(F.struct("rid", "first", "last")).alias("at"), F.bool_or("again").alias("again"))
    distinct = keep(distinct.select("anchor", "sd", "weight", F.col("at.rid").alias("rid"), F.col("at.first").alias("first"), F.col("at.last").alias("last"), "again"), "distinct")
    size = F.col("last") - F.col("first") + length
    # a segment whose anchor stands nowhere else has nothing to equal
    anchors = distinct.groupBy("anchor").agg(F.sum("weight").alias("all"), F.sum(size.cast("bigint")).alias("total"), F.bool_or("again").alias("again"),
                                            F.count("*").alias("kinds")).where("all > 1 or again")
    anchors = keep(anchors.select("anchor", "total", F.ceil(F.col("total") / SHARD_BYTES).cast("int").alias("parts"),
                                  (F.expr("kinds = 1 and not again")).alias("sole")), "anchors")
    # equal segments that are all of their anchor have nothing else to equal: their strings stand as often as they do
    sole = distinct.join(anchors.where("sole"), "anchor").select("anchor", "sd", F.array(F.struct(F.lit(0).alias("from"), size.cast("int").alias("to"))).alias("runs"))
    anchors = anchors.where("not sole").drop("sole")
    shards = max(1, -(-(anchors.agg(F.sum("total")).first()[0] or 0) // SHARD_BYTES))
    segs = fetched(rows, distinct.drop("again").join(anchors, "anchor"), length)
    shard = F.pmod(F.xxhash64("anchor", F.pmod("sd", "parts")), F.lit(shards))
    found = keep(in_shards(segs.withColumn("shard", shard), length), "found")
    runs = found.where("runs is not null").select("anchor", "sd", "runs")
    held = found.where("runs is null").select("anchor", "sd", "bytes", "open")
    if not held.isEmpty():
        runs = runs.union(merged(held, length))
    runs = runs.union(sole)
    spans = runs.groupBy("anchor", "sd").agg(F.array_distinct(F.flatten(F.collect_list("runs"))).alias("runs"))
    placed = pieces.join(spans, ["anchor", "sd"]).select("rid", F.transform("runs", lambda r: F.struct(
        (r["from"] + F.col("first")).alias("from"), (r["to"] + F.col("first")).alias("to"))).alias("runs"))
    return placed.groupBy("rid").agg(F.array_distinct(F.flatten(F.collect_list("runs"))).alias("spans"))


def drop_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", length: int = 400) -> DataFrame:
    """All rows with ``n_bytes``, ``n_removed``, ``spans`` (maximal removed runs, from and to), ``kept_bytes`` and ``kept_sha256``.

    Removed is each byte covered by a ``length``-byte string that also starts at another place, in the
    same text, even overlapping, or in another; strings never run over the end of a text. Texts are
    compared as UTF-8 bytes as they were given.

    Places are dealt by the smallest hash within the string that starts there. Runs of places with one
    such anchor are segments; equal segments are one, with a weight. Anchors that stand once are done, and
    those all of whose segments are equal. The others' segments go to shards of bounded size by their anchor; the suffix array of a shard
    orders its strings and Kasai's lengths group them. An anchor with more segments than a shard should
    hold is dealt over several. What their suffix arrays leave alone is compared across them in ranges of
    neighbouring strings, which get narrower where ranges agree in part.

    Null texts are empty; texts shorter than ``length`` lose nothing. Rows that agree in key and text are
    several texts, so each repeats the others. Keys may be null. Columns with the names of new ones are
    replaced. A ``length`` below ``GRAM`` (32) is refused.
    """
    if length < GRAM:
        raise ValueError(f"repeated strings need a length of at least {GRAM} bytes, not {length}")
    rid = F.unhex(F.md5(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")))
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[text].alias("text")).withColumn("rid", rid)
    spans = repeated_spans(rows.select("rid", "text"), length).withColumnRenamed("rid", "r")
    both = rows.join(spans, F.col("rid") == F.col("r"), "left").select("row", "text", "spans")
    span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for t, ss in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                raw, runs = _raw(t), []
                for s in sorted(ss or (), key=lambda s: s["from"]):
                    if runs and s["from"] <= runs[-1]["to"]:
                        runs[-1]["to"] = max(runs[-1]["to"], s["to"])
                    else:
                        runs.append(s)
                ends = [0, *[x for r in runs for x in (r["from"], r["to"])], len(raw)]
                left = b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2]))
                for column, value in zip(out, (len(raw), len(raw) - len(left), runs, left, hashlib.sha256(left).hexdigest())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("row"), *[pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), span, pa.binary(), pa.string()))]],
                                             ["row", "n_bytes", "n_removed", "spans", "kept_bytes", "kept_sha256"])

    new = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
           T.StructField("spans", T._parse_datatype_string("array<struct<from int, to int>>")),
           T.StructField("kept_bytes", T.BinaryType()), T.StructField("kept_sha256", T.StringType())]
    got = both.mapInArrow(run, T.StructType([T.StructField("row", df.schema), *new]))
    return unboxed(got, df.columns, [f.name for f in new])
