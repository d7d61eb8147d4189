"""MinHash near-duplicates by tensored banding, with exact verification and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from dqspark.llm.common import discard, keep, unboxed
from dqspark.llm.shingles import Words, mix, shingle_set

SIDE = 8          # keys in each of the two collections; tables are their 64 pairs
HASHES_A_KEY = 2  # minima joined into one key of a collection
HASHES = 2 * SIDE * HASHES_A_KEY
PAIRS_A_TASK = 256   # members compared with one copy of a pivot's set
NEAR = 35            # per cent shared with a pivot from which a set is compared by how it differs from the pivot
SLACK = 1e-6         # rounding of sizes times a fraction
ROWS_A_BLOCK = 512   # rows of a table compared with each other at once
SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64))
FACTORS = mix(np.arange(101, HASHES + 101, dtype=np.uint64)) | np.uint64(1)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The upper halves of the minima of all hash functions over a set."""
    low = ((shingles[None, :] ^ SEEDS[:, None]) * FACTORS[:, None]).min(axis=1)
    return (low >> np.uint64(32)).astype("<u4")


def agreement(at_least: int) -> int:
    """Equal minima asked of a candidate: a pair at the threshold has fewer in one case of 20 000 (normal tail)."""
    p = at_least / 100
    return max(1, int(HASHES * p - 4.2 * (HASHES * p * (1 - p)) ** 0.5))


def sketched(df: DataFrame, k: int, text: str = "text") -> DataFrame:
    """Rows as ``row``, with ``n_shingles``, ``sid`` (a digest of the set, null if empty) and ``sig``."""
    names = df.columns
    schema = T.StructType([T.StructField("row", df.schema), T.StructField("n_shingles", T.LongType()),
                           T.StructField("sid", T.BinaryType()), T.StructField("sig", T.BinaryType())])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            row = batch.column(0)
            sizes, ids, sigs = [], [], []
            for t in row.field(names.index(text)).to_pylist():
                s = shingle_set(t, k, words)
                sizes.append(len(s))
                ids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(minima(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [row, pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(sigs, pa.binary())],
                ["row", "n_shingles", "sid", "sig"])

    return df.select(F.struct(*[df[c] for c in names]).alias("row")).mapInArrow(sketch, schema)


def sets_of(texts: DataFrame, k: int) -> DataFrame:
    """``sid`` and ``shingles`` (sorted hashes) of rows ``sid``, ``text``."""
    def full(batches):
        words = Words()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("sid"), pa.array(
                [shingle_set(t, k, words).tobytes() for t in batch.column("text").to_pylist()], pa.binary())],
                ["sid", "shingles"])
    return texts.select("sid", "text").mapInArrow(full, "sid long, shingles binary")


def crossed(rows: DataFrame) -> DataFrame:
    """One row for each set and table: ``table_key`` combines a key of the first collection with one of the second."""
    width = 4 * HASHES_A_KEY
    i, j = F.floor(F.col("t") / SIDE), F.col("t") % SIDE
    first = F.substring(F.col("sig"), i * width + 1, F.lit(width))
    second = F.substring(F.col("sig"), (i * 0 + SIDE + j) * width + 1, F.lit(width))
    return rows.select("sid", "sig", F.explode(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1))).alias("t")).select(
        "sid", F.xxhash64("t", first, second).alias("table_key"))


def verified(pairs: DataFrame, shingles: DataFrame, at_least: int) -> DataFrame:
    """Pairs ``a``, ``b`` with ``linked``, decided on the full sets, and how they differ.

    ``near`` pairs share ``NEAR`` per cent, with ``apart`` the shingles that one of them lacks. ``far``
    pairs share less than that and the distance of a link together.

    Members are sent to their pivot ``a``; a pivot with many members is copied, once for each
    ``PAIRS_A_TASK`` of them, so that no key gathers a whole group.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_A_TASK).cast("int").alias("copies"))
    pivots = many.join(shingles.withColumnRenamed("sid", "a"), "a").select(
        "a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("shingles").alias("of_a"))
    members = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), "copies").cast("int").alias("copy")).join(
        shingles.select(F.col("sid").alias("b"), F.col("shingles").alias("of_b")), "b")

    def decide(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            for x, y in zip(batch.column("of_a"), batch.column("of_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                apart = np.setxor1d(x, y, assume_unique=True)
                union = (len(x) + len(y) + len(apart)) // 2
                both = union - len(apart)
                near = 100 * both >= NEAR * union
                for column, value in zip(out, (len(x), len(y), 100 * both >= at_least * union, near, 100 * both < (NEAR + 100 - at_least) * union,
                                               apart.view(np.int64) if near else None)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *[
                pa.array(column, kind) for column, kind in zip(out, (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(pa.int64())))]],
                ["a", "b", "n_a", "n_b", "linked", "near", "far", "apart"])

    return members.join(pivots, ["a", "copy"]).select("a", "b", "of_a", "of_b").mapInArrow(
        decide, "a long, b long, n_a long, n_b long, linked boolean, near boolean, far boolean, apart array<long>")


def _are_stars(edges: DataFrame) -> bool:
    """Whether each upper end ``u`` has one edge and is no lower end ``v``: lower ends are roots then."""
    ends = edges.select(F.col("u").alias("s"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    crossed = ends.groupBy("s").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1")
    return crossed.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``sid`` and ``root`` of all ends of the edges ``a``, ``b``, kept: their smallest reachable end.

    Alternates large stars and small stars, each a minimum over the rows of one end, dealt once, until
    stars are all there is; every round is kept as a table.
    """
    of_end = Window.partitionBy("u")
    now = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not _are_stars(now):
        both = now.union(now.select("v", "u").toDF("u", "v"))
        large = both.withColumn("m", F.least("u", F.min("v").over(of_end))).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.withColumn("m", F.min("v").over(of_end))
        small = least.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("edge")).select(
            "edge.*").where("u <> v").distinct()
        last, now = now, keep(small, "edges")
        discard(last)
    roots = keep(now.select(F.col("u").alias("sid"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("sid"), F.col("v").alias("root")).distinct()), "roots")
    discard(now)
    return roots


def with_links(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``sid``, ``root`` after further links ``a``, ``b``: only links between two of them are followed."""
    between = links.join(roots.toDF("a", "root_a"), "a", "left").join(roots.toDF("b", "root_b"), "b", "left").select(
        F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).where("a <> b")
    between = keep(between.distinct(), "between")
    if between.isEmpty():
        return roots
    upper = components(between)
    new = keep(roots.join(upper.toDF("root", "above"), "root", "left").select("sid", F.coalesce("above", "root").alias("root")).union(
        upper.join(roots.select("sid"), "sid", "left_anti").select("sid", "root")), "roots")
    discard(between, upper, roots)
    return new


def _unsettled(checked: DataFrame, roots: DataFrame) -> DataFrame:
    """Pivots ``a`` with a near member that links have not brought into their component."""
    of_a, of_b = roots.toDF("a", "root_a"), roots.toDF("b", "root_b")
    near = checked.where("near and not linked").select("a", "b").join(of_b, "b", "left").join(of_a, "a", "left")
    return near.where(F.coalesce("root_b", "b") != F.coalesce("root_a", "a")).select("a").distinct()


def centred(checked: DataFrame, at_least: int) -> tuple[DataFrame, DataFrame]:
    """Sets near one pivot by how they differ from the middle of their star: (``a``, ``b``, ``w``) and their shingles (``a``, ``b``, ``e``).

    Sets that differ from the pivot by Dx and Dy differ from each other by Dx ^ Dy, which stays the same if
    the shingles in which most members differ from the pivot are swapped in all. What is left, of size d, is
    small for most. A link allows a fixed part c of both sizes; ``w`` = d - c n is what a set exceeds its own
    part by.
    """
    c = (100 - at_least) / (100 + at_least)
    members = checked.where("near").select("a", "b", F.col("n_b").alias("n"), "apart")
    crowded = members.groupBy("a").agg(F.count("*").alias("members")).where("members > 1")
    members = keep(members.join(crowded, "a"), "members")
    own = members.select("a", "b", "members", F.explode("apart").alias("e"))
    usual = keep(own.groupBy("a", "e", "members").agg(F.count("*").alias("df")).where("2 * df > members").select("a", "e"), "usual")
    rare = own.join(usual, ["a", "e"], "left_anti").select("a", "b", "e")
    lacking = members.select("a", "b").join(usual, "a").join(own.select("a", "b", "e"), ["a", "b", "e"], "left_anti").select("a", "b", "e")
    shingles = keep(rare.union(lacking), "differences")
    d = shingles.groupBy("a", "b").agg(F.count("*").alias("d"))
    sized = members.select("a", "b", "n").join(d, ["a", "b"], "left").select("a", "b", (F.coalesce("d", F.lit(0)) - c * F.col("n")).alias("w"))
    sized = keep(sized, "sized")
    discard(members, usual)
    return sized, shingles


def links_at_the_middle(sized: DataFrame, shingles: DataFrame) -> DataFrame:
    """Sure links ``a``, ``b``, with one witness for each set or shingle.

    If w of both together is not above 0, their differences cannot add up to too much; the member with
    the smallest w has such a link with every other that has one. If it is not above 2, one shingle that
    both differences hold is enough; of its holders the one with the smallest w links all such others.
    """
    top = F.min(F.struct("w", "b")).alias("top")
    middle = sized.groupBy("a").agg(top)
    sure = sized.join(middle, "a").where("b <> top.b and w + top.w <= 0").select(F.col("top.b").alias("a"), "b")
    held = sized.join(shingles, ["a", "b"])
    witness = held.groupBy("a", "e").agg(top)
    more = held.join(witness, ["a", "e"]).where("b <> top.b and w + top.w <= 2").select(F.col("top.b").alias("a"), "b")
    return sure.union(more).distinct()


def links_by_difference(sized: DataFrame, shingles: DataFrame, roots: DataFrame, at_least: int) -> DataFrame | None:
    """Links ``a``, ``b`` of members outside the component of their star's middle, with one another or with others.

    These need shared differences: 2 |Dx & Dy| >= wx + wy > 0, hence with m shingles left in x that others
    hold and g = 2 m - w both gx >= wy and gy >= wx. A shingle is dropped from a set if no other holder
    fulfils this, which lowers m, and so on until none is; what remains meets in an inverted index, whose
    counts decide the link exactly. None if all members are in the component of their middle.
    """
    root = roots.toDF("r_sid", "r_root")
    named = sized.join(root, F.col("b") == F.col("r_sid"), "left").select("a", "b", "w", F.coalesce("r_root", "b").alias("root"))
    middle = named.groupBy("a").agg(F.min(F.struct("w", "b", "root")).alias("top")).select("a", F.col("top.root").alias("main"))
    named = keep(named.join(middle, "a").select("a", "b", "w", "root", (F.col("root") != F.col("main")).alias("out")), "named")
    if named.where("out").isEmpty():
        return None
    busy = named.where("out").select("a").distinct()
    own = keep(named.join(busy, "a", "left_semi").join(shingles, ["a", "b"]), "left")
    rows = None
    while (left := own.count()) != rows and left:
        rows = left
        sided = own.withColumn("g", 2 * F.count("*").over(Window.partitionBy("a", "b")) - F.col("w"))
        outer = lambda c: F.when(F.col("out"), F.col(c))
        of_e = sided.groupBy("a", "e").agg(
            F.count("*").alias("df"), F.min("w").alias("least_w"), F.max("g").alias("most_g"),
            F.min(outer("w")).alias("least_out_w"), F.max(outer("g")).alias("most_out_g")).where("df > 1 and least_out_w is not null")
        last, own = own, keep(sided.join(of_e, ["a", "e"]).where(
            f"out and w <= most_g + {SLACK} and g >= least_w - {SLACK} "
            f"or w <= most_out_g + {SLACK} and g >= least_out_w - {SLACK}").select("a", "b", "w", "root", "out", "e"), "left")
        discard(last)
    x = own.where("out").select("a", "e", F.col("b").alias("x"), F.col("w").alias("w_x"), F.col("root").alias("root_x"))
    y = own.select("a", "e", F.col("b").alias("y"), F.col("w").alias("w_y"), F.col("root").alias("root_y"))
    met = x.join(y, ["a", "e"]).where("root_x <> root_y").groupBy("a", "x", "y", "w_x", "w_y").agg(F.count("*").alias("both"))
    return met.where(f"2 * both >= w_x + w_y - {SLACK}").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def unlike_blocks(buckets: DataFrame, sets: DataFrame, at_least: int) -> DataFrame:
    """Candidates ``a``, ``b`` of different components among the rows of one bucket (``table_key``, ``sid``, ``root``).

    The rows of a bucket are dealt into blocks by their hashes; two blocks at a time meet in a task,
    which compares minima and sizes and gives the pairs that pass.
    """
    full = buckets.join(sets.select("sid", "sig", "n_shingles"), "sid")
    blocks = buckets.groupBy("table_key").agg(F.ceil(F.count("*") / ROWS_A_BLOCK).cast("int").alias("blocks"))
    dealt = full.join(blocks, "table_key").withColumn("own", F.pmod(F.xxhash64("sid"), "blocks").cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "table_key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "sid", "root", "sig", "n_shingles")
    need = agreement(at_least)

    def compare(key, table):
        lo, hi = key[1].as_py(), key[2].as_py()
        own = np.array(table.column("own"))
        sid, root = table.column("sid").to_pylist(), np.unique(table.column("root").to_pylist(), return_inverse=True)[1]
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u4").reshape(-1, HASHES)
        n = np.array(table.column("n_shingles"))
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        a, b = [], []
        for x in left:
            ys = right[right > x] if lo == hi else right
            ys = ys[(root[ys] != root[x]) & (100 * np.minimum(n[ys], n[x]) >= at_least * np.maximum(n[ys], n[x]))]
            for y in ys[(sig[ys] == sig[x]).sum(axis=1) >= need]:
                p, q = sorted((sid[x], sid[y]))
                a.append(p)
                b.append(q)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return met.groupBy("table_key", "lo", "hi").applyInArrow(compare, "a long, b long").distinct()


def near_roots(rows: DataFrame, k: int, at_least: int, text: str, key: str) -> DataFrame:
    """``sid``, smallest ``key`` and ``root`` (one for each component) of all sets of sketched, kept rows.

    Equal sets are one set from here on, with a number in place of its digest. A set meets others in 64
    tables, whose keys pair each of 8 keys with each of 8 others, so that 32 minima serve for what 128 would be needed for; at the threshold of 85
    a pair shares no table in one of 7 000 cases. In each table the set with most company in all tables is
    the pivot that the rest is compared with, on whole shingle sets. Candidates that stars leave in different
    components are not paired: near the pivot their differences from it are matched, and the few far from
    it are compared block by block. No candidate is left out.
    """
    own = rows.where("sid is not null").select("sid", "sig", "n_shingles", F.col("row").getField(key).alias("key"))
    sets = own.groupBy("sid").agg(F.max("sig").alias("sig"), F.max("n_shingles").alias("n_shingles"), F.min("key").alias("key"))
    sets = keep(sets.select(F.monotonically_increasing_id().alias("sid"), F.col("sid").alias("digest"), "sig", "n_shingles", "key"), "sets")
    crossings = crossed(sets).repartition("table_key")
    shared = crossings.groupBy("table_key").agg(F.count("*").alias("rows")).where("rows > 1")
    buckets = keep(crossings.join(shared, "table_key"), "buckets")
    of_sets = buckets.select("table_key", "sid", "rows").repartition("sid")
    company = of_sets.groupBy("sid").agg(F.sum("rows").alias("company"))
    weighed = of_sets.select("table_key", "sid").join(company, "sid")
    pivots = weighed.groupBy("table_key").agg(F.max(F.struct("company", "sid")).alias("top")).select("table_key", F.col("top.sid").alias("a"))
    stars = buckets.join(pivots, "table_key").where("sid <> a").select("table_key", "sid", "a")
    stars = keep(stars, "stars")
    pairs = keep(stars.select("a", F.col("sid").alias("b")).distinct(), "pairs")

    def sets_for(pairs):
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(sets.select("sid", "digest", "key"), "sid")
        texts = rows.select(F.col("sid").alias("d"), F.col("row").getField(key).alias("k"), F.col("row").getField(text).alias("text")).join(
            wanted, F.col("d").eqNullSafe(F.col("digest")) & F.col("k").eqNullSafe(F.col("key")))
        return keep(sets_of(texts, k).groupBy("sid").agg(F.max("shingles").alias("shingles")), "shingles")

    whole = sets_for(pairs)
    checked = keep(verified(pairs, whole, at_least), "checked")
    discard(whole, pairs)
    roots = components(checked.where("linked").select("a", "b"))
    unsettled = keep(_unsettled(checked, roots), "unsettled")
    if not unsettled.isEmpty():
        sized, shingles = centred(checked.join(unsettled, "a", "left_semi"), at_least)
        roots = with_links(roots, links_at_the_middle(sized, shingles))
        more = links_by_difference(sized, shingles, roots, at_least)
        if more is not None:
            roots = with_links(roots, more)
        discard(sized, shingles)
    # sets far from the pivot of a table can only be linked with others of that table that are not near it
    aside = stars.join(checked.where("far").select("a", F.col("b").alias("sid")), ["a", "sid"], "left_semi").select("table_key", "sid")
    aside = keep(aside.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid")), "aside")
    discard(buckets, stars)
    split = aside.groupBy("table_key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("table_key")
    unlike = keep(aside.join(split, "table_key", "left_semi"), "unlike")
    if not unlike.isEmpty():
        done = checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        rest = keep(unlike_blocks(unlike, sets, at_least).join(done, ["a", "b"], "left_anti"), "rest")
        if not rest.isEmpty():
            roots = with_links(roots, verified(rest, sets_for(rest), at_least).where("linked").select("a", "b"))
    discard(checked, aside, unlike)
    return sets.select("sid", "digest", "key").join(roots, "sid", "left").select(F.col("digest").alias("sid"), "key", F.coalesce("root", "sid").alias("root"))


def near_duplicates(df: DataFrame, k: int = 5, at_least: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All rows with ``n_shingles``, ``component_id`` and ``kept``.

    Two texts are linked if their sets of ``k``-word shingles share ``at_least`` per cent of their union;
    ``component_id`` is the smallest key that links reach, and the row of that key is ``kept``. A text of
    fewer words is one shingle. Null, empty and blank texts have no shingles and no links: they are their
    own component and kept. Null keys are larger than others; a component of null keys alone is null and
    kept. Rows of one key and text are all given back. Columns with the names of new ones are replaced.
    """
    rows = keep(sketched(df, k, text), "sketched")
    rooted = near_roots(rows, k, at_least, text, key)
    lowest = rooted.groupBy("root").agg(F.min("key").alias("component"))
    found = rooted.join(lowest, "root").select(F.col("sid").alias("s"), "component")
    out = rows.join(found, F.col("sid") == F.col("s"), "left").withColumn("own", F.col("row").getField(key))
    out = out.withColumn("component_id", F.when(F.col("sid").isNull(), F.col("own")).otherwise(F.col("component")))
    return unboxed(out.withColumn("kept", F.col("own").eqNullSafe(F.col("component_id"))), df.columns, ["n_shingles", "component_id", "kept"])


def one_of_each(df: DataFrame, k: int = 5, at_least: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows without near-duplicates: one row of each component, the smallest by key, null last.

    Components are those of ``near_duplicates``. Of rows that agree in key and text one stays. Texts without words are kept, all of them.
    """
    rows = keep(sketched(df, k, text).withColumn("uid", F.monotonically_increasing_id()), "sketched")
    found = near_roots(rows, k, at_least, text, key).select(F.col("sid").alias("s"), "root")
    own = F.col("row").getField(key)
    lead = F.struct(own.isNull().alias("none"), own.alias("key"), "sid", "uid")
    best = rows.where("sid is not null").select("sid", "uid", lead.alias("lead")).join(found, F.col("sid") == F.col("s")).groupBy(
        "root").agg(F.min("lead").alias("lead")).select(F.col("lead.uid").alias("best"))
    stay = rows.where("sid is not null").join(best, F.col("uid") == F.col("best"), "left_semi")
    return unboxed(stay.union(rows.where("sid is null")), df.columns, [])
