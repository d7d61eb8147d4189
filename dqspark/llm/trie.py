"""A trie of the prefixes of conversations, by vertical bitmaps of shards."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from dqspark.llm.common import keep, numbered, placed
from dqspark.operators.skew import salted_join

CONVERSATIONS = 1024  # conversations of a shard: the bits of a bitmap
POSITIONS = 128       # positions of a shard's conversations walked in one task


def turns_of(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns as ``conv``, ``turn``, ``token`` (a digest of role and text, null as empty) and ``chars``."""
    role_, text_ = (F.coalesce(turns[c], F.lit("")) for c in (role, text))
    digest = F.sha2(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_), 256)
    return turns.where(turns[conversation].isNotNull()).select(
        turns[conversation].cast("bigint").alias("conv"), turns[turn].cast("bigint").alias("turn"),
        F.unhex(F.substring(digest, 1, 32)).alias("token"), F.length(text_).cast("bigint").alias("chars"))


def in_turn(said: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences as ``conv``, ``k`` (from 1), ``token``, ``chars``; and the conversations with their ``length``."""
    order = [F.asc_nulls_first("turn"), F.asc("token")]
    kept, ranges = placed(keep(said, "turns"), ["conv"], order)
    own = F.row_number().over(Window.partitionBy("part", "conv").orderBy(*order))
    rows = kept.join(ranges.drop("n"), ["part", "conv"]).select("conv", (F.col("ahead") + own).alias("k"), "token", "chars")
    return keep(rows, "said"), ranges.groupBy("conv").agg(F.sum("n").alias("length"))


def with_heads(said: DataFrame, convs: DataFrame, every: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Every conversation begun like the one its id rounds to.

    Conversation c takes the first h turns of c - c % ``every`` (all if fewer, none if absent) in place of
    its own first h, with h = crc32(c as decimal) % (``most`` + 1). A conversation lends at most ``most`` turns.
    """
    base = F.col("conv") - F.col("conv") % every
    h = F.crc32(F.encode(F.col("conv").cast("string"), "UTF-8")) % (most + 1)
    lenders = convs.where(F.col("conv") % every == 0).select(F.col("conv").alias("base"), F.least("length", F.lit(most)).alias("lent"))
    plan = convs.select("conv", "length", base.alias("base"), h.alias("h")).join(lenders, "base", "left").select(
        "conv", "base", "length", "h", F.least("h", F.coalesce("lent", F.lit(0))).alias("head"))
    blocks = said.withColumn("block", F.floor((F.col("k") - 1) / POSITIONS))
    # a long conversation meets its plan once a block of its turns
    spans = blocks.select("conv", "block").groupBy("conv", "block").agg(F.count("*").alias("n")).join(plan, "conv")
    own = blocks.join(spans.select("conv", "block", "h", "head"), ["conv", "block"]).where("k > h").select(
        "conv", (F.col("k") - F.col("h") + F.col("head")).alias("k"), "token", "chars")
    firsts = said.where((F.col("conv") % every == 0) & (F.col("k") <= most)).withColumnRenamed("conv", "base")
    lent = plan.where("head > 0").select("conv", "base", "head").join(firsts, "base").where("k <= head").select("conv", "k", "token", "chars")
    lengths = plan.select("conv", (F.col("head") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("length"))
    return keep(own.unionByName(lent), "rebuilt"), keep(lengths, "lengths")


def _hashed(said: DataFrame) -> DataFrame:
    """Turns with the ``block`` of their place, and two hashes of place and token: those of a prefix are their xor."""
    return said.select("conv", "k", "chars", F.floor((F.col("k") - 1) / POSITIONS).alias("block"),
                       *[F.xxhash64(F.lit(seed), "k", "token").alias(name) for name, seed in (("a", 20), ("b", 21))])


def _blocks(hashed: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for every block of a conversation, one at least: its shard, and the prefix in front of the block."""
    sums = hashed.groupBy("conv", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("chars").alias("chars"))
    ahead = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    entered = sums.select(
        "conv", "block", F.coalesce(F.bit_xor("a").over(ahead), none).alias("entry_a"), F.coalesce(F.bit_xor("b").over(ahead), none).alias("entry_b"),
        F.coalesce(F.sum("chars").over(ahead), none).alias("entry_chars"), F.sum("chars").over(Window.partitionBy("conv")).alias("total"))
    ids = numbered(convs, [], [F.asc("conv")], "rank").select(
        "conv", "length", F.floor((F.col("rank") - 1) / CONVERSATIONS).alias("shard"), ((F.col("rank") - 1) % CONVERSATIONS).cast("int").alias("bit"))
    return ids.join(entered, "conv", "left").fillna(0, ["block", "entry_a", "entry_b", "entry_chars", "total"])


def _bits(bitmap: int) -> Iterator[int]:
    while bitmap:
        low = bitmap & -bitmap
        yield low.bit_length() - 1
        bitmap ^= low


def walk(rows: list[dict]) -> Iterator[dict]:
    """The nodes that conversations of one shard have in one block of positions, depth first.

    The index holds a bitmap of conversations for every (position, turn), and one for every length. The
    children of a node are the intersections of its bitmap with the postings of the next position, each
    found from the lowest conversation not yet in a child. A node: hashes ``a``, ``b`` of the prefix and
    ``pa``, ``pb`` of the parent, ``depth``, ``chars`` of the last turn, ``before`` of the turns in front, and
    the bits of its ``members`` and of those that end in it (``ends``).
    """
    postings, entries, ending = defaultdict(int), {}, defaultdict(int)
    said = defaultdict(dict)
    for r in rows:
        bit = 1 << r["bit"]
        start = entries.setdefault((r["entry_a"], r["entry_b"]), [r["entry_chars"], 0])
        start[1] |= bit
        ending[r["length"]] |= bit
        if r["k"] is not None:
            turn = (r["a"], r["b"], r["chars"])
            postings[r["k"], turn] |= bit
            said[r["bit"]][r["k"]] = turn
    first = rows[0]["block"] * POSITIONS
    for (a, b), (upto, bitmap) in entries.items():
        if first == 0:
            yield dict(a=a, b=b, pa=None, pb=None, depth=0, chars=0, before=0, members=list(_bits(bitmap)), ends=list(_bits(bitmap & ending[0])))
        open_ = [(bitmap, first, a, b, upto)]
        while open_:
            bitmap, depth, a, b, upto = open_.pop()
            rest = bitmap & ~ending[depth]
            while rest and depth < first + POSITIONS:
                turn = said[(rest & -rest).bit_length() - 1][depth + 1]
                child = rest & postings[depth + 1, turn]
                rest ^= child
                x, y, chars = turn
                yield dict(a=a ^ x, b=b ^ y, pa=a, pb=b, depth=depth + 1, chars=chars, before=upto,
                           members=list(_bits(child)), ends=list(_bits(child & ending[depth + 1])))
                open_.append((child, depth + 1, a ^ x, b ^ y, upto + chars))


NODES = ("a long, b long, pa long, pb long, depth long, chars long, before long, n long, conv long, "
         "total long, n_ends long, shard long, ends string")


def _nodes(table: pa.Table) -> pa.Table:
    """The nodes of a shard with their counts, smallest member, characters of all members, and ids that end."""
    rows = table.to_pylist()
    of = {r["bit"]: r for r in rows}
    out = []
    for node in walk(rows):
        members, ends = node.pop("members"), node.pop("ends")
        out.append(node | dict(
            n=len(members), conv=of[members[0]]["conv"], total=sum(of[m]["total"] for m in members), n_ends=len(ends),
            shard=rows[0]["shard"], ends=",".join(str(of[e]["conv"]) for e in ends) or None))
    return pa.Table.from_pylist(out, schema=_schema(NODES))


SUMS = "a long, b long, conv long, owned long, leaves long, top long, top_depth long"


def _sums(table: pa.Table) -> pa.Table:
    """The nodes of a shard with sums over their members, and the first node that the smallest member owns."""
    rows = table.to_pylist()
    of = {r["bit"]: r for r in rows}
    out = []
    for node in walk(rows):
        members = [of[m] for m in node["members"]]
        out.append(dict(a=node["a"], b=node["b"], conv=members[0]["conv"], owned=sum(m["owned"] for m in members),
                        leaves=sum(m["leaf"] for m in members), top=members[0]["top"], top_depth=members[0]["top_depth"]))
    return pa.Table.from_pylist(out, schema=_schema(SUMS))


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, pa.string() if kind == "string" else pa.int64()) for name, kind in (f.split() for f in ddl.split(", "))])


def _digests(batches):
    """One row for each run of equal (a, b): the SHA-256 of its ends, joined by commas, fed row by row."""
    key, digest = None, None
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])
    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if key != (r["a"], r["b"]):
                if digest:
                    done.append(dict(a=key[0], b=key[1], ends_sha256=digest.hexdigest()))
                key, digest = (r["a"], r["b"]), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(r["ends"].encode())
        yield pa.RecordBatch.from_pylist(done, schema=schema)
    if digest:
        yield pa.RecordBatch.from_pylist([dict(a=key[0], b=key[1], ends_sha256=digest.hexdigest())], schema=schema)


def trie(said: DataFrame, convs: DataFrame) -> DataFrame:
    """The distinct prefixes of sequences: a row a node, from the empty root.

    ``said`` holds ``conv``, ``k`` (from 1, without gaps), ``token`` and ``chars``, ``convs`` every ``conv``
    with its ``length``, 0 included; both should be kept tables. Gives ``conv_id`` (the smallest member),
    ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves`` and ``saved_tokens`` (both over the
    subtree; saved: for each node its members but one, times the characters of its last turn) and
    ``ends_sha256`` (of the ids, ascending and comma-joined, of the sequences that are the prefix).

    Shards hold neighbouring ids; a task walks the bitmaps of one shard over one block of positions, and
    equal nodes of shards are added up. No subtree is gathered: a node is owned by its smallest member, so
    what a conversation owns is one path; sums over a subtree are sums over the members of the node of
    what each of them owns, less what the smallest one owns above the node.

    No conversations give no rows. Sequences of equal tokens are members of the same nodes.
    """
    hashed = keep(_hashed(said), "hashed")
    blocks = keep(_blocks(hashed, convs), "blocks")

    def in_shards(blocks: DataFrame, answer, schema: str) -> DataFrame:
        return blocks.join(hashed, ["conv", "block"], "left").groupBy("shard", "block").applyInArrow(answer, schema)

    local = keep(in_shards(blocks, _nodes, NODES), "local-nodes")
    nodes = keep(local.groupBy("a", "b").agg(
        *[F.min(c).alias(c) for c in ("pa", "pb", "depth", "chars", "before", "conv")],
        *[F.sum(c).alias(c) for c in ("n", "total", "n_ends")]), "nodes")
    weights = nodes.groupBy("conv").agg(
        F.sum("chars").alias("owned"), F.max((F.col("n") == F.col("n_ends")).cast("bigint")).alias("leaf"),
        F.min("before").alias("top"), F.min("depth").alias("top_depth"))
    weighed = blocks.join(weights, "conv", "left").fillna(0, ["owned", "leaf", "top", "top_depth"])
    first = F.min(F.struct("conv", "top", "top_depth"))
    sums = in_shards(weighed, _sums, SUMS).groupBy("a", "b").agg(
        F.sum("owned").alias("owned"), F.sum("leaves").alias("n_leaves"), first.alias("first"))
    ended = local.where("ends is not null").select("a", "b", "shard", "ends").repartition("a", "b").sortWithinPartitions(
        "a", "b", "shard").mapInArrow(_digests, "a long, b long, ends_sha256 string")
    children = nodes.where("pa is not null").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    found = keep(nodes.join(sums, ["a", "b"]).join(children, ["a", "b"], "left").join(ended, ["a", "b"], "left").select(
        "a", "b", "pa", "pb", "conv", "depth", "n", F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children"), "n_leaves",
        (F.col("total") - F.col("n") * F.col("before") - F.col("owned") + F.col("before") - F.col("first.top")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        (F.col("depth") == F.col("first.top_depth")).alias("is_top")), "found")
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("parent"))
    tops = salted_join(found.where("is_top"), parents, ["pa", "pb"], "left", ["a", "b"])
    below = found.where("not is_top").withColumn("parent", F.col("conv"))
    return tops.select(*below.columns).unionByName(below).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                rebuilt: bool = False) -> DataFrame:
    """``trie`` of logged conversations, ordered by turn, null first; ``rebuilt``: begun as ``with_heads`` says.

    Null role or text is empty. Turns of equal number are ordered by a digest of role and text, equal rows
    are turns of their own. Turns without conversation belong to none and are left out, as nothing names
    one. Other columns are not read. Texts of any length enter as a digest and a count of characters.
    """
    said, convs = in_turn(turns_of(turns, conversation, turn, role, text))
    if rebuilt:
        said, convs = with_heads(said, convs)
    return trie(said, convs)
