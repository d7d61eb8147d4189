"""Packing of tokenized documents into sequences: first fit, longest pieces first, in random groups."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from dqspark.llm.common import boxed, keep, unboxed

TEXTS_AT_ONCE = 1_000_000  # characters tokenized together; a longer text is tokenized alone
PIECES_A_GROUP = 4096      # pieces packed together
#: Fixed value: how byte-level BPE splits a text into parts.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of characters whose classes are beyond doubt: printable ASCII, its usual white space, Latin, Greek and Cyrillic letters.
COMMON = re.compile(r"[\t\n\r\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f]*").fullmatch
STEP = 500  # characters; a text with as many in a row and no space, or only white space, may hold very long parts
PACKED = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def _some(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts that are tokenized together."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > TEXTS_AT_ONCE:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if texts:
        yield first, len(texts)


def _long_parts(text: str) -> bool:
    """Whether the text may hold a word or white space of twice ``STEP`` characters, which pattern engines take badly."""
    steps = (text[i:i + STEP] for i in range(0, len(text) - STEP + 1, STEP))
    return any(" " not in s or s.isspace() for s in steps)


class Encoder:
    """Ids of texts by a tokenizer's file. With ``ranks``, a file of the same byte-level vocabulary as ranks, texts
    of characters that all libraries class alike are encoded from it, which costs a third and gives the same ids."""

    def __init__(self, tokenizer: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        self._encoder = Tokenizer.from_file(tokenizer)
        self._special = [str(t) for t in self._encoder.get_added_tokens_decoder().values()]
        self._fast = None
        if ranks:
            import tiktoken
            with open(ranks, "rb") as lines:
                found = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self._fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=found, special_tokens={})

    def __call__(self, texts: Sequence[str]) -> list[np.ndarray]:
        out, rest = [], []
        for i, text in enumerate(texts):
            plain = self._fast and COMMON(text) and not _long_parts(text) and not any(t in text for t in self._special)
            out.append(np.array(self._fast.encode_ordinary(text), np.uint32) if plain else None)
            if not plain:
                rest.append(i)
        for i, found in zip(rest, self._encoder.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = np.array(found.ids, np.uint32)
        return out


def pieces(df: DataFrame, tokenizer: str, text: str = "text", capacity: int = 2048, end: int = 1,
           ranks: str | None = None) -> DataFrame:
    """Tokenized texts cut into pieces of ``capacity`` ids and a shorter last one.

    ``row`` holds the input's columns but the text; ``start``, ``length`` and ``ids`` (binary: unsigned
    32-bit, little-endian) the piece; ``doc_tokens`` all ids of the text with the final ``end``.
    ``tokenizer`` is the path of a tokenizer's file, which every machine has. ``ranks`` is
    that of the same vocabulary as ranks, where there is one.
    """
    def cut(batches):
        encode, last_id = Encoder(tokenizer, ranks), np.array([end], "<u4").tobytes()
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for first, last in _some(texts):
                of, start, ids, total = [], [], [], []
                for i, found in enumerate(encode(texts[first:last]), first):
                    own = found.astype("<u4").tobytes() + last_id
                    for s in range(0, len(own), 4 * capacity):
                        of.append(i)
                        start.append(s // 4)
                        ids.append(own[s:s + 4 * capacity])
                        total.append(len(own) // 4)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(pa.array(of, pa.int64())), pa.array(start, pa.int64()),
                     pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())],
                    ["row", *PACKED[:4]])

    own = df.select(boxed(df.drop(text)), df[text].alias("text"))
    schema = StructType([own.schema["row"]]).add("start", "long").add("length", "long").add("ids", "binary").add("doc_tokens", "long")
    return own.mapInArrow(cut, schema)


def first_fit(lengths: Sequence[int], capacity: int) -> list[int]:
    """The bin of each length, given from the longest: the first one with room.

    The leaves of a tournament tree are the free capacities of the bins, an inner node holds the larger
    of its two; one way down finds the first bin with room, one way up renews the winners.
    """
    leaves = 1 << max(len(lengths) - 1, 0).bit_length()
    free = [capacity] * (2 * leaves)
    chosen = []
    for length in lengths:
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < length:
                node += 1
        chosen.append(node - leaves)
        free[node] -= length
        node //= 2
        while node:
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
            node //= 2
    return chosen


def _without_gaps(bins: list[list[tuple[int, int, int]]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """The bins (piece, first id, ids) with the emptiest cut up to fill the others.

    The one bin that may stay unfilled is cut into sequences of powers of two, which are not padded.
    """
    bins = sorted(bins, key=lambda b: -sum(n for _, _, n in b))
    fill = [sum(n for _, _, n in b) for b in bins]
    i = 0
    while i < len(bins) - 1:
        if fill[i] == capacity:
            i += 1
            continue
        piece, s, n = bins[-1].pop()
        moved = min(n, capacity - fill[i])
        bins[i].append((piece, s + n - moved, moved))
        fill[i] += moved
        fill[-1] -= moved
        if moved < n:
            bins[-1].append((piece, s, n - moved))
        elif not bins[-1]:
            bins.pop()
            fill.pop()
    rest, out = bins[-1] if bins else [], bins[:-1]
    left = sum(n for _, _, n in rest)
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out.append([])
        while room:
            piece, s, n = rest.pop()
            taken = min(n, room)
            out[-1].append((piece, s + n - taken, taken))
            room -= taken
            if taken < n:
                rest.append((piece, s, n - taken))
    return out


def packed(df: DataFrame, tokenizer: str, text: str = "text", capacity: int = 2048, end: int = 1,
           ranks: str | None = None) -> DataFrame:
    """Documents as pieces of token ids, laid into sequences of at most ``capacity`` ids.

    A row a piece: the input's columns but the text, ``start`` (ids of the document before it), ``length``,
    ``ids`` (binary: unsigned 32-bit, little-endian), ``doc_tokens`` (with the final id ``end``),
    ``sequence_id`` and ``offset`` (ids of the sequence before it). Pieces of full length are sequences of
    their own. The last pieces of the documents are dealt to random groups of some ``PIECES_A_GROUP``; in each
    they are packed by first fit, longest first, then the emptiest bins are cut up to fill the gaps of the
    others, and what is left of a group is cut into sequences of powers of two. So no sequence is padded when
    those of a power of two are left as they are.

    A null text is empty; a document always holds its final id. Rows are tokenized once, into a kept table, and
    dealt by their place there, so equal rows and null keys are spread like any others. An empty table gives
    no rows; input columns of the new names are replaced. A text is tokenized whole, in one task's memory.
    """
    kept = keep(pieces(df, tokenizer, text, capacity, end, ranks), "pieces")
    at = F.monotonically_increasing_id()
    full = F.col("length") == capacity
    whole = kept.where(full).withColumn("sequence_id", F.lit(1 << 62) + at).withColumn("offset", F.lit(0).cast("long"))
    groups = max(1, round(kept.where(~full).count() / PIECES_A_GROUP))
    dealt = kept.where(~full).withColumn("at", at).withColumn("group", F.pmod(F.xxhash64("at"), F.lit(groups)).cast("long"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("at", "ascending")])
        lengths = table.column("length").to_pylist()
        bins: list[list[tuple[int, int, int]]] = []
        for piece, (chosen, n) in enumerate(zip(first_fit(lengths, capacity), lengths)):
            if chosen == len(bins):
                bins.append([])
            bins[chosen].append((piece, 0, n))
        ids = table.column("ids").to_pylist()
        of, first, length, sequence, offset = [], [], [], [], []
        for number, held in enumerate(_without_gaps(bins, capacity)):
            filled = 0
            for piece, s, n in held:
                for out, x in zip((of, first, length, sequence, offset), (piece, s, n, number, filled)):
                    out.append(x)
                filled += n
        chosen = table.select(["row", "start", "doc_tokens", "group"]).take(pa.array(of, pa.int64()))
        numbers = np.asarray(sequence, np.int64)
        return pa.table({
            "row": chosen.column("row"), "start": pa.array(chosen.column("start").to_numpy() + np.asarray(first, np.int64)),
            "length": pa.array(length, pa.int64()), "ids": pa.array([ids[p][4 * s:4 * (s + n)] for p, s, n in zip(of, first, length)], pa.binary()),
            "doc_tokens": chosen.column("doc_tokens"),
            "sequence_id": pa.array((chosen.column("group").to_numpy() << 24) + numbers), "offset": pa.array(offset, pa.int64())})

    schema = StructType(kept.schema.fields).add("sequence_id", "long").add("offset", "long")
    rest = dealt.groupBy("group").applyInArrow(pack, schema)
    return unboxed(whole.select(*schema.names).unionByName(rest), [c for c in df.columns if c != text], PACKED)
