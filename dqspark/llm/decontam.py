"""Benchmark decontamination by template canonicalisation, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dqspark.llm.common import boxed, keep, unboxed

WINDOW = 8         # words compared at once; shorter items are one window
LITERALS = 5       # words of a window that must not be placeholders
RUN = 6            # windows of an item that must be found in a row, or all if it has fewer
BROADCAST_ROWS = 200_000  # windows of a benchmark up to which they are sent to every executor: about 20 MB
PIECE = 512        # words of a text handled at once; more if an item without literal windows is longer

# Units that are replaced by a placeholder.
UNITS = ("mm cm m km in ft mi mg g kg lb oz ml l s sec min h hr hrs hours minutes seconds days weeks years miles "
         "meters metres dollars cents euros pounds percent degrees usd eur gbp")
#: A number with its sign, currency, separators and percent sign, among other punctuation.
NUMBER = r'^["(\[]*[-+$€£]?[0-9][0-9.,:/]*%?[")\].,;:!?]*$'
#: A capital, small letters and punctuation: a name unless it begins a sentence.
NAME = r'^["(\[]*[A-Z][a-z]+[")\].,;:!?]*$'
ENDS = r'[.!?][")\]]*$'
#: What is stripped from both ends of a word before it is compared.
EDGES = "\"'()[]{}<>.,;:!?*#$%&|_~`^=+-/@" + "\\"


def words(text: Column) -> Column:
    """The words of a text; of a blank one a single empty word."""
    return F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+")


def bare(w: Column) -> Column:
    return F.lower(F.btrim(w, F.lit(EDGES)))


def _plain(w: Column) -> Column:
    """Most words begin with a small letter, so are no numbers or names: they never meet a pattern."""
    return F.ascii(w).between(97, 122)


def _kind(w: Column, i: Column, before: Column, own: Column) -> Column:
    """The placeholder of a word, null for a literal one; ``own`` is the word without case and edges."""
    return (F.when(~_plain(w) & w.rlike(NUMBER), F.lit("<number>"))
            .when(~_plain(w) & w.rlike(NAME) & (i > 0) & ~before.rlike(ENDS), F.lit("<name>"))
            .when((i > 0) & ~_plain(before) & before.rlike(NUMBER) & own.isin(UNITS.split()), F.lit("<unit>")))


def template(found: Column, bares: Column) -> Column:
    """Each word as (``t``: its placeholder or its lower-cased letters, ``v``: the word if replaced, else null)."""
    kinds = F.transform(found, lambda w, i: _kind(w, i, F.get(found, i - 1), F.get(bares, i)))
    return F.zip_with(kinds, bares, lambda kind, own: F.struct(
        F.coalesce(kind, own).alias("t"), F.when(kind.isNotNull(), own).alias("v")))


def template_hashes(found: Column, bares: Column) -> Column:
    """The hash of each word's placeholder or letters."""
    return F.transform(found, lambda w, i: F.xxhash64(F.coalesce(_kind(w, i, F.get(found, i - 1), F.get(bares, i)), F.get(bares, i))))


def _hashed(tokens: Column) -> Column:
    return F.transform(tokens, lambda x: F.xxhash64(x["t"]))


def _window(h: Column, i: Column, n, exact: bool = False) -> Column:
    """The hash of ``n`` words from place ``i`` (0 is the first)."""
    return F.xxhash64(F.slice(h, i + 1, n), F.lit(exact))


def item_windows(items: DataFrame, key: str, text: str) -> DataFrame:
    """``item``, ``item_at``, ``long``, ``window``, ``part`` (the words) and ``exact`` of what is searched.

    The windows with enough literal words, the first also as it reads within a sentence. An item without such a
    window is searched ``exact``: all its words, found by the first of them.
    """
    # each step is kept: put into one expression, the words of an item would be worked out anew for every word
    found = keep(items.select(items[key].alias("item"), words(items[text]).alias("w")).distinct().withColumn("bares", F.transform("w", bare)), "item-words")
    tokens = keep(found.where(F.exists("bares", lambda x: x != "")).select(
        "item", F.get("w", F.lit(0)).alias("head"), template(F.col("w"), F.col("bares")).alias("tokens"), "bares"), "item-templates")
    tokens = keep(tokens.withColumn("h", _hashed(F.col("tokens"))), "item-hashes")
    n = F.least(F.size("h"), F.lit(WINDOW))
    each = F.when(F.size("h") >= LITERALS, F.transform(F.sequence(F.lit(0), F.size("h") - n), lambda i: F.struct(
        i.alias("item_at"), n.alias("long"), _window(F.col("h"), i, n).alias("window"), F.slice("tokens", i + 1, n).alias("part"))))
    literal = F.filter(each, lambda x: F.size(F.filter(x["part"], lambda y: y["v"].isNull() & (y["t"] != ""))) >= LITERALS)
    made = keep(tokens.select("item", "head", "bares", "h", literal.alias("each")), "item-parts")
    rich = made.where(F.size("each") > 0).select("item", "head", F.inline("each"))
    whole = F.transform("bares", lambda x: F.struct(x.alias("t"), F.lit(None).cast("string").alias("v")))
    poor = made.where(F.coalesce(F.size("each"), F.lit(0)) <= 0).select("item", F.lit(0).alias("item_at"), n.alias("long"), whole.alias("part")).withColumn(
        "window", _window(_hashed(F.col("part")), F.lit(0), F.col("long"), exact=True))

    # within a document's sentence an item's first word is a name, and behind a number a unit
    def begun(kind, holds):
        first = F.get("part", F.lit(0))
        part = F.concat(F.array(F.struct(F.lit(kind).alias("t"), first["t"].alias("v"))), F.slice("part", F.lit(2), F.col("long") - 1))
        return rich.where((F.col("item_at") == 0) & first["v"].isNull() & holds).withColumn("part", part).withColumn(
            "window", _window(_hashed(F.col("part")), F.lit(0), F.col("long")))
    searched = rich.union(begun("<name>", F.col("head").rlike(NAME))).union(begun("<unit>", bare(F.col("head")).isin(UNITS.split()))).drop("head")
    return searched.withColumn("exact", F.lit(False)).unionByName(poor.withColumn("exact", F.lit(True)))


def contaminated(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text",
                 item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Which documents hold which items: ``key``, ``digest``, ``item``, ``windows`` found and ``of`` all.

    Words become placeholders by type: numbers, names (capitalised within a sentence) and units (after a
    number). Windows of eight words of both sides are joined by the hash of this template. Windows of a
    document that stand as far from those of an item are one match. It holds if each value of the item's
    slots is filled by one value throughout (a name or number may be exchanged, but everywhere alike) and
    if at least six windows (thirteen words), or all of the item, are found. The first word of an item is
    compared as it stands and as the name or unit that it is within a sentence of a document.

    Items are searched by windows with five words that are no placeholders. An item of five to eight words is
    one window. An item without such a window, however short, is found where all its words stand in a row,
    but for case and punctuation at their edges; that is one window of one. A null item, or one without
    letters and digits, is found nowhere. Null and blank documents hold nothing. Rows that agree in key and
    text are one document; null keys are kept apart by ``digest``, a hash of the text. Equal items are each found.
    """
    wanted = keep(item_windows(items, item_key, item_text), "item-windows")
    kinds = wanted.groupBy("exact", "long").agg(F.max(F.size("part")).alias("reach")).limit(2 * WINDOW).collect()
    lengths = sorted((r.exact, r.long) for r in kinds) or [(False, WINDOW)]
    reach = max([r.reach for r in kinds], default=WINDOW)
    piece = max(PIECE, reach)
    hashes = wanted.select("window").distinct()
    small = wanted.count() <= BROADCAST_ROWS
    texts = docs.select(docs[doc_key].alias("key"), F.xxhash64(docs[doc_text]).alias("digest"), docs[doc_text].alias("text")).where("text is not null")
    lead = (F.col("start") > 0).cast("int")

    def cut(w, start, ahead):
        """A text's ``piece`` words from ``start``, with the one in front of them, if any, and ``ahead`` that windows of theirs reach into."""
        return F.slice(w, F.greatest(start, F.lit(1)), piece + ahead + 1)

    # hashes first, so that words are only handled for pieces with a hit
    starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(piece))
    ahead = max(n for _, n in lengths) - 1
    found = texts.select("key", "digest", words(F.col("text")).alias("w")).select("key", "digest", F.inline(F.transform(
        starts, lambda at: F.struct(at.alias("start"), cut(F.col("w"), at, ahead).alias("w"))))).withColumn("bares", F.transform("w", bare))
    h = found.select("key", "digest", "start", *[hashed.alias(name) for exact, name, hashed in (
        (False, "h_false", template_hashes(F.col("w"), F.col("bares"))), (True, "h_true", F.transform("bares", lambda x: F.xxhash64(x)))
    ) if exact in {e for e, _ in lengths}])

    def of_length(exact, n):
        own = F.col(f"h_{exact}".lower())
        last = F.least(F.size(own) - n, lead + (piece - 1))
        return F.struct(F.lit(exact).alias("exact"), F.lit(n).alias("long"), F.when(last >= lead, F.transform(
            F.sequence(lead, last), lambda i: _window(own, i, F.lit(n), exact))).alias("windows"))
    each = h.select("key", "digest", "start", F.inline(F.array(*[of_length(exact, n) for exact, n in lengths])))
    hits = keep(each.select("key", "digest", "start", "exact", "long", F.posexplode("windows").alias("i", "window")).join(
        F.broadcast(hashes) if small else hashes, "window").select(
        "key", "digest", "start", "exact", "long", (F.col("start") + F.col("i")).alias("at"), "window").distinct(), "hits")

    held = hits.select(F.col("key").alias("k"), F.col("digest").alias("d")).distinct()
    held = F.broadcast(held) if held.count() <= BROADCAST_ROWS else held
    of_doc = F.col("digest").eqNullSafe(F.col("d")) & F.col("key").eqNullSafe(F.col("k"))
    doc = hits.groupBy(F.col("key").alias("k"), F.col("digest").alias("d"), "start").agg(
        F.collect_list(F.struct("exact", "long", "at", "window")).alias("hits")).groupBy("k", "d").agg(F.collect_list(F.struct("start", "hits")).alias("parts"))
    # texts meet their hits before they are words, and only pieces with hits go on
    found = texts.join(held, of_doc, "left_semi").dropDuplicates(["key", "digest"]).join(doc, of_doc).select(
        "key", "digest", words(F.col("text")).alias("w"), "parts").select("key", "digest", F.inline(F.transform("parts", lambda x: F.struct(
            x["start"].alias("start"), cut(F.col("w"), x["start"], reach - 1).alias("w"), x["hits"].alias("hits"))))).withColumn("bares", F.transform("w", bare))
    plainly = F.transform("bares", lambda x: F.struct(x.alias("t"), F.lit(None).cast("string").alias("v")))
    spoken = found.select("key", "digest", "start", template(F.col("w"), F.col("bares")).alias("tokens"), plainly.alias("plainly"), "hits")
    own = F.slice(F.when(F.col("exact"), F.col("plainly")).otherwise(F.col("tokens")), F.col("at") - F.col("start") + lead + 1,
                  F.when(F.col("exact"), F.lit(reach)).otherwise(F.col("long")))
    met = spoken.select("key", "digest", "start", "tokens", "plainly", F.inline("hits")).select(
        "key", "digest", "exact", "long", "at", "window", own.alias("own")).join(wanted, ["exact", "long", "window"]).withColumn(
        "own", F.slice("own", F.lit(1), F.size("part")))
    fills = F.filter(F.zip_with("part", "own", lambda p, o: F.struct(p["v"].alias("slot"), o["v"].alias("value"))), lambda x: x["slot"].isNotNull())
    same = keep(met.where(F.transform("own", lambda x: x["t"]) == F.transform("part", lambda x: x["t"])).select(
        "key", "digest", "item", (F.col("at") - F.col("item_at")).alias("shift"), fills.alias("fills")), "matches")
    match = ["key", "digest", "item", "shift"]
    broken = same.select(*match, F.explode("fills").alias("f")).groupBy(*match, "f.slot").agg(
        F.min("f.value").alias("x"), F.max("f.value").alias("y")).where("x <> y").select(*[F.col(c).alias(f"b_{c}") for c in match]).distinct()
    whole = same.groupBy(*match).agg(F.count("*").alias("windows")).join(
        broken, [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in match], "left_anti")
    of = wanted.groupBy(F.col("item").alias("of_item")).agg(F.countDistinct("item_at").alias("of"))
    return whole.join(of, F.col("item").eqNullSafe(F.col("of_item"))).where(
        F.col("windows") >= F.least(F.lit(RUN), F.col("of"))).groupBy("key", "digest", "item").agg(
        F.max("windows").alias("windows"), F.max("of").alias("of"))


def decontaminated(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text",
                   item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of documents that hold no item; see ``contaminated``."""
    bad = contaminated(docs, items, doc_key, doc_text, item_key, item_text).select(
        F.col("key").alias("bad_key"), F.col("digest").alias("bad_digest")).distinct()
    rows = docs.select(boxed(docs), docs[doc_key].alias("key"), F.xxhash64(docs[doc_text]).alias("digest"))
    return unboxed(rows.join(bad, F.col("digest").eqNullSafe(F.col("bad_digest")) & F.col("key").eqNullSafe(F.col("bad_key")), "left_anti"),
                   docs.columns, [])
