"""Many equal texts: their segments are handled once, with a weight."""

import random
from collections import Counter

from pyspark.sql import functions as F

from dqspark.llm import repeats
from test_repeats import plain


def test_equal_texts_are_fetched_and_placed_once(spark, monkeypatch):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9)))
    base = [word() for _ in range(200)]
    edited = [*base[:100], "edited", *base[101:]]
    texts = [" ".join(base)] * 40 + [" ".join(edited)] + [" ".join(word() for _ in range(60)) for _ in range(5)]
    sizes, kept, shards = {}, repeats.keep, repeats.in_shards

    def counted(df, purpose):
        out = kept(df, purpose)
        sizes[purpose] = out.count()
        return out

    def watched(segs, length):
        sizes["fetched"] = segs.count()
        return shards(segs, length)

    monkeypatch.setattr(repeats, "keep", counted)
    monkeypatch.setattr(repeats, "in_shards", watched)
    rows = list(enumerate(texts))
    got = Counter((x.doc_id, x.n_bytes, x.n_removed, len(x.spans), x.kept_sha256)
                  for x in repeats.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=60).collect())
    assert got == Counter((k, *x) for (k, _), x in zip(rows, plain(texts, 60)))
    once = sum(len(repeats.segments(t.encode(), 60)) for t in dict.fromkeys(texts))
    assert sizes["segments"] == once
    assert 0 < sizes["fetched"] <= sizes["distinct"]
