"""The network's gradients, its accuracy on held-out documents, and odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from dqspark.llm import gru, queries, toxicity

SF = "/root/testdata/sf0.1"


def test_gradients_equal_differences():
    p = {k: v.astype(np.float64) for k, v in gru.start(1).items()}
    words = gru.Vocabulary()
    windows = np.array([words.places("a bb ccc dd".split()) + [0], words.places("zz a".split()) + [0, 0, 0]])
    known = words.features()

    def total():
        return gru.forward(p, gru.project(p, gru.inputs(p, known).astype(np.float64)), windows).sum()

    x = gru.inputs(p, known)
    gates = gru.project(p, x.astype(np.float64))
    _, traced = gru.forward(p, gates, windows, trace=True)
    grad, dgates = gru.backward(p, gates, windows, traced, np.ones(2))
    grad |= gru.word_gradients(p, x, known, dgates)
    for name, g in grad.items():
        flat, i = p[name].reshape(-1), int(np.abs(g).argmax())
        here = flat[i]
        flat[i] = here + 1e-2
        up = total()
        flat[i] = here - 1e-2
        down = total()
        flat[i] = here
        assert abs(g.reshape(-1)[i] - (up - down) / 2e-2) < 1e-2 * max(1, abs(g.reshape(-1)[i])), name


def test_features_do_not_depend_on_company():
    one, many = gru.Features.of([b"abc"]), gru.Features.of([b"x", b"abc", b"defghij"])
    second = many.some(np.array([1]))
    assert one.ids[0] == second.ids[0] and sorted(one.grams) == sorted(second.grams)


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        w = toxicity.windows_of(list(range(1, n + 1)))
        assert set(w.reshape(-1)) - {0} == set(range(1, n + 1))


def test_held_out_fold(spark):
    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    for r in df.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_a_marker_word_is_learnt_and_odd_rows_are_scored(spark):
    r = np.random.default_rng(3)
    plain = [f"{a}{b}" for a in ("ta", "mo", "re", "li") for b in ("ne", "so", "ka", "pi", "du")]

    def text(n, bad):
        w = [plain[i] for i in r.integers(0, len(plain), n)]
        for _ in range(bad):
            w.insert(int(r.integers(0, n)), "grumph" + plain[r.integers(0, 5)])
        return " ".join(w)

    rows = [(i, text(int(r.integers(10, 120)), 4 * (i % 3 == 0))) for i in range(300)]
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (None, text(40, 5)), (902, text(5000, 0)), (903, text(5000, 150))], "doc_id long, text string")
    docs = docs.withColumn("score", F.lit("old")).withColumn("toxic", F.lit(1))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fitted(docs, labels)
    got = {x.doc_id: x for x in toxicity.scored(docs, model).collect()}
    assert len(got) == 305 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got.values())
    wrong = sum(got[i].predicted != (i % 3 == 0) for i in range(300))
    assert wrong <= 6 and got[903].predicted == 1 and got[902].predicted == 0 and got[None].predicted == 1
    assert got[900].score == got[901].score
    assert toxicity.scored(docs.limit(0), model).count() == 0


def test_labels_of_one_kind(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    for rows, want in (([], 0.0), ([(2, 1), (1, 1)], 1.0)):
        model = toxicity.fitted(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert {x.score for x in toxicity.scored(docs, model).collect()} == {want}


def test_held_out_documents_are_told_apart(spark):
    got = {x.doc_id: x for x in queries.QUERIES["op7_toxicity_gru"](spark, SF).collect()}
    toxic = {x.doc_id: x.toxic for x in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(got[k].score, y) for k, y in toxic.items() if got[k].held_out]
    hits = [s > t for s, y in held if y for t, z in held if not z]
    assert sum(hits) / len(hits) > 0.9  # area under the curve
