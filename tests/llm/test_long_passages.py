"""Deletion of long passages of one or two lines, beside runs of three."""

import random

from dqspark.llm import lines


def plain(rows, w, least):
    seen, out = set(), {}
    for key, text in rows:
        ls = text.split("\n")
        full = [i for i, x in enumerate(ls) if x.strip(" ")]
        gone = set()
        for width in range(1, w + 1):
            for s in range(len(full) - width + 1):
                run = tuple(ls[i] for i in full[s:s + width])
                if width < w and sum(len(x.split()) for x in run) < least:
                    continue
                if run in seen:
                    gone |= set(range(full[s], full[s + width - 1] + 1))
                seen.add(run)
        out[key] = "\n".join(x for i, x in enumerate(ls) if i not in gone)
    return out


def test_a_long_line_that_stood_earlier_goes(spark):
    passage, half = " ".join(f"w{i}" for i in range(50)), " ".join(f"h{i}" for i in range(25))
    rows = [(1, passage), (2, f"own\n{passage}\nmore"), (3, passage), (4, f"{half}\n\n{half}"), (5, f"x\n{half}\n{half}"),
            (6, half), (7, passage + "!"), (8, passage[:-4])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.removed, r.kept_text) for r in lines.drop_repeated_runs(df, long_words=50).collect()}
    assert got == {1: ([], passage), 2: ([1], "own\nmore"), 3: ([0], ""), 4: ([], rows[3][1]), 5: ([1, 2], "x"), 6: ([], half),
                   7: ([], passage + "!"), 8: ([], passage[:-4])}


def test_equals_brute_force(spark):
    r = random.Random(7)
    some = ("a", "b c", " ", "", "d e f g h", "i j k l m n", "\t", "o p q r s t u v w x")
    rows = [(i, "\n".join(r.choice(some) for _ in range(r.randint(0, 9)))) for i in range(80)]
    for w, least in ((3, 8), (3, 11), (2, 6)):
        got = lines.drop_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"), min_lines=w, long_words=least)
        assert {x.doc_id: x.kept_text for x in got.collect()} == plain(rows, w, least)
