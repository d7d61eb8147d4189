"""Decontamination: slots, thresholds and odd inputs."""

from pyspark.sql import functions as F

from dqspark.llm import decontam

QUESTION = "A baker sold 24 loaves and Anna bought 7 of them for 3 kg of flour so how many loaves remain on the shelf"


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit("x")).withColumn("h", F.lit(1))
    i = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.key, r.item): r.windows for r in decontam.contaminated(d, i).collect()}
    left = decontam.decontaminated(d, i)
    assert left.columns == d.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(k) for k, t in docs if k not in {x for x, _ in got})
    return got


def test_exchanged_values_are_found_if_they_are_consistent(spark):
    swapped = QUESTION.replace("24", "31").replace("Anna", "Bertha").replace("7", "9").replace("3 kg", "5 lb")
    twice = "Tom ate 4 of the red apples then gave 4 more to the old horse while Tom went home again"
    docs = [(1, "words before " + QUESTION + " words after"), (2, swapped), (3, "nothing of the kind is said in this text at all today"),
            (4, twice.replace("4", "6").replace("and Tom", "and Bob")), (5, twice.replace("4 of", "6 of").replace("4 more", "8 more"))]
    got = found(spark, docs, [(10, QUESTION), (11, twice)])
    assert set(got) == {(1, 10), (2, 10), (4, 11)}


def test_a_short_overlap_is_not_enough(spark):
    words = QUESTION.split()
    docs = [(1, "So " + " ".join(words[:12]) + " end"), (2, "So " + " ".join(words[4:18]) + " end"), (3, " ".join(words).upper())]
    assert set(found(spark, docs, [(1, QUESTION)])) == {(2, 1), (3, 1)}


def test_short_items_and_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "x the quick brown fox jumps y"), (4, "the quick brown fox"), (None, "the quick brown fox jumps"), (6, "1 2 3 4 5 6 7 8"), (3, "x the quick brown fox jumps y")]
    items = [(1, "the quick brown fox jumps"), (2, "the quick"), (3, None), (4, ""), (5, "1 2 3 4 5 6 7 8"), (None, "the quick brown fox jumps"), (1, "the quick brown fox jumps")]
    assert set(found(spark, docs, items)) == {(3, 1), (3, None), (None, 1), (None, None), (3, 2), (4, 2), (None, 2), (6, 5)}


def test_empty_tables_and_the_way_without_broadcast(spark, monkeypatch):
    assert not found(spark, [], [(1, QUESTION)]) and not found(spark, [(1, QUESTION)], [])
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert set(found(spark, [(1, QUESTION * 2), (2, "x " * 5000)], [(1, QUESTION)])) == {(1, 1)}


def test_items_without_literal_windows_are_found_whole(spark):
    sums, name = "12 + 30 = 42 or 12 + 31 = 43", "Anna Bertha Carla Dora Emma Fanny Gerda Hanna Ida Jana"
    docs = [(1, f"It says: {sums}."), (2, sums.replace("42", "41")), (3, f"both {name.upper()} and more"), (4, name[:-5]), (5, "Paris"), (6, "in paris, now"), (7, "?!")]
    assert set(found(spark, docs, [(1, sums), (2, name), (3, "Paris?"), (4, "?")])) == {(1, 1), (3, 2), (5, 3), (6, 3)}


def test_every_verbatim_item_is_found(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    docs = [(i, f"{'Question: ' if i % 2 else 'So it went on. '}{t} That is all.") for i, t in items]
    assert {(i, i) for i, _ in items} <= set(found(spark, docs, items))


def test_many_hits_in_a_long_text(spark):
    """Rows with all words of a text for each of its hits, which one task holds together, would be more than the memory here."""
    items = [(i, " ".join(f"w{'abcdefghij'[j % 10]}{i}x{j}" for j in range(40))) for i in range(50)]
    text = " ".join(t for _, t in items)
    got = found(spark, [(1, " ".join([text] * 10)), (2, "Nothing of it is here")], items)
    assert got == {(1, i): 33 for i, _ in items}


def test_pieces_of_a_text_change_nothing(spark, monkeypatch):
    sums = "1 + 2 = 3 or 2 + 2 = 4 or 3 + 2 = 5 or 4 + 2 = 6"
    docs = [(n, "x " * n + f"So Anna said {QUESTION} and 3 kg of {sums} are all") for n in range(40)]
    items = [(1, QUESTION), (2, sums), (3, "Said"), (4, "kg of 1"), (5, "are all")]
    whole = found(spark, docs, items)
    assert {k for k, _ in whole} == set(range(40)) and {i for _, i in whole} == {1, 2, 3, 4, 5}
    monkeypatch.setattr(decontam, "PIECE", 1)  # as many as the longest item has words
    assert found(spark, docs, items) == whole
