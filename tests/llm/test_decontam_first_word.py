"""Items whose first word is a name or unit within a document, but not at the beginning of the item."""

from dqspark.llm import decontam


def found(spark, docs, items):
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.key, r.item): r.windows for r in decontam.contaminated(d, i).collect()}
    left = {r.doc_id for r in decontam.decontaminated(d, i).collect()}
    assert left == {k for k, _ in docs} - {k for k, _ in got}
    return got


def test_a_capitalised_first_word_within_a_sentence(spark):
    item = "What is the capital city of France today?"
    docs = [(1, f"Question: {item}"), (2, item), (3, f"It ended. {item}"), (4, f"Question: {item[:-7]} now?"), (5, "so " + item[0].lower() + item[1:])]
    assert found(spark, docs, [(1, item)]) == {(1, 1): 1, (2, 1): 1, (3, 1): 1, (5, 1): 1}


def test_a_first_word_that_is_a_unit_and_the_count_of_windows(spark):
    unit, name = "miles from the old town there was a well", "Anna bought seven of the loaves and later Anna sold all of the bread to her friends"
    docs = [(1, "some 30 " + unit), (2, unit), (3, "then " + name), (4, "then " + name.replace("Anna", "Bertha")),
            (5, "then " + name.replace("Anna", "Bertha", 1))]
    n = len(name.split()) - 7
    got = found(spark, docs, [(1, unit), (2, name)])
    assert got == {(1, 1): 2, (2, 1): 2, (3, 2): n, (4, 2): n}
