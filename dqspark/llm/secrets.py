"""Secret scans: a random forest sorts findings from look-alikes, in DataFrame functions and Spark ML alone."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from dqspark.llm.common import keep

#: A candidate: sixteen or more characters of the alphabets of keys, with a digit among the first forty.
CANDIDATE = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]{0,40}[0-9])[A-Za-z0-9_+/-]{16,}=*"
# Words beside a secret, prefixes of issued keys, parts of paths that hold examples.
BESIDE = "token|secret|password|passwd|pwd|api_?key|apikey|access_?key|private_?key|credential|auth|bearer|aws"
PREFIX = "^(?:AKIA|ASIA|ghp_|gho_|github_pat_|sk_live_|sk-|xox[abp]-|AIza|glpat-|eyJ)"
#: A candidate without a condition on digits: sixteen or more such characters that begin like an issued key.
PREFIXED = rf"(?<![A-Za-z0-9_+/-])(?={PREFIX[1:]})[A-Za-z0-9_+/-]{{16,}}=*"
#: Java only: six or more characters assigned next to one of the words above, up to white space or a quote; if quoted, up to that quote.
ASSIGNED = (r"(?<=[=:\s\"'`])(?<=[=:]\s{0,3}[\"'`]?)(?<=(?i:" + BESIDE + r")[A-Za-z0-9_.-]{0,20}[\"'`]?\s{0,3}[=:]\s{0,3}[\"'`]?)"
            r"(?:(?<=\")[^\s\"]{6,}|(?<=')[^\s']{6,}|(?<=`)[^\s`]{6,}|(?<=[=:\s])[^\s\"'`]{5,}[^\s\"'`.,;:)\]}>])")
FOUND = f"{ASSIGNED}|{CANDIDATE}|{PREFIXED}"
EXAMPLE_PATH = "test|example|sample|fixture|docs?/|mock|demo"
DICTIONARY_DOCUMENTS = 20      # documents a run of letters stands in to count as a word
SAMPLE_ROWS = 4000             # labelled findings of either kind a forest is fitted on at most
TREES, DEPTH = 30, 8
FEATURES = ("length", "digits", "capitals", "others", "transitions", "alphabets", "hex", "entropy", "covered", "beside",
            "assigned", "quoted", "prefixed", "example_path", "separators")


def candidates(df: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = "source") -> DataFrame:
    """``key``, ``digest`` (of the text), ``nth``, ``path``, ``candidate``, ``before`` and ``after``: every candidate of a text, in order.

    Candidates are keys by their alphabet with a digit, keys by their prefix, and values of six or more
    characters that are assigned next to a word for credentials, whatever their characters.
    """
    rows = df.select(df[key].alias("key"), F.xxhash64(df[text]).alias("digest"), df[text].alias("t"),
                     (df[path].cast("string") if path else F.lit(None).cast("string")).alias("path"))
    rows = rows.where(F.col("t").rlike(FOUND))
    # what splits the text between two candidates is behind one and in front of the other
    found = rows.select("key", "digest", "path", F.split("t", FOUND).alias("gaps"), F.regexp_extract_all("t", F.lit(FOUND), F.lit(0)).alias("found"))
    each = found.select("key", "digest", "path", F.posexplode(F.arrays_zip(
        F.col("found"), F.slice("gaps", F.lit(1), F.size("found")).alias("front"), F.slice("gaps", F.lit(2), F.size("found")).alias("back"))).alias("nth", "x"))
    return each.select("key", "digest", "nth", "path", F.col("x.found").alias("candidate"),
                       F.regexp_extract(F.col("x.front"), r"(?:\S+\s+){0,3}\S*$", 0).alias("before"),
                       F.regexp_extract(F.col("x.back"), r"^\S*(?:\s+\S+){0,2}", 0).alias("after"))


def _runs(c: Column) -> Column:
    """The runs of letters of a candidate, in lower case, from three letters on."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0))


def dictionary(df: DataFrame, runs: DataFrame, text: str = "text", documents: int = DICTIONARY_DOCUMENTS) -> DataFrame:
    """Those of the ``run``s that stand as a word in at least so many documents, counted over all of them."""
    words = df.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(df[text]), F.lit(r"\b[a-z]{3,20}\b"), F.lit(0)))).alias("run"))
    return words.join(runs, "run", "left_semi").groupBy("run").agg(F.count("*").alias("n")).where(F.col("n") >= documents).select("run")


def described(found: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """Candidates with their features, kept.

    Length and shares of characters; transitions between alphabets (small, capital, digit, other) for
    each character; entropy of the characters; the share covered by words of the corpus; the words
    beside it; whether it is assigned, quoted, or begins like an issued key; whether the path is one of
    examples.
    """
    c = F.col("candidate")
    n = F.length(c)
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A"), "[^0aA]", "_")
    squeezed = F.regexp_replace(kinds, r"(.)\1+", "$1")
    def share(pattern):
        return F.length(F.regexp_replace(c, pattern, "")) / n
    letters = F.split(c, "")
    entropy = -F.aggregate(F.transform(F.array_distinct(letters), lambda x: F.size(F.filter(letters, lambda y: y == x)) / F.size(letters)),
                           F.lit(0.0), lambda acc, p: acc + p * F.log2(p))
    around = F.lower(F.concat_ws(" ", "before", "after"))
    runs = keep(found.select(F.explode(_runs(c)).alias("run")).distinct(), "runs")
    known = dictionary(docs, runs, text)
    covered = found.select("key", "digest", "nth", F.explode(F.array_distinct(_runs(c))).alias("run")).join(known, "run").groupBy(
        F.col("key").alias("k"), F.col("digest").alias("d"), F.col("nth").alias("m")).agg(F.sum(F.length("run")).alias("letters"))
    joined = found.join(covered, F.col("key").eqNullSafe(F.col("k")) & F.col("digest").eqNullSafe(F.col("d")) & (F.col("nth") == F.col("m")), "left")
    return keep(joined.select(
        "key", "digest", "nth", "path", "candidate", "before", "after",
        n.cast("double").alias("length"), share("[^0-9]").alias("digits"), share("[^A-Z]").alias("capitals"), share("[A-Za-z0-9]").alias("others"),
        ((F.length(squeezed) - 1) / n).alias("transitions"), F.size(F.array_distinct(F.split(kinds, ""))).cast("double").alias("alphabets"),
        c.rlike("^[0-9a-f]+$|^[0-9A-F]+$").cast("double").alias("hex"), entropy.alias("entropy"),
        F.coalesce(F.least(F.col("letters") / n, F.lit(1.0)), F.lit(0.0)).alias("covered"),
        around.rlike(BESIDE).cast("double").alias("beside"), F.col("before").rlike(r"[=:]\s*[\"'`]?$").cast("double").alias("assigned"),
        (F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")).cast("double").alias("quoted"), c.rlike(PREFIX).cast("double").alias("prefixed"),
        F.coalesce(F.lower("path").rlike(EXAMPLE_PATH), F.lit(False)).cast("double").alias("example_path"),
        (F.length(c) - F.length(F.regexp_replace(c, "[_+/-]", ""))).cast("double").alias("separators")).fillna(0.0, list(FEATURES)), "candidates")


def weak_labels(found: DataFrame) -> DataFrame:
    """Labelled findings where none were reviewed: sure cases by rule, the rest without a label.

    A candidate that begins like an issued key, or is assigned next to a word for credentials and mixes
    digits and letters, is a secret (1). Digits alone, and candidates without any such word or prefix
    that are mostly words or mostly one alphabet, are none (0).
    """
    sure = (F.col("prefixed") == 1) & (F.col("entropy") >= 2.5) | (F.col("beside") == 1) & (F.col("assigned") == 1) & F.col("digits").between(0.05, 0.95) & (F.col("entropy") >= 2.5)
    none = (F.col("digits") >= 0.99) | (F.col("beside") == 0) & (F.col("prefixed") == 0) & ((F.col("covered") >= 0.5) | (F.col("transitions") < 0.1))
    return found.withColumn("label", F.when(sure, 1.0).when(none, 0.0)).where("label is not null")


def fitted(labelled: DataFrame, seed: int = 1) -> RandomForestClassificationModel | None:
    """A forest from rows with ``FEATURES`` and ``label``; at most ``SAMPLE_ROWS`` of either label, in the order of a hash.

    None if there are not both labels.
    """
    h = F.xxhash64(F.lit(seed), "candidate", "key", "nth")
    rows = [labelled.where(F.col("label") == x).orderBy(h).limit(SAMPLE_ROWS) for x in (0.0, 1.0)]
    sample = keep(rows[0].union(rows[1]).select("label", *FEATURES), "labelled")
    if sample.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featuresCol="features", labelCol="label").fit(
        VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample))


def scan(df: DataFrame, findings: DataFrame | None = None, text: str = "text", key: str = "doc_id", path: str | None = "source") -> DataFrame:
    """Every candidate of every text with the forest's ``score`` and ``secret`` (from one half).

    ``findings`` are reviewed ones: ``key``, ``candidate``, ``label`` (0 or 1; other values and nulls are
    passed over). Without them the forest learns from ``weak_labels``. With labels of one kind or none,
    the score is null and ``secret`` is 1 for every candidate: nothing is dismissed untrained.

    Null and empty texts have no candidates; a null path is no path of examples; a null key is kept.
    Rows that agree in key and text give their candidates as often as they stand. Candidates come whole,
    whatever their length, with up to three words in front and two behind. Extra columns are not read.
    """
    found = described(candidates(df, text, key, path), df, text)
    if findings is None:
        labelled = weak_labels(found)
    else:
        said = findings.select(findings["key"].alias("k"), findings["candidate"].alias("c"), findings["label"].cast("double").alias("label")).where("label in (0, 1)").distinct()
        labelled = found.join(said, F.col("key").eqNullSafe(F.col("k")) & (F.col("candidate") == F.col("c")))
    model = fitted(labelled)
    out = ["key", "digest", "nth", "candidate", "before", "after", *FEATURES]
    if model is None:
        return found.select(*out, F.lit(None).cast("double").alias("score"), F.lit(1).alias("secret"))
    scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found))
    score = F.get(vector_to_array("probability"), F.lit(1))
    return scored.select(*out, score.alias("score"), (score >= 0.5).cast("int").alias("secret"))
