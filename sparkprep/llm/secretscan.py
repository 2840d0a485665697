"""Secret scans: a random forest removes false positives, in DataFrame functions and Spark ML only.

Candidates are long runs of key characters, and values of any length that are assigned to a secret's name or stand as password
in a URL. The forest sees a candidate's length, its transitions between character
classes, how much of it the corpus's own words cover, the path it lies in, and the words beside it. It is trained from
labelled findings.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import SPACE, word_list

CANDIDATE = r"[A-Za-z0-9+/_\-]{16,}={0,2}"
#: Labelled findings of each class that a fit uses at most, about; a hash of the finding chooses them.
FIT_ROWS = 10_000
FEATURES = [
    "length", "digits", "upper", "lower", "transitions", "distinct", "hex", "covered", "slashes", "key_path", "test_path", "key_before", "hash_before",
    "assigned", "quoted", "login",
]
#: Words that stand beside secrets, and beside harmless identifiers.
KEY_WORDS = r"(?i)(token|secret|passw(or)?d|pwd|api_?-?key|access_?key|auth|credential|bearer|private_?key)"
HARMLESS_WORDS = r"(?i)(sha-?(1|256)?|md5|commit|checksum|digest|etag|uuid|revision|hash|mailto|href|src)"
TEST_PATHS = r"(?i)(test|example|sample|fixture|mock|dummy)"
#: Formats that providers issue.
ISSUED = r"^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^sk_live_[A-Za-z0-9]{16,}$"

#: A value of any length assigned to a secret's name, as end of a word and the two before it; user:password in a URL.
NAME = KEY_WORDS.replace("(?i)", "(?i)(?<![a-z])") + r"(?![a-z])[a-z0-9_.\-]*[\"']?\s*[=:]+"
NAMED = NAME + r"\s*[\"'`]?([^\s\"'`,;=:][^\s\"'`,;]*)[\"'`,;]*$"
#: The group of NAMED that has the value.
VALUE = NAME.count("(") - NAME.count("(?") + 1
LOGIN = r"://[^/\s:@]*:([^/\s@]+)@"


def candidates(df: DataFrame, keys: list[str], text: str, path: str | None) -> DataFrame:
    """(keys, place, word, before, after, path, secret): every candidate of every whole text.

    `place` is the number of the word from 0 and `before` has the two words in front of it.
    """
    cut = df.select(
        *keys, (F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")).alias("path"), word_list(F.col(text).cast("string")).alias("words"),
        F.col(text).cast("string").alias("__text"),
    )

    def word_at(i: Column) -> Column:
        return F.when((i >= 0) & (i < F.size("words")), F.element_at("words", F.greatest(i, F.lit(0)) + 1)).otherwise(F.lit(""))

    long = F.filter(
        F.transform("words", lambda w, i: F.struct(i.alias("place"), w.alias("word"))),
        lambda s: (F.length(s["word"]) >= 16) & s["word"].rlike(CANDIDATE),
    )
    found = cut.select(*keys, "path", "words", F.explode(long).alias("s")).select(
        *keys, "path", F.col("s.place").alias("place"), F.col("s.word").alias("word"),
        F.concat_ws(" ", word_at(F.col("s.place") - 2), word_at(F.col("s.place") - 1)).alias("before"), word_at(F.col("s.place") + 1).alias("after"),
    )
    found = found.withColumn("secret", F.explode(F.array_distinct(F.regexp_extract_all("word", F.lit(f"({CANDIDATE})"), F.lit(1)))))
    # Shorter values, and those with other characters: only texts with a secret's name and a sign, or a login, are cut again.
    some = cut.where(F.col("__text").rlike(f"{NAME}|{LOGIN}"))
    moved = lambda n: F.slice(F.concat(F.array_repeat(F.lit(""), n), "words"), F.lit(1), F.size("words"))
    after = F.concat(F.slice("words", F.lit(2), F.size("words")), F.array(F.lit("")))
    near = F.arrays_zip(F.col("words").alias("word"), moved(2).alias("second"), moved(1).alias("first"), after.alias("after"))
    each = some.where(F.size("words") > 0).select(*keys, "path", F.posexplode(near).alias("place", "s")).select(
        *keys, "path", "place", "s.word", F.concat_ws(" ", "s.second", "s.first").alias("before"), "s.after"
    )
    value = F.array(F.regexp_extract(F.concat_ws(" ", "before", "word"), NAMED, VALUE), F.regexp_extract("word", LOGIN, 1))
    short = each.withColumn("secret", F.explode(F.array_distinct(value))).where((F.col("secret") != "") & ~F.col("secret").rlike(f"^{CANDIDATE}$"))
    return found.unionByName(short)


def letter_triples(df: DataFrame, text: str, share: float = 1e-5) -> DataFrame:
    """(triple): runs of three letters a-z that make up at least `share` of those in the words of all texts; at most 26 ** 3 rows.

    Only words of letters count, so that keys don't enter the dictionary.
    """
    words = df.select(F.explode(F.split(F.lower(F.col(text).cast("string")), SPACE)).alias("w"))
    words = words.select(F.regexp_replace("w", "[.,;:!?]+$", "").alias("w")).where(F.col("w").rlike("^[a-z]{3,15}$")).groupBy("w").count()
    cut = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 2), lambda i: F.substring("w", i, F.lit(3)))).alias("triple"), "count")
    sums = cut_lineage(cut.groupBy("triple").agg(F.sum("count").alias("n")))
    total = sums.agg(F.sum("n")).first()[0] or 0
    return sums.where(F.col("n") >= share * total).select("triple", F.lit(1).alias("known"))


def features(found: DataFrame, triples: DataFrame) -> DataFrame:
    """`found` with the columns FEATURES. Dictionary coverage is worked out once for each different candidate."""
    s, n = F.col("secret"), F.length("secret")

    def share(chars: str) -> Column:
        return F.regexp_count(s, F.lit(chars)) / n

    low = F.lower("secret")
    pieces = found.select("secret").distinct().select(
        "secret", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substring(low, i, F.lit(3)))).alias("triple")
    )
    covered = pieces.join(F.broadcast(triples), "triple", "left").groupBy("secret").agg((F.count("known") / F.count(F.lit(1))).alias("covered"))
    flag = lambda c: c.cast("double")
    return found.join(covered, "secret").withColumns({
        "length": n.cast("double"), "digits": share("[0-9]"), "upper": share("[A-Z]"), "lower": share("[a-z]"),
        "transitions": share("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "distinct": F.size(F.array_distinct(F.split(s, ""))) / n, "hex": flag(s.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
        "slashes": flag(F.regexp_count("word", F.lit("/"))), "key_path": flag(F.col("path").rlike(KEY_WORDS)), "test_path": flag(F.col("path").rlike(TEST_PATHS)),
        "key_before": flag(F.concat_ws(" ", "before", F.substring_index("word", "=", 1)).rlike(KEY_WORDS)),
        "hash_before": flag(F.concat_ws(" ", "before", "word").rlike(HARMLESS_WORDS)),
        "assigned": flag(F.concat_ws(" ", "before", "word").rlike("[=:]")), "quoted": flag(F.col("word").rlike("[\"'`]")),
        "login": flag(F.col("word").rlike(LOGIN)),
    })


def label_findings(found: DataFrame) -> DataFrame:
    """Findings with a certain label: 1 for formats that providers issue, keys assigned to a secret's name and passwords in URLs, 0 for letters
    only, digits only, identifiers named as hashes, mail addresses, and URLs without a part that looks like a key. All others are left out; they
    are what the forest decides on."""
    s = F.col("secret")
    beside = F.concat_ws(" ", "before", "word")
    mixed = s.rlike("[0-9]") & s.rlike("[A-Za-z]")
    assigned = beside.rlike(NAMED) & (F.regexp_extract(beside, NAMED, VALUE) == s)
    password = F.regexp_extract("word", LOGIN, 1) == s
    named = mixed & (assigned | beside.rlike(KEY_WORDS.replace("(?i)", "(?i)\\b") + r"[\"']?\s*[=:]\s*[\"']?[A-Za-z0-9+/_\-]{16,}"))
    issued = F.exists(F.split(s, "/"), lambda part: part.rlike(ISSUED))
    keylike = F.exists(F.split(s, "/"), lambda part: (F.length(part) >= 16) & part.rlike("[0-9]") & part.rlike("[A-Za-z]"))
    plain = s.rlike("^[A-Za-z_-]+$") & (F.lower(s) == s) | s.rlike("^[0-9-]+$") | F.col("word").rlike("^[^/:]*@") | F.col("word").rlike("@|://|^www[.]") & ~keylike
    uuid = s.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
    harmless = plain | uuid | mixed & F.col("before").rlike(HARMLESS_WORDS) & ~beside.rlike(KEY_WORDS)
    label = F.when(issued | named | password, F.lit(1.0)).when(harmless & ~assigned, F.lit(0.0))
    return found.withColumn("label", label).where("label IS NOT NULL")


def fit_forest(labelled: DataFrame, rows: int = FIT_ROWS, trees: int = 20, depth: int = 6) -> PipelineModel | None:
    """A forest from a table with FEATURES and `label`; None without findings of both classes.

    Equal findings count once. Classes are weighted to the same sum.
    """
    each = labelled.dropDuplicates(["secret", *FEATURES[8:], "label"])
    counts = {r["label"]: r["count"] for r in each.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    at = F.when(F.col("label") == 1, F.lit(min(1.0, rows / counts[1.0]))).otherwise(F.lit(min(1.0, rows / counts[0.0])))
    picked = cut_lineage(each.where(F.pmod(F.xxhash64("secret", "before", "word"), F.lit(1_000_000)) < F.lit(1_000_000) * at).select(*FEATURES, "label"))
    seen = {r["label"]: r["count"] for r in picked.groupBy("label").count().collect()}
    if len(seen) < 2:
        return None
    even = picked.withColumn("weight", F.when(F.col("label") == 1, F.lit(1 / seen[1.0])).otherwise(F.lit(1 / seen[0.0])) * sum(seen.values()))
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, weightCol="weight", featureSubsetStrategy="sqrt")
    return PipelineModel([vector, forest.fit(vector.transform(even))])


def scan(
    df: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", path: str | None = "source", findings: DataFrame | None = None,
    threshold: float = 0.5, rows: int = FIT_ROWS,
) -> DataFrame:
    """(keys, place, secret, score) of the candidates that the forest takes for secrets, one row per candidate and word.

    `findings` may bring labelled findings (secret, word, before, after, path, label); else those of `df` with a certain
    label train the forest. If one class is missing there is nothing to learn and no candidate is removed (score NULL).
    NULL and empty texts have no candidates; repeated rows are reported each; key columns may be NULL. Keys must not be
    named like the other columns of the result.
    """
    found = cut_lineage(candidates(df, list(keys), text, path))
    triples = letter_triples(df, text)
    ready = cut_lineage(features(found, triples))
    model = fit_forest(label_findings(ready) if findings is None else features(findings, triples), rows)
    if model is None:
        return ready.select(*keys, "place", "secret", F.lit(None).cast("double").alias("score"))
    scored = model.transform(ready).withColumn("score", F.element_at(vector_to_array("probability"), 2))
    return scored.where(F.col("score") >= threshold).select(*keys, "place", "secret", "score")
