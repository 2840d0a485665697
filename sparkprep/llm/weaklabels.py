"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on each document; expectation-maximisation estimates their accuracies from the
votes of all documents; posterior labels train a hashed linear scorer that judges every whole text.
"""

from __future__ import annotations

import operator
import pickle
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Documents with posterior labels that the scorer is fitted on at most, about; a hash of the text chooses them.
FIT_ROWS = 10_000
FEATURES = 1 << 14
SYMBOLS, TAILS = b"#*$%&|<>{}\\^~", frozenset(b"#*$%&|!<>")
CAPITALS, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
NAMES = ["symbols", "tailed", "marks", "capitals", "variety", "again", "letters", "stops", "lines", "digits", "empty"]
_SHAPE = bytes(57 if 48 <= c < 58 else 65 if 65 <= c < 91 else 97 if 97 <= c < 123 or c >= 128 else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)


def votes_of(text: str | None) -> tuple[list[int], list[bytes]]:
    """The labellers' votes (0 bad, 1 good, 2 abstains) on a whole text, in the order of NAMES, and its words.

    Each labeller knows one kind of defect and they overlap. Below 20 words shares mean little, so there most abstain.
    Distinct words are held against the root of the length, as vocabularies grow. NULL counts as empty.
    """
    raw = (text or "").encode()
    words = raw.split()
    n = max(len(words), 1)
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / n
    kinds = set(words)
    symbols, marks, capitals, digits, stops = share(SYMBOLS), share(b"!?"), share(CAPITALS), share(DIGITS), share(b".,;:")
    tailed = sum(map(TAILS.__contains__, [w[-1] for w in words])) / n
    rich = len(kinds) / n * max(len(words) / 50, 0.02) ** 0.5
    again = sum(map(operator.eq, words, words[1:])) / n
    letters, lines = len(text or "") / n, (raw.count(b"\n") + 1) / n
    long = len(words) >= 20
    vote = lambda good, bad: 0 if bad else 1 if good and long else 2
    return [
        vote(symbols < 0.02, symbols > 0.1),
        vote(tailed < 0.02, tailed > 0.15),
        vote(marks < 0.05, marks > 0.3),
        vote(0.01 <= capitals <= 0.5, capitals > 1.5),
        vote(rich > 0.55, long and rich < 0.3),
        vote(again < 0.02, long and again > 0.2),
        vote(3 <= letters <= 9, letters > 20 or long and letters < 2),
        vote(0.02 <= stops <= 0.4, long and stops > 0.8 or stops < 0.002 and len(words) >= 100),
        vote(lines < 0.2, long and lines > 0.7),
        vote(digits < 0.3, long and digits > 2),
        2 if words else 0,
    ], words


class Hashed(dict):
    """word -> the number of its lower-case form and of its shape among `size` features, packed; forgets when it is full.

    Shapes turn runs of letters and digits into one character.
    """

    def __init__(self, size: int, room: int = 60_000):
        super().__init__()
        self.size, self.room = size, room

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.room:
            self.clear()
        shape = _RUN.sub(rb"\1", word.translate(_SHAPE))
        out = self[word] = crc32(word.lower()) % self.size * self.size + crc32(b"\1" + shape) % self.size
        return out


def features_of(words: list[bytes], known: Hashed) -> np.ndarray:
    """Counts of words, shapes and words that repeat the one before, scaled to length 1."""
    size = known.size
    both = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    out = (np.bincount(both // size, minlength=size) + np.bincount(both % size, minlength=size)).astype(float)
    out[crc32(b"\2") % size] += sum(map(operator.eq, words, words[1:]))
    return out / max(np.sqrt(np.square(out).sum()), 1e-12)


@dataclass
class LabelModel:
    """P(good) and, for each labeller, the chance that it says bad where it votes on a bad and on a good document."""

    prior: float
    names: list[str]
    #: (labeller, class: bad, good)
    says_bad: np.ndarray

    def weights(self) -> np.ndarray:
        """What each vote adds to the log odds of good: (labeller, vote: bad, good)."""
        bad, good = self.says_bad[:, 0], self.says_bad[:, 1]
        return np.stack([np.log(good / bad), np.log((1 - good) / (1 - bad))], axis=1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(good) for rows of votes 0 bad, 1 good, 2 abstain; abstaining says nothing."""
        w = np.concatenate([self.weights(), np.zeros((len(self.names), 1))], axis=1)
        logs = np.log(self.prior / (1 - self.prior)) + sum(w[j, votes[:, j]] for j in range(len(self.names)))
        return 1 / (1 + np.exp(-np.clip(logs, -700, 700)))

    def accuracy(self) -> dict[str, float]:
        """How often each labeller is right where it votes."""
        right = self.says_bad[:, 0] * (1 - self.prior) + (1 - self.says_bad[:, 1]) * self.prior
        return dict(zip(self.names, right.round(4).tolist()))


#: A heuristic is written to raise few false alarms: prior share of bad votes on good documents, and the prior's weight
#: in multiples of the rows. Without it the classes could stand for any other split of the corpus.
FALSE_ALARMS = (0.002, 20.0)


def em(votes: np.ndarray, count: np.ndarray, names: list[str], rounds: int = 200) -> LabelModel:
    """Labeller accuracies from counted vote patterns, given that votes are independent within a class.

    Starts with every document that some labeller calls bad in the bad class.
    """
    n = max(count.sum(), 1.0)
    p = np.where((votes == 0).any(1), 0.2, 0.98)
    model = LabelModel(0.9, names, np.full((votes.shape[1], 2), 0.5))
    bad, good = (votes == 0).astype(float), (votes == 1).astype(float)
    share, strength = FALSE_ALARMS[0], FALSE_ALARMS[1] * n
    for _ in range(rounds):
        is_bad, is_good = count * (1 - p), count * p
        model.prior = float(np.clip(is_good.sum() / n, 1e-4, 1 - 1e-4))
        model.says_bad = np.stack([
            (is_bad @ bad + 1) / (is_bad @ (bad + good) + 2),
            (is_good @ bad + share * strength) / (is_good @ (bad + good) + strength),
        ], axis=1)
        new = model.posterior(votes)
        if np.max(np.abs(new - p), initial=0) < 1e-7:
            break
        p = new
    return model


def pattern(votes: list[int]) -> int:
    """Votes as one number in base 3."""
    return sum(v * 3 ** j for j, v in enumerate(votes))


def unpack(codes: np.ndarray, m: int) -> np.ndarray:
    return (codes[:, None] // 3 ** np.arange(m)) % 3


def fit_label_model(texts: DataFrame) -> tuple[LabelModel, int]:
    """The model from the votes on all texts, and their number. At most 3 ** labellers counts reach the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pattern(votes_of(t.as_py())[0]) for t in batch.column(0)], pa.int32())], names=["votes"])

    found = sorted((r["votes"], r["count"]) for r in texts.mapInArrow(work, "votes int").groupBy("votes").count().collect())
    codes, count = np.array([f[0] for f in found], int), np.array([f[1] for f in found], float)
    return em(unpack(codes, len(NAMES)), count, NAMES), int(count.sum())


def fit_scorer(texts: DataFrame, labels: LabelModel, features: int = FEATURES) -> tuple[np.ndarray, float] | None:
    """Weights and intercept of a logistic scorer over hashed words and shapes, from distinct texts.

    A text with p = P(good) counts for good with weight p and for bad with 1 - p. None if either class has a weight under
    one text.
    """
    sent = cloudpickle.dumps(labels)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = Hashed(features), pickle.loads(sent)
        for batch in batches:
            at, value, p = [], [], []
            for t in batch.column(0):
                votes, words = votes_of(t.as_py())
                x = features_of(words, known)
                at.append(np.nonzero(x)[0])
                value.append(x[at[-1]])
                p.append(float(model.posterior(np.array([votes]))[0]))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float64())), pa.array(p, pa.float64())], names=["at", "value", "p"])

    vector = F.udf(lambda at, value: Vectors.sparse(features, at, value), VectorUDT())
    ready = cut_lineage(texts.mapInArrow(work, "at array<int>, value array<double>, p double").select(vector("at", "value").alias("features"), "p"))
    good, bad = ready.agg(F.sum("p"), F.sum(1 - F.col("p"))).first()
    if min(good or 0, bad or 0) < 1:
        return None
    sides = ready.select("features", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight")),
    )).alias("side")).select("features", "side.label", "side.weight").where("weight > 0.001")
    fit = LogisticRegression(regParam=1e-4, maxIter=25, weightCol="weight", elasticNetParam=0.0).fit(sides)
    return fit.coefficients.toArray(), float(fit.intercept)


def classify(df: DataFrame, text: str = "text", threshold: float = 0.5, rows: int = FIT_ROWS, features: int = FEATURES) -> DataFrame:
    """`df` with the columns posterior, score and kept; columns of these names are replaced.

    `posterior` is the label model's P(good) from the votes, `score` the scorer's; `kept` where `score` is at least
    `threshold`. Accuracies come from the votes on all rows, the scorer's fit from at most about `rows` texts. NULL, empty
    and blank texts have no words to score and are rejected with score 0. If all votes agree on one class there is nothing
    to learn and `score` is the posterior. Rows are neither dropped nor merged.
    """
    keep = [c for c in df.columns if c not in ("posterior", "score", "kept")]
    texts = df.select(F.col(f"`{text}`").cast("string").alias("text"))
    labels, n = fit_label_model(texts)
    # Distinct texts, so that a text with very many copies takes one place.
    share = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, rows / max(n, 1)))
    scorer = fit_scorer(texts.where(share & F.col("text").rlike(r"[^\x20\x09-\x0D]")).dropDuplicates(["text"]), labels, features)
    sent = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps((labels, scorer)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, scorer = pickle.loads(sent.value)
        known = Hashed(features)
        for batch in batches:
            votes, score = [], []
            for t in batch.column(batch.num_columns - 1):
                own, words = votes_of(t.as_py())
                votes.append(own)
                score.append(0.0 if not words else np.nan if scorer is None else float((features_of(words, known) * scorer[0]).sum()) + scorer[1])
            blank = np.array([v[-1] == 0 for v in votes], bool)
            p = model.posterior(np.array(votes, int).reshape(-1, len(NAMES)))
            s = np.where(blank, 0.0, p if scorer is None else 1 / (1 + np.exp(-np.clip(score, -700, 700))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p), pa.array(s), pa.array(s >= threshold)], names=[*keep, "posterior", "score", "kept"])
            pa.default_memory_pool().release_unused()  # idle workers keep what they hold

    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("posterior", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(work, schema)
