"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is cut into runs of ``WORDS`` words; its score is that of its worst run, so a few words in a long text are
not averaged away. Training picks the worst run of each text anew in every round, with a random run beside it for
clean texts. Words unseen in training share character n-grams with seen ones.

Cases: a null, empty or letterless text has one run without n-grams, whose score is that of the bias; repeated rows
get equal scores; an empty table gives an empty result; without training rows of both classes every score is the
share of class 1 (0 if there is none). Columns of the input named like a result column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herdlens.llm import common, subwords

SIZES, BITS, DIM, WORDS = (3, 4, 5, 6), 17, 8, 4
#: Training rows of each class; the rest of the labelled rows is not used.
PER_CLASS = 1000


@dataclass
class Model:
    table: np.ndarray  # logit difference by bucket
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for bag in subwords.bags(texts, SIZES, BITS, subwords.LETTERS_DIGITS, WORDS):
            at, most = subwords.text_max(bag, subwords.segment_scores(bag, self.table)[:, 0])
            out[at] = most
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -40, 40)))


def train(texts: list[str], label: list[int], seed: int = 11) -> Model:
    seen = pd.DataFrame({"text": texts, "label": label}).dropna().drop_duplicates()
    texts, y = seen["text"].tolist(), seen["label"].to_numpy(np.int64)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros((1 << BITS, 1), np.float32), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    data = subwords.rows(texts, SIZES, BITS, subwords.LETTERS_DIGITS, WORDS)
    draw, net = np.random.default_rng(seed), subwords.SubwordSoftmax(2, BITS, DIM)
    cut = np.flatnonzero(np.concatenate([[True], data.text[1:] != data.text[:-1]]))
    until = np.concatenate([cut[1:], [len(data.text)]])
    owner_label = y[data.text[cut]]
    weight = np.where(owner_label == 1, 0.5 / max(1, (owner_label == 1).sum()), 0.5 / max(1, (owner_label == 0).sum()))
    for r in range(min(100, max(25, 50_000 // len(texts)))):  # few texts take more rounds
        table = net.table()
        spread = table[:, 1] - table[:, 0]
        mean = subwords.segment_means(data, spread)
        worst = np.array([a + int(np.argmax(mean[a:b])) for a, b in zip(cut, until, strict=True)])
        if r < 3:  # before the table says anything: any run of the text
            worst = draw.integers(cut, until)
        other = draw.integers(cut, until)
        clean = owner_label == 0
        chosen = np.concatenate([worst, other[clean]])
        target = np.concatenate([owner_label, owner_label[clean]])
        share = np.concatenate([weight, weight[clean]])
        order = draw.permutation(len(chosen))
        for part in np.array_split(order, max(1, len(order) // 64)):
            net.step(data, chosen[part], target[part], share[part], 0.1)
    table = net.table()
    return Model((table[:, 1:] - table[:, :1]).astype(np.float32), float(net.bias[1] - net.bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Train on about ``per_class`` labelled documents of each class outside fold 0.

    Of an id that several rows share one text is trained on, and texts above ``common.MOST_BYTES`` are not, so that what
    reaches the driver is bounded in rows and bytes.
    """
    known = labels.where(~common.held_out("doc_id") & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    chosen = common.sample_per_class(known.select("doc_id", F.col(label).alias("__label__")).distinct(), "doc_id", "__label__", per_class)
    short = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= common.MOST_BYTES)
    joined = short.join(F.broadcast(chosen), "doc_id")  # at most 4 * per_class narrow rows
    one = joined.groupBy("doc_id", "__label__").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = one.select("text", "__label__").toPandas()
    found = found.sort_values(["__label__", "text"])  # the same model whatever the order of tasks
    return train(found["text"].fillna("").tolist(), found["__label__"].tolist())


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with the probability of class 1; narrow, whole texts, no shuffle."""
    return common.append(docs, [T.StructField(column, T.DoubleType())], text, lambda texts: [pa.array(model.score(texts), pa.float64())])
