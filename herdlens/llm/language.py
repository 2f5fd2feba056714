"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy, with rejection.

The temperature of the softmax and the rejection threshold are set on training rows kept aside: the threshold is the
lowest score that leaves the asked share of them right. ``lang_pred`` is always the best learned language;
``rejected`` says that the score lies below the threshold.

Cases: a null text, or one without any letter, is ``und`` with score 0 and rejected; equal texts get equal results;
scores that tie go to the language first in order; without training rows everything is ``und``; an empty table gives
an empty result. Columns of the input named like a result column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herdlens.llm import common, subwords

SIZES, BITS, DIM = (2, 3, 4), 15, 12
#: Training rows of each language.
PER_CLASS = 600
UNKNOWN = "und"


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros((len(texts), len(self.langs)))
        for bag in subwords.bags(texts, SIZES, BITS, subwords.LETTERS, None):
            out[bag.text] = subwords.segment_scores(bag, self.table)
        return out + self.bias

    def judge(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        lettered = np.asarray(pc.match_substring_regex(texts, r"\p{L}"), dtype=bool) if len(texts) else np.zeros(0, bool)
        if not self.langs:
            return np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.ones(len(texts), bool)
        logit = self.logits(texts) / self.temperature
        prob = np.exp(logit - logit.max(1, keepdims=True))
        best = logit.argmax(1)
        top = np.where(lettered, 1 / prob.sum(1), 0.0)
        lang = np.where(lettered, np.array(self.langs, object)[best], UNKNOWN)
        return lang, top, ~lettered | (top < self.threshold)


def _calibrate(model: Model, texts: list[str], y: np.ndarray, right: float) -> None:
    logit = model.logits(pa.array(texts, pa.string()))

    def loss(t: float) -> float:
        z = logit / t
        z = z - z.max(1, keepdims=True)
        return float(-(z[np.arange(len(y)), y] - np.log(np.exp(z).sum(1))).mean())

    model.temperature = min(np.geomspace(0.05, 20, 60).tolist(), key=loss)
    z = logit / model.temperature
    top = 1 / np.exp(z - z.max(1, keepdims=True)).sum(1)
    order = np.argsort(-top)
    kept_right = np.cumsum(z.argmax(1)[order] == y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(kept_right >= right)
    model.threshold = float(top[order[good[-1]]]) if len(good) else 1.0


def train(texts: list[str], langs: list[str], rounds: int = 12, right: float = 0.99, seed: int = 5) -> Model:
    seen = pd.DataFrame({"text": texts, "lang": langs}).dropna().drop_duplicates().sort_values(["lang", "text"])
    names = sorted(seen["lang"].unique().tolist())
    if not names:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    y = seen["lang"].map({n: i for i, n in enumerate(names)}).to_numpy(np.int64)
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(y))
    aside = order[: len(y) // 5]
    learn = order[len(y) // 5 :]
    texts = seen["text"].tolist()
    data = subwords.rows(texts, SIZES, BITS, subwords.LETTERS, None)
    net = subwords.SubwordSoftmax(len(names), BITS, DIM)
    weight = 1 / np.bincount(y, minlength=len(names))[y]
    for _ in range(rounds):
        part_order = draw.permutation(learn)
        for part in np.array_split(part_order, max(1, len(part_order) // 64)):
            net.step(data, part, y[part], weight[part], 0.2)
    model = Model(names, net.table().astype(np.float32), net.bias.astype(float))
    if len(aside):
        _calibrate(model, [texts[i] for i in aside], y[aside], right)
    return model


def fit(docs: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Train on about ``per_class`` documents of each language outside fold 0, by their ``text`` and ``lang``.

    Texts above ``common.MOST_BYTES`` are not trained on, so that what reaches the driver is bounded in bytes too.
    """
    known = docs.where(~common.held_out("doc_id") & F.col("doc_id").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    short = known.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= common.MOST_BYTES)
    found = common.sample_per_class(short, "doc_id", "lang", per_class).select("text", "lang").toPandas()
    return train(found["text"].fillna("").tolist(), found["lang"].tolist())


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected``; narrow, whole texts, no shuffle."""
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]

    def compute(texts: pa.Array) -> list[pa.Array]:
        lang, top, rejected = model.judge(texts)
        return [pa.array(lang, pa.string()), pa.array(top, pa.float64()), pa.array(rejected, pa.bool_())]

    return common.append(docs, fields, text, compute)
