"""Encoders, the logistic classifier and retraining, on Spark ML."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from silverloop.contracts import require_rows
from silverloop.functions.labels import text_or_empty
from silverloop.operators.metrics import metric_rows
from silverloop.operators.text import TOKEN_SPACE
from silverloop.session import stage_table

# Texts per encoder call, solver steps, inverse penalty.
ENCODE_BATCH = 32
MAX_ITERATIONS = 2000
C = 1.0

# A text encoder: a list of texts to a list (or 2-d array) of vectors.
Encoder = Callable[[list[str]], Sequence[Sequence[float]]]


def hashed_mean_encoder(dim: int = 16, max_tokens: int | None = None) -> Encoder:
    """Mean of one-hot token vectors; a token's slot comes from its md5.

    The stand-in where no model runtime is at hand. ``max_tokens`` makes it one that
    reads so many tokens only; give such an encoder windows (``embed_documents``).
    """
    word = re.compile(f"[^{TOKEN_SPACE}]+")

    @lru_cache(maxsize=1 << 18)
    def slot(token: str) -> int:
        return int(hashlib.md5(token.encode()).hexdigest()[:4], 16) % dim

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, text in enumerate(texts):
            slots = [slot(t.group()) for t in islice(word.finditer(text), max_tokens)]
            if slots:
                out[i] = np.bincount(slots, minlength=dim) / len(slots)
        return out

    return encode


def embed_batches(
    df: DataFrame,
    make_encoder: Callable[[], Encoder],
    text: str = "text",
    out: str = "embedding",
    batch: int = ENCODE_BATCH,
    tasks: int | None = None,
) -> DataFrame:
    """Add a vector per text from a pluggable encoder.

    ``make_encoder`` runs once per task, before its first batch; the encoder then
    gets ``batch`` texts at a time. Null text is ``""``. ``tasks`` spreads the rows
    evenly over that many tasks first.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for frame in frames:
            texts = frame["_text"].tolist()
            vectors: list = []
            for i in range(0, len(texts), batch):
                vectors.extend(np.asarray(v, dtype="float32") for v in encode(texts[i : i + batch]))
            yield frame.drop(columns="_text").assign(**{out: vectors})

    schema = StructType([*df.schema.fields, StructField(out, ArrayType(FloatType()))])
    spread = df.repartition(tasks) if tasks else df
    return spread.withColumn("_text", text_or_empty(F.col(text))).mapInPandas(run, schema)


def _pooled(texts: list[str], encode: Encoder, window: int, batch: int) -> np.ndarray:
    """A vector per text: its windows of ``window`` tokens encoded, ``batch`` at a time, and averaged by their tokens."""
    word = re.compile(f"[^{TOKEN_SPACE}]+")
    parts: list[str] = []
    whose: list[int] = []
    sizes: list[int] = []
    total: np.ndarray | None = None

    def flush() -> None:
        nonlocal total
        found = np.asarray(encode(parts), dtype="float32").astype(float)
        if total is None:
            total = np.zeros((len(texts), found.shape[1]))
        np.add.at(total, whose, found * np.array(sizes)[:, None])
        for x in (parts, whose, sizes):
            x.clear()

    counts = np.zeros(len(texts))
    for i, text in enumerate(texts):
        tokens = word.findall(text)
        counts[i] = len(tokens)
        for k in range(0, max(len(tokens), 1), window):
            part = tokens[k : k + window]
            parts.append(" ".join(part))
            whose.append(i)
            sizes.append(len(part))
            if len(parts) == batch:
                flush()
    if parts:
        flush()
    return total / np.maximum(counts, 1e-9)[:, None]


def embed_documents(
    df: DataFrame,
    make_encoder: Callable[[], Encoder],
    key: str = "doc_id",
    text: str = "text",
    out: str = "embedding",
    window: int = 256,
    batch: int = ENCODE_BATCH,
    tasks: int | None = None,
) -> DataFrame:
    """(``key``, ``out``) of whole texts by an encoder that reads ``window`` tokens at once.

    Every text is cut into windows, each is encoded, and the vectors are averaged by
    their tokens, all where the text lies: nothing is shuffled, and a text is split once.
    A text without tokens, null included, is one empty window with no weight, so its
    vector is 0. ``tasks`` deals whole rows to that many tasks first, which is for tables
    of fewer files than tasks.
    """
    rows = df.select(key, text_or_empty(F.col(text)).alias("_text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({key: frame[key], out: list(_pooled(frame["_text"].tolist(), encode, window, batch))})

    schema = StructType([df.schema[key], StructField(out, ArrayType(DoubleType()))])
    return (rows.repartition(tasks) if tasks else rows).mapInPandas(run, schema)


def fit_logreg(
    df: DataFrame,
    vector: str = "embedding",
    label: str = "label",
    c: float = C,
    max_iter: int = MAX_ITERATIONS,
    tol: float = 1e-12,
) -> PipelineModel:
    """Fit L2 logistic regression on an array column.

    ``c`` weighs the summed loss against half the squared norm of the weights; Spark's
    penalty is on the mean loss, hence 1 / (c n).
    """
    data = df.select(array_to_vector(vector).alias("features"), F.col(label).cast("double").alias("label"))
    n = df.count()
    if n == 0:
        raise ValueError("no rows to fit")
    lr = LogisticRegression(
        maxIter=max_iter, regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, tol=tol
    )
    return PipelineModel([lr.fit(data)])


def predict_proba(
    df: DataFrame,
    model: PipelineModel,
    vector: str = "embedding",
    probability: str = "p_green",
    prediction: str = "prediction",
) -> DataFrame:
    """Add P(class 1) and the predicted class of a fitted model."""
    scored = model.transform(df.withColumn("features", array_to_vector(vector)))
    return scored.select(
        *df.columns,
        vector_to_array("probability")[1].alias(probability),
        F.col("prediction").cast("int").alias(prediction),
    )


def text_pipeline(
    n_features: int = 1 << 12, max_iter: int = 100, reg_param: float = 0.1, tol: float = 1e-3
) -> Pipeline:
    """Tokens, hashed counts, inverse document frequency, logistic regression."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="_tokens", pattern=f"[{TOKEN_SPACE}]+"),
            HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=n_features),
            IDF(inputCol="_counts", outputCol="_features"),
            LogisticRegression(
                featuresCol="_features", labelCol="label", maxIter=max_iter, regParam=reg_param, tol=tol
            ),
        ]
    )


def _stateless_head(pipeline: Pipeline) -> tuple[list[Transformer], list]:
    """The stages that need no fit, up to the first that does, and the others."""
    stages = list(pipeline.getStages())
    n = next((i for i, stage in enumerate(stages) if not isinstance(stage, Transformer)), len(stages))
    return stages[:n], stages[n:]


def _fit_texts(train: DataFrame, pipeline: Pipeline) -> PipelineModel:
    """Fit a text pipeline; what needs no fit (hashed counts) is staged, since the fit passes over it many times."""
    head, rest = _stateless_head(pipeline)
    prepared = PipelineModel(head).transform(train).drop("text", *[s.getOutputCol() for s in head[:-1]])
    training = require_rows(stage_table(prepared, "training"), "no training rows")
    return PipelineModel(head + Pipeline(stages=rest).fit(training).stages)


def retrain_eval(
    train: DataFrame,
    evaluation: DataFrame,
    run: str,
    pipeline: Pipeline | None = None,
    make_encoder: Callable[[], Encoder] | None = None,
    tasks: int | None = None,
) -> tuple[PipelineModel, DataFrame]:
    """Fit on (``text``, ``label``) rows and return the model with its metric rows.

    With an encoder, texts become vectors once and ``fit_logreg`` is fitted on them, as
    the baseline is; else a pipeline over texts is. Two tables go to the shared folder:
    the training rows as vectors or hashed counts, not text, and the narrow
    predictions, so that no metric runs the model again.
    """
    typed, held = (df.select("text", F.col("label").cast("double").alias("label")) for df in (train, evaluation))
    if make_encoder is None:
        model = _fit_texts(typed, pipeline or text_pipeline())
        scored = model.transform(held).select("label", "prediction", vector_to_array("probability")[1].alias("p_true"))
    else:
        if pipeline is not None:
            raise ValueError("give a pipeline or an encoder, not both")
        vectors = [embed_batches(df, make_encoder, tasks=tasks).select("label", "embedding") for df in (typed, held)]
        model = fit_logreg(require_rows(stage_table(vectors[0], "training"), "no training rows"))
        scored = predict_proba(vectors[1], model, probability="p_true")
    predicted = scored.select(F.col("label").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"), "p_true")
    scored = require_rows(stage_table(predicted, "predictions"), "no evaluation rows")
    return model, metric_rows(scored, run, p_one="p_true")
