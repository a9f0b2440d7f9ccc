"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of 1 to 3 characters per language and hash bucket inside
the tasks, sums the counts in Spark, and brings a matrix of languages x buckets to
the driver, whose size depends on neither rows nor texts. Prediction broadcasts
that matrix and scores whole texts with numpy gathers and segment sums.
Log probabilities are integers in units of 2**-16, so a score doesn't depend on how
rows are batched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from silverloop.llm.common import chunks, texts_of

UNKNOWN = "und"
BUCKET_BITS = 15
SIZES = (1, 2, 3)
UNIT = 65536
# The evidence that a score weighs: longer texts count as so many n-grams.
EVIDENCE = 20
# Largest model to broadcast, in cells of 4 bytes.
MAX_CELLS = 1 << 27


@cache
def _lower() -> np.ndarray:
    """Lower-case letter of each code point; a space for what isn't a letter."""
    table = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        if (c := chr(i)).isalpha():
            table[i] = ord(c.lower()[0])
    return table


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash buckets of all n-grams, the text each belongs to (ascending), and which texts have a letter."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    joined = "".join(f" {t} " for t in texts)
    codes = _lower()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    keep = codes != 32
    has_letter = np.zeros(len(texts), bool)
    has_letter[owner[keep]] = True
    keep[1:] |= (codes[:-1] != 32) | (owner[1:] != owner[:-1])
    if len(keep):
        keep[0] = True
    codes, owner = codes[keep].astype(np.uint64), owner[keep]
    grams, owners, at = codes, [], []
    for n in SIZES:
        if n > 1:
            grams = grams[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        inside = owner[: len(grams)] == owner[n - 1 :]
        hashed = (grams + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(29)
        hashed *= np.uint64(0xBF58476D1CE4E5B9)
        at.append((hashed >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)[inside])
        owners.append(owner[: len(grams)][inside])
    return at, owners, has_letter


def train(docs: DataFrame, text_col: str = "text", label_col: str = "lang", max_cells: int = MAX_CELLS) -> tuple[list[str], np.ndarray]:
    """Languages in ascending order and their log probabilities [language, bucket] in units of 2**-16.

    Rows with a null label are left out; null texts and texts without a letter teach
    nothing. Classes have equal priors. No rows: no languages. More languages than
    ``max_cells`` allows is an error, as the matrix is broadcast.
    """
    rows = docs.where(F.col(label_col).isNotNull())
    rows = texts_of(rows, label_col, text_col, F.col(label_col).cast("string").alias("_lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(batch.schema.get_field_index("_lang")).to_pylist()
            for first, last, texts in chunks(batch):
                names = sorted(set(langs[first:last]))
                index = np.array([names.index(x) for x in langs[first:last]])
                at, owners, _ = features(texts)
                for a, o in zip(at, owners, strict=True):
                    both = np.bincount(index[o] * (1 << BUCKET_BITS) + a, minlength=len(names) << BUCKET_BITS)
                    for i, name in enumerate(names):
                        part = both[i << BUCKET_BITS : (i + 1) << BUCKET_BITS]
                        totals[name] = totals[name] + part if name in totals else part
        for name, total in totals.items():
            hit = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(hit), pa.string()), pa.array(hit.astype(np.int32)), pa.array(total[hit])], ["lang", "bucket", "n"])

    counted = rows.select("_text", "_lang").mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    names = [r.lang for r in docs.where(F.col(label_col).isNotNull()).select(F.col(label_col).cast("string").alias("lang")).distinct().limit((max_cells >> BUCKET_BITS) + 1).collect()]
    if len(names) << BUCKET_BITS > max_cells:
        raise ValueError(f"more languages than a model of {max_cells} cells holds")
    names.sort()
    counts = np.ones((len(names), 1 << BUCKET_BITS))
    if names:
        lang, bucket, n = (c.to_numpy() for c in counted.toArrow().columns)
        np.add.at(counts, (np.searchsorted(np.array(names, object), lang), bucket), n)
    logs = np.log(counts) - np.log(counts.sum(axis=1, keepdims=True)) if names else counts
    return names, np.rint(logs * UNIT).astype(np.int32)


def _scored(rows: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``rows`` has ``_id`` and ``_text``."""
    names, logs = model
    sent = rows.sparkSession.sparkContext.broadcast(logs)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = sent.value
        for batch in batches:
            for first, last, texts in chunks(batch):
                at, owners, has_letter = features(texts)
                sums, n = np.zeros((len(names), len(texts)), np.int64), np.zeros(len(texts), np.int64)
                for a, o in zip(at, owners, strict=True):
                    if not len(o):
                        continue
                    starts = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
                    who = o[starts]
                    n[who] += np.diff(np.append(starts, len(o)))
                    for k in range(len(names)):
                        sums[k, who] += np.add.reduceat(matrix[k][a], starts, dtype=np.int64)
                known = has_letter & bool(names)
                pred, prob = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
                if names:
                    best = sums.argmax(axis=0)
                    gap = (sums - sums.max(axis=0)) / UNIT * (np.minimum(n, EVIDENCE) / np.maximum(n, 1))
                    chance = 1 / np.exp(gap).sum(axis=0)
                    pred[known], prob[known] = np.array(names, object)[best[known]], chance[known]
                ids = batch.column(batch.schema.get_field_index("_id")).slice(first, last - first)
                yield pa.RecordBatch.from_arrays([ids, pa.array(pred, pa.string()), pa.array(prob)], ["_id", "lang_pred", "score"])

    schema = StructType([rows.schema["_id"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(score, schema)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred`` and ``score`` for every row, from the text alone.

    ``score`` is the class probability with the evidence scaled to ``EVIDENCE``
    n-grams. A null text, one without a letter or an empty model gives ``und`` and
    0. Ties go to the first language. Repeated rows give repeated rows.
    """
    return _scored(texts_of(docs, id_col, text_col), model).withColumnRenamed("_id", id_col)


def filtered(docs: DataFrame, model: tuple[list[str], np.ndarray], min_score: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is known with ``min_score`` or more, with all their columns.

    The other columns go to the tasks and back as they are, so nothing is joined.
    """
    kept = docs.select(F.struct("*").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return _scored(kept, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select("_id.*")
