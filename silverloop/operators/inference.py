"""Batch inference with pluggable models, and what is built on it.

A model is a function from a list of prompts to a list of replies, made once per
task by a factory. Rows are spread by Spark; replies that are read more than once
are written to a staged table first, so no reply is generated twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from silverloop.contracts import require_columns
from silverloop.functions import labels, prompts
from silverloop.operators.cleaning import drop_incomplete
from silverloop.operators.sampling import cap_sample
from silverloop.operators.text import judge_columns, parse_kv_response, resolve_label
from silverloop.session import stage_table

Generate = Callable[[list[str]], list[str]]

# The answer columns.
ANSWER_COLUMNS = ("qlora_label", "qlora_rationale", "qlora_raw", "qlora_json_ok")


def map_batches(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str
) -> DataFrame:
    """Apply a function to batches of rows; ``schema`` names what it returns."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield fn(frame)

    return df.mapInPandas(run, schema)


def map_column(make: Callable[[], Callable[[pd.Series], pd.Series]], returns: str) -> Callable[..., Column]:
    """A column function from a function over one column's batches, set up once per task.

    ``make`` loads what the function needs (a model, a dictionary) and returns it; it is
    called when a task begins, and its function then gets batch after batch. The result
    goes wherever an expression goes, so other columns don't leave the JVM. Nulls are
    passed on as pandas has them.
    """

    @F.pandas_udf(returns)
    def over_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = make()
        for batch in batches:
            yield fn(batch)

    return over_batches


def map_columns(make: Callable[[], Callable[..., pd.Series]], returns: str) -> Callable[..., Column]:
    """As ``map_column``, over several columns."""

    @F.pandas_udf(returns)
    def over_batches(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        fn = make()
        for columns in batches:
            yield fn(*columns)

    return over_batches


def batch_generate(
    df: DataFrame,
    make_model: Callable[[], Generate],
    prompt: str = "prompt",
    out: str = "reply",
    batch: int = 32,
    tasks: int | None = None,
) -> DataFrame:
    """Add one reply per prompt: the prompt's echo is cut off and the reply stripped.

    ``tasks`` spreads the rows evenly over that many tasks first. A model call costs
    more than moving a row, and files seldom split into even work for it.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = make_model()
        for frame in frames:
            asked = ["" if p is None else p for p in frame[prompt].tolist()]
            answered: list[str] = []
            for i in range(0, len(asked), batch):
                part = asked[i : i + batch]
                answered.extend(r.removeprefix(p).strip() for p, r in zip(part, generate(part), strict=True))
            yield frame.assign(**{out: answered})

    spread = df.repartition(tasks) if tasks else df
    return spread.mapInPandas(run, StructType([*df.schema.fields, StructField(out, StringType())]))


def label_rows(df: DataFrame, make_model: Callable[[], Generate], text: str = "text") -> DataFrame:
    """Fill the suggestion columns of review rows from the labeller's replies; ``llm_raw`` is the whole reply."""
    asked = df.withColumn("_prompt", prompts.render_named("labeller", claim=labels.text_or_empty(F.col(text))))
    parsed = parse_kv_response(batch_generate(asked, make_model, "_prompt", "_reply"), "_reply")
    filled = parsed.withColumns(
        {
            "llm_green_suggested": F.col("label"),
            "llm_confidence": F.col("confidence"),
            "llm_rationale": F.col("rationale"),
            "llm_raw": F.col("_reply"),
        }
    )
    return filled.drop("_prompt", "_reply", "label", "confidence", "rationale")


# Each task's file is put in place when the task ends, and stays if the job ends early.
COMMIT_PER_TASK = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def written(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """The rows that earlier runs have left at a path, or None."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def resumed(rows: DataFrame, path: str, key: str, make: Callable[[DataFrame], DataFrame], tasks: int | None = None) -> DataFrame:
    """``make(rows)`` written to ``path``; a run that starts again makes only keys not there yet.

    The input is scanned once. Every task commits its own file as it ends, so a run that
    fails or is killed loses the rows of its open tasks only; ``tasks`` says how many the
    rows are dealt to, as a model call costs more than moving a row. ``key`` is unique and
    not null: a null key can't be found again, and fails the run.
    """
    absent = F.raise_error(F.lit(f"null {key}")).cast(rows.schema[key].dataType)
    todo = rows.withColumn(key, F.when(F.col(key).isNull(), absent).otherwise(F.col(key)))
    schema = make(todo).schema
    done = written(rows.sparkSession, path, schema)
    if done is not None:
        todo = todo.join(done.select(key), key, "left_anti")
    made = make(todo.repartition(tasks) if tasks else todo)
    made.write.mode("append").options(**COMMIT_PER_TASK).parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def debate(
    df: DataFrame,
    models: Mapping[str, Callable[[], Generate]],
    text: str = "text",
    stage: bool = True,
    tasks: int | None = None,
    run: str | None = None,
    key: str = "doc_id",
) -> DataFrame:
    """Advocate and skeptic argue, the judge decides, the verdict becomes columns.

    ``models`` has one factory each for ``advocate``, ``skeptic`` and ``judge``.
    With ``stage`` (the default) this writes two tables to the shared folder: the
    arguments, and the judge's replies. ``tasks`` spreads the rows before the first
    model. With ``run``, a path of the caller's, they are written there as tasks end,
    and a run that starts again goes on from what is there, known by ``key``.
    """
    require_columns(df, [text])
    if tasks and not run:
        df = df.repartition(tasks)
    keep: Callable[[DataFrame, str], DataFrame] = stage_table if stage else (lambda d, _: d)
    claim = labels.text_or_empty(F.col(text), literal_null=True)

    def argue(rows: DataFrame) -> DataFrame:
        asked = rows.withColumns(
            {
                "_advocate": prompts.render_named("advocate", claim=claim),
                "_skeptic": prompts.render_named("skeptic", claim=claim),
            }
        )
        argued = batch_generate(asked, models["advocate"], "_advocate", "agent1_advocate")
        return batch_generate(argued, models["skeptic"], "_skeptic", "agent2_skeptic").drop("_advocate", "_skeptic")

    def decide(argued: DataFrame) -> DataFrame:
        said = {"advocate": F.col("agent1_advocate"), "skeptic": F.col("agent2_skeptic")}
        asked = argued.withColumn("_judge", prompts.render_named("judge", claim=claim, **said))
        return batch_generate(asked, models["judge"], "_judge", "judge_json").drop("_judge")

    if run:
        argued = resumed(df, f"{run}/arguments", key, argue, tasks)
        return judge_columns(resumed(argued, f"{run}/verdicts", key, decide, tasks))
    return judge_columns(keep(decide(keep(argue(df), "debate-arguments")), "debate-verdicts"))


def _answered(df: DataFrame, make_model: Callable[[], Generate], text: str, names: tuple[str, str, str, str]) -> DataFrame:
    """Ask the classifier and add label, rationale, raw reply and clean-parse flag."""
    label, rationale, raw, ok = names
    asked = df.withColumn("_prompt", prompts.classifier_prompt(labels.text_or_empty(F.col(text), literal_null=True)))
    replied = batch_generate(asked, make_model, "_prompt", raw).drop("_prompt")
    return resolve_label(replied, raw, label, rationale, ok)


def _on_unparsed(label: Column, policy: str) -> Column:
    if policy not in ("zero", "null"):
        raise ValueError(f"on_unparsed must be 'zero' or 'null', not {policy!r}")
    return F.coalesce(label, F.lit(0)) if policy == "zero" else label


def evaluate_capped(
    df: DataFrame,
    make_model: Callable[[], Generate],
    key: str = "id",
    text: str = "text",
    gold: str = "is_green_silver",
    max_rows: int | None = None,
    seed: int = 42,
    on_unparsed: str = "zero",
    stage: bool = True,
) -> DataFrame:
    """Predictions (``key``, ``y_true``, ``y_pred``, ``label``, ``ok``) on all rows, or ``max_rows`` by seeded order.

    The rows are complete and have a readable gold label. Feed the result to the
    metrics; ``label`` and ``ok`` go to ``parse_quality``. With ``stage`` the answers
    are written once to the shared folder, however many readers they have.
    """
    complete = drop_incomplete(df.select(key, text, gold), [text, gold])
    typed = complete.withColumn("y_true", labels.to_int01(F.col(gold)))
    chosen = cap_sample(drop_incomplete(typed, ["y_true"]), max_rows, key, seed)
    answered = _answered(chosen, make_model, text, ("label", "rationale", "raw", "ok"))
    if stage:
        answered = stage_table(answered.drop(text), "evaluated")
    return answered.select(key, "y_true", _on_unparsed(F.col("label"), on_unparsed).alias("y_pred"), "label", "ok")


def predict_and_score(
    df: DataFrame,
    make_model: Callable[[], Generate],
    text: str = "text",
    gold: str = "is_green_human",
    on_unparsed: str = "null",
    stage: bool = True,
) -> DataFrame:
    """All rows with ``gold01``, ``qlora_label``, ``qlora_rationale``, ``qlora_raw``, ``qlora_json_ok``.

    With ``stage`` they are written once to the shared folder; else every reader
    asks the model again.
    """
    require_columns(df, [text, gold])
    typed = df.withColumn("gold01", labels.to_int01(F.col(gold)))
    answered = _answered(typed, make_model, text, ANSWER_COLUMNS)
    if stage:
        answered = stage_table(answered, "answers")
    return answered.withColumn("qlora_label", _on_unparsed(F.col("qlora_label"), on_unparsed))


def scored_rows(predicted: DataFrame) -> DataFrame:
    """(``y_true``, ``y_pred``) of the rows that have both a gold and a predicted label."""
    both = drop_incomplete(predicted, ["gold01", "qlora_label"])
    return both.select(F.col("gold01").alias("y_true"), F.col("qlora_label").alias("y_pred"))
