"""Prompts, chat, instruction rows, reply parsing jobs, token windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silverloop.contracts import require_columns
from silverloop.functions import prompts, replies
from silverloop.operators.cleaning import CORPUS_COLUMNS, drop_incomplete, split_filter, to_int01
from silverloop.operators.joins import exclude_ids
from silverloop.operators.sampling import BUCKET_DIGITS, BUCKET_ROWS, cap_sample, running_total, seeded_key

# What separates tokens, as the inside of a character class.
TOKEN_SPACE = " \t\n\r\f"

# Token limits of the texts in use.
MAX_TOKENS = {"encoder": 256, "pack": 512}


def tokens_of(text: Column) -> Column:
    """White-space tokens as an array, empty for blank text."""
    # Space at either end leaves an empty first or last piece.
    return F.array_remove(F.split(text, f"[{TOKEN_SPACE}]+"), "")


def render_prompt(df: DataFrame, template: str, out: str = "prompt", **slots: str) -> DataFrame:
    """Add a prompt from a named template; ``slots`` maps slot to column name."""
    return df.withColumn(out, prompts.render_named(template, **{s: F.col(c) for s, c in slots.items()}))


def collect_messages(
    df: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    part_turns: int | None = None,
) -> DataFrame:
    """Turns to ordered message arrays, one row per conversation.

    A conversation is one string in the end, so it has to fit into a row. Where one
    may not, ``part_turns`` makes a row (``part``) of so many turn numbers each; a
    system turn goes to the part of the turn it introduces, and joined in part order
    the parts are the conversation.
    """
    place = F.col(turn) + (F.col(role) == "system").cast("int")
    message = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(text, F.lit("")).alias("content"))
    parts = [F.floor(place / part_turns).alias("part")] if part_turns else []
    return df.groupBy(conversation, *parts).agg(F.sort_array(F.collect_list(message)).alias("messages"))


def chat_render(df: DataFrame, messages: str = "messages", out: str = "chat") -> DataFrame:
    """Add the chat string of an ordered message array; the array is dropped."""
    return df.withColumn(out, prompts.chat_text(F.col(messages))).drop(messages)


def sft_target(df: DataFrame, label: str = "label01", out: str = "target") -> DataFrame:
    """Add the JSON answer taught for a 0/1 label."""
    return df.withColumn(out, prompts.target_json(F.col(label)))


def sft_records(
    corpus: DataFrame,
    reviewed: DataFrame,
    train_split: str = "train_silver",
    max_rows: int | None = 10_000,
    seed: int = 42,
    normalize: bool = True,
) -> DataFrame:
    """Instruction-tuning rows (``id``, ``text``): prompt, target and end mark.

    Train split, without reviewed ids, complete, with a readable label, at most
    ``max_rows`` by seeded order.
    """
    require_columns(corpus, CORPUS_COLUMNS)
    require_columns(reviewed, ["doc_id"])
    train = split_filter(corpus, train_split, normalize=True)
    unseen = exclude_ids(train, reviewed, normalize=normalize)
    complete = drop_incomplete(unseen.select("id", "text", "is_green_silver"), ["text", "is_green_silver"])
    usable = drop_incomplete(to_int01(complete, "is_green_silver", "label01"), ["label01"])
    chosen = cap_sample(usable, max_rows, "id", seed)
    record = F.concat(
        prompts.classifier_prompt(F.col("text")), prompts.target_json(F.col("label01")), F.lit(prompts.END)
    )
    return chosen.select("id", record.alias("text"))


def parse_kv_response(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Add (``label``, ``confidence``, ``rationale``) of key-value replies."""
    r = replies.kv_reply(F.col(reply))
    return df.withColumns({name: r[name] for name in ("label", "confidence", "rationale")})


def json_first_object(df: DataFrame, reply: str = "reply", out: str = "obj") -> DataFrame:
    """Add the first JSON object of a reply as a ``VARIANT``, null where none parses."""
    return df.withColumn(out, replies.first_json_object(F.col(reply)))


def label_fallback(df: DataFrame, reply: str = "reply", out: str = "label") -> DataFrame:
    """Add the leftmost label token of a reply."""
    return df.withColumn(out, replies.label_token(F.col(reply)))


def resolve_label(
    df: DataFrame, reply: str = "reply", label: str = "label", rationale: str = "rationale", ok: str = "ok"
) -> DataFrame:
    """Add label, rationale and the clean-parse flag of JSON replies."""
    parsed = json_first_object(df, reply, "_obj")
    r = replies.json_reply(F.col(reply), F.col("_obj"))
    return parsed.withColumns({label: r["label"], rationale: r["rationale"], ok: r["ok"]}).drop("_obj")


def salvage_json(df: DataFrame, reply: str = "reply", out: str = "obj") -> DataFrame:
    """Add the judge's JSON as a ``VARIANT``, rebuilt from its fields where broken."""
    return df.withColumn(out, replies.salvaged_json(F.col(reply)))


def judge_columns(df: DataFrame, reply: str = "judge_json") -> DataFrame:
    """Add the verdict columns of a judge reply."""
    parsed = salvage_json(df, reply, "_obj")
    r = replies.judge_verdict(F.col(reply), F.col("_obj"))
    return parsed.withColumns(
        {
            "llm_green_suggested": r["label"],
            "llm_confidence": r["confidence"],
            "llm_rationale": r["rationale"],
            "parse_failed": r["failed"],
        }
    ).drop("_obj")


def token_truncate(df: DataFrame, n: int, text: str = "text", out: str = "tokens") -> DataFrame:
    """Add the first ``n`` white-space tokens of the text as an array."""
    return df.withColumn(out, F.slice(tokens_of(F.col(text)), 1, n))


def sequence_pack(
    df: DataFrame,
    key: str,
    block: int = 512,
    text: str = "text",
    seed: int = 42,
    digits: int = BUCKET_DIGITS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """All texts as one token stream in seeded order, cut into blocks.

    Returns (``block_id``, ``n_tokens``, ``text``); only the last block may be
    short. Every document learns its place in the stream from bucket sums, cuts
    itself at block borders, and a block is put together from pieces that hold
    ``block`` tokens at most in all.
    """
    # The text crosses the shuffle as it is and is split again after it: a token
    # array would be about three times the bytes.
    counted = df.select(
        seeded_key(seed, key).alias("h"), F.col(text).alias("text"), F.size(tokens_of(F.col(text))).alias("n")
    )
    placed = running_total(counted, F.col("h"), F.col("n"), "start", digits, bucket_rows).where(F.col("n") > 0)

    size = F.lit(block).cast("bigint")
    first, last = F.expr(f"start div {block}"), F.expr(f"(start + n - 1) div {block}")

    def piece(tokens: Column, b: Column) -> Column:
        begin = F.greatest(b * size - F.col("start"), F.lit(0))
        end = F.least((b + 1) * size - F.col("start"), F.col("n").cast("bigint"))
        return F.struct(
            b.alias("block_id"),
            (F.col("start") + begin).alias("at"),
            (end - begin).alias("n"),
            F.array_join(F.slice(tokens, (begin + 1).cast("int"), (end - begin).cast("int")), " ").alias("text"),
        )

    # The outer transform runs once and holds the split text for all pieces.
    cut = F.transform(
        F.array(tokens_of(F.col("text"))),
        lambda tokens: F.transform(F.sequence(first, last), lambda b: piece(tokens, b)),
    )
    pieces = placed.select(F.inline(F.element_at(cut, 1)))
    ordered = F.sort_array(F.collect_list(F.struct("at", "text")))
    return pieces.groupBy("block_id").agg(
        F.sum("n").alias("n_tokens"), F.array_join(F.transform(ordered, lambda p: p["text"]), " ").alias("text")
    )
