"""Chat records to training examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sidforge.functions.sid import MESSAGE_END
from sidforge.functions.text import pytrim, strict_json

#: Fixed value: the label that a loss ignores.
IGNORED = -100
MESSAGES = "array<struct<role:string,content:string>>"


def content_text(content: Column) -> Column:
    """Text of a message content given as variant: a string as it is; of a list the trimmed non-empty texts, one a line; null as ''."""
    kind = F.schema_of_variant(content)
    whole = F.try_variant_get(content, "$", "string")

    def part(x: Column) -> Column:
        value = F.when(F.schema_of_variant(x).startswith("OBJECT"), F.try_variant_get(x, "$.text", "variant")).otherwise(x)
        text, truth = F.try_variant_get(value, "$", "string"), F.schema_of_variant(value) == "BOOLEAN"
        number = F.when(F.schema_of_variant(value) != "STRING", F.try_variant_get(value, "$", "double"))
        # zero and false say nothing, as an empty text does
        said = F.when(truth, F.when(text == "true", F.lit("True"))).when(number == 0, F.lit(None)).otherwise(text)
        return pytrim(F.coalesce(said, F.lit("")))

    joined = F.array_join(F.filter(F.transform(content.try_cast("array<variant>"), part), lambda t: t != ""), "\n")
    return F.when(kind.startswith("ARRAY"), joined).otherwise(F.coalesce(whole, F.lit("")))


def messages_from_json(text: Column) -> Column:
    """Messages of a JSON list; elements that are no objects or have a blank role are skipped; null when it is no list."""
    elements = strict_json(text).try_cast("array<variant>")
    objects = F.filter(elements, lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    made = F.transform(objects, lambda x: F.struct(pytrim(F.coalesce(F.try_variant_get(x, "$.role", "string"), F.lit(""))).alias("role"), content_text(F.try_variant_get(x, "$.content", "variant")).alias("content")))
    return F.filter(made, lambda m: m["role"] != "")


def messages_from_structs(messages: Column) -> Column:
    """Messages of an array of structs: roles trimmed, blank ones skipped, null contents as ''."""
    made = F.transform(messages, lambda m: F.struct(pytrim(F.coalesce(m["role"], F.lit(""))).alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")))
    return F.filter(made, lambda m: m["role"] != "")


def messages_from_lines(text: Column, roles: tuple[str, ...] = ("system", "user", "assistant")) -> Column:
    """Messages of a transcript in which each message begins a line with its role and a colon."""
    start = "(?:^|\\n)(?=(?:" + "|".join(roles) + "): )"
    blocks = F.filter(F.split(text, start), lambda b: F.regexp_like(b, F.lit("^(?:" + "|".join(roles) + "): ")))
    return F.transform(blocks, lambda b: F.struct(F.substring_index(b, ": ", 1).alias("role"), F.regexp_replace(b, "^[a-z]+: ", "").alias("content")))


def split_columns(messages: Column) -> tuple[Column, Column]:
    """(prompt messages, completion): cut at the last assistant message; both null unless it has a predecessor and text."""
    roles = F.transform(messages, lambda m: m["role"])
    last = F.size(messages) - F.array_position(F.reverse(roles), "assistant")  # 0-based; the size itself when there is none
    found = F.array_contains(roles, "assistant") & (last > 0)
    completion = F.when(found, pytrim(F.get(messages, last.cast("int"))["content"]))
    good = found & (completion != "")
    return F.when(good, F.slice(messages, F.lit(1), last.cast("int"))), F.when(good, completion)


def split_prompt_completion(df: DataFrame, messages: str = "messages", strict: bool = False) -> DataFrame:
    """``df`` with ``prompt_messages`` and ``completion``; rows without them are dropped, or with ``strict`` an error."""
    prompt, completion = split_columns(F.col(messages))
    out = df.withColumn("prompt_messages", prompt).withColumn("completion", completion)
    if strict:
        return out.withColumn("completion", F.coalesce("completion", F.raise_error(F.lit("no final assistant message with text after another message"))))
    return out.where("completion is not null")


def render_prompt(prompt_messages: Column) -> Column:
    """Default template: each message between markers with its role on top, then the opening of the assistant's turn."""
    turns = F.transform(prompt_messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit(MESSAGE_END + "\n")))
    return F.concat(F.array_join(turns, ""), F.lit("<|im_start|>assistant\n"))


def prompt_completion_records(df: DataFrame, render=render_prompt) -> DataFrame:  # noqa: ANN001
    """``prompt, completion`` from a ``messages`` column (JSON or structs), where present, else from these two columns.

    On the first path the end marker is appended to the completion; on the second nothing is changed.
    """
    if "messages" in df.columns:
        as_text = df.schema["messages"].dataType.simpleString() == "string"
        made = df.withColumn("messages", messages_from_json(F.col("messages")) if as_text else messages_from_structs(F.col("messages")))
        parts = split_prompt_completion(made, strict=True)
        return parts.withColumn("prompt", render(F.col("prompt_messages"))).withColumn("completion", F.concat("completion", F.lit(MESSAGE_END))).drop("prompt_messages", "messages")
    if {"prompt", "completion"} <= set(df.columns):
        return df.withColumn("prompt", F.col("prompt").cast("string")).withColumn("completion", F.col("completion").cast("string"))
    raise ValueError("records need a messages column, or prompt and completion")


def code_points(text: Column) -> Column:
    """The simplest tokenizer: the code point of every character."""
    return F.when(text == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint")))


def last_of(values: Column, n: int) -> Column:
    """The last ``n`` elements, all of them when there are fewer or ``n`` is 0."""
    return F.when((F.size(values) > n) & F.lit(n > 0), F.slice(values, -n if n else 1, n or 1)).otherwise(values)


def encode_pair(df: DataFrame, tokenizer=code_points, max_length: int = 1024, prompt: str = "prompt", completion: str = "completion") -> DataFrame:  # noqa: ANN001
    """``df`` with ``input_ids, attention_mask, labels``: prompt labels ignored, the front cut off beyond ``max_length``.

    An error where the cut leaves no label.
    """
    df = df.withColumn("_p", tokenizer(F.col(prompt))).withColumn("_c", tokenizer(F.col(completion)))
    ids = F.concat("_p", "_c")
    labels = F.concat(F.transform("_p", lambda _: F.lit(IGNORED).cast("bigint")), F.col("_c"))
    cut = last_of(labels, max_length)
    lost = (F.size(labels) > max_length) & F.forall(cut, lambda x: x == IGNORED)
    checked = F.when(lost, F.raise_error(F.lit("truncation leaves no completion label"))).otherwise(cut)
    out = df.withColumn("input_ids", last_of(ids, max_length)).withColumn("labels", checked).drop("_p", "_c")
    return out.withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1).cast("bigint")))


def collate(df: DataFrame, batch: str = "batch", pad_id: int | None = None, end_id: int | None = None) -> DataFrame:
    """Rows padded on the right to the longest of their batch: ids with the pad id, mask with 0, labels ignored.

    A pad id of 0 or none gives way to the end id; an error when there is neither. Batches are bounded, so is the window.
    """
    pad = pad_id or end_id
    if pad is None:
        raise ValueError("a pad or an end id is needed")
    longest = F.max(F.size("input_ids")).over(W.partitionBy(batch))
    out = df.withColumn("_more", longest - F.size("input_ids"))
    for column, filler in (("input_ids", pad), ("attention_mask", 0), ("labels", IGNORED)):
        out = out.withColumn(column, F.concat(F.col(column), F.array_repeat(F.lit(filler).cast("bigint"), F.col("_more"))))
    return out.drop("_more")
