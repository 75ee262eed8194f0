"""Language-model tasks: messages, prompts, one- and two-stage classification with a pluggable client, resuming.

A client is a function from (system, user) pairs to answers, called with batches in the executors. Models are not part
of this package; ``echo_client`` answers by rule and serves tests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewarden.functions.text import LABELS, UNPARSED, after_last, filled, label_id, label_name, split_prompt, text
from gatewarden.operators import retrieve
from gatewarden.operators.vocabulary import numbered

Client = Callable[[list[tuple[str, str]]], list[str]]
BATCH, READY, COMPLETED = 32, "ready", "completed"

LOCALISE = "Name the malicious part of the request, if there is one, after 'Final Answer:'.\n# Input request\n{request}"
CLASSIFY = "Suspicious part: {malicious}\nSimilar cases:\n{related}\nName the kind after 'Final Classification:'.\n# Input request\n{request}"
DIRECT = "Name the kind of the request after 'Final Classification:'.\n# Input request\n{request}"


def prepared(requests: DataFrame, order: list[Column], engine: str = "local", model: str = "stub") -> DataFrame:
    """Tasks numbered from 1, ready to run."""
    out = numbered(requests, order, 1, "task_id")
    return out.withColumns({"engin": F.lit(engine), "model": F.lit(model), "state": F.lit(READY), "response": F.lit(None).cast("string")})


def remaining(tasks: DataFrame, done: DataFrame, key: str = "task_id") -> DataFrame:
    """Tasks without a completed row in an earlier run's table."""
    return tasks.join(done.filter(F.col("state") == COMPLETED).select(key), key, "left_anti")


def generated(rows: DataFrame, prompt: Column, client: Client, to: str, batch: int = BATCH) -> DataFrame:
    """``rows`` with the client's answers to their prompts, split in system and user part at the input's mark."""
    asked = rows.withColumn("_p", split_prompt(prompt)).select(*rows.columns, F.col("_p.system").alias("_system"), F.col("_p.user").alias("_user"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers: list[str] = []
            for k in range(0, len(frame), batch):
                part = frame.iloc[k : k + batch]
                answers += client(list(zip(part["_system"], part["_user"], strict=True)))
            yield frame.drop(columns=["_system", "_user"]).assign(**{to: answers})

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + f", `{to}` string"
    return asked.mapInPandas(run, schema)


def embedded(rows: DataFrame, column: str, encoder: Callable[[list[str]], list[list[float]]], to: str = "embedding") -> DataFrame:
    """``rows`` with embeddings of a column from a batch encoder."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(encoder([t or "" for t in texts]))

    return rows.withColumn(to, embed(column))


def two_stage(tasks: DataFrame, client: Client, encoder: Callable, store: DataFrame, k: int = retrieve.K) -> DataFrame:
    """Localise, retrieve similar cases, classify. Tasks in which nothing is found are normal and ask no second time."""
    first = generated(tasks, filled(F.lit(LOCALISE), request=F.col("request")), client, "localised")
    first = first.withColumn("predicted_malicious", after_last(F.col("localised"), "Final Answer:"))
    found, clean = first.filter(F.col("predicted_malicious") != ""), first.filter(F.col("predicted_malicious") == "")
    second = classified(found, "predicted_malicious", CLASSIFY, client, encoder, store, k)
    clean = clean.withColumns({"related": F.array().cast("array<string>"), "response": F.lit("Final Classification: normal")})
    return finished(second.unionByName(clean))


def classified(rows: DataFrame, query: str, template: str, client: Client, encoder: Callable, store: DataFrame, k: int) -> DataFrame:
    queries = embedded(rows.select(F.col("task_id").alias("query_id"), query), query, encoder)
    near = retrieve.related(retrieve.nearest(queries, store, k), store)
    rows = rows.join(near.select(F.col("query_id").alias("task_id"), "related"), "task_id", "left")
    rows = rows.withColumn("related", F.coalesce("related", F.array().cast("array<string>")))
    malicious = F.col("predicted_malicious") if "predicted_malicious" in rows.columns else F.lit("")
    asked = filled(F.lit(template), malicious=malicious, related=F.array_join("related", "\n"), request=F.col("request"))
    return generated(rows.drop("response"), asked, client, "response")


def one_stage(tasks: DataFrame, client: Client, encoder: Callable, store: DataFrame, k: int = retrieve.K) -> DataFrame:
    """Retrieve by the whole request, classify."""
    return finished(classified(tasks, "request", CLASSIFY, client, encoder, store, k))


def direct(tasks: DataFrame, client: Client) -> DataFrame:
    """Classify from the request alone."""
    return finished(generated(tasks.drop("response"), filled(F.lit(DIRECT), request=F.col("request")), client, "response"))


def finished(rows: DataFrame) -> DataFrame:
    number = label_id(F.col("response"))
    return rows.withColumns({"state": F.lit(COMPLETED), "y_pred": number, "attack_type": label_name(number)})


def realtime_results(rows: DataFrame) -> DataFrame:
    """Rows whose type is an attack: not normal, unknown or others."""
    return rows.filter(~F.col("y_pred").isin(0, LABELS.index("Others"), UNPARSED))


def input_length(system: Column, user: Column) -> Column:
    """Characters of a message's two parts."""
    return F.length(text(system)) + F.length(text(user))


def with_tokens(rows: DataFrame, column: str, count: Callable[[list[str]], list[int]], to: str = "n_tokens") -> DataFrame:
    """``rows`` with the tokens of a column as a tokenizer counts them, in batches; null counts as empty."""

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series(count([t or "" for t in texts]), index=texts.index, dtype="int64")

    return rows.withColumn(to, counted(column))


def message_input(request: DataFrame, column: str = "request") -> Column:
    """System and user parts on two lines for structs, the string itself for strings."""
    kind = dict(request.dtypes)[column]
    if kind.startswith("struct"):
        return F.concat_ws("\n", F.col(f"{column}.system"), F.col(f"{column}.user"))
    if kind.startswith("array"):
        return F.array_join(F.transform(column, lambda x: x["human"]), "\n")
    return F.col(column)


#: Models that need a named template, by name or by a part of it; others bring their own.
NAMED_TEMPLATES = {"LLM-Research/Meta-Llama-3.1-8B-Instruct": "llama3_1", "LLM-Research/Llama-3.2-3B-Instruct": "llama3_2"}
PART_TEMPLATES = {"Llama_3-8b": "llama3"}


def chat_template(model: str) -> str:
    """The family of templates a model's name stands for."""
    name = model.lower()
    return next((f for f in ("qwen", "llama", "mistral", "deepseek", "gemma") if f in name), "plain")


def named_template(model: str) -> str | None:
    """The template that a model's client must be started with; None where the model's own will do."""
    return NAMED_TEMPLATES.get(model) or next((t for part, t in PART_TEMPLATES.items() if part in model), None)


def chat_prompt(system: Column, user: Column) -> Column:
    """A system and a user message in the published format of the third Llama generation, ready for the answer."""
    turn = lambda role, c: F.concat(F.lit(f"<|start_header_id|>{role}<|end_header_id|>\n\n"), text(c), F.lit("<|eot_id|>"))
    return F.concat(F.lit("<|begin_of_text|>"), turn("system", system), turn("user", user), F.lit("<|start_header_id|>assistant<|end_header_id|>\n\n"))


def echo_client(pairs: list[tuple[str, str]]) -> list[str]:
    """Answers by rule: names a quoted or angle-bracketed part, and a kind by what it holds."""
    out = []
    for system, user in pairs:
        low = user.lower()
        kind = "Cross-site Scripting" if "<" in low else "SQL Injection" if "'" in low or " or " in low else "Path Traversal" if "../" in low else "normal"
        if "Final Answer" in system:
            out.append("Final Answer: " + ("" if kind == "normal" else user.split("\n")[-1]))
        else:
            out.append(f"Final Classification: {kind}")
    return out


def hash_encoder(texts: list[str], size: int = 16) -> list[list[float]]:
    """Counts of characters by code, for tests."""
    return [[float(sum(ord(c) % size == k for c in t)) for k in range(size)] for t in texts]
