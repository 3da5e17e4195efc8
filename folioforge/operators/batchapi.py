"""Batched image requests, nested responses, job states, chat templates and model backends."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import API_RESPONSE

# Batch size, final states, image sizes, prompts.
BATCH_SIZE = 500
TERMINAL = ["JOB_STATE_SUCCEEDED", "JOB_STATE_FAILED", "JOB_STATE_CANCELLED", "JOB_STATE_EXPIRED"]
IMAGE_SIZES = [(1024, 1024), (1152, 896), (896, 1152), (1152, 864), (864, 1152), (1248, 832), (832, 1248), (1280, 720), (720, 1280), (1344, 576), (576, 1344)]
IMAGE_PROMPT = "この段落のテキストに関連した画像を、画像生成モデルによって生成したいです。その画像を描写する、適切なプロンプトを日本語の文章として出力してください。出力はプロンプトのみとしてください。\n\n対象となる段落:\n"
TITLE_PROMPT = ("このテキストに関して、適切な日本語タイトルを出力してください。出力はタイトルのみとしてください。\n\n対象となるテキスト:\n```\n", "\n```\n")
DOCUMENT_PROMPT = (
    "以下のテキストが書かれた日本語の文書画像を生成してください。\n現代の社会に存在しそうな文書画像にしてください。\n文書は",
    "段組みのものにしてください。\nまた、図のキャプションが含まれている場合はそれに対応する図を文書に挿入してください。\n\n文書に含むべきテキスト:\n```\n",
    "\n```\n",
)


def document_prompt(vertical: Column, columns: Column, text: Column) -> Column:
    a, b, c = (F.lit(x) for x in DOCUMENT_PROMPT)
    return F.concat(a, F.when(vertical, "縦書き").otherwise("横書き"), F.lit("で"), columns.cast("string"), b, text, c)


def request_json(key: Column, prompt: Column) -> Column:
    parts = F.array(F.struct(F.array(F.struct(prompt.alias("text"))).alias("parts")))
    config = F.struct(F.array(F.lit("TEXT"), F.lit("IMAGE")).alias("responseModalities"))
    return F.to_json(F.struct(key.alias("key"), F.struct(parts.alias("contents"), config.alias("generation_config")).alias("request")))


def response_parts(results: DataFrame, column: str = "line") -> DataFrame:
    """Parts of the first candidate: key, index, status, text, extension, data; rows with errors have one status row."""
    r = results.select(F.from_json(column, API_RESPONSE).alias("r"))
    first = F.get(F.col("r.response.candidates"), F.lit(0))["content"]["parts"]
    good = r.where(F.col("r.response").isNotNull()).select(F.col("r.key").alias("key"), F.posexplode(first).alias("index", "part"))
    text = F.nullif(F.col("part.text"), F.lit(""))
    inline = F.col("part.inlineData")
    image = text.isNull() & inline.isNotNull()
    good = good.select(
        "key", "index", F.when(text.isNotNull(), "text").when(image, "image").otherwise("empty").alias("status"), text.alias("text"),
        F.when(image, F.element_at(F.split(inline["mimeType"], "/"), -1)).alias("extension"), F.when(image, F.unbase64(inline["data"])).alias("data"),
    )
    null = lambda t: F.lit(None).cast(t)
    bad = r.where(F.col("r.response").isNull()).select(F.col("r.key").alias("key"), null("int").alias("index"), F.when(F.col("r.error").isNotNull(), "error").otherwise("unknown").alias("status"), F.col("r.error").alias("text"), null("string").alias("extension"), null("binary").alias("data"))
    return good.unionByName(bad)


def job_status(state: Column) -> Column:
    """Pending until terminal, or without a state; only succeeded jobs have results."""
    return F.when(~F.coalesce(state.isin(TERMINAL), F.lit(False)), "pending").when(state == TERMINAL[0], "succeeded").otherwise("failed")


def chat_template(messages: DataFrame, id_col: str, order_col: str) -> DataFrame:
    """One prompt per conversation in the ChatML form, with the opening of the answer."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), "role", "text")))
    said = F.transform(ordered, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["text"], F.lit("<|im_end|>\n")))
    return messages.groupBy(id_col).agg(F.concat(F.array_join(said, ""), F.lit("<|im_start|>assistant\n")).alias("prompt"))


Backend = Callable[[list[str]], list[str]]


def echo_backend(prompts: list[str]) -> list[str]:
    """Deterministic stand-in for a model: the last line that has text, at most 40 characters."""
    return [next((x.strip() for x in reversed(p.splitlines()) if x.strip() and x.strip() != "```"), "")[:40] for p in prompts]


def generate(prompts: DataFrame, backend: Backend = echo_backend, key: str = "key", prompt: str = "prompt") -> DataFrame:
    """key, value: every prompt through a backend, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "value": backend(b["prompt"].fillna("").tolist())})

    return prompts.select(F.col(key).cast("string").alias("key"), F.col(prompt).alias("prompt")).mapInPandas(run, "key string, value string")
