"""A model endpoint as a source: requests, calls through an injected client, answers, cache and log."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import udf

from .scheduling import Schedule, all_tried
from .shared import written

#: Bytes of prompts that are worked on at once.
PROMPT_BYTES = 2 << 20
RESULT = "ok boolean, http_status int, text string, prompt_tokens long, completion_tokens long"


def stub_client(prompt: str) -> dict:
    """A client without a network: the answer is a digest of the prompt, a tenth of the prompts fail."""
    digest = hashlib.sha256(prompt.encode()).hexdigest()
    if int(digest[:2], 16) % 10 == 0:
        return {"ok": False, "http_status": 429, "text": "retry after 2"}
    return {"ok": True, "http_status": 200, "text": json.dumps({"answer": digest[:8]}), "prompt_tokens": len(prompt), "completion_tokens": 8}


def call(rows: DataFrame, prompt: str, client: Callable[[str], dict], schedule: Schedule = Schedule(), width: int | None = None, report: bool = False) -> DataFrame:
    """rows with the client's result; failed calls with status 429, 5xx or none are tried again as the schedule says.

    width bounds the tasks, and with the schedule's at_once the calls, that run
    at once; rows keep their order. With report also tries and waited_ms.
    """
    kinds = RESULT + (", tries int, waited_ms long" if report else "")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + [kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = {"ok": pa.bool_(), "http_status": pa.int32(), "text": pa.string(), "prompt_tokens": pa.int64(), "completion_tokens": pa.int64()} | ({"tries": pa.int32(), "waited_ms": pa.int64()} if report else {})
        at = names.index(prompt)
        for batch in batches:
            for part in _slices(batch, at):
                found = list(all_tried(client, part.column(at).to_pylist(), schedule))
                made = [pa.array([x.get(n) for x in found], kind) for n, kind in columns.items()]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*names, *columns])
                del found, made
                pa.default_memory_pool().release_unused()

    names = rows.columns
    return (rows.repartition(width) if width else rows).mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about PROMPT_BYTES of a text column; a longer row stands alone."""
    first, size = 0, 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if k > first and size + n > PROMPT_BYTES:
            yield batch.slice(first, k - first)
            first, size = k, 0
        size += n
    if first < batch.num_rows:
        yield batch.slice(first)


def answer_text(v: Column) -> Column:
    """The text of a provider's answer, whatever its shape (v: VARIANT)."""
    paths = ("$.choices[0].message.content", "$.output_text", "$.output[0].content[0].text", "$.content[0].text", "$.candidates[0].content.parts[0].text", "$.text")
    return F.coalesce(*[F.try_variant_get(v, p, "string") for p in paths])


def usage(v: Column) -> Column:
    """struct(prompt, completion, total) of three usage shapes; a missing total is the sum."""
    number = lambda *paths: F.coalesce(*[F.try_variant_get(v, p, "long") for p in paths])
    prompt = number("$.usage.prompt_tokens", "$.usage.input_tokens", "$.usageMetadata.promptTokenCount")
    completion = number("$.usage.completion_tokens", "$.usage.output_tokens", "$.usageMetadata.candidatesTokenCount")
    return F.struct(prompt.alias("prompt"), completion.alias("completion"), F.coalesce(number("$.usage.total_tokens", "$.usageMetadata.totalTokenCount"), prompt + completion).alias("total"))


def request_body(shape: Column, model: Column, prompt: Column, image: Column) -> Column:
    """The JSON body of a request for each provider shape; the attachment goes on the last message."""
    part = lambda **kw: F.struct(*[v.alias(k) for k, v in kw.items()])
    chat = F.to_json(part(model=model, messages=F.array(part(role=F.lit("user"), content=F.array(part(type=F.lit("text"), text=prompt, url=F.lit(None).cast("string")), part(type=F.lit("image_url"), text=F.lit(None).cast("string"), url=image))))))
    responses = F.to_json(part(model=model, input=F.array(part(role=F.lit("user"), content=F.array(part(type=F.lit("input_text"), text=prompt))))))
    generate = F.to_json(part(contents=F.array(part(role=F.lit("user"), parts=F.array(part(text=prompt))))))
    messages = F.to_json(part(model=model, max_tokens=F.lit(4096), messages=F.array(part(role=F.lit("user"), content=prompt))))
    return F.when(shape == "chat", chat).when(shape == "responses", responses).when(shape == "generate", generate).otherwise(messages)


def provider_target(protocol: Column, endpoint: Column, temperature: Column, supports_temperature: Column, token_parameter: Column) -> Column:
    """A provider row as a call target: shape, endpoint reference, and the parameters it takes."""
    shape = F.when(protocol.contains("responses"), "responses").when(protocol.contains("gemini"), "generate").when(protocol.contains("anthropic"), "messages").otherwise("chat")
    from_env = endpoint.startswith("env:")
    return F.struct(
        shape.alias("shape"), F.when(from_env, F.substring(endpoint, 5, 200)).alias("endpoint_name"), F.when(~from_env, endpoint).alias("endpoint"),
        F.when(supports_temperature, temperature).alias("temperature"), F.when(token_parameter == "max_tokens", 4096).alias("max_tokens"),
    )


def cache_key(*parts: Column) -> Column:
    """Hash of canonical JSON parts: key order inside them does not matter."""
    return F.sha2(F.concat_ws("\n", *[udf.canonical_json(p) for p in parts]), 256)


def read_through(requests: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(answers, new cache rows) of requests (key, prompt): hits come from the cache, misses from compute.

    Only good answers are to be cached. What compute returns is written to the
    shared folder, so that its calls are made once.
    """
    hits = requests.join(cache, "key").withColumn("cached", F.lit(True))
    made = written(compute(requests.join(cache, "key", "left_anti")))
    fresh = made.where("ok").select("key", "text").dropDuplicates(["key"])
    return hits.select("key", "text", "cached").unionByName(made.select("key", "text", F.lit(False).alias("cached"))), fresh


def page_map(pages: DataFrame, cache: DataFrame, client: Callable[[str], dict], schedule: Schedule = Schedule(), width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages with ok, text, cached, tries, waited_ms, new cache rows) of pages (..., prompt) and a cache (key, text).

    Pages with one prompt are asked once, pages that the cache knows not at all;
    a page that fails to the end keeps its row, without a text.
    """
    keyed = pages.withColumn("key", F.sha2("prompt", 256))
    known = cache.groupBy("key").agg(F.min("text").alias("known"))
    asked = keyed.join(known, "key", "left_anti").groupBy("key").agg(F.first("prompt").alias("prompt"))
    made = written(call(asked, "prompt", client, schedule, width, report=True).select("key", "ok", F.when(F.col("ok"), F.col("text")).alias("text"), "tries", "waited_ms"))
    both = keyed.join(known, "key", "left").join(made, "key", "left")
    hit = F.col("known").isNotNull()
    out = both.select(*pages.columns, F.when(hit, True).otherwise(F.col("ok")).alias("ok"), F.coalesce("known", "text").alias("text"), hit.alias("cached"), F.coalesce("tries", F.lit(0)).alias("tries"), F.coalesce("waited_ms", F.lit(0)).cast("long").alias("waited_ms"))
    return out, made.where("ok").select("key", "text")


def log_text(c: Column, limit: int = 20000) -> Column:
    """Payload text for the log: credentials and inline files masked, cut at limit."""
    t = F.regexp_replace(c, "(?i)(bearer\\s+|api[-_]?key\"?\\s*[:=]\\s*\"?)[A-Za-z0-9._-]+", "$1***")
    t = F.regexp_replace(t, "[A-Za-z0-9+/]{200,}={0,2}", "<base64>")
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("..."))).otherwise(t)
