"""Model clients: what answers prompts, with retries, caching and prices.

Clients of services are in providers.py. A client is asked inside executors, once for each distinct prompt, and replies are
written before anything reads them.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from functools import lru_cache
from hashlib import sha256
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.checkpoints import cut
from docloom.operators.evaluation import call_cost
from docloom.plans.prompts import tokenize
from docloom.schemas import PROMPT_TOKENS

KINDS = ("gpt", "azure", "anthropic", "cohere", "google", "mistral", "ollama", "replicate", "together", "custom")
TEXT_ONLY = frozenset({"replicate", "together"})


@dataclass(frozen=True)
class Spec:
    """A model: its kind, prices and limits. Specs that differ in any field are different models."""

    model_id: str
    kind: str = "custom"
    name: str | None = None
    price_in: float = 0
    price_out: float = 0
    price_image: float = 0
    max_tokens: int = PROMPT_TOKENS
    max_answer: int = 1024
    multimodal: bool = False
    max_images: int | None = None
    max_image_pixels: int | None = None
    system: str | None = None
    temperature: float = 0
    attempts: int = 5
    wait: tuple[float, float] = (2, 20)
    endpoint: str | None = None
    api_version: str | None = None
    api_key: str | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind of model {self.kind!r}")
        if self.multimodal and self.kind in TEXT_ONLY:
            raise ValueError(f"models of kind {self.kind} take text only")

    def key(self) -> str:
        return sha256(repr(sorted(asdict(self).items())).encode()).hexdigest()


def config(kind: str) -> Callable[..., Spec]:
    """A function that makes specs of one kind: name, then any other fields; the id is the name unless given."""
    return lambda name, model_id=None, **more: Spec(model_id or name, kind, name, **more)


gpt, azure, anthropic, cohere, google, mistral, ollama, replicate, together = map(config, KINDS[:-1])


class RetryError(Exception):
    """A client was asked as often as its spec allows and never answered."""


class RateLimited(Exception):
    """To be asked again later. Told by the mark, as executors may hold this package twice: as sent by the driver and as imported by a client's module."""

    again = True


@dataclass(frozen=True)
class Reply:
    """A reply's text and the tokens that the service counted, if it does."""

    text: str
    tokens_in: int | None = None
    tokens_out: int | None = None


class Client(Protocol):
    def ask(self, prompt: str, images: list[bytes]) -> str | Reply: ...


ClientFactory = Callable[[Spec], Client]


class Rules:
    """A client that answers by rules: functions of the prompt, the first that gives a text."""

    def __init__(self, *rules: Callable[[str], str | None]) -> None:
        self.rules = rules

    def ask(self, prompt: str, images: list[bytes]) -> str:
        return next((x for r in self.rules if (x := r(prompt)) is not None), "n/a")


def asking(spec: Spec, factory: ClientFactory, sleep: Callable[[float], None] = time.sleep, cached: int = 128) -> Callable[[str, tuple[bytes, ...]], str | Reply]:
    """A function that asks a client, again with random, growing waits if it is limited, and remembers the last answers."""
    client = factory(spec)

    @lru_cache(cached)
    def ask(prompt: str, images: tuple[bytes, ...] = ()) -> str | Reply:
        for n in range(spec.attempts):
            try:
                return client.ask(prompt, list(images))
            except Exception as e:
                if not getattr(e, "again", False):
                    raise
                if n + 1 < spec.attempts:
                    low, high = spec.wait
                    sleep(min(high, max(low, random.uniform(0, 2**n))))
        raise RetryError(spec.model_id)

    return ask


#: The model that answers with what is known to be true.
ASSIGNED = "assigned"


@dataclass(frozen=True)
class Custom:
    """A model of one's own in place of prompts: functions of elements and an item that give answers or locations as replies.py does."""

    answers: Callable[[DataFrame, object], DataFrame] | None = None
    locations: Callable[[DataFrame, object], DataFrame] | None = None


class Registry:
    """Clients by the kind of model, specs by id (the first of an id counts), and models of one's own by id."""

    def __init__(self, specs: list[Spec] = (), factories: dict[str, ClientFactory] | None = None, custom: dict[str, Custom] | None = None) -> None:
        self.specs, self.factories, self.custom = list(specs), dict(factories or {}), dict(custom or {})

    def spec(self, model_id: str) -> Spec:
        found = next((s for s in self.specs if s.model_id == model_id), None)
        if found is None:
            raise ValueError(f"no model {model_id!r}")
        return found

    def factory(self, spec: Spec) -> ClientFactory:
        if spec.kind not in self.factories:
            raise ValueError(f"no client for models of kind {spec.kind!r}")
        return self.factories[spec.kind]


def ask(prompts: DataFrame, spec: Spec, factory: ClientFactory, prompt_col: str = "prompt", failed_as_null: bool = False, images_col: str | None = None, store: str | None = None) -> DataFrame:
    """prompts with ``reply`` and ``cost``. Equal prompts (with equal images) are asked once; replies are written before they are joined back.

    They are written to the checkpoint folder, or with ``store``, a folder of Parquet, beside those that the model gave earlier,
    which aren't asked for again. Images (``images_col``: an array of bytes) are shown to models that take them. A null prompt has a null reply. A
    client that never answers fails the job, or gives null, which isn't stored.
    """
    shown = F.col(images_col) if images_col and spec.multimodal else F.array().cast("array<binary>")
    key = F.sha2(F.concat_ws("|", F.lit(spec.key()), F.sha2(prompt_col, 256), F.array_join(F.transform(shown, lambda i: F.sha2(i, 256)), "|")), 256)
    keyed = prompts.withColumn("_key", F.when(F.col(prompt_col).isNotNull(), key))
    distinct = keyed.where("_key is not null").select("_key", F.col(prompt_col).alias("_prompt"), shown.alias("_images")).dropDuplicates(["_key"])
    spark = prompts.sparkSession
    known = None
    if store is not None and spark._jvm.org.apache.hadoop.fs.Path(store).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(store)):
        known = spark.read.parquet(store)
        distinct = distinct.join(known, "_key", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = asking(spec, factory)

        def reply(p: str, images: list[bytes]) -> Reply:
            try:
                got = one(p, tuple(images))
            except RetryError:
                if failed_as_null:
                    return Reply(None)
                raise
            return Reply(got) if isinstance(got, str) else got

        for batch in batches:
            got = [reply(p, i) for p, i in zip(batch.column("_prompt").to_pylist(), batch.column("_images").to_pylist())]
            counts = [pa.array([getattr(r, c) for r in got], pa.int32()) for c in ("tokens_in", "tokens_out")]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_prompt"), pa.array([len(i) for i in batch.column("_images").to_pylist()], pa.int32()), pa.array([r.text for r in got], pa.string()), *counts], ["_key", "_prompt", "_n", "reply", "_in", "_out"])

    replies = distinct.mapInArrow(run, "_key string, _prompt string, _n int, reply string, _in int, _out int")
    used = lambda counted, text: F.coalesce(counted, F.size(tokenize(F.coalesce(text, F.lit("")))))
    cost = call_cost(used("_in", F.col("_prompt")), used("_out", F.col("reply")), F.col("_n"), F.lit(spec.price_in), F.lit(spec.price_out), F.lit(spec.price_image))
    priced = replies.select("_key", "reply", cost.alias("cost"))
    if store is None:
        priced = cut(priced)
    else:
        fresh = cut(priced)
        fresh.where("reply is not null").write.mode("append").parquet(store)
        # What was known costs nothing this time.
        priced = fresh if known is None else fresh.unionByName(known.select("_key", "reply", F.lit(0).cast("decimal(38,10)").alias("cost")))
    return keyed.join(priced, "_key", "left").drop("_key")


def ask_with_fallback(prompts: DataFrame, models: list[tuple[Spec, ClientFactory]], prompt_col: str = "prompt", images_col: str | None = None) -> DataFrame:
    """prompts with ``reply``, ``cost`` and ``model``: of the first model that answers; each is only asked what those before it left."""
    out, open_ = None, prompts
    for spec, factory in models:
        asked = ask(open_, spec, factory, prompt_col, failed_as_null=True, images_col=images_col).withColumn("model", F.lit(spec.model_id))
        good = asked.where("reply is not null")
        out = good if out is None else out.unionByName(good)
        open_ = asked.where("reply is null").select(*prompts.columns)
    rest = open_.select("*", F.lit(None).cast("string").alias("reply"), F.lit(None).cast("decimal(38,10)").alias("cost"), F.lit(None).cast("string").alias("model"))
    return rest if out is None else out.unionByName(rest)
