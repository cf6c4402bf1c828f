"""Batch inference with an external model.

``infer`` runs one ``mapInPandas`` task per partition; each task owns a client and
a bounded thread pool, so the cluster-wide ceiling on concurrent calls is
(running tasks x ``threads_per_task``). Each request is retried with exponential
backoff on any error (including a response that fails the quick schema check)
and dead-lettered when the attempts run out. Nothing is raised out of a task for
a single bad document, so no batch of results can be lost.

The function is non-deterministic and paid: write its output once
(:func:`docket.plans.casework.answer`) and read the written table downstream.
"""

from __future__ import annotations

import heapq
import itertools
import json
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket.config import Config
from docket.operators.requests import PromptTemplate
from docket.schema import ANALYSIS_FIELDS
from docket.session import ship_package

RESPONSE_DDL = (
    "filename string, request_key string, response string, error string,"
    " attempts int, waited_ms bigint, latency_s double, began_s double"
)


class ModelClient(Protocol):
    """Anything that turns one request into the model's raw text answer."""

    def complete(self, request: dict) -> str: ...


ClientFactory = Callable[[], ModelClient]


def params_for(model: str) -> dict:
    """R07 on the driver side: same rule as :func:`docket.operators.requests.model_params`."""
    return {"reasoning_effort": "high"} if model == "o1" else {"temperature": 0}


def _unique_keys(pairs: list[tuple]) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("response has a duplicate key")
    return dict(pairs)


def _no_constant(name: str) -> None:
    raise ValueError(f"response is not valid JSON: {name}")


def check_response(raw: str) -> None:
    """In-task check of the nine-field contract, as strict as the Spark side; raises so the call is retried.

    The authoritative check is the Spark-side :func:`docket.operators.validate.validate`.
    """
    obj = json.loads(raw, object_pairs_hook=_unique_keys, parse_constant=_no_constant)
    if not isinstance(obj, dict):
        raise ValueError("response is not a JSON object")
    for name, kind in ANALYSIS_FIELDS:
        if name not in obj:
            raise ValueError(f"missing field {name}")
        v = obj[name]
        if kind == "string" and not isinstance(v, str):
            raise ValueError(f"field {name} is not a string")
        if kind == "list" and not (isinstance(v, list) and all(isinstance(x, str) for x in v)):
            raise ValueError(f"field {name} is not a list of strings")


def call_with_retry(client: ModelClient, request: dict, config: Config,
                    sleep: Callable[[float], None] = time.sleep) -> tuple:
    """One document: up to ``max_retries + 1`` attempts, backoff ``delay * 2**attempt``.

    Returns ``(response, error, attempts, waited_ms, latency_s)``.
    """
    start = time.monotonic()
    waited = 0
    m = config.max_retries
    for attempt in range(m + 1):
        try:
            raw = client.complete(request)
            check_response(raw)
            return raw, None, attempt + 1, waited, time.monotonic() - start
        except Exception as e:  # any error is retried, as a failed validation is
            if attempt < m:
                w = config.retry_delay_ms * (2 ** attempt)
                sleep(w / 1000.0)
                waited += w
            else:
                return None, f"Failed after {m} retries: {e}", attempt + 1, waited, time.monotonic() - start
    raise AssertionError("unreachable")


def _partition_fn(client_factory: ClientFactory, config: Config, template: PromptTemplate):
    params = params_for(config.model_name)
    threads = config.threads_per_task
    out_rows = config.arrow_batch_rows

    def call(client: ModelClient, request: dict) -> str:
        raw = client.complete(request)
        check_response(raw)
        return raw

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = client_factory()
        pool = ThreadPoolExecutor(max_workers=threads)
        running: dict = {}  # future -> job
        backing_off: list = []  # heap of (due, number, job): a backoff holds no thread
        done: list[tuple] = []
        number = itertools.count()

        def flush():
            cols = ["filename", "request_key", "response", "error", "attempts", "waited_ms", "latency_s", "began_s"]
            frame = pd.DataFrame(done, columns=cols)
            done.clear()
            return frame.astype({"attempts": "int32", "waited_ms": "int64", "latency_s": "float64", "began_s": "float64"})

        def start(job: dict):
            job["attempts"] += 1
            running[pool.submit(call, client, job["request"])] = job

        def settle():
            """Take whatever completes first; start retries that are due."""
            now = time.monotonic()
            while backing_off and backing_off[0][0] <= now:
                start(heapq.heappop(backing_off)[2])
            timeout = max(0.0, backing_off[0][0] - now) if backing_off else None
            if not running:
                time.sleep(timeout or 0.0)
                return
            for future in wait(running, timeout=timeout, return_when=FIRST_COMPLETED).done:
                job, error = running.pop(future), future.exception()
                m = config.max_retries
                if error is not None and job["attempts"] <= m:
                    pause = config.retry_delay_ms * 2 ** (job["attempts"] - 1)
                    job["waited"] += pause
                    heapq.heappush(backing_off, (time.monotonic() + pause / 1000.0, next(number), job))
                    continue
                done.append((job["filename"], job["key"], None if error else future.result(),
                             f"Failed after {m} retries: {error}" if error else None, job["attempts"], job["waited"],
                             time.monotonic() - job["began"], job["began_at"]))

        try:
            for pdf in batches:
                for fn, text, key in zip(pdf["filename"], pdf["text"], pdf["request_key"]):
                    req = {"filename": fn, "model": config.model_name,
                           "messages": template.messages(text or ""), **params}
                    start({"filename": fn, "key": key, "request": req, "attempts": 0, "waited": 0,
                           "began": time.monotonic(), "began_at": time.time()})
                    # bounded window: at most 2 x threads requests in memory per task
                    while len(running) + len(backing_off) >= 2 * threads:
                        settle()
                    if len(done) >= out_rows:
                        yield flush()
            while running or backing_off:
                settle()
            if done:
                yield flush()
        finally:
            pool.shutdown(wait=True)

    return run


def infer(requests: DataFrame, client_factory: ClientFactory, config: Config,
          template: PromptTemplate | None = None, n_requests: int | None = None) -> DataFrame:
    """``(filename, text, request_key)`` -> one response row per request.

    The input is spread over ``inference_partitions`` tasks, or one
    task per ``requests_per_task`` requests when ``n_requests`` is known (at least
    the default parallelism): document tables often scan as a handful of
    partitions, and small tasks bound what a retried task calls again. A task has a range
    of the request keys (SHA-256, so ranges of equal width hold equally many distinct ones),
    and its answers go to few buckets of the store.
    """
    template = template or PromptTemplate(template_id=config.template_id)
    spark = requests.sparkSession
    ship_package(spark)
    slots = spark.sparkContext.defaultParallelism
    if config.inference_partitions:
        parts = config.inference_partitions
    elif n_requests is not None:
        # whole waves: a multiple of the task slots, so the last wave is not half empty
        wanted = max(2 * slots, -(-n_requests // config.requests_per_task))
        parts = -(-wanted // slots) * slots
    else:
        parts = 2 * slots
    src = requests.select("filename", "text", "request_key")
    if n_requests is None:  # keys may repeat: a range could be one hot key
        src = src.repartition(parts)
    else:
        place = F.conv(F.substring("request_key", 1, 7), 16, 10).cast("bigint") * parts
        src = src.withColumn("_place", F.shiftright(place, 28).cast("int")).repartitionById(parts, "_place").drop("_place")
    return src.mapInPandas(_partition_fn(client_factory, config, template), RESPONSE_DDL)


# -- stub clients (no network is used anywhere in this package) -----------------------


class StubClient:
    """Answers every request with a valid record built from the request text."""

    def complete(self, request: dict) -> str:
        text = request["messages"][-1]["content"]
        body = text.split("\n\n", 1)[-1].strip()
        first = body.split("\n", 1)[0]
        rec = {
            "blue_book_citation": first[:120],
            "summary": body[:200],
            "relevance_level": "Low",
            "reasoning": "stub",
            "key_points": [],
            "citations": [],
            "quotes": [],
            "argument": "stub",
            "support_level": "Does not Support",
        }
        return json.dumps(rec, ensure_ascii=False)


class FaultInjectingClient:
    """Fails the first ``failures(filename)`` calls for each file, then defers to ``inner``."""

    def __init__(self, inner: ModelClient, failures: Callable[[str], int]):
        self.inner = inner
        self.failures = failures
        self.calls: dict[str, int] = {}
        self.lock = threading.Lock()

    def complete(self, request: dict) -> str:
        fn = request["filename"]
        with self.lock:
            n = self.calls.get(fn, 0)
            self.calls[fn] = n + 1
        if n < self.failures(fn):
            raise RuntimeError(f"injected failure on attempt {n + 1}")
        return self.inner.complete(request)


class FixedLatencyClient:
    """Stub with a fixed service time per call (for throughput benchmarks)."""

    def __init__(self, inner: ModelClient, latency_s: float):
        self.inner = inner
        self.latency_s = latency_s

    def complete(self, request: dict) -> str:
        time.sleep(self.latency_s)
        return self.inner.complete(request)
