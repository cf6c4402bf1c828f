"""Retry with exponential backoff (R10) and dead letters (R11): the closed form."""

import pytest

from docket.config import Config
from docket.operators.infer import FaultInjectingClient, StubClient, call_with_retry, infer


class Flaky:
    def __init__(self, k):
        self.k = k
        self.calls = 0

    def complete(self, request):
        self.calls += 1
        if self.calls <= self.k:
            raise RuntimeError(f"fail {self.calls}")
        return StubClient().complete(request)


REQ = {"filename": "a.docx", "model": "o1", "messages": [{"role": "user", "content": "x\n\nbody"}]}


@pytest.mark.parametrize("k", range(5))
@pytest.mark.parametrize("m", range(4))
def test_closed_form(k, m):
    slept = []
    cfg = Config(max_retries=m, retry_delay_s=1.0)
    resp, err, attempts, waited, _ = call_with_retry(Flaky(k), REQ, cfg, sleep=slept.append)
    assert attempts == min(k + 1, m + 1)
    assert waited == 1000 * (2 ** min(k, m) - 1)
    assert sum(slept) == pytest.approx(waited / 1000)
    assert (resp is not None) == (k <= m)
    if k > m:
        assert err == f"Failed after {m} retries: fail {m + 1}"


def test_negative_retries_rejected():
    with pytest.raises(ValueError):
        Config(max_retries=-1)


def test_invalid_answer_is_retried():
    class Bad:
        calls = 0

        def complete(self, request):
            Bad.calls += 1
            return "{}" if Bad.calls == 1 else StubClient().complete(request)

    resp, err, attempts, _, _ = call_with_retry(Bad(), REQ, Config(max_retries=1, retry_delay_s=0), sleep=lambda s: None)
    assert err is None and attempts == 2


def test_infer_one_row_per_request(spark):
    rows = [(f"{i:09d}.docx", f"text {i}", f"k{i}") for i in range(40)]
    reqs = spark.createDataFrame(rows, "filename string, text string, request_key string")
    cfg = Config(max_retries=1, retry_delay_s=0.001, threads_per_task=4, inference_partitions=3)
    client = lambda: FaultInjectingClient(StubClient(), lambda fn: int(fn[:9]) % 3)
    out = {r["filename"]: r for r in infer(reqs, client, cfg).collect()}
    assert len(out) == 40
    for fn, r in out.items():
        k = int(fn[:9]) % 3
        assert r["attempts"] == min(k + 1, 2)
        assert (r["error"] is None) == (k <= 1)
