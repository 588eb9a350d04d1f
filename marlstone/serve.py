"""An HTTP façade: single transactions in, decisions out, scored in micro-batches by the same plans.

`GET /ready` answers 200 once the session and the references are there. `POST /fraud-score` takes one
transaction as JSON and answers `{"approved": ..., "fraud_score": ...}`. Requests that arrive while a
batch is scored wait for the next one, up to `most` of them; one that waits longer than `timeout` gets
504, a body that isn't a transaction 400. A micro-batch is a Spark job, so an answer takes tenths of a
second at best: the façade is for tests and small loads, streams are for the rest.
"""

from __future__ import annotations

import json
import queue
import threading
from concurrent.futures import Future
from concurrent.futures import TimeoutError as Late
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame

from .plans.scoring import decide
from .session import ready
from .sources.readers import transactions_of

TIMEOUT = 2.001


class Scorer:
    """Collects requests and decides on them together, one batch at a time."""

    def __init__(self, refs: DataFrame, most: int = 256, **how) -> None:
        self.spark, self.refs, self.most, self.how = refs.sparkSession, refs.persist(), most, how
        self.waiting: queue.Queue[tuple[str, Future] | None] = queue.Queue()
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()

    def ask(self, body: str) -> Future:
        """Of (approved, fraud_score), or of None if the body isn't a transaction."""
        answer: Future = Future()
        self.waiting.put((body, answer))
        return answer

    def close(self) -> None:
        self.waiting.put(None)
        self.thread.join()
        self.refs.unpersist()

    def _run(self) -> None:
        while (first := self.waiting.get()) is not None:
            batch, last = [first], False
            while len(batch) < self.most and not self.waiting.empty():
                if (one := self.waiting.get()) is None:
                    last = True
                    break
                batch.append(one)
            try:
                found = self._decide([body for body, _ in batch])
            except Exception as e:  # a failed batch answers its own requests only
                for _, answer in batch:
                    answer.set_exception(e)
            else:
                for i, (_, answer) in enumerate(batch):
                    answer.set_result(found.get(i))
            if last:
                return

    def _decide(self, bodies: list[str]) -> dict[int, tuple[bool, float]]:
        rows = transactions_of(self.spark.createDataFrame(list(enumerate(bodies)), "idx long, value string"))
        decided = decide(rows.where("NOT malformed"), self.refs, **self.how)
        return {r["idx"]: (r["approved"], r["fraud_score"]) for r in decided.collect()}


def server(refs: DataFrame, host: str = "127.0.0.1", port: int = 9999, timeout: float = TIMEOUT, **how) -> ThreadingHTTPServer:
    """A server, not yet running: call serve_forever(), then shutdown() and scorer.close()."""
    scorer = Scorer(refs, **how)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, status: int, body: dict | None = None) -> None:
            data = b"" if body is None else json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802
            if self.path != "/ready":
                return self._answer(404)
            return self._answer(200 if ready(scorer.spark, scorer.refs) else 503)

        def do_POST(self) -> None:  # noqa: N802
            if self.path != "/fraud-score":
                return self._answer(404)
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode("utf-8", "replace")
            try:
                found = scorer.ask(body).result(timeout)
            except Late:
                return self._answer(504, {"error": "too late"})
            except Exception:
                return self._answer(500, {"error": "not scored"})
            if found is None:
                return self._answer(400, {"error": "not a transaction"})
            return self._answer(200, {"approved": found[0], "fraud_score": found[1]})

        def log_message(self, *args) -> None:
            pass

    made = ThreadingHTTPServer((host, port), Handler)
    made.scorer = scorer
    return made
