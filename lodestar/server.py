"""The tool server as a process: one JSON request per line in, one JSON answer per line out.

    python -m lodestar.server /data/project [--snapshot /shared/snap] [--workers 4]

Requests are answered as they get done, not in the order in which they came: each runs in a thread
of its own, under a job tag and in a pool of Spark's fair scheduler. ``notifications/cancelled`` breaks
off the request that it names. Only answers go to standard output; everything else goes to standard error.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import threading
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor, wait

from pyspark.sql import SparkSession

from lodestar.operators.tools import INTERNAL_ERROR, INVALID_REQUEST, PARSE_ERROR, Server


class Loop:
    """Reads requests and writes answers through ``write``; ``workers`` requests run at a time."""

    def __init__(self, server: Server, write: Callable[[str], object], workers: int = 4) -> None:
        self.server, self.write = server, write
        self.context = server.nodes.sparkSession.sparkContext
        self.pool, self.lock = ThreadPoolExecutor(workers), threading.Lock()
        self.cancelled: set[str] = set()

    def answer(self, reply: dict) -> None:
        with self.lock:
            self.write(json.dumps(reply, ensure_ascii=False) + "\n")

    def failed(self, request: object, code: int, message: str) -> None:
        self.answer({"jsonrpc": "2.0", "id": request, "error": {"code": code, "message": message}})

    def run(self, request: dict) -> None:
        name = self.tag(request.get("id"))
        if name in self.cancelled:
            return
        self.context.setLocalProperty("spark.scheduler.pool", name)
        self.context.setInterruptOnCancel(True)
        self.context.addJobTag(name)
        try:
            reply = self.server.handle(request)
        except Exception as e:  # noqa: BLE001  one request's failure is its own answer
            if name not in self.cancelled:
                self.failed(request.get("id"), INTERNAL_ERROR, f"{type(e).__name__}: {str(e)[:300]}")
            return
        finally:
            self.context.removeJobTag(name)
        if reply is not None and name not in self.cancelled:
            self.answer(reply)

    @staticmethod
    def tag(request: object) -> str:
        """Tags hold no commas."""
        return "rpc-" + json.dumps(request).encode().hex()

    def serve(self, lines: Iterable[str]) -> None:
        """Take lines until they end, and wait for what is still running."""
        running = []
        for line in lines:
            if not line.strip():
                continue
            try:
                request = json.loads(line)
            except ValueError:
                self.failed(None, PARSE_ERROR, "Parse error")
                continue
            if not isinstance(request, dict) or not isinstance(request.get("method"), str):
                self.failed(request.get("id") if isinstance(request, dict) else None, INVALID_REQUEST, "Invalid Request")
                continue
            if request["method"] == "notifications/cancelled":
                name = self.tag((request.get("params") or {}).get("requestId"))
                self.cancelled.add(name)
                self.context.cancelJobsWithTag(name)
                continue
            running = [r for r in running if not r.done()] + [self.pool.submit(self.run, request)]
        wait(running)
        self.pool.shutdown()


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lodestar.server")
    parser.add_argument("root")
    parser.add_argument("--snapshot")
    parser.add_argument("--workers", type=int, default=4)
    given = parser.parse_args(argv)
    # whatever writes to standard output from here on, the JVM included, writes to standard error
    out = os.fdopen(os.dup(1), "w", encoding="utf-8", buffering=1)
    os.dup2(2, 1)
    sys.stdout = sys.stderr
    from lodestar.engine import Engine

    spark = SparkSession.builder.appName("lodestar").config("spark.scheduler.mode", "FAIR").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        engine = Engine.scan(spark, given.root, given.snapshot)
        Loop(engine.server(), out.write, given.workers).serve(sys.stdin)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
