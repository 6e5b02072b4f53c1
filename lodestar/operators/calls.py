"""Calls to a model: a few at a time inside a task, each with its own deadline."""

from __future__ import annotations

import json
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

Model = Callable[[list[str]], list[str]]


class NotServed(Exception):
    """The endpoint answers but doesn't know the call; another form of it may do."""


@dataclass(frozen=True)
class Config:
    """How a model is called; ``concurrency`` calls of a task run at a time, ``retries`` further ones follow an error."""

    endpoint: str = "http://127.0.0.1:11434/v1"
    model: str = ""
    api_key: str = ""
    timeout_s: float = 60
    temperature: float = 0.2
    max_tokens: int = 2048
    concurrency: int = 3
    retries: int = 0

    def updated(self, **changes) -> Config:  # noqa: ANN003
        """With the given values; those that are None stay as they are."""
        new = replace(self, **{k: v for k, v in changes.items() if v is not None})
        return replace(new, endpoint=new.endpoint.rstrip("/"), model=new.model.strip(), api_key=new.api_key.strip())


def pooled(model: Model, prompts: Sequence[str], config: Config = Config(), fallback: Model | None = None) -> list[tuple[str | None, str | None]]:
    """(answer, error) of each prompt, in order; one of the two is None.

    A call that isn't back after ``timeout_s`` is given up: its thread is left behind (it ends with the
    worker), another takes its place in the pool, and no other prompt waits longer for it. A call that
    fails is repeated ``retries`` times. Where the model says ``NotServed``, ``fallback`` is asked instead.
    A thread makes one call after another, as starting one takes longer than a short call.
    """
    out: list[tuple[str | None, str | None]] = [(None, None)] * len(prompts)
    waiting = [(i, config.retries) for i in range(len(prompts))][::-1]
    # who takes a call out of here settles it, its thread or the loop below; single steps on lists and dicts need no lock
    running: dict[tuple[int, int], float] = {}
    settled: list[int] = []
    over = threading.Event()

    def one(i: int) -> tuple[str | None, str | None]:
        try:
            try:
                return model([prompts[i]])[0], None
            except NotServed:
                if fallback is None:
                    raise
                return fallback([prompts[i]])[0], None
        except Exception as e:  # noqa: BLE001  whatever a model raises is that prompt's error
            return None, str(e) or type(e).__name__

    def settle(i: int, answer: str | None, error: str | None) -> None:
        out[i] = answer, error
        settled.append(i)
        if len(settled) == len(prompts):
            over.set()

    def work() -> None:
        while True:
            try:
                call = i, turn = waiting.pop()
            except IndexError:
                return
            running[call] = time.monotonic() + config.timeout_s
            answer, error = one(i)
            if running.pop(call, None) is None:
                return  # given up before
            if error is not None and turn:
                waiting.append((i, turn - 1))
            else:
                settle(i, answer, error)

    def begin(n: int) -> None:
        for _ in range(n):
            threading.Thread(target=work, daemon=True).start()

    begin(min(max(1, config.concurrency), len(prompts)))
    while prompts and not over.is_set():
        next_end = min(running.copy().values(), default=time.monotonic() + config.timeout_s)
        over.wait(max(0.0, next_end - time.monotonic()))
        now = time.monotonic()
        late = [call[0] for call, end in running.copy().items() if end <= now and running.pop(call, None) is not None]
        for i in late:
            settle(i, None, f"no answer within {config.timeout_s:g} s")
        begin(len(late))
    return out


def posted(url: str, body: dict, config: Config) -> dict:
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {config.api_key}"} if config.api_key else {})
    request = urllib.request.Request(url, json.dumps(body).encode(), headers)
    try:
        with urllib.request.urlopen(request, timeout=config.timeout_s) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as e:
        if e.code == 404:
            raise NotServed(url) from e
        raise


def chat_model(config: Config, system: str = "") -> Model:
    """A model behind a chat endpoint: POST .../chat/completions with the configured model and temperature."""
    base = config.endpoint
    url = base if "/chat/completions" in base else f"{base}/chat/completions" if base.endswith("/v1") else f"{base}/v1/chat/completions"

    def ask(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            messages = [{"role": "system", "content": system}] * bool(system) + [{"role": "user", "content": p}]
            answer = posted(url, {"model": config.model, "messages": messages, "temperature": config.temperature, "max_tokens": config.max_tokens}, config)
            out.append(((answer.get("choices") or [{}])[0].get("message") or {}).get("content") or "")
        return out

    return ask


def native_model(config: Config) -> Model:
    """The same model through a local server's own form: POST .../api/generate."""
    url = config.endpoint.removesuffix("/v1") + "/api/generate"

    def ask(prompts: list[str]) -> list[str]:
        return [posted(url, {"model": config.model, "prompt": p, "stream": False, "options": {"temperature": config.temperature}}, config).get("response") or "" for p in prompts]

    return ask
