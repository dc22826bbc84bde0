"""Answers of services for the rows of a table, several calls at once: a window of calls slides over the rows of each task."""

from __future__ import annotations

import asyncio
import inspect
import json
import random
import re
import threading
import time
from collections.abc import Awaitable, Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .enrichment import SCHEMA


@dataclass(frozen=True)
class Provider:
    """A service: a plain or async function of title and body that returns a JSON text or None, and how much of the body it is given.

    An async call is cancelled at the deadline. A plain one runs in a thread, which can't be: its row goes on without it, but its place
    in the window stays taken until it returns.
    """

    name: str
    call: Callable[[str, str], str | None | Awaitable[str | None]]
    deadline: float = 30.0
    body_chars: int = 2500


@dataclass(frozen=True)
class Limits:
    """at_once: calls in flight in one task. tries: of a call that fails, with a pause that doubles (and is drawn out by chance) in between.

    A provider that has failed `failures` times in a row within a task is passed over for `rest` seconds there, then tried by one row.
    """

    at_once: int = 5
    tries: int = 2
    pause: float = 0.5
    failures: int = 20
    rest: float = 60.0


def is_answer(raw: str) -> bool:
    """Whether a text, code fences aside, is a JSON object with a title."""
    try:
        found = json.loads(re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", raw))
    except ValueError:
        return False
    return isinstance(found, dict) and isinstance(found.get("refined_title"), str)


@dataclass
class _Breaker:
    """Whether a provider is asked at all just now."""

    limits: Limits
    in_row: int = 0
    until: float = 0.0

    def closed(self) -> bool:
        if self.in_row < self.limits.failures:
            return True
        if (now := time.monotonic()) < self.until:
            return False
        self.until = now + self.limits.rest  # one row tries, the others wait for what becomes of it
        return True

    def told(self, well: bool) -> None:
        self.in_row = 0 if well else self.in_row + 1
        if self.in_row == self.limits.failures:
            self.until = time.monotonic() + self.limits.rest


@dataclass
class Window:
    """The calls of one task. All state of it is the loop's: nothing is shared with other tasks."""

    providers: list[Provider]
    limits: Limits
    breakers: list[_Breaker] = field(init=False)

    def __post_init__(self) -> None:
        self.breakers = [_Breaker(self.limits) for _ in self.providers]
        self.free = asyncio.Semaphore(self.limits.at_once)
        self.threads = ThreadPoolExecutor(self.limits.at_once)

    async def _called(self, provider: Provider, title: str, body: str) -> str | None:
        """One call, for which a place in the window is free."""
        await asyncio.wait_for(self.free.acquire(), provider.deadline)
        given = (title, body[: provider.body_chars])
        if inspect.iscoroutinefunction(provider.call):
            try:
                return await asyncio.wait_for(provider.call(*given), provider.deadline)
            finally:
                self.free.release()
        running = asyncio.get_running_loop().run_in_executor(self.threads, provider.call, *given)

        def over(done: asyncio.Future) -> None:
            self.free.release()
            if not done.cancelled():
                done.exception()  # looked at, also where nobody waits for it any more

        running.add_done_callback(over)
        return await asyncio.wait_for(asyncio.shield(running), provider.deadline)

    async def answered(self, title: str, body: str) -> tuple[str | None, str | None, int, str]:
        """The first provider's answer that is one, its name, the calls made, and what failed on the way."""
        calls, failed = 0, []
        for provider, breaker in zip(self.providers, self.breakers):
            for attempt in range(self.limits.tries):
                if not breaker.closed():
                    failed.append(f"{provider.name}: resting")
                    break
                if attempt:
                    await asyncio.sleep(self.limits.pause * 2 ** (attempt - 1) * random.uniform(0.5, 1.5))  # noqa: S311
                calls += 1
                try:
                    raw = await self._called(provider, title, body)
                except Exception as e:  # noqa: BLE001  told in the row, whatever it is
                    breaker.told(False)
                    failed.append(f"{provider.name}: {type(e).__name__}")
                    continue
                breaker.told(True)
                if isinstance(raw, str) and is_answer(raw):
                    return raw, provider.name, calls, "; ".join(failed)
                failed.append(f"{provider.name}: no answer")
                break  # it has spoken: the next one is asked
        return None, None, calls, "; ".join(failed)

    def run(self, batches: Iterator[pa.RecordBatch], title: str, body: str) -> Iterator[pa.RecordBatch]:
        """Each batch with its answers, as soon as the last of them is there; batches may overtake each other.

        Rows are taken up while places are free, across the ends of batches, so a slow row holds up its own batch alone. No more
        batches are open than there are places, and a few rows more than places are waiting. The loop turns in a thread of its own, so
        calls go on, and deadlines count their time alone, while this generator waits for a batch or for what takes its answers.
        """
        loop = asyncio.new_event_loop()
        turning = threading.Thread(target=loop.run_forever, daemon=True)
        turning.start()
        todo = ((number, batch, at) for number, batch in enumerate(batches) for at in range(len(batch)))
        opened: dict[int, tuple[pa.RecordBatch, list]] = {}
        left: dict[int, int] = {}
        pending: dict[Future, tuple[int, int]] = {}
        try:
            exhausted = False
            while pending or not exhausted:
                while not exhausted and len(pending) < self.limits.at_once:
                    if (row := next(todo, None)) is None:
                        exhausted = True
                        break
                    number, batch, at = row
                    if number not in opened:
                        opened[number], left[number] = (batch, [None] * len(batch)), len(batch)
                    said = self.answered(batch.column(title)[at].as_py() or "", batch.column(body)[at].as_py() or "")
                    pending[asyncio.run_coroutine_threadsafe(said, loop)] = (number, at)
                if not pending:
                    break
                done, _ = wait(pending, return_when=FIRST_COMPLETED)
                for call in done:
                    number, at = pending.pop(call)
                    opened[number][1][at] = call.result()
                    left[number] -= 1
                    if not left[number]:
                        del left[number]
                        yield _with_answers(*opened.pop(number))
        finally:
            for call in pending:
                call.cancel()
            self.threads.shutdown(wait=False, cancel_futures=True)
            asyncio.run_coroutine_threadsafe(_cancelled(), loop).result()
            loop.call_soon_threadsafe(loop.stop)
            turning.join()
            loop.close()


async def _cancelled() -> None:
    """All other tasks of the loop cancelled, and a second given to them to end."""
    others = asyncio.all_tasks() - {asyncio.current_task()}
    for task in others:
        task.cancel()
    if others:
        await asyncio.wait(others, timeout=1)


ANSWER = {"__json": pa.string(), "answered_by": pa.string(), "calls": pa.int32(), "failures": pa.string()}


def _with_answers(batch: pa.RecordBatch, answers: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(values, kind) for values, kind in zip(zip(*answers), ANSWER.values())]
    return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *ANSWER])


def asked(rows: DataFrame, providers: list[Provider], limits: Limits = Limits(), title: str = "title", body: str = "body", tasks: int | None = None) -> DataFrame:  # noqa: B008
    """rows with raw (struct, null where no provider answers), answered_by, calls and failures.

    Providers are asked in turn for each row by itself; what fails for one row fails for no other. Null titles and bodies are given
    as empty ones. At most limits.at_once calls are in flight in a task; with `tasks` rows are dealt over that many, so that
    tasks * at_once calls are in flight in all, which is what a service allows. Rows of a task that is lost are asked again.
    """
    spread = rows.repartition(tasks) if tasks else rows
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", __json string, answered_by string, calls int, failures string"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from Window(providers, limits).run(batches, title, body)

    parsed = F.from_json(text.strip_code_fence(F.col("__json")), SCHEMA, {"mode": "PERMISSIVE"})
    return spread.mapInArrow(ask, schema).withColumn("raw", F.when(F.col("__json").isNotNull(), parsed)).drop("__json")
