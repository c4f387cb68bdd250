"""A queue of Spark jobs: priority first, bounded concurrency, pause, cancel, deadline.

Runners are callables (progress, params, gate); each runs under its own Spark job tag, so cancelling interrupts what it
has on the cluster. ``gate`` is called at a runner's own boundaries and blocks while a priority job waits or the job is
paused.
"""

from __future__ import annotations

import itertools
import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

FINISHED = ("done", "failed", "cancelled")


@dataclass
class Job:
    id: str
    kind: str
    run: Callable[..., Any]
    params: dict = field(default_factory=dict)
    priority: bool = False
    status: str = "queued"
    progress: Any = None
    result: Any = None
    error: str | None = None
    paused: threading.Event = field(default_factory=threading.Event)
    over: threading.Event = field(default_factory=threading.Event)
    cancelled: bool = False


class Cancelled(Exception):
    """Raised in a runner at its next gate after its job was cancelled."""


class Queue:
    def __init__(self, spark=None, concurrent: int = 3, deadline_s: float = 240 * 60, keep: int = 200) -> None:
        self.spark, self.concurrent, self.deadline_s, self.keep = spark, concurrent, deadline_s, keep
        self.jobs: dict[str, Job] = {}
        self.waiting: list[Job] = []
        self.running: list[Job] = []
        self.lock = threading.RLock()
        self.ids = itertools.count(1)

    def submit(self, kind: str, run: Callable[..., Any], params: dict | None = None, priority: bool = False) -> Job:
        """Priority jobs queue before others, in order among themselves, and hold running ones at their next gate."""
        with self.lock:
            job = Job(f"job-{next(self.ids)}", kind, run, params or {}, priority)
            self.jobs[job.id] = job
            at = sum(1 for j in self.waiting if j.priority) if priority else len(self.waiting)
            self.waiting.insert(at, job)
            self._pump()
        return job

    def _pump(self) -> None:
        """Resume what was held, start what there is room for, and ask one running job to make room for a priority job.

        A job gives its place away when it has reached its gate, not when it is asked to.
        """
        with self.lock:
            if not any(j.priority for j in (*self.waiting, *self.running)):
                for j in self.running:
                    if j.paused.is_set():
                        j.paused.clear()
                        j.status = "running"
            while self.waiting and len(self._active()) < self.concurrent:
                job = self.waiting.pop(0)
                job.status = "running"
                self.running.append(job)
                threading.Thread(target=self._work, args=(job,), daemon=True).start()
            if any(j.priority for j in self.waiting) and not any(j.paused.is_set() for j in self.running):
                asked = next((j for j in self.running if not j.priority), None)
                if asked:
                    asked.paused.set()

    def _active(self) -> list[Job]:
        return [j for j in self.running if j.status != "paused"]

    def _gate(self, job: Job) -> None:
        while job.paused.is_set() and not job.cancelled:
            with self.lock:
                if job.paused.is_set():
                    job.status = "paused"
                self._pump()
            threading.Event().wait(0.01)
        if job.cancelled:
            raise Cancelled(job.id)

    def _work(self, job: Job) -> None:
        timer = threading.Timer(self.deadline_s, lambda: self.cancel(job.id, "deadline"))
        timer.daemon = True
        timer.start()
        if self.spark is not None:
            self.spark.addTag(job.id)
        try:
            job.result = job.run(lambda p: setattr(job, "progress", p), job.params, lambda: self._gate(job))
            outcome, error = ("cancelled", job.error) if job.cancelled else ("done", None)
        except Cancelled:
            outcome, error = "cancelled", job.error
        except Exception as e:  # a runner's failure is its job's result
            outcome, error = ("cancelled" if job.cancelled else "failed"), job.error or str(e)
        finally:
            timer.cancel()
            if self.spark is not None:
                self.spark.removeTag(job.id)
        with self.lock:
            job.status, job.error = outcome, error
            self.running.remove(job)
            old = [j for j in self.jobs.values() if j.status in FINISHED]
            for j in old[: max(0, len(old) - self.keep)]:
                del self.jobs[j.id]
            self._pump()
        job.over.set()

    def cancel(self, job_id: str, why: str | None = None) -> bool:
        with self.lock:
            job = self.jobs.get(job_id)
            if job is None or job.status in FINISHED:
                return False
            job.cancelled, job.error = True, why
            if job in self.waiting:
                self.waiting.remove(job)
                job.status = "cancelled"
                job.over.set()
            elif self.spark is not None:
                self.spark.interruptTag(job.id)
            return True

    def move(self, job_id: str, place: int) -> bool:
        """To another place among the waiting jobs of its own kind of priority."""
        with self.lock:
            job = next((j for j in self.waiting if j.id == job_id), None)
            if job is None:
                return False
            self.waiting.remove(job)
            first = sum(1 for j in self.waiting if j.priority)
            low, high = (0, first) if job.priority else (first, len(self.waiting))
            self.waiting.insert(min(max(place, low), high), job)
            return True

    def update(self, job_id: str, **params: Any) -> bool:
        """New parameters, while the job still waits."""
        with self.lock:
            job = next((j for j in self.waiting if j.id == job_id), None)
            if job:
                job.params.update(params)
            return job is not None

    def place(self, job_id: str) -> int | None:
        return next((i for i, j in enumerate(self.waiting) if j.id == job_id), None)
