"""Helpers of a task that is its job's only one: forked processes that see the task's memory.

NumPy counts with the interpreter's lock held, so threads cannot share that work. A
helper is a fork of the task's worker: it reads the arrays that were there before, and
results are written to ``shared`` arrays. Commands and answers go through pipes; a
helper ends when its pipe is closed, so also when the worker dies.
"""

from __future__ import annotations

import mmap
import os
import pickle
import traceback

import numpy as np


def shared(shape, kind=float) -> np.ndarray:
    """Zeros that forked helpers and the task both see; memory is taken as it is written."""
    size = int(np.prod(shape)) * np.dtype(kind).itemsize
    return np.frombuffer(mmap.mmap(-1, max(1, size)), kind, int(np.prod(shape))).reshape(shape)


class Crew:
    """The task's own process and ``helpers - 1`` forks of it, all of which have ``job`` as it was at the start."""

    def __init__(self, helpers: int, job) -> None:
        self.number, self.job, self.pids, self.pipes = helpers, job, [], []
        for own in range(1, helpers):
            (theirs, orders), (ready, said) = os.pipe(), os.pipe()
            if not (pid := os.fork()):
                try:
                    for f in [orders, ready, *(f.fileno() for pair in self.pipes for f in pair)]:
                        os.close(f)
                    self._serve(own, theirs, said)
                finally:
                    os._exit(0)
            os.close(theirs), os.close(said)
            self.pids.append(pid), self.pipes.append((os.fdopen(orders, "wb"), os.fdopen(ready, "rb")))

    def _serve(self, own: int, orders: int, said: int) -> None:
        with os.fdopen(orders, "rb") as source, os.fdopen(said, "wb") as answers:
            while source.peek(1):
                name, args = pickle.load(source)
                try:
                    answer = getattr(self.job, name)(own, self.number, *args), ""
                except Exception:  # noqa: BLE001 - told to the task, which fails
                    answer = None, traceback.format_exc()
                pickle.dump(answer, answers)
                answers.flush()

    def work(self, name: str, *args, alone: bool = False) -> list:
        """What the job's method returns for (number of the helper, helpers, *args), by helper; or done by one ``alone``."""
        others = [] if alone else self.pipes
        order = pickle.dumps((name, args)) if others else b""
        for orders, _ in others:
            orders.write(order)
            orders.flush()
        found = [getattr(self.job, name)(0, len(others) + 1, *args)]
        for _, ready in others:
            answer, error = pickle.load(ready)            # EOFError: the helper died
            if error:
                raise RuntimeError(f"a helper failed: {error}")
            found.append(answer)
        return found

    def __enter__(self) -> "Crew":
        return self

    def __exit__(self, *_) -> None:
        for pair in self.pipes:
            for f in pair:
                f.close()
        for pid in self.pids:
            os.waitpid(pid, 0)
