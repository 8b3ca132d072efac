"""A model in a process of its own: one for all Python workers of a machine, started on use, ended when idle.

A model is a function without arguments that loads it and returns ``score(query, texts)``: scores in the order of the texts, or
pairs (index, score), where texts that are not named score 0.  Workers of Spark come and go and may run many at a time;
they reach the process by a socket, start it if there is none, and start it again if it fails.
"""

from __future__ import annotations

import fcntl
import hashlib
import os
import signal
import subprocess
import sys
import tempfile
import time
from collections.abc import Callable
from multiprocessing.connection import Client, Connection, Listener
from pathlib import Path

from pyspark import cloudpickle

IDLE_SECONDS, CALL_SECONDS, START_SECONDS = 120.0, 120.0, 60.0


class ModelError(ValueError):
    """The model refused a request; the process lives on."""


class ModelService:
    """Scores texts by a model that other processes share.  ``load`` is sent by value."""

    def __init__(self, load: Callable[[], Callable], idle: float = IDLE_SECONDS, timeout: float = CALL_SECONDS) -> None:
        self.code, self.idle, self.timeout = cloudpickle.dumps(load), idle, timeout
        self.name = hashlib.sha256(self.code + repr(idle).encode()).hexdigest()[:24]

    @property
    def address(self) -> str:
        return f"{tempfile.gettempdir()}/shelfmark-{os.getuid()}-{self.name}"

    def _connect(self) -> Connection:
        return Client(f"{self.address}.sock", family="AF_UNIX", authkey=self.name.encode())

    def running(self) -> int | None:
        """The process, if it answers."""
        try:
            with self._connect() as line:
                line.send(None)
                return line.recv() if line.poll(self.timeout) else None
        except (OSError, EOFError):
            return None

    def _start(self) -> None:
        with open(f"{self.address}.lock", "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)  # of several workers, one starts it
            if self.running() is not None:
                return
            root = str(Path(__file__).resolve().parents[2])
            env = os.environ | {"PYTHONPATH": os.pathsep.join([root, *sys.path])}
            process = subprocess.Popen([sys.executable, "-m", __name__, f"{self.address}.sock", self.name, str(self.idle)], stdin=subprocess.PIPE, stdout=subprocess.DEVNULL, env=env, start_new_session=True)
            process.stdin.write(self.code)
            process.stdin.close()
            end = time.monotonic() + START_SECONDS
            while self.running() is None:
                if process.poll() is not None or time.monotonic() > end:
                    process.kill()
                    raise RuntimeError("the model's process did not start")
                time.sleep(0.05)

    def score(self, query: str, texts: list[str]) -> list[float]:
        """A score for each text, higher is better.  A process that died is started again, once."""
        for attempt in range(2):
            try:
                if attempt or self.running() is None:
                    self._start()
                with self._connect() as line:
                    line.send((query, list(texts)))
                    if not line.poll(self.timeout):
                        self.stop()
                        raise TimeoutError(f"the model did not answer within {self.timeout} seconds")
                    ok, found = line.recv()
                if not ok:
                    raise ModelError(found)
                return by_index(found, len(texts))
            except (EOFError, ConnectionError):
                continue
        raise RuntimeError("the model's process failed twice")

    __call__ = score

    def stop(self) -> None:
        pid = self.running()
        if pid:
            os.kill(pid, signal.SIGKILL)


def by_index(found: list, n: int) -> list[float]:
    """Scores in order, or by index with 0 for those that are missing."""
    if found and isinstance(found[0], (tuple, list)):
        scores = [0.0] * n
        for index, score in found:
            if 0 <= index < n:
                scores[index] = float(score)
        return scores
    if len(found) != n:
        raise ModelError(f"{len(found)} scores for {n} texts")
    return [float(s) for s in found]


def serve(path: str, key: str, idle: float) -> None:
    """Answers requests one at a time until none comes for ``idle`` seconds.  The model is loaded with the first one."""
    load = cloudpickle.loads(sys.stdin.buffer.read())
    if os.path.exists(path):
        os.unlink(path)  # of a process that died
    model = None
    with Listener(path, family="AF_UNIX", authkey=key.encode()) as listener:
        listener._listener._socket.settimeout(idle)
        while True:
            try:
                with listener.accept() as line:
                    request = line.recv()
                    if request is None:
                        line.send(os.getpid())
                        continue
                    try:
                        model = model or load()
                        line.send((True, list(model(*request))))
                    except Exception as error:  # a bad request must not end the process
                        line.send((False, f"{type(error).__name__}: {error}"))
            except TimeoutError:
                return
            except (EOFError, ConnectionError):
                continue  # the worker that asked is gone


if __name__ == "__main__":
    serve(sys.argv[1], sys.argv[2], float(sys.argv[3]))
