"""Session binding, settings, version facts and the recorder of operations."""

from __future__ import annotations

import platform
import sys
from collections.abc import Mapping

import pyspark
from pyspark.sql import SparkSession

from lattica.operators import expr
from lattica.operators.collection import session

_state: dict = {}


def init(backend: str = "spark", blocking: bool = False) -> SparkSession:
    """Binds the active session once; a second call must not ask for something else."""
    if _state and _state != {"backend": backend, "blocking": blocking}:
        raise RuntimeError(f"already initialised with {_state}")
    if backend != "spark":
        raise ValueError(f"no such backend: {backend}")
    _state.update(backend=backend, blocking=blocking)
    return session()


class Config(Mapping):
    """spark.conf as a mapping; knobs of storage formats and threads do not exist here."""

    def __getitem__(self, key: str):
        return session().conf.get(key)

    def __setitem__(self, key: str, value) -> None:
        session().conf.set(key, value)

    def __iter__(self):
        return (r.key for r in session().sql("SET").select("key").toLocalIterator())

    def __len__(self) -> int:
        return sum(1 for _ in self)


config = Config()


def about() -> dict[str, str]:
    return {"library": "lattica", "engine": f"Spark {pyspark.__version__}", "python": sys.version.split()[0], "platform": platform.platform()}


class Recorder:
    """Collects the operations that are built while it runs; ``explain`` shows a result's plan."""

    def __init__(self, *, start: bool = True, max_rows: int | None = None):
        from collections import deque

        self.data: deque[str] = deque(maxlen=max_rows)
        if start:
            self.start()

    @property
    def is_recording(self) -> bool:
        return self in expr.RECORDERS

    def start(self) -> None:
        if not self.is_recording:
            expr.RECORDERS.append(self)

    def stop(self) -> None:
        if self.is_recording:
            expr.RECORDERS.remove(self)

    def clear(self) -> None:
        self.data.clear()

    def __len__(self) -> int:
        return len(self.data)

    def __iter__(self):
        return iter(self.data)

    def __enter__(self) -> Recorder:
        self.start()
        return self

    def __exit__(self, *_) -> None:
        self.stop()

    @staticmethod
    def explain(collection, mode: str = "formatted") -> None:
        collection.df.explain(mode)
