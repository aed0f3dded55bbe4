"""Measuring: seconds of a repeated call, of the stages of a run, and memory and CPU of the driver while something runs."""

from __future__ import annotations

import resource
import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field
from statistics import median

from pyspark.sql import DataFrame


def drain(df: DataFrame) -> None:
    """Compute every row and keep none."""
    df.write.format("noop").mode("overwrite").save()


@dataclass
class Timing:
    seconds: list[float]
    result: object = None

    @property
    def median(self) -> float:
        return median(self.seconds)

    @property
    def least(self) -> float:
        return min(self.seconds)


def timed(f: Callable[[], object], repeats: int = 5, warm_up: int = 1) -> Timing:
    """Seconds of each of ``repeats`` calls, after ``warm_up`` that do not count, and what the last one gave."""
    out = Timing([])
    for i in range(warm_up + max(1, repeats)):
        start = time.perf_counter()
        out.result = f()
        if i >= warm_up:
            out.seconds.append(time.perf_counter() - start)
    return out


@dataclass
class Stages:
    """Seconds by name, added up where a name comes again."""

    seconds: dict[str, float] = field(default_factory=dict)

    @contextmanager
    def __call__(self, name: str):
        start = time.perf_counter()
        try:
            yield self
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - start

    def table(self) -> str:
        total = sum(self.seconds.values()) or 1.0
        return "\n".join(f"{name:20} {s:9.3f} s {100 * s / total:5.1f} %" for name, s in self.seconds.items())


@contextmanager
def used(spark, watts: float | None = None):
    """A dict that at the end has seconds, CPU seconds and peak MB of the driver's Python, and MB that the JVM's heap holds.

    With ``watts``, the power that one busy core takes, also the energy of those CPU seconds in joules.
    """
    out: dict[str, float] = {}
    start, cpu = time.perf_counter(), time.process_time()
    yield out
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    out |= {
        "seconds": time.perf_counter() - start, "cpu_seconds": time.process_time() - cpu,
        "peak_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, "heap_mb": (runtime.totalMemory() - runtime.freeMemory()) / (1 << 20),
    }
    if watts is not None:
        out["joules"] = out["cpu_seconds"] * watts
