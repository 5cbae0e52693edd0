"""Backends: a registry of ways to obtain a Spark session, and the one in use."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from gridloom.storage import ship


@dataclass
class Driver:
    """A running backend: its name, its session and how many tasks run at once."""

    name: str
    spark: SparkSession

    @property
    def executors(self) -> int:
        return self.spark.sparkContext.defaultParallelism


def _local(spec: int | str | None = None, **conf) -> SparkSession:
    """spec: a number of local cores, "all", or a master URL; None takes the active session or all cores."""
    if spec is None and not conf and (found := SparkSession.getActiveSession()):
        return found
    builder = SparkSession.builder
    if spec is not None:
        builder = builder.master(f"local[{spec}]" if isinstance(spec, int) else "local[*]" if spec == "all" else spec)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _fork(cores: int | None = None, **conf) -> SparkSession:
    """Processes of this machine: all its cores unless a number is given."""
    return _local(cores or "all", **conf)


_REGISTRY: dict[str, Callable[..., SparkSession]] = {"spark": _local, "parallel": _local, "fork": _fork}
_CURRENT: Driver | None = None


def register_driver(name: str, start: Callable[..., SparkSession]) -> None:
    _REGISTRY[name] = start


def available_backends() -> list[str]:
    return sorted(_REGISTRY)


def use_backend(name: str = "spark", *args, **settings) -> Driver:
    global _CURRENT
    if name not in _REGISTRY:
        raise ValueError(f"no backend {name!r}; there are {', '.join(available_backends())}")
    _CURRENT = Driver(name, _REGISTRY[name](*args, **settings))
    ship(_CURRENT.spark)
    return _CURRENT


def use_session(spark: SparkSession) -> Driver:
    """Take a session that runs already."""
    global _CURRENT
    _CURRENT = Driver("spark", spark)
    ship(spark)
    return _CURRENT


def current() -> Driver:
    return _CURRENT if _CURRENT is not None else use_backend()


def shutdown(driver: Driver | None = None) -> None:
    global _CURRENT
    (driver or current()).spark.stop()
    if driver is None or driver is _CURRENT:
        _CURRENT = None
