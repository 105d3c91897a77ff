"""Logging of the library: one logger with children, timed steps, progress and the size of a table."""
from __future__ import annotations

import logging
import sys
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame

ROOT = "skirmish"
STYLES = {
    "simple": "%(levelname)s: %(message)s",
    "detailed": "%(asctime)s %(name)s %(levelname)s %(funcName)s:%(lineno)d %(message)s",
    "json": '{"time": "%(asctime)s", "level": "%(levelname)s", "name": "%(name)s", "message": "%(message)s"}',
}


def setup(level: str | int = logging.INFO, file: str | None = None, style: str = "detailed") -> logging.Logger:
    """Replaces the handlers of the library's logger."""
    logger = logging.getLogger(ROOT)
    logger.setLevel(level.upper() if isinstance(level, str) else level)
    logger.propagate = False
    logger.handlers[:] = [logging.StreamHandler(sys.stdout), *([logging.FileHandler(file)] if file else [])]
    for handler in logger.handlers:
        handler.setFormatter(logging.Formatter(STYLES[style]))
    return logger


def child(name: str) -> logging.Logger:
    return logging.getLogger(f"{ROOT}.{name}")


@contextmanager
def timed(logger: logging.Logger, what: str, level: int = logging.INFO) -> Iterator[None]:
    """Logs the seconds that a step took, or that it failed."""
    began = time.perf_counter()
    try:
        yield
    except Exception:
        logger.exception("%s failed after %.2f s", what, time.perf_counter() - began)
        raise
    logger.log(level, "%s took %.2f s", what, time.perf_counter() - began)


def timing(logger: logging.Logger, level: int = logging.INFO) -> Callable:
    """The same for every call of a function."""

    def around(f: Callable) -> Callable:
        @wraps(f)
        def run(*args: object, **named: object) -> object:
            with timed(logger, f.__qualname__, level):
                return f(*args, **named)

        return run

    return around


def table(logger: logging.Logger, df: DataFrame | None, name: str, level: int = logging.DEBUG) -> None:
    """Logs columns and kinds; counts rows only if the level is on, as that runs the plan."""
    if df is None:
        logger.log(level, "%s: none", name)
    elif logger.isEnabledFor(level):
        logger.log(level, "%s: %d rows of %s", name, df.count(), df.schema.simpleString())


def convergence(logger: logging.Logger, step: int, moved: float, bound: float, what: str = "loop") -> None:
    done = moved <= bound
    logger.log(logging.INFO if done else logging.DEBUG, "%s %s at step %d: moved %.2e, bound %.2e", what, "converged" if done else "goes on", step, moved, bound)
