"""The catalogue of runnable queries, each with the SQL its result is checked against."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from quayline.sources.derived import Feeds, feed_ctes

AS_OF = date(2000, 6, 30)
EVENTS_AS_OF = date(2024, 1, 30)

CASES: dict[str, tuple[Callable[[Feeds], DataFrame], str | None]] = {}


def case(key: str, check: str | None = None):
    """Register a query under its key; `check` is SQL over the tables and feeds."""

    def register(build: Callable[[Feeds], DataFrame]):
        if key in CASES:
            raise ValueError(f"duplicate key {key}")
        CASES[key] = (build, check)
        return build

    return register


def with_feeds(check: str) -> str:
    """The check with the feeds it names in front, as one statement."""
    body = check.strip()
    ctes = feed_ctes(body)
    if body.upper().startswith("WITH "):
        ctes.append(body[5:])
        return "WITH " + ",\n".join(ctes)
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


def load_cases() -> None:
    from quayline.suite import (  # noqa: F401
        pipelines, questions, relational, reports, scalars, sources, streams, texts, triage,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load_cases()

    def runner(build):
        return lambda spark, folder: build(Feeds(spark, folder))

    return {key: runner(build) for key, (build, _) in CASES.items()}


def oracle_sql() -> dict[str, str]:
    load_cases()
    return {key: with_feeds(check) for key, (_, check) in CASES.items() if check}
