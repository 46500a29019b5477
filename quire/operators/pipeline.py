"""Pipelines of named steps with conditions for each document."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import patterns as P
from quire.functions.values import bates
from quire.operators.extraction import any_held, any_of
from quire.operators.sequence import lenient_range
from quire.sources.tables import LINES_A_PAGE

Step_ = Callable[..., Column]


def redact(text: Column, pattern: str, mark: str = "█") -> Column:
    """Every match hidden; the text keeps its length where the mark is one sign for each."""
    return F.regexp_replace(text, F.lit(P.java(pattern)), F.lit(mark))


def by_page(text: Column, change: Callable[[Column], Column]) -> Column:
    """The text after ``change`` of its pages, an array of texts of forty lines each."""

    def pages(lines: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / LINES_A_PAGE).cast("int"))
        return F.transform(starts, lambda p: F.array_join(F.slice(lines, p * LINES_A_PAGE + 1, F.lit(LINES_A_PAGE)), "\n"))

    bound = F.transform(F.array(F.split(text, "\n")), pages)  # split once, whatever the change reads
    return F.when(text.isNotNull(), F.array_join(F.transform(bound, change)[0], "\n"))


def _numbered(template: str) -> Callable[[Column], Column]:
    """Every page with a last line: ``template`` with {i} and {n} for its number and the number of pages."""
    shown = lambda pages, i: F.replace(F.replace(F.lit(template), F.lit("{i}"), (i + 1).cast("string")), F.lit("{n}"), F.size(pages).cast("string"))
    return lambda pages: F.transform(pages, lambda p, i: F.concat(p, F.lit("\n"), shown(pages, i)))


def _stamped(prefix: str, first: int, digits: int) -> Callable[[Column], Column]:
    return lambda pages: F.transform(pages, lambda p, i: F.concat(p, F.lit("\n"), bates(i + first, prefix, "", digits)))


def _extracted(wanted: list[int]) -> Callable[[Column], Column]:
    return lambda pages: F.filter(pages, lambda p, i: (i + 1).isin(wanted))


def _without_blank(least: int) -> Callable[[Column], Column]:
    return lambda pages: F.filter(pages, lambda p: F.length(F.regexp_replace(p, r"\s+", "")) >= least)


#: what a step does to the text column
OPERATIONS: dict[str, Step_] = {
    "redact-pattern": lambda text, pattern, mark="█": redact(text, pattern, mark),
    "redact-personal": lambda text, mark="█": F.regexp_replace(text, any_of(P.PERSONAL_DATA), mark),
    "header": lambda text, label: F.concat(F.lit(label + "\n"), text),
    "footer": lambda text, label: F.concat(text, F.lit("\n" + label)),
    "collapse-space": lambda text: F.trim(F.regexp_replace(text, r"[ \t]+", " ")),
    "clear": lambda text: F.lit(""),
    "page-numbers": lambda text, template="{i} of {n}": by_page(text, _numbered(template)),
    "bates": lambda text, prefix="", first=1, digits=6: by_page(text, _stamped(prefix, first, digits)),
    "extract-pages": lambda text, pages, most=100_000: by_page(text, _extracted(lenient_range(pages, most))) if pages.strip().lower() not in ("", "all") else text,
    "drop-blank-pages": lambda text, least=8: by_page(text, _without_blank(least)),
    "reverse-pages": lambda text: by_page(text, lambda pages: F.reverse(pages)),
}
#: when a step applies
CONDITIONS: dict[str, Step_] = {
    "always": lambda text: F.lit(True),
    "has-text": lambda text: F.length(F.regexp_replace(text, r"\s+", "")) >= 20,
    "scanned": lambda text: F.length(F.regexp_replace(text, r"\s+", "")) < 20,
    "sensitive": lambda text: any_held(text, P.PERSONAL_DATA),
    "privilege": lambda text: text.rlike(P.java(P.PRIVILEGE)),
    "size-over": lambda text, megabytes=5.0: F.octet_length(text) / 1048576 > megabytes,
}


@dataclass(frozen=True)
class Step:
    op: str
    params: dict = field(default_factory=dict)
    condition: str = "always"
    condition_params: dict = field(default_factory=dict)


def run(docs: DataFrame, steps: list[Step], text: str = "text") -> DataFrame:
    """``docs`` after the steps, each applied to the documents that meet its condition, and skipped: how many were not."""
    docs = docs.withColumn("skipped", F.lit(0))
    for step in steps:
        now = F.col(text)
        docs = docs.withColumn("_met", CONDITIONS[step.condition](now, **step.condition_params))  # worked out once
        done = F.when(F.col("_met"), OPERATIONS[step.op](now, **step.params)).otherwise(now)
        docs = docs.withColumns({text: done, "skipped": F.col("skipped") + F.when(F.col("_met"), 0).otherwise(1)})
    return docs.drop("_met")


def leaks(docs: DataFrame, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """How many documents still match each pattern."""
    return docs.agg(*[F.count_if(any_held(F.col(text), {c: p})).alias(c) for c, p in patterns.items()])


def gate(docs: DataFrame, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """``docs`` if no text matches (null texts don't); the first text that does fails the job."""
    clean = ~F.coalesce(any_held(F.col(text), patterns), F.lit(False))
    return docs.withColumn(text, F.when(clean, F.col(text)).otherwise(F.raise_error(F.lit("a redacted value is still there"))))


def flatten(docs: DataFrame, clear_sensitive_first: bool = False, text: str = "text") -> DataFrame:
    """``docs`` ready to be made part of a page: a text with a sensitive value fails the job, or is emptied if that is asked for."""
    if not clear_sensitive_first:
        return gate(docs, P.PERSONAL_DATA, text)
    return docs.withColumn(text, F.when(any_held(F.col(text), P.PERSONAL_DATA), "").otherwise(F.col(text)))
