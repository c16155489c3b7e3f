"""Spans of regex matches as DataFrame expressions: whole texts, code-point offsets, no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of text that a span carries from before and after it.
CONTEXT = 80
SPAN_TYPE = "array<struct<start:int,stop:int,value:string,before:string,after:string>>"


def quoted(pattern: str) -> str:
    """A pattern as a SQL string literal."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans(text: str, pattern: str, context: int = CONTEXT) -> Column:
    """The leftmost non-overlapping matches of ``pattern`` in column ``text``, in order, with their neighbourhood.

    Splitting by the pattern gives the texts between the matches, whose lengths add up to the offsets. ``pattern`` must
    match no empty text. A null text has no spans.
    """
    p = quoted(pattern)
    return F.expr(
        f"""coalesce(case when {text} rlike {p} then
        transform(array(named_struct('g', split({text}, {p}, -1), 'v', regexp_extract_all({text}, {p}, 0))), x ->
          aggregate(sequence(1, size(x.v)), named_struct('p', 0, 'o', cast(array() as {SPAN_TYPE})), (acc, i) -> named_struct(
            'p', acc.p + length(element_at(x.g, i)) + length(element_at(x.v, i)),
            'o', concat(acc.o, array(named_struct(
              'start', acc.p + length(element_at(x.g, i)),
              'stop', acc.p + length(element_at(x.g, i)) + length(element_at(x.v, i)),
              'value', element_at(x.v, i),
              'before', right(element_at(x.g, i), {context}),
              'after', left(element_at(x.g, i + 1), {context}))))), acc -> acc.o))[0]
        end, cast(array() as {SPAN_TYPE}))"""
    )
