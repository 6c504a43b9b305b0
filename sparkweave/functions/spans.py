"""Spans of tokens, both ends included unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(start: Column, end: Column) -> Column:
    return end - start + 1


def overlap_f1(true_start: Column, true_end: Column, start: Column, end: Column) -> Column:
    """F1 of the tokens of two spans."""
    shared = F.greatest(F.lit(0), F.least(true_end, end) - F.greatest(true_start, start) + 1)
    precision, recall = shared / length(start, end), shared / length(true_start, true_end)
    return F.when(shared == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))


def pack(start: Column, end: Column, n: Column, bound: int) -> Column:
    """Place of a span in the list of all spans of at most ``bound`` tokens of a text of n, by length and then start."""
    steps = end - start
    return (steps * n - (steps * (steps - 1) / 2).cast("long") + start).cast("long")


def answer_text(span_text: Column, is_span: Column, is_yes_no: Column, no: Column, yes: Column) -> Column:
    """The span if a span is at least as likely as yes or no, else the likelier of these; ties go to span and to yes."""
    return F.when(is_span >= is_yes_no, span_text).when(yes >= no, F.lit("yes")).otherwise(F.lit("no"))
