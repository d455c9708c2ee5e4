"""Marked phrases in prose: found as whole words, longest first, each word of the text counted for one phrase only."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import fold_lower, let

#: What may stand after a marked phrase.
ENDS = (" ", ",", ".")


def longest_first(phrases: Sequence[str]) -> list[str]:
    """By falling length; phrases of one length keep their order."""
    return sorted(phrases, key=lambda p: -len(p))


def line_of(c: Column) -> Column:
    """The folded text, lower-cased, with a blank at both ends."""
    return F.concat(F.lit(" "), fold_lower(c), F.lit(" "))


def occurs(line: Column, start: Column) -> Column:
    """Whether a phrase stands in a line before a blank, comma or dot; ``start`` is the phrase after a blank, which most lines don't hold."""
    found = F.contains(line, F.concat(start, F.lit(ENDS[0])))
    for end in ENDS[1:]:
        found = found | F.contains(line, F.concat(start, F.lit(end)))
    return F.contains(line, start) & found


def _occurs(line: Column, phrase: str) -> Column:
    """``occurs`` of a known phrase: most texts don't hold it, and one look for it says so."""
    start = " " + phrase
    found = F.contains(line, F.lit(start + ENDS[0]))
    for end in ENDS[1:]:
        found = found | F.contains(line, F.lit(start + end))
    return F.contains(line, F.lit(start)) & found


def present(c: Column, phrases: Sequence[str]) -> Column:
    """The phrases that occur in a text, in the order given; none hides another."""
    return let(line_of(c), lambda line: F.array_compact(F.array(*[F.when(_occurs(line, p), F.lit(p)) for p in phrases])))


def _quoted(phrase: str) -> str:
    """A pattern of just that phrase, in the common part of Java's and RE2's syntax."""
    return re.sub(r"([!-/:-@\[-`{-~])", r"\\\1", phrase)


def any_of(line: Column, phrases: Sequence[str]) -> Column:
    """Whether a line of ``line_of`` has one of the phrases: one pass over the line for all."""
    if not phrases:
        return F.lit(False)
    return F.rlike(line, F.lit(f" (?:{'|'.join(_quoted(p) for p in phrases)})[{''.join(ENDS)}]"))


def strongest(c: Column, phrases: Sequence[str]) -> Column:
    """The longest of the phrases that occurs, or null; of several as long, the first given."""
    return F.get(present(c, longest_first(phrases)), F.lit(0))


def consume(c: Column, markers: Sequence[tuple[str, str]]) -> Column:
    """``array<struct<phrase, role>>`` of the marked phrases of a text, by phrase.

    Markers are tried by falling length.  One that occurs is taken out of the text
    wherever it stands, so that a shorter marker inside it doesn't count the same
    words again; it still counts where it stands alone.  A text that has none at
    first has none later on.
    """
    ordered = sorted(markers, key=lambda m: -len(m[0]))
    listed = F.array(*[F.struct(F.lit(f" {p}").alias("start"), F.struct(F.lit(p).alias("phrase"), F.lit(r).alias("role")).alias("marker")) for p, r in ordered])
    none = F.array().cast("array<struct<phrase:string,role:string>>")

    def step(state: Column, tried: Column) -> Column:
        rest = F.replace(state["line"], tried["marker"]["phrase"], F.lit(" "))
        taken = F.struct(rest.alias("line"), F.array_append(state["found"], tried["marker"]).alias("found"))
        return F.when(occurs(state["line"], tried["start"]), taken).otherwise(state)

    def taken_out(line: Column) -> Column:
        start = F.struct(line.alias("line"), none.alias("found"))
        found = F.aggregate(listed, start, step, lambda state: F.array_sort(state["found"]))
        return F.when(any_of(line, [p for p, _ in ordered]), found).when(line.isNotNull(), none)

    return let(line_of(c), taken_out)


def described(found: Column) -> Column:
    """Consumed markers as one line: each phrase in quotation marks with its role."""
    return F.array_join(F.transform(found, lambda m: F.concat(F.lit('"'), m["phrase"], F.lit('" ('), m["role"], F.lit(")"))), ", ")
