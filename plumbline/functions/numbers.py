"""Numbers as prose writes them, and the bounds that it states with them.

A number is read token by token by a small machine that runs as one ``aggregate``
over the words after a phrase; it stops where the number ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.fixed import BOUNDS, FRACTIONS, SCALES, SMALL_NUMBERS, TENS
from plumbline.functions.text import fold_lower, let

#: Signs that end or divide a clause; dots and commas inside a number don't.
_DIVIDING = r"(?<![0-9])[.,]|[.,](?![0-9])|[;:!?()\[\]]"
_LITERAL = r"^([+-]?(?:[0-9][0-9,]*(?:\.[0-9]+)?|\.[0-9]+)(?:e[+-]?[0-9]+)?)([a-z]*%*)$"
_HYPHEN = r"(?<![a-z])(" + "|".join(TENS) + ")-(" + "|".join(SMALL_NUMBERS[1:10]) + ")(?![a-z])"


def spaced(c: Column) -> Column:
    """A text with blanks around the signs that end or divide a clause, folded and lower-cased; ``thirty-five`` is two words."""
    return F.regexp_replace(fold_lower(F.regexp_replace(c, _DIVIDING, " $0 ")), _HYPHEN, "$1 $2")


def _vocabulary() -> dict[str, tuple[str, float]]:
    """Number words with their kind: unit, teen, ten, hundred, scale, fraction, and the two that join."""
    out = {w: ("unit" if n < 10 else "teen", float(n)) for n, w in enumerate(SMALL_NUMBERS)}
    out |= {w: ("ten", 10.0 * (n + 2)) for n, w in enumerate(TENS)}
    out |= {w: ("hundred" if v == 100 else "scale", float(v)) for w, v in SCALES}
    out |= {w: ("fraction", 1.0 / n) for w, n in FRACTIONS}
    return out | {"and": ("and", 0.0), "a": ("article", 1.0), "an": ("article", 1.0)}


def token(word: Column) -> Column:
    """``struct<kind, value, digits, unit>`` of a word; digits are a ``literal``, signs alone are a ``mark``, all else is ``other``."""
    known = F.create_map(*[x for w, (k, v) in _vocabulary().items() for x in (F.lit(w), F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value")))])
    digits, unit = (F.regexp_extract(word, _LITERAL, i) for i in (1, 2))
    plain = F.regexp_replace(digits, ",", "")

    def made(named: Column) -> Column:
        kind = F.when(named.isNotNull(), named["kind"]).when(digits != "", "literal").when(F.rtrim(word, F.lit(".,;:%)")) == "", "mark").otherwise("other")
        value = F.coalesce(named["value"], plain.try_cast("double"))
        return F.struct(kind.alias("kind"), value.alias("value"), plain.alias("digits"), F.coalesce(unit, F.lit("")).alias("unit"))

    return let(F.try_element_at(known, word), made)


_FIELDS = ("stage", "total", "value", "part", "joined", "adds", "last", "digits", "unit")


def read_number(words: Column) -> Column:
    """``struct<value, raw>`` of the number that a list of words opens with, or null.

    Marks before it are passed over; any other word before it, an article too,
    means that there is none.  Digits may carry a unit, which ends the number, or a
    scale (``5 million``).  Words go up by unit, ten, hundred and scale, with
    ``and`` after a hundred or scale; ``and`` before a fraction adds it (``two and a
    half``), and a number before a fraction multiplies it (``three quarters``).  A
    word that can't go on ends the number.  Values are rounded to six places;
    ``raw`` is the digits as written without thousands commas, or the value of
    words in digits, with the unit.
    """
    none = F.lit(None).cast("double")
    start = F.struct(
        F.lit("before").alias("stage"), F.lit(0.0).alias("total"), none.alias("value"), none.alias("part"), F.lit(False).alias("joined"),
        F.lit(False).alias("adds"), F.lit("").alias("last"), F.lit("").alias("digits"), F.lit("").alias("unit"),
    )

    def step(s: Column, word: Column) -> Column:
        def on(t: Column) -> Column:
            kind, v, last = t["kind"], t["value"], s["last"]

            def to(**changes: Column) -> Column:
                return F.struct(*[(changes[f] if f in changes else s[f]).alias(f) for f in _FIELDS])

            ended = to(stage=F.lit("ended"))
            opened = (
                F.when(kind == "mark", s)
                .when(kind == "literal", to(stage=F.when(t["unit"] == "", "in").otherwise("ended"), value=v, last=kind, digits=t["digits"], unit=t["unit"]))
                .when(kind.isin("unit", "teen", "ten", "hundred"), to(stage=F.lit("in"), value=v, last=kind))
                .when(kind == "scale", to(stage=F.lit("in"), total=v, value=F.lit(0.0), last=kind))
                .when(kind == "fraction", to(stage=F.lit("ended"), value=v))
                .otherwise(to(stage=F.lit("none")))
            )
            whole = last.isin("hundred", "scale")
            joined = (
                F.when(kind == "fraction", to(stage=F.lit("ended"), value=s["value"] + F.coalesce(s["part"], F.lit(1.0)) * v, part=none))
                .when((kind == "article") & s["part"].isNull(), to(part=F.lit(1.0), last=kind))
                .when(kind.isin("unit", "teen", "ten") & s["part"].isNull(), to(part=v, last=kind))
                .when((kind == "unit") & (last == "ten"), to(part=s["part"] + v, last=kind))
                .when((kind == "hundred") & s["adds"] & last.isin("unit", "teen"), to(value=s["value"] + s["part"] * v, part=none, joined=F.lit(False), last=kind))
                .when((kind == "scale") & s["adds"] & last.isin("unit", "teen", "ten"), to(total=s["total"] + (s["value"] + s["part"]) * v, value=F.lit(0.0), part=none, joined=F.lit(False), last=kind))
                .otherwise(ended)
            )
            going = (
                F.when((kind == "unit") & (whole | (last == "ten")) | kind.isin("teen", "ten") & whole, to(value=s["value"] + v, last=kind))
                .when((kind == "hundred") & last.isin("unit", "teen", "ten", "literal"), to(value=s["value"] * v, last=kind, digits=F.lit("")))
                .when((kind == "scale") & (last != "scale"), to(total=s["total"] + s["value"] * v, value=F.lit(0.0), last=kind, digits=F.lit("")))
                .when((kind == "fraction") & last.isin("unit", "teen", "literal") & (s["total"] == 0), to(stage=F.lit("ended"), value=s["value"] * v, digits=F.lit("")))
                .when(kind == "and", to(joined=F.lit(True), adds=whole))
                .otherwise(ended)
            )
            return F.when(s["stage"] == "before", opened).when(s["stage"] != "in", s).when(s["joined"], joined).otherwise(going)

        return let(token(word), on)

    def finish(s: Column) -> Column:
        extra = F.when(s["joined"] & s["adds"] & (s["last"] != "article"), s["part"])
        value = F.round(s["total"] + s["value"] + F.coalesce(extra, F.lit(0.0)), 6)

        def told(v: Column) -> Column:
            written = F.when(v == F.floor(v), v.cast("decimal(38,0)").cast("string")).otherwise(F.regexp_replace(v.cast("decimal(38,6)").cast("string"), "0+$", ""))
            as_digits = (s["digits"] != "") & (v == s["digits"].try_cast("double"))
            return F.struct(v.alias("value"), F.concat(F.when(as_digits, s["digits"]).otherwise(written), s["unit"]).alias("raw"))

        return F.when(s["stage"].isin("in", "ended"), let(value, told))

    return F.aggregate(words, start, step, finish)


def parse_bound(c: Column, phrases: Sequence[tuple[str, str]] = BOUNDS) -> Column:
    """``struct<op, value, phrase, raw>`` of the bound that a text states, or null.

    Of the phrases in the text the longest counts, of several as long the first
    given, where it first stands; the number after it is the bound.  A phrase
    before ``a`` or ``an`` states none: that is an article and not a number.
    """

    def stated(line: Column) -> Column:
        found = F.lit(None)
        for phrase, op in sorted(reversed(phrases), key=lambda p: len(p[0])):
            rest = F.substring_index(line, f" {phrase} ", 1)
            after = F.substring(line, F.char_length(rest) + len(phrase) + 2, F.char_length(line))
            here = F.struct(F.lit(op).alias("op"), F.lit(phrase).alias("phrase"), F.split(F.trim(after), " ").alias("words"))
            found = F.when(F.contains(line, F.lit(f" {phrase} ")), here).otherwise(found)
        return found

    def bound(x: Column) -> Column:
        made = lambda n: F.when(n.isNotNull(), F.struct(x["op"].alias("op"), n["value"].alias("value"), x["phrase"].alias("phrase"), n["raw"].alias("raw")))
        return F.when(x.isNotNull(), let(read_number(x["words"]), made))

    return let(let(F.concat(F.lit(" "), spaced(c), F.lit(" ")), stated), bound)
