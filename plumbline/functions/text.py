"""Column functions on text; all built from native expressions.

Patterns are in the common part of Java's and RE2's syntax.  Offsets are in
characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.fixed import CONCLUSION, COPULAS, CUTS, PRONOUNS, REASON, UNITS

# Quotation marks, dashes and spaces that fold to plain ones.
_CURLY = "‘’‚‛“”„‟‐‑‒–—―   "
_PLAIN = "''''\"\"\"\"------   "


def fold(c: Column) -> Column:
    """Runs of blanks to one, quotation marks, dashes and hard spaces to plain ones, case kept; idempotent."""
    return F.trim(F.regexp_replace(F.translate(c, _CURLY, _PLAIN), r"\s+", " "))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def fold_once(c: Column) -> Column:
    """``fold`` for many texts: one of ASCII alone has none of those signs and isn't looked through for them, sign by sign."""
    plain = let(c, lambda x: F.when(F.octet_length(x) > F.char_length(x), F.translate(x, _CURLY, _PLAIN)).otherwise(x))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def fold_lower(c: Column) -> Column:
    return F.lower(fold_once(c))


def slug(c: Column) -> Column:
    """Runs of ``[a-z0-9]`` of the lower-cased text joined by ``-``; ``untitled`` if there is none."""
    made = F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(made, F.lit("")), F.lit("untitled"))


def one_line(c: Column, width: int) -> Column:
    """Words joined by single blanks, cut to ``width`` characters with an ellipsis."""
    line = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.char_length(line) > width, F.concat(F.substring(line, 1, width), F.lit("…"))).otherwise(line)


def words(c: Column) -> Column:
    """Words between blanks."""
    line = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, " "))


#: A token that closes a sentence: it ends in ``!`` or ``?``, or is a dot alone or after two or more signs but dots.
_CLOSING = r"(?<![^ ])([^ ]*[!?]|(?:[^ .]{2,})?\.) (?=\p{Lu})"


def sentences(c: Column) -> Column:
    """Sentences of a text.

    A token that ends in ``.``, ``!`` or ``?`` closes a sentence if the next one
    starts with an upper-case letter; ``.`` does not after a one-character token
    or one that holds another dot.
    """
    line = F.trim(F.regexp_replace(c, r"\s+", " "))
    marked_ = F.regexp_replace(line, _CLOSING, "$1\x01")
    return F.filter(F.split(marked_, "\x01"), lambda s: s != "")


_SIGNS = ",.;:!?\"'"


def _plain(word: Column) -> Column:
    return F.lower(F.btrim(word, F.lit(_SIGNS)))


def subject_size(words_: Column) -> Column:
    """Number of words before the first copula that isn't the first word; 0 if there is none."""
    return F.array_position(F.transform(F.slice(words_, 2, F.size(words_)), lambda w: _plain(w).isin(*COPULAS)), True)


def capitalized(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.char_length(c)))


def claims_from_text(c: Column, dependent: tuple[str, ...] = REASON + CONCLUSION) -> Column:
    """``array<struct<text, anchor, substituted>>``: sentences, each cut once where a conjunction joins two claims.

    The cut is refused if a side is blank, if the right side opens with a word of
    ``dependent``, or if it has no subject of its own before a copula.  A right
    side that opens with a pronoun takes the left side's subject for it, or is
    refused if that has none.  ``anchor`` keeps the words as written.
    """
    pattern = "^(" + "|".join(dependent) + ")([^a-z0-9_-]|$)"

    def cut(s: Column) -> Column:
        low = F.lower(s)
        places = [F.when(F.instr(low, x) > 0, F.struct(F.instr(low, x).alias("at"), F.lit(i).alias("rank"), F.lit(len(x)).alias("size"))) for i, x in enumerate(CUTS)]

        def sides(first: Column) -> Column:
            left, right = F.trim(F.substring(s, F.lit(1), first["at"] - 1)), F.trim(F.substring(s, first["at"] + first["size"], F.char_length(s)))
            return F.when(first.isNotNull(), F.struct(left.alias("left"), right.alias("right"), F.split(left, " ").alias("l"), F.split(right, " ").alias("r")))

        def judged(x: Column) -> Column:
            whole = F.array(F.struct(s.alias("text"), s.alias("anchor"), F.lit(False).alias("substituted")))
            pronoun, n = _plain(x["r"][0]).isin(*PRONOUNS), subject_size(x["l"])
            text = F.when(pronoun, F.concat_ws(" ", F.array_join(F.slice(x["l"], 1, n.cast("int")), " "), F.array_join(F.slice(x["r"], 2, F.size(x["r"])), " "))).otherwise(x["right"])
            stands = F.when(pronoun, n > 0).otherwise(subject_size(x["r"]) > 0)
            good = x.isNotNull() & (x["left"] != "") & (x["right"] != "") & ~F.lower(x["right"]).rlike(pattern) & stands
            two = F.array(F.struct(x["left"].alias("text"), x["left"].alias("anchor"), F.lit(False).alias("substituted")), F.struct(capitalized(text).alias("text"), x["right"].alias("anchor"), pronoun.alias("substituted")))
            return F.when(good, two).otherwise(whole)

        return let(let(F.least(*places), sides), judged)

    return F.flatten(F.transform(sentences(c), cut))


def written_dimension(raw: Column) -> Column:
    """Dimension of a written value by the unit after its last digit; null for none or an unknown one."""
    unit = F.lower(F.btrim(F.regexp_extract(raw, r"^.*[0-9.]([^0-9.]*)$", 1), F.lit(".,;:)")))
    out = F.lit(None).cast("string")
    for dimension, units in UNITS.items():
        out = F.when(unit.isin(*units), dimension).otherwise(out)
    return out


def states_value(c: Column, value: Column) -> Column:
    """Whether a number occurs in a text by itself, not inside a longer one."""
    pattern = F.concat(F.lit("[^0-9.]"), F.regexp_replace(value, r"[.]", "[.]"), F.lit("[^0-9.]"))
    return F.regexp_like(F.concat(F.lit(" "), c, F.lit(" ")), pattern)


def snippet(c: Column, query: str, width: int = 160) -> Column:
    """Text around the first of a query's terms, without headings and link targets; operators are no terms."""
    plain = F.regexp_replace(F.regexp_replace(c, r"(^|\n)#+[^\n]*", " "), r"\[([^\]]*)\]\([^)]*\)", "$1")
    terms = [t for t in (x.strip('"()*') for x in query.lower().split()) if t and t not in ("and", "or", "not", "near")]

    def cut(line: Column) -> Column:
        places = [F.nullif(F.instr(F.lower(line), t), F.lit(0)) for t in terms] or [F.lit(None).cast("int")]
        first = F.coalesce(F.least(*places) if len(places) > 1 else places[0], F.lit(1))
        at = F.when(F.char_length(line) <= width, 1).otherwise(F.greatest(first - width // 2, F.lit(1)))
        head, tail = F.when(at > 1, "…").otherwise(""), F.when(at + width - 1 < F.char_length(line), "…").otherwise("")
        return F.concat(head, F.substring(line, at, F.lit(width)), tail)

    return let(F.trim(F.regexp_replace(plain, r"\s+", " ")), cut)


def placeholders(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\{\{[A-Z][A-Z0-9_]*\}\}"), F.lit(0)))


# Hidden characters by class, and where such characters are meant: a joiner between two signs that are
# not ASCII, the tags of three flags, and a byte order mark in first place.
HIDDEN = {"zero-width": "[​‌‍⁠﻿]", "bidi": "[‪-‮⁦-⁩]", "tag": "[\U000e0000-\U000e007f]"}
_JOINED = "(?<=[^\\x00-\\x7f​-‍⁠﻿])[‌‍](?=[^\\x00-\\x7f​-‍⁠﻿])"
_FLAGS = "(\U0001f3f4)(" + "|".join("".join(chr(0xE0000 + ord(x)) for x in flag) for flag in ("gbeng", "gbsct", "gbwls")) + ")\U000e007f"


def unmeant(c: Column) -> Column:
    """A text with every hidden character that is meant replaced by ``-``; offsets stay."""
    out = F.regexp_replace(F.regexp_replace(c, _JOINED, "-"), _FLAGS, "$1------")
    return F.regexp_replace(out, "^﻿", "-")


def hidden_chars(c: Column, kind: str) -> Column:
    """``struct<times, first>``: how many hidden characters of a class a text holds, and the offset of the first, or null."""
    at = F.regexp_instr(unmeant(c), F.lit(HIDDEN[kind]))
    return F.struct(F.regexp_count(unmeant(c), F.lit(HIDDEN[kind])).alias("times"), F.when(at > 0, F.char_length(F.split(unmeant(c), HIDDEN[kind], 2)[0])).alias("first"))


def without_hidden(c: Column) -> Column:
    """A text without its hidden characters."""
    return F.regexp_replace(c, "|".join(HIDDEN.values()), "")


def hidden_channels(c: Column) -> Column:
    """Texts that no reader sees: those of HTML comments, then the titles of link labels."""
    comments = F.regexp_extract_all(c, F.lit(r"(?s)<!--(.*?)-->"), F.lit(1))
    labels = [F.regexp_extract_all(c, F.lit(rf"(?m)^ {{0,3}}\[[^\]\n]+\]:[ \t]*[^ \t\n]+[ \t]+{quoted}[ \t]*$"), F.lit(1)) for quoted in (r'"([^"\n]*)"', r"'([^'\n]*)'", r"\(([^)\n]*)\)")]
    return F.transform(F.concat(comments, *labels), lambda s: F.trim(s))


def html_text(c: Column) -> Column:
    """Readable text of an HTML page: no scripts, styles or comments, blocks on lines of their own."""
    out = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)<(/?(p|div|li|ul|h[1-6]|article|nav|footer|header|section|tr|table)|br)[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.btrim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\s*\n\s*", "\n"), F.lit(" \n"))


def claim_ref(doc: Column, claim: Column) -> Column:
    """``doc#claim``, or null if a side is empty."""
    return F.when((doc != "") & (claim != ""), F.concat_ws("#", doc, claim))


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts joined by a zero byte."""
    return F.sha2(F.concat_ws("\0", *parts).cast("binary"), 256)


def days_between(start: Column, end: Column) -> Column:
    """Whole days from one time to another."""
    return F.floor((F.unix_timestamp(end) - F.unix_timestamp(start)) / 86400).cast("long")
