"""Text functions on columns: phrase patterns, words, padding, samples, sizes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed names of the match modes and what they stand for, after dropping dashes and underscores.
MODE_NAMES = {"startswith": "starts", "starts": "starts", "prefix": "starts", "endswith": "ends", "ends": "ends", "suffix": "ends", "wholeword": "whole", "word": "whole", "exact": "whole", "contains": "contains"}


def match_mode(name: str | None) -> str:
    """contains, starts, ends or whole; any unknown name means contains."""
    return MODE_NAMES.get(re.sub("[-_]", "", (name or "").lower()), "contains")


def match_mode_of(name: Column) -> Column:
    """The same for a column of names."""
    bare = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[-_]", "")
    table = F.create_map(*[F.lit(x) for pair in MODE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, bare), F.lit("contains"))


def phrase_pattern(phrase: str, mode: str = "contains", case_sensitive: bool = False) -> str:
    """A regular expression (Java and RE2) for a phrase taken literally; word edges by mode."""
    left, right = r"\b" * (match_mode(mode) in ("starts", "whole")), r"\b" * (match_mode(mode) in ("ends", "whole"))
    return ("" if case_sensitive else "(?i)") + left + re.escape(phrase) + right


def java_pattern(phrase: str, mode: str = "contains", case_sensitive: bool = False) -> str:
    """The same with Unicode case folding, for Spark."""
    return phrase_pattern(phrase, mode, case_sensitive).replace("(?i)", "(?iu)")


def count_matches(text: Column, phrase: str, mode: str = "contains", case_sensitive: bool = False) -> Column:
    """Matches that do not overlap; an empty phrase has none."""
    if not phrase:
        return F.lit(0)
    return F.regexp_count(text, F.lit(java_pattern(phrase, mode, case_sensitive)))


def words(text: Column) -> Column:
    """Non-empty runs between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def zero_padded(number: Column, digits: int) -> Column:
    """Left-padded with zeros to at least ``digits``; longer numbers stay whole."""
    text = number.cast("string")
    return F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(digits) - F.length(text))), text)


def printable(text: Column) -> Column:
    """Anything but printable ASCII as a full stop."""
    return F.regexp_replace(text, "[^ -~]", ".")


def sample(text: Column, limit: int = 80) -> Column:
    """One line of a script: line ends as spaces, trimmed, cut with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, "[\r\n]", " "))
    return F.concat(F.lit("JS: "), F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))).otherwise(flat))


def lines(text: Column) -> Column:
    """Lines after all line ends are made alike."""
    return F.split(F.regexp_replace(text, "\r\n|\r", "\n"), "\n")


def clipped(text: Column, limit: int = 200) -> Column:
    """White space collapsed, cut with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))).otherwise(flat)


def html_escaped(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return out


def approximate_size(base64_chars: Column) -> Column:
    """Size of what base64 text stands for, in bytes or, from 1024, in KB."""
    n = F.round(base64_chars * 0.75).cast("long")
    return F.when(n >= 1024, F.concat(F.round(n / 1024).cast("long").cast("string"), F.lit(" KB"))).otherwise(F.concat(n.cast("string"), F.lit(" B")))


#: Fixed parts of font names that tell a family, tried in this order; any other name is helvetica.
FAMILY_PARTS = {"times": ("times", "serif", "georgia", "roman", "minion"), "courier": ("courier", "mono", "consol")}
BOLD_PARTS, ITALIC_PARTS = ("bold", "black", "heavy", "semibold"), ("italic", "oblique")
#: Fixed names of families and their plain, bold, italic and bold italic faces.
FAMILY_NAMES = {"times": "times", "serif": "times", "courier": "courier", "mono": "courier", "monospace": "courier"}
FACES = {
    "helvetica": ("Helvetica", "Helvetica-Bold", "Helvetica-Oblique", "Helvetica-BoldOblique"),
    "times": ("Times-Roman", "Times-Bold", "Times-Italic", "Times-BoldItalic"),
    "courier": ("Courier", "Courier-Bold", "Courier-Oblique", "Courier-BoldOblique"),
}


def bare_font(name: Column) -> Column:
    """A font's name without the seven characters of a subset tag."""
    return F.when((F.length(name) > 7) & (F.substring(name, 7, 1) == "+"), F.substring(name, 8, 1_000_000)).otherwise(name)


def font_style(name: Column) -> Column:
    """struct<family, bold, italic> read from a font's name."""
    low = F.lower(F.coalesce(name, F.lit("")))
    has = lambda parts: F.greatest(*[low.contains(p) for p in (*parts, parts[0])])
    family = F.when(has(FAMILY_PARTS["times"]), "times").when(has(FAMILY_PARTS["courier"]), "courier").otherwise("helvetica")
    return F.struct(family.alias("family"), has(BOLD_PARTS).alias("bold"), has(ITALIC_PARTS).alias("italic"))


def font_face(family: Column, bold: Column, italic: Column) -> Column:
    """One of twelve standard faces."""
    names = F.create_map(*[F.lit(x) for pair in FAMILY_NAMES.items() for x in pair])
    faces = F.create_map(*[x for k, v in FACES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    known = F.coalesce(F.try_element_at(names, F.lower(F.trim(F.coalesce(family, F.lit("helvetica"))))), F.lit("helvetica"))
    return F.element_at(F.element_at(faces, known), bold.cast("int") + 2 * italic.cast("int") + 1)


def substitution_note(wanted: Column, used: Column) -> Column:
    """A note that one face stands in for another, or null if it is the same."""
    return F.when(bare_font(wanted) != used, F.concat(F.lit("Font "), bare_font(wanted), F.lit(" shown as "), used))
