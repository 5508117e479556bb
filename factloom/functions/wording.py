"""Values of facts as they are worded in running text, as Column expressions.

``Locale`` is the interface of a language; ``English`` is the one that ships. Every method takes and
returns Columns, so whole-stage code generation covers it; null means that a value has no wording.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import KILOMETRES, MONTHS, NAMESPACES, SQUARE_KILOMETRES

XSD, UNITS = NAMESPACES["xsd"], NAMESPACES["dbpdatatype"]
#: Regular expressions of words in title case and of words that begin with a digit.
TITLE_CASE, NUMBER = r"^[^\p{L}]*\p{Lu}\p{Ll}*([^\p{L}]+\p{Lu}\p{Ll}*)*[^\p{L}]*$", r"^\p{Nd}"


class Locale(Protocol):
    """What extraction needs to know about a language."""

    language: str
    decimal_separator: str
    thousands_separator: str

    def worded_int(self, value: Column) -> Column: ...
    def worded_float(self, value: Column) -> Column: ...
    def worded_inch(self, value: Column, unit: bool = True) -> Column: ...
    def worded_kilometre(self, value: Column, unit: bool = True) -> Column: ...
    def worded_square_kilometre(self, value: Column, unit: bool = True) -> Column: ...
    def worded_date(self, iso: Column) -> Column: ...
    def class_phrases(self, label: Column) -> Column: ...
    def part_of_proper_noun(self, word: Column) -> Column: ...
    def adjust_text(self, text: Column) -> Column: ...
    def convert(self, value: Column, unit: Column) -> Column: ...


class English:
    language, decimal_separator, thousands_separator = "en", ".", ","

    def worded_int(self, value: Column) -> Column:
        """Thousands separated by commas; beyond 64 bits digits are grouped in decimal arithmetic."""
        small, large = value.try_cast("bigint"), value.try_cast("decimal(38,0)")
        return F.coalesce(F.format_number(small, 0), F.format_number(large, 0))

    def worded_float(self, value: Column) -> Column:
        """Rounded half away from zero to an integer, then worded; the integer step keeps "-0" out."""
        return F.format_number(F.round(value.try_cast("double")).try_cast("bigint"), 0)

    def _unit(self, value: Column, suffix: str, unit: bool) -> Column:
        worded = self.worded_float(value)
        return F.concat(worded, F.lit(suffix)) if unit else worded

    def worded_inch(self, value: Column, unit: bool = True) -> Column:
        return self._unit(value, " in", unit)

    def worded_kilometre(self, value: Column, unit: bool = True) -> Column:
        return self._unit(value, " km", unit)

    def worded_square_kilometre(self, value: Column, unit: bool = True) -> Column:
        return self._unit(value, " km2", unit)

    def worded_date(self, iso: Column) -> Column:
        """``Month D, Y`` for an ISO date; a minus sign before the year becomes `` B.C.``; null if it is no date."""
        before = F.startswith(iso, F.lit("-"))
        bare = F.regexp_replace(iso, "^-", "")
        day = F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}$"), bare.try_cast("date"))
        text = F.date_format(day, "MMMM d, y")
        return F.when(before, F.concat(text, F.lit(" B.C."))).otherwise(text)

    def class_phrases(self, label: Column) -> Column:
        """Both phrases, ``The x`` and ``the x``, with the label's first letter in lower case."""
        rest = F.concat(F.lower(label.substr(1, 1)), label.substr(F.lit(2), F.length(label)))
        return F.when(F.length(label) > 0, F.array(F.concat(F.lit("The "), rest), F.concat(F.lit("the "), rest)))

    def part_of_proper_noun(self, word: Column) -> Column:
        """Title case: each run of letters is a capital followed by small letters."""
        return word.rlike(TITLE_CASE)

    def adjust_text(self, text: Column, strict: bool = False) -> Column:
        """``21 August 1999`` to ``August 21, 1999``, ``3 January`` to ``January 3``; then tags go. With a year and without
        are two passes, as a group that takes no part would leave its comma. ``strict`` knows neither July nor August."""
        months = "|".join(m for m in MONTHS if not (strict and m in ("July", "August")))
        with_year = F.regexp_replace(text, rf"(\d{{1,2}})\s+({months})\s+(\d{{2,4}})", "$2 $1, $3")
        alone = F.regexp_replace(with_year, rf"(\d{{1,2}})\s+({months})", "$2 $1")
        return F.regexp_replace(alone, "<[^>]+>", "")

    def convert(self, value: Column, unit: Column) -> Column:
        """A template's number and unit in kilometres or square kilometres; the number itself if it is none, '' for other units."""
        bare = F.regexp_replace(value, ",", "")
        number = F.regexp_replace(F.regexp_replace(bare, "^(?:−|&minus;)", "-"), r"^\s+|\s+$", "")
        amount = F.when(number.rlike(r"^-?\d+(\.\d+)?$"), number.try_cast("double"))
        out = F.lit("")
        for name, factor in KILOMETRES.items():
            out = F.when(unit == name, self.worded_kilometre(amount * factor)).otherwise(out)
        for name, factor in SQUARE_KILOMETRES.items():
            out = F.when(unit == name, self.worded_square_kilometre(amount * factor)).otherwise(out)
        return F.when(amount.isNull(), bare).otherwise(out)


def is_numeric(wording: Column) -> Column:
    """Whether the first character is a decimal digit."""
    return wording.rlike(NUMBER)


def common_wording(kind: Column, value: Column, datatype: Column, label: Column, locale: Locale | None = None) -> Column:
    """The wording of a fact's object by its type and datatype; null if it has none, and then the fact is dropped."""
    locale = locale or English()
    typed = (
        F.when(datatype == f"{XSD}date", locale.worded_date(value))
        .when(datatype.isin(f"{XSD}int", f"{XSD}integer"), locale.worded_int(value))
        .when(datatype.isin(f"{XSD}float", f"{XSD}double"), locale.worded_float(value))
        .when(datatype == f"{UNITS}squareKilometre", locale.worded_square_kilometre(value))
        .when(datatype == f"{UNITS}inch", locale.worded_inch(value))
    )
    return F.when(kind == "uri", label).when(kind == "literal", value).when(kind == "typed-literal", typed)


def source_revision(provenance: Column) -> Column:
    """Revision number in a provenance URL; null without one."""
    found = F.regexp_extract(provenance, r"oldid=(\d+)", 1)
    return F.when(found != "", found.try_cast("bigint"))


def source_wiki(provenance: Column) -> Column:
    """Language prefix of the wiki in a provenance URL; null without one."""
    found = F.regexp_extract(provenance, r"^https?://([a-z-]+)\.wikipedia\.org/", 1)
    return F.when(found != "", found)
