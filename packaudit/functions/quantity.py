"""Net-quantity and month/year parsing (F18, F19) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packaudit import dims
from packaudit.functions.text import let

WEIGHT_VOLUME, LENGTH_AREA_NUMBER = "weight_or_volume", "length_area_number"


def decimal_text(text: Column) -> Column:
    """Number text with either decimal mark to double (a comma is always a decimal mark)."""
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def _quantity(raw: Column, mult: Column, value: Column, unit: Column, repaired: bool) -> Column:
    base_unit = F.try_element_at(dims.literal_map({u: b for u, (b, _) in dims.UNITS.items()}), unit)
    factor = F.try_element_at(dims.literal_map({u: f for u, (_, f) in dims.UNITS.items()}), unit)
    multiplier = F.coalesce(F.nullif(mult, F.lit("")).try_cast("int"), F.lit(1))
    number = decimal_text(value)
    return F.struct(
        F.trim(raw).alias("raw"), number.alias("value"), unit.alias("unit"), multiplier.alias("multiplier"),
        (number * factor * multiplier).alias("base_value"), base_unit.alias("base_unit"),
        F.when(base_unit.isin("g", "ml"), WEIGHT_VOLUME).otherwise(LENGTH_AREA_NUMBER).alias("kind"),
        F.lit(repaired).alias("ocr_recovered"))


def _forward(text: Column, pattern: str, repaired: bool) -> Column:
    """All readings of ``[n x] value unit`` in text order."""
    def read(m: Column) -> Column:
        part = [F.regexp_extract(m, pattern, g) for g in (1, 2, 3)]
        unit = F.lower(part[2])
        if repaired:
            unit = F.try_element_at(dims.literal_map(dims.UNIT_CONFUSIONS), unit)
        return _quantity(m, part[0], part[1], unit, repaired)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), read)
    return F.filter(found, lambda q: q["base_unit"].isNotNull())


def _preferred(readings: Column) -> Column:
    """First weight or volume, else the first reading, else null."""
    return let(readings, lambda r: F.coalesce(
        F.get(F.filter(r, lambda q: q["kind"] == WEIGHT_VOLUME), F.lit(0)), F.get(r, F.lit(0))))


def parse_net_quantity(text: Column, allow_repair: Column | bool) -> Column:
    """Quantity struct or null: a clean reading, a reversed count, or a repaired unit."""
    rev = [F.regexp_extract(text, dims.REVERSED_QUANTITY, g) for g in (0, 1, 2)]
    reversed_ = F.when(rev[0] != "", _quantity(rev[0], F.lit(""), rev[2], F.lower(rev[1]), False))
    allow = allow_repair if isinstance(allow_repair, Column) else F.lit(allow_repair)
    return F.when(text.rlike(r"(?U)\d"), F.coalesce(
        _preferred(_forward(text, dims.STRICT_QUANTITY, False)), reversed_,
        F.when(allow, _preferred(_forward(text, dims.LOOSE_QUANTITY, True)))))


def _dated(text: Column, pattern: str, month: Column, year_group: int) -> Column:
    year = F.regexp_extract(text, pattern, year_group)
    full = F.when(F.length(year) == 4, year.try_cast("int")).otherwise(year.try_cast("int") + 2000)
    hit = F.regexp_extract(text, pattern, 0)
    read = F.when(month.between(1, 12) & full.between(2000, 2099), F.struct(
        month.alias("month"), full.alias("year"), hit.alias("text"),
        (F.regexp_instr(text, F.lit(pattern)) - 1).alias("pos")))
    return F.when(text.rlike(pattern), read)


def parse_month_year(text: Column, strict_compat: bool = False) -> Column:
    """First date as struct<month,year,text,pos>; null when none.

    Day-month-year text is read as such. ``strict_compat`` tries the month/year
    pattern first, which takes the day's last digits for a month in such text.
    """
    numeric = _dated(text, dims.NUMERIC_DATE,
                     F.regexp_extract(text, dims.NUMERIC_DATE, 1).try_cast("int"), 2)
    name = F.upper(F.left(F.regexp_extract(text, dims.NAMED_DATE, 1), F.lit(3)))
    named = _dated(text, dims.NAMED_DATE,
                   F.try_element_at(dims.literal_map({m: i + 1 for i, m in enumerate(dims.MONTHS)}), name), 2)
    day = _dated(text, dims.DAY_DATE, F.regexp_extract(text, dims.DAY_DATE, 2).try_cast("int"), 3)
    order = [numeric, named, day] if strict_compat else [day, numeric, named]
    return F.when(text.rlike(r"\d"), F.coalesce(*order))
