"""Measures in text, brought to base units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Unit spellings, their family, and what one of them is in the family's base unit.
UNITS = {
    "tb": ("memory_mb", 1048576.0), "тб": ("memory_mb", 1048576.0), "gb": ("memory_mb", 1024.0), "гб": ("memory_mb", 1024.0),
    "mb": ("memory_mb", 1.0), "мб": ("memory_mb", 1.0), "kb": ("memory_mb", 1 / 1024.0), "кб": ("memory_mb", 1 / 1024.0),
    "kg": ("mass_mg", 1e6), "кг": ("mass_mg", 1e6), "g": ("mass_mg", 1000.0), "гр": ("mass_mg", 1000.0), "г": ("mass_mg", 1000.0), "mg": ("mass_mg", 1.0), "мг": ("mass_mg", 1.0),
    "l": ("volume_ml", 1000.0), "л": ("volume_ml", 1000.0), "ml": ("volume_ml", 1.0), "мл": ("volume_ml", 1.0),
    "m": ("length_mm", 1000.0), "м": ("length_mm", 1000.0), "cm": ("length_mm", 10.0), "см": ("length_mm", 10.0), "mm": ("length_mm", 1.0), "мм": ("length_mm", 1.0),
    "hz": ("frequency_hz", 1.0), "гц": ("frequency_hz", 1.0), "kw": ("power_w", 1000.0), "квт": ("power_w", 1000.0), "w": ("power_w", 1.0), "вт": ("power_w", 1.0),
    "mah": ("battery_mah", 1.0), "мач": ("battery_mah", 1.0), "v": ("voltage_v", 1.0), "в": ("voltage_v", 1.0),
    "pcs": ("quantity", 1.0), "шт": ("quantity", 1.0), "inch": ("inch", 1.0), "дюйм": ("inch", 1.0),
}

# The units of typed measurements, the numeric type that they stand for, and their scale.
TYPED = {
    "tb": ("ram_storage", 1024.0**4), "тб": ("ram_storage", 1024.0**4), "gb": ("ram_storage", 1024.0**3), "гб": ("ram_storage", 1024.0**3),
    "mb": ("ram_storage", 1024.0**2), "мб": ("ram_storage", 1024.0**2), "kb": ("ram_storage", 1024.0), "кб": ("ram_storage", 1024.0),
    "kg": ("weight", 1000.0), "кг": ("weight", 1000.0), "mg": ("weight", 0.001), "мг": ("weight", 0.001), "g": ("weight", 1.0), "гр": ("weight", 1.0), "г": ("weight", 1.0),
    "ml": ("volume", 1.0), "мл": ("volume", 1.0), "l": ("volume", 1000.0), "л": ("volume", 1000.0),
    "mm": ("dimensions", 1.0), "мм": ("dimensions", 1.0), "cm": ("dimensions", 10.0), "см": ("dimensions", 10.0), "m": ("dimensions", 1000.0), "м": ("dimensions", 1000.0),
    "kw": ("power", 1000.0), "квт": ("power", 1000.0), "w": ("power", 1.0), "вт": ("power", 1.0), "v": ("voltage", 1.0), "в": ("voltage", 1.0), "hz": ("frequency", 1.0), "гц": ("frequency", 1.0),
    "mah": ("capacity", 1.0), "мач": ("capacity", 1.0), "dpi": ("optical", 1.0), "dpt": ("optical", 1.0), "дптр": ("optical", 1.0), "шт": ("pack_count", 1.0),
}

# Spellings that become one, in a text whose measures are written the same way throughout.
ALIASES = {
    "tb": "терабайт(?:а|ов)?|тб|tb", "gb": "гигабайт(?:а|ов)?|гб|gb", "mb": "мегабайт(?:а|ов)?|мб|mb", "kg": "килограмм(?:а|ов)?|кг|kg", "mg": "миллиграмм(?:а|ов)?|мг|mg",
    "g": "грамм(?:а|ов)?|гр|г|g", "ml": "миллилитр(?:а|ов)?|мл|ml", "l": "литр(?:а|ов)?|л|l", "mm": "миллиметр(?:а|ов)?|мм|mm", "cm": "сантиметр(?:а|ов)?|см|cm",
    "hz": "герц|гц|hz", "kw": "киловатт(?:а|ов)?|квт|kw", "w": "ватт(?:а|ов)?|вт|w",
}


def _spellings(table: dict) -> str:
    return "|".join(sorted(table, key=len, reverse=True))


def _lookup(table: dict, i: int) -> Column:
    return F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, v[i])))


def _number(text: Column) -> Column:
    return F.translate(text, ",", ".").cast("double")


def spelled(value: Column) -> Column:
    """One spelling of a value, to six places."""
    return F.round(value, 6).cast("string")


def measures(text: Column) -> Column:
    """Distinct (family, value in base units) of the numbers with a unit behind them."""
    folded = F.lower(F.coalesce(text, F.lit("")))
    pattern = rf"(?U)(?<!\w)(\d+(?:[.,]\d+)?)\s*({_spellings(UNITS)})(?!\w)"
    values, names = (F.regexp_extract_all(folded, F.lit(pattern), i) for i in (1, 2))
    family, factor = _lookup(UNITS, 0), _lookup(UNITS, 1)
    return F.array_distinct(F.zip_with(values, names, lambda x, u: F.struct(F.element_at(family, u).alias("family"), F.round(_number(x) * F.element_at(factor, u), 6).alias("value"))))


def by_family(text: Column) -> Column:
    """The measures of a text as a map: family -> distinct values."""
    return grouped(measures(text))


def grouped(found: Column) -> Column:
    """(family, value) rows in an array as a map: family -> values."""

    def of_family(rows: Column) -> Column:
        families = F.array_distinct(F.transform(rows, lambda m: m["family"]))
        return F.map_from_entries(F.transform(families, lambda f: F.struct(f, F.transform(F.filter(rows, lambda m: m["family"] == f), lambda m: m["value"]))))

    return let(found, of_family)


def typed(text: Column) -> Column:
    """(family, value) of typed measurements; values are spelled in base units."""
    pattern = rf"(?U)(?<![\w.])(\d+(?:[.,]\d+)?)\s*({_spellings(TYPED)})\b"
    values, names = (F.regexp_extract_all(text, F.lit(pattern), i) for i in (1, 2))
    family, factor = _lookup(TYPED, 0), _lookup(TYPED, 1)
    return F.zip_with(values, names, lambda x, u: F.struct(F.element_at(family, u).alias("family"), spelled(_number(x) * F.element_at(factor, u)).alias("value")))


def chains(text: Column) -> Column:
    """(dimensions, value) of chains of lengths such as 10x20x5 cm: the parts in millimetres, joined by x."""
    pattern = r"(?U)(?<![\w.])((?:\d+(?:[.,]\d+)?\s*[xх×*]\s*){1,3}\d+(?:[.,]\d+)?)\s*(mm|мм|cm|см|m|м)\b"
    parts, names = (F.regexp_extract_all(text, F.lit(pattern), i) for i in (1, 2))
    factor = _lookup(TYPED, 1)

    def one(chain: Column, unit: Column) -> Column:
        sizes = F.transform(F.split(chain, r"\s*[xх×*]\s*"), lambda x: spelled(_number(x) * F.element_at(factor, unit)))
        return F.struct(F.lit("dimensions").alias("family"), F.array_join(sizes, "x").alias("value"))

    return F.zip_with(parts, names, one)


def one_spelling(text: Column) -> Column:
    """A folded text with decimal points and one spelling of each unit: '1,5 Кг' becomes '1.5 kg'."""
    out = text
    for unit, spellings in ALIASES.items():
        out = F.regexp_replace(out, rf"(?U)(?<![\w.,])(\d+)(?:[.,](\d+))?\s*(?:{spellings})\b", f"$1\u0001$2 {unit}")
    return F.regexp_replace(F.regexp_replace(out, "\u0001(?=[0-9])", "."), "\u0001", "")
