"""Items as text and back: labelled lines, truncation at line ends, values exchanged in place."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx
from . import features as fe, similarity as sim

TITLE, CATEGORY, CUT = "Название", "Категория", "Характеристики обрезаны"
FAMILY_ORDER = ("identifier", "brand", "model", "size", "quantity", "color", "country", "material")


def card(category: Column, name: Column, bag: Column, priority: list[str]) -> Column:
    """Lines of category, name and attributes, keys of the priority list first."""
    return F.concat_ws("\n", F.concat(F.lit(f"{CATEGORY}: "), category), F.concat(F.lit(f"{TITLE}: "), name), sim.serialize(bag, priority, "\n"))


def title_line(text: Column) -> Column:
    """What the title line of a card says, '' without one; the label may be in any case, on any line."""
    return F.trim(F.regexp_extract(text, rf"(?imu)^\s*{TITLE}\s*:[ \t]*(.*)$", 1))


def fields(text: Column) -> Column:
    """Folded key -> value of a card's 'key: value' lines, but for category, title and the mark of a cut; of repeated keys
    the last counts."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: s.contains(":"))
    pairs = F.transform(lines, lambda s: F.struct(tx.fold(F.substring_index(s, ":", 1)).alias("key"), F.trim(F.substr(s, F.locate(":", s) + 1)).alias("value")))
    kept = F.filter(pairs, lambda e: ~e["key"].isin(CATEGORY.lower(), TITLE.lower(), CUT.lower()) & (e["key"] != "") & (e["value"] != ""))
    last = F.filter(kept, lambda e, i: ~F.exists(F.slice(kept, i + 2, F.greatest(F.size(kept), F.lit(1))), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def exchange(text: Column, key: Column, old: Column, new: Column) -> Column:
    """A card with another value of one key, and in its title wherever the old value stands there, in any case. Null where the
    card lacks the key."""
    quoted = F.concat(F.lit(r"(?iu)"), F.regexp_replace(old, r"([\\.\[\]{}()*+?^$|])", r"\\$1"))
    safe = F.regexp_replace(new, r"([\\$])", r"\\$1")

    def line(s: Column) -> Column:
        label = tx.fold(F.substring_index(s, ":", 1))
        head, rest = F.substring_index(s, ":", 1), F.trim(F.substr(s, F.locate(":", s) + 1))
        return (
            F.when(~s.contains(":"), s).when(label == key, F.concat(head, F.lit(": "), new))
            .when(label == TITLE.lower(), F.concat(head, F.lit(": "), F.regexp_replace(rest, quoted, safe))).otherwise(s)
        )

    return F.when(F.map_contains_key(fields(text), key), F.array_join(F.transform(F.split(text, "\n"), line), "\n"))


def cut_lines(text: Column, limit: int, mark: str = CUT) -> Column:
    """A card of at most ``limit`` characters: whole lines, and a last one that says that it was cut, where it must be. The
    first line is kept, shortened if need be."""
    room = limit - len(mark) - 1
    lines = F.split(text, "\n")
    kept = F.aggregate(
        lines, F.struct(F.lit("").alias("s"), F.lit(True).alias("go"), F.lit(True).alias("first")),
        lambda acc, x: F.struct(
            F.when(acc["first"], F.substring(x, 1, room)).when(acc["go"] & (F.length(acc["s"]) + 1 + F.length(x) <= room), F.concat(acc["s"], F.lit("\n"), x)).otherwise(acc["s"]).alias("s"),
            F.when(acc["first"], F.length(x) <= room).otherwise(acc["go"] & (F.length(acc["s"]) + 1 + F.length(x) <= room)).alias("go"), F.lit(False).alias("first"),
        ), lambda acc: acc["s"],
    )
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(kept, F.lit("\n"), F.lit(mark)))


def rich_card(name: Column, bag: Column, seller: str = r"продавец|магазин|seller|vendor|store") -> Column:
    """Title and attributes in the order of their families, then by key; what only the seller says is left out."""
    rank = F.create_map(*(F.lit(x) for i, f in enumerate(FAMILY_ORDER) for x in (f, i)))
    entries = F.filter(F.map_entries(bag), lambda e: ~e["key"].rlike(seller))
    placed = F.transform(entries, lambda e: F.struct(F.coalesce(F.try_element_at(rank, F.coalesce(fe.family_of(e["key"]), F.lit(""))), F.lit(50)).alias("r"), e["key"].alias("key"), e["value"].alias("value")))
    return F.concat(F.lit(f"{TITLE}: "), name, F.lit("\n"), F.array_join(F.transform(F.array_sort(placed), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n"))


def compatibility_fold(text: Column) -> Column:
    """NFKC, full case folding, io as ie, squeezed white space; punctuation stays (Arrow batches: Catalyst has neither of the
    first two)."""

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        folded = s.fillna("").str.normalize("NFKC").str.casefold().str.replace("ё", "е")
        return folded.str.replace(r"\s+", " ", regex=True).str.strip()

    return fold(text)
