"""Unit text to canonical unit and factor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lisura.functions import fixed
from lisura.functions import text as X
from lisura.session import cut_lineage

#: A pack word with its number and what it holds, or a number with a measure word, from the plain lists.
_PACKS = "|".join((*fixed.PACK_OF_UNITS, *fixed.OTHER_PACKS))
_INSIDE = "|".join((*fixed.UNIT_WORDS, *fixed.SHEET_WORDS[1:], *(w for w, base, _ in fixed.MEASURES if base in ("l", "kg"))))
_MEASURED = "|".join(w for w, _, _ in fixed.MEASURES)
# How a number is written, and what may stand between a pack word and its number.
_NUMBER, _BETWEEN = r"(\d+(?:[.,]\d+)?)", r"(?:\s*(?:c/|com|de|x|/)\s*|\s+|(?=\d))"
PACK = rf"^({_PACKS}){_BETWEEN}{_NUMBER}(?:\s*({_INSIDE}))?$"
QUANTITY = rf"^(?:[a-z][a-z0-9]*\s+)?{_NUMBER}\s*({_MEASURED})$"


def unit_key(raw: Column) -> Column:
    return F.regexp_replace(X.fold(raw), "[.:;]+$", "")


def _measures(what: int) -> Column:
    """Literal map from measure word to canonical unit (0) or factor (1)."""
    return F.create_map(*[F.lit(x) for word, *row in fixed.MEASURES for x in (word, row[what])])


def _structured(df: DataFrame) -> DataFrame:
    """Add ``s_c`` and ``s_f``: unit and factor read out of "cx c/ 10" or "frasco 20 ml".

    Built in steps, so each pattern is matched once per text.
    """
    key = F.col("key")
    df = df.withColumns({
        "_head": F.regexp_extract(key, PACK, 1), "_pack": F.regexp_extract(key, PACK, 2),
        "_inner": F.regexp_extract(key, PACK, 3), "_qty": F.regexp_extract(key, QUANTITY, 1),
        "_word": F.regexp_extract(key, QUANTITY, 2),
    })
    df = df.withColumns({
        "_pack": X.parse_decimal("_pack"), "_qty": X.parse_decimal("_qty"),
        "_unit": F.try_element_at(_measures(0), F.when(F.col("_head") != "", F.col("_inner")).otherwise(F.col("_word"))),
        "_size": F.try_element_at(
            _measures(1), F.when(F.col("_head") != "", F.col("_inner")).otherwise(F.col("_word"))).cast(X.MONEY),
    })
    number = F.when(F.col("_head") != "", F.col("_pack")).otherwise(F.col("_qty"))
    pack = F.col("_head") != ""
    sheets = F.col("_head").isin(*fixed.SHEET_WORDS) | F.col("_inner").isin(*fixed.SHEET_WORDS)
    counted = F.when(sheets, "folha").when(F.col("_head").isin(*fixed.PACK_OF_UNITS), "un")
    # A zero number settles the matter: no unit.
    canonical = F.when(number != 0, F.coalesce(F.col("_unit"), F.when(pack, counted)))
    factor = F.when(F.col("_unit").isNotNull(), (number * F.col("_size")).cast(X.MONEY)).otherwise(number)
    return df.withColumns({"s_c": canonical, "s_f": factor}).drop(
        "_head", "_pack", "_inner", "_qty", "_word", "_unit", "_size")


def match_units(texts: DataFrame, units: DataFrame | None = None, name: str = "unidade_medida") -> DataFrame:
    """(text, unidade_canonica, fator, base_unit, unit_parse_confidence) per distinct text.

    Order: exact spelling, exact without blanks, structured reading, longest
    known prefix, else ``unknown``.  Prefixes become an equality join: each
    text lists its own prefixes, so there is no inequality join with the table.
    """
    units = units if units is not None else fixed.units(texts.sparkSession)
    table = units.select(
        unit_key(F.col("raw")).alias("k"),
        F.struct(
            F.col("canonical"), F.col("to_base_factor").cast(X.MONEY).alias("factor"), F.col("base_unit")).alias("u"),
    )
    known = (
        table.unionByName(table.withColumn("k", F.replace("k", F.lit(" "), F.lit(""))))
        .groupBy("k").agg(F.max("u").alias("u"))
    )
    keyed = cut_lineage(texts.select(F.col(name)).distinct()).withColumn("key", unit_key(F.col(name)))
    keyed = keyed.withColumn("tight", F.replace("key", F.lit(" "), F.lit("")))
    exact = keyed.join(known.select(F.col("k").alias("key"), F.col("u").alias("e1")), "key", "left").join(
        known.select(F.col("k").alias("tight"), F.col("u").alias("e2")), "tight", "left")
    parsed = _structured(exact)
    settled = F.coalesce("e1", "e2").isNotNull() | F.col("s_c").isNotNull()

    # Prefixes of the key must be followed by a blank, "/" or "x"; prefixes of
    # the key without blanks by a digit.
    todo = parsed.where(~settled & (F.length("key") >= 3)).select("key", "tight")
    cuts = F.sequence(F.lit(2), F.length("key") - 1)
    loose = todo.select("key", F.explode(cuts).alias("n"), F.col("key").alias("_t"), F.lit(" /x").alias("_after"))
    tight_cuts = F.sequence(F.lit(2), F.length("tight") - 1)
    solid = todo.where(F.length("tight") >= 3).select(
        "key", F.explode(tight_cuts).alias("n"), F.col("tight").alias("_t"), F.lit("0123456789").alias("_after"))
    tries = loose.unionByName(solid)
    tries = tries.withColumn("_next", F.substring("_t", F.col("n") + 1, F.lit(1))).where(
        F.contains("_after", F.col("_next"))).withColumn("k", F.substring("_t", F.lit(1), F.col("n")))
    prefix = tries.join(known, "k").groupBy("key").agg(F.max_by("u", "n").alias("p"))
    full = parsed.join(prefix, "key", "left")
    best = F.coalesce(
        F.col("e1"), F.col("e2"),
        F.when(F.col("s_c").isNotNull(), F.struct(
            F.col("s_c").alias("canonical"), F.col("s_f").alias("factor"), F.col("s_c").alias("base_unit"))),
        F.col("p"),
    )
    found = full.withColumn("b", F.when(F.col("key") != "", best))
    return found.select(
        name,
        F.coalesce(F.col("b.canonical"), F.lit("unknown")).alias("unidade_canonica"),
        F.coalesce(F.col("b.factor"), F.lit(1).cast(X.MONEY)).alias("fator"),
        F.coalesce(F.col("b.base_unit"), F.lit("unknown")).alias("base_unit"),
        F.when(F.col("b").isNotNull(), "parsed").otherwise("unknown").alias("unit_parse_confidence"),
    )
