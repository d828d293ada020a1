"""Column expressions over text: folding, numbers, dates.

All of them are built-in Spark expressions, so they stay inside code
generation; no Python runs per row.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 6)
WIDE = T.DecimalType(38, 12)
#: Runs of white space, the separators of files and records among them.
BLANK = "(?U)[\\s\\x1c-\\x1f]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def column(df: DataFrame, name: str, kind: str = "string") -> Column:
    """The column if the frame has it, else a typed null."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


#: Characters that no text holds: they stand before a letter and before its expansion.
_LETTER, _MEANS = "\ufdd0", "\ufdd1"


@lru_cache(maxsize=1)
def _letters() -> tuple[str, str, str, str]:
    """Characters that decompose to one plain one or to none, the plain ones, those of several, and what each of these means."""
    wide, plain, marks, long, means = [], [], [], [], []
    for code in range(0x80, 0x110000):
        if 0xAC00 <= code < 0xE000:  # Hangul syllables stay whole; surrogates are no characters
            continue
        ch = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
        if len(base) > 1:
            long.append(code)
            means.append(f"{_LETTER}{ch}{_MEANS}{base}")
        elif not base:
            marks.append(ch)
        elif base != ch:
            wide.append(ch)
            plain.append(base)
    spans: list[list[int]] = []
    for code in long:
        if spans and spans[-1][1] == code - 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    some = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans)
    # Marks come last: characters beyond the end of the plain ones are dropped.
    return "".join(wide + marks), "".join(plain), some, "".join(means) + _LETTER


def _expand(c: Column) -> Column:
    """Ligatures, fractions, squared units and the like, written out.

    The meanings are put behind the text, where one pattern finds that of
    each letter; so this stays one built-in expression.
    """
    _, _, some, means = _letters()
    one = f"(?s)\\G([^{_LETTER}{some}]*+)([{some}])(?=.*?{_LETTER}\\2{_MEANS}([^{_LETTER}]*+))"
    full = F.regexp_replace(F.concat(c, F.lit(means)), one, "$1$3")
    return F.when(c.rlike(f"[{some}]"), F.substring(full, F.lit(1), F.char_length(full) - len(means))).otherwise(c)


def unaccent(c: Column | str) -> Column:
    """Compatibility-decompose and drop combining marks (case is kept; Hangul syllables are not taken apart)."""
    c = _col(c)
    wide, plain, _, _ = _letters()
    # Plain text, the usual case, pays for one pattern test only.
    return F.when(c.rlike("[^\\x00-\\x7f]"), F.translate(_expand(c), wide, plain)).otherwise(c)


def fold(c: Column | str) -> Column:
    """Accent-free, single-spaced, trimmed, lower case; null becomes ''."""
    return F.lower(F.trim(F.regexp_replace(unaccent(F.coalesce(_col(c), F.lit(""))), BLANK, " ")))


def fold_name(name: str) -> str:
    """Python twin of :func:`fold` for column headers, with separators removed."""
    text = unicodedata.normalize("NFKD", str(name))
    text = "".join(x for x in text if not unicodedata.combining(x)).lower()
    return "".join(text.split()).replace("_", "")


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(_col(c)), F.lit(""))


def digits(c: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(_col(c), F.lit("")), "[^0-9]", "")


def alnum(c: Column | str) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(_col(c), F.lit("")), "[^\\p{L}\\p{N}]", ""))


def company_root(c: Column | str) -> Column:
    """First eight characters of a company id, zero padded on the left."""
    token = F.substring(alnum(c), 1, 8)
    return F.when(token != "", F.lpad(token, 8, "0"))


NO_NUMBER = ["", "nan", "none", "null", "-"]


def parse_decimal(c: Column | str, to: T.DecimalType = MONEY) -> Column:
    """Decimal from Brazilian or plain notation; null when it is not a number.

    The last separator decides: after a comma with no dot behind it, dots are
    thousands marks; otherwise commas are.
    """
    s = F.trim(_col(c))
    comma_last = s.rlike(",[^.]*$")
    return F.when(comma_last, F.translate(s, ",.", ".")).otherwise(F.translate(s, ",", "")).try_cast(to)


_ISO = "^\\d{4}-\\d{1,2}-\\d{1,2}([T ]\\d{1,2}:\\d{2}(:\\d{2}(\\.\\d+)?)?\\s*(Z|[+-]\\d{2}:?\\d{2})?)?$"
_DMY = "^(\\d{1,2})/(\\d{1,2})/(\\d{4})( \\d{1,2}:\\d{2}:\\d{2})?$"
_YMD = "^(\\d{4})(\\d{2})(\\d{2})$"


def parse_timestamp(c: Column | str) -> Column:
    """Timestamp from ISO (with or without zone), d/m/Y [H:M:S] or Ymd text.

    Text without a zone is read in the session zone, which is UTC here.
    """
    s = F.regexp_replace(F.regexp_replace(F.trim(_col(c)), _DMY, "$3-$2-$1$4"), _YMD, "$1-$2-$3")
    return F.when(s.rlike(_ISO), s).try_cast("timestamp")


def parse_date(c: Column | str) -> Column:
    return parse_timestamp(c).cast("date")


def quarter_label(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))


def day_text(d: Column) -> Column:
    return F.coalesce(d.cast("string"), F.lit(""))


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def is_truthy(c: Column | str) -> Column:
    return fold(_col(c).cast("string")).isin("1", "true", "t", "yes", "vencedor")


def month_windows(start: Column, end: Column) -> Column:
    """Array of (first, last) day pairs, one per calendar month the range touches."""
    months = F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month"))
    return F.transform(
        months,
        lambda m: F.struct(
            F.greatest(m.cast("date"), start).alias("first"),
            F.least(F.last_day(m), end).alias("last"),
        ),
    )
