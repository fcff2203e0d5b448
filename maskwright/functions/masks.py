"""Format-preserving masks: the shape of a value stays, its content goes.

All take and give text Columns; lengths that show are UTF-16 units except in mask_generic, which counts code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cells import NOT_WS, WS, digits, is_date_type, units


def _times(mark: str, n: Column) -> Column:
    return F.repeat(F.lit(mark), F.greatest(n, F.lit(0)).cast("int"))


def mask_generic(text: Column, keep_start: int = 1, keep_end: int = 0, mark: str = "*") -> Column:
    """Keeps a prefix and a suffix, together at most half of the text; shorter than 4 is masked whole.

    Where both ends together would show more than half (M), the larger gives way until they fit, the suffix first on ties; in closed form the prefix is
    cut to max(M - suffix, ceil(M / 2)) and the suffix to max(M - prefix, floor(M / 2))."""
    s, e = max(0, keep_start), max(0, keep_end)
    n = F.char_length(text)
    most = F.floor(n / 2).cast("int")
    fits = F.lit(s + e) <= most
    start = F.when(fits, F.lit(s)).otherwise(F.least(F.lit(s), F.greatest(most - e, F.ceil(most / 2).cast("int"))))
    end = F.when(fits, F.lit(e)).otherwise(F.least(F.lit(e), F.greatest(most - s, F.floor(most / 2).cast("int"))))
    masked = F.concat(F.substr(text, F.lit(1), start), _times(mark, n - start - end), F.when(end > 0, F.substr(text, n - end + 1)).otherwise(F.lit("")))
    return F.when(n < 4, _times(mark, n)).otherwise(masked)


def mask_email(text: Column, mark: str = "*") -> Column:
    """b***@host: the first character and the domain stay; a local part of one character goes whole."""
    parts = r"(?s)^(.+)(@[^@]*)\z"
    local, domain = F.regexp_extract(text, parts, 1), F.regexp_extract(text, parts, 2)
    n = units(local)
    shown = F.when(n > 1, F.substr(local, F.lit(1), F.lit(1))).otherwise(F.lit(""))
    return F.when(text.rlike(parts), F.concat(shown, _times(mark, F.when(n > 1, n - 1).otherwise(F.lit(1))), domain)).otherwise(mask_generic(text, 1, 0, mark))


def mask_phone(text: Column, mark: str = "*") -> Column:
    """+6281****6789: four leading digits and the last four stay.

    With 9 digits or fewer that rule would show all or nearly all of them, so there only the last two can stay."""
    d = digits(text)
    n = F.length(d)
    plus = F.when(F.regexp_replace(text, f"^{WS}+", "").startswith("+"), F.lit("+")).otherwise(F.lit(""))
    long = F.concat(plus, F.substr(d, F.lit(1), F.lit(4)), _times(mark, n - 8), F.right(d, F.lit(4)))
    return F.when(n < 6, _times(mark, units(text))).when(n <= 9, F.concat(plus, mask_generic(d, 0, 2, mark))).otherwise(long)


def mask_card(text: Column, mark: str = "*") -> Column:
    """Six leading digits and the last four stay."""
    d = digits(text)
    n = F.length(d)
    return F.when(n < 12, mask_generic(d, 0, 4, mark)).otherwise(F.concat(F.left(d, F.lit(6)), _times(mark, n - 10), F.right(d, F.lit(4))))


def mask_nik(text: Column, mark: str = "*") -> Column:
    """The region prefix of four digits and the last two stay."""
    d = digits(text)
    return F.when(F.length(d) != 16, mask_generic(d, 4, 2, mark)).otherwise(F.concat(F.left(d, F.lit(4)), F.lit(mark * 10), F.right(d, F.lit(2))))


def mask_npwp(text: Column, mark: str = "*") -> Column:
    d = digits(text)
    return F.concat(F.left(d, F.lit(2)), _times(mark, F.length(d) - 2))


def mask_date(col: Column, text: Column, dtype: T.DataType, mark: str = "*") -> Column:
    """The year stays: of a date cell, or the first year from 1900 to 2099 in a text."""
    tail = F.lit(f"-{mark * 2}-{mark * 2}")
    if is_date_type(dtype):
        return F.concat(F.year(col).cast("string"), tail)
    year = F.regexp_extract(text, "(?<![A-Za-z0-9_])((?:19|20)[0-9]{2})(?![A-Za-z0-9_])", 1)
    return F.when(year != "", F.concat(year, tail)).otherwise(_times(mark, units(text)))


def _literal(mark: str) -> str:
    return mark.replace("\\", "\\\\").replace("$", "\\$")


def mask_name(text: Column, mark: str = "*") -> Column:
    """The first character of every word stays, white space too."""
    return F.regexp_replace(text, f"(?<={NOT_WS}){NOT_WS}", _literal(mark))


def mask_address(text: Column, mark: str = "*") -> Column:
    return F.regexp_replace(text, "[0-9]", _literal(mark))


def mask_whole(text: Column, mark: str = "*") -> Column:
    return _times(mark, units(text))


def apply_partial(col: Column, text: Column, dtype: T.DataType, semantic: str, mark: str = "*", keep_start: int = 1, keep_end: int = 0) -> Column:
    """The mask for a semantic type; keep_start and keep_end count only for text and unknown."""
    simple = {"email": mask_email, "phone": mask_phone, "card": mask_card, "nik": mask_nik, "npwp": mask_npwp, "name": mask_name, "address": mask_address, "currency": mask_whole}
    if semantic == "date":
        return mask_date(col, text, dtype, mark)
    return simple[semantic](text, mark) if semantic in simple else mask_generic(text, keep_start, keep_end, mark)
