"""Column functions over text shared by the operators (JVM side, no Python workers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that must read the same texts as the notes' own format.
ANCHOR = r"\{\{\s*(?:p|loc)\.\s*([0-9ivxlcdmIVXLCDM]+)\s*\}\}|<!--\s*p\.\s*([0-9ivxlcdmIVXLCDM]+)\s*-->"
WIKILINK = r"\[\[([^\]|#]+)"


def is_blank(c: Column) -> Column:
    """Null, empty, only white space, ``null`` or ``[]``."""
    return c.isNull() | F.regexp_replace(c, r"(?U)^\s+|\s+$", "").isin("", "null", "[]")


def squeeze(c: Column) -> Column:
    """White space of any kind trimmed at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Runs of anything but Unicode white space; null counts 0."""
    return F.coalesce(F.regexp_count(c, F.lit(r"(?U)\S+")), F.lit(0)).cast("long")


def link_stem(c: Column) -> Column:
    """Stem a link means: inside ``[[ ]]`` if marked so, without alias, section, folder, extension, white space.

    Null where the field is blank or the link is empty.
    """
    inner = F.when(F.instr(c, "[[") > 0, F.regexp_extract(c, r"\[\[([^\]]*)\]\]", 1)).otherwise(c)
    inner = F.regexp_replace(inner, r"[|#].*$", "")
    inner = F.regexp_replace(inner, r"^.*/", "")
    inner = F.regexp_replace(squeeze(inner), r"(?i)\.md$", "")
    return F.when(is_blank(c), F.lit(None)).otherwise(F.nullif(squeeze(inner), F.lit("")))
