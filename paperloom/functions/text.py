"""Column expressions on text that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


#: Letters whose capital is another than that of the letter they are a case of, and that letter;
#: the dotless i, which is a letter of its own, waits as a character that no text has.
ODD_CASES = {"\u1e9e": "\u00df", "\u2126": "\u03c9", "\u212a": "k", "\u212b": "\u00e5", "\u03f4": "\u03b8", "\u0131": "\ufdd0"}


def folded(text: Column) -> Column:
    """The text in one case, so that texts that differ in case alone are equal, also where a letter becomes two.

    All letters go up, by which `ß` is `SS`. A collation isn't used, as those that leave case out also leave out
    the widths and circles of characters.
    """
    return F.upper(F.translate(text, "".join(ODD_CASES), "".join(ODD_CASES.values())))


def is_blank(text: Column) -> Column:
    """Whether a text is null, empty or white space only."""
    return text.isNull() | ~text.rlike(r"(?U)\S")


def joined(rows: Column, by: str) -> Column:
    """The `text` fields of collected (order..., text) structs, in order."""
    return F.array_join(F.transform(F.array_sort(rows), lambda r: r["text"]), by)


def extension(name: Column) -> Column:
    """The lower-case extension of a file name with its dot, or an empty text."""
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))
