"""Text cleaning as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _literal(text: str) -> str:
    """A replacement without group references."""
    return re.sub(r"([\\$])", r"\\\1", text)


def strip_comments(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<!--.*?-->", "")


def redundant_punctuation(text: Column, marks: Sequence[str]) -> Column:
    """Each mark, with the blanks around it, becomes one blank."""
    for m in marks:
        text = F.regexp_replace(text, rf"(?U)\s*\Q{m}\E\s*", " ")
    return text


def punctuation_blanks(text: Column, marks: Sequence[str]) -> Column:
    """No blanks before these marks."""
    for m in marks:
        text = F.regexp_replace(text, rf"(?U)\s+\Q{m}\E", _literal(m))
    return text


def collapse_blanks(text: Column) -> Column:
    """Runs of white space and zero characters become one blank; ends stay."""
    return F.regexp_replace(text, r"(?U)[\s\x00]+", " ")


def remove_stopwords(text: Column, stopwords: Sequence[str]) -> Column:
    """Every occurrence goes, whatever its case, inside words too; longer ones first."""
    words = sorted({w for w in stopwords if w}, key=lambda w: (-len(w), w))
    return F.regexp_replace(text, "(?iu)" + "|".join(rf"\Q{w}\E" for w in words), "") if words else text


def tag_count(html: Column) -> Column:
    """Opening tags in raw html."""
    return F.regexp_count(strip_comments(html), F.lit(r"<[A-Za-z][^<>]*>"))


def failed_load(text: Column, keys: Sequence[str]) -> Column:
    """Whether any of the patterns is found."""
    out = F.lit(False)
    for k in keys:
        out = out | text.rlike(k)
    return F.coalesce(out, F.lit(False))
