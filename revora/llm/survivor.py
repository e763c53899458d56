"""Which rows are copies of one review: keys of the vendor's id and of the content.

Rows with a vendor's id are copies by (facility, id); rows without one are
copies by (facility, reviewer, day, text) and join every vendor group that holds
a row of the same content.

Defined results: null or blank names, days, facilities or texts never link a
row that has no vendor id; a substitute id starts with ``h:``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space as Python's strip() removes it.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def written_day(date: Column) -> Column:
    """The day of a date as it is written, 'YYYY-MM-DD', or null."""
    form = r"^\s*([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})(?![0-9]).*"
    day = F.regexp_replace(F.trim(date), r"(?s)" + form, "$1-0$2-0$3")
    short = F.regexp_replace(day, r"-0?([0-9]{2})", "-$1")
    return F.when(date.rlike(form[:-2]), short)


def is_vendor_id(review_id: Column) -> Column:
    own = stripped(review_id)
    return review_id.isNotNull() & (own != "") & ~own.startswith("h:")


def keys() -> dict[str, Column]:
    """A row's vendor key and content key, null where it has none."""
    real, day, name = is_vendor_id(F.col("review_id")), written_day(F.col("review_date")), F.col("reviewer_name")
    linked = F.col("facility_id").isNotNull() & (stripped(name) != "") & day.isNotNull() & (stripped(F.col("text")) != "")
    return {
        "vendor_key": F.when(real & F.col("facility_id").isNotNull(), F.md5(F.concat_ws("\x1f", F.col("facility_id").cast("string"), stripped(F.col("review_id"))))),
        "content_key": F.when(linked, F.md5(F.concat_ws("\x1f", F.col("facility_id").cast("string"), name, day, F.col("text")))),
    }
