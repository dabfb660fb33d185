"""Text decoding and tag helpers as columns, with kernels where Spark's decoders refuse what files hold."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import NUMBER_TAGS, TEXT_TAGS


def latin1(body: Column) -> Column:
    return F.decode(body, "ISO-8859-1")


def trimmed(text: Column) -> Column:
    """Without NUL and space at both ends."""
    return F.btrim(text, F.concat(F.lit(" "), F.char(F.lit(0))))


def upper_ascii(text: Column) -> Column:
    """a-z only: other letters stay."""
    low = "abcdefghijklmnopqrstuvwxyz"
    return F.translate(text, low, low.upper())


def split_count(text: Column) -> Column:
    """number and total of "3/12": digits gathered up to a character that ends them, after a slash the total."""
    head = F.substring_index(text, "/", 1)
    # Before the slash the first run of digits counts; after it all digits up to a second slash do.
    number = F.regexp_extract(head, "^[^0-9]*([0-9]+)", 1)
    ended = F.regexp_like(head, F.lit("[0-9][^0-9]"))
    rest = F.when(F.contains(text, F.lit("/")) & ~ended, F.substring_index(F.substring(text, F.length(head) + 2, 1 << 30), "/", 1))
    total = F.regexp_replace(F.coalesce(rest, F.lit("")), "[^0-9]", "")
    return F.struct(F.coalesce(number.try_cast("int"), F.lit(0)).alias("number"), F.coalesce(total.try_cast("int"), F.lit(0)).alias("total"))


def utf16(body: Column, big: Column) -> Column:
    """UTF-16 text; a lone surrogate becomes the replacement character, an odd last byte is dropped."""

    @F.pandas_udf("string")
    def run(body: pd.Series, big: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else bytes(b[: len(b) // 2 * 2]).decode("utf-16-be" if e else "utf-16-le", "replace") for b, e in zip(body, big)])

    return run(body, big)


def tags_are_empty(tags: Column) -> Column:
    """Nothing said; totals alone don't count."""
    texts = [F.coalesce(tags[n], F.lit("")) == "" for n in TEXT_TAGS]
    numbers = [F.coalesce(tags[n], F.lit(0)) == 0 for n in NUMBER_TAGS if not n.endswith("Total")]
    out = F.coalesce(F.size(tags["other"]), F.lit(0)) <= 0
    for x in texts + numbers:
        out = out & x
    return out


def merge_tags(newer: Column, older: Column) -> Column:
    """The newer tag; the older fills title, artist, album, date, comment and track number, and adds keys not yet there."""
    filled = {"title", "artist", "album", "date", "comment"}
    pick = lambda n: F.coalesce(F.nullif(newer[n], F.lit("")), older[n]) if n in filled else newer[n]
    fields = [pick(n).alias(n) for n in TEXT_TAGS]
    fields += [(F.coalesce(F.nullif(newer[n], F.lit(0)), older[n]) if n == "trackNumber" else newer[n]).alias(n) for n in NUMBER_TAGS]
    more = F.filter(older["other"], lambda o: ~F.exists(newer["other"], lambda n: n["key"] == o["key"]))
    return F.struct(*fields, F.concat(newer["other"], more).alias("other"))


def tags_json(tags: Column) -> Column:
    """The tag as JSON: fields in a fixed order, other as a list of key and value."""
    return F.to_json(F.struct(*[tags[n].alias(n) for n in (*TEXT_TAGS, *NUMBER_TAGS)], tags["other"].alias("other")))
