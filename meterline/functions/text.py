"""Names, codes and display strings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def postal_code(c: Column) -> Column:
    """NN-NNN from five digits with blanks or dashes anywhere; null for anything else."""
    bare = c
    for blank in "- \t\n\x0b\f\r":
        bare = F.replace(bare, F.lit(blank))
    made = F.when(bare.rlike(r"\A[0-9]{5}\z"), F.concat(bare.substr(1, 2), F.lit("-"), bare.substr(3, 3)))
    return F.when(c.rlike(r"\A[0-9]{2}-[0-9]{3}\z"), c).otherwise(made)  # most are in order already, which costs one look


def once(df: DataFrame, **made: Column) -> DataFrame:
    """df with more columns, each computed once a row: a generator's output isn't folded into the filters and columns that use it."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def folded(c: Column) -> Column:
    return F.upper(F.translate(F.trim(c), "łŁóÓźŹ", "lLoOzZ"))


def matched(c: Column, pattern: str, group: int = 1) -> Column:
    """A regular expression's group, null where it is empty or doesn't match."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def meter_id(name: Column, pattern: str) -> Column:
    return matched(F.upper(F.trim(name)), pattern)


def id_letter(meter: Column) -> Column:
    return matched(meter, "([A-Z])$")


def subzone_of_letter(letter: Column, subzones: dict[str, str]) -> Column:
    """The subzone that a letter stands for; null for other letters."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in subzones.items() for x in pair]), letter)


def short_street(full: Column, stem: Column) -> Column:
    known = F.trim(stem) != ""
    avenue = F.lower(full).rlike(r"^(aleja |al\. )")
    return F.when(F.coalesce(known, F.lit(False)), F.when(avenue, F.concat(F.lit("al. "), stem)).otherwise(stem)).otherwise(full)


def shortened(listed: Column, most: int = 6, sep: str = "; ") -> Column:
    """The first `most` parts of a joined list and how many more there are."""
    parts = F.split(listed, sep)
    rest = F.size(parts) - most
    return F.concat(F.array_join(F.slice(parts, 1, most), sep), F.when(rest > 0, F.concat(F.lit(" (+"), rest.cast("string"), F.lit(")"))).otherwise(""))


def money(c: Column) -> Column:
    """12.5 -> '12,50 zł'."""
    return F.concat(F.translate(F.format_string("%.2f", c), ".", ","), F.lit(" zł"))


def thousands(c: Column, digits: int = 0) -> Column:
    return F.translate(F.format_number(c, digits), ",.", " ,")


def duration(minutes: Column) -> Column:
    """Up to an hour in minutes, beyond it in hours and minutes."""
    m = minutes.cast("long")
    hours, rest = F.floor(m / 60).cast("string"), m % 60
    long = F.concat(hours, F.lit(" h"), F.when(rest != 0, F.concat(F.lit(" "), rest.cast("string"), F.lit(" min"))).otherwise(""))
    return F.when(m <= 60, F.concat(m.cast("string"), F.lit(" min"))).otherwise(long)


def label_number(read: Column, letter: Column, highest: int = 440) -> Column:
    """The number on a label as OCR read it: blanks and a leading B or D (a frame's edge) go, the known letter is cut off,
    and a B may have been read as 8. Numbers outside 1 .. highest are null."""
    t = F.regexp_replace(F.upper(F.regexp_replace(F.coalesce(read, F.lit("")), r"\s", "")), "^[BD](?=[0-9])", "")
    last = t.substr(F.length(t), F.lit(1))
    digits = t.substr(F.lit(1), F.length(t) - 1)
    fits = (last == letter) | ((letter == "B") & (last == "8"))
    n = F.when(fits & digits.rlike("^[0-9]{1,3}$"), digits.cast("int"))
    return F.when(n.between(1, highest), n)


def label_id(number: Column, letter: Column) -> Column:
    return F.concat(number.cast("string"), letter)
