"""String, age and grouping expressions, all built-in and codegen friendly."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Age bins are closed on the right, so 0 and anything above 120
# belong to no group.
AGE_GROUPS = (
    (0, 10, "0–10"),
    (10, 20, "11–20"),
    (20, 30, "21–30"),
    (30, 40, "31–40"),
    (40, 50, "41–50"),
    (50, 60, "51–60"),
    (60, 70, "61–70"),
    (70, 120, "70+"),
)
GENDERS = ("Male", "Female", "Other")

_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


# every character that counts as white space at the ends of a text
_BLANKS = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
           "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.trim(col, F.lit(_BLANKS))


def file_part(col: Column) -> Column:
    """Last component of a path written with slashes, backslashes or a drive."""
    bare = F.when(F.substring(col, 2, 1) == ":", F.substr(col, F.lit(3))).otherwise(col)
    return F.substring_index(F.rtrim(F.translate(bare, "\\", "/"), F.lit("/")), "/", -1)


def drop_suffix(name: Column) -> Column:
    """File name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def clean_stem(col: Column) -> Column:
    """Recording id of a file name: no quotes, folder or last suffix, lower case."""
    bare = F.trim(F.trim(strip(col), F.lit('"')), F.lit("'"))
    return F.lower(drop_suffix(file_part(bare)))


def normalize_class(col: Column) -> Column:
    """``Abnormal``, ``Normal`` or empty; "abnormal" is looked for first."""
    text = F.lower(F.coalesce(col, F.lit("")))
    return (
        F.when(text.contains("abnormal"), "Abnormal")
        .when(text.contains("normal"), "Normal")
        .otherwise("")
    )


def normalize_split(col: Column) -> Column:
    text = F.lower(strip(F.coalesce(col, F.lit(""))))
    return (
        F.when(text.isin("train", "training"), "train")
        .when(text.isin("evaluation", "eval", "test", "testing"), "evaluation")
        .otherwise(text)
    )


def parse_source_year(stem: Column) -> Column:
    """Struct ``(source, year)`` read from ``ffh_YYYY_`` / ``mh_YYYY_`` ids."""
    pattern = r"(?i)^(ffh|mh)_(\d{4})_"
    found = stem.rlike(pattern)
    return F.struct(
        F.when(found, F.lower(F.regexp_extract(stem, pattern, 1)))
        .otherwise("unknown").alias("source"),
        F.when(found, F.regexp_extract(stem, pattern, 2))
        .otherwise("unknown").alias("year"),
    )


def to_number(col: Column) -> Column:
    """Double for plain decimal text, null for anything else."""
    text = strip(col.cast("string"))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def make_age(years: Column, months: Column) -> Column:
    """Years plus months/12 to two decimals; null only when both are unreadable."""
    y, m = to_number(years), to_number(months)
    age = F.coalesce(y, F.lit(0.0)) + F.coalesce(m, F.lit(0.0)) / 12
    return F.when(y.isNotNull() | m.isNotNull(), F.bround(age, 2))


def normalize_gender(col: Column) -> Column:
    text = F.lower(strip(col))
    return (
        F.when(col.isNull(), "Unknown")
        .when(text.isin("m", "male"), "Male")
        .when(text.isin("f", "female"), "Female")
        .otherwise("Other")
    )


def age_group(age: Column) -> Column:
    label = F.lit(None).cast("string")
    for low, high, name in reversed(AGE_GROUPS):
        label = F.when((age > low) & (age <= high), name).otherwise(label)
    return label


def log1p_duration(col: Column) -> Column:
    """``log(1 + x)`` of finite values from zero up, null for the others."""
    finite = ~F.isnan(col) & (col < F.lit(float("inf")))
    return F.when(finite & (col >= 0), F.log1p(col))


def recording_group(path: Column) -> Column:
    """``Normal`` / ``Abnormal`` / ``Unknown`` from the words in a path."""
    text = F.lower(path)
    return (
        F.when(text.contains("abnormal"), "Abnormal")
        .when(text.contains("normal"), "Normal")
        .otherwise("Unknown")
    )


def recording_subset(path: Column) -> Column:
    return F.when(path.contains("train"), "train").otherwise("eval")
