"""Channel names: vocabularies, list dialects and checks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Channel vocabularies.
SCALP_19 = (
    "FP1", "FP2", "F7", "F3", "FZ", "F4", "F8", "T3", "C3", "CZ",
    "C4", "T4", "T5", "P3", "PZ", "P4", "T6", "O1", "O2",
)
EXPECTED_22 = SCALP_19 + ("A1", "A2", "ECG")
SCALP_19_MIXED = (
    "Fp1", "Fp2", "F7", "F3", "Fz", "F4", "F8", "T3", "C3", "Cz",
    "C4", "T4", "T5", "P3", "Pz", "P4", "T6", "O1", "O2",
)
POSTERIOR = ("O1", "O2", "P3", "P4")


def vocabulary(names) -> Column:
    return F.array(*[F.lit(n) for n in names])


def norm_channel(col: Column) -> Column:
    return F.regexp_replace(F.upper(F.regexp_replace(col, r"^\s+|\s+$", "")), " ", "")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def parse_channels(col: Column, dialect: str = "spaced") -> Column:
    """Array of channel names in upper case; order and repeats are kept.

    ``spaced``    commas count as blanks
    ``wrapped``   outer brackets dropped, quotes are blanks, ``, ; |`` separate
    ``unquoted``  quotes and square brackets deleted, commas and blanks separate
    """
    text = F.coalesce(col, F.lit(""))
    if dialect == "spaced":
        text = F.regexp_replace(text, ",", " ")
    elif dialect == "wrapped":
        text = F.regexp_replace(text, r"^\s+|\s+$", "")
        text = F.regexp_replace(text, r"^[\[\](){}]+|[\[\](){}]+$", "")
        text = F.regexp_replace(text, r"[,;|'\"]", " ")
    elif dialect == "unquoted":
        text = F.regexp_replace(F.regexp_replace(text, r"['\"\[\]]", ""), ",", " ")
    else:
        raise ValueError(f"unknown channel dialect: {dialect}")
    return _words(F.upper(text))


def not_in(channels: Column, known: Column) -> Column:
    """Channels absent from ``known``, keeping order and repeats."""
    return F.filter(channels, lambda c: ~F.array_contains(known, c))


def set_difference(left: Column, right: Column) -> tuple[Column, Column]:
    """Count and sorted, blank-joined text of ``left - right``."""
    diff = F.array_sort(F.array_except(left, right))
    return F.size(diff).cast("bigint"), F.array_join(diff, " ")
