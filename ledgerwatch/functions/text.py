"""Text helpers for analyst narratives."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_reasoning(text) -> Column:
    """Drop closed ``<think>`` blocks and outer whitespace; an unterminated block stays."""
    text = F.col(text) if isinstance(text, str) else text
    cleaned = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return F.regexp_replace(cleaned, r"^\s+|\s+$", "")


def recommendation(text) -> Column:
    """First match of the ordered recommendations; monitoring when none is named."""
    upper = F.upper(F.col(text) if isinstance(text, str) else text)
    return (
        F.when(upper.contains("FILE STR"), "FILE STR")
        .when(upper.contains("ENHANCED MONITORING"), "ENHANCED MONITORING")
        .when(upper.contains("DISMISS"), "DISMISS")
        .otherwise("ENHANCED MONITORING")
    )
