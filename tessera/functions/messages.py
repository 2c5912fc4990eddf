"""Texts of outcomes by key, joined to outcomes as a small table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A sentence for each key; ``{kind}`` stands for the file's format.
TEXTS = {
    "not_a_file": "There is no such file.",
    "unsupported_format": "This format can't be cleaned.",
    "damaged": "The {kind} file is damaged.",
    "unsupported_variant": "This variant of {kind} can't be cleaned.",
    "unsupported_part": "The {kind} file has a part that can't be judged.",
    "unsupported_profile": "The colour profile in the {kind} file can't be reduced safely.",
    "raw_photo": "Raw photos can't be cleaned.",
    "too_large": "The {kind} picture is too large to check.",
    "extra_image_data": "The {kind} file hides data behind its picture.",
    "no_video": "The {kind} file has no picture track.",
    "verification_failed": "The clean copy of the {kind} file could not be proven equivalent.",
}


def with_texts(outcomes: DataFrame) -> DataFrame:
    """``outcomes`` (``kind, error_key``) with ``message``, null for clean copies."""
    table = outcomes.sparkSession.createDataFrame(list(TEXTS.items()), "error_key string, message_text string")
    joined = outcomes.join(F.broadcast(table), "error_key", "left")  # one row per key above
    return joined.withColumn("message", F.replace("message_text", F.lit("{kind}"), F.coalesce("kind", F.lit("file")))).drop("message_text")
