"""EEG epoch amplitudes: lateral difference and its odd/even summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.conditional import if_null_safe, recode
from ..functions.strings import PARADIGMS, pad_number
from .summaries import full_join_summaries


def lateral_difference(epochs: DataFrame, left_label: str = "left") -> DataFrame:
    """Difference of the two electrodes per epoch, with subject code and condition labels.

    Epochs whose label equals `left_label` give P8 - P7, the others P7 - P8. No label is "left", so the
    default gives P7 - P8 throughout; "AN" gives contralateral minus ipsilateral.
    """
    letter = recode(F.col("paradigm"), {1: "a", 2: "b"})
    angry = recode(F.col("angry"), {1: "NA", 2: "AN"})
    right, left = F.col("P8"), F.col("P7")
    return epochs.select(
        F.concat(letter, pad_number(F.col("subject_num"))).alias("subject"),
        recode(letter, PARADIGMS).alias("paradigm"),
        "trial",
        angry.alias("angry"),
        F.when(F.col("trial") % 2 == 0, "Even").otherwise("Odd").alias("odd_even"),
        if_null_safe(angry == left_label, right - left, left - right).alias("n2pc"),
        "P7",
        "P8",
    )


def odd_even_summary(epochs: DataFrame) -> DataFrame:
    """Mean difference by subject: by half, by side and by both.

    The overall values weigh both sides evenly, whatever their numbers of epochs.
    """
    half = {k: F.col("odd_even") == k for k in ("Odd", "Even")}
    side = {k: F.col("angry") == k for k in ("AN", "NA")}
    both = {f"{s}_{h}": c & d for s, c in side.items() for h, d in half.items()}
    means = full_join_summaries(
        epochs, "n2pc", ["subject", "paradigm"], {"half": half, "side": side, "both": both}
    )
    even_weight = lambda end: (F.col(f"n2pc_AN{end}") + F.col(f"n2pc_NA{end}")) / 2
    return means.withColumns({f"n2pc{end}": even_weight(end) for end in ("", "_Odd", "_Even")})
