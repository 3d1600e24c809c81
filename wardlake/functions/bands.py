"""Banding of whole numbers into labelled ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label -> greatest whole number in the band (None: no upper end).
AGE_BANDS = {"0-17": 17, "18-39": 39, "40-64": 64, "65+": None}
WAIT_BANDS = {"00-15": 15, "16-30": 30, "31-45": 45, "46+": None}
EXPERIENCE_BANDS = {"0-10": 10, "11-15": 15, "16+": None}


def band(value: Column, bands: dict[str, int | None]) -> Column:
    """Label of the first band the value fits in; NULL stays NULL.

    The lowest band has no lower end, so negative numbers land in it.
    """
    label = F.when(value.isNull(), F.lit(None).cast("string"))
    for name, greatest in bands.items():
        label = label.when(value <= greatest, name) if greatest is not None else label.otherwise(name)
    return label
