"""JSON export of upcoming listings for outside curation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from playbill.operators.views import export_header


def write_export(export: DataFrame, path: str, as_of: dt.date) -> None:
    """Listings as JSON lines under ``events``, their count under ``header``."""
    export.write.mode("overwrite").json(f"{path}/events")
    export_header(export, as_of).write.mode("overwrite").json(f"{path}/header")
