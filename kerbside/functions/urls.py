"""Sources, names and texts that are parsed: URLs, file names, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where live videos are watched; fixed value.
VIDEO_URL = r"^https?://(www\.)?(youtube\.com/watch|youtu\.be/|youtube\.com/live/)"
SITE_ID = r"^[a-zA-Z0-9_-]+$"


def kind(source: Column) -> Column:
    return F.when(source.rlike(VIDEO_URL), "video").when(source.rlike(r"^https?://"), "stream").otherwise("file")


def leaf(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/?#]+)/?(?:[?#].*)?$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(leaf(path), r"\.[^.]*$", "")


def valid_site(site_id: Column) -> Column:
    return site_id.rlike(SITE_ID)


def megabytes(text: Column) -> Column:
    """``1.5GiB``, ``200MiB`` and the like."""
    number = F.regexp_extract(text, r"([0-9.]+)", 1).try_cast("double")
    return F.when(text.contains("GiB"), number * 1024).when(text.contains("KiB"), number / 1024).otherwise(number)


def percent(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "%", "")).try_cast("double")
