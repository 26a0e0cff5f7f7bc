"""Column contracts of the stored tables and files."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_text = T.StringType()
_list = T.ArrayType(T.StringType())

NEWS_DATA = _struct(
    published=T.TimestampNTZType(),
    headline=_text,
    summary=_text,
    link=_text,
    facebook_link=_text,
    facebook_page_name=_text,
    domain=_text,
    facebook_interactions=T.LongType(),
    source=_text,
)

NEWS_LABELS = _struct(link=_text, facebook_link=_text, themes=_list, indexes=_list, subindex=_text)

SNAPSHOTS = _struct(
    published=T.TimestampNTZType(),
    headline=_text,
    summary=_text,
    link=_text,
    domain=_text,
    facebook_interactions=T.LongType(),
    date_extracted=T.DateType(),
    suggested_labels=_text,
)

TRAINING = _struct(published=T.TimestampNTZType(), headline=_text, label=_text)

# Headers of a weekly scan file and the stored name of each.
SCAN_COLUMNS = {
    "Published": "published",
    "Headline": "headline",
    "Summary": "summary",
    "Link": "facebook_link",
    "Link URL": "link",
    "Facebook Page Name": "facebook_page_name",
    "Domain": "domain",
    "Facebook Interactions": "facebook_interactions",
}
SCAN_COUNT_ALIAS = "Total Interactions"

# Columns of an indexed-data file.
INDEXED_COLUMNS = ["link", "facebook_link", "themes", "indexes", "subindex"]

# Columns of a base training file.
TRAINING_COLUMNS = ["Published", "Headline", "Theme", "New Index"]

# Columns of a labelled-articles workbook.
LABELLED_COLUMNS = [
    "published",
    "headline",
    "summary",
    "link",
    "facebook_page_name",
    "domain",
    "facebook_interactions",
    "subindex",
    "source",
]
