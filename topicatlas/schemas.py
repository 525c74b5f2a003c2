"""Column layouts shared by the sources, operators and sinks.

Coordinates travel as integer micro-degrees (``lat_udeg``, ``lon_udeg``) so that
sums are exact whatever the order in which Spark adds them; degrees as doubles
are derived where a formula or a report needs them.
"""

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _strings(*names: str) -> list[StructField]:
    return [StructField(name, StringType()) for name in names]


# Values of the REVISION line, in order.
REVISION_COLUMNS = [
    "article_id", "rev_id", "article_title", "edit_ts", "username", "user_id",
]

# Further lines of a revision stanza: keyword in the file -> column name.
STANZA_FIELDS = {
    "CATEGORY": "categories",
    "IMAGE": "image",
    "MAIN": "main",
    "TALK": "talk",
    "USER": "user",
    "USER_TALK": "user_talk",
    "OTHER": "other",
    "EXTERNAL": "external",
    "TEMPLATE": "template",
    "COMMENT": "comment",
    "MINOR": "minor",
    "TEXTDATA": "textdata",
}

RAW_REVISION = StructType(_strings(*REVISION_COLUMNS, *STANZA_FIELDS.values()))

CLEAN_COLUMNS = [
    "article_id", "rev_id", "article_title", "user_id", "categories", "textdata",
]

EDIT = StructType(_strings(*CLEAN_COLUMNS) + [StructField("long_ip", LongType())])

LOCATION = StructType(
    [StructField("ip_from", LongType()), StructField("ip_to", LongType())]
    + _strings("country_code", "country_name", "region_name", "city_name")
    + [StructField("lat_udeg", LongType()), StructField("lon_udeg", LongType())]
)

EDIT_WITH_LOC = StructType(
    _strings("article_id", "rev_id", "article_title", "category", "textdata")
    + [StructField("long_ip", LongType())]
    + _strings("country_code", "country_name", "region_name", "city_name")
    + [StructField("lat_udeg", LongType()), StructField("lon_udeg", LongType())]
)

CATEGORY_IPS = StructType(
    [
        StructField("category", StringType()),
        StructField("class_ip", LongType()),
        StructField("n", LongType()),
    ]
)

CENTROID = StructType(
    [
        StructField("cluster", IntegerType(), False),
        StructField("lon", DoubleType(), False),
        StructField("lat", DoubleType(), False),
    ]
)

# What a run of updates starts from; k, seed and init are the same in all its rows.
RUN = StructType(
    [
        *CENTROID.fields,
        StructField("k", IntegerType(), False),
        StructField("seed", IntegerType(), False),
        StructField("init", StringType(), False),
    ]
)

ITERATION_LOG = StructType(
    [
        StructField("iteration", IntegerType(), False),
        StructField("cluster", IntegerType(), False),
        StructField("lon", DoubleType(), False),
        StructField("lat", DoubleType(), False),
        StructField("movement", DoubleType(), False),
    ]
)
