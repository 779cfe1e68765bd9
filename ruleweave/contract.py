"""The data contract: columns, domains, labels and schemas.

Everything here is a fixed value of the data model, shared by every job.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Feature columns in contract order, spelling as in the data.
FEATURES = (
    "SFH",
    "popUpWidnow",
    "SSLfinal_State",
    "Request_URL",
    "URL_of_Anchor",
    "web_traffic",
    "URL_Length",
    "age_of_domain",
    "having_IP_Address",
)
TARGET = "Result"
RECORD = (*FEATURES, TARGET)

# The shared domain used for training and matching, and the
# stricter per-feature domains used for data sets and live vectors.
SHARED_DOMAIN = (-1, 0, 1)
DOMAINS = {name: SHARED_DOMAIN for name in FEATURES}
DOMAINS["age_of_domain"] = (-1, 1)
DOMAINS["having_IP_Address"] = (0, 1)

# Target codes, their labels and the count columns per class.
LABELS = {-1: "Phishy", 0: "Suspicious", 1: "Legitimate"}
CLASSES = tuple(LABELS)
CLASS_COUNTS = {-1: "phishy", 0: "suspicious", 1: "legitimate"}

# History states and provider states.
PREDICTED = "predicted"
UNAVAILABLE = "feature_mapping_unavailable"
STATUSES = (PREDICTED, UNAVAILABLE)
VERIFIED = "verified"
UNVERIFIED = "mapping_unverified"
PROVIDER_STATES = ("provider_unavailable", "extraction_error")

LABELLED_SCHEMA = T.StructType(
    [T.StructField(name, T.IntegerType()) for name in RECORD]
)

HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("prediction", T.IntegerType()),
        T.StructField("label", T.StringType()),
        T.StructField("features", T.StringType()),
        T.StructField("prediction_status", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)


class ContractError(ValueError):
    """A table or record breaks the data contract.

    ``invalid`` holds all bad values as rows (column_name, value, row_count), if it is for those.
    """

    invalid = None
