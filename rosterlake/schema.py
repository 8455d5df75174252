"""Column sets and types of the roster store and its projections."""

from pyspark.sql import types as T

KEY = ("normalized_name", "district", "stream")

_strings = T.ArrayType(T.StringType())

STORE_SCHEMA = T.StructType([
    T.StructField("college_name", T.StringType()),
    T.StructField("normalized_name", T.StringType()),
    T.StructField("district", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("stream", T.StringType()),
    T.StructField("affiliation", T.StringType()),
    T.StructField("website", T.StringType()),
    T.StructField("placement_officer_name", T.StringType()),
    T.StructField("placement_email", T.StringType()),
    T.StructField("placement_phone", T.StringType()),
    T.StructField("backup_emails_found", _strings),
    T.StructField("backup_phones_found", _strings),
    T.StructField("fallback_contact_email", T.StringType()),
    T.StructField("fallback_contact_phone", T.StringType()),
    T.StructField("confidence_score", T.IntegerType()),
    T.StructField("source_urls", _strings),
    T.StructField("email_verified", T.BooleanType()),
    T.StructField("last_scraped", T.TimestampType()),
    T.StructField("status", T.StringType()),
    T.StructField("outreach_status", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

STORE_COLUMNS = tuple(f.name for f in STORE_SCHEMA)

#: A record on its way into the store, before the key is derived.
RECORD_COLUMNS = tuple(
    c for c in STORE_COLUMNS
    if c not in ("normalized_name", "outreach_status", "created_at", "updated_at")
)

#: Upsert rules per column.
FILL_COLUMNS = (
    "affiliation", "website", "placement_officer_name", "placement_email",
    "placement_phone", "fallback_contact_email", "fallback_contact_phone",
)
OVERWRITE_COLUMNS = (
    "college_name", "backup_emails_found", "backup_phones_found", "source_urls",
    "email_verified", "last_scraped", "status",
)
LIST_COLUMNS = ("backup_emails_found", "backup_phones_found", "source_urls")

MARKETING_COLUMNS = (
    "college_name", "state", "stream", "affiliation", "website", "email", "phone",
    "all_emails_found", "all_phones_found", "outreach_status",
)
#: Columns that must not leave the store through a marketing output.
INTERNAL_ONLY = ("status", "last_scraped", "confidence_score", "id", "source_urls", "email_verified")

SORTABLE = (
    "college_name", "state", "stream", "district", "status", "outreach_status",
    "confidence_score", "last_scraped", "created_at",
)
EDITABLE = (
    "college_name", "affiliation", "website", "placement_officer_name", "placement_email",
    "placement_phone", "fallback_contact_email", "fallback_contact_phone", "outreach_status",
)

EXPORT_LABELS = {
    "college_name": "College Name",
    "state": "State",
    "stream": "Stream",
    "affiliation": "Affiliation",
    "website": "Website",
    "email": "Email",
    "phone": "Phone",
    "all_emails_found": "All Emails Found",
    "all_phones_found": "All Phones Found",
    "outreach_status": "Outreach Status",
}

SEED_SCHEMA = T.StructType([
    T.StructField("college_name", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("stream", T.StringType()),
    T.StructField("district", T.StringType()),
    T.StructField("address", T.StringType()),
    T.StructField("phone", T.StringType()),
    T.StructField("website", T.StringType()),
    T.StructField("affiliation", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("source_urls", _strings),
])
SEED_COLUMNS = tuple(f.name for f in SEED_SCHEMA)

RUN_EVENT_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("at", T.TimestampType()),
    T.StructField("state", T.StringType()),
    T.StructField("stream", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("total_colleges", T.LongType()),
    T.StructField("processed", T.LongType()),
    T.StructField("succeeded", T.LongType()),
    T.StructField("failed", T.LongType()),
    T.StructField("notes", T.StringType()),
])
