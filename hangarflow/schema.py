"""Column names and schemas of the tables this package reads and writes."""

from pyspark.sql import types as T

# --- fixed values: column names of the work-order interface -----------------
COLUMN_MAPPING = {
    "ATA": "ATA04_Entered",
    "W/O Description": "Defect_Text",
    "W/O Action": "Rectification_Text",
    "Type": "WO_Type",
    "A/C": "AC_Registration",
    "Issued": "Open_Date",
    "Closed": "Close_Date",
    "ATA 04 Corrected": "ATA04_Final",
}
REQUIRED_COLUMNS = [
    "ATA",
    "W/O Description",
    "W/O Action",
    "Type",
    "A/C",
    "Issued",
    "Closed",
]
RESULT_COLUMNS = [
    "ATA04_Entered",
    "Defect_Text",
    "Rectification_Text",
    "WO_Type",
    "AC_Registration",
    "Open_Date",
    "Close_Date",
    "Is_Technical_Defect",
    "Non_Defect_Reason",
    "ATA04_From_Cited",
    "Cited_Manual",
    "Cited_Task",
    "Cited_Exists",
    "ATA04_Derived",
    "Derived_Task",
    "Derived_DocType",
    "Derived_Score",
    "Evidence_Snippet",
    "Evidence_Source",
    "Decision",
    "ATA04_Final",
    "Confidence",
    "Reason",
]
DECISIONS = ["CONFIRM", "CORRECT", "REVIEW", "NON_DEFECT"]
MANUAL_TYPES = ["TSM", "FIM", "AMM"]
# --- end of fixed values -----------------------------------------------------

WORK_ORDER = T.StructType(
    [T.StructField("WO_Number", T.StringType())]
    + [T.StructField(name, T.StringType()) for name in REQUIRED_COLUMNS]
)

REGISTRY = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "manual_type",
            "ata04",
            "task_number",
            "chapter",
            "section",
            "subject",
            "subsection1",
            "subsection2",
            "title",
            "filename",
        )
    ]
    + [
        T.StructField("is_active", T.BooleanType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

CHUNK = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("manual_type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("ata04", T.StringType()),
        T.StructField("task_number", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("chunk_type", T.StringType()),
    ]
)

ELEMENT = T.StructType(
    [
        T.StructField("pos", T.IntegerType()),
        T.StructField("last", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("first", T.IntegerType()),
        T.StructField("count", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("caption", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    ]
)
