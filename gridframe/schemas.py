"""Logical schemas (StructTypes) and fixed values shared by all modules."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. These must equal the source data's conventions for results to
# line up; they are stated here once, in their natural order.
# ---------------------------------------------------------------------------
# Record (grid file) name pattern, Spark datetime syntax: 6-hourly records.
RECORD_NAME_PATTERN = "'pgbh02.gdas.'yyyyMMddHH'.grb2'"
DECODED_SUFFIX = ".nc"
# Archive name: one tar per period of a month, days 1-5, 6-10, 11-15, 16-20,
# 21-25 and 26 to month end (six periods per month).
ARCHIVE_PREFIX = "pgbh02.gdas."
ARCHIVE_SUFFIX = ".tar"
ARCHIVE_NAME_REGEX = r"^pgbh02\.gdas\.(\d{8})-(\d{8})\.tar$"
ARCHIVE_PERIOD_DAYS = 5
ARCHIVE_PERIODS_PER_MONTH = 6
# Variables extracted from every record, in vector order (26 surface fields,
# then 5 fields on pressure levels).
DEFAULT_VARIABLES = [
    "TCDC_P8_L234_GLL0_avg", "TCDC_P8_L224_GLL0_avg", "TCDC_P8_L214_GLL0_avg",
    "TCDC_P8_L200_GLL0_avg", "TCDC_P0_L244_GLL0", "CSDLF_P8_L1_GLL0_avg",
    "CSULF_P8_L8_GLL0_avg", "CSULF_P8_L1_GLL0_avg", "ULWRF_P8_L8_GLL0_avg",
    "ULWRF_P8_L1_GLL0_avg", "DLWRF_P8_L1_GLL0_avg", "ULWRF_P0_L1_GLL0",
    "DLWRF_P0_L1_GLL0", "CPRAT_P8_L1_GLL0_avg", "ACPCP_P8_L1_GLL0_acc",
    "NCPCP_P8_L1_GLL0_acc", "APCP_P8_L1_GLL0_acc", "PRATE_P8_L1_GLL0_avg",
    "CAPE_P0_2L108_GLL0", "CAPE_P0_L1_GLL0", "CIN_P0_2L108_GLL0", "CIN_P0_L1_GLL0",
    "PLI_P0_2L108_GLL0", "CWAT_P0_L200_GLL0", "PWAT_P0_L200_GLL0",
    "PWAT_P0_2L108_GLL0", "TMP_P0_L100_GLL0", "VVEL_P0_L100_GLL0",
    "VGRD_P0_L100_GLL0", "RH_P0_L100_GLL0", "SPFH_P0_L100_GLL0",
]
# ---------------------------------------------------------------------------

# Default number of floats per stored vector segment (4 KiB of payload).
DEFAULT_BLOCK_SIZE = 1024

FLOATS = T.ArrayType(T.FloatType(), containsNull=False)
DOUBLES = T.ArrayType(T.DoubleType(), containsNull=False)

# D1 file list
ARCHIVE_LIST = T.StructType([T.StructField("archive_name", T.StringType(), False)])

# D2 manifest: one row per regular entry of an archive
MANIFEST = T.StructType([
    T.StructField("archive_path", T.StringType(), False),
    T.StructField("entry_idx", T.IntegerType(), False),
    T.StructField("record_name", T.StringType(), True),
    T.StructField("size", T.LongType(), True),
    T.StructField("data_offset", T.LongType(), True),
])

# D4 gridded variable of one record
GRID_VAR = T.StructType([
    T.StructField("record_name", T.StringType(), False),
    T.StructField("var", T.StringType(), False),
    T.StructField("dims", T.ArrayType(T.IntegerType(), False), False),
    T.StructField("fill", T.FloatType(), True),
    T.StructField("values", FLOATS, False),
])

# D5 long-form cells
CELLS = T.StructType([
    T.StructField("record_name", T.StringType(), False),
    T.StructField("var", T.StringType(), False),
    T.StructField("level", T.IntegerType(), False),
    T.StructField("i", T.IntegerType(), False),
    T.StructField("j", T.IntegerType(), False),
    T.StructField("value", T.FloatType(), True),
    T.StructField("is_missing", T.BooleanType(), False),
])

# D12 variable layout (one row per variable level)
LAYOUT = T.StructType([
    T.StructField("var", T.StringType(), False),
    T.StructField("var_pos", T.IntegerType(), False),
    T.StructField("level", T.IntegerType(), False),
    T.StructField("n_lat", T.IntegerType(), False),
    T.StructField("n_lon", T.IntegerType(), False),
    T.StructField("offset", T.LongType(), False),
    T.StructField("length", T.LongType(), False),
])

# D6 record vector, logical and segmented (physical) forms
RECORD_VECTOR = T.StructType([
    T.StructField("record_name", T.StringType(), False),
    T.StructField("values", FLOATS, False),
])
RECORD_SEGMENT = T.StructType([
    T.StructField("record_name", T.StringType(), False),
    T.StructField("block_id", T.IntegerType(), False),
    T.StructField("values", FLOATS, False),
])

# D7 row of A
MATRIX_ROW = T.StructType([
    T.StructField("row_idx", T.LongType(), False),
    T.StructField("values", FLOATS, False),
])

# D10 column chunk of A: a row segment covering one block of records
MATRIX_ROW_CHUNK = T.StructType([
    T.StructField("row_idx", T.LongType(), False),
    T.StructField("rblock", T.IntegerType(), False),
    T.StructField("values", FLOATS, False),
])

# D8 column names
COLUMN_NAMES = T.StructType([
    T.StructField("col_idx", T.LongType(), False),
    T.StructField("record_name", T.StringType(), False),
    T.StructField("ts", T.TimestampType(), True),
])

# S14 quarantine
QUARANTINE = T.StructType([
    T.StructField("archive_path", T.StringType(), True),
    T.StructField("entry_idx", T.IntegerType(), True),
    T.StructField("record_name", T.StringType(), True),
    T.StructField("reason", T.StringType(), False),
])
