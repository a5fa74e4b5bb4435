"""Row type of sequencing reads and the constants of its domain."""

from __future__ import annotations

from pyspark.sql import types as T

READS = T.StructType(
    [
        T.StructField("read_id", T.LongType(), False),
        T.StructField("block_id", T.LongType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("seq", T.StringType(), False),
        T.StructField("qual", T.StringType(), False),
    ]
)

# Fixed values of the record and archive formats.
ALPHABET = "AGCTNRWSKMDVHBYXU.-"
QUALITY_OFFSET = 33
BLOCK_BYTES = 1_048_576
TAIL_QUALITY = 2
COUPLING_QUALITY = 7
COUPLED_BASE = 128
RLE_RATIO = 1.25
TRUNCATED_RATIO = 1.10
MAX_RUN = 255
TITLE_SEPARATORS = " ._,=:/-#"
MAX_TEXT_POSITIONS = 128
MAX_NUMERIC_SYMBOLS = 512
NUMERIC_RLE_RATIO = 1.25
MAX_NUMBER = 1 << 30
MAX_FIELDS = 255

DNA_SCHEMES = {"B2": 0, "HUFFMAN": 1, "NONE": 255}
QUALITY_SCHEMES = {"PLAIN": 0, "TRUNCATED": 1, "RLE": 2}
NUMERIC_SCHEMES = {"VALUE_VAR": 1, "VALUE_RLE": 2, "DELTA_VAR": 3, "DELTA_RLE": 4, "DELTA_CONST": 5}
