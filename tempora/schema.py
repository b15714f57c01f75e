"""Names and schemas of the event model."""

from pyspark.sql import types as T

# Fixed values of the data model.
SPECIAL_TOKENS = {"[PAD]": 0, "[CLS]": 1, "[SEP]": 2, "[UNK]": 3, "[MASK]": 4}
BIRTH, DEATH, ADMISSION, DISCHARGE = "DOB", "DOD", "ADMISSION", "DISCHARGE"
BACKGROUND_PREFIX, ADMISSION_PREFIX, VALUE_PREFIX = "BG_", "ADM_", "VAL_"
CLS_SHIFT, SEP_SHIFT = -0.001, 0.001
GAP_HOURS = 48.0
DAYS_PER_YEAR = 365.25

EVENTS = T.StructType(
    [
        T.StructField("subject_id", T.LongType()),
        T.StructField("time", T.TimestampNTZType()),
        T.StructField("code", T.StringType()),
        T.StructField("numeric_value", T.DoubleType()),
        T.StructField("row_id", T.LongType()),
    ]
)
FEATURES = T.StructType(
    [
        T.StructField("subject_id", T.LongType()),
        T.StructField("age", T.DoubleType()),
        T.StructField("abspos", T.DoubleType()),
        T.StructField("segment", T.IntegerType()),
        T.StructField("code", T.StringType()),
        T.StructField("seq", T.LongType()),
    ]
)
SEQUENCE_EVENT = "struct<code:int,abspos:double,segment:int,age:double>"
