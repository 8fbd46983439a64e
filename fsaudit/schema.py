"""The one fact table: a row per regular file."""

from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

#: Partition of the files that lie directly under the top directory.
ROOT_PARTITION = "__root__"

SCHEMA = StructType([StructField("path", StringType(), False), StructField("size", LongType(), False), StructField("atime", LongType(), False)])
#: With the partition as a string, so that names like 001 are not read as numbers.
SCHEMA_P = StructType([*SCHEMA.fields, StructField("partition", StringType(), False)])
#: With the directories of a packed index.
SCHEMA_B = StructType([*SCHEMA_P.fields, StructField("buckets", IntegerType(), False), StructField("bucket", IntegerType(), False)])
DAY = 86_400
