"""Row types of the library."""

from __future__ import annotations

from pyspark.sql import types as T

METADATA = T.StructType(
    [
        T.StructField("source_reliability", T.StringType()),
        T.StructField("source_category", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("word_count", T.IntegerType()),
        T.StructField("char_count", T.IntegerType()),
        T.StructField("is_ocr", T.BooleanType()),
        T.StructField("dimensions", T.ArrayType(T.IntegerType())),
        T.StructField("table_dimensions", T.ArrayType(T.IntegerType())),
        T.StructField("related_entities", T.ArrayType(T.StringType())),
    ]
)
CHUNK = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("document_name", T.StringType()),
        T.StructField("document_type", T.StringType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("section_title", T.StringType()),
        T.StructField("modality", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("media_path", T.StringType()),
        T.StructField("caption", T.StringType()),
        T.StructField("metadata", METADATA),
    ]
)
QUESTION = T.StructType([T.StructField(n, T.StringType()) for n in ("qid", "track", "question")])
