from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def docs_of(spark, rows, **extra):
    """documents with the given (doc_id, text) rows."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC)
