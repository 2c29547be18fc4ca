import random
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=""):
    """Documents of (doc_id, text[, source]), optionally with more columns of clashing names."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    for name in filter(None, extra.split()):
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("clash"))
    return df


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


#: Column names that operators use inside, given to them as extra columns.
CLASHES = "key keys comp rep hub size bucket order spans kept votes score position salt number before row tokens extra block"
