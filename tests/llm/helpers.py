from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOCS = T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("source", "string").add("n_chars", "long")


def documents(spark, texts, source="s", extra=None):
    """Rows (id, text) as documents, with a column that clashes with results where ``extra`` names one."""
    rows = [(i, t, "en", source, len(t or "")) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("mine") for c in extra})
    return df


class Sets:
    """Union-find for brute-force components."""

    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a
