"""Rows that every corpus operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# columns whose names operators use themselves
CLASH = "score double, fingerprint string, component_id long, spans string, tokens int, start int, length int, sequence_id long, media binary, block string, fp int, id string"


def edge_docs(spark):
    long_text = " ".join(f"word{i % 997} of {i}" for i in range(60_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank.", "en", "a", 64),
        (2, "The quick brown fox jumps over the lazy dog near the river bank.", "en", "a", 64),
        (2, "The quick brown fox jumps over the lazy dog near the river bank.", "en", "a", 64),
        (3, "", "en", "b", 0),
        (4, None, None, None, None),
        (5, long_text, "en", "a", len(long_text)),
        (6, "12345 !!! \t\n", "fr", None, 12),
        (None, "Un texte sans nom.", "fr", "c", 18),
        (7, "ééé ß 日本語 🙂 token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", None, "c", 60),
        (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, DOCS)
    names = [c.split() for c in CLASH.split(", ")]
    return df.selectExpr("*", *(f"cast(null as {kind}) as {name}" for name, kind in names))


def no_docs(spark):
    return edge_docs(spark).limit(0)
