"""Small documents for the tests."""

import hashlib

SCHEMA = "doc_id long, text string"
ODD = [None, "", " ", "\n", "a", "a\x00b", "é" * 300, "word " * 400]


def documents(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
