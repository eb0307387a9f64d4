"""Texts and plain definitions that the tests of the text operators share."""

import re

WORD = r"[^\x20\x09-\x0D]+"


def words(text):
    return re.findall(WORD, text or "")


def documents(spark, rows):
    """(doc_id, text) or (doc_id, text, lang, source) rows."""
    full = [(*r, None, None)[:4] for r in rows]
    return spark.createDataFrame(full, "doc_id BIGINT, text STRING, lang STRING, source STRING")


def sentence(n, start=0, stem="word"):
    return " ".join(f"{stem}{i}" for i in range(start, start + n))


def empty(spark):
    return documents(spark, [])
