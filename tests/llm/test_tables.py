"""Operators over tables: raked mixing, dated URL lists, WARC archives; and the pipeline."""

import base64
import datetime as dt
import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from text_tables import documents, empty, sentence
from pyspark.sql import functions as F

from lumaspark.llm import ecoc_language, fertility, mixing as X, pigeonhole, secrets, url_lists
from lumaspark.llm import url_lists as U
from lumaspark.llm import warc as A


def raked(tokens, targets, sweeps=500):
    """Plain iterative proportional fitting of a three-way table."""
    m = tokens.astype(float) / tokens.sum()
    for _ in range(sweeps):
        for axis, want in enumerate(targets):
            have = m.sum(axis=tuple(a for a in range(3) if a != axis), keepdims=True)
            m = m * np.divide(want.reshape(have.shape), have, out=np.zeros_like(have), where=have > 0)
    return m / (tokens / tokens.sum())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    rows = []
    for i in range(400):
        source = rng.choice("aaaaaabcd")
        lang = rng.choice(["en", "en", "de", None]) if source != "b" else "de"
        rows.append((i, sentence(rng.randrange(1, 60)) + (" license code" if rng.random() < 0.3 else ""), lang, source))
    return rows


def test_raking_equals_plain_fitting(spark, corpus):
    rows = X.mix(documents(spark, corpus).withColumn("weight", F.lit("old"))).collect()
    assert len(rows) == len(corpus)
    names = [sorted({getattr(r, c) if getattr(r, c) is not None else X.NONE for r in rows}) for c in ("source", "lang", "topic")]
    table = np.zeros([len(n) for n in names])
    at = lambda r: tuple(n.index(v if v is not None else X.NONE) for n, v in zip(names, (r.source, r.lang, r.topic), strict=True))
    for r in rows:
        table[at(r)] += r.tokens
    targets = []
    for axis, c in enumerate(("source", "lang", "topic")):
        t = table.sum(axis=tuple(a for a in range(3) if a != axis)) ** X.TEMPER[c]
        targets.append(t / t.sum())
    want = raked(table, targets)
    assert [r.weight for r in rows] == pytest.approx([want[at(r)] for r in rows], rel=1e-6)
    assert all(r.copies in (int(r.expected), int(r.expected) + 1) for r in rows)
    drawn, expected = sum(r.copies for r in rows), sum(r.expected for r in rows)
    assert abs(drawn - expected) < 4 * np.sqrt(len(rows))


def test_given_targets_and_odd_rows(spark):
    rows = [(i, sentence(10), "en" if i % 2 else "fr", "big") for i in range(50)] + [(100, sentence(10), "xx", "small"), (101, None, "en", None), (102, "", None, "big"), (103, sentence(10), "en", "small"), (103, sentence(10), "en", "small")]
    mixed = X.mix(documents(spark, rows), lang_targets={"en": 0.5, "fr": 0.3, X.OTHER: 0.2}, source_targets={"big": 0.5, "small": 0.5})
    got = mixed.collect()
    mass = {}
    for r in got:
        mass[r.lang if r.lang in ("en", "fr") else "rest"] = mass.get(r.lang if r.lang in ("en", "fr") else "rest", 0) + r.weight * r.tokens
    total = sum(mass.values())
    assert {k: round(v / total, 6) for k, v in mass.items()} == {"en": 0.5, "fr": 0.3, "rest": 0.2}
    twice = [r for r in got if r.doc_id == 103]
    assert len(twice) == 2 and twice[0].copies == twice[1].copies
    assert next(r for r in got if r.doc_id == 101).copies == 0
    assert X.mix(empty(spark)).count() == 0


def test_contradicting_targets_are_told(spark):
    """Each source holds one language: no weights give both half of the sources and nine tenths of a language."""
    docs = documents(spark, [(i, sentence(10), "en" if i % 2 else "fr", f"s{i % 2}") for i in range(20)]).withColumn("by", F.lit(1)).withColumn("factor", F.lit("x")).withColumn("_source", F.lit(2))
    targets = {"source_targets": {"s0": 0.5, "s1": 0.5}, "lang_targets": {"en": 0.9, "fr": 0.1}}
    with pytest.raises(ValueError, match="contradict"):
        X.mix(docs, **targets)
    rows = X.mix(docs, most_error=1.0, **targets).collect()
    assert rows[0].fit_error == pytest.approx(0.4) and {(r.by, r.factor, r._source) for r in rows} == {(1, "x", 2)}
    assert X.mix(docs).first().fit_error < 1e-6


def test_columns_named_like_those_of_the_operators_stay(spark):
    names = ["_row", "_day", "_keys", "_kept", "found", "leaks_", "_m", "_group", "key", "stop"]
    own = {n: F.lit(i) for i, n in enumerate(names)}
    want = tuple(range(len(names)))
    captures = spark.createDataFrame([("http://a.b/c", DAY)], "url STRING, day DATE").withColumns({n: c for n, c in own.items() if n != "day"})
    entries = spark.createDataFrame([("l", "a.b", DAY, 0, "add")], "list STRING, key STRING, day DATE, seq INT, kind STRING")
    rows = [url_lists.evaluate(captures, entries)]
    docs = documents(spark, [(1, "some words of a text " * 30, "en", "s")]).withColumns(own)
    rows.append(fertility.rules(docs))
    rows.append(ecoc_language.identify(docs, ecoc_language.train(docs)))
    rows.append(pigeonhole.find(docs, spark.createDataFrame([(1, "some words of a text some words of a text")], "item_id BIGINT, text STRING"), block_chars=10))
    rows.append(secrets.scan(docs))
    for df in rows:
        assert tuple(df.select(*names).first()) == want


DAY = dt.date(2023, 1, 1)


def test_url_lists_equal_a_loop(spark):
    rng = random.Random(2)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "other.org", "localhost"]
    keys = [*hosts, "com", "other.org/x", "other.org/x/y", "org"]
    entries = [(rng.choice(["bad", "worse", "allow"]), rng.choice(keys), DAY + dt.timedelta(rng.randrange(300)), rng.randrange(3), rng.choice(["add", "remove"])) for _ in range(160)]
    entries += [entries[0], (None, "com", DAY, 0, "add"), ("bad", None, DAY, 0, "add"), ("bad", "com", None, 0, "add"), ("bad", "com", DAY, None, None)]
    captures = [(i, rng.choice(["http://", "HTTPS://u:p@", "ftp://"]) + rng.choice(hosts) + rng.choice(["", ":80", "."]) + rng.choice(["", "/", "/x", "/x/y/z?q#f", "//x", "/X"]), DAY + dt.timedelta(rng.randrange(-20, 330))) for i in range(400)]
    captures += [(900, None, DAY), (901, "no url", DAY), (902, "http://example.com", None), (903, "http:///x", DAY), (0, *captures[0][1:])]

    def active(key, lst, day):
        told = [(d, s, k == "remove") for a, b, d, s, k in entries if a == lst and b == key and d is not None and d <= day and k]
        return bool(told) and not max(told)[2]

    import re

    for block in (U.BLOCK_DAYS, 7):
        got = U.evaluate(
            spark.createDataFrame(captures, "id BIGINT, url STRING, day DATE").withColumn("verdict", F.lit(0)),
            spark.createDataFrame(entries, "list STRING, key STRING, day DATE, seq INT, kind STRING"), block_days=block,
        ).collect()
        assert len(got) == len(captures)
        for r in got:
            m = re.match(r"(?i)[a-z]+://(?:[^/?#@]*@)?([^/:?#]*)(?::\d+)?([^?#]*)", r.url or "")
            host = m[1].lower().removesuffix(".") if m else ""
            labels, path = host.split("."), [s for s in (m[2] if m else "").split("/") if s][:2]
            mine = [".".join(labels[i:]) for i in range(max(1, len(labels) - 1))] + [host + "/" + "/".join(path[: i + 1]) for i in range(len(path))] if host else []
            hits = sorted(f"{a}:{k}" for k in mine for a in ("bad", "worse", "allow") if r.day and active(k, a, r.day))
            assert (r.n_active, r.active) == (len(hits), ",".join(hits)), r
            best = max(((len(h.partition(":")[2]), h.startswith("allow:")) for h in hits), default=None)
            assert r.verdict == ("none" if best is None else "allow" if best[1] else "block")


def test_url_lists_without_entries_or_captures(spark):
    none = spark.createDataFrame([], "list STRING, key STRING, day DATE, seq INT, kind STRING")
    one = spark.createDataFrame([(1, "http://a.b", DAY)], "id BIGINT, url STRING, day DATE")
    assert U.evaluate(one, none).first().verdict == "none"
    assert U.evaluate(one.limit(0), none).count() == 0


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")


PAGES = [(i, f"http://h/{i}", f"<p>{i % 7}</p>" * (i % 5)) for i in range(60)] + [
    (-1, None, None), (-2, "u", ""), (-3, "http://x y/\n", "é" * 1000), (-4, "a", "é" * 1000), (-4, "a", "é" * 1000), (None, "a", "é" * 1000), (None, None, "q"), (500, "a", "\r\n\r\nWARC/1.1\r\n" * 50_000),
]


@pytest.mark.parametrize(("least", "size"), [(0, 1 << 26), (10, 2000)])
def test_archives_come_back_whole(spark, least, size):
    given = [*PAGES, (501, "http://long/" + "u" * 5_000_000, "long url")]
    archives = A.write(pages(spark, given), least_bytes=least, archive_bytes=size)
    normal = A.normalise(archives)
    got = sorted(map(tuple, A.read(A.index(normal)).collect()), key=str)
    first = {}
    for i, _, h in given:
        if i is not None and len((h or "").encode()) >= least:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in given:
        p = (h or "").encode()
        f = first.get(h or "")
        revisit = f is not None and i != f
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    assert got == sorted(want, key=str)
    assert normal.agg(F.sum("records")).first()[0] == len(given)


def test_normalised_archive_holds_the_same_records(tmp_path):
    records = [A.record(i, u, (h or "").encode(), None) for i, u, h in PAGES]
    source, target = str(tmp_path / "whole.warc.gz"), str(tmp_path / "out" / "records.warc.gz")
    with open(source, "wb") as f:  # one stream, then a second member
        f.write(gzip.compress(b"".join(records[:40])) + gzip.compress(b"".join(records[40:])))
    assert A.normalise_stream(source, target) == len(records)
    data = open(target, "rb").read()
    assert gzip.decompress(data) == b"".join(records)
    for line, record in zip(open(target + ".idx").read().splitlines(), records, strict=True):
        at, length, _, _ = line.split("\t")
        assert zlib.decompress(data[int(at) : int(at) + int(length)], 31) == record


def test_broken_archives_fail(tmp_path):
    whole = gzip.compress(b"".join(A.record(i, "u", b"x" * 5000, None) for i in range(50)))
    for name, data in (("cut", whole[: len(whole) // 2]), ("not", gzip.compress(b"hello\r\n\r\n")), ("short", gzip.compress(A.record(1, "u", b"abc", None)[:-6]))):
        path = str(tmp_path / f"{name}.gz")
        with open(path, "wb") as f:
            f.write(data)
        with pytest.raises((ValueError, zlib.error)):
            A.normalise_stream(path, str(tmp_path / f"{name}.out.gz"))


def test_no_pages(spark):
    assert A.read(A.index(A.normalise(A.write(pages(spark, []))))).count() == 0


def test_pipeline_stages(spark, small, tmp_path):
    import corpus_pipeline as C

    assert [name for name, _ in C.STAGES] == ["language_id", "near_duplicates", "decontaminate", "mask_secrets", "mix"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = []
    for name, stage in C.STAGES:
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.count())
        if name != "mix":
            assert tuple(docs.columns) == C.COLUMNS
    assert seen[0] >= seen[1] >= seen[2] == seen[3] >= seen[4] > 0
    assert docs.where(F.col("text").rlike("AKIA[A-Z0-9]{16}")).isEmpty()


def test_pipeline_of_odd_documents(spark, small):
    import corpus_pipeline as C

    rows = [(1, None, "en", "s"), (2, "", "en", "s"), (None, sentence(30, stem="abc"), "en", None), (3, sentence(30, stem="xyz"), None, "s"), (3, sentence(30, stem="xyz"), None, "s"), (4, sentence(30, stem="xyz"), "en", "s")]
    docs = documents(spark, rows).withColumn("n_chars", F.lit(None).cast("bigint")).withColumn("leaks", F.lit(1))
    for _, stage in C.STAGES:
        docs = stage(spark, docs, small)
        docs.count()
    nothing = empty(spark).withColumn("n_chars", F.lit(0).cast("bigint"))
    for _, stage in C.STAGES:
        nothing = stage(spark, nothing, small)
        assert nothing.count() == 0
