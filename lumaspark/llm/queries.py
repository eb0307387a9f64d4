"""The queries over the driver's tables: one per operator, with SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bayes_join, debruijn, ecoc_language, fertility, inner_product, maxent, mixing, pigeonhole, ranked_search, secrets, spelling, url_lists, warc
from .tasks import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its raked weight, expected and drawn copies."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "topic", "tokens", "weight", "expected", "copies", "fit_error")


# The pages have no fetch time and there is no list: both come from the pages by formula. A key's md5 decides its lists and days.
FIRST_DAY, DAYS = "2022-01-01", 730
LISTS = (("adult", 5, 0), ("malware", 7, 1), ("allow", 11, 2))  # list, a key is on it where its number modulo this is that


def dated_entries(pages: DataFrame) -> DataFrame:
    """Entries for the hosts, domains and path prefixes of the pages: put on a list, taken off, and half of them put on again."""
    keys = pages.select(F.explode(url_lists.keys_of(F.col("url"))).alias("key")).distinct()
    number = F.conv(F.substring(F.md5(F.col("key").cast("binary")), 1, 6), 16, 10).cast("int")
    keys = keys.withColumn("x", number)
    member = F.explode(F.array(*[F.struct(F.lit(n).alias("list"), (F.col("x") % m == r).alias("on")) for n, m, r in LISTS]))
    listed = keys.select("key", "x", member.alias("m")).where("m.on").select("key", "x", "m.list")
    start = F.col("x") % 500
    changes = F.explode(F.array(
        F.struct(start.alias("n"), F.lit("add").alias("kind")), F.struct((start + 30 + F.col("x") % 90).alias("n"), F.lit("remove").alias("kind")),
        F.struct((start + 200).alias("n"), F.when(F.col("x") % 2 == 0, "add").otherwise("remove").alias("kind")),
    ))
    return listed.select("list", "key", changes.alias("c")).select("list", "key", F.date_add(F.lit(FIRST_DAY).cast("date"), F.col("c.n")).alias("day"), F.lit(0).alias("seq"), "c.kind")


def op2_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("page_id") * 37 % DAYS).cast("int"))
    return url_lists.evaluate(pages.withColumn("day", day), dated_entries(pages)).drop("url")


OP2_SQL = """
WITH captures AS (
  SELECT page_id, DATE '2022-01-01' + CAST(page_id * 37 % 730 AS INTEGER) AS day,
    nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1), '\\.$', ''), '') AS host,
    [s for s in string_split(regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#]*/([^?#]*)', 1), '/') if s <> ''][1:2] AS parts
  FROM pages
), named AS (
  SELECT *, list_concat(
    [array_to_string(string_split(host, '.')[i:], '.') for i in range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1)],
    [host || '/' || array_to_string(parts[1:i], '/') for i in range(1, len(parts) + 1)]) AS keys
  FROM captures
), asked AS (SELECT page_id, day, unnest(keys) AS key FROM named),
numbered AS (SELECT DISTINCT key, CAST(('0x' || substr(md5(key), 1, 6)) AS INTEGER) AS x FROM asked),
listed AS (
  SELECT key, x, list FROM numbered, (VALUES ('adult', 5, 0), ('malware', 7, 1), ('allow', 11, 2)) AS l(list, m, r) WHERE x % m = r
), entries AS (
  SELECT list, key, DATE '2022-01-01' + x % 500 AS day, 'add' AS kind FROM listed
  UNION ALL SELECT list, key, DATE '2022-01-01' + (x % 500 + 30 + x % 90), 'remove' FROM listed
  UNION ALL SELECT list, key, DATE '2022-01-01' + (x % 500 + 200), CASE WHEN x % 2 = 0 THEN 'add' ELSE 'remove' END FROM listed
), valid AS (
  SELECT list, key, kind, day AS start, lead(day) OVER (PARTITION BY list, key ORDER BY day) AS stop FROM entries
), hits AS (
  SELECT a.page_id, v.list, a.key FROM asked a JOIN valid v ON a.key = v.key AND v.kind = 'add' AND v.start <= a.day AND (v.stop IS NULL OR a.day < v.stop)
), found AS (
  SELECT page_id, count(*) AS n, string_agg(list || ':' || key, ',' ORDER BY list || ':' || key) AS active,
    max(length(key) * 2 + CASE WHEN list = 'allow' THEN 1 ELSE 0 END) AS best
  FROM hits GROUP BY page_id
)
SELECT c.page_id, c.day, c.host, coalesce(f.n, 0) AS n_active, coalesce(f.active, '') AS active,
  CASE WHEN f.best IS NULL THEN 'none' WHEN f.best % 2 = 1 THEN 'allow' ELSE 'block' END AS verdict
FROM captures c LEFT JOIN found f ON c.page_id = f.page_id
"""


def op3_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = fertility.rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_tokens", "piece_chars", "byte_chars", "fallback", "entropy", "reasons",
    )


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["rank"] == secrets.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.shown(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        secrets.shown(F.col("all_spans")).alias("spans"),
    )


def found_sql(pattern: str, group: int, table: str = "d") -> str:
    """Start, text and measured group of each match of a pattern in a table (doc_id, t)."""
    q = pattern.replace("'", "''")
    return f"""
      SELECT doc_id, m[i] AS v, g[i] AS value, CAST(list_sum(gaps[1:i]) + coalesce(list_sum(sizes[1:i - 1]), 0) AS BIGINT) AS start FROM (
        SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
          SELECT doc_id, regexp_extract_all(t, '{q}', 0) AS m, regexp_extract_all(t, '{q}', {group}) AS g, [length(x) for x in string_split_regex(t, '{q}')] AS gaps,
                 [length(x) for x in regexp_extract_all(t, '{q}', 0)] AS sizes FROM {table} WHERE regexp_matches(t, '{q}')))"""


def secrets_sql() -> str:
    base = " UNION ALL ".join(
        f"SELECT doc_id, start, {secrets.KINDS.index(kind)} AS rank, start + length(v) AS stop FROM ({found_sql(pattern, group)}) WHERE length(value) >= {least}"
        for kind, pattern, group, least in secrets.PATTERNS
    )
    w = secrets.WINDOW
    whole = [p for p in secrets.ALLOWED if p.removeprefix("(?i)").startswith("^")]
    allowed = " AND ".join(f"NOT regexp_matches(v, '{p}')" for p in whole)
    quiet = " UNION ALL ".join(f"SELECT doc_id, start, start + length(v) AS stop FROM ({found_sql(p, 0, 'named')})" for p in secrets.ALLOWED if p not in whole)
    rank = {k: secrets.THOROUGH_KINDS.index(k) for k in secrets.LEAST_BITS}
    most = {k: secrets.most_weight(bits) for k, bits in secrets.LEAST_BITS.items()}
    names = "[" + ", ".join(f"'{k}'" for k in secrets.THOROUGH_KINDS) + "]"
    shown = f"{names}[rank + 1] || ':' || start || ':' || stop"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS MATERIALIZED ({base}),
candidates AS MATERIALIZED (SELECT doc_id, start, v FROM ({found_sql(secrets.CANDIDATE, 0)}) WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND {allowed}),
named AS MATERIALIZED (SELECT doc_id || ':' || start AS doc_id, v AS t FROM candidates),
quiet AS MATERIALIZED ({quiet}),
windows AS (
  SELECT doc_id, start AS c, start + i AS start, substr(v, CAST(i AS INTEGER) + 1, {w}) AS z FROM (SELECT *, unnest(range(length(v) - {w} + 1)) AS i FROM candidates) x
  WHERE NOT EXISTS (SELECT 1 FROM quiet q WHERE q.doc_id = x.doc_id || ':' || x.start AND q.start < x.i + {w} AND q.stop > x.i)
),
counted AS (SELECT doc_id, c, start, z, count(*) AS n FROM (SELECT *, unnest(string_split(z, '')) AS ch FROM windows) GROUP BY doc_id, c, start, z, ch),
summed AS (SELECT doc_id, c, start, z, CAST(sum(({secrets.weights()})[n + 1]) AS BIGINT) AS total FROM counted GROUP BY doc_id, c, start, z),
kinds AS (
  SELECT doc_id, c, start, CASE
    WHEN NOT regexp_matches(z, '[0-9]') THEN NULL
    WHEN regexp_full_match(z, '[0-9A-Fa-f]+') THEN CASE WHEN regexp_matches(z, '[A-Fa-f]') AND total <= {most["entropy_hex"]} THEN {rank["entropy_hex"]} END
    WHEN regexp_matches(z, '[A-Z]') AND regexp_matches(z, '[a-z]') THEN CASE WHEN total <= {most["entropy_mixed"]} THEN {rank["entropy_mixed"]} END
    WHEN regexp_full_match(z, '[0-9a-z]+') AND total <= {most["entropy_lower"]} THEN {rank["entropy_lower"]}
    WHEN regexp_full_match(z, '[0-9A-Z]+') AND total <= {most["entropy_upper"]} THEN {rank["entropy_upper"]} END AS rank
  FROM summed
), marked AS (
  SELECT *, CASE WHEN start <= lag(start) OVER p + {w} THEN 0 ELSE 1 END AS new FROM kinds WHERE rank IS NOT NULL WINDOW p AS (PARTITION BY doc_id, c, rank ORDER BY start)
), islands AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id, c, rank ORDER BY start) AS part FROM marked
), entropy AS (
  SELECT doc_id, min(start) AS start, rank, max(start) + {w} AS stop FROM islands GROUP BY doc_id, c, rank, part
), every AS (
  SELECT doc_id, start, rank, stop FROM base
  UNION ALL SELECT doc_id, start, rank, stop FROM entropy e WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = e.doc_id AND b.start <= e.start AND b.stop >= e.stop)
), told AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    string_agg({shown}, ',' ORDER BY start, rank, stop) FILTER (rank < 3) AS base, string_agg({shown}, ',' ORDER BY start, rank, stop) AS spans
  FROM every GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told ON d.doc_id = told.doc_id
"""


HELD_OUT_FOLDS, SCORED_FOLD = 5, 1


def op5_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = ecoc_language.held_out(F.col("doc_id"), HELD_OUT_FOLDS, SCORED_FOLD)
    return maxent.score(table(spark, sf_dir, "documents").select("doc_id", "text"), held)


def op6_bayes_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bayes_join.join(table(spark, sf_dir, "documents"))


def op7_pigeonhole_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items it holds: their ids, the least distance, and all spans."""
    found = pigeonhole.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size("leaks").cast("long").alias("n_items"), F.sort_array(F.transform("leaks", lambda x: x["item_id"])).alias("item_ids"),
        F.array_min(F.transform("leaks", lambda x: x["distance"])).cast("long").alias("distance"),
        F.array_join(F.transform(F.array_sort(F.transform("leaks", lambda x: F.struct(x["item_id"], x["start"], x["stop"]))), lambda x: F.concat_ws(":", x["item_id"], x["start"], x["stop"])), ",").alias("spans"),
    )


def op8_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = debruijn.remove(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as whole-file streams, normalised, and read back by the sidecars."""
    archives = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(warc.index(warc.normalise(archives))).withColumnRenamed("id", "page_id")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, [w for w in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if w <> ''] AS words FROM documents),
windows AS MATERIALIZED (SELECT doc_id, i, array_to_string(words[i + 1:i + 20], ' ') AS h FROM (SELECT doc_id, words, unnest(range(len(words) - 19)) AS i FROM d)),
firsts AS MATERIALIZED (SELECT h, min((doc_id, i)) AS first FROM windows GROUP BY h),
covered AS (SELECT DISTINCT doc_id, pos FROM (SELECT w.doc_id, unnest(range(w.i, w.i + 20)) AS pos FROM windows w JOIN firsts f ON w.h = f.h WHERE (w.doc_id, w.i) <> f.first)),
gone AS (SELECT doc_id, list(pos) AS gone FROM covered GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS text FROM (SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS pos FROM d) p
  WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.doc_id = p.doc_id AND c.pos = p.pos) GROUP BY doc_id
)
SELECT d.doc_id, len(d.words) AS n_words, coalesce(len(g.gone), 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN gone g ON d.doc_id = g.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


OP9_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first, sha1(coalesce(html, '')) AS hex FROM pages
)
SELECT page_id, strlen(body) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST(('0x' || substr(hex, i // 4 * 5 + 1, 5)) AS BIGINT) >> (15 - i % 4 * 5)) & 31 AS INTEGER) + 1, 1)
    for i in range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p
"""


LANGUAGE_FOLDS, LANGUAGE_HELD_OUT = 4, 2


def op10_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = ecoc_language.held_out(F.col("doc_id"), LANGUAGE_FOLDS, LANGUAGE_HELD_OUT)
    model = ecoc_language.train(docs.where(~held))
    return ecoc_language.identify(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS doc, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE doc_id IS NOT NULL
), d AS MATERIALIZED (SELECT doc_id, doc, terms, len(terms) AS n FROM words WHERE len(terms) > 0),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
held AS MATERIALIZED (SELECT doc_id, doc, n, term, count(*) AS tf FROM (SELECT doc_id, doc, n, unnest(terms) AS term FROM d) GROUP BY ALL),
weighed AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM held, corpus GROUP BY term, docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL
), scored AS (
  SELECT item_id, doc_id, doc, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score
  FROM asked JOIN held USING (term) JOIN weighed USING (term), corpus GROUP BY item_id, doc_id, doc
), ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(table(spark, sf_dir, "documents"))


# CRC-32 by its table (made from the polynomial) over the bytes of each run; words are near by the words they become without one character.
OP12_SQL = r"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS steps FROM range(256) t(i)
), runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents
  ) GROUP BY ALL
), bytes AS (
  SELECT doc_id, run, n, [CAST('0x' || substr(x, i, 2) AS BIGINT) for i in range(1, len(x), 2)] AS bytes FROM (SELECT *, hex(encode(doc_id || ':' || run)) AS x FROM runs WHERE length(run) >= 7)
), summed AS (
  SELECT doc_id, run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c // 256, steps[xor(c % 256, b) + 1])), 4294967295::BIGINT) AS h FROM bytes, crc
), observed AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM summed
), vocabulary AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM observed WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, CAST(i AS INTEGER) - 1) || substr(word, CAST(i AS INTEGER) + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN vocabulary b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN vocabulary b ON a.rest = b.word
), best AS (SELECT word, count(*) AS n_near, min((-near_n, near)) AS best FROM near GROUP BY word),
judged AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 10 * v.n THEN best[2] END AS form, CASE WHEN -best[1] >= 10 * v.n THEN -best[1] END AS form_n
  FROM vocabulary v LEFT JOIN best b ON v.word = b.word
), followed AS (
  SELECT word, word AS at, form FROM judged UNION ALL SELECT f.word, j.word, j.form FROM followed f JOIN judged j ON f.form = j.word
)
SELECT j.word, j.form, f.at AS root, j.n, j.n_near, j.form_n FROM judged j JOIN followed f ON j.word = f.word AND f.form IS NULL
"""


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inner_product.search(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(100)) == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (op1_mix_to_targets, op2_temporal_url_lists, op3_tokeniser_fertility, op4_secret_scan, op5_maxent_scores, op6_bayes_jaccard, op7_pigeonhole_leaks, op8_debruijn_dedup, op9_warc_normaliser, op10_ecoc_language, op11_ranked_search, op12_spelling_variants, op13_exact_top_k)
}
ORACLES: dict[str, str] = {"op2_temporal_url_lists": OP2_SQL, "op4_secret_scan": secrets_sql(), "op8_debruijn_dedup": OP8_SQL, "op9_warc_normaliser": OP9_SQL, "op11_ranked_search": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_exact_top_k": OP13_SQL}
