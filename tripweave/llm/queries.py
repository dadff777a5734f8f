"""One query per operator: (spark, folder of parquet tables) to the columns its contract names."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.llm import (
    covertree,
    decontam,
    lexical,
    lm,
    packing,
    quality,
    rules,
    sharding,
    simhash,
    tokens,
    topk,
    toxicity,
    warc,
)
from tripweave.llm.common import remainder
from tripweave.plans.lineage import owns_copies
from tripweave.queries.folders import name_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def query(build):
    """Register ``build``; what it copies and its result does not read is removed at once."""

    @functools.wraps(build)
    def named(spark: SparkSession, folder: str) -> DataFrame:
        name_folder(spark)
        return owns_copies(build)(spark, folder)

    QUERIES[build.__name__] = named
    return named


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(divisor: int, rest: int, key: str = "doc_id"):
    return remainder(key, divisor) == rest


@query
def op1_best_fit_packing(spark, folder):
    packed = packing.pack_documents(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024
    )
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op2_lm_scoring(spark, folder):
    scored = lm.score(table(spark, folder, "documents"), train=~held_out(5, 1), order=3)
    return scored.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


@query
def op3_decontamination(spark, folder):
    found = decontam.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), window=13)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    " '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
ORACLES["op3_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[pos : pos + n - 1], ' ') AS run
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS pos
        FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, sizes WHERE len(w) >= n),
hits AS (
  SELECT p.doc_id, p.pos, p.n, x.item_id
  FROM (SELECT doc_id, pos, n, array_to_string(w[pos : pos + n - 1], ' ') AS run FROM places) p JOIN windows x USING (n, run)),
words AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS pos FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query
def op4_toxicity(spark, folder):
    docs = table(spark, folder, "documents")
    known = table(spark, folder, "labels").filter(~held_out(5, 0))
    model = toxicity.train(docs, known)
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id",
        held_out(5, 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "sentences",
        "worst",
        "worst_score",
    )


@query
def op5_sharding(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id")
    return sharding.place(docs, SHARDS).select("doc_id", sharding.slot_of(F.col("doc_id")).alias("slot"), "shard")


ORACLES["op5_sharding"] = f"""
WITH filled AS (SELECT string_split('{",".join(map(str, sharding.fill_table(SHARDS)))}', ',') AS held),
placed AS (
  SELECT doc_id,
    CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), chr(0) || 'null')), 1, 12) AS BIGINT) % {sharding.SLOTS} AS INTEGER) AS slot
  FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(held[slot + 1], 3, '0') AS shard FROM placed, filled"""


def crawl_records(pages: DataFrame) -> DataFrame:
    """The pages as a crawl: a 200 response each, and for three in four one to three later
    answers, most of them 304, some 204 or 206.  Times, validators and headers, some of them
    repeated in another spelling, follow from page_id and html by integer rules."""
    at = (F.col("page_id") * 7919) % 1_000_003
    tag = F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    records = pages.select(
        "page_id", "url", at.alias("at"), tag.alias("tag"), F.explode(F.sequence(F.lit(0), (F.col("page_id") % 4).cast("int"))).alias("visit")
    )
    first = F.col("visit") == 0
    # A later visit names another tag (a changed page), or none and only a time, or nothing.
    kind = (F.col("page_id") + F.col("visit")) % 7
    part = (F.col("page_id") + F.col("visit")) % 11
    stamp = lambda seconds: F.timestamp_seconds(F.lit(1_700_000_000) + seconds)
    return records.select(
        (F.col("page_id") * 4 + F.col("visit")).alias("record_id"),
        "url",
        stamp(F.col("at") + F.col("visit") * 86_400).alias("captured_at"),
        F.when(first, 200).when(part == 3, 206).when(part == 5, 204).otherwise(304).alias("status"),
        F.when(first | (kind < 4), F.col("tag")).when(kind == 4, F.concat(F.lit("x"), "tag")).alias("etag"),
        F.when(first | (kind == 5), stamp(F.col("at") - 3_600)).alias("last_modified"),
        F.when(
            first,
            F.create_map(
                F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.length("tag").cast("string"), F.lit("Age"), F.lit("0")
            ),
        )
        .otherwise(
            F.create_map(
                F.lit("Age"), F.lit("7"), F.lit("age"), F.col("visit").cast("string"), F.lit("Content-Length"), F.lit("0"), F.lit("X-Visit"), kind.cast("string")
            )
        )
        .alias("headers"),
        F.when(first, F.col("tag")).alias("digest"),
    )


@query
def op6_simhash_near_dedup(spark, folder):
    found = simhash.near_duplicates(table(spark, folder, "documents"), words=3, distance=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_revisit_resolution(spark, folder):
    resolved = warc.resolve_revisits(crawl_records(table(spark, folder, "pages")))
    listed = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return resolved.select(
        "record_id",
        "canonical",
        F.unix_timestamp("captured_at").alias("captured_s"),
        "response_id",
        "response_digest",
        F.array_join(listed, ";").alias("headers"),
        "outcome",
    )


ORACLES["op7_revisit_resolution"] = rf"""
WITH bare AS (
  SELECT page_id, md5(coalesce(html, '')) AS tag, (page_id * 7919) % 1000003 AS at_s,
    regexp_replace(regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^/?@]*@', '') AS u
  FROM pages),
parts AS (
  SELECT page_id, tag, at_s,
    regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')), ':(80|443)$', ''), '^(www|m)\.', '')
      || regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS place,
    array_to_string(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'),
      lambda f: f <> '' AND NOT regexp_matches(f, '{warc.TRACKING}')), '&') AS q
  FROM bare),
records AS (
  SELECT page_id * 4 + visit AS record_id, place || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canonical,
    1700000000 + at_s + visit * 86400 AS captured_s, page_id, visit, (page_id + visit) % 7 AS kind, tag, at_s
  FROM parts, range(0, 4) r(visit) WHERE visit <= page_id % 4),
known AS (
  SELECT *,
    CASE WHEN visit = 0 OR kind < 4 THEN tag WHEN kind = 4 THEN 'x' || tag END AS etag,
    CASE WHEN visit = 0 OR kind = 5 THEN at_s - 3600 END AS modified,
    last_value(CASE WHEN visit = 0 THEN {{'id': record_id, 'tag': tag, 'modified': at_s - 3600}} END IGNORE NULLS)
      OVER (PARTITION BY canonical ORDER BY captured_s, record_id ROWS UNBOUNDED PRECEDING) AS stored
  FROM records),
judged AS (
  SELECT *, CASE WHEN stored IS NULL THEN 'orphan'
    WHEN etag IS NOT NULL AND etag = stored.tag THEN 'resolved'
    WHEN etag IS NULL AND modified IS NOT NULL AND modified = stored.modified THEN 'resolved'
    ELSE 'changed' END AS outcome
  FROM known WHERE visit > 0 AND canonical IS NOT NULL AND (page_id + visit) % 11 NOT IN (3, 5))
SELECT record_id, canonical, captured_s,
  CASE WHEN outcome = 'resolved' THEN stored.id END AS response_id,
  CASE WHEN outcome = 'resolved' THEN stored.tag END AS response_digest,
  CASE WHEN outcome = 'resolved'
    THEN 'age=7, ' || visit || ';content-length=32;content-type=text/html;x-visit=' || kind
    ELSE 'Age=7;Content-Length=0;X-Visit=' || kind || ';age=' || visit END AS headers,
  outcome
FROM judged"""


@query
def op8_quality_classifier(spark, folder):
    docs = table(spark, folder, "documents")
    known = table(spark, folder, "labels").filter(~held_out(3, 1))
    scored = quality.classify(docs, known, "quality")
    return scored.select(
        "doc_id",
        held_out(3, 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op9_quality_rules(spark, folder):
    return rules.repetition(table(spark, folder, "documents"), **rules.LIMITS)


@query
def op10_token_counts(spark, folder):
    counted = tokens.token_counts(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@query
def op11_exact_top_k(spark, folder):
    rows = table(spark, folder, "embeddings")
    return topk.exact_top_k(rows, rows.filter(F.col("vec_id") % 100 == 0), k=10)


#: Vectors without null or non-finite components, scaled to whole numbers kept in doubles.
_VECTORS = """
SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

ORACLES["op11_exact_top_k"] = f"""
WITH v AS ({_VECTORS}),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""


@query
def op12_ranked_search(spark, folder):
    return lexical.ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=50)


_TERMS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    " '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
)
ORACLES["op12_ranked_search"] = f"""
WITH d AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n FROM (SELECT doc_id, {_TERMS} AS w FROM documents) WHERE len(w) > 0),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
held AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM held GROUP BY term), whole),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term), whole GROUP BY ALL),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50"""


@query
def op13_cover_tree_codes(spark, folder):
    codes, books = covertree.fit_codes(table(spark, folder, "embeddings"), parts=4, entries=256, rounds=4)
    return covertree.with_label_errors(codes).select(
        "vec_id", "code", "error", "label_error", F.lit(covertree.books_digest(books)).alias("codebooks_sha256")
    )


def _lloyd_sql(parts: int, entries: int, rounds: int) -> str:
    """Plain rounds: every part against every entry."""
    square = "list_inner_product(x.p, x.p) - 2 * list_inner_product(x.p, c.p) + list_inner_product(c.p, c.p)"

    def assigned(name: str, book: str) -> str:
        nearest = f"min({{'d': CAST({square} AS BIGINT), 'entry': c.entry}})"
        return f"{name} AS MATERIALIZED (SELECT x.vec_id, x.part, {nearest} AS near FROM cut x JOIN {book} c USING (part) GROUP BY ALL)"

    steps = [
        f"v AS MATERIALIZED ({_VECTORS})",
        f"""cut AS MATERIALIZED (
  SELECT vec_id, part, e[part * len(e) // {parts} + 1 : (part + 1) * len(e) // {parts}] AS p FROM v, range({parts}) r(part))""",
        f"first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT {entries})",
        "b0 AS MATERIALIZED (SELECT part, entry, p FROM cut JOIN first USING (vec_id))",
    ]
    for r in range(rounds):
        steps += [
            assigned(f"a{r}", f"b{r}"),
            f"""m{r} AS (
  SELECT part, entry, list(mean ORDER BY pos) AS p FROM (
    SELECT part, near.entry AS entry, pos, floor(sum(p[pos]) / count(*)) AS mean
    FROM a{r} JOIN cut USING (vec_id, part), LATERAL (SELECT unnest(range(1, len(p) + 1)) AS pos) GROUP BY ALL)
  GROUP BY ALL)""",
            f"b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{r}.p, b{r}.p) AS p FROM b{r} LEFT JOIN m{r} USING (part, entry))",
        ]
    steps += [
        assigned("final", f"b{rounds}"),
        """coded AS (
  SELECT vec_id, string_agg(printf('%02x', near.entry), '' ORDER BY part) AS code, CAST(sum(near.d) AS BIGINT) AS error
  FROM final GROUP BY vec_id)""",
        f"""digest AS (
  SELECT sha256(string_agg(array_to_string(list_transform(p, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS s
  FROM b{rounds})""",
    ]
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256
FROM coded JOIN v USING (vec_id), digest"""


ORACLES["op13_cover_tree_codes"] = _lloyd_sql(4, 256, 4)
