"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framequarry.llm import licenses, line_dedup, mixing, ogg, packing, quality, sharding, simhash, substring_dedup, url_rules
from framequarry.llm._common import read_table
from framequarry.llm._words import slices

#: Production parameters.
SHARD_BYTES = 1 << 20
MIX_BUDGET, MIX_EPOCHS, MIX_SEED = 0.8, 2, 7
MIX_WEIGHTS = {"domain": {"web": 3, "books": 4, "news": 2, "code": 1}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 1}}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def domain_of(source: Column) -> Column:
    """src0 is web; of the others the number modulo 3 says books, news or code."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1).try_cast("int")
    return F.when(source == "src0", "web").when(number % 3 == 0, "books").when(number % 3 == 1, "news").when(number % 3 == 2, "code").otherwise("other")


def _media_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        payload, media = b.column("payload").to_pylist(), b.column("media").to_pylist()
        sha = lambda x: hashlib.sha256(x).hexdigest()
        cols = {
            "payload_bytes": pa.array(map(len, payload), pa.int64()),
            "payload_sha256": pa.array(map(sha, payload), pa.string()),
            "tail_crc32": pa.array([zlib.crc32(x[-64:]) for x in payload], pa.int64()),
            "media_bytes": pa.array(map(len, media), pa.int64()),
            "media_sha256": pa.array(map(sha, media), pa.string()),
        }
        rest = ["doc_id", "n_bytes", *cols, "feature", "faults"]
        yield pa.RecordBatch.from_arrays([cols.get(c, b.column(c) if c not in cols else None) for c in rest], names=rest)


def op1_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    n = F.octet_length(text)
    pad = F.when(n == 0, 64).otherwise((64 - n % 64) % 64)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("n_bytes"), F.concat(text, F.expr("unhex(repeat('00', 64))").substr(F.lit(1), pad)).alias("payload"))
    read = ogg.from_ogg(_with_media(docs))
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, faults string"
    return read.mapInArrow(_media_digests, schema)


def _with_media(docs: DataFrame) -> DataFrame:
    """The stored form, kept beside what is read back from it."""
    return ogg.to_ogg(docs, "payload")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", _sha256(F.col("kept_text")).alias("kept_sha256"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.filter_urls(pages, url_rules.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def op4_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.extendible_shards(docs, SHARD_BYTES).select("doc_id", "n_bytes", "shard", "depth", "shard_bytes")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *quality.FIGURES, "base_failed", "kept")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read_table(spark, sf_dir, "documents").select("doc_id", "text"), nulls=False)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "sentence_ids", F.concat_ws(",", "licenses").alias("licenses"), "n_licenses")


def op8_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary_path())


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", mixing.byte_tokens(F.col("text")).alias("n_tokens"))
    return mixing.mix(rows, MIX_BUDGET, MIX_WEIGHTS, MIX_EPOCHS, MIX_SEED)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicated(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", _sha256(F.col("kept_text")).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_ogg_media,
        op2_substring_dedup,
        op3_url_filters,
        op4_extendible_shards,
        op5_quality_rules,
        op6_simhash_dedup,
        op7_license_scan,
        op8_vector_packing,
        op9_source_mixing,
        op10_line_dedup,
    )
    return {f.__name__: f for f in every}


_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

_OP2 = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
win AS (SELECT doc_id, i, list_slice(words, i, i + 19) AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
each_word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p) AS t FROM each_word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

_OP3 = """
WITH a AS (SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN NULL ELSE substr(url, position('://' IN url) + 3) END AS r FROM pages),
b AS (SELECT page_id, coalesce(translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(substr(regexp_extract(r, '^[^?#]*'), length(regexp_extract(r, '^[^/?#]*')) + 1), '') AS path FROM a),
r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h) DESC, length(p) DESC) AS n
  FROM b JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT b.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM b LEFT JOIN m ON b.page_id = m.page_id AND n = 1
"""

_OP4 = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
p AS (SELECT doc_id, k, sum(n_bytes) OVER (PARTITION BY k, h >> (60 - k)) AS total FROM d, range(0, 25) t(k)),
leaf AS (SELECT doc_id, min(k) AS depth, max(total) AS total FROM p WHERE total <= {SHARD_BYTES} GROUP BY doc_id)
SELECT d.doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE substr(lpad(bin(h), 60, '0'), 1, depth::INTEGER) END AS shard, depth::INTEGER AS depth, total::BIGINT AS shard_bytes
FROM d JOIN leaf USING (doc_id)
"""

_STOPS = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS)) + "]"
_OP5 = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM w),
win AS (SELECT doc_id, i, list_slice(words, i, i + 2) AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM twice) GROUP BY doc_id),
f AS (SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(words, lambda x: list_contains({_STOPS}, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))))::BIGINT AS n_stop_words
  FROM w JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND NOT (word_chars < 2 * n_words OR word_chars > 20 * n_words OR n_symbols > 0.3::DOUBLE * n_words
  OR n_stop_words < 0.005::DOUBLE * n_words OR n_dup_lines > 0.5::DOUBLE * n_lines) AS kept FROM g
"""


def _op7() -> str:
    sentences = licenses.known_sentences()
    known = ", ".join(f"('{s}', '{i}')" for s, i in sentences.items())
    norm = f"chr(10) || chr(10) || translate(coalesce(text, ''), '{licenses.FROM}', '{licenses.TO}') || chr(10) || chr(10)"
    for pattern, mark in licenses.STEPS:
        norm = f"regexp_replace({norm}, '{pattern}', '{mark}', 'g')"
    parts = []
    for k, (name, sequence, gaps) in enumerate(licenses.RULES):
        pattern, groups = licenses.rule_pattern(sequence, gaps)
        left = "".join(f"\\{i + 1}" for i in range(groups))
        parts.append(
            f"r{k} AS (SELECT doc_id, ids, regexp_replace(rest, '{pattern}', '{left}', 'g') AS rest, CASE WHEN regexp_matches(rest, '{pattern}') AND NOT list_contains(found, '{name}') "
            f"THEN list_append(found, '{name}') ELSE found END AS found FROM {f'r{k - 1}' if k else 'start'})"
        )
    return f"""
WITH known(s, i) AS (VALUES {known}),
cut AS (SELECT doc_id, regexp_extract_all({norm}, '{licenses.sentence_pattern(sentences)}', 1) AS x FROM documents),
line AS (SELECT doc_id, replace(unnest(x), '//', ' ') AS s, generate_subscripts(x, 1) AS n FROM cut),
hit AS (SELECT doc_id, string_agg(i, '' ORDER BY n) AS ids FROM line JOIN known USING (s) GROUP BY doc_id),
start AS (SELECT doc_id, coalesce(ids, '') AS ids, coalesce(ids, '') AS rest, []::VARCHAR[] AS found FROM documents LEFT JOIN hit USING (doc_id)),
{", ".join(parts)}
SELECT doc_id, ids AS sentence_ids, array_to_string(found, ',') AS licenses, len(found)::BIGINT AS n_licenses FROM r{len(licenses.RULES) - 1}
"""


def _op9() -> str:
    weight = lambda level: "CASE " + " ".join(f"WHEN {level} = '{v}' THEN {w}" for v, w in MIX_WEIGHTS[level].items()) + " ELSE 1 END::DOUBLE"
    steps, up = [], []
    for k, level in enumerate(mixing.LEVELS):
        keys = mixing.LEVELS[: k + 1]
        w = weight(level) if level in MIX_WEIGHTS else "1::DOUBLE"
        cols, part = ", ".join(keys), f"PARTITION BY {', '.join(up)}" if up else ""
        steps.append(f"""
n{k} AS (SELECT {", ".join("l." + c for c in keys)}, sum(capacity)::BIGINT AS capacity, any_value(b.budget) AS budget FROM leaves l JOIN b{k} b ON {" AND ".join(f"l.{c} IS NOT DISTINCT FROM b.{c}" for c in up) or "true"} GROUP BY {", ".join("l." + c for c in keys)}),
f{k} AS (SELECT *, capacity / ({w}) AS fill, {w} AS weight FROM n{k}),
g{k} AS (SELECT *, (budget - coalesce(sum(capacity) OVER ({part} ORDER BY fill, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER ({part} ORDER BY fill, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS per_weight FROM f{k}),
h{k} AS (SELECT *, min(CASE WHEN per_weight < fill THEN fill END) OVER ({part}) AS open_fill FROM g{k}),
i{k} AS (SELECT *, min(CASE WHEN per_weight < fill AND fill = open_fill THEN per_weight END) OVER ({part}) AS open_per FROM h{k}),
b{k + 1} AS (SELECT {cols}, (CASE WHEN open_fill IS NULL OR fill < open_fill THEN capacity ELSE least(capacity, floor(weight * open_per)) END)::BIGINT AS budget FROM i{k})""")
        up = list(keys)
    return f"""
WITH d AS (SELECT doc_id, CASE WHEN source = 'src0' THEN 'web' ELSE CASE try_cast(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS INTEGER) % 3 WHEN 0 THEN 'books' WHEN 1 THEN 'news' WHEN 2 THEN 'code' ELSE 'other' END END AS domain,
  lang, source, ceil(coalesce(strlen(text), 0) / 4.0)::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * {MIX_EPOCHS})::BIGINT AS capacity FROM d GROUP BY ALL),
b0 AS (SELECT least(floor(sum(tokens) * {MIX_BUDGET}::DOUBLE), sum(capacity))::BIGINT AS budget FROM leaves),{",".join(steps)},
plan AS (SELECT l.domain, l.lang, l.source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS whole, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest
  FROM leaves l JOIN b3 b ON l.domain IS NOT DISTINCT FROM b.domain AND l.lang IS NOT DISTINCT FROM b.lang AND l.source IS NOT DISTINCT FROM b.source),
p AS (SELECT d.*, whole, rest, ('0x' || substr(md5('{MIX_SEED}:' || (whole + 1)::VARCHAR || ':' || doc_id::VARCHAR), 1, 15))::BIGINT AS h
  FROM d JOIN plan l ON l.domain IS NOT DISTINCT FROM d.domain AND l.lang IS NOT DISTINCT FROM d.lang AND l.source IS NOT DISTINCT FROM d.source),
q AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM p)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(1, whole + 1))::INTEGER AS epoch FROM p WHERE whole > 0
UNION ALL SELECT doc_id, domain, lang, source, n_tokens, (whole + 1)::INTEGER FROM q WHERE rest > 0 AND run <= rest
"""


_OP10 = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express at a bearable speed."""
    return {
        "op2_substring_dedup": _OP2,
        "op3_url_filters": _OP3,
        "op4_extendible_shards": _OP4,
        "op5_quality_rules": _OP5,
        "op7_license_scan": _op7(),
        "op9_source_mixing": _op9(),
        "op10_line_dedup": _OP10,
    }
