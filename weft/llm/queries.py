"""The subpackage's queries, each over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weft.llm import bpe, chat, editprint, html, media, mixing, quality, simhash, toxicity, urls
from weft.llm.parameters import LABELLED, TARGETS, VOCABULARY
from weft.session import table

#: Fixed values of the query: (action, host, path).
URL_RULES = (
    urls.Rule("block", "net", "/"),
    urls.Rule("allow", "example.net", "/en/"),
    urls.Rule("block", "example.com", "/de/"),
    urls.Rule("allow", "org", "/fr/"),
)
URL_ORACLE = r"""
WITH u AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
s AS (SELECT page_id, coalesce(lower(url), '') AS low, coalesce(regexp_extract(rest, '^([^/?#]*)', 1), '') AS raw, rest FROM u),
h AS (SELECT page_id, low, lower(raw) AS host, coalesce(regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1), '') AS path FROM s),
r AS (SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(low, '/robots\.txt') THEN 'allow'
    WHEN regexp_matches(low, '://ads\.|/ads/|/adserver/|/banner/|\.casino\.|/casino/|/porn/|\.xxx/|/warez/|/wp-login\.|/cgi-bin/|/phishing/') THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""
#: CRC-32 (reflected, polynomial EDB88320) of a list of bytes b, and per document the bytes of its text.
MEDIA_ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, row_number() OVER () AS row, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, row, length(x) // 2 AS n_bytes, CASE WHEN x = '' THEN repeat('00', 64) ELSE x || repeat('00', cast((64 - (length(x) // 2) % 64) % 64 AS INTEGER)) END AS x FROM t),
m AS (SELECT *, cast(length(x) // 2 AS BIGINT) AS n FROM p),
le AS (SELECT *, '52494646' || {riff} || '57415645666d7420' || '10000000' || '01000100' || '401f0000' || '401f0000' || '01000800' || '64617461' || {size} || x AS media FROM m),
tab AS (SELECT list(c ORDER BY k) AS crc FROM (SELECT k, list_reduce(range(8), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k) AS c FROM (SELECT unnest(range(256)) AS k))),
tail AS (SELECT row, list_reduce(list_transform(range(64), lambda j: cast('0x' || substr(right(x, 128), cast(2 * j + 1 AS BIGINT), 2) AS BIGINT)),
    lambda c, b: xor(crc[xor(c, b) % 256 + 1], c >> 8), 4294967295) AS c FROM m, tab),
bytes AS (SELECT row, i, cast('0x' || substr(x, 2 * i + 1, 2) AS BIGINT) AS b FROM (SELECT row, x, unnest(range(n)) AS i FROM m)),
steps AS (SELECT row, b, CASE WHEN (b >= 128) <> lag(b >= 128) OVER (PARTITION BY row ORDER BY i) THEN 1 ELSE 0 END AS turn FROM bytes),
f AS (SELECT row, cast(sum(b) AS BIGINT) AS total, cast(sum((b - 128) * (b - 128)) AS BIGINT) AS energy, cast(sum(turn) AS BIGINT) AS crossings FROM steps GROUP BY row)
SELECT doc_id, n_bytes, n AS payload_bytes, sha256(unhex(x)) AS payload_sha256, xor(tail.c, 4294967295) AS tail_crc32, length(media) // 2 AS media_bytes, sha256(unhex(media)) AS media_sha256,
    'audio/wav;rate=8000;samples=' || n || ';sum=' || total || ';energy=' || energy || ';crossings=' || crossings AS feature
FROM le JOIN tail USING (row) JOIN f USING (row)
"""


def _little_endian(value: str) -> str:
    return " || ".join(f"printf('%02x', ({value}) // {256**k} % 256)" for k in range(4))


MEDIA_ORACLE = MEDIA_ORACLE.replace("{riff}", _little_endian("n + 36")).replace("{size}", _little_endian("n"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), URL_RULES + urls.DEFAULT_PATTERNS)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = mixing.labelled_documents(docs, table(spark, sf_dir, "labels"), LABELLED)
    return mixing.mix(docs, labelled, TARGETS, max_rows=LABELLED)


def op10_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editprint.compare(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_chat": op2_chat,
    "op3_bpe": op3_bpe,
    "op4_html": op4_html,
    "op5_url_filter": op5_url_filter,
    "op6_media": op6_media,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_mixing": op9_mixing,
    "op10_edit_fingerprint": op10_edit_fingerprint,
}

ORACLES: dict[str, str] = {"op2_chat": chat.ORACLE, "op5_url_filter": URL_ORACLE, "op6_media": MEDIA_ORACLE}
