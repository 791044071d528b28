"""Records that the queries read, in Spark and in SQL. Tables and texts are always read whole."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.tokens import remove_frequent_tokens, term_frequency
from weft.session import cut, table
from weft.sources.files import table_records

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Book:
    """Queries by name, and the SQL of those that have it."""

    queries: dict[str, Query] = field(default_factory=dict)
    oracles: dict[str, str] = field(default_factory=dict)

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(query: Query) -> Query:
            self.queries[query.__name__] = query
            if sql is not None:
                self.oracles[query.__name__] = sql
            return query

        return keep


MAX_FREQUENCY = 60
#: Part records have few distinct words, so their stop words start higher.
PART_FREQUENCY = 100


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_id, tokens) of whole documents."""
    return table_records(table(spark, sf_dir, "documents"), "doc_id", "text")


def kept_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents without stop words, and their token frequencies."""
    return without_stop_words(documents(spark, sf_dir), MAX_FREQUENCY)


def without_stop_words(records: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Records without tokens of more than most occurrences, and the frequencies of the others, which that does not change."""
    freq = cut(term_frequency(records))
    return cut(remove_frequent_tokens(records, freq, most)), freq.where(F.col("freq") <= most)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_id, tokens) of parts: name, brand, type, size and price as one short record."""
    text = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("p_name", "p_brand", "p_type", "p_size", "p_retailprice")])
    return table_records(table(spark, sf_dir, "part").withColumn("text", text), "p_partkey", "text")


def kept_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return without_stop_words(parts(spark, sf_dir), PART_FREQUENCY)


def _tokens(text: str) -> str:
    return (
        rf"list_filter(list_transform(string_split_regex(replace(upper(replace({text}, 'ß', 'SS')), ',', ' '), '\s+'), "
        rf"lambda t: regexp_replace(t, '[^\p{{L}}\p{{N}}_]+', '', 'g')), lambda t: t <> '')"
    )


#: Common table expressions; every SQL text starts with one of them.
DOCUMENTS = f"WITH RECURSIVE rec AS (SELECT doc_id AS ref_id, {_tokens('text')} AS tokens FROM documents)"
PARTS = f"WITH RECURSIVE rec AS (SELECT p_partkey AS ref_id, {_tokens("concat_ws(' ', p_name, p_brand, p_type, p_size, p_retailprice)")} AS tokens FROM part)"
OCCURRENCES = "occ AS (SELECT ref_id, unnest(tokens) AS token FROM rec), tf AS (SELECT token, count(*) AS freq FROM occ GROUP BY token)"


def kept_sql(base: str, most: int) -> str:
    """rec, tf, then krec (tokens without stop words), kd (distinct tokens of records) and ktf (their frequencies)."""
    return f"""{base}, {OCCURRENCES},
ktf AS MATERIALIZED (SELECT token, freq FROM tf WHERE freq <= {most}),
kocc AS (SELECT ref_id, token FROM occ JOIN ktf USING (token)),
kd AS MATERIALIZED (SELECT DISTINCT ref_id, token FROM kocc),
krec AS (SELECT r.ref_id, coalesce(k.ts, []) AS tokens FROM rec r LEFT JOIN (SELECT ref_id, list(token ORDER BY token) AS ts FROM kd GROUP BY ref_id) k USING (ref_id))"""


KEPT_DOCUMENTS = kept_sql(DOCUMENTS, MAX_FREQUENCY)
KEPT_PARTS = kept_sql(PARTS, PART_FREQUENCY)
CAP = "cap AS (SELECT coalesce(list_sort(list(freq))[least(cast(floor(count(*) * 0.95) AS BIGINT), count(*) - 1) + 1], 0) AS c FROM ktf)"
SEEDS = f"""{CAP},
seed AS (SELECT [token] AS key, ref_id FROM kd JOIN ktf USING (token), cap
    WHERE length(token) >= 4 AND NOT regexp_full_match(token, '\\p{{Nd}}+') AND freq BETWEEN 2 AND c)"""
#: Seeds of part records: all tokens of frequency two or more.
FULL_SEEDS = "seed AS (SELECT [token] AS key, ref_id FROM kd JOIN ktf USING (token) WHERE freq >= 2)"


def prints_sql(blocks: str, name: str) -> str:
    """Blocks with their member lists."""
    return f"{name} AS (SELECT key, list(ref_id ORDER BY ref_id) AS members, count(*) AS size FROM {blocks} GROUP BY key)"


def components_sql(edges: str, nodes: str) -> str:
    """comp(ref_id, root): smallest node reachable over undirected edges(a, b), by growing reach sets."""
    return f"""und AS (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}),
reach(a, b) AS (SELECT a, b FROM und UNION SELECT r.a, u.b FROM reach r JOIN und u ON r.b = u.a),
comp AS (SELECT n.ref_id, least(n.ref_id, coalesce(min(r.b), n.ref_id)) AS root FROM {nodes} n LEFT JOIN reach r ON r.a = n.ref_id GROUP BY n.ref_id)"""


def _code_sql(letter: str) -> str:
    from weft.functions.text import SOUNDEX

    return "CASE " + " ".join(f"WHEN contains('{letters}', {letter}) THEN '{code}'" for letters, code in SOUNDEX.items()) + " ELSE '' END"


def soundex_sql(token: str) -> str:
    """Sound code of a non-empty token; the folded state is the code so far, a bar, and the last letter's own code."""
    upper = f"upper(replace({token}, 'ß', 'SS'))"
    step = (
        f"split_part(s, '|', 1) || CASE WHEN {_code_sql('c')} <> '' AND {_code_sql('c')} <> split_part(s, '|', 2) THEN {_code_sql('c')} ELSE '' END "
        f"|| '|' || CASE WHEN c IN ('H', 'W') THEN split_part(s, '|', 2) ELSE {_code_sql('c')} END"
    )
    start = f"substr({upper}, 1, 1) || '|' || {_code_sql(f'substr({upper}, 1, 1)')}"
    folded = f"list_reduce(list_filter(string_split(substr({upper}, 2), ''), lambda x: x <> ''), lambda s, c: {step}, {start})"
    return f"rpad(substr(split_part({folded}, '|', 1), 1, 4), 4, '0')"


def plain_soundex_sql(token: str) -> str:
    upper = f"upper(replace({token}, 'ß', 'SS'))"
    step = f"s || CASE WHEN {_code_sql('c')} <> '' AND {_code_sql('c')} <> s[-1] THEN {_code_sql('c')} ELSE '' END"
    folded = f"list_reduce(list_filter(string_split(substr({upper}, 2), ''), lambda x: x <> ''), lambda s, c: {step}, substr({upper}, 1, 1))"
    return f"rpad(substr({folded}, 1, 4), 4, '0')"
