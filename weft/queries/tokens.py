"""Queries on tokens, frequencies, gates and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.functions.variations import FIXED, RULES
from weft.operators import seeds, tokens
from weft.operators.signature import vocabulary
from weft.queries import base
from weft.queries.base import CAP, DOCUMENTS, KEPT_DOCUMENTS, KEPT_PARTS, OCCURRENCES, PARTS, Book
from weft.session import table

BOOK = Book()
NON_WORD = r"[^\p{L}\p{N}_]+"


def _case(mapping: dict[str, str], value: str, otherwise: str) -> str:
    whens = " ".join(f"WHEN '{k.replace(chr(39), chr(39) * 2)}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in mapping.items())
    return f"CASE {value} {whens} ELSE {otherwise} END"


@BOOK.add(f"{DOCUMENTS} SELECT ref_id, len(tokens) AS n, array_to_string(tokens, ' ') AS tokens FROM rec")
def tokenize_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.documents(spark, sf_dir).select("ref_id", F.size("tokens").cast("long").alias("n"), F.array_join("tokens", " ").alias("tokens"))


@BOOK.add(
    rf"""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(concat_ws(' ', nullif(role, ''), nullif(text, ''))), '{NON_WORD}', ' ', 'g'), '\s+', ' ', 'g')) AS x FROM conversations)
SELECT conv_id, turn, x AS cleaned, array_to_string(list_transform(list_filter(string_split(x, ' '), lambda t: t <> ''), lambda t: {_case(T.NORMALIZATION, 't', 't')}), ' ') AS tokens FROM c"""
)
def clean_and_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        "conv_id", "turn", T.clean_text(F.concat_ws(" ", "role", "text")).alias("cleaned"), F.array_join(T.record_tokens(["role", "text"]), " ").alias("tokens")
    )


@BOOK.add(
    rf"""SELECT page_id, array_to_string(list_filter(string_split(trim(regexp_replace(url, '{NON_WORD}', ' ', 'g')), ' '), lambda t: t <> ''), ' ') AS tokens FROM pages"""
)
def resplit_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(T.resplit_tokens(F.array("url")), " ").alias("tokens"))


@BOOK.add(f"{DOCUMENTS}, {OCCURRENCES} SELECT token, freq FROM tf")
def token_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.term_frequency(base.documents(spark, sf_dir))


@BOOK.add(f"{DOCUMENTS}, {OCCURRENCES} SELECT token, count(DISTINCT ref_id) AS freq FROM occ GROUP BY token")
def token_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.document_frequency(base.documents(spark, sf_dir))


@BOOK.add(f"{DOCUMENTS}, {OCCURRENCES} SELECT token, count(*) AS tf, count(DISTINCT ref_id) AS df FROM occ GROUP BY token")
def token_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_statistics(base.documents(spark, sf_dir))


@BOOK.add(f"{KEPT_DOCUMENTS}, {CAP} SELECT c AS freq FROM cap")
def df_cap_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.frequency_cap(base.kept_documents(spark, sf_dir)[1])


@BOOK.add(
    f"{DOCUMENTS}, {OCCURRENCES}, s AS (SELECT list_sort(list(freq)) AS l, count(*) AS n FROM tf), q AS (SELECT unnest([0.5, 0.9, 0.95, 0.99]) AS q) "
    "SELECT cast(q AS DOUBLE) AS q, l[least(cast(floor(n * q) AS BIGINT), n - 1) + 1] AS freq FROM s, q"
)
def frequency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    freq = tokens.term_frequency(base.documents(spark, sf_dir))
    out = None
    for q in (0.5, 0.9, 0.95, 0.99):
        one = tokens.rank_value(freq, "freq", q).select(F.lit(q).alias("q"), "freq")
        out = one if out is None else out.unionByName(one)
    return out


@BOOK.add(
    f"{DOCUMENTS}, m AS (SELECT len(list_distinct(tokens)) AS n, count(*) AS c FROM rec GROUP BY n) "
    "SELECT cast(floor(n * 0.6) AS BIGINT) AS stop_k, cast(floor(n * 0.75) AS BIGINT) AS max_k FROM m ORDER BY c DESC, n LIMIT 1"
)
def stop_k_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.mode_length(base.documents(spark, sf_dir)).select(F.floor(F.col("mode") * 0.6).alias("stop_k"), F.floor(F.col("mode") * 0.75).alias("max_k"))


@BOOK.add(
    f"{DOCUMENTS}, {OCCURRENCES} SELECT r.ref_id, array_to_string(list_filter(r.tokens, lambda t: NOT list_contains(s.l, t)), ' ') AS tokens "
    "FROM rec r, (SELECT list(token) AS l FROM tf WHERE freq > 60) s"
)
def stopword_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = base.documents(spark, sf_dir)
    kept = tokens.remove_frequent_tokens(records, tokens.term_frequency(records), base.MAX_FREQUENCY)
    return kept.select("ref_id", F.array_join("tokens", " ").alias("tokens"))


@BOOK.add(
    rf"""{KEPT_DOCUMENTS}, {CAP} SELECT CASE WHEN length(token) < 4 THEN 'too_short' WHEN regexp_full_match(token, '\p{{Nd}}+') THEN 'numeric'
    WHEN freq < 2 THEN 'too_rare' WHEN freq > c THEN 'too_frequent' ELSE 'kept' END AS gate, count(*) AS n FROM kd JOIN ktf USING (token), cap GROUP BY gate"""
)
def seed_gate_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.gate_counters(*base.kept_documents(spark, sf_dir))


@BOOK.add(
    f"{DOCUMENTS}, {OCCURRENCES}, m AS (SELECT avg(freq) AS mean FROM tf) SELECT token, freq, freq > 1.5 * mean AS strict FROM tf, m WHERE freq >= 1.1 * mean"
)
def mean_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    freq = tokens.term_frequency(base.documents(spark, sf_dir))
    strict = tokens.mean_gate(freq, 1.5, True).select("token", F.lit(True).alias("s"))
    return tokens.mean_gate(freq, 1.1, False).join(strict, "token", "left").select("token", "freq", F.coalesce("s", F.lit(False)).alias("strict"))


@BOOK.add(
    f"""{DOCUMENTS}, {OCCURRENCES}, g AS (SELECT token, CASE WHEN length(token) < 2 THEN [token] ELSE list_transform(range(1, length(token)), lambda i: substr(token, i, 2)) END AS grams FROM tf)
SELECT token, array_to_string(grams, '|') AS grams,
    'MH_' || substr(sha256(array_to_string(list_sort(list_distinct(grams)), chr(31))), 1, 16) AS sig FROM g"""
)
def qgram_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = vocabulary(base.documents(spark, sf_dir)).withColumn("g", T.qgrams("token", 2))
    return words.select("token", F.array_join("g", "|").alias("grams"), T.gram_key("g").alias("sig"))


@BOOK.add(
    rf"""{PARTS}, {OCCURRENCES}, v AS (SELECT a.token AS a, b.token AS b FROM tf a JOIN tf b ON substr(a.token, 1, 1) = substr(b.token, 1, 1) AND a.token < b.token)
SELECT a, b, levenshtein(a, b) AS distance, cast(round_even(100 * (1 - levenshtein(a, b) / greatest(length(a), length(b))), 0) AS INTEGER) AS ratio,
    length(a) = length(b) AND levenshtein(a, b) = 2 AND damerau_levenshtein(a, b) = 1 AS swapped FROM v"""
)
def token_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = vocabulary(base.parts(spark, sf_dir)).withColumn("c", F.substring("token", 1, 1))
    pairs = words.select(F.col("token").alias("a"), "c").join(words.select(F.col("token").alias("b"), "c"), "c").where("a < b")
    a, b = F.col("a"), F.col("b")
    return pairs.select("a", "b", F.levenshtein(a, b).alias("distance"), T.similarity_ratio(a, b).alias("ratio"), (T.adjacent_swap(a, b) & (F.levenshtein(a, b) == 2)).alias("swapped"))


@BOOK.add(
    rf"""{KEPT_PARTS}, k AS (SELECT ref_id, tokens AS key FROM krec)
SELECT ref_id, len(key) AS n, CASE WHEN len(key) = 0 THEN 0.0 ELSE list_sum(list_transform(key, lambda t: length(t))) / len(key) END AS mean_length,
    round(CASE WHEN len(key) = 0 THEN 1.0 ELSE 1.0 + 0.5 * ln(1 + list_max(list_transform(key, lambda t: length(t)))) END, 6) AS length_score,
    CASE WHEN len(key) > 0 AND len(list_filter(key, lambda t: NOT regexp_full_match(t, '\p{{Nd}}+'))) = 0 THEN cast(0.5 AS DOUBLE) ELSE cast(2.0 AS DOUBLE) END AS type_factor FROM k"""
)
def key_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = base.kept_parts(spark, sf_dir)[0].select("ref_id", F.array_distinct("tokens").alias("key"))
    return keys.select(
        "ref_id", T.key_size("key").cast("long").alias("n"), T.key_mean_length("key").alias("mean_length"),
        F.round(T.key_length_score("key", 0.5), 6).alias("length_score"), T.key_type_factor("key", 0.5, 2.0).alias("type_factor"),
    )


@BOOK.add(
    "SELECT p_partkey, cast(concat('0x', substr(sha1(p_name), 1, 8)) AS BIGINT) AS h FROM part"
)
def stable_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.stable_hash(F.col("p_name")).alias("h"))


@BOOK.add(f"{DOCUMENTS}, {OCCURRENCES} SELECT token, {base.soundex_sql('token')} AS soundex, {base.plain_soundex_sql('token')} AS plain_soundex FROM tf")
def sound_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = vocabulary(base.documents(spark, sf_dir))
    return words.select("token", T.soundex("token").alias("soundex"), T.plain_soundex("token").alias("plain_soundex"))


@BOOK.add()
def minhash_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = vocabulary(base.parts(spark, sf_dir))
    return words.select("token", T.minhash_signature(T.qgrams("token", 2), 64, 42).alias("signature"))


def _fixed_sql() -> str:
    """Variants without random choice, over part names and their words."""
    from weft.functions import variations as V

    w = "lower(w)"

    def patterns(rules: dict[str, str]) -> str:
        ordered = sorted(rules.items(), key=lambda rule: -len(rule[0]))
        return "CASE " + " ".join(f"WHEN contains({w}, '{p}') THEN substr({w}, 1, instr({w}, '{p}') - 1) || '{r}' || substr({w}, instr({w}, '{p}') + {len(p)})" for p, r in ordered) + f" ELSE {w} END"

    stems = "CASE " + " ".join(f"WHEN ends_with({w}, '{s}') AND length(w) - {len(s)} >= 3 THEN substr({w}, 1, length(w) - {len(s)})" for s in sorted(V.SUFFIXES, key=len, reverse=True)) + " ELSE w END"
    regional = {**{uk: us for us, uk in V.REGIONAL.items()}, **V.REGIONAL}
    single = {
        "phonetic_substitution": patterns(V.PHONEMES),
        "phonetic_silent_letter_removal": _case(V.SILENT, w, "w"),
        "ortho_regional_spelling": _case(regional, w, "w"),
        "ortho_informal": _case(V.INFORMAL, w, "w"),
        "ortho_punctuation_removal": "regexp_replace(w, '[.''\\\\\\-_,!]', '', 'g')",
        "morph_stemming": stems,
        "abbrev_abbreviation": _case(V.ABBREVIATIONS, w, "CASE WHEN length(w) > 3 THEN lower(substr(w, 1, 3)) || '.' ELSE w END"),
        "abbrev_acronym": "CASE WHEN contains(w, ' ') THEN array_to_string(list_transform(string_split(w, ' '), lambda x: upper(substr(x, 1, 1))), '') ELSE upper(w) END",
        "abbrev_shortened_form": _case(V.NICKNAMES, w, "substr(w, 1, cast(ceil(length(w) / 2) AS INTEGER))"),
        "token_merge": "replace(w, ' ', '')",
        "noise_number_substitution": _case(V.NUMBERS, w, "w"),
    }
    lists = {
        "ngram_substrings": "CASE WHEN length(w) < 3 THEN w ELSE array_to_string(list_transform(range(0, length(w) - 2, 3), lambda i: substr(w, cast(i AS INTEGER) + 1, 3)), '|') END",
        "ngram_overlapping_fragments": "CASE WHEN length(w) < 4 THEN w ELSE array_to_string(list_transform(range(0, length(w) - 3), lambda i: substr(w, cast(i AS INTEGER) + 1, 4)), '|') END",
    }
    columns = ", ".join(f"{sql} AS {name}" for name, sql in {**single, **lists}.items())
    return f"WITH v AS (SELECT DISTINCT unnest([p_name, p_type, p_brand, split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)]) AS w FROM part) SELECT w AS word, {columns} FROM v"


@BOOK.add(_fixed_sql())
def dq_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part")
    words = names.select(F.explode(F.array("p_name", "p_type", "p_brand", F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2)))).alias("word")).distinct()
    return words.select("word", *[F.array_join(RULES[name](F.col("word")), "|").alias(name) for name in FIXED])


@BOOK.add()
def dq_all_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return words.select("word", *[RULES[name](F.col("word")).alias(name) for name in RULES])
