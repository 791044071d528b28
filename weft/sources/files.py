"""Readers of record, truth, word-list, tabular and run files, and writers of clusters, blocks, metrics and reports.

Everything is read and written through Spark, so paths may lie in any store it knows. A path may be a folder of files: each file
has its own header, and files follow each other by name. Where a later row replaces an earlier one of equal id, that order
decides: a line's place is (file, start of its split, place in the split), whatever way Spark deals splits to tasks.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions.text import compress_tokens


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, value): trimmed lines; seq (file, start, line) sorts them in the order of files and of lines within."""
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line")
    )
    return spark.read.text(path).select(place.alias("seq"), F.trim(F.regexp_replace("value", r"^\x{FEFF}|[\r\t]+$", "")).alias("value"))


def _without_header(lines: DataFrame) -> DataFrame:
    """All lines but the first of each file (a minimum per file, not a sort)."""
    heads = lines.where("seq.start = 0").groupBy(F.col("seq.file").alias("head_of")).agg(F.min("seq.line").alias("head"))
    return lines.join(heads, (F.col("seq.file") == F.col("head_of")) & (F.col("seq.line") == F.col("head")), "left_anti")


def _last_by(rows: DataFrame, key: str) -> DataFrame:
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "seq").alias("r"), F.min("seq").alias("first_seq"))
    return newest.select(key, "r.*", "first_seq")


def read_records(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """(ref_id, tokens, seq) of a delimited file with a header: id before the first delimiter, the rest is one body.

    Lines that are blank or lack the delimiter are skipped. A repeated id keeps its first place and its last body. seq orders rows.
    """
    lines = _without_header(_numbered_lines(spark, path)).where((F.col("value") != "") & F.contains("value", F.lit(delimiter)))
    at = F.instr("value", delimiter)
    split = lines.select("seq", F.trim(F.substring("value", F.lit(1), at - 1)).alias("ref_id"), F.substring(F.col("value"), at + len(delimiter), F.char_length("value")).alias("body"))
    last = _last_by(split, "ref_id")
    return last.select("ref_id", compress_tokens("body", delimiter).alias("tokens"), F.col("first_seq").alias("seq"))


def table_records(df: DataFrame, id_col: str, text_col: str, limit: int | None = None, last_by: str | None = None) -> DataFrame:
    """(ref_id, tokens) of a table; limit keeps the first so many tokens of each record.

    A table has no order of its own, so rows of equal or null ids stay records of their own. With last_by, a column that orders
    them, the last row of each id replaces the others, as in a file.
    """
    if last_by is not None:
        newest = df.groupBy(F.col(id_col)).agg(F.max_by(F.struct(F.col(text_col).alias("text")), F.struct(F.col(last_by), F.col(text_col))).alias("r"))
        return table_records(newest.select(F.col(id_col), F.col("r.text").alias("text")), id_col, "text", limit)
    tokens = compress_tokens(F.coalesce(F.col(text_col), F.lit("")))
    return df.select(F.col(id_col).alias("ref_id"), (F.slice(tokens, 1, limit) if limit else tokens).alias("tokens"))


def load_dict(spark: SparkSession, path: str) -> DataFrame:
    """(ref_id, tokens) of a file that holds one dictionary literal or JSON object of token lists.

    A literal is parsed, never evaluated. The file is one document by its format, so it is read as one row.
    """
    text = spark.read.text(path, wholetext=True)
    as_json = F.udf(_as_json, "string")  # once per file, not per record
    parsed = text.select(F.posexplode(F.from_json(as_json("value"), "map<string,array<string>>")).alias("seq", "ref_id", "tokens"))
    return parsed.select("ref_id", "tokens", F.col("seq").cast("long").alias("seq"))


def _as_json(text: str | None) -> str | None:
    """A dictionary literal as JSON."""
    if text is None:
        return None
    value = ast.literal_eval(text)
    return json.dumps({str(k): [str(t) for t in v] for k, v in value.items()})


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(ref_id, truth_id) of a comma-separated file with header; short lines are skipped, the last of equal ids wins (S3)."""
    parts = F.split("value", ",")
    lines = _without_header(_numbered_lines(spark, path)).where(F.size(parts) >= 2)
    rows = lines.select("seq", F.trim(parts[0]).alias("ref_id"), F.trim(parts[1]).alias("truth_id"))
    return _last_by(rows, "ref_id").select("ref_id", "truth_id")


def truth_file(name: str, directory: str) -> str | None:
    """The truth file of a data set by its name: any P means poor quality, else any G good."""
    stem = name.replace("\\", "/").rsplit("/", 1)[-1].upper()
    kind = "poorDQ" if "P" in stem else "goodDQ" if "G" in stem else None
    return f"{directory}/truthABC{kind}.txt" if kind else None


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(word) of a newline list, trimmed, distinct, without blanks."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV table with header (S6). Give a schema in production: inferring one reads the file twice."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_first_column(spark: SparkSession, path: str) -> DataFrame:
    """(value): the first column of a CSV file without header."""
    rows = spark.read.option("header", False).csv(path)
    return rows.select(F.col("_c0").alias("value")).where(F.col("value").isNotNull())


#: Words that made-up people and addresses consist of.
FIRST = ("Ada", "Bruno", "Carla", "Dmitri", "Esther", "Farid", "Greta", "Hugo", "Ines", "Jonas", "Katya", "Leo")
LAST = ("Abbott", "Becker", "Castillo", "Dvorak", "Eriksen", "Fontaine", "Grigoryan", "Hoffmann", "Iversen", "Jankowski", "Kowal", "Lindqvist")
STREETS = ("Almond", "Birch", "Canal", "Dogwood", "Ember", "Foundry", "Granite", "Harbour", "Ivy", "Juniper")
SUFFIXES = (("Crescent", "Cres"), ("Terrace", "Ter"), ("Boulevard", "Blvd"), ("Court", "Ct"), ("Parade", "Pde"))
CITIES = ("Aldermoor", "Brackwater", "Copperfield", "Dunmere", "Eastholm", "Fernleigh")


def sample_records(spark: SparkSession, n_rows: int, duplicate_ratio: float = 0.3, seed: int = 42) -> DataFrame:
    """(RecID, Name, Address, City, source_id): clean records, the last share of which repeat an earlier one with noise.

    Noise is a dropped, doubled or swapped letter, an initial for the first name, an abbreviated street suffix, a city left out: one
    kind at least, each of the others as well with some chance.
    Everything is a function of the row number and the seed, so any partitioning gives the same table.
    """
    clean = n_rows - int(n_rows * duplicate_ratio)

    def draw(salt: str, row: Column, n: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(f"{seed}:{salt}"), row), F.lit(n)).cast("int")

    def pick(options: tuple[str, ...], salt: str, row: Column) -> Column:
        return F.element_at(F.array(*[F.lit(o) for o in options]), draw(salt, row, len(options)) + 1)

    rows = spark.range(n_rows).select(F.col("id"), F.when(F.col("id") < clean, F.col("id")).otherwise(draw("source", F.col("id"), max(1, clean))).cast("long").alias("source_id"))
    s = F.col("source_id")
    kinds = ("drop", "double", "swap", "initial", "suffix", "city")

    def noisy(kind: str) -> Column:
        """Whether a repeat has a kind of noise; of the three on letters the first that it has counts."""
        sure = draw("noise", F.col("id"), len(kinds)) == kinds.index(kind)
        return (F.col("id") >= clean) & (sure | (draw(f"also {kind}", F.col("id"), 4) == 0))

    first, last = pick(FIRST, "first", s), pick(LAST, "last", s)
    at = draw("at", F.col("id"), 3) + 2
    typo = (
        F.when(noisy("drop"), F.concat(F.substring(last, F.lit(1), at - 1), F.substring(last, at + 1, F.lit(50))))
        .when(noisy("double"), F.concat(F.substring(last, F.lit(1), at), F.substring(last, at, F.lit(50))))
        .when(noisy("swap"), F.concat(F.substring(last, F.lit(1), at - 2), F.substring(last, at, F.lit(1)), F.substring(last, at - 1, F.lit(1)), F.substring(last, at + 1, F.lit(50))))
        .otherwise(last)
    )
    name = F.concat_ws(" ", F.when(noisy("initial"), F.substring(first, 1, 1)).otherwise(first), typo)
    kind = draw("suffix", s, len(SUFFIXES))
    long, short = (F.element_at(F.array(*[F.lit(x[k]) for x in SUFFIXES]), kind + 1) for k in (0, 1))
    address = F.concat_ws(" ", (draw("number", s, 999) + 1).cast("string"), pick(STREETS, "street", s), F.when(noisy("suffix"), short).otherwise(long))
    city = F.when(noisy("city"), "").otherwise(pick(CITIES, "city", s))
    return rows.select((F.col("id") + 1).alias("RecID"), name.alias("Name"), address.alias("Address"), city.alias("City"), (s + 1).alias("source_id"))


def cluster_documents(clusters: DataFrame, records: DataFrame, include_singletons: bool = True) -> DataFrame:
    """(cluster_id, size, records): nested members with their tokens, from clusters(ref_id, cluster_id)."""
    joined = clusters.join(records.select("ref_id", "tokens"), "ref_id", "left")
    nested = joined.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list(F.struct("ref_id", "tokens"))).alias("records")
    )
    return nested if include_singletons else nested.where("size > 1")


def write_clusters(clusters: DataFrame, records: DataFrame, path: str, include_singletons: bool = True) -> None:
    cluster_documents(clusters, records, include_singletons).write.mode("overwrite").json(path)


def config_suffix(merge: bool, purge: bool) -> str:
    """File suffix of a configuration."""
    return f"_m{int(merge)}_p{int(purge)}"


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A one-row metrics frame as JSON beside a readable log."""
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}.metrics.json")
    lines = F.array(*[F.concat(F.lit(f"{c}: "), F.coalesce(F.to_json(F.struct(c)), F.lit(""))) for c in metrics.columns])
    metrics.coalesce(1).select(F.explode(lines).alias("value")).write.mode("overwrite").text(f"{path}.metrics.log")


def flat_blocks(members: DataFrame, records: DataFrame, separator: str = " ") -> DataFrame:
    """(label, ref_id, tokens): one row per membership, as text columns."""
    return members.join(records.select("ref_id", "tokens"), "ref_id").select(
        F.array_join("key", separator).alias("label"), "ref_id", F.array_join("tokens", separator).alias("tokens")
    )


def write_csv(df: DataFrame, path: str) -> None:
    """A flat frame as CSV with header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def collect_runs(spark: SparkSession, folder: str, fields: Mapping[str, str]) -> DataFrame:
    """One row per run of an experiment folder: runs(read_runs) of its *.metrics.json, joined with the invocation.json beside them
    (columns group, config_id and command). An invocation that left no metrics yields a row whose error says so (S18)."""
    own = "^(.*)/([^/]*)/([^/]*)/[^/]*$"  # group, configuration
    asked = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "invocation.json").text(folder, wholetext=True)
    asked = asked.select(
        F.regexp_extract("_metadata.file_path", own, 2).alias("group"), F.regexp_extract("_metadata.file_path", own, 3).alias("config_id"),
        F.get_json_object("value", "$.command").alias("command"),
    )
    found = read_runs(spark, folder, fields, "*.metrics.json")
    found = found.withColumns({"group": F.regexp_extract("file", own, 2), "config_id": F.regexp_extract("file", own, 3)})
    joined = asked.join(found, ["group", "config_id"], "full")
    error = F.when(F.col("file").isNull(), "missing").otherwise(F.col("error"))
    return joined.select("group", "config_id", "command", "file", *fields, error.alias("error"))


def read_runs(spark: SparkSession, paths: list[str] | str, fields: Mapping[str, str], named: str | None = None) -> DataFrame:
    """Flat rows of nested metrics files (S18): fields maps an output name to a dotted path. A path that a file lacks reads
    null, and a file that is no JSON object becomes a row whose error column says so. named looks in all folders below, for files of such names."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", named) if named else spark.read
    text = reader.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    broken = F.get_json_object("value", "$").isNull()
    values = [F.get_json_object("value", f"$.{path}").alias(name) for name, path in fields.items()]
    return text.select("file", *values, F.when(broken, "unreadable").alias("error"))


def numbered(df: DataFrame, order: list[str | Column], name: str = "n") -> DataFrame:
    """df with row numbers over a total order. One task ranks all rows: for report tables only."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))
