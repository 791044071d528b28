"""Normalisation, blocking keys and matching of personal records."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import col, lookup, plain_soundex

FIELDS = ("record_id", "first_name", "middle_name", "last_name", "address", "phone", "ssn", "email", "dob")
#: Address words and their long forms.
ADDRESS_WORDS = {"st": "street", "rd": "road", "ave": "avenue", "blvd": "boulevard"}


def _given(c: str | Column) -> Column:
    """The text, null where empty."""
    return F.when(col(c) != "", col(c))


def normalize_name(c: str | Column) -> Column:
    return F.trim(F.lower(_given(c)))


normalize_email = normalize_name


def normalize_address(c: str | Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(_given(c)), r"[^\p{L}\p{N}_\s]", ""), r"\s+")
    kept = F.filter(words, lambda w: w != "")
    return F.array_join(F.transform(kept, lambda w: F.coalesce(lookup(ADDRESS_WORDS, w), w)), " ")


def _digits(c: str | Column) -> Column:
    return F.regexp_replace(_given(c), r"[^0-9]", "")


def normalize_phone(c: str | Column) -> Column:
    digits = _digits(c)
    return F.when(F.length(digits) == 10, F.concat(F.lit("1"), digits)).otherwise(digits)


def normalize_ssn(c: str | Column) -> Column:
    return _digits(c)


def normalize_dob(c: str | Column) -> Column:
    """Month/day/year as ISO; anything else stays."""
    given = _given(c)
    return F.coalesce(F.date_format(F.try_to_timestamp(given, F.lit("M/d/yyyy")), "yyyy-MM-dd"), given)


def blocking_tokens() -> Column:
    """Keys of a normalised record: SSN_, PHONE_, LN_ with a sound code, ADDR_ with ten characters; none for nulls."""
    def keyed(prefix: str, value: Column, when: str) -> Column:
        return F.when(F.col(when) != "", F.concat(F.lit(prefix), value))

    return F.array_compact(
        F.array(
            keyed("SSN_", F.col("ssn"), "ssn"),
            keyed("PHONE_", F.col("phone"), "phone"),
            keyed("LN_", plain_soundex("last_name"), "last_name"),
            keyed("ADDR_", F.substring("address", 1, 10), "address"),
        )
    )


def normalize_records(records: DataFrame) -> DataFrame:
    """All fields normalised, with blocking_tokens."""
    rules = {
        "first_name": normalize_name, "last_name": normalize_name, "address": normalize_address, "phone": normalize_phone,
        "ssn": normalize_ssn, "email": normalize_email, "dob": normalize_dob,
    }
    missing = {c: F.lit(None).cast("string") for c in FIELDS if c not in records.columns}
    done = records.withColumns(missing).withColumns({c: rule(c) for c, rule in rules.items()}) if missing else records.withColumns({c: rule(c) for c, rule in rules.items()})
    return done.withColumn("blocking_tokens", blocking_tokens())


def is_match(a: str, b: str, null_agrees: bool = True) -> Column:
    """Equal SSN, else at least two points: phone 2, last name 1, address 1. Two missing values agree unless told
    otherwise."""
    def x(name: str) -> tuple[Column, Column]:
        return F.col(f"{a}.{name}"), F.col(f"{b}.{name}")

    def points(name: str, n: int) -> Column:
        left, right = x(name)
        same = left.eqNullSafe(right) if null_agrees else F.coalesce(left == right, F.lit(False))
        return F.when(same, n).otherwise(0)

    left, right = x("ssn")
    ssn = F.coalesce((left != "") & (left == right), F.lit(False))
    return ssn | (points("phone", 2) + points("last_name", 1) + points("address", 1) >= 2)


def labelled_fields(text: str) -> dict[str, str | None]:
    """Default extractor: 'name: value' or 'name=value' pairs, or a JSON object, anywhere in a text."""
    found = re.search(r"\{.*\}", text, re.S)
    out: dict[str, str | None] = dict.fromkeys(FIELDS)
    if found:
        try:
            out.update({k: None if v is None else str(v) for k, v in json.loads(found.group()).items() if k in out})
        except ValueError:
            pass
    else:
        for name, value in re.findall(rf"\b({'|'.join(FIELDS)})\s*[:=]\s*([^;|\n]+)", text):
            out[name] = value.strip()
    if not out["record_id"]:
        words = re.split(r"[\s,]+", text.strip(), maxsplit=1)
        out["record_id"] = words[0] if words and words[0] else None
    return out


def extract_records(raw: DataFrame, text_col: str = "value", extractor: Callable[[str], dict[str, str | None]] = labelled_fields) -> DataFrame:
    """One record per line by a pluggable extractor, batch by batch; a language model can be plugged in here."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([extractor(text or "") for text in batch[text_col]], columns=list(FIELDS), dtype=object)

    return raw.select(text_col).mapInPandas(run, ", ".join(f"{name} string" for name in FIELDS))
