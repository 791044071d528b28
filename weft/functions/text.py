"""String, token and key functions as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Anything that is not a letter, a digit or an underscore, in any script.
NON_WORD = r"[^\p{L}\p{N}_]+"

#: Abbreviations that record tokens are expanded by.
NORMALIZATION = {
    "st": "street", "str": "street", "rd": "road", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "boul": "boulevard",
    "ln": "lane", "dr": "drive", "ct": "court", "pl": "place", "sq": "square", "hwy": "highway", "pkwy": "parkway",
    "apt": "apartment", "ste": "suite", "n": "north", "s": "south", "e": "east", "w": "west", "co": "company",
    "inc": "incorporated", "corp": "corporation", "llc": "limitedliabilitycompany", "ltd": "limited", "intl": "international",
    "mfg": "manufacturing", "&": "and",
}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_map(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def lookup(mapping: Mapping[str, str], value: Column) -> Column:
    """mapping[value], null where it has no entry."""
    return F.try_element_at(literal_map(mapping), value) if mapping else F.lit(None).cast("string")


def text_of(c: str | Column) -> Column:
    """Null and NaN read as an empty text."""
    text = col(c).cast("string")
    return F.coalesce(F.when(text != "NaN", text), F.lit(""))


def compress_tokens(body: str | Column, delimiter: str = ",") -> Column:
    """Upper-cased tokens of a record body: the delimiter separates like white space, other non-word characters vanish
    from inside tokens, empty tokens are dropped (C1)."""
    spaced = F.replace(F.upper(col(body)), F.lit(delimiter), F.lit(" "))
    # Over the whole text at once: removing characters from inside tokens does not move their borders.
    return F.array_remove(F.split(F.regexp_replace(spaced, r"[^\p{L}\p{N}_\s]+", ""), r"\s+"), "")


def resplit_tokens(tokens: str | Column) -> Column:
    """Tokens split again at their non-word characters."""
    pieces = F.transform(col(tokens), lambda t: F.split(F.trim(F.regexp_replace(t, NON_WORD, " ")), " "))
    return F.filter(F.flatten(pieces), lambda t: t != "")


def clean_text(text: str | Column) -> Column:
    """Lower case, non-word characters and white space squeezed to single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text_of(text)), NON_WORD, " "), r"\s+", " "))


def standardize(token: Column, mapping: Mapping[str, str] = NORMALIZATION) -> Column:
    """The mapped form of a token, or the token (C4)."""
    return F.coalesce(lookup(mapping, token), token)


def merged_normalization(extra: Mapping[str, str], base: Mapping[str, str] = NORMALIZATION) -> dict[str, str]:
    """base with lower-cased additions."""
    return {**base, **{k.lower(): v.lower() for k, v in extra.items()}}


def record_tokens(columns: list[str], mapping: Mapping[str, str] = NORMALIZATION) -> Column:
    """Tokens of several columns joined, cleaned and standardised."""
    joined = F.concat_ws(" ", *[F.when(text_of(c) != "", text_of(c)) for c in columns])
    tokens = F.filter(F.split(clean_text(joined), " "), lambda t: t != "")
    return F.transform(tokens, lambda t: standardize(t, mapping))


def qgrams(token: str | Column, q: int) -> Column:
    """Overlapping substrings of length q; a shorter token is its own gram, an empty one has none."""
    if q <= 0:
        raise ValueError("q must be positive")
    token = col(token)
    size = F.char_length(token)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), size - q + 1)), lambda i: F.substring(token, i, F.lit(q)))
    return F.when(size == 0, F.array().cast("array<string>")).when(size < q, F.array(token)).otherwise(grams)


def stable_hash(text: Column) -> Column:
    """The first four bytes of SHA-1 as an unsigned integer."""
    return F.conv(F.substring(F.sha1(text), 1, 8), 16, 10).cast("long")


def minhash_signature(grams: str | Column, num_perm: int = 64, seed: int = 42) -> Column:
    """num_perm minima of seeded hashes over the grams."""
    seeds = F.sequence(F.lit(seed), F.lit(seed + num_perm - 1))
    return F.transform(seeds, lambda s: F.array_min(F.transform(col(grams), lambda g: F.xxhash64(s, g))))


def gram_key(grams: str | Column) -> Column:
    """One key per set of grams, MH_EMPTY for none (C11). A hash of the whole signature separates different gram sets
    as surely as a hash of the sorted set itself, which is cheaper."""
    grams = col(grams)
    digest = F.substring(F.sha2(F.array_join(F.array_sort(F.array_distinct(grams)), "\x1f"), 256), 1, 16)
    return F.when(F.size(grams) > 0, F.concat(F.lit("MH_"), digest)).otherwise("MH_EMPTY")


def jaccard(a: Column, b: Column, both_empty: float) -> Column:
    """Jaccard similarity of two arrays as sets; both_empty where neither has an element (C12: 1, C13: 0)."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def similarity_ratio(a: Column, b: Column) -> Column:
    """100 (1 - distance / longer length), rounded half to even; 100 for two empty texts."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longer == 0, 100).otherwise(F.bround(100 * (1 - F.levenshtein(a, b) / longer)).cast("int"))


def adjacent_swap(a: Column, b: Column) -> Column:
    """Whether b is a with two neighbouring different characters exchanged (C17)."""
    n = F.char_length(a)

    def swapped(i: Column) -> Column:
        return F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, n))

    places = F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1))
    return (n == F.char_length(b)) & (n > 1) & (a != b) & F.exists(places, lambda i: swapped(i) == b)


#: Soundex codes.
SOUNDEX = {"BFPV": "1", "CGJKQSXZ": "2", "DT": "3", "L": "4", "MN": "5", "R": "6"}


def _codes(letter: Column) -> Column:
    return F.translate(letter, "".join(SOUNDEX), "".join(code * len(letters) for letters, code in SOUNDEX.items()))


def _coded(letter: Column) -> Column:
    return letter.rlike("^[BCDFGJKLMNPQRSTVXZ]$")


def soundex(token: str | Column) -> Column:
    """Four-character Soundex: letters H and W are transparent, any other uncoded character resets; '' for ''. Unlike the
    built-in it also codes tokens that do not start with a letter (C18)."""
    upper = F.upper(col(token))
    first = F.substring(upper, 1, 1)

    def step(state: Column, letter: Column) -> Column:
        code = F.when(_coded(letter), _codes(letter)).otherwise("")
        out = F.when((code != "") & (code != state["last"]), F.concat(state["out"], code)).otherwise(state["out"])
        return F.struct(out.alias("out"), F.when(letter.isin("H", "W"), state["last"]).otherwise(code).alias("last"))

    start = F.struct(first.alias("out"), F.when(_coded(first), _codes(first)).otherwise("").alias("last"))
    rest = F.filter(F.split(F.substring(upper, F.lit(2), F.char_length(upper)), ""), lambda c: c != "")
    return F.when(upper == "", "").otherwise(F.rpad(F.substring(F.aggregate(rest, start, step)["out"], 1, 4), 4, "0"))


def plain_soundex(name: str | Column) -> Column:
    """Simplified Soundex: a code is added unless it equals the last character written; nothing resets."""
    upper = F.upper(col(name))

    def step(out: Column, letter: Column) -> Column:
        code = _codes(letter)
        return F.when(_coded(letter) & (code != F.right(out, F.lit(1))), F.concat(out, code)).otherwise(out)

    rest = F.filter(F.split(F.substring(upper, F.lit(2), F.char_length(upper)), ""), lambda c: c != "")
    return F.when(upper == "", F.lit(None)).otherwise(F.rpad(F.substring(F.aggregate(rest, F.substring(upper, 1, 1), step), 1, 4), 4, "0"))


def key_size(key: str | Column) -> Column:
    """Number of tokens in a block key (C20)."""
    return F.size(col(key))


def key_mean_length(key: str | Column) -> Column:
    """Mean length of a key's tokens, 0 for none (C20)."""
    key = col(key)
    total = F.aggregate(key, F.lit(0), lambda n, t: n + F.char_length(t))
    return F.when(F.size(key) == 0, 0.0).otherwise(total / F.size(key))


def present_tokens(path: str | Column) -> Column:
    """Tokens of a path of (token, present) steps that are present."""
    return F.transform(F.filter(col(path), lambda s: s["present"] == 1), lambda s: s["token"])


def key_length_score(key: str | Column, weight: float) -> Column:
    """1 + weight ln(1 + longest token), 1 for an empty key."""
    key = col(key)
    if weight == 0.0:
        return F.lit(1.0)
    return F.when(F.size(key) == 0, 1.0).otherwise(1.0 + weight * F.log1p(F.array_max(F.transform(key, F.char_length))))


def is_number(token: Column) -> Column:
    return token.rlike(r"^\p{Nd}+$")


def key_type_factor(key: str | Column, numeric: float, word: float) -> Column:
    """The numeric factor for keys of digits only, else the word factor, also for an empty key."""
    key = col(key)
    return F.when((F.size(key) > 0) & F.forall(key, is_number), numeric).otherwise(word)


def pair_count(n: str | Column) -> Column:
    """Unordered pairs among n."""
    n = col(n).cast("long")
    return (n * (n - 1) / 2).cast("long")
