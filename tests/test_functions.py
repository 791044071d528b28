from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weft.functions import pii
from weft.functions import text as T
from weft.functions import variations as V


def values(spark, column, rows, schema="x string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in df.select(column).collect()]


def test_qgrams(spark):
    assert values(spark, T.qgrams("x", 2), ["smith", "a", "", "ab"]) == [["sm", "mi", "it", "th"], ["a"], [], ["ab"]]
    assert values(spark, T.qgrams("x", 3), ["smith", "ab"]) == [["smi", "mit", "ith"], ["ab"]]
    with pytest.raises(ValueError):
        T.qgrams("x", 0)


def test_clean_text(spark):
    assert values(spark, T.clean_text("x"), ["  Hello, World!  ", "12 Main St.", "", None, "NaN"]) == ["hello world", "12 main st", "", "", ""]


def test_standardize_and_tokens(spark):
    assert values(spark, T.standardize(F.col("x")), ["st", "xyz", "&"]) == ["street", "xyz", "and"]
    rows = [("John Smith", "NaN"), (None, None), ("A & B Co.", "12 Main St")]
    got = values(spark, T.record_tokens(["a", "b"]), rows, "a string, b string")
    assert got == [["john", "smith"], [], ["a", "b", "company", "12", "main", "street"]]
    assert T.merged_normalization({"Ter": "Terrace"})["ter"] == "terrace"


def test_compress_and_resplit(spark):
    got = values(spark, T.compress_tokens("x"), ["O'Brien, 490-46-2048  straße", "", "é_1 -- ,"])
    assert got == [["OBRIEN", "490462048", "STRASSE"], [], ["É_1"]]
    assert values(spark, T.resplit_tokens(F.array(F.col("x"))), ["a-b c", "--", "x"]) == [["a", "b", "c"], [], ["x"]]


def test_jaccard_conventions(spark):
    df = spark.createDataFrame([(["a"], ["a"]), (["a"], ["b"]), (["a", "b"], ["b", "c"]), ([], [])], "a array<string>, b array<string>")
    both = df.select(T.jaccard(F.col("a"), F.col("b"), 1.0), T.jaccard(F.col("a"), F.col("b"), 0.0)).collect()
    assert [r[0] for r in both] == [1.0, 0.0, pytest.approx(1 / 3), 1.0] and both[3][1] == 0.0


def test_keys_and_signatures(spark):
    df = spark.createDataFrame([(["ab", "bc"],), (["bc", "ab", "ab"],), (["x"],), ([],)], "g array<string>")
    keys = [r[0] for r in df.select(T.gram_key("g")).collect()]
    assert keys[0] == keys[1] != keys[2] and keys[3] == "MH_EMPTY" and all(k.startswith("MH_") for k in keys)
    signatures = [r[0] for r in df.limit(3).select(T.minhash_signature("g")).collect()]
    assert signatures[0] == signatures[1] != signatures[2] and len(signatures[0]) == 64


def test_similarity_ratio_rounds_half_to_even(spark):
    rows = [("", ""), ("abc", "abc"), ("abcdefgh", "abcdefgx"), ("ab", "cd")]
    assert values(spark, T.similarity_ratio(F.col("a"), F.col("b")), rows, "a string, b string") == [100, 100, 88, 0]


def test_adjacent_swap(spark):
    rows = [("teh", "the"), ("the", "the"), ("aa", "aa"), ("ab", "ba"), ("abc", "cab"), ("a", "b"), ("", "")]
    assert values(spark, T.adjacent_swap(F.col("a"), F.col("b")), rows, "a string, b string") == [True, False, False, True, False, False, False]


CODES = {c: d for letters, d in T.SOUNDEX.items() for c in letters}


def soundex(token: str) -> str:
    if not token:
        return ""
    token = token.upper()
    out, last = token[0], CODES.get(token[0], "")
    for c in token[1:]:
        code = CODES.get(c, "")
        if code and code != last:
            out += code
        if c not in "HW":
            last = code
    return (out + "000")[:4]


def plain(token: str) -> str:
    out = token.upper()[0]
    for c in token.upper()[1:]:
        if c in CODES and CODES[c] != out[-1]:
            out += CODES[c]
    return (out + "000")[:4]


def test_sound_codes(spark):
    rng = random.Random(1)
    words = ["Robert", "Rupert", "Ashcraft", "Tymczak", "Pfister", "Honeyman", "123", "1bc", "É", "a"] + ["".join(rng.choice("abcdehklmnprstwz1é") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    assert values(spark, T.soundex("x"), [*words, ""]) == [soundex(w) for w in [*words, ""]]
    assert values(spark, T.plain_soundex("x"), words) == [plain(w) for w in words]
    letters = [w for w in words if "a" <= w[0].lower() <= "z" and w.isascii()]
    assert values(spark, F.soundex("x"), letters) == values(spark, T.soundex("x"), letters)


def test_key_functions(spark):
    df = spark.createDataFrame([(["12", "345"],), (["ab", "12"],), ([],)], "k array<string>")
    got = df.select(T.key_size("k"), T.key_mean_length("k"), T.key_type_factor("k", 0.5, 2.0), T.key_length_score("k", 1.0)).collect()
    assert [tuple(r)[:3] for r in got] == [(2, 2.5, 0.5), (2, 2.0, 2.0), (0, 0.0, 2.0)]
    assert got[0][3] == pytest.approx(1 + __import__("math").log(4)) and got[2][3] == 1.0
    path = spark.sql("SELECT array(named_struct('token', 'a', 'present', 1), named_struct('token', 'b', 'present', 0)) AS p")
    assert path.select(T.present_tokens("p")).first()[0] == ["a"]
    assert spark.range(6).select(T.pair_count("id")).collect()[5][0] == 10


def test_personal_fields(spark):
    df = spark.createDataFrame(
        [("1", " Ann ", None, "Lee", "12 Main St., Apt #4", "(501) 555-1234", "490-46-2048", "A@B.C ", "1/2/1990"), ("2", "", None, None, "", None, "", None, "unknown")],
        ", ".join(f"{c} string" for c in pii.FIELDS),
    )
    one, two = pii.normalize_records(df).orderBy("record_id").collect()
    assert (one["first_name"], one["address"], one["phone"], one["ssn"], one["email"], one["dob"]) == ("ann", "12 main street apt 4", "15015551234", "490462048", "a@b.c", "1990-01-02")
    assert one["blocking_tokens"] == ["SSN_490462048", "PHONE_15015551234", "LN_L000", "ADDR_12 main st"]
    assert two["dob"] == "unknown" and two["blocking_tokens"] == [] and two["first_name"] is None


@pytest.mark.parametrize(
    ("a", "b", "nulls", "strict"),
    [(("1", None, None, None), ("1", "x", "y", "z"), True, True), ((None, None, "lee", None), (None, None, "ray", "y"), True, False), ((None, "5", "l", "a"), (None, "6", "l", "a"), True, True), (("", "5", "l", "a"), ("", "6", "m", "a"), False, False)],
)
def test_match_rule(spark, a, b, nulls, strict):
    schema = "struct<ssn:string,phone:string,last_name:string,address:string>"
    df = spark.createDataFrame([(a, b)], f"r1 {schema}, r2 {schema}")
    assert tuple(df.select(pii.is_match("r1", "r2"), pii.is_match("r1", "r2", null_agrees=False)).first()) == (nulls, strict)


def test_extraction(spark):
    rows = ["first_name: Ann; last_name: Lee; phone=5", 'noise {"record_id": 7, "ssn": "1"} noise', "R9, nothing else", "", "{broken"]
    got = pii.extract_records(spark.createDataFrame([(r,) for r in rows], "value string")).collect()
    assert (got[0]["first_name"], got[0]["last_name"], got[0]["phone"], got[0]["record_id"]) == ("Ann", "Lee", "5", "first_name:")
    assert (got[1]["record_id"], got[1]["ssn"]) == ("7", "1") and got[2]["record_id"] == "R9" and got[3]["record_id"] is None


def one(spark, rule, *words):
    df = spark.createDataFrame([(w,) for w in words], "w string")
    return [r[0] for r in df.select(V.RULES[rule](F.col("w"))).collect()]


def test_fixed_variations(spark):
    assert one(spark, "phonetic_substitution", "Phone", "Match", "cat") == [["fone"], ["mach"], ["cat"]]
    assert one(spark, "phonetic_silent_letter_removal", "Knife", "x") == [["nife"], ["x"]]
    assert one(spark, "ortho_regional_spelling", "Color", "colour", "z") == [["colour"], ["color"], ["z"]]
    assert one(spark, "ortho_punctuation_removal", "a.b'c-d_e,f!g\\h") == [["abcdefgh"]]
    assert one(spark, "morph_stemming", "running", "sing", "nations", "cat") == [["runn"], ["sing"], ["nation"], ["cat"]]
    assert one(spark, "abbrev_abbreviation", "Street", "Unknown", "ab") == [["st"], ["unk."], ["ab"]]
    assert one(spark, "abbrev_acronym", "new york city", "nasa") == [["NYC"], ["NASA"]]
    assert one(spark, "abbrev_shortened_form", "Robert", "abcde") == [["rob"], ["abc"]]
    assert one(spark, "ngram_substrings", "abcdefgh", "ab") == [["abc", "def"], ["ab"]]
    assert one(spark, "ngram_overlapping_fragments", "abcdef", "abc") == [["abcd", "bcde", "cdef"], ["abc"]]
    assert one(spark, "token_merge", "a b c") == [["abc"]] and one(spark, "noise_number_substitution", "For") == [["4"]]
    assert one(spark, "phonetic_vowel_shift", "house") == [["hose"]] and one(spark, "phonetic_vowel_shift", "xyz") == [[]]
    assert one(spark, "token_split", "Notebook", "abc") == [["note book"], []]


def test_random_variations_obey_their_rules(spark):
    words = ["frank", "Elm", "z", "", "Kettle", "a b", "12", "école"]
    for w in words:
        got = {rule: one(spark, rule, w)[0] for rule in ("char_insertion", "char_deletion", "char_substitution", "char_transposition", "char_repetition", "char_truncation", "noise_random", "typo_adjacent_key", "unicode_accent", "unicode_lookalike", "token_reorder", "ortho_case_change", "morph_affix")}
        for rule, delta in (("char_insertion", 1), ("char_deletion", -1), ("char_repetition", 1), ("char_substitution", 0), ("char_transposition", 0), ("noise_random", 0), ("typo_adjacent_key", 0), ("unicode_accent", 0)):
            assert all(len(v) == len(w) + delta for v in got[rule]), (rule, w, got[rule])
        assert all(sorted(v) == sorted(w) for v in got["char_transposition"] + got["token_reorder"])
        assert all(w.startswith(v) and len(v) >= len(w) // 2 for v in got["char_truncation"])
        assert all(v.lower() == w.lower() for v in got["ortho_case_change"])
        assert all(any(v == p + w.lower() for p in V.PREFIXES) for v in got["morph_affix"])
        assert all(sum(a != b for a, b in zip(v, w)) == 1 for v in got["char_substitution"] + got["typo_adjacent_key"] + got["unicode_lookalike"])
    assert one(spark, "char_deletion", "a", "") == [[], []] and one(spark, "char_truncation", "ab") == [[]]


def test_all_variations_are_stable(spark):
    df = spark.createDataFrame([("frank",), ("street",)], "w string")
    got = [r[0] for r in df.select(V.all_variations(F.col("w"))).collect()]
    again = [r[0] for r in df.repartition(2).orderBy("w").select(V.all_variations(F.col("w"))).collect()]
    assert got == again and len(V.RULES) == 35 and all(len(v) > 15 for v in got)
