"""Data-quality variations of a word as column expressions.

Each rule maps a word to an array of variants. Random choices are functions of the word and the rule, so a variant
depends on neither partitioning nor run. Rules that the reference semantics skip on short input give an empty array.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.text import lookup

# Fixed values of the rules.
KEYBOARD = {
    "q": "wa", "w": "qeasd", "e": "wrsdf", "r": "etdfg", "t": "ryfgh", "y": "tughj", "u": "yihjk", "i": "uojkl", "o": "ipkl",
    "p": "ol", "a": "qwsz", "s": "awedxz", "d": "serfcx", "f": "drtgvc", "g": "ftyhbv", "h": "gyujnb", "j": "huikmn",
    "k": "jiolm", "l": "kop", "z": "asx", "x": "zsdc", "c": "xdfv", "v": "cfgb", "b": "vghn", "n": "bhjm", "m": "njk",
}
HOMOPHONES = {
    "to": ["too", "two"], "there": ["their", "they're"], "here": ["hear"], "right": ["write"], "know": ["no"],
    "new": ["knew"], "see": ["sea"], "be": ["bee"], "by": ["buy", "bye"], "for": ["four", "fore"], "one": ["won"],
    "ate": ["eight"], "hour": ["our"], "flower": ["flour"], "mail": ["male"], "meet": ["meat"], "piece": ["peace"],
    "plain": ["plane"], "rain": ["reign", "rein"], "sole": ["soul"], "sun": ["son"], "tail": ["tale"], "way": ["weigh"],
    "week": ["weak"], "wear": ["where"],
}
REGIONAL = {
    "color": "colour", "center": "centre", "analyze": "analyse", "defense": "defence", "gray": "grey", "humor": "humour",
    "license": "licence", "organize": "organise", "recognize": "recognise", "flavor": "flavour", "honor": "honour",
    "labor": "labour", "neighbor": "neighbour", "favor": "favour", "behavior": "behaviour", "program": "programme",
    "dialog": "dialogue", "catalog": "catalogue", "realize": "realise", "apologize": "apologise",
}
INFORMAL = {
    "going": "goin", "nothing": "nothin", "something": "somethin", "everything": "everythin", "talking": "talkin",
    "walking": "walkin", "running": "runnin", "because": "cuz", "you": "u", "your": "ur", "are": "r", "before": "b4",
    "great": "gr8", "later": "l8r", "people": "ppl", "please": "plz", "thanks": "thx", "tonight": "2nite",
    "tomorrow": "2moro", "message": "msg",
}
ABBREVIATIONS = {
    "street": "st", "avenue": "ave", "boulevard": "blvd", "drive": "dr", "road": "rd", "mister": "mr", "doctor": "dr",
    "professor": "prof", "january": "jan", "february": "feb", "march": "mar", "april": "apr", "august": "aug",
    "september": "sep", "october": "oct", "november": "nov", "december": "dec", "department": "dept", "company": "co",
    "incorporated": "inc", "limited": "ltd", "approximately": "approx", "maximum": "max", "minimum": "min",
    "number": "no", "telephone": "tel", "versus": "vs",
}
NICKNAMES = {
    "alexander": "alex", "william": "bill", "robert": "rob", "elizabeth": "liz", "jennifer": "jen", "michael": "mike",
    "christopher": "chris", "katherine": "kate", "matthew": "matt", "nicholas": "nick", "jonathan": "jon",
    "benjamin": "ben", "stephanie": "steph", "thomas": "tom", "patricia": "pat", "timothy": "tim", "barbara": "barb",
    "richard": "rick", "nathaniel": "nate", "jessica": "jess",
}
PHONEMES = {
    "tch": "ch", "dge": "j", "ph": "f", "ck": "k", "ce": "se", "ci": "si", "gh": "g", "kn": "n", "wr": "r", "mb": "m",
    "qu": "kw", "x": "ks",
}
SILENT = {
    "knight": "night", "knife": "nife", "know": "no", "kneel": "neel", "wrap": "rap", "write": "rite", "wrong": "rong",
    "wrist": "rist", "gnome": "nome", "gnat": "nat", "thumb": "thum", "lamb": "lam", "bomb": "bom", "comb": "com",
    "debt": "det", "doubt": "dout", "hour": "our", "honest": "onest", "psychology": "sychology",
    "pneumonia": "neumonia", "castle": "casle", "whistle": "wisle",
}
VOWEL_PAIRS = {
    "ou": "o", "er": "or", "ir": "ur", "or": "ar", "ea": "ee", "ai": "ay", "oa": "o", "oo": "u", "ie": "ee", "ei": "ay",
    "au": "aw", "ew": "oo",
}
PREFIXES = ["un", "pre", "mis", "re", "in", "dis", "im", "il", "non", "over", "sub", "super"]
SUFFIXES = ["ing", "tion", "ment", "ness", "less", "ful", "able", "ible", "ity", "ism", "ist", "er", "est", "ly", "ed", "s"]
ACCENTS = {
    "a": "á", "e": "é", "i": "í", "o": "ó", "u": "ú", "A": "Á", "E": "É", "I": "Í", "O": "Ó", "U": "Ú", "n": "ñ", "c": "ç",
}
LOOKALIKES = {"o": "0", "l": "1", "i": "!", "s": "5", "e": "3", "a": "@", "b": "6", "g": "9", "t": "7", "z": "2"}
COMPOUNDS = {
    "notebook": "note book", "football": "foot ball", "bedroom": "bed room", "sunshine": "sun shine",
    "keyboard": "key board", "airport": "air port", "birthday": "birth day", "basketball": "basket ball",
    "rainbow": "rain bow", "sunflower": "sun flower", "doorbell": "door bell", "moonlight": "moon light",
    "bookshelf": "book shelf", "firework": "fire work", "highway": "high way", "downtown": "down town",
    "baseball": "base ball", "classroom": "class room", "newspaper": "news paper", "username": "user name",
}
NUMBERS = {
    "for": "4", "to": "2", "too": "2", "ate": "8", "be": "b", "one": "1", "won": "1", "are": "r", "you": "u", "see": "c",
    "why": "y", "oh": "0", "before": "b4", "great": "gr8", "later": "l8r", "tonight": "2nite",
}
PUNCTUATION = ".'\\-_,!"
VOWELS = "aeiou"
ALPHABET = "abcdefghijklmnopqrstuvwxyz"

Rule = Callable[[Column], Column]


def _none() -> Column:
    return F.array().cast("array<string>")


def _one(value: Column, when: Column | None = None) -> Column:
    return F.array(value) if when is None else F.when(when, F.array(value)).otherwise(_none())


def draw(word: Column, salt: str, n: Column | int) -> Column:
    """A number below n, fixed by word and rule."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(F.xxhash64(word, F.lit(salt)), F.greatest(n, F.lit(1)).cast("long")).cast("int")


def _options(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _pick(word: Column, salt: str, values: Column) -> Column:
    return F.get(values, draw(word, salt, F.size(values)))


def _part(word: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """Characters from a zero-based start."""
    start = F.lit(start) if isinstance(start, int) else start
    length = F.char_length(word) if length is None else F.lit(length) if isinstance(length, int) else length
    return F.substring(word, start + 1, F.greatest(length, F.lit(0)))


def _at(word: Column, i: Column) -> Column:
    return _part(word, i, 1)


def _replaced(word: Column, i: Column, by: Column, length: int = 1) -> Column:
    return F.concat(_part(word, 0, i), by, _part(word, i + length))


def _same_case(letter: Column, by: Column) -> Column:
    return F.when((F.upper(letter) == letter) & (F.lower(letter) != letter), F.upper(by)).otherwise(by)


def _places(word: Column, characters: str, fold: bool) -> Column:
    """Zero-based places of characters of a set."""
    every = F.filter(F.sequence(F.lit(0), F.char_length(word)), lambda i: i < F.char_length(word))
    return F.filter(every, lambda i: _at(F.lower(word) if fold else word, i).isin(*characters))


def _table(mapping: Mapping[str, str], word: Column) -> Column:
    return F.coalesce(lookup(mapping, F.lower(word)), word)


def insertion(w: Column) -> Column:
    i = draw(w, "insertion", F.char_length(w) + 1)
    return _one(F.concat(_part(w, 0, i), _pick(w, "inserted", _options(list(ALPHABET))), _part(w, i)), F.char_length(w) > 0)


def deletion(w: Column) -> Column:
    return _one(_replaced(w, draw(w, "deletion", F.char_length(w)), F.lit("")), F.char_length(w) > 1)


def substitution(w: Column) -> Column:
    i = draw(w, "substitution", F.char_length(w))
    old = _at(w, i)
    by = _pick(w, "substituted", F.filter(_options(list(ALPHABET)), lambda c: c != F.lower(old)))
    return _one(_replaced(w, i, _same_case(old, by)), F.char_length(w) > 0)


def transposition(w: Column) -> Column:
    i = draw(w, "transposition", F.char_length(w) - 1)
    return _one(_replaced(w, i, F.concat(_at(w, i + 1), _at(w, i)), 2), F.char_length(w) > 1)


def repetition(w: Column) -> Column:
    i = draw(w, "repetition", F.char_length(w))
    return _one(F.concat(_part(w, 0, i + 1), _part(w, i)), F.char_length(w) > 0)


def truncation(w: Column) -> Column:
    n = F.char_length(w)
    least = F.floor(n / 2).cast("int")
    return _one(_part(w, 0, least + draw(w, "truncation", n - least)), n > 2)


def _first_pattern(w: Column, rules: Mapping[str, str], otherwise: Column) -> Column:
    """w with the first occurrence of the longest pattern it contains replaced; equal lengths in the table's order."""
    out = otherwise
    for pattern, by in sorted(rules.items(), key=lambda rule: -len(rule[0]))[::-1]:
        at = F.instr(w, pattern)
        out = F.when(at > 0, _replaced(w, at - 1, F.lit(by), len(pattern))).otherwise(out)
    return out


def phonetic_substitution(w: Column) -> Column:
    return _one(_first_pattern(F.lower(w), PHONEMES, F.lower(w)))


def silent_letters(w: Column) -> Column:
    return _one(_table(SILENT, w))


def vowel_shift(w: Column) -> Column:
    low = F.lower(w)
    places = _places(low, VOWELS, False)
    i = _pick(w, "vowel", places)
    other = _pick(w, "vowel for", F.filter(_options(list(VOWELS)), lambda v: v != _at(low, i)))
    shifted = _first_pattern(low, VOWEL_PAIRS, F.when(F.size(places) > 0, _replaced(low, i, other)))
    return F.array_compact(F.array(shifted))


def homophone(w: Column) -> Column:
    options = F.split(lookup({word: " ".join(same) for word, same in HOMOPHONES.items()}, F.lower(w)), " ")
    return _one(F.coalesce(_pick(w, "homophone", options), w))


def regional_spelling(w: Column) -> Column:
    both = {**{uk: us for us, uk in REGIONAL.items()}, **REGIONAL}
    return _one(_table(both, w))


def informal(w: Column) -> Column:
    return _one(_table(INFORMAL, w))


def case_change(w: Column) -> Column:
    letters = F.transform(F.filter(F.split(w, ""), lambda c: c != ""), lambda c, i: F.when(F.pmod(F.xxhash64(w, i), F.lit(2)) == 0, F.upper(c)).otherwise(F.lower(c)))
    return _one(_pick(w, "case", F.array(F.upper(w), F.lower(w), F.initcap(w), F.array_join(letters, ""))))


def punctuation_removal(w: Column) -> Column:
    return _one(F.translate(w, PUNCTUATION, ""))


def _ends(w: Column, n: int) -> Column:
    return F.right(w, F.lit(n))


def inflection(w: Column) -> Column:
    low, n = F.lower(w), F.char_length(w)

    def vowel(k: int) -> Column:
        return F.substring(low, -k, 1).isin(*VOWELS)

    closed = (n >= 3) & ~vowel(1) & vowel(2) & ~vowel(3)
    last, stem = _ends(low, 1), _part(low, 0, n - 1)
    ing = F.when((n > 2) & (last == "e"), F.concat(stem, F.lit("ing"))).when(closed, F.concat(low, last, F.lit("ing"))).otherwise(F.concat(low, F.lit("ing")))
    ed = F.when(last == "e", F.concat(low, F.lit("d"))).when(closed, F.concat(low, last, F.lit("ed"))).otherwise(F.concat(low, F.lit("ed")))
    plural = (
        F.when(last.isin("s", "x", "z") | _ends(low, 2).isin("sh", "ch"), F.concat(low, F.lit("es")))
        .when((last == "y") & (n >= 2) & ~vowel(2), F.concat(stem, F.lit("ies")))
        .otherwise(F.concat(low, F.lit("s")))
    )
    compared = [F.concat(low, F.when(last == "e", F.lit(form[1:])).otherwise(F.lit(form))) for form in ("er", "est")]
    return _one(_pick(w, "inflection", F.array(ing, ed, plural, *compared)), n > 0)


def derivation(w: Column) -> Column:
    low = F.lower(w)
    suffix = _pick(w, "derivation", _options([s for s in SUFFIXES if s not in ("ed", "s", "est")]))
    elided = (_ends(low, 1) == "e") & F.substring(suffix, 1, 1).isin(*VOWELS)
    return _one(F.concat(F.when(elided, _part(low, 0, F.char_length(low) - 1)).otherwise(low), suffix), F.char_length(w) > 0)


def stemming(w: Column) -> Column:
    low, out = F.lower(w), w
    for suffix in sorted(SUFFIXES, key=len, reverse=True)[::-1]:
        root = F.char_length(low) - len(suffix)
        out = F.when(F.endswith(low, F.lit(suffix)) & (root >= 3), _part(low, 0, root)).otherwise(out)
    return _one(out)


def affix(w: Column) -> Column:
    return _one(F.concat(_pick(w, "affix", _options(PREFIXES)), F.lower(w)))


def abbreviation(w: Column) -> Column:
    short = F.when(F.char_length(w) > 3, F.concat(F.lower(_part(w, 0, 3)), F.lit("."))).otherwise(w)
    return _one(F.coalesce(lookup(ABBREVIATIONS, F.lower(w)), short))


def acronym(w: Column) -> Column:
    words = F.filter(F.split(w, r"\s+"), lambda x: x != "")
    initials = F.array_join(F.transform(words, lambda x: F.upper(F.substring(x, 1, 1))), "")
    return _one(F.when(F.contains(w, F.lit(" ")), initials).otherwise(F.upper(w)))


def shortened(w: Column) -> Column:
    return _one(F.coalesce(lookup(NICKNAMES, F.lower(w)), _part(w, 0, F.ceil(F.char_length(w) / 2).cast("int"))))


def adjacent_key(w: Column) -> Column:
    places = _places(w, "".join(KEYBOARD), True)
    i = _pick(w, "key place", places)
    near = F.filter(F.split(lookup(KEYBOARD, F.lower(_at(w, i))), ""), lambda c: c != "")
    return _one(_replaced(w, i, _same_case(_at(w, i), _pick(w, "key", near))), F.size(places) > 0)


def token_split(w: Column) -> Column:
    n = F.char_length(w)
    known = lookup(COMPOUNDS, F.lower(w))
    middle = F.lit(2) + draw(w, "split", n - 3)
    return F.when(known.isNotNull(), F.array(known)).when(n >= 4, F.array(F.concat(_part(w, 0, middle), F.lit(" "), _part(w, middle)))).otherwise(_none())


def token_merge(w: Column) -> Column:
    return _one(F.replace(w, F.lit(" "), F.lit("")))


def token_reorder(w: Column) -> Column:
    words = F.filter(F.split(w, r"\s+"), lambda x: x != "")
    keyed = F.array_sort(F.transform(words, lambda x, i: F.struct(F.xxhash64(w, i, F.lit("reorder")).alias("h"), x.alias("x"))))
    return _one(F.array_join(F.transform(keyed, lambda s: s["x"]), " "), F.size(words) > 1)


def noise(w: Column) -> Column:
    return _one(_replaced(w, draw(w, "noise", F.char_length(w)), draw(w, "digit", 10).cast("string")), F.char_length(w) > 0)


def number_substitution(w: Column) -> Column:
    return _one(_table(NUMBERS, w))


def _mapped_letter(w: Column, mapping: Mapping[str, str], salt: str, fold: bool) -> Column:
    places = _places(w, "".join(mapping), fold)
    i = _pick(w, salt, places)
    letter = F.lower(_at(w, i)) if fold else _at(w, i)
    return _one(_replaced(w, i, lookup(mapping, letter)), F.size(places) > 0)


def accent(w: Column) -> Column:
    return _mapped_letter(w, ACCENTS, "accent", False)


def lookalike(w: Column) -> Column:
    return _mapped_letter(w, LOOKALIKES, "lookalike", True)


def _fragments(w: Column, n: int, step: int) -> Column:
    size = F.char_length(w)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), size - n), F.lit(step))
    return F.when(size < n, F.array(w)).otherwise(F.transform(starts, lambda i: _part(w, i, n)))


def substrings(w: Column, n: int = 3) -> Column:
    return _fragments(w, n, n)


def overlapping_fragments(w: Column, n: int = 4) -> Column:
    return _fragments(w, n, 1)


#: What combinations are drawn from.
POOL: tuple[Rule, ...] = (
    insertion, deletion, substitution, transposition, repetition, phonetic_substitution, case_change, adjacent_key, noise,
    lookalike, accent, affix, stemming,
)


def combination(w: Column) -> Column:
    """Two different rules of the pool in turn, chosen by the word; a rule that gives nothing leaves its input."""
    first = draw(w, "first of two", len(POOL))
    second = F.pmod(first + 1 + draw(w, "second of two", len(POOL) - 1), F.lit(len(POOL)))

    def apply(value: Column, chosen: Column) -> Column:
        out = value
        for k, rule in enumerate(POOL):
            out = F.when(chosen == k, F.coalesce(F.get(rule(value), F.lit(0)), value)).otherwise(out)
        return out

    once = F.transform(F.array(w), lambda v: apply(v, first))
    return F.transform(once, lambda v: apply(v, second))


RULES: dict[str, Rule] = {
    "char_insertion": insertion, "char_deletion": deletion, "char_substitution": substitution,
    "char_transposition": transposition, "char_repetition": repetition, "char_truncation": truncation,
    "phonetic_substitution": phonetic_substitution, "phonetic_silent_letter_removal": silent_letters,
    "phonetic_vowel_shift": vowel_shift, "phonetic_homophone": homophone, "ortho_regional_spelling": regional_spelling,
    "ortho_informal": informal, "ortho_case_change": case_change, "ortho_punctuation_removal": punctuation_removal,
    "morph_inflection": inflection, "morph_derivation": derivation, "morph_stemming": stemming, "morph_affix": affix,
    "abbrev_abbreviation": abbreviation, "abbrev_acronym": acronym, "abbrev_shortened_form": shortened,
    "typo_adjacent_key": adjacent_key, "typo_missed_keystroke": deletion, "typo_double_key_press": repetition,
    "typo_wrong_key_order": transposition, "token_split": token_split, "token_merge": token_merge,
    "token_reorder": token_reorder, "noise_random": noise, "noise_number_substitution": number_substitution,
    "unicode_accent": accent, "unicode_lookalike": lookalike, "ngram_substrings": substrings,
    "ngram_overlapping_fragments": overlapping_fragments, "hybrid_combination": combination,
}
#: Rules without random choice.
FIXED = (
    "phonetic_substitution", "phonetic_silent_letter_removal", "ortho_regional_spelling", "ortho_informal",
    "ortho_punctuation_removal", "morph_stemming", "abbrev_abbreviation", "abbrev_acronym", "abbrev_shortened_form",
    "token_merge", "noise_number_substitution", "ngram_substrings", "ngram_overlapping_fragments",
)


def all_variations(word: Column, rules: list[str] | None = None) -> Column:
    """Distinct variants of a word under all (or the named) rules."""
    return F.array_distinct(F.flatten(F.array(*[RULES[name](word) for name in (rules or RULES)])))
