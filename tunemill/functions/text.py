"""Text expressions that stay in the JVM: trimming, terms, estimates, numbers, URLs, headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that make a document interesting to tuners.
TUNING_TERMS = "afr lambda knock boost timing ignition fuel injector maf map vvt avcs trim duty psi rpm wideband dyno scaling throttle load ecu rom".split()
#: Words that are no query terms.
STOP_WORDS = (
    "the and for with that this from have has was were are you your not can will would should could about into over under than then them they "
    "there their what when where which while been being does doing very just like also some more most much many each other only same"
).split()
TERM = r"[A-Za-z][A-Za-z0-9_/.\-]{2,}"
EDGE = r"[^\p{L}\p{N}_]"


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def has_word(text: Column, words: list[str]) -> Column:
    """Does one of the words stand in text, in any case, between characters that are no letters or digits?"""
    return text.rlike(rf"(?i)(^|{EDGE})({'|'.join(words)})($|{EDGE})")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.coalesce(F.length(text), F.lit(0)) / 4)).cast("int")


def terms(text: Column) -> Column:
    """Lower-cased query terms in order, stop words left out, repeats kept."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(f"({TERM})")), lambda w: F.lower(w)), lambda w: ~w.isin(*STOP_WORDS))


#: Fixed value: a number in evidence.
_NUMBER = r"((?:(?<![\w.)])-)?(?<![A-Za-z0-9.])(?:\d+(?:\.\d+)?|\.\d+))"


def healed(text: Column) -> Column:
    """Digit runs torn apart by blanks, soft hyphens or zero-width spaces, joined. A hyphen never joins."""
    return F.regexp_replace(text, "(?<=[0-9])[    ­​](?=[0-9])", "")


def numbers(text: Column) -> Column:
    """Numbers in text: reference marks and commas removed, a minus only where it can't be a dash, none inside names."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\[REF\s+\d+\]", " "), ",", "")
    return F.transform(F.regexp_extract_all(plain, F.lit(_NUMBER)), lambda x: x.cast("double"))


def collapsed(text: Column) -> Column:
    """Soft hyphens dropped and white space runs made one blank."""
    return F.regexp_replace(F.regexp_replace(text, "­", ""), r"[\s\p{Z}]+", " ")


def file_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_")


def parent_key(source_id: Column) -> Column:
    """What precedes the first `#` of an id."""
    return F.substring_index(source_id, "#", 1)


def rom_id(name: Column) -> Column:
    """10 to 16 hexadecimal digits in a file name, or null."""
    return F.nullif(F.upper(F.regexp_extract(name, r"(?i)(?<![0-9a-f])([0-9a-f]{10,16})(?![0-9a-f])", 1)), F.lit(""))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def is_markup(data: Column) -> Column:
    """Do the first bytes of a file look like HTML?"""
    head = F.lower(F.decode(F.substring(data, 1, 64), "ISO-8859-1"))
    return F.ltrim(head).rlike(r"^(<!doctype html|<html|<head|<!--)")


def tolerant_number(text: Column) -> Column:
    """The first plain number in a text, as a double; null where there is none."""
    return F.regexp_extract(text, r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def quoted_in(quote: Column, source: Column) -> Column:
    """Does the quote stand in the source, white space and soft hyphens aside? Nulls are empty, an empty quote stands everywhere."""
    plain = lambda c: F.trim(collapsed(F.coalesce(c, F.lit(""))))
    return F.contains(plain(source), plain(quote))


def values_in(value: Column, source: Column) -> Column:
    """Does every number of a value stand in the source, as written or without commas?"""
    full = F.trim(collapsed(F.coalesce(source, F.lit(""))))
    bare = F.replace(full, F.lit(","), F.lit(""))
    found = F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(r"(-?\d[\d.,]*)"))
    return F.forall(found, lambda v: F.contains(full, v) | F.contains(bare, F.replace(v, F.lit(","), F.lit(""))))
