"""Keys of texts and JSON states, and hash buckets, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "[ \\t\\n\\x0B\\f\\r]+"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalized(text) -> Column:
    """Lower case with sharp s as ss, runs of ASCII white space as one space, no space at the ends."""
    return F.trim(F.regexp_replace(F.replace(F.lower(col(text)), F.lit("ß"), F.lit("ss")), SPACE, " "))


def digest(text) -> Column:
    return F.sha2(col(text), 256)


def json_digest(state) -> Column:
    """Equal for JSON values that differ in key order or spacing only. What is no JSON value, or an object in which a
    key repeats, has the digest of its normal form as a text."""
    return F.coalesce(F.sha2(F.to_json(F.try_parse_json(col(state))), 256), digest(normalized(state)))


def state_key(text, kind=None) -> Column:
    """Of a text by its normal form; of JSON, where kind is 'json', by its canonical form."""
    plain = digest(normalized(text))
    return plain if kind is None else F.when(col(kind) == "json", json_digest(text)).otherwise(plain)


def content_atoms(text, least: int = 32) -> Column:
    """Digests of the sentences (cut at newlines and full stops) with that many normalised characters or more."""
    parts = F.transform(F.split(col(text), "[\n.]"), normalized)
    return F.transform(F.array_distinct(F.filter(parts, lambda x: F.length(x) >= least)), lambda x: F.sha2(x, 256))


def leaf_strings(state) -> Column:
    """The string leaves of a JSON value at any depth: strings that no colon follows in the canonical form. What is no
    JSON value, or an object in which a key repeats, is one leaf as a whole.

    Escaped backslashes and quotes stand as control characters meanwhile, which JSON never holds as they are.
    """
    marked = F.replace(F.replace(F.to_json(F.try_parse_json(col(state))), F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    strings = F.regexp_extract_all(marked, F.lit('"[^"]*+":?+'), F.lit(0))
    found = F.array_join(F.filter(strings, lambda x: ~F.endswith(x, F.lit(":"))), ",")
    back = F.replace(F.replace(found, F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
    leaves = F.from_json(F.concat(F.lit("["), back, F.lit("]")), "array<string>")
    return F.coalesce(leaves, F.when(col(state).isNotNull(), F.array(col(state))))


def leaf_atoms(state, least: int = 32) -> Column:
    """Digests of whole leaf strings with that many normalised characters or more."""
    whole = F.filter(F.transform(leaf_strings(state), normalized), lambda x: F.length(x) >= least)
    return F.transform(F.array_distinct(whole), lambda x: F.sha2(x, 256))


def bucket(key, kind: str = "sha256") -> Column:
    """From 0 to 1 by a key's hash: SHA-256 over 2**32, or SHA-1 over 2**32 - 1."""
    hashed, top = (F.sha2(col(key), 256), 4294967296.0) if kind == "sha256" else (F.sha1(col(key)), 4294967295.0)
    return F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") / top


def seeded(seed, *keys) -> Column:
    """A hash to order rows by, instead of a shuffle."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *(col(k).cast("string") for k in keys)), 256)
