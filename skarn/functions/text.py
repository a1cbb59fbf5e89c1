"""Scalar functions: slugs, identifiers, hashes, urls, dates and quoting."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The alphabet of time-ordered identifiers and the same digits in base 32.
ULID_DIGITS, BASE32_DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: Start and factor of FNV-1a, 32 bits.
FNV_START, FNV_PRIME = 2166136261, 16777619


#: Shown where there is no value.
NOTHING = "\u2014"


def slugify(text: Column, most: int = 100) -> Column:
    """Lower case, runs of other characters as one dash, none at the ends, ``most`` characters; null if nothing is left."""
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    cut = F.regexp_replace(F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, most), "-+$", "")
    return F.when(cut != "", cut)


def document_id(full_name: Column) -> Column:
    """owner/name with the first slash replaced by two underscores."""
    at = F.instr(full_name, "/")
    return F.when(at > 0, F.concat(F.substr(full_name, F.lit(1), at - 1), F.lit("__"), F.substr(full_name, at + 1))).otherwise(full_name)


def full_name(document: Column) -> Column:
    """The opposite of document_id."""
    at = F.instr(document, "__")
    return F.when(at > 0, F.concat(F.substr(document, F.lit(1), at - 1), F.lit("/"), F.substr(document, at + 2))).otherwise(document)


def is_repo_name(name: Column) -> Column:
    return F.regexp_like(name, F.lit(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$"))


def is_safe_name(name: Column) -> Column:
    """A name whose parts can't leave their folder."""
    return is_repo_name(name) & ~F.array_contains(F.split(name, "/"), "..")


def is_store_id(value: Column) -> Column:
    return F.coalesce(F.regexp_like(value, F.lit(r"^[A-Za-z0-9_-]+$")) & (F.length(value) <= 250) & ~value.isin("undefined", "null"), F.lit(False))


def is_https(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")) == "https", F.lit(False))


def normal_url(url: Column) -> Column:
    """Lower case, without trailing slashes and .git: the key that listings are joined by."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), "/+$", ""), r"\.git$", "")


def encode_component(text: Column) -> Column:
    """Percent-encodes all but letters, digits and -_.!~*'() of a text."""
    coded = F.url_encode(text)
    for code, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(code), F.lit(plain))
    return coded


def ulid_millis(ulid: Column) -> Column:
    """The time of a time-ordered identifier, in milliseconds."""
    return F.conv(F.translate(F.substring(F.upper(ulid), 1, 10), ULID_DIGITS, BASE32_DIGITS), 32, 10).cast("long")


def day_bucket(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def content_hash(*columns: Column) -> Column:
    """First 32 hex digits of the SHA-256 of the columns as JSON, nulls included."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256), 1, 32)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of an ASCII text, unsigned."""
    codes = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substr(text, i, F.lit(1))).cast("long"))
    step = lambda h, c: (h.bitwiseXOR(c) * FNV_PRIME).bitwiseAND(0xFFFFFFFF)
    return F.when(F.length(text) > 0, F.aggregate(codes, F.lit(FNV_START).cast("long"), step)).otherwise(F.lit(FNV_START).cast("long"))


def shard_of(name: Column, shards: int) -> Column:
    """The worker that owns a name: the hash as a signed value, without sign, modulo the shards."""
    h = fnv1a(name)
    signed = F.when(h >= 2**31, h - 2**32).otherwise(h)
    return F.abs(signed) % shards


def monogram(name: Column) -> Column:
    letter = F.upper(F.regexp_extract(name, "[A-Za-z0-9]", 0))
    return F.struct(F.when(letter == "", F.lit("?")).otherwise(letter).alias("letter"), (fnv1a(name) % 360).alias("hue"))


def relative_time(ts: Column, now: Column) -> Column:
    """``5m ago``, ``7h ago`` up to 48 hours, then days; a dash without a time. Times to come are ``0m ago``."""
    minutes = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 60e6)
    hours = F.floor(minutes / 60)
    label = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return F.when(minutes.isNull(), F.lit(NOTHING)).when(hours < 1, label(F.greatest(minutes, F.lit(0)), "m")).when(hours < 48, label(hours, "h")).otherwise(label(F.floor(hours / 24), "d"))


def duration(millis: Column) -> Column:
    """``42s``, ``7m`` or ``3h05m``; a dash for null."""
    seconds = F.floor(millis / 1000 + 0.5)
    minutes = F.floor(seconds / 60)
    long = F.concat(F.floor(minutes / 60).cast("string"), F.lit("h"), F.lpad((minutes % 60).cast("string"), 2, "0"), F.lit("m"))
    return F.when(millis.isNull(), F.lit(NOTHING)).when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s"))).when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"))).otherwise(long)


def date_label(ts: Column) -> Column:
    """``Jan 5, 2024``, in the session's time zone (UTC for labels that don't depend on the reader)."""
    return F.date_format(ts, "MMM d, yyyy")


def shell_quote(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def decode_base64(content: Column) -> Column:
    return F.decode(F.unbase64(F.regexp_replace(content, r"\s", "")), "UTF-8")


def cut_bytes(text: Column, most: int) -> Column:
    """At most ``most`` UTF-8 bytes, cut at a character's end: the longest of the four last cuts that is valid."""
    raw = F.encode(text, "UTF-8")
    cuts = [F.substring(raw, 1, most - k) for k in range(4)]
    valid = F.coalesce(*[F.when(F.is_valid_utf8(c.cast("string")), c.cast("string")) for c in cuts])
    return F.when(F.octet_length(text) <= most, text).otherwise(valid)


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
