"""Projections over names, paths, addresses and cells, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fold import fold_text

#: Classes of access rights, the first that holds names the access.
ACCESS = (("delete", 0x10000 | 0x40), ("write", 0x2 | 0x4), ("permissions", 0x40000 | 0x80000), ("attributes", 0x100), ("read", 0x1))


def extension(name: Column) -> Column:
    """From the last dot on, lower-cased; a dot in front makes a hidden file, not an extension."""
    return F.regexp_extract(F.lower(F.coalesce(name, F.lit(""))), r"(?s)^.+(\.[^.]+)$", 1)


def parent_folder(path: Column) -> Column:
    """Path up to its last separator; empty at the root."""
    return F.regexp_extract(F.coalesce(path, F.lit("")), r"(?s)^(.*)[\\/][^\\/]*$", 1)


def kilobytes(size: Column) -> Column:
    return F.round(size / 1024, 1)


def megabytes(size: Column) -> Column:
    return F.round(size / 1048576, 2)


def person(name: Column, email: Column) -> Column:
    """Name <email>; whichever of the two there is; empty without both."""
    n, e = F.nullif(F.trim(name), F.lit("")), F.nullif(F.trim(email), F.lit(""))
    both = F.when(n.isNotNull() & e.isNotNull() & (n != e), F.concat(n, F.lit(" <"), e, F.lit(">")))
    return F.coalesce(both, n, e, F.lit(""))


def display_name(sender: Column) -> Column:
    """What stands before <address> without quotes; empty if it only repeats the address."""
    s = F.trim(F.coalesce(sender, F.lit("")))
    name = F.regexp_replace(F.trim(F.regexp_extract(s, r"^([^<]+)<", 1)), r'^"|"$', "")
    address = F.lower(F.regexp_extract(s, r"<([^>]*)>", 1))
    return F.when(F.lower(name) == address, F.lit("")).otherwise(name)


def sample_text(before: Column, match: Column, after: Column, where: Column) -> Column:
    text = F.concat(F.coalesce(before, F.lit("")), F.lit("["), F.coalesce(match, F.lit("")), F.lit("]"), F.coalesce(after, F.lit("")))
    return F.when(F.coalesce(where, F.lit("")) == "", text).otherwise(F.concat(text, F.lit(" ("), where, F.lit(")")))


def csv_cell(value: Column) -> Column:
    """A text cell: formulas are neutralised, and what needs quotes gets them."""
    s = F.coalesce(value, F.lit(""))
    s = F.when(s.rlike("^[=+\\-@\t\r]"), F.concat(F.lit("'"), s)).otherwise(s)
    return F.when(s.rlike('[";\n\r]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_number(value: Column, digits: int = 2) -> Column:
    """Decimal comma, no trailing zeros."""
    text = F.regexp_replace(F.format_string(f"%.{digits}f", value.cast("double")), r"\.?0+$", "") if digits else value.cast("long").cast("string")
    return F.coalesce(F.replace(text, F.lit("."), F.lit(",")), F.lit(""))


def csv_time(value: Column) -> Column:
    return F.coalesce(F.date_format(value, "dd/MM/yyyy HH:mm:ss"), F.lit(""))


def html_cell(value: Column) -> Column:
    """The five characters of markup escaped."""
    s = F.coalesce(value, F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    return s


def access_label(mask: Column) -> Column:
    """Hexadecimal access mask to the first class of rights that it holds; null without a number."""
    n = F.conv(F.regexp_replace(mask, "^0[xX]", ""), 16, 10).cast("long")
    out = F.lit("other")
    for label, bits in reversed(ACCESS):
        out = F.when(n.bitwiseAND(F.lit(bits)) != 0, F.lit(label)).otherwise(out)
    return F.when(mask.rlike("^0[xX][0-9A-Fa-f]{1,15}$"), out)


def windows_path(path: Column) -> Column:
    r"""Comparable form: lower-cased, \\?\ and \\?\UNC\ prefixes gone, one kind of separator, none at the end."""
    p = F.translate(F.coalesce(path, F.lit("")), "/", "\\")
    p = F.regexp_replace(p, r"^(?i)\\\\\?\\UNC\\", r"\\\\")
    p = F.regexp_replace(p, r"^\\\\\?\\", "")
    return F.lower(F.regexp_replace(p, r"\\+$", ""))


def safe_name(name: Column) -> Column:
    """A name for a download: folded letters and digits, the rest as single dashes, at most 80 characters."""
    s = F.regexp_replace(fold_text(name), "[^A-Za-z0-9_]+", "-")
    s = F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, 80)
    return F.when(s == "", F.lit("relatorio")).otherwise(s)


def normal_extension(value: Column) -> Column:
    """*.MP3, mp3 and .mp3 alike; null if that is no extension."""
    e = F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), r"^\*", "")
    e = F.when(e.startswith("."), e).otherwise(F.concat(F.lit("."), e))
    return F.when(e.rlike(r"^\.[a-z0-9][a-z0-9._~-]{0,30}$") & ~e.endswith("."), e)


def message_id(value: Column) -> Column:
    """<abc@x> and abc@x alike."""
    return F.lower(F.trim(F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), "^<+|>+$", "")))


def email_domain(address: Column) -> Column:
    return F.regexp_extract(F.lower(F.trim(F.coalesce(address, F.lit("")))), r"@([^@]*)$", 1)


def domain_suffixes(domain: Column) -> Column:
    """a.b.c, b.c, c: the domain and all that it is part of."""
    parts = F.split(domain, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def is_internal(address: Column, domains: list[str]) -> Column:
    """Whether the address's domain is one of domains or below one; without domains nothing is."""
    domain = email_domain(address)
    own = F.array(*map(F.lit, domains)) if domains else F.array().cast("array<string>")
    return (domain != "") & F.arrays_overlap(domain_suffixes(domain), own)


def normal_domains(value: str | list[str]) -> list[str]:
    """Internal domains as typed by a person: split, lower-cased, addresses cut to their domain, no repeats."""
    parts = value if isinstance(value, list) else value.replace(",", " ").replace(";", " ").split()
    found = (p.strip().lower().rpartition("@")[2].strip(".") for p in parts)
    return list(dict.fromkeys(d for d in found if d))


def quote_sender(attachment: Column) -> Column:
    """Sender named in the JSON of a quoted message."""
    return F.coalesce(F.get_json_object(attachment, "$.messageSender.user.displayName"), F.lit(""))


def hosted_images(html: Column) -> Column:
    """Ids of images that a message hosts, distinct, in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"hostedContents/([^/\"']+)/\$value"), F.lit(1)))


def pdf_date(value: Column) -> Column:
    """D:YYYYMMDDHHmmSS with an offset, as an instant; null if it is none."""
    g = lambda k: F.regexp_extract(value, r"^(?:D:)?([0-9]{4})([0-9]{2})?([0-9]{2})?([0-9]{2})?([0-9]{2})?([0-9]{2})?(?:([+-])([0-9]{2})'?([0-9]{2})?)?", k)
    n = lambda k, default: F.coalesce(F.try_to_number(F.nullif(g(k), F.lit("")), F.lit("9999")).cast("int"), F.lit(default))
    text = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", n(1, 0), n(2, 1), n(3, 1), n(4, 0), n(5, 0), n(6, 0))
    at = F.try_to_timestamp(F.when(g(1) != "", text), F.lit("yyyy-MM-dd HH:mm:ss"))
    minutes = (n(8, 0) * 60 + n(9, 0)) * F.when(g(7) == "-", -1).otherwise(1)
    return F.timestamp_seconds(F.unix_timestamp(at) - minutes * 60)


def drive_path(reference: Column) -> Column:
    """Path of a drive item from its parent's reference: what follows root:, decoded where that works."""
    raw = F.regexp_extract(F.coalesce(reference, F.lit("")), r"(?s)root:/?(.*)$", 1)
    return F.coalesce(F.try_url_decode(raw), raw)
