"""String expressions: search, handles, names, slugs, dates, URLs. Nulls give nulls unless stated."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def matches_any(needle: str, columns: Sequence[str]) -> Column:
    """Case-insensitive substring search; the needle's wildcards are plain signs."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(needle.lower())) for c in columns])


def group(text: Column | str, pattern: str, number: int = 1) -> Column:
    """A regex group, null where nothing matches."""
    text = col(text)
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, number))


def handle(raw: Column | str, dots: bool = True) -> Column:
    """A handle trimmed, lower-cased, without leading @ signs; `dots` also strips trailing dots. Empty gives null."""
    out = F.regexp_replace(F.lower(F.trim(col(raw))), r"^@+", "")
    return F.nullif(F.regexp_replace(out, r"\.+$", "") if dots else out, F.lit(""))


def slug(text: Column | str) -> Column:
    """Lower case, runs of other signs as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def truncated(text: Column | str, most: int) -> Column:
    """At most so many characters, the last an ellipsis where something is cut."""
    text = col(text)
    return F.when(F.char_length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def title_word(text: Column | str) -> Column:
    text = col(text)
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, F.lit(2), F.char_length(text))))


def name_from_handle(username: Column | str) -> Column:
    """A display name from a handle: its parts between dots, underscores and hyphens, capitalised."""
    parts = F.filter(F.split(col(username), r"[._\-]+"), lambda x: x != "")
    return F.array_join(F.transform(parts, title_word), " ")


def display_name(business: Column, full: Column, username: Column) -> Column:
    """The business name unless it is missing or just the handle, then the full name, then the handle."""
    just = (F.lower(business) == F.lower(username)) | (F.lower(business) == F.concat(F.lit("@"), F.lower(username)))
    return F.coalesce(F.when(business.isNotNull() & ~just, business), F.nullif(full, F.lit("")), username)


def venue_name_key(raw: Column | str) -> Column:
    """For attribution: letters and digits only, every 'the' dropped."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(raw)), r"\bthe\b", ""), r"[^a-z0-9]", "")


def lead_name_key(raw: Column | str) -> Column:
    """For leads: quotes dropped, other punctuation as blanks, a leading 'the ' dropped, blanks folded."""
    out = F.regexp_replace(F.lower(F.trim(col(raw))), r"['’\"“”]", "")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"[,.&\-–—()!:;]", " "), r"\s+", " "))
    return F.regexp_replace(out, r"^the ", "")


#: Street words and their abbreviations.
STREET_WORDS = {"street": "st", "avenue": "ave", "boulevard": "blvd", "drive": "dr", "road": "rd", "lane": "ln", "place": "pl", "north": "n", "south": "s", "east": "e", "west": "w"}


def search_key(text: Column | str) -> Column:
    """For searching venues: lower case, no punctuation, street words abbreviated, blanks folded."""
    out = F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), r"[^\p{L}\p{N}\s]", " ")
    for word, short in STREET_WORDS.items():
        out = F.regexp_replace(out, rf"\b{word}\b", short)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def couple_key(raw: Column | str) -> Column:
    """A pair of first names as one key: split at &, + or 'and' into exactly two, three letters or more, sorted."""
    parts = F.transform(F.split(F.lower(F.trim(col(raw))), r"\s*(?:&|\+|\band\b)\s*"), lambda x: F.regexp_extract(F.trim(x), r"^(\p{L}+)", 1))
    good = (F.size(parts) == 2) & F.forall(parts, lambda x: F.char_length(x) >= 3)
    return F.when(good, F.array_join(F.array_sort(parts), "|"))


def hashtags(caption: Column | str) -> Column:
    """Distinct hashtags, lower-cased, without the sign, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(col(caption), F.lit("")), F.lit(r"#([\p{L}\p{N}_]+)"), F.lit(1)), F.lower))


def mentions(caption: Column | str) -> Column:
    """Distinct handles that are mentioned, lower-cased."""
    found = F.regexp_extract_all(F.coalesce(col(caption), F.lit("")), F.lit(r"@([A-Za-z0-9._]{2,30})"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.lower(x), r"\.+$", "")))


def names_handle(caption: Column | str, name: Column | str) -> Column:
    """Whether a caption names exactly this handle: no letter, digit, underscore, or dot before such, may follow."""
    found = F.regexp_extract_all(F.lower(col(caption)), F.lit(r"@([a-z0-9_]+(?:\.[a-z0-9_]+)*)"), F.lit(1))
    return F.array_contains(found, F.lower(col(name)))


def host(url: Column | str) -> Column:
    """The registrable host of a URL or bare domain: lower case, without www."""
    url = F.trim(col(url))
    full = F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), url).otherwise(F.concat(F.lit("https://"), url))
    return F.regexp_replace(F.lower(F.try_parse_url(full, F.lit("HOST"))), r"^www\.", "")


#: Hosts that list many businesses, so sharing one says nothing.
AGGREGATORS = ["linktr.ee", "instagram.com", "facebook.com", "theknot.com", "weddingwire.com", "zola.com", "yelp.com", "google.com", "linkin.bio", "beacons.ai", "bit.ly", "youtube.com", "tiktok.com", "pinterest.com"]


def is_aggregator(name: Column) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [(name == h) | name.endswith("." + h) for h in AGGREGATORS]), F.lit(False))


def url_key(url: Column | str) -> Column:
    """A URL for comparison: host and path without a trailing slash, and the query, lower case."""
    out = F.regexp_replace(F.lower(F.trim(col(url))), r"^[a-z][a-z0-9+.-]*://(www\.)?", "")
    return F.regexp_replace(F.regexp_replace(out, r"#.*$", ""), r"/+(?=$|\?)", "")


def without_tracking(url: Column | str) -> Column:
    """A URL without the parameters that only track."""
    out = F.regexp_replace(col(url), r"(?i)([?&])(?:(?:utm_[a-z]+|fbclid|gclid|igshid|mc_[a-z]+)=[^&#]*(?:&|(?=#|$)))+", "$1")
    return F.regexp_replace(out, r"[?&]+(?=#|$)", "")


def shortcode(url: Column | str) -> Column:
    return group(url, r"/p/([^/]+)")


def video_url(url: Column | str) -> Column:
    """The canonical page of a video link, null for others."""
    url = col(url)
    tube = group(url, r"(?:youtube\.com/(?:watch\?(?:[^#]*&)?v=|embed/|shorts/)|youtu\.be/)([A-Za-z0-9_-]{11})")
    vimeo = group(url, r"vimeo\.com/(?:video/)?(\d+)")
    return F.coalesce(F.concat(F.lit("https://www.youtube.com/watch?v="), tube), F.concat(F.lit("https://vimeo.com/"), vimeo))


def event_date(raw: Column | str, confidence: Column | None = None, least: float = 0.8) -> Column:
    """A date from an ISO start or month/day/year with / . or -; two-digit years are of this century.

    Impossible dates give null (a calendar that rolls 31 February over would give March). A confidence under `least` gives
    null.
    """
    raw = F.trim(col(raw))
    iso = r"^(\d{4})-(\d{2})-(\d{2})"
    us = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4}|\d{2})$"
    part = lambda p, i: F.regexp_extract(raw, p, i).try_cast("int")
    year = F.when(part(us, 3) < 100, part(us, 3) + 2000).otherwise(part(us, 3))
    made = F.when(raw.rlike(iso), F.to_date(F.try_to_timestamp(F.regexp_extract(raw, iso, 0), F.lit("yyyy-MM-dd")))).when(
        raw.rlike(us), F.to_date(F.try_to_timestamp(F.concat_ws("-", year.cast("string"), F.lpad(part(us, 1).cast("string"), 2, "0"), F.lpad(part(us, 2).cast("string"), 2, "0")), F.lit("yyyy-MM-dd")))
    )
    return made if confidence is None else F.when(confidence >= least, made)


def days_between(a: Column, b: Column) -> Column:
    """Days between two timestamps, with their fraction, never negative."""
    return F.abs(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / F.lit(86_400_000_000.0)


def season(date: Column) -> Column:
    """The season and year of a date by its month; December counts for its own year."""
    month = F.month(date)
    name = F.when(month.isin(12, 1, 2), "Winter").when(month.isin(3, 4, 5), "Spring").when(month.isin(6, 7, 8), "Summer").when(month.isNotNull(), "Fall")
    return F.concat_ws(" ", name, F.year(date).cast("string"))


def clock(raw: Column | str) -> Column:
    """A time of day as HH:MM from forms such as 5pm, 5:30 PM, 17:30, noon and midnight; null for others."""
    text = F.lower(F.regexp_replace(F.trim(col(raw)), r"[\s.]", ""))
    p = r"^(\d{1,2})(?::(\d{2}))?(am|pm)?$"
    hour, minute, half = F.regexp_extract(text, p, 1).try_cast("int"), F.coalesce(F.regexp_extract(text, p, 2).try_cast("int"), F.lit(0)), F.regexp_extract(text, p, 3)
    full = F.when(half == "pm", hour % 12 + 12).when(half == "am", hour % 12).otherwise(hour)
    shown = F.concat_ws(":", F.lpad(full.cast("string"), 2, "0"), F.lpad(minute.cast("string"), 2, "0"))
    fits = text.rlike(p) & (full < 24) & (minute < 60) & ((half == "") | hour.between(1, 12)) & ((half != "") | text.contains(":"))
    return F.when(text == "noon", "12:00").when(text == "midnight", "00:00").when(fits, shown)


def batch_label(ts: Column, tick: Column | str, zone: str = "America/Chicago") -> Column:
    """A batch id from the calendar date in a zone."""
    return F.concat_ws("-", F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd"), col(tick).cast("string"))


def ordered_role(label: Column, roles: Sequence[tuple[str, Sequence[str]]], other: str = "other") -> Column:
    """The first role any of whose keys is in a label, by the order of the list."""
    low = F.lower(label)
    out = F.when(label.isNull(), F.lit(None).cast("string"))
    for role, keys in roles:
        out = out.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in keys]), role)
    return out.otherwise(other)


def java_regex(pattern: str) -> str:
    """A POSIX-style pattern for Java: word borders are written differently."""
    return re.sub(r"\\y", r"\\b", pattern)


#: What the words around a handle in a biography say: its own account for events, or somebody related.
OWN_ACCOUNT = r"(?i)events? account|weddings? account|special events|our events|book(?:ing)? (?:at|via)"
RELATED = r"(?i)by @|managed? by|management|caterer at|in-house|hospitality|\bgroup\b|part of|sister"


def mention_snippet(biography: Column | str, name: Column | str) -> Column:
    """The first mention of a handle with 20 characters on either side; null where it is not mentioned as a whole handle.

    Case is that of A-Z. Where the first place of the handle is a whole one, that is the mention; only where a longer handle
    comes first a pattern is made of the name, which is compiled for every row.
    """
    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    text = col(biography)
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))
    needle = F.concat(F.lit("@"), F.regexp_replace(F.lower(F.trim(col(name))), "^@", ""))
    quoted = lambda w: F.concat(F.lit(r"(?is).{0,20}?\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![a-z0-9._]).{0,20}"))
    size = lambda x: F.char_length(x["w"])
    piece = lambda x: F.substring(text, F.greatest(x["at"] - 20, F.lit(1)), F.least(x["at"] - 1, F.lit(20)) + size(x) + 20)
    whole = lambda x: ~F.substring(x["low"], x["at"] + size(x), F.lit(1)).rlike("[a-z0-9._]")
    first = lambda x: F.struct(x["w"].alias("w"), x["low"].alias("low"), F.position(x["w"], x["low"]).alias("at"))
    found = lambda x: F.when((x["at"] > 0) & (x["w"] != "@"), F.trim(F.when(whole(x), piece(x)).otherwise(F.regexp_substr(text, quoted(x["w"])))))
    return bound(bound(F.struct(needle.alias("w"), low.alias("low")), first), found)


def mention_kind(snippet: Column | str) -> Column:
    """alias_like, related_not_alias or null; the first wins where both fit."""
    return F.when(col(snippet).rlike(OWN_ACCOUNT), "alias_like").when(col(snippet).rlike(RELATED), "related_not_alias")
