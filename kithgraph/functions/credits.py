"""Credits out of captions: lines such as `Photographer: @handle` become (label, handle, line number, role)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.functions.labels import Rule, classified
from kithgraph.functions.text import ordered_role

#: A credit line is a label, a separator and something with a handle.
LINE = r"^\s*[•\-*]?\s*([A-Za-z][A-Za-z &+/'’]{1,35}?)\s*[:|\-–—/]+\s*(.*@.*)$"
HANDLE = r"@([A-Za-z0-9._]{2,30})"
#: Roles by the first key that a label contains, in this order.
ROLES = [
    ("photo_booth", ["photo booth", "photobooth"]),
    ("venue", ["venue"]),
    ("hotel", ["hotel"]),
    ("planner", ["plann"]),
    ("photographer", ["photo"]),
    ("videographer", ["video", "film", "content"]),
    ("hair", ["hair"]),
    ("makeup", ["makeup"]),
    ("beauty_services", ["hmu", "beauty"]),
    ("florist", ["flor", "bloom"]),
    ("dj", ["dj", "entertainment"]),
    ("live_music", ["music", "sax", "strings", "band"]),
    ("attire", ["dress", "gown", "suit", "tux", "attire", "bridal"]),
    ("stationery", ["stationery", "invitation", "paper"]),
    ("cake", ["cake", "dessert"]),
    ("catering", ["cater", "dinner", "drinks", "food"]),
    ("rentals", ["rental", "linen", "decor"]),
    ("transportation", ["transport", "limo"]),
    ("officiant", ["officiant"]),
    ("jewelry", ["ring", "jewel"]),
]


def credit_lines(posts: DataFrame) -> DataFrame:
    """(post_id, line_no, role_raw, handle, role) of posts (post_id, caption), in built-in expressions only.

    Lines count from 0. Handles are lower-cased. A line credits every handle in it. Null captions have none. Distinct
    labels are few, but the ordered match is cheap enough to run per line.
    """
    lines = posts.select("post_id", F.posexplode(F.split(F.coalesce("caption", F.lit("")), "\n")).alias("line_no", "line"))
    line = F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))
    found = lines.select("post_id", "line_no", line.alias("line")).where(F.col("line").rlike(LINE))
    each = found.select(
        "post_id", "line_no", F.trim(F.regexp_extract("line", LINE, 1)).alias("role_raw"),
        F.explode(F.regexp_extract_all(F.regexp_extract("line", LINE, 2), F.lit(HANDLE), F.lit(1))).alias("handle"),
    )
    return each.select("post_id", "line_no", "role_raw", F.lower("handle").alias("handle"), ordered_role(F.col("role_raw"), ROLES).alias("role"))


def credits_of(caption: Column) -> Column:
    """The credit lines of one caption as an array of (line_no, role_raw, handle, role), in order."""
    stripped = F.transform(F.split(F.coalesce(caption, F.lit("")), "\n"), lambda x, i: F.struct(i.alias("i"), F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")).alias("line")))
    found = F.filter(stripped, lambda x: x["line"].rlike(LINE))
    label = lambda x: F.trim(F.regexp_extract(x["line"], LINE, 1))
    handles = lambda x: F.regexp_extract_all(F.regexp_extract(x["line"], LINE, 2), F.lit(HANDLE), F.lit(1))
    return F.flatten(F.transform(found, lambda x: F.transform(handles(x), lambda h: F.struct(x["i"].alias("line_no"), label(x).alias("role_raw"), F.lower(h).alias("handle"), ordered_role(label(x), ROLES).alias("role")))))


def roles_of(caption: Column) -> Column:
    """The distinct roles of a caption's credit lines, within the row."""
    lines = F.transform(F.split(F.coalesce(caption, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    return F.array_distinct(F.transform(F.filter(lines, lambda x: x.rlike(LINE)), lambda x: ordered_role(F.trim(F.regexp_extract(x, LINE, 1)), ROLES)))


def has_stack_raw(credits: DataFrame, least: int = 3) -> DataFrame:
    """Posts with at least so many distinct labels as written."""
    return credits.groupBy("post_id").agg(F.countDistinct("role_raw").alias("n")).where(F.col("n") >= least).select("post_id")


def has_stack_roles(credits: DataFrame, least: int = 3) -> DataFrame:
    """Posts with at least so many distinct roles."""
    return credits.groupBy("post_id").agg(F.countDistinct("role").alias("n")).where(F.col("n") >= least).select("post_id")


def has_any_credit(credits: DataFrame) -> DataFrame:
    """Posts with any credit."""
    return credits.select("post_id").distinct()


#: Signs that stand for a role, by the first group of which a run of signs has one; None is no vendor's.
SIGN_GROUPS = [
    (["📸", "📷"], "photographer"),
    (["🎥", "📽", "🎞️", "🎬"], "videographer"),
    (["💐", "🌸", "🌷", "🌹"], "florist"),
    (["💄"], "makeup"),
    (["💇"], "hair"),
    (["📋", "🗓️", "📝", "📅"], "planner"),
    (["🎧", "💽"], "dj"),
    (["🎻", "🎷", "🎺", "🎸", "🎹"], "live_music"),
    (["🎤", "🎶", "🎵"], "band"),
    (["🍽️", "🍴", "🥗", "🍸", "🍹"], "catering"),
    (["🍰", "🎂", "🧁"], "cake"),
    (["👗", "👰"], "wedding_dress"),
    (["🤵", "👔"], "menswear"),
    (["💍"], "jewelry"),
    (["💌", "✉️"], "stationery"),
    (["🪑", "🎀", "🧺"], "rentals"),
    (["💡"], "lighting_production"),
    (["🚌", "🚎", "🚐", "🚗"], "transportation"),
    (["🏨"], "accommodations"),
    (["💒", "⛪", "🏡", "🏛️", "🏰", "📍"], "venue"),
    (["🥂", "🎉", "✨", "🥳"], None),
]
#: Pictographs by code points, which every regular-expression library here knows, and what joins or tints them.
PICTURES = r"\x{A9}\x{AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{21AA}\x{231A}-\x{23FF}\x{24C2}\x{25AA}-\x{25FE}\x{2600}-\x{27BF}\x{2934}\x{2935}\x{2B05}-\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F000}-\x{1FAFF}"
JOINERS = r"\x{200D}\x{FE0F}"
#: The forms of a labelled line; a colon wins over other separators, those over none at all.
SIGNED = f"[A-Za-z &+/'’0-9#*\\x{{20E3}}{JOINERS}{PICTURES}]"
TAIL = r"((?:@[A-Za-z0-9._]{2,30}[\s/,&]*)+)$"
FORMS = [
    rf"^\s*[•\-*]?\s*([A-Za-z]{SIGNED}{{1,40}}?)\s*:\s*(.*@.*)$",
    rf"^\s*[•\-*]?\s*([A-Za-z]{SIGNED}{{1,40}}?)\s*[|\-–—/]+\s*(.*@.*)$",
    rf"^\s*[•\-*]?\s*([A-Z]{SIGNED}{{0,39}})\s*{TAIL}",
]
#: A sign that each form can't do without, which is found faster than the form.
SEPARATORS = [":", r"[|\-–—/]", "@"]
SIGN_LINE = rf"^\s*([{PICTURES}][{PICTURES}{JOINERS}]{{0,7}})\s*[:|\-–—]?\s*{TAIL}"
#: A label before a handle, and what parts several of them on one line.
NEXT_LABEL = r"[A-Za-z][A-Za-z &+/'’]{0,35}?\s*[:|]\s*@"
BETWEEN = r"(?: - | – | — | \| | • | · | // | / |;)\s*"


def sign_role(run: Column) -> Column:
    """The role of a run of signs; `other` for signs without one."""
    out = None
    for signs, role in SIGN_GROUPS:
        has = F.contains(run, F.lit(signs[0]))
        for sign in signs[1:]:
            has = has | F.contains(run, F.lit(sign))
        out = F.when(has, role or "other") if out is None else out.when(has, role or "other")
    return out.otherwise("other")


def labelled_lines(posts: DataFrame) -> DataFrame:
    """(post_id, line_no, label, handle, source, sign_role) of lines with a label or with signs in its place.

    A line with several labels before handles is cut between them. Labels may hold signs. Handles are lower-cased; lines
    count from 0; null captions have none.
    """
    stripped = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    lines = posts.select("post_id", F.posexplode(F.split(F.coalesce("caption", F.lit("")), "\n")).alias("line_no", "line")).where(F.contains("line", F.lit("@")))
    two = lambda x: F.contains(F.substring(x, F.instr(x, "@") + 1, F.char_length(x)), F.lit("@"))
    several = lambda x: two(x) & x.rlike("[:|]") & (F.regexp_count(x, F.lit(NEXT_LABEL)) >= 2)
    cut = lambda x: F.when(several(x), F.split(x, f"{BETWEEN}(?={NEXT_LABEL})")).otherwise(F.array(x))
    form = lambda x, p, source, sign: F.when(F.coalesce(x.rlike(sign), F.lit(False)) & x.rlike(p), F.struct(stripped(F.regexp_extract(x, p, 1)).alias("label"), F.regexp_extract(x, p, 2).alias("rest"), F.lit(source).alias("source")))
    told = lambda x: F.coalesce(*[form(x, p, "credit_line", sign) for p, sign in zip(FORMS, SEPARATORS, strict=True)], form(x, SIGN_LINE, "emoji_line", "@"))
    parts = F.transform(F.flatten(F.transform(F.array(stripped(F.col("line"))), cut)), stripped)
    # the generator keeps later filters above it, so each part is matched once
    found = lines.select("post_id", "line_no", F.explode(F.filter(F.transform(parts, told), lambda m: m.isNotNull())).alias("m"))
    each = found.select("post_id", "line_no", "m.label", F.explode(F.regexp_extract_all("m.rest", F.lit(HANDLE), F.lit(1))).alias("handle"), "m.source")
    return each.select("post_id", "line_no", "label", F.lower("handle").alias("handle"), "source", F.when(F.col("source") == "emoji_line", sign_role(F.col("label"))).alias("sign_role"))


def labelled_credits(posts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(post_id, line_no, label, handle, source, role, event_context, participant, rule): a row per role of each label's handle.

    The labels mean what the rules say. Labels that name people have a participant and no role. Distinct labels are classified
    once; the captions are read twice, for the labels and for the rows.
    """
    lines = labelled_lines(posts)
    signs = F.col("source") == "emoji_line"
    found = classified(lines.where(~signs).select("label"), rules)
    rows = lines.join(found.withColumn("source", F.lit("credit_line")), ["label", "source"], "left").withColumn("role", F.explode_outer(F.split(F.nullif("roles", F.lit("")), ",")))
    of_sign = lambda sign, name: F.when(signs, sign).otherwise(F.col(name)).alias(name)
    return rows.select("post_id", "line_no", "label", "handle", "source", of_sign(F.col("sign_role"), "role"), of_sign(F.lit("wedding_day"), "event_context"), "participant", of_sign(F.lit("emoji"), "rule"))


def sign_credits(posts: DataFrame) -> DataFrame:
    """Credits of lines that start with signs in place of a label: (post_id, line_no, handle, role)."""
    return labelled_lines(posts).where("source = 'emoji_line'").select("post_id", "line_no", "handle", F.col("sign_role").alias("role"))
