"""What a credit line's label means: roles, event context, participants. Distinct labels are classified once and joined back.

The words are not ours to know: they come as a table of rules (kind, pattern, value), in the order of their rank. Kinds:
`context` (a pattern anywhere in a label sets the event context), `participant` (a pattern of people who are no vendors),
`press` and `noise` (patterns of labels that credit nobody), `phase` (a whole label that means the venue of a context),
`exact` (a whole label or part with its roles, comma-joined), `qualifier` (a pattern that a part is also tried without),
`head` (a pattern with its roles, comma-joined).
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("context", "participant", "press", "noise", "phase", "exact", "qualifier", "head")
#: Rules of a table that one session may hold; a longer table is refused.
MOST_RULES = 5_000
NO_CONTEXT = "wedding_day"
SPLIT = r"\s*(?:&|\+|/|,|\band\b|\bwith\b)\s*"


class Rule(NamedTuple):
    kind: str
    pattern: str
    value: str = ""


def rules_of(table: DataFrame) -> list[Rule]:
    """The rules of a table (kind, pattern, value, rank), by rank. Tables of unknown kinds or too many rules are refused."""
    rows = table.select("kind", "pattern", F.coalesce("value", F.lit("")).alias("value"), "rank").orderBy("rank", "kind", "pattern").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES or any(r.kind not in KINDS for r in rows):
        raise ValueError(f"a table of rules has at most {MOST_RULES} rows of the kinds {', '.join(KINDS)}")
    return [Rule(r.kind, r.pattern, r.value) for r in rows]


def normal(label: Column) -> Column:
    """Lower case, without signs that only decorate, without 'the', blanks folded."""
    plain = F.regexp_replace(F.lower(label), r"[^\p{L}\p{N}\s&+/,'’]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "[’`]", "'"), r"\bthe\b", " "), r"\s+", " "))


class Rules:
    """The rules by kind, as expressions of a normalised label."""

    def __init__(self, rules: Sequence[Rule]):
        self.of = {k: [r for r in rules if r.kind == k] for k in KINDS}

    def first(self, kind: str, text: Column) -> Column:
        """The value of the first rule whose pattern the text has, else null."""
        return F.coalesce(*[F.when(text.rlike(r.pattern), r.value) for r in self.of[kind]], F.lit(None).cast("string"))

    def has(self, kind: str, text: Column) -> Column:
        return self.first(kind, text).isNotNull()

    def looked_up(self, kind: str, text: Column) -> Column:
        """The value of the rule that names the whole text, else null."""
        table = {r.pattern: r.value for r in reversed(self.of[kind])}
        if not table:
            return F.lit(None).cast("string")
        return F.try_element_at(F.map_from_arrays(F.array(*map(F.lit, table)), F.array(*map(F.lit, table.values()))), text)

    def without(self, kind: str, text: Column) -> Column:
        """A text without what a kind's patterns match, blanks folded."""
        for r in self.of[kind]:
            text = F.regexp_replace(text, r.pattern, " ")
        return F.trim(F.regexp_replace(text, r"\s+", " "))

    def part(self, text: Column) -> Column:
        """Roles of a part, comma-joined: named as a whole, named without qualifiers, then by head rules likewise; null for none."""
        bare = self.without("qualifier", text)
        return F.coalesce(self.looked_up("exact", text), self.looked_up("exact", bare), self.first("head", bare), self.first("head", text))

    def parts(self, text: Column) -> Column:
        """Distinct roles of a compound's parts, in their order."""
        each = F.filter(F.split(text, SPLIT), lambda x: x != "")
        named = F.filter(F.transform(each, self.part), lambda r: r.isNotNull())
        return F.array_distinct(F.flatten(F.transform(named, lambda r: F.split(r, ","))))


def classified(labels: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(label, roles, event_context, participant, rule) of distinct labels; roles comma-joined in order of appearance.

    People, press and noise come first, then labels that name a phase's venue and those that are named as a whole. Else the
    words of the context go: nothing left is the venue of that phase; what is left is a compound's parts or a part. What no
    rule meets is `other`. Null labels are left out, an empty one is noise.
    """
    r = Rules(rules)
    one = labels.select("label").where("label is not null").distinct().withColumn("n", normal(F.col("label")))
    n = F.col("n")
    rows = one.select("label", "n", r.first("participant", n).alias("participant"), r.first("context", n).alias("c"), r.looked_up("phase", n).alias("phase"), F.coalesce(r.looked_up("exact", n), r.looked_up("exact", r.without("qualifier", n))).alias("exact"), r.without("context", n).alias("rest"))
    whole = F.when(F.col("rest") == "", n).otherwise(F.col("rest"))
    rows = rows.withColumn("parts", r.parts(whole)).withColumn("several", F.size(F.filter(F.split(whole, SPLIT), lambda x: x != "")) > 1)
    only_phase = (F.col("rest") == "") & F.col("c").isNotNull()
    rule = (
        F.when(n == "", "empty").when(F.col("participant").isNotNull(), "participant").when(r.has("press", n), "press").when(r.has("noise", n), "noise").when(F.col("phase").isNotNull(), "phase_venue")
        .when(F.col("exact").isNotNull(), "exact").when(only_phase, "phase_venue").when(F.size("parts") == 0, "unmatched").when(F.col("several"), "compound").otherwise("head")
    )
    roles = (
        F.when(rule.isin("empty", "noise"), "noise").when(rule == "participant", "").when(rule == "press", "press_feature").when(rule == "phase_venue", "venue")
        .when(rule == "exact", F.col("exact")).when(rule == "unmatched", "other").otherwise(F.array_join("parts", ","))
    )
    plain = rule.isin("empty", "participant", "press", "noise")
    return rows.select("label", roles.alias("roles"), F.when(plain, NO_CONTEXT).otherwise(F.coalesce("phase", "c", F.lit(NO_CONTEXT))).alias("event_context"), "participant", rule.alias("rule"))


def with_roles(entries: DataFrame, label: str, rules: Sequence[Rule]) -> DataFrame:
    """Entries with their label's classification: labels are few, so they are classified once."""
    found = classified(entries.select(F.col(label).alias("label")), rules).withColumnRenamed("label", label)
    return entries.join(found, label, "left")


def label_coverage(entries: DataFrame, label: str, rules: Sequence[Rule]) -> DataFrame:
    """(rule, labels, entries): how many distinct labels and entries each kind of rule decides."""
    per = entries.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return per.join(classified(per, rules), "label").groupBy("rule").agg(F.count("*").alias("labels"), F.sum("n").alias("entries"))
