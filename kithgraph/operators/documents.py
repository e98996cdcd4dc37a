"""Documents about venues: grounding of quotes, sanity checks, versions and corrections, capacity and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.operators.helpers import latest_by

#: Shares of a quote's words that a page must hold, and the words that a strict check needs.
CLEAN, WEAK, STRICT_WORDS = 0.8, 0.5, 3
#: Words that say nothing about where a quote is from.
STOP_WORDS = ["the", "and", "for", "with", "are", "our", "you", "your", "from", "that", "this", "can", "all", "per", "has", "have", "will", "not", "but", "any", "was"]
#: Plausible ranges of prices and rates.
RANGES = {"per_guest": (20, 1_000), "flat": (100, 100_000), "service_charge_pct": (0, 35), "sales_tax_pct": (0, 20), "cc_fee_pct": (0, 6)}
#: Prices of rooms for the night, other events, daytime specials.
NIGHTLY = r"(?i)\bnights?\b|per night|room rate|guest ?rooms?|\bADR\b"
OTHER_EVENT = r"(?i)\b(gala|corporate|meeting|meetings|conference|business|banquet|program|town hall|general session|other event)\b"
DAYTIME = r"(?i)\b(lunch|brunch|early[- ]bird|daytime|morning|afternoon special)\b"


def words(text: Column) -> Column:
    """The words of a text for grounding: numbers normalised ($ and commas off, k as thousands, % off), short and stop words out."""
    raw = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9$.,%]+)"), F.lit(1))
    plain = F.transform(raw, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"[$,%]", ""), r"^(\d+)k$", "$1000"), r"\.+$|[^a-z0-9.]", ""))
    stops = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(plain, lambda x: (x != "") & (x.rlike("[0-9]") | ((F.length(x) >= 3) & ~F.array_contains(stops, x))))


def coverage(quote: Column, page: Column) -> Column:
    """The share of a quote's words that a page holds, as grounding counts it; 0 for a quote without words."""
    said, held = words(quote), words(page)
    return F.when(F.size(said) == 0, 0.0).otherwise(F.round(F.size(F.filter(said, lambda x: F.array_contains(held, x))) / F.size(said), 6))


def grounding(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """Where each quote stands: pass, grounded_elsewhere, weak_quote, source_not_crawled or fail, with its coverage.

    quotes: quote_id, entity_id, quote, source_url; pages: entity_id, url, text. A page that holds 0.8 of a quote's n words
    lacks few of them, so it holds one of the rarest n - ceil(0.8 n) + 1; pages are looked for by those alone, and a word that
    most pages of an entity have pairs nothing. What is found, and the page that a quote names, is then counted in full.
    """
    from kithgraph.functions.text import url_key

    q = quotes.select("quote_id", "entity_id", url_key("source_url").alias("source"), words(F.col("quote")).alias("w"))
    p = pages.select("entity_id", url_key("url").alias("page"), words(F.col("text")).alias("held")).groupBy("entity_id", "page").agg(F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"))
    of_page = p.select("entity_id", "page", F.explode("held").alias("word"))
    uses = of_page.groupBy("entity_id", "word").agg(F.count("*").alias("uses"))
    each = q.select("quote_id", "entity_id", F.size("w").alias("n"), F.explode("w").alias("word")).join(uses, ["entity_id", "word"], "left")
    ordered = each.groupBy("quote_id", "entity_id", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "word"))).alias("o"))
    rare = ordered.select("quote_id", "entity_id", F.explode(F.array_distinct(F.slice("o", F.lit(1), F.col("n") - F.ceil(F.col("n") * CLEAN - 1e-9).cast("int") + 1)["word"])).alias("word"))
    near = rare.join(of_page, ["entity_id", "word"]).select("quote_id", "entity_id", "page").unionByName(q.select("quote_id", "entity_id", F.col("source").alias("page"))).distinct()
    holds = F.filter("w", lambda x: F.array_contains("held", x))
    sized = q.select("quote_id", "source", "entity_id", F.size("w").alias("n"), F.size(F.filter("w", lambda x: x.rlike("^[0-9]"))).alias("n_numbers"))
    scored = near.join(q, ["quote_id", "entity_id"]).join(p, ["entity_id", "page"]).select("quote_id", "source", "page", F.try_divide(F.size(holds), F.size("w")).alias("coverage"), F.size(F.filter(holds, lambda x: x.rlike("^[0-9]"))).alias("numbers"))
    best = scored.where(F.col("coverage") >= CLEAN).groupBy("quote_id").agg(F.min_by(F.struct("page", "coverage", "numbers"), F.struct(-F.col("coverage"), F.col("page") != F.col("source"), "page")).alias("best"))
    own = scored.where("page = source and coverage > 0").select("quote_id", F.col("coverage").alias("own"))
    known = p.select("entity_id", F.col("page").alias("source")).withColumn("crawled", F.lit(True))
    rows = sized.join(best, "quote_id", "left").join(own, "quote_id", "left").join(known, ["entity_id", "source"], "left")
    clean = (F.col("best.coverage") >= CLEAN) & (F.col("best.numbers") >= F.col("n_numbers")) & (F.col("n") >= STRICT_WORDS)
    at_source = F.coalesce("own", F.lit(0.0))
    weak = F.when(F.col("n") < STRICT_WORDS, at_source > 0).otherwise(at_source >= WEAK)
    status = F.when(clean & (F.col("best.page") == F.col("source")), "pass").when(clean, "grounded_elsewhere").when(F.col("crawled").isNull(), "source_not_crawled").when(weak, "weak_quote").otherwise("fail")
    coverage = F.when(status.isin("pass", "grounded_elsewhere"), F.col("best.coverage")).when(status == "source_not_crawled", 0.0).otherwise(at_source)
    return rows.select("quote_id", status.alias("status"), F.round(coverage, 6).alias("coverage"))


def price_issue(kind: Column, value: Column, quote: Column) -> Column:
    """What is wrong with a price: a nightly rate, or a value out of range; null if nothing."""
    out = F.when(quote.rlike(NIGHTLY), "nightly_rate")
    for name, (low, high) in RANGES.items():
        out = out.when((kind == name) & ~value.between(low, high), "implausible")
    return out


def minimum_issue(kind: Column, amount: Column) -> Column:
    """A guest minimum like a sum of money, or a spend minimum like a number of guests."""
    return F.when((kind == "guest_minimum") & (amount > 1000), "guest_minimum_is_money").when((kind == "fb_minimum") & (amount < 500), "fb_minimum_is_guests")


def bar_policy(bar: Column, add_ons: Column) -> Column:
    """A corkage fee means that guests may bring their own."""
    return F.when((bar == "in_house") & F.exists(add_ons, lambda x: F.lower(x).contains("corkage")), "byo_with_corkage").otherwise(bar)


def fuzzy_duplicates(names: DataFrame, most: int = 2) -> DataFrame:
    """Spaces of a venue whose names are within `most` edits or contain each other. names: entity_id, id, name."""
    key = F.regexp_replace(F.lower("name"), r"[^a-z0-9]", "")
    base = names.select("entity_id", "id", key.alias("k"))
    a, b = base.select("entity_id", F.col("id").alias("id_a"), F.col("k").alias("k_a")), base.select("entity_id", F.col("id").alias("id_b"), F.col("k").alias("k_b"))
    near = (F.levenshtein("k_a", "k_b", most) >= 0) | F.col("k_a").contains(F.col("k_b")) | F.col("k_b").contains(F.col("k_a"))
    return a.join(b, "entity_id").where((F.col("id_a") < F.col("id_b")) & near).select("entity_id", "id_a", "id_b")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes between two versions as rows (entity_id, path, value): added, removed or changed; equal values give no row."""
    both = before.select("entity_id", "path", F.col("value").alias("old"), F.lit(None).cast("string").alias("new"), F.lit(1).alias("b"), F.lit(0).alias("a"))
    both = both.unionByName(after.select("entity_id", "path", F.lit(None).cast("string").alias("old"), F.col("value").alias("new"), F.lit(0).alias("b"), F.lit(1).alias("a")))
    per = both.groupBy("entity_id", "path").agg(F.max("old").alias("old"), F.max("new").alias("new"), F.sum("b").alias("b"), F.sum("a").alias("a"))
    kind = F.when(F.col("b") == 0, "added").when(F.col("a") == 0, "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return per.withColumn("change", kind).where("change is not null").select("entity_id", "path", "change", "old", "new")


def corrected(values: DataFrame, corrections: DataFrame) -> DataFrame:
    """Values with the latest correction of each path: set, unset or retire. Of equal times the first correction stays.

    values: entity_id, path, value; corrections: entity_id, path, action, value, at, id.
    """
    last = latest_by(corrections, ["entity_id", "path"], [F.desc("at"), F.col("id")]).select("entity_id", "path", "action", F.col("value").alias("_v"))
    rows = values.join(last, ["entity_id", "path"], "left").where("action is null or action = 'set'")
    kept = rows.select("entity_id", "path", F.when(F.col("action") == "set", F.col("_v")).otherwise(F.col("value")).alias("value"))
    new = last.where("action = 'set'").join(values, ["entity_id", "path"], "left_anti").select("entity_id", "path", F.col("_v").alias("value"))
    return kept.unionByName(new)


def served_run(runs: DataFrame) -> DataFrame:
    """The run to serve per entity: the latest that passed, else the latest of all."""
    return latest_by(runs, ["entity_id"], [F.col("passed").desc_nulls_last(), F.desc("at"), F.desc("run_id")])


def headline_capacity(capacities: DataFrame, spaces: DataFrame) -> DataFrame:
    """The capacity that a venue is compared by: (venue_id, headline, layout, space_id, cocktail_only).

    Seated dinner before seated with dance before other seated before cocktail; the largest of a kind. Other events' rows
    never count; whole-venue rows only if there are no others; of several spaces only those bookable by themselves.
    capacities: venue_id, space_id, layout, tile, max, condition; spaces: venue_id, space_id, bookable.
    """
    per = spaces.groupBy("venue_id").agg(F.count("*").alias("n_spaces"))
    scoped = capacities.groupBy("venue_id").agg(F.bool_or(F.col("space_id") != "whole_venue").alias("scoped"))
    rows = capacities.join(scoped, "venue_id").join(per, "venue_id", "left").join(spaces, ["venue_id", "space_id"], "left")
    rows = rows.where(~F.coalesce(F.col("condition").rlike(OTHER_EVENT), F.lit(False)))
    bookable = F.when(F.col("space_id") == "whole_venue", ~F.col("scoped")).otherwise((F.coalesce("n_spaces", F.lit(0)) <= 1) | F.coalesce("bookable", F.lit(True)))
    rank = (
        F.when((F.col("layout") == "seated_dinner") & bookable, 0).when((F.col("layout") == "seated_with_dance") & bookable, 1)
        .when((F.col("layout") == "other") & (F.col("tile") == "seated") & bookable, 2).when(F.col("tile") == "cocktail", 3)
    )
    ranked = rows.withColumn("_r", rank).where("_r is not null")
    best = ranked.groupBy("venue_id").agg(F.min_by(F.struct("max", "layout", "space_id", "_r"), F.struct("_r", -F.col("max"), "space_id")).alias("b"))
    return best.select("venue_id", F.col("b.max").alias("headline"), F.col("b.layout").alias("layout"), F.col("b.space_id").alias("space_id"), (F.col("b._r") == 3).alias("cocktail_only"))


def day_matches(stated: Column, day: Column) -> Column:
    """Whether a price for a day holds on another: any, the same, or weekday for Monday to Thursday."""
    return stated.isNull() | (stated == "any") | (stated == day) | ((stated == "weekday") & day.isin("mon", "tue", "wed", "thu"))


def season_matches(stated: Column, season: Column) -> Column:
    return stated.isNull() | (stated == "any") | (stated == season)


def specificity(day: Column, season: Column) -> Column:
    """How specific a price is: a day counts 2, weekday 1, a season 1."""
    by_day = F.when(day.isNull() | (day == "any"), 0).when(day == "weekday", 1).otherwise(2)
    return by_day + F.when(season.isNull() | (season == "any"), 0).otherwise(1)


def cost_estimate(requests: DataFrame, fees: DataFrame, tiers: DataFrame, minimums: DataFrame, rates: DataFrame) -> DataFrame:
    """What an event would cost: venue fees, catering by the most specific tier, service charge, sales tax and card fee.

    requests: request_id, path_id, guests, day, season, space_id, card; fees: path_id, label, amount, space_id (null for the
    whole venue), day, season, hours; tiers: path_id, tier_id, per_guest, day, season; minimums: path_id, kind, amount, day,
    season; rates: path_id, service_pct, service_on_all, tax_pct, tax_on_all, card_pct. A fee of the chosen space takes the
    place of whole-venue fees. Sums of money round half up.
    """
    r = requests
    met = r.join(fees.withColumnRenamed("space_id", "fee_space").withColumnRenamed("day", "fee_day").withColumnRenamed("season", "fee_season"), "path_id")
    met = met.where(~F.coalesce(F.col("label").rlike(DAYTIME), F.lit(False)) & day_matches(F.col("fee_day"), F.col("day")) & season_matches(F.col("fee_season"), F.col("season")) & (F.col("fee_space").isNull() | (F.col("fee_space") == F.col("space_id"))))
    own_space = fees.where("space_id is not null").select("path_id", "space_id").distinct().withColumn("own", F.lit(True))
    met = met.join(own_space, ["path_id", "space_id"], "left").where(F.col("own").isNull() | F.col("fee_space").isNotNull())
    venue = met.groupBy("request_id").agg(F.sum(F.col("amount") * F.coalesce("hours", F.lit(1))).alias("venue"))
    t = r.join(tiers.withColumnRenamed("day", "t_day").withColumnRenamed("season", "t_season"), "path_id").where(day_matches(F.col("t_day"), F.col("day")) & season_matches(F.col("t_season"), F.col("season")))
    food = t.groupBy("request_id").agg(F.min_by(F.col("guests") * F.col("per_guest"), F.struct(-specificity(F.col("t_day"), F.col("t_season")), "tier_id")).alias("food"))
    m = r.join(minimums.withColumnRenamed("day", "m_day").withColumnRenamed("season", "m_season"), "path_id").where(season_matches(F.col("m_season"), F.col("season")) & (F.col("m_day").isNull() | (F.col("m_day") == "any") | (F.col("m_day") == F.col("day"))))
    least = m.groupBy("request_id").agg(*[F.min_by(F.when(F.col("kind") == k, F.col("amount")), F.when(F.col("kind") == k, F.struct((~F.col("m_day").eqNullSafe(F.col("day"))).alias("other"), "amount"))).alias(k) for k in ("guest_minimum", "fb_minimum")])
    rows = r.join(venue, "request_id", "left").join(food, "request_id", "left").join(least, "request_id", "left").join(rates, "path_id", "left")
    v, f = F.coalesce("venue", F.lit(0.0)), F.coalesce("food", F.lit(0.0))
    pct = lambda base, c: F.floor(base * F.coalesce(F.col(c), F.lit(0.0)) / 100 + 0.5)
    service = pct(F.when(F.coalesce("service_on_all", F.lit(False)), v + f).otherwise(f), "service_pct")
    rows = rows.withColumn("_v", v).withColumn("_f", f).withColumn("service", service)
    rows = rows.withColumn("tax", pct(F.col("_f") + F.col("service") + F.when(F.coalesce("tax_on_all", F.lit(False)), F.col("_v")).otherwise(0.0), "tax_pct"))
    rows = rows.withColumn("card_fee", F.when(F.coalesce("card", F.lit(False)), pct(F.col("_v") + F.col("_f") + F.col("service") + F.col("tax"), "card_pct")).otherwise(0))
    return rows.select(
        "request_id", F.round("_v", 2).alias("venue"), F.round("_f", 2).alias("food"), "service", "tax", "card_fee", F.round(F.col("_v") + F.col("_f") + F.col("service") + F.col("tax") + F.col("card_fee"), 2).alias("total"),
        F.coalesce(F.col("guests") < F.col("guest_minimum"), F.lit(False)).alias("under_minimum"), F.coalesce(F.col("_f") < F.col("fb_minimum"), F.lit(False)).alias("under_fb_minimum"),
    )


def price_grid(prices: DataFrame, seasons: list[str]) -> DataFrame:
    """Prices by day and season as a table with a column per season. prices: venue_id, day, season, amount."""
    return prices.groupBy("venue_id", "day").pivot("season", seasons).agg(F.min("amount"))


def golden_score(candidate: DataFrame, golden: DataFrame) -> DataFrame:
    """Per tier of fields: golden facts, found ones, right ones, accuracy. Both: entity_id, path, value; golden also tier."""
    met = golden.join(candidate.select("entity_id", "path", F.col("value").alias("_v"), F.lit(True).alias("_f")), ["entity_id", "path"], "left")
    per = met.groupBy("tier").agg(F.count("*").alias("facts"), F.count_if("_f").alias("found"), F.count_if(F.col("_v").eqNullSafe(F.col("value")) & F.col("_f")).alias("right"))
    return per.withColumn("accuracy", F.round(F.col("right") / F.col("facts"), 6))


def rolled_back(versions: DataFrame, targets: DataFrame) -> DataFrame:
    """All versions (id, version, doc) and, for each target (id, version), a new one after the last with the old one's content.

    Nothing is rewritten. Targets without such a version, or that are the last one already, add nothing.
    """
    last = versions.groupBy("id").agg(F.max("version").alias("last"))
    old = versions.join(targets.select("id", "version").distinct(), ["id", "version"]).join(last, "id").where("version < last")
    return versions.select("id", "version", "doc").unionByName(old.select("id", (F.col("last") + 1).alias("version"), "doc"))
