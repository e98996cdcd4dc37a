"""What an event at a venue can cost at least and at most, over its paths, tiers, days and seasons.

A path's fees and tiers are gathered into its row (they are a price list, small by nature), so no join is made per combination.
Days and seasons are told as bits where a price is read, once; all combinations of a batch of rows are then priced at once, in
columns. For a day and a season the cost rises with the guests and with the price of the tier, so the ends of both give the ends of
the cost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.operators.documents import DAYTIME, day_matches, season_matches, specificity

# Days and seasons of an event, least guests where none are stated, the defaults of a path that varies by neither.
DAYS, SEASONS, LEAST_GUESTS, DAY, SEASON = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"], ["peak", "off"], 10, "sat", "peak"

#: Whose a fee is: of the whole venue, of the path's own space, of another one.
WHOLE, OWN, OTHER = 0, 1, 2
PATHS = "venue_id, path_id, min_guests, max_guests, space_id"


def held(day: Column, season: Column) -> Column:
    """The days and seasons that a price holds on, as bits: the days of DAYS from the lowest bit on, then the seasons of SEASONS."""
    tests = [day_matches(day, F.lit(d)) for d in DAYS] + [season_matches(season, F.lit(s)) for s in SEASONS]
    bits = F.lit(0)
    for i, t in enumerate(tests):
        bits = bits + F.when(t, F.lit(1 << i)).otherwise(0)
    return bits


def priced_paths(paths: DataFrame, fees: DataFrame, tiers: DataFrame, rates: DataFrame) -> DataFrame:
    """Paths with their price list in the row: fees, tiers and rates, fees and tiers in the order of their place.

    paths: venue_id, path_id, min_guests, max_guests, space_id; fees: venue_id, path_id, place, label, amount, space_id (null for
    the whole venue), day, season; tiers: venue_id, path_id, place, tier_id, name, per_guest, day, season; rates: venue_id,
    service_pct, service_on_all, tax_pct, tax_on_all. Fees without an amount and tiers without a price are none; no guests
    stated give 10 and what is stated at least. Each fee and tier has `held`, of a fee 0 where it is for daytime only.
    Paths are one row each; they meet their prices in one aggregation, and frames that are dealt by venue_id alike are not moved again.
    """
    key = ["venue_id", "path_id"]
    bits = held(F.col("day"), F.col("season"))
    fee_bits = F.when(F.coalesce(F.col("label").rlike(DAYTIME), F.lit(False)), 0).otherwise(bits)
    fee = F.struct("place", "label", "amount", "space_id", "day", "season", fee_bits.alias("held"))
    tier = F.struct("place", "tier_id", "name", "per_guest", "day", "season", bits.alias("held"), specificity(F.col("day"), F.col("season")).alias("rank"))
    known = F.col("venue_id").isNotNull() & F.col("path_id").isNotNull()
    least = F.coalesce("min_guests", F.lit(LEAST_GUESTS))
    rated = paths.select(*key, "space_id", least.alias("least"), F.greatest(F.coalesce("max_guests", least), least).alias("most")).join(rates, "venue_id", "left")
    rows = rated.select(*key, F.struct(*[c for c in rated.columns if c not in key]).alias("path"))
    for entries in (fees.where(known & F.col("amount").isNotNull()).select(*key, fee.alias("fee")), tiers.where(known & F.col("per_guest").isNotNull()).select(*key, tier.alias("tier"))):
        rows = rows.unionByName(entries, allowMissingColumns=True)
    # sort_array and not array_sort, which compares by a lambda function
    rows = rows.groupBy(*key).agg(F.max("path").alias("path"), F.sort_array(F.collect_list("fee")).alias("fees"), F.sort_array(F.collect_list("tier")).alias("tiers"))
    return rows.where("path is not null").select(*key, "path.*", "fees", "tiers")


def venue_fee(day: Column, season: Column) -> Column:
    """What the chosen space costs on a day and in a season; its own fees take the place of fees of the whole venue."""
    own = F.exists("fees", lambda f: f["space_id"].isNotNull() & (f["space_id"] == F.col("space_id")))
    due = lambda f: ~F.coalesce(f["label"].rlike(DAYTIME), F.lit(False)) & F.coalesce(day_matches(f["day"], day) & season_matches(f["season"], season), F.lit(False)) & F.coalesce(F.when(f["space_id"].isNull(), ~own).otherwise(f["space_id"] == F.col("space_id")), F.lit(False))
    return F.aggregate(F.filter("fees", due), F.lit(0.0), lambda s, f: s + f["amount"].cast("double"))


def total(venue: Column, food: Column) -> Column:
    """Venue and food with service charge and sales tax; money is rounded half up."""
    pct = lambda base, c: F.floor(base * F.coalesce(F.col(c), F.lit(0.0)) / 100 + 0.5)
    service = pct(food + F.when(F.coalesce("service_on_all", F.lit(False)), venue).otherwise(0.0), "service_pct")
    tax = pct(food + service + F.when(F.coalesce("tax_on_all", F.lit(False)), venue).otherwise(0.0), "tax_pct")
    return F.round(venue + food + service + tax, 2)


def of_rows(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """The row of each element of lists, and the elements."""
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten()


def numbers(elements: pa.StructArray, name: str) -> np.ndarray:
    return elements.field(name).to_numpy(zero_copy_only=False)


def ends_of_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row the least cost for the least guests and the greatest for the most, before rounding.

    A space's own fees take the place of the whole venue's. Of the tiers that hold, each name counts with its most specific one, the
    first of equals. Sums are made in the order of the fees.
    """
    for batch in batches:
        n = batch.num_rows
        row, fees = of_rows(batch["fees"])
        whose, amount, fee_bits = numbers(fees, "whose"), numbers(fees, "amount"), numbers(fees, "held")
        has_own = np.bincount(row[whose == OWN], minlength=n) > 0
        due = (whose == OWN) | ((whose == WHOLE) & ~has_own[row])
        row, amount, fee_bits = row[due], amount[due], fee_bits[due]
        of, tiers = of_rows(batch["tiers"])
        name = tiers.field("name").dictionary_encode().indices.fill_null(-1).to_numpy()
        turn = np.lexsort((-numbers(tiers, "rank"), name, of))  # stable: equals stay in the order of their list
        of, name, price, tier_bits = of[turn], name[turn], numbers(tiers, "price")[turn], numbers(tiers, "held")[turn]
        column = lambda c: batch[c].to_numpy(zero_copy_only=False)  # noqa: E731, B023
        service, tax, least, most = column("service"), column("tax"), column("least").astype(float), column("most").astype(float)
        served, taxed = column("service_on_all"), column("tax_on_all")

        def total(venue: np.ndarray, food: np.ndarray, service=service, tax=tax, served=served, taxed=taxed) -> np.ndarray:
            more = np.floor((food + np.where(served, venue, 0.0)) * service / 100 + 0.5)
            return venue + food + more + np.floor((food + more + np.where(taxed, venue, 0.0)) * tax / 100 + 0.5)

        low, high = np.full(n, np.nan), np.full(n, -np.inf)
        for both in [1 << i | 1 << (len(DAYS) + j) for i in range(len(DAYS)) for j in range(len(SEASONS))]:
            now = (fee_bits & both) == both
            venue = np.bincount(row[now], amount[now], n)
            at = np.flatnonzero((tier_bits & both) == both)
            first = np.ones(len(at), bool)
            first[1:] = (np.diff(of[at]) != 0) | (np.diff(name[at]) != 0)
            at = at[first]
            cheap, dear = np.zeros(n), np.zeros(n)
            if len(at):
                starts = np.flatnonzero(np.append(True, np.diff(of[at]) != 0))
                cheap[of[at][starts]], dear[of[at][starts]] = np.fmin.reduceat(price[at], starts), np.maximum.reduceat(price[at], starts)
            low, high = np.fmin(low, total(venue, cheap * least)), np.maximum(high, total(venue, dear * most))
        yield pa.RecordBatch.from_arrays([batch["venue_id"], batch["path_id"], pa.array(low), pa.array(high)], ["venue_id", "path_id", "low", "high"])


def extremes(priced: DataFrame) -> DataFrame:
    """(venue_id, low, low_path, high, high_path): the least and the greatest cost over all paths, days, seasons, tiers and guests.

    Days and seasons are all there are; a day without a tier has no food. Paths without fees and tiers cost nothing and are
    left out; ties go to the least path. Rounding keeps the order of costs, so only the ends are rounded.
    """
    whose = lambda f: F.when(f["space_id"].isNull(), WHOLE).when(f["space_id"] == F.col("space_id"), OWN).otherwise(OTHER)
    fees = F.transform("fees", lambda f: F.struct(whose(f).alias("whose"), f["amount"].cast("double").alias("amount"), f["held"].alias("held")))
    tiers = F.transform("tiers", lambda t: F.struct(t["name"].alias("name"), t["per_guest"].cast("double").alias("price"), t["held"].alias("held"), t["rank"].alias("rank")))
    pct, on_all = (lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))), (lambda c: F.coalesce(c, F.lit(False)).alias(c))
    rows = priced.where((F.size("fees") > 0) | (F.size("tiers") > 0))
    rows = rows.select("venue_id", "path_id", "least", "most", fees.alias("fees"), tiers.alias("tiers"), pct("service_pct").alias("service"), on_all("service_on_all"), pct("tax_pct").alias("tax"), on_all("tax_on_all"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    rows = rows.mapInArrow(ends_of_costs, f"venue_id {kind['venue_id']}, path_id {kind['path_id']}, low double, high double").select("venue_id", "path_id", F.round("low", 2).alias("low"), F.round("high", 2).alias("high"))
    out = rows.groupBy("venue_id").agg(F.min(F.struct("low", "path_id")).alias("l"), F.min(F.struct((-F.col("high")).alias("high"), "path_id")).alias("h"))
    return out.select("venue_id", F.col("l.low").alias("low"), F.col("l.path_id").alias("low_path"), (-F.col("h.high")).alias("high"), F.col("h.path_id").alias("high_path"))


def shown_range(priced: DataFrame) -> DataFrame:
    """(venue_id, path_id, low, high, low_day, high_day, low_tier, high_tier): the example range of a path.

    From the least guests with the cheap day, season and tier to the most guests with the dear ones. The cheap day is weekday
    if the path names it, else the first that is not Saturday; the dear one is Saturday, else the last. Days are told where
    the path names several, tiers where it has several names. A pinned tier counts only where it holds; else the most specific
    one that does.
    """
    named = lambda c: F.array_distinct(F.filter(F.concat(F.transform("fees", lambda f: f[c]), F.transform("tiers", lambda t: t[c])), lambda x: x.isNotNull()))
    days, seasons, names = named("day"), named("season"), F.array_distinct(F.transform("tiers", lambda t: t["name"]))
    other = F.filter(days, lambda x: x != DAY)
    cheap_day = F.when(F.array_contains(days, "weekday"), "weekday").otherwise(F.coalesce(F.try_element_at(other, F.lit(1)), F.try_element_at(days, F.lit(1)), F.lit(DAY)))
    dear_day = F.when(F.array_contains(days, DAY), DAY).otherwise(F.coalesce(F.try_element_at(days, F.lit(-1)), F.lit(DAY)))
    cheap_season = F.when(F.array_contains(seasons, "off"), "off").otherwise(F.coalesce(F.try_element_at(seasons, F.lit(1)), F.lit(SEASON)))
    dear_season = F.when(F.array_contains(seasons, SEASON), SEASON).otherwise(F.coalesce(F.try_element_at(seasons, F.lit(-1)), F.lit(SEASON)))
    by_price = lambda sign: F.array_min(F.transform("tiers", lambda t: F.struct((t["per_guest"] * sign).alias("p"), t["place"].alias("place"), t["tier_id"].alias("tier_id"), t["name"].alias("name"))))
    rows = priced.select("*", cheap_day.alias("low_d"), dear_day.alias("high_d"), cheap_season.alias("low_s"), dear_season.alias("high_s"), (F.size(days) > 1).alias("by_day"), F.when(F.size(names) > 1, by_price(1)).alias("low_t"), F.when(F.size(names) > 1, by_price(-1)).alias("high_t"))

    def cost(end: str, guests: str) -> Column:
        day, season = F.col(f"{end}_d"), F.col(f"{end}_s")
        fits = F.filter("tiers", lambda t: F.coalesce(day_matches(t["day"], day) & season_matches(t["season"], season), F.lit(False)))
        pinned = F.filter(fits, lambda t: t["tier_id"].eqNullSafe(F.col(f"{end}_t.tier_id")) & F.col(f"{end}_t").isNotNull())
        ranked = F.array_min(F.transform(fits, lambda t: F.struct((-specificity(t["day"], t["season"])).alias("s"), t["place"].alias("place"), t["per_guest"].alias("per_guest"))))
        price = F.coalesce(F.try_element_at(pinned, F.lit(1))["per_guest"], ranked["per_guest"], F.lit(0)).cast("double")
        return total(venue_fee(day, season), price * F.col(guests))

    return rows.select(
        "venue_id", "path_id", cost("low", "least").alias("low"), cost("high", "most").alias("high"), F.when(F.col("by_day"), F.col("low_d")).alias("low_day"), F.when(F.col("by_day"), F.col("high_d")).alias("high_day"),
        F.col("low_t.name").alias("low_tier"), F.col("high_t.name").alias("high_tier"),
    )
