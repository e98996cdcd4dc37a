"""Entity resolution: blocks, set similarity within date windows, greedy events, reconciliation, merges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithgraph.operators.helpers import jaccard
from kithgraph.session import ensure_checkpoints

#: Rows of a batch that a fold gives back.
ROWS = 10_000
#: Signs of a name up to which names meet on variants: one of 40 signs has 821 within two edits.
LONG = 40


def alike_within(rows: DataFrame, days: int, above: float) -> DataFrame:
    """Pairs (id_a < id_b, jaccard) of one block whose dates are `days` apart at most and whose member sets are alike above a bound.

    rows: id, block, date, members. Rows meet by block and by window of days: each row goes to its own window and, on one
    side, to the next, so pairs need no look at the whole block. Nulls never pair.
    """
    window = F.floor(F.unix_date("date") / (days + 1))
    a = rows.select(F.col("id").alias("id_a"), "block", F.col("date").alias("date_a"), F.col("members").alias("members_a"), F.explode(F.array(window - 1, window, window + 1)).alias("_w"))
    b = rows.select(F.col("id").alias("id_b"), "block", F.col("date").alias("date_b"), F.col("members").alias("members_b"), window.alias("_w"))
    near = a.join(b, ["block", "_w"]).where((F.col("id_a") < F.col("id_b")) & (F.abs(F.datediff("date_a", "date_b")) <= days))
    return near.withColumn("jaccard", jaccard(F.col("members_a"), F.col("members_b"))).where(F.col("jaccard") > above).select("id_a", "id_b", "block", "date_a", "date_b", "jaccard")


def pairs_in_groups(rows: DataFrame, most: int) -> DataFrame:
    """All pairs (id_a < id_b) within blocks of at most `most` rows; larger blocks say too little to pair. rows: id, block."""
    sizes = rows.groupBy("block").agg(F.count("*").alias("_n")).where(F.col("_n").between(2, most))
    kept = rows.join(sizes, "block")
    return kept.select(F.col("id").alias("id_a"), "block").join(kept.select(F.col("id").alias("id_b"), "block"), "block").where("id_a < id_b")


def variants(name: Column, most: int) -> Column:
    """A name and what is left of it without up to so many of its signs, each once."""
    places = lambda x: F.when(F.char_length(x) > 0, F.sequence(F.lit(1), F.char_length(x))).otherwise(F.array().cast("array<int>"))
    cut = lambda x: F.transform(places(x), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.char_length(x))))
    every = last = F.array(name)
    for _ in range(most):
        last = F.array_distinct(F.flatten(F.transform(last, cut)))
        every = F.concat(every, last)
    return F.array_distinct(every)


def within_edits(names: DataFrame, most: int) -> DataFrame:
    """Pairs (id_a < id_b, distance) of names within so many edits. names: id, name, and block where only names of one block may meet.

    Two names within k edits are one string once each has lost the right k signs or fewer, so names of up to LONG signs meet
    on the hashes of such variants: a beginning that very many names share brings none together. Longer names meet on pieces.
    """
    block = ["block"] if "block" in names.columns else []
    # a small table makes many variants, so it is dealt to as many tasks as a shuffle has
    base = names.where("name is not null").select("id", "name", *block).repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    keys = F.transform(variants(F.col("name"), most), lambda v: F.xxhash64(v, *[F.col(c) for c in block]))
    each = base.where(F.char_length("name") <= LONG).select("id", "name", *block, F.explode(F.array_distinct(keys)).alias("key"))
    side = lambda end: each.select("key", *block, F.col("id").alias(f"id_{end}"), F.col("name").alias(f"name_{end}"))
    distance = F.levenshtein("name_a", "name_b", most)
    # what the variants come to is not seen in the size of the table, so they must not be broadcast
    met = side("a").hint("merge").join(side("b").hint("merge"), ["key", *block]).where("id_a < id_b").where(F.abs(F.char_length("name_a") - F.char_length("name_b")) <= most)
    near = met.select("id_a", "id_b", distance.alias("distance")).where("distance >= 0")
    return near.unionByName(within_edits_on_pieces(base.where(F.char_length("name") > LONG - most), most)).distinct()


def within_edits_on_pieces(names: DataFrame, most: int) -> DataFrame:
    """The pairs of within_edits for long names, whose variants would be too many.

    Names of nearby lengths meet by a piece: of two names within k edits, one of the k + 1 even pieces of the one is found
    in the other, shifted by k at most, so rows join on (length, piece, text) instead of on length alone.
    """
    size, block = F.char_length("name"), ["block"] if "block" in names.columns else []
    base = names.where("name is not null").select("id", "name", *block, size.alias("n"))
    parts = most + 1
    begin = lambda n, i: F.floor(n * i / parts).cast("int")
    cut = lambda i: F.substring(F.col("name"), begin(F.col("n"), i) + 1, begin(F.col("n"), i + 1) - begin(F.col("n"), i))
    pieces = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(most)), cut)).alias("i", "piece")
    piece = base.select(F.col("id").alias("id_a"), F.col("name").alias("name_a"), F.col("n").alias("n_a"), *block, pieces)
    lengths = F.explode(F.sequence(F.greatest(F.lit(0), F.col("n") - most), F.col("n") + most)).alias("n_a")
    shifted = base.select(F.col("id").alias("id_b"), F.col("name").alias("name_b"), *block, lengths, "n")
    shifted = shifted.select("id_b", "name_b", "n_a", *block, F.explode(F.sequence(F.lit(0), F.lit(most))).alias("i"))
    shifted = shifted.select("id_b", "name_b", "n_a", *block, "i", F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("shift"))
    at, length = begin(F.col("n_a"), F.col("i")) + F.col("shift"), begin(F.col("n_a"), F.col("i") + 1) - begin(F.col("n_a"), F.col("i"))
    inside = shifted.where((at >= 0) & (at + length <= F.char_length("name_b")))
    shifted = inside.select("id_b", "name_b", "n_a", *block, "i", F.substring(F.col("name_b"), at + 1, length).alias("piece")).distinct()
    first = lambda x, y: F.when(F.col("id_a") < F.col("id_b"), F.col(x)).otherwise(F.col(y))
    met = piece.join(shifted, ["n_a", *block, "i", "piece"]).where("id_a <> id_b")
    near = met.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), first("name_a", "name_b").alias("x"), first("name_b", "name_a").alias("y")).distinct()
    return near.withColumn("distance", F.levenshtein("x", "y")).where(F.col("distance") <= most).select("id_a", "id_b", "distance")


def best_match(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """Per candidate the most alike event of its block, by Jaccard then least event id; none gives nulls.

    Both: id, block, date, members. Candidates without a block are left out. Pairs meet on (block, member), so only events
    that share a member are counted; a candidate that shares none has the block's least event, at a likeness of 0.
    """
    sized = lambda df, i: df.where("block is not null").select(F.col("id").alias(i), "block", F.col("date").alias(f"{i}_date"), F.array_distinct(F.coalesce("members", F.array())).alias("m"))
    c, e = sized(candidates, "candidate_id"), sized(events, "event_id")
    each = lambda df, i: df.select(i, "block", F.explode("m").alias("member"))
    met = each(c, "candidate_id").join(each(e, "event_id"), ["block", "member"]).groupBy("candidate_id", "event_id").agg(F.count("*").alias("both"))
    size = lambda df, i: df.select(i, F.col(f"{i}_date"), F.size("m").alias(f"{i}_n"))
    scored = met.join(size(c, "candidate_id"), "candidate_id").join(size(e, "event_id"), "event_id")
    scored = scored.withColumn("jaccard", F.col("both") / (F.col("candidate_id_n") + F.col("event_id_n") - F.col("both"))).withColumn("days", F.abs(F.datediff("candidate_id_date", "event_id_date")))
    best = scored.groupBy("candidate_id").agg(F.min_by(F.struct("event_id", "jaccard", "days"), F.struct(-F.col("jaccard"), "event_id")).alias("best"))
    least = e.groupBy("block").agg(F.min_by(F.struct("event_id", "event_id_date"), "event_id").alias("least"))
    rows = c.join(best, "candidate_id", "left").join(least, "block", "left")
    other = F.when(F.col("least").isNotNull(), F.struct(F.col("least.event_id").alias("event_id"), F.lit(0.0).alias("jaccard"), F.abs(F.datediff("candidate_id_date", "least.event_id_date")).alias("days")))
    return rows.select("candidate_id", F.coalesce("best", other).alias("m")).select("candidate_id", "m.*")


def reconciled(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """The belief which event a candidate is: strong, ambiguous or insufficient, with confidence 0.8, 0.4 or 0.1.

    Insufficient matches keep their signals but name no event; venue_match tells whether the venue has any event.
    """
    best = best_match(candidates, events)
    strong = (F.col("days") <= 14) & (F.col("jaccard") > 0.5)
    weak = (F.col("days") <= 30) | (F.col("jaccard") > 0.3)
    level = F.when(F.col("event_id").isNull(), "insufficient").when(strong, "high").when(weak, "ambiguous").otherwise("insufficient")
    out = best.withColumn("level", F.coalesce(level, F.lit("insufficient"))).withColumn("venue_match", F.col("event_id").isNotNull())
    confidence = F.when(F.col("level") == "high", 0.8).when(F.col("level") == "ambiguous", 0.4).otherwise(0.1)
    return out.select("candidate_id", F.when(F.col("level") != "insufficient", F.col("event_id")).alias("matched_event_id"), "level", confidence.alias("confidence"), F.round("jaccard", 6).alias("jaccard"), "days", "venue_match")


def merge_groups(candidates: DataFrame, days: int = 400) -> DataFrame:
    """Candidates of one venue and one couple within so many days that are not yet events merge into the least id.

    candidates: id, venue, couple, date, created. Groups with a created member, or a longer span, stay apart.
    """
    group = candidates.where("venue is not null and couple is not null").groupBy("venue", "couple").agg(F.min("id").alias("survivor"), F.count("*").alias("members"), F.datediff(F.max("date"), F.min("date")).alias("span"), F.bool_or("created").alias("created"))
    return group.where((F.col("members") > 1) & (F.coalesce(F.col("span"), F.lit(0)) <= days) & ~F.col("created")).select("venue", "couple", "survivor", "members", "span")


def duplicate_pairs(events: DataFrame, keys: dict[str, DataFrame], days: int = 400) -> DataFrame:
    """Pairs of events at one venue that share something, within so many days, with the reasons in order.

    events: id, venue, date. keys: reason -> (id, key). Each reason is a join on venue, key and a window of `days`, of
    which each event looks into its own and the next on both sides.
    """
    every = None
    for reason, key in keys.items():
        side = events.join(key, "id").where("venue is not null and key is not null and date is not null")
        window = F.floor(F.unix_date("date") / (days + 1))
        a = side.select(F.col("id").alias("id_a"), "venue", "key", F.col("date").alias("date_a"), window.alias("window"))
        b = side.select(F.col("id").alias("id_b"), "venue", "key", F.col("date").alias("date_b"), F.explode(F.sequence(window - 1, window + 1)).alias("window"))
        part = a.join(b, ["venue", "key", "window"]).where((F.col("id_a") < F.col("id_b")) & (F.abs(F.datediff("date_a", "date_b")) <= days)).select("id_a", "id_b", F.lit(reason).alias("reason")).distinct()
        every = part if every is None else every.unionByName(part)
    return every.groupBy("id_a", "id_b").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def linked_components(rows: DataFrame, days: int) -> DataFrame:
    """(id, component) of the rows (id, date, members) that share a member within so many days with others, directly or through others.

    Rows of one member are linked to the one before by date, which gives the same components as all pairs. The least
    component id spreads along the links, with jumps, and a reliable checkpoint each round. Rows linked to none are left out.
    """
    ensure_checkpoints(rows.sparkSession)
    w = Window.partitionBy("member").orderBy("date", "id")
    each = rows.where("date is not null").select("id", "date", F.explode("members").alias("member"))
    link = each.select("id", F.lag("id").over(w).alias("other"), F.datediff("date", F.lag("date").over(w)).alias("gap")).where((F.col("gap") <= days) & (F.col("id") != F.col("other"))).select("id", "other").distinct()
    both = link.union(link.select("other", "id")).distinct().checkpoint()
    label = both.groupBy("id").agg(F.min("other").alias("m")).select("id", F.least("id", "m").alias("component"))
    while True:
        near = both.join(label.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("component").alias("m"))
        low = label.join(near, "id", "left").select("id", "component", F.least("component", "m").alias("low"))
        jump = low.join(low.select(F.col("id").alias("low"), F.col("low").alias("far")), "low", "left").select("id", "component", F.least("low", "far").alias("next")).checkpoint()
        changed = not jump.where("next <> component").isEmpty()
        label = jump.select("id", F.col("next").alias("component"))
        if not changed:
            return label


def fold_rows(posts: DataFrame, days: int = 21, seeds: DataFrame | None = None) -> DataFrame:
    """Posts and seeds as greedy_events folds them: component_seed, component_id, id, seed, day, couple, members; no component where there is nothing to fold.

    Several folds of the same posts and days may share these rows.
    """
    if "couple" not in posts.columns:
        posts = posts.withColumn("couple", F.lit(None).cast("string"))
    usable = F.coalesce(F.col("date").isNotNull() & (F.size("members") > 0), F.lit(False))
    rows = posts.select("id", F.when(usable, F.col("date")).alias("date"), F.when(usable, F.col("members")).alias("members"), "couple", F.lit(False).alias("seed"))
    if seeds is not None:
        old = seeds.where(usable).select(F.col("id").cast("long").alias("id"), "date", "members", F.lit(None).cast("string").alias("couple"), F.lit(True).alias("seed"))
        rows = rows.unionByName(old)
    node = F.struct("seed", "id")  # an event and a post may have one id
    found = linked_components(rows.select(node.alias("id"), "date", "members"), days if seeds is None else 2 * days)
    of = found.select(F.col("id.seed").alias("seed"), F.col("id.id").alias("id"), F.col("component.seed").alias("component_seed"), F.col("component.id").alias("component_id"))
    joined = rows.join(of, ["seed", "id"], "left")
    return joined.select("component_seed", "component_id", "id", "seed", F.when(F.col("component_id").isNotNull(), F.unix_date("date")).alias("day"), "couple", F.when(F.col("component_id").isNotNull(), F.array_distinct("members")).alias("members"))


def greedy_events(posts: DataFrame, days: int = 21, above: float = 0.5, inclusive: bool = False, best: bool = False, seeds: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """(event_id, post_id) of the sequential fold that attaches each post to an earlier event or opens one.

    posts: id, date, members (accounts, or account:role) and, if known, couple. By (date, id), a post joins the first event
    (with `best` the most alike) whose members are alike above the bound (`inclusive`: at least), whose first date is within
    `days` and whose couple, where both name one, is the same; its members join the event's. The event is named by its least
    post. seeds: events that exist already (id, date, members); posts meet them first, in the order of id, and the first
    post that joins one sets its date; events of theirs keep the seed's id. Posts that share no member can't meet, so the
    fold runs per component of those that do; a component is one task's work by the nature of the fold, and one of a single
    post needs none. A task reads its components one after the other and holds one of them. Posts without a date or members
    are events of their own. rows: the fold_rows of the same posts, days and seeds, where they are at hand.
    """
    rows = fold_rows(posts, days, seeds) if rows is None else rows
    blind = above < 0 or (inclusive and above == 0)  # then even events without a common member are alike

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component, events = None, []
        of: dict = {}  # member -> events that have it, as they were opened
        out: list[tuple] = []

        def opened(day: int, name: int | None) -> dict:
            events.append({"members": set(), "day": day, "posts": [], "couple": None, "seed": name, "at": len(events)})
            return events[-1]

        def joined(event: dict, members: set) -> None:
            for m in members - event["members"]:
                of.setdefault(m, []).append(event["at"])
            event["members"] |= members

        def told() -> None:
            out.extend((min(e["posts"]) if e["seed"] is None else e["seed"], p) for e in events for p in e["posts"])
            events.clear()
            of.clear()

        def batch(n: int) -> pa.RecordBatch:
            part, out[:] = out[:n], out[n:]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in part], pa.int64()) for i in (0, 1)], ["event_id", "post_id"])

        for given in batches:
            for in_seed, in_id, post, seed, day, couple, members in zip(*(c.to_pylist() for c in given.columns), strict=True):
                if component != (in_seed, in_id):
                    told()
                    component = (in_seed, in_id)
                own = set(members)
                if seed:
                    joined(opened(day, post), own)
                    continue
                found, most = None, -1.0
                for at in range(len(events)) if blind else sorted({e for m in own for e in of.get(m, ())}):
                    e = events[at]
                    if abs(day - e["day"]) > days or (couple and e["couple"] and couple != e["couple"]):
                        continue
                    both = len(own & e["members"])
                    share = both / (len(own) + len(e["members"]) - both)
                    if (share > above or inclusive and share == above) and share > most:
                        found, most = e, share
                        if not best:
                            break
                if found is None:
                    found = opened(day, None)
                elif found["seed"] is not None and not found["posts"]:
                    found["day"] = day
                found["couple"] = found["couple"] or couple
                joined(found, own)
                found["posts"].append(post)
            if out:
                yield batch(len(out))
        told()
        while out:
            yield batch(ROWS)

    alone = rows.where("component_id is null and not seed").select(F.col("id").alias("event_id"), F.col("id").alias("post_id"))  # nothing to fold
    in_turn = ["component_seed", "component_id", F.desc("seed"), F.when(~F.col("seed"), F.col("day")), "id"]
    linked = rows.where("component_id is not null").repartition("component_seed", "component_id").sortWithinPartitions(*in_turn)
    return linked.select("component_seed", "component_id", "id", "seed", "day", "couple", "members").mapInArrow(fold, "event_id long, post_id long").unionByName(alone)


def tag_clusters(posts: DataFrame, above: float = 0.5, least: int = 4) -> DataFrame:
    """(cluster_id, reason, n_posts, posts) of rejected posts with one reason and alike hashtags, of so many posts at least.

    posts: id, reason, tags. The fold of events without dates, in the order of id; tags meet within a reason, whatever
    their case. Posts without tags are left out.
    """
    tags = F.array_distinct(F.transform(F.filter("tags", lambda t: t.isNotNull()), lambda t: F.concat_ws(":", "reason", F.lower(t))))
    rows = posts.select("id", F.to_date(F.lit("2000-01-01")).alias("date"), tags.alias("members")).where(F.size("members") > 0)
    found = greedy_events(rows, above=above).withColumnRenamed("event_id", "cluster_id").join(posts.select(F.col("id").alias("post_id"), "reason"), "post_id")
    grouped = found.groupBy("cluster_id").agg(F.first("reason").alias("reason"), F.count("*").alias("n_posts"), F.array_sort(F.collect_list("post_id")).alias("posts"))
    return grouped.where(F.col("n_posts") >= least)


def alike_pairs(left: DataFrame, right: DataFrame, days: int = 21, above: float = 0.5) -> DataFrame:
    """(id_a, id_b, jaccard, days) of a left and a right event that are alike above the bound and within the days.

    Both: id, date, members, and block where only events of one block may meet. Sets that are so alike share one of their
    rarest members, all but the most frequent half at a bound of 0.5, so pairs meet on those, within windows of the days:
    a member of very many events is hardly ever among them.
    """
    block = ["block"] if "block" in left.columns else []
    sets = lambda df: df.where("date is not null").select("id", "date", *block, F.array_distinct(F.filter("members", lambda m: m.isNotNull())).alias("members")).where(F.size("members") > 0)
    a, b = sets(left), sets(right)
    count = a.select(F.explode("members").alias("member")).unionAll(b.select(F.explode("members").alias("member"))).groupBy("member").agg(F.count("*").alias("uses"))

    def rare(df: DataFrame) -> DataFrame:
        each = df.select("id", F.size("members").alias("n"), F.explode("members").alias("member")).join(count, "member")
        ordered = each.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("uses", "member"))).alias("m"))
        prefix = F.slice("m", F.lit(1), F.col("n") - F.ceil(F.col("n") * above - 1e-9).cast("int") + 1)
        return ordered.select("id", F.explode(prefix["member"]).alias("member"))

    window = F.floor(F.unix_date("date") / (days + 1))
    x = rare(a).join(a, "id").select(F.col("id").alias("id_a"), F.col("date").alias("date_a"), F.col("members").alias("of_a"), *block, "member", window.alias("window"))
    y = rare(b).join(b, "id").select(F.col("id").alias("id_b"), F.col("date").alias("date_b"), F.col("members").alias("of_b"), *block, "member", F.explode(F.sequence(window - 1, window + 1)).alias("window"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    jaccard = both / (F.size("of_a") + F.size("of_b") - both)
    met = x.join(y, [*block, "member", "window"]).where((F.abs(F.datediff("date_a", "date_b")) <= days) & (jaccard > above))
    return met.select("id_a", "id_b", jaccard.alias("jaccard"), F.abs(F.datediff("date_a", "date_b")).alias("days")).distinct()


def stem(handle: Column) -> Column:
    """A handle without the words that only say what a place is; the whole where nothing else is left."""
    plain = F.regexp_replace(F.lower(handle), r"[._\-]", "")
    short = F.regexp_replace(plain, r"(weddings?|events?|venue|chicago|chi|official|hotel|the)$", "")
    return F.when(F.char_length(short) >= 3, short).otherwise(plain)


def alias_signals(accounts: DataFrame, most: int = 8) -> DataFrame:
    """Signals that two accounts are one: (id_a, id_b, signals, tier). accounts: id, username, full_name, url, biography.

    S1 equal stems, S1b names that differ in punctuation only, S2 equal full names, S3 equal links, S4 a biography that names
    the other, S6 two edits or fewer. Each signal is an equi-join on its key; groups of more than `most` say nothing.
    """
    from kithgraph.functions.text import host, is_aggregator, mentions, url_key

    plain = F.regexp_replace(F.lower("username"), r"[._\-]", "")
    link = F.when(~is_aggregator(host("url")), url_key("url"))
    keys = {"S1": stem(F.col("username")), "S1b": plain, "S2": F.nullif(F.lower(F.trim("full_name")), F.lit("")), "S3": link}
    every = None
    for code, key in keys.items():
        part = pairs_in_groups(accounts.select("id", key.alias("block")).where("block is not null"), most).select("id_a", "id_b", F.lit(code).alias("code"))
        every = part if every is None else every.unionByName(part)
    named = accounts.select("id", F.explode(mentions("biography")).alias("username")).join(accounts.select(F.col("id").alias("other"), F.lower("username").alias("username")), "username").where("id <> other")
    every = every.unionByName(named.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"), F.lit("S4").alias("code")).distinct())
    every = every.unionByName(within_edits(accounts.select("id", F.lower("username").alias("name")), 2).select("id_a", "id_b", F.lit("S6").alias("code")))
    codes = every.groupBy("id_a", "id_b").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    has = lambda *xs: F.arrays_overlap("codes", F.array(*map(F.lit, xs)))
    tier = F.when(has("S4") & has("S1", "S1b", "S2", "S3"), "T1").when((F.size("codes") >= 2) | has("S3", "S1b"), "T2").otherwise("T3")
    return codes.select("id_a", "id_b", F.array_join("codes", ",").alias("signals"), tier.alias("tier"))
