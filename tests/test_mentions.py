"""Mentions by their first place give what a pattern of every name gives."""

import random

from kithgraph.functions import text as T
from pyspark.sql import functions as F


def test_mentions_by_first_place(spark):
    rng = random.Random(6)
    parts = ["@", "@ab", "@AB", "@a.b", "ab", ".", "_", " ", "\n", "É", "🥂", "K", "word and more words ", "\x01", "@a@", "a"]
    names = ["ab", "@AB", "a.b", " ab ", "", "@", "a@", "a@a", "é", "a", None]
    rows = [(None if rng.random() < 0.02 else "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))), rng.choice(names)) for _ in range(3000)]
    df = spark.createDataFrame([*rows, ("see @a\\Eb.", "a\\Eb"), ("see @a\\Eb now", "a\\Eb")], "bio string, name string")
    plain = F.regexp_replace(F.lower(F.trim("name")), "^@", "")
    by_name = F.when(plain != "", F.trim(F.regexp_substr("bio", F.concat(F.lit(r"(?is).{0,20}?@\Q"), plain, F.lit(r"\E(?![a-z0-9._]).{0,20}")))))
    got = df.select("bio", "name", T.mention_snippet("bio", "name").alias("got"), by_name.alias("want")).collect()
    assert [x for x in got[:-2] if x.got != x.want] == [] and sum(x.got is not None for x in got) > 200
    # a name with the end of a quotation is a name like others
    assert [x.got for x in got[-2:]] == [None, "see @a\\Eb now"]
