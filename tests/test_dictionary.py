"""The automaton against ``contains``, key by key."""

import random

from pyspark.sql import functions as F

from folioscope.operators.dictionary import first_key, with_keys
from folioscope.operators.media import Plate, match_plate


def test_places_match_contains(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé \U0001f600") for _ in range(n))
    keys = [(word(rng.randrange(1, 5)), k) for k in range(120)] + [("", 500), (None, 501), ("abab", 502), ("abab", -7)]
    texts = [None, "", *[word(rng.randrange(0, 60)) for _ in range(60)], "ab" * 100_000]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")
    table = spark.createDataFrame(keys, "key string, place int")
    low = {}
    for key, place in keys:
        if key is not None:
            low[key] = min(place, low.get(key, place))
    for size in (1 << 20, 3000):  # one block, several
        got = {r["id"]: r["places"] for r in with_keys(rows, F.col("text"), table, key_bytes=size).collect()}
        for k, t in enumerate(texts):
            assert got[k] == (None if t is None else sorted(p for key, p in low.items() if key in t)), t
    assert all(r["places"] == [] for r in with_keys(rows.where("id > 0"), F.col("text"), table.limit(0)).collect())


def test_first_key_is_the_first_plate(spark):
    plates = [Plate("gate", "Gate", "c1", "t1", ("g",)), Plate("iron_gate", "Iron", "c2", "t2"), Plate("sea", "Sea", "c3", "t3")]
    table = spark.createDataFrame([(p.key, k, p.title) for k, p in enumerate(plates)], "key string, place int, title string")
    stems = spark.createDataFrame([("Old_Iron_Gate_Sea",), ("sea_view",), ("nothing",), (None,)], "stem string")
    out = first_key(stems, F.lower("stem"), table).select("stem", "title", match_plate(F.col("stem"), plates)["title"].alias("want")).collect()
    assert len(out) == 4 and all(r["title"] == r["want"] for r in out) and {r["title"] for r in out} == {"Gate", "Sea", None}


def test_hundred_thousand_keys(spark):
    keys = spark.range(100_000).select(F.concat(F.lit("key"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("key"), F.col("id").alias("place"))
    rows = spark.range(2000).select("id", F.concat(F.lit("some key"), F.lpad((F.col("id") * 37).cast("string"), 6, "0"), F.lit(" here")).alias("text"))
    out = first_key(rows, F.col("text"), keys).where(F.col("place") == F.col("id") * 37)
    assert out.count() == 2000


def test_keys_are_few_bytes_besides_their_letters():
    import pickle

    from folioscope.operators.dictionary import _packed

    keys = [{"key": f"schlüssel{k}", "place": k} for k in range(10_000)]
    ends, text, places = _packed(keys)
    assert [text.decode()[ends[i] : ends[i + 1]] for i in (0, 77, 9_999)] == ["schlüssel0", "schlüssel77", "schlüssel9999"]
    assert len(text) + ends.nbytes + places.nbytes < 32 * len(keys) and len(pickle.dumps((ends, text, places))) < 34 * len(keys)
