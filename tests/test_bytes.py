"""Byte-level token text back to text."""

import random

from pyspark.sql import functions as F

from foliospark.functions import text as T


def test_from_byte_characters(spark):
    table = T._byte_of_character()
    character = {b: c for c, b in table.items()}
    assert len(table) == 256 and sorted(table.values()) == list(range(256))
    rng = random.Random(4)
    raws = [bytes([b]) for b in range(256)] + ["Hello, Welt é 中文 😀\n".encode()]
    raws += [rng.randbytes(rng.randrange(8)) for _ in range(400)] + [rng.choice(["é", "中", "😀"]).encode()[: rng.randrange(1, 4)] + rng.choice([b"", b"a", b"\xe4"]) for _ in range(200)]
    rows = [("".join(character[b] for b in raw), raw.decode("utf-8", errors="replace")) for raw in raws]
    rows += [("中Ġa", "中 a"), ("", ""), (None, None)]
    got = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(rows)], "i int, s string").select("i", T.from_byte_characters(F.col("s")).alias("x")).orderBy("i").collect()
    assert [(r["i"], r["x"]) for r in got] == [(i, w) for i, (_, w) in enumerate(rows)]
