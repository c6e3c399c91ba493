"""Repeated passages against a table of all strings of 100 bytes."""

from __future__ import annotations

import random
import zlib

import numpy as np
import plain

from tunestrata.llm import repeats as rp
from tunestrata.llm.common import read, ship_package


def expected(rows):
    docs = {(d is None, d or 0, zlib.crc32((t or "").encode()) % (1 << 31)): (t or "").encode() for d, t in rows}
    first, results = {}, {}
    for key in sorted(docs):
        data = docs[key]
        covered = bytearray(len(data))
        for at in range(len(data) - 99):
            string = data[at : at + 100]
            if string in first:
                covered[at : at + 100] = b"\1" * 100
            else:
                first[string] = True
        kept = bytes(b for b, c in zip(data, covered, strict=True) if not c)
        spans = sum(bool(c) and (i == 0 or not covered[i - 1]) for i, c in enumerate(covered))
        results[key] = len(data), sum(covered), spans, plain.sha(kept)
    return sorted(((d, *results[d is None, d or 0, zlib.crc32((t or "").encode()) % (1 << 31)]) for d, t in rows), key=repr)


def frame(spark, rows):
    ship_package(spark)
    return spark.createDataFrame([(*r, 1, "x", 1) for r in rows], "doc_id bigint, text string, place bigint, going string, tie bigint").repartition(6)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def made(seed):
    rng = random.Random(seed)

    def prose(n):
        return "".join(rng.choices("abcdeé ", k=n))

    passages = [prose(n) for n in (99, 100, 101, 130, 168, 169, 400, 1200)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            cut = rng.choice([0, 0, 1, rng.randrange(len(p))])
            parts += [prose(rng.choice([0, 1, 30, 200])), p[cut:]]
        rows.append((i * 13 % 61 - 20, "".join(parts)))
    long = prose(900)
    near = [(100 + i, long[:k] + "Z" + long[k + 1 :]) for i, k in enumerate((0, 50, 99, 100, 101, 450, 899))]
    odd = [
        (200, None), (201, ""), (202, "x" * 99), (203, "x" * 100), (204, "x" * 101), (205, "y" * 5000), (206, "y" * 300), (207, "ab" * 700),
        (208, "ba" * 700), (209, "日本" * 200), (210, "本日" * 200), (None, long), (None, prose(300)), (None, None), (100, prose(250) + passages[4]),
        (205, "y" * 5000), (-5, "y" * 150),
    ]
    return [*rows, *near, *odd]


def test_passages(spark):
    for seed in (1, 2):
        rows = made(seed)
        rng = random.Random(seed)
        rng.shuffle(rows)
        assert found(rp.without_repeats(frame(spark, rows))) == expected(rows)


def test_many_partitions(spark, many_slices):
    """Equal names fall into neighbouring partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        rows = [(i, "z" * 120 + str(i) * 3 + "q" * 130) for i in range(60)] + made(3)
        assert found(rp.without_repeats(frame(spark, rows))) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_long_texts_are_named_in_stretches():
    rng = random.Random(4)
    text = "".join(rng.choices("abc ", k=3000)).encode()
    data = np.frombuffer(text, np.uint8)
    low, n, piece, least, name = rp.segments(data, np.array([0, 1000]), np.array([500, 1901]))
    places = np.concatenate([np.arange(a, a + k) for a, k in zip(low, n, strict=True)])
    assert places.tolist() == [*range(500), *range(1000, 2901)]
    assert n.max() <= rp.SPAN and (np.diff(piece) >= 0).all()
    again = rp.segments(data[200:], np.array([0]), np.array([100]))
    whole = rp.segments(data, np.array([200]), np.array([100]))
    assert (again[3] == whole[3]).all() and (again[4] == whole[4]).all()
    for a, k in zip(low, n, strict=True):
        grams = {rp.names(data[s + j : s + j + 64])[0][0] for s in (a, a + k - 1) for j in range(0, 69)}
        assert least[list(low).index(a)] == min(rp.names(data[a : a + 164])[0][:69]) and len(grams) > 1


def test_edges(spark):
    assert found(rp.without_repeats(frame(spark, [(1, "a")]).where("false"))) == []
    big = "".join(random.Random(5).choices("abcdefgh \n", k=700_000))
    rows = [(1, big), (2, big[300_000:650_000] + "!" + big[:1000])]
    assert found(rp.without_repeats(frame(spark, rows))) == expected(rows)


def test_given_table(spark, sf_dir):
    ship_package(spark)
    docs = read(spark, sf_dir, "documents")
    assert found(rp.without_repeats(docs)) == expected([tuple(r) for r in docs.select("doc_id", "text").collect()])
