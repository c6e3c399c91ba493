"""Spelling variants against a comparison of all words with all."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from tunestrata.llm import spelling as sp
from tunestrata.llm.common import read, ship_package


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def plain_words(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def plain_variants(rows):
    words = plain_words(rows)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def made(seed, n):
    """Words and their variants, some of them many times as frequent as others."""
    rng = random.Random(seed)
    letters = "abéxÿ"
    stock = ["".join(rng.choices(letters, k=rng.randint(5, 8))) for _ in range(n)]
    stock += ["common" * 30, "common" * 30 + "s", "x" * 300, "x" * 301, "straße×÷", "zzzzzz"]
    texts = []
    for _ in range(60):
        words = []
        for w in rng.sample(stock, 40):
            words += [w] * rng.choice([1, 1, 3, 40])
            k = rng.randrange(len(w))
            words += [rng.choice([w[:k] + w[k + 1 :], w[:k] + "a" + w[k:], w[:k] + "b" + w[k + 1 :]])] * rng.choice([0, 1, 2])
        rng.shuffle(words)
        texts.append(rng.choice([" ", "-", "1", "日", "Ÿ", "\n"]).join(w.upper() if rng.random() < 0.1 else w for w in words))
    return texts


def frame(spark, rows):
    ship_package(spark)
    return spark.createDataFrame([(*r, "x", 1, "x", "x") for r in rows], "doc_id bigint, text string, word string, n bigint, root string, form string").repartition(4)


def found(df):
    return sorted(map(tuple, df.collect()))


def test_variants(spark):
    rows = [(i * 7 - 30, t) for i, t in enumerate(made(1, 120))] + [(3, None), (4, ""), (None, "letters " * 9), (None, "lettters " * 50)]
    rows += [(500, "variantsab " * 6 + "variantsa " * 40 + "variants " * 300)]
    got = found(sp.spelling_variants(frame(spark, rows)))
    assert got == plain_variants(rows)
    assert any(w != root and form != root for w, form, root, *_ in got if form)  # a chain of forms


def test_small_blocks_find_the_same(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(made(2, 150))]
    monkeypatch.setattr(sp, "BLOCK_WORDS", 7)
    assert found(sp.spelling_variants(frame(spark, rows))) == plain_variants(rows)


@pytest.mark.parametrize("seed", range(6))
def test_scan_of_a_sorted_list(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(6, 9))) for _ in range(150)})
    for wanted in (words, words[::3] + ["abcabcd", "zzzzzz"]):
        pairs = sorted((wanted[i], words[j]) for i, j in sp.near_in(words, wanted))
        assert pairs == sorted((a, b) for a in wanted for b in words if one_edit(a, b))


def test_long_texts_are_cut_between_runs(monkeypatch):
    text = " ".join(made(3, 50)) * 3
    whole = Counter(dict.fromkeys([], 0))
    for w, n in sp.words_of(5, text):
        whole[w] += n
    monkeypatch.setattr(sp, "BLOCK", 100)
    parts = Counter()
    for w, n in sp.words_of(5, text):
        parts[w] += n
    assert parts == whole


def test_edges(spark):
    empty = frame(spark, [(1, "words")]).where("false")
    assert found(sp.spelling_variants(empty)) == []
    alone = [(1, "singular " * 5), (2, "word " * 50)]
    assert found(sp.spelling_variants(frame(spark, alone))) == plain_variants(alone)
    twice = [(1, "singular plurals plural " * 9)] * 3
    assert found(sp.spelling_variants(frame(spark, twice))) == plain_variants(twice)


def test_given_table(spark, sf_dir):
    ship_package(spark)
    docs = read(spark, sf_dir, "documents")
    assert found(sp.spelling_variants(docs)) == plain_variants([tuple(r) for r in docs.select("doc_id", "text").collect()])
