"""Operators on documents beside plain versions, over edge texts and over the given documents."""

from __future__ import annotations

import base64
import time
import zlib
from collections import defaultdict

import numpy as np
import plain
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tunestrata.llm import byte_bpe, packing, pii, rules, secrets, simhash, token_counts, tokens
from tunestrata.llm.common import read, word_blocks
from tunestrata.llm.ledger import Ledger, paths_with
from tunestrata.session import shared_path

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module", params=["edges", "given"])
def table(request, spark, docs, sf_dir):
    return docs if request.param == "edges" else read(spark, sf_dir, "documents")


@pytest.fixture(scope="module")
def rows(table):
    return [tuple(r) for r in table.select("doc_id", "text").collect()]


def bag(rows):
    return sorted(map(tuple, rows), key=repr)


def test_word_blocks_cut_no_word():
    text = "ab cd\tefg\n" * 40 + "é" * 90 + " x"
    assert [w for b in word_blocks(text, 16) for w in b] == text.encode().split()


# ---- near-duplicates --------------------------------------------------------


def test_simhash(table, rows):
    prints = np.array([plain.fingerprint(t) for _, t in rows], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    label = plain.components(len(rows), lambda i, j: near[i, j])
    least = defaultdict(list)
    for (doc, _), root in zip(rows, label, strict=True):
        least[root] += [doc] if doc is not None else []
    expected = [(d, f"{int(p):016x}", min(least[r], default=None)) for (d, _), p, r in zip(rows, prints, label, strict=True)]
    assert bag(simhash.simhash_groups(table).collect()) == bag(expected)


def test_simhash_buckets_in_blocks(spark):
    """A dense group, with buckets far larger than a block."""
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 1 << 62))
    dense = {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (300, 2))}
    other = {int(x) for x in rng.integers(-(1 << 62), 1 << 62, 300)}
    prints = sorted({p - (1 << 64) if p >= 1 << 63 else p for p in dense | other})
    unsigned = np.array(prints, np.int64).view(np.uint64)
    near = np.bitwise_count(unsigned[:, None] ^ unsigned[None, :]) <= 3
    expected = plain.components(len(prints), lambda i, j: near[i, j])
    fps = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    links = [tuple(r) for r in simhash.near_links(fps, block=16).collect()]
    place = {p: i for i, p in enumerate(prints)}
    assert all(near[place[a], place[b]] for a, b in links)
    pairs = {(place[a], place[b]) for a, b in links}
    assert plain.components(len(prints), lambda i, j: (i, j) in pairs or (j, i) in pairs) == expected


def test_keep_one(docs):
    kept = simhash.keep_one(docs)
    assert kept.columns[0] == "doc_id" and set(kept.columns) == set(docs.columns)
    groups = simhash.simhash_groups(docs).where("doc_id is null or doc_id = component_id").select("doc_id")
    assert bag(kept.select("doc_id").collect()) == bag(groups.collect())


# ---- packing ----------------------------------------------------------------


def test_packing(table, rows):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for doc, start, length, crc, total, sequence, offset in packing.pack_documents(table, WORD_BPE).collect():
        pieces[doc].append((start, length, crc, total))
        sequences[sequence].append((offset, length))
    expected = defaultdict(list)
    encoded = tokens.load(WORD_BPE).encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    for (doc, _), e in zip(rows, encoded, strict=True):
        ids, start = np.array([*e.ids, 1], "<u4"), 0
        for length in packing.cut_lengths(len(ids), 2048):
            crc = zlib.crc32(ids[start : start + length].tobytes())
            expected[doc].append((start, length, crc, len(ids)))
            start += length
        assert start == len(ids)
    assert {d: sorted(p) for d, p in pieces.items()} == {d: sorted(p) for d, p in expected.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= 2048


def test_packing_pads_little(spark):
    packed = packing.pack_documents(read(spark, "/root/testdata/sf0.01", "documents"), WORD_BPE)
    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.sum("n"), F.count("*")).first()
    assert used[0] / (2048 * used[1]) > 0.98


def test_histogram_patterns():
    histogram = {n: (n * 7919) % 50 + 1 for n in range(1, 65)}
    patterns = packing.pack_histogram(histogram, 64)
    made = defaultdict(int)
    for count, lengths in patterns:
        assert count > 0 and sum(n * k for n, k in lengths) <= 64
        for n, k in lengths:
            made[n] += count * k
    assert dict(made) == histogram
    assert len(patterns) <= 2 * len(histogram)
    assert packing.pack_histogram({}, 64) == []


# ---- quality rules ----------------------------------------------------------


def test_rules(table, rows):
    judged = rules.judged(table)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert bag(judged.select(*names).collect()) == bag((d, *plain.rule_measures(t)) for d, t in rows)
    assert judged.where("base_failed and kept").count() == 0
    again = rules.ledger(table).withColumn("kept", rules.passes("v2"))
    assert bag(again.select("doc_id", "kept").collect()) == bag(judged.select("doc_id", "kept").collect())
    kept = rules.keep_good(table)
    assert kept.columns == table.columns
    assert bag(kept.select("doc_id", "text").collect()) == bag(
        table.join(judged.where("kept").select("doc_id").distinct(), "doc_id").select("doc_id", "text").collect()
        + table.where("doc_id is null and text is not null").select("doc_id", "text").collect()
    )


def test_ablation(docs):
    ledger = [r["failed"] for r in rules.ledger(docs).collect()]
    found = {(r["policy"], r["rule"]): (r["n_failed"], r["n_only"]) for r in rules.ablation(rules.ledger(docs)).collect()}
    names = list(rules.RULES)
    for policy, members in rules.POLICIES.items():
        for rule in members:
            bit, whole = 1 << names.index(rule), rules.mask(members)
            expected = sum(1 for f in ledger if f & bit), sum(1 for f in ledger if f & whole == bit)
            assert found[policy, rule] == expected


# ---- secrets ----------------------------------------------------------------


def _secrets(spark):
    return Ledger(spark, shared_path(spark, "secrets"), secrets.FINDINGS)


def test_secrets(spark, table, rows):
    found = secrets.secret_scan(table, _secrets(spark))
    assert bag(found.drop("spans").collect()) == bag((d, *plain.secrets(t)) for d, t in rows)


def test_added_secret_kinds(spark, docs):
    spans = {s.split(":")[0] for r in secrets.secret_scan(docs, _secrets(spark)).collect() for s in r["spans"].split(",") if s}
    assert {"pem", "jwt", "forge", "assign", "access", "hex"} <= spans


def test_ledger_scans_each_blob_once(spark, docs):
    ledger = _secrets(spark)
    first = bag(secrets.secret_scan(docs, ledger).collect())
    blobs = docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert ledger.read().select("digest").distinct().count() == blobs
    size = ledger.read().count()
    assert size == blobs  # also though one row of the table is there twice, id and all
    reopened = Ledger(spark, ledger.path, secrets.FINDINGS)
    assert bag(secrets.secret_scan(docs, reopened).collect()) == first
    assert reopened.read().count() == size
    secrets.secret_scan(docs, reopened, version="next")
    assert reopened.read().count() == 2 * size


def test_two_writers_of_one_ledger(spark, docs):
    """Both open it empty; what one adds stays there beside the other's rows."""
    path = shared_path(spark, "both")
    ledgers = [Ledger(spark, path, secrets.FINDINGS) for _ in range(2)]
    halves = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1 or doc_id is null")
    scans = [secrets.secret_scan(half, ledger) for half, ledger in zip(halves, ledgers, strict=True)]
    expected = bag(secrets.secret_scan(docs, _secrets(spark)).collect())
    assert bag(scans[0].collect() + scans[1].collect()) == expected
    again = Ledger(spark, path, secrets.FINDINGS)
    size = again.read().count()
    assert bag(secrets.secret_scan(docs, again).collect()) == expected and again.read().count() == size
    caches = [Ledger(spark, f"{path}-tokens", token_counts.COUNTS) for _ in range(2)]
    counted = [token_counts.token_counts(docs, cache, public_tokenizers.path("byte_bpe_50k.json")) for cache in caches]
    assert bag(counted[0].collect()) == bag(counted[1].collect()) and counted[0].count() == docs.count()


def test_a_lost_blob_raises(spark, docs):
    ledger = _secrets(spark)
    secrets.secret_scan(docs, ledger)
    stored = ledger.read().where("spans != ''").select("digest", "spans")
    paths = docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))
    with pytest.raises(Exception, match="not in the ledger"):
        paths_with(paths, stored, ("spans",)).collect()


def test_many_secrets_in_one_text(spark):
    """Time grows with the matches, not with their square."""
    sums = "\n".join(f"{i:040x}  file-{i}.bin token={i:012d}x" for i in range(64_000))
    table = spark.createDataFrame([(1, sums), (2, "0123456789abcdef")], "doc_id bigint, text string")
    secrets.secret_scan(table.limit(0), _secrets(spark)).collect()
    start = time.perf_counter()
    (one, two) = sorted(secrets.secret_scan(table, _secrets(spark)).collect())
    assert time.perf_counter() - start < 15  # some 3 s, the jobs around the scan included; 120 s once
    assert (one["n_hex"], one["n_assign"], two["n_hex"]) == (64_000, 64_000, 1)
    assert tuple(one.asDict()[c] for c in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")) == (1, *plain.secrets(sums))


def test_secret_scan_is_native(spark, docs):
    plan = secrets.scan(docs.select(F.lit(b"").alias("digest"), "text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_policies_read_a_stored_ledger(spark, docs, monkeypatch):
    stored, asked = [], []
    keep, passes = rules.written, rules.passes
    monkeypatch.setattr(rules, "written", lambda df, label: stored.append(keep(df, label)) or stored[-1])
    monkeypatch.setattr(rules, "passes", lambda *a, **k: asked.append(a[0]) or passes(*a, **k))
    found = bag(rules.policies_compared(docs).collect())
    assert len(stored) == 1 and "Python" not in stored[0]._jdf.queryExecution().toString()
    failed = [r["failed"] for r in rules.ledger(docs).select("failed").collect()]
    expected = []
    for policy, names in rules.POLICIES.items():
        whole = rules.mask(names)
        for rule in names:
            bit = rules.mask((rule,))
            expected.append((policy, rule, sum(f & bit > 0 for f in failed), sum(f & whole == bit for f in failed), sum(f & whole == 0 for f in failed)))
    assert found == bag(expected)
    for policy, names in rules.POLICIES.items():
        asked.clear()
        kept = rules.keep_good(docs, policy)
        assert asked == [policy] and kept.columns == docs.columns
        assert kept.count() == sum(f & rules.mask((*rules.BASE, *(n for n in names if n not in rules.BASE))) == 0 for f in failed)


# ---- tokens -----------------------------------------------------------------


def test_token_counts(spark, table, rows):
    cache = Ledger(spark, shared_path(spark, "tokens"), token_counts.COUNTS)
    found = bag(token_counts.token_counts(table, cache, BYTE_BPE).collect())
    encoded = tokens.load(BYTE_BPE).encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    expected = [(d, len((t or "").encode()), len(e.ids), len(e.ids) > 512) for (d, t), e in zip(rows, encoded, strict=True)]
    assert found == bag(expected)
    size = cache.read().count()
    assert bag(token_counts.token_counts(table, cache, BYTE_BPE).collect()) == found
    assert cache.read().count() == size


@pytest.mark.parametrize("size", [7, 1 << 20])
def test_tokens_in_parts(texts, size, monkeypatch):
    monkeypatch.setattr(tokens, "STRETCH", size)
    monkeypatch.setattr(tokens.stretches, "__defaults__", (size,))
    short = [t for t in texts if t and len(t) < 10_000]
    library = tokens.load(BYTE_BPE).encode_batch(short, add_special_tokens=False)
    assert tokens.count_tokens(short, BYTE_BPE) == [len(e.ids) for e in library]
    library = tokens.load(WORD_BPE).encode_batch(short, add_special_tokens=False)
    assert list(tokens.id_bytes(short, WORD_BPE)) == [np.array(e.ids, "<u4").tobytes() for e in library]


def test_latin_pieces_are_what_the_library_makes():
    stock = ["Don't", "É.", "x's", "'s", "a's.", "ß|", "ÀB,c", "1st", "a1", "µm", "ªº", "×2", "÷", "...", "A.B.", "\xad", "\xa0", "e\x85f", "<b>", "#x#"]
    texts = [f"{a}{gap}{b}" for a in stock for b in stock for gap in ("", " ", "\n", " \t")]
    library = tokens.load(WORD_BPE).encode_batch(texts, add_special_tokens=False)
    assert list(tokens.id_bytes(texts, WORD_BPE)) == [np.array(e.ids, "<u4").tobytes() for e in library]


def test_remembered_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 10)
    encode = tokens.PieceEncoder(BYTE_BPE, len)
    for i in range(20):
        encode([[f"w{i}", f"v{i}"]])
        assert len(encode.known) <= 10


def _tiktoken():
    import tiktoken

    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(table, rows):
    library, expected = _tiktoken(), []
    for doc, text in rows:
        ids = library.encode_ordinary(text or "")
        expected.append((doc, len(ids), plain.sha(",".join(map(str, ids))), plain.sha(text or "")))
    assert bag(byte_bpe.round_trip(table, RANKS, public_tokenizers.PATTERN).collect()) == bag(expected)


def test_byte_bpe_columns_and_parts(docs, texts):
    both = byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    for r in both.select("text", "bytes").collect():
        assert bytes(r["bytes"]) == (r["text"] or "").encode()
    library = _tiktoken()
    for text in texts:
        if text and len(text) < 10_000:
            parts = byte_bpe.encoded_parts(text, RANKS, public_tokenizers.PATTERN, size=5)
            assert [i for p in parts for i in p] == library.encode_ordinary(text)


def test_long_runs_of_white_space():
    library = _tiktoken()
    for run in (" " * 9, "\n" * 7, "\t \n\r\x85\u3000 \xa0 ", "\n\n\n\n "):
        for text in (run, f"a{run}", f"{run}b", f"a{run}b{run}", f"a{run}!{run}\x1c{run}1 '{run}'s"):
            parts = byte_bpe.encoded_parts(text, RANKS, public_tokenizers.PATTERN, long_run=5)
            assert [i for p in parts for i in p] == library.encode_ordinary(text)
    huge = "a" + " " * 1_500_000 + "b"
    n, _, data = byte_bpe.digest_round_trip(byte_bpe.encoded_parts(huge, RANKS, public_tokenizers.PATTERN), library)
    assert n > 1000 and data == plain.sha(huge)


# ---- personal data ----------------------------------------------------------


def test_personal_data(table, rows):
    found = pii.personal_data(table)
    assert bag(found.drop("spans").collect()) == bag((d, *plain.personal(t)) for d, t in rows)
    for r in found.where("spans != ''").collect():
        spans = [s.split(":") for s in r["spans"].split(",")]
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), int(s[1])))


def test_labelers_are_told_apart():
    """Three labelers that are mostly right and one that guesses: EM finds out which."""
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.4
    counts: dict[tuple, float] = defaultdict(float)
    for t in truth:
        votes = [(1 if t else -1) if rng.random() < right else (-1 if t else 1) for right in (0.95, 0.85, 0.8, 0.5)]
        counts[tuple(votes)] += 1
    posterior, table = pii.reliabilities(counts)
    accuracy = [(t[1, 2] * 0.4 + t[0, 0] * 0.6) for t in table]
    assert accuracy[0] > accuracy[1] > 0.75 and abs(accuracy[3] - 0.5) < 0.06
    assert posterior[1, 1, 1, -1] > 0.95 and posterior[-1, -1, -1, 1] < 0.05
    assert pii.accepted_codes({}) == []
    kinds = {pii._code(k, (v, 0, 0, 0), "x", ""): 9 for k in (4, 5) for v in (-1, 1)}
    assert pii.posteriors(kinds).keys() == kinds.keys()


def test_em_by_a_slow_version():
    """The same steps, pattern by pattern in plain loops."""
    rng = np.random.default_rng(8)
    counts = {tuple(map(int, rng.integers(-1, 2, 4))): float(rng.integers(1, 60)) for _ in range(40)}
    posterior = {p: 0.9 if sum(p) > 0 else 0.1 if sum(p) < 0 else 0.3 for p in counts}
    for _ in range(100):
        weight = {1: {p: n * posterior[p] for p, n in counts.items()}, 0: {p: n * (1 - posterior[p]) for p, n in counts.items()}}
        share = {c: sum(weight[c].values()) + 1 for c in (0, 1)}
        table = {}
        for c in (0, 1):
            for j in range(4):
                sums = {v: sum(w for p, w in weight[c].items() if p[j] == v) + (2 + v * (1 if c else -1)) for v in (-1, 0, 1)}
                for v, n in sums.items():
                    table[c, j, v] = n / sum(sums.values())
                    table["n", c, j, v] = n
        for j in range(4):
            whole = sum(table["n", c, j, v] for c in (0, 1) for v in (-1, 0, 1))
            for v, turned in ((-1, table[1, j, -1] > table[0, j, -1]), (1, table[1, j, 1] < table[0, j, 1])):
                if turned:
                    table[0, j, v] = table[1, j, v] = (table["n", 0, j, v] + table["n", 1, j, v]) / whole
            for c in (0, 1):
                table[c, j, 0] = 1 - table[c, j, -1] - table[c, j, 1]
        fresh = {}
        for p in counts:
            odds = [share[c] * np.prod([table[c, j, p[j]] for j in range(4)]) for c in (0, 1)]
            fresh[p] = odds[1] / sum(odds)
        done = max(abs(fresh[p] - posterior[p]) for p in counts) < 1e-9
        posterior = fresh
        if done:
            break
    found, _ = pii.reliabilities(counts)
    assert all(abs(found[p] - posterior[p]) < 1e-9 for p in counts)


def test_codes_hold_features():
    for found, before in (("Jane Miller", "my name is "), ("12 Main Street", "x\n"), ("a.b [at] c [dot] de", "")):
        for kind in range(len(pii.BASE), len(pii.KINDS)):
            for votes in ((1, 0, -1, 1), (-1, -1, 0, 0)):
                k, v, (separators, _, opens) = pii._features(pii._code(kind, votes, found, before))
                assert (k, v, separators, opens) == (kind, votes, min(found.count(" "), 2), int(before in ("", "x\n")))


LABELLED = [  # kind, texts that hold it, texts that only look like it
    ("account", ["iban DE89 3704 0044 0532 0130 00 please", "my account GB29 NWBK 6016 1331 9268 19 thanks"], ["part XY12 3456 7890 1234 AB of it", "version ZZ99 AAAA BBBB CCCC here"]),
    ("masked_email", ["contact j.doe{i} [at] mail [dot] de now", "e-mail anna.k{i} (at) web (dot) org"], ["look [at] this [dot] here", "arrive [at] gate [dot] seven"]),
    ("local_phone", ["call 030 123{d} 456{d} today", "tel 089 234{d} 567{d} please"], ["order 012 34 56 was late", "page 077 11 22 of the book"]),
    ("long_number", ["passport 123{d} 5678 90123 4 is mine", "ssn 123{d} 45 678 ok"], ["isbn 978 31 614 84 in print", "table 111 11 111 shows it"]),
    ("address", ["she lives at 12{d} Main Street now", "ship to 4{d} Oak Hill Road please"], ["chapter 2024 Great Stone Road ended", "page 3141 Big Empty Lane told"]),
    ("person", ["my name is Anna Miller today", "contact Peter Novak soon", "Dear Maria Lopez, hello"], ["in New York they said", "near The Hague it was", "the North Sea was cold"]),
]


@pytest.fixture(scope="module")
def labelled():
    rows, truth = [], {}
    for k, (kind, good, bad) in enumerate(LABELLED):
        for i in range(40):
            for flag, texts in ((True, good), (False, bad)):
                doc_id = len(rows)
                rows.append((doc_id, "so " + texts[i % len(texts)].format(i=i, d=i % 10)))
                truth[doc_id] = (kind, flag)
    return rows, truth


def test_loose_spans_of_labelled_texts(spark, labelled):
    """What weak supervision finds without labels, held against the labels."""
    rows, truth = labelled
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    hits, wrong = defaultdict(int), defaultdict(int)
    for r in pii.personal_data(docs).collect():
        kind, flag = truth[r["doc_id"]]
        kinds = {s.split(":")[0] for s in r["spans"].split(",") if s}
        hits[kind] += flag and kind in kinds
        wrong[kind] += not flag and bool(kinds)
    for kind, _, _ in LABELLED:
        assert hits[kind] >= 36, (kind, dict(hits))
        assert wrong[kind] <= 2, (kind, dict(wrong))
    masked = {r["doc_id"]: r["text"] for r in pii.redacted(docs).collect()}
    assert "<ACCOUNT>" in masked[0] and "3704" not in masked[0]


def test_few_candidates_are_left_alone(spark):
    docs = spark.createDataFrame([(1, "Once New Found land was far"), (2, "row 123 45 678")], "doc_id bigint, text string")
    assert [r["spans"] for r in pii.personal_data(docs).collect()] == ["", ""]


def test_redacted(docs, table):
    masked = pii.redacted(table)
    assert masked.columns == table.columns
    assert masked.count() == table.count()
    left = pii.personal_data(masked.select("doc_id", "text"))
    assert left.where("n_email + n_ip > 0").count() == 0
    assert masked.where("text is null").count() == table.where("text is null").count()
    assert masked.where("n_chars != length(text)").count() == table.where("n_chars != length(text)").count()


# ---- empty tables -----------------------------------------------------------


def test_empty_tables(spark, empty):
    cache = Ledger(spark, shared_path(spark, "tokens"), token_counts.COUNTS)
    for made in (
        simhash.simhash_groups(empty), simhash.keep_one(empty), packing.pack_documents(empty, WORD_BPE), rules.judged(empty),
        rules.keep_good(empty), rules.ablation(rules.ledger(empty)), secrets.secret_scan(empty, _secrets(spark)),
        token_counts.token_counts(empty, cache, BYTE_BPE), byte_bpe.round_trip(empty, RANKS, public_tokenizers.PATTERN),
        pii.personal_data(empty), pii.redacted(empty),
    ):
        assert made.count() == 0
