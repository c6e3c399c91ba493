"""Operators on pages, embeddings, labels and whole corpora."""

from __future__ import annotations

import gzip
import hashlib
import io
import os
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import plain
import pytest
import zstandard
from pyarrow import fs
from pyspark.sql import functions as F

from tunestrata.llm import cover_tree, quality, warc
from tunestrata.llm import queries as llm
from tunestrata.llm.common import read, ship_package
from tunestrata.llm.components import components
from tunestrata.session import shared_path


def bag(rows):
    return sorted(map(tuple, rows), key=repr)


# ---- components -------------------------------------------------------------


@pytest.mark.parametrize("shape", ["chain", "star", "mixed", "none"])
def test_components(spark, shape):
    rng = np.random.default_rng(1)
    n = 40
    pairs = {
        "chain": [(i, i + 1) for i in rng.permutation(n - 1)],
        "star": [(n - 1, i) for i in range(n - 1)],
        "mixed": [tuple(p) for p in rng.integers(0, n, (30, 2))] + [(5, 5), (3, None), (None, None)],
        "none": [],
    }[shape]
    edges = spark.createDataFrame([(None if a is None else int(a), None if b is None else int(b)) for a, b in pairs], "a bigint, b bigint")
    linked = {(a, b) for a, b in pairs if a is not None and b is not None}
    label = plain.components(n, lambda i, j: (i, j) in linked or (j, i) in linked)
    touched = {x for a, b in linked if a != b for x in (a, b)}
    assert bag(components(edges).collect()) == bag((int(i), label[i]) for i in touched)


# ---- archives ---------------------------------------------------------------

PAGES = "page_id bigint, url string, html string, digest string, payload string, first string, archive string"


@pytest.fixture(scope="module")
def pages(spark):
    ship_package(spark)
    long, small = "<p>é🙂" * 60, "<p>x"
    html = [None, "", small, small, long, long, long + "!", long, "\r\n\r\nWARC/1.1\r\n\r\n" * 20, "\r\n\r\nWARC/1.1\r\n\r\n" * 20, "z" * (5 << 20)]
    rows = [((13 * i) % 29, None if i % 3 == 0 else f"http://ex.org/ä b\r\n{i}", h, "x", "x", "x", "x") for i, h in enumerate(html)]
    return spark.createDataFrame([*rows, (None, None, long, "x", "x", "x", "x")], PAGES).repartition(4).persist()


def test_warc(spark, pages):
    rows = pages.select("page_id", "html").collect()
    first = {}
    for r in rows:
        if r["page_id"] is not None and len((r["html"] or "").encode()) >= 100:
            first[r["html"]] = min(first.get(r["html"], r["page_id"]), r["page_id"])
    expected = []
    for page, html in rows:
        data = (html or "").encode()
        origin = first.get(html)
        again = page is not None and origin is not None and page > origin
        expected.append((page, len(data), plain.sha(data), "revisit" if again else "response", origin if again else None))
    assert bag(warc.warc_round_trip(spark, pages).collect()) == bag(expected)
    assert warc.warc_round_trip(spark, pages.where("false")).count() == 0


def test_warc_repeated_rows(spark, pages):
    one = bag(warc.warc_round_trip(spark, pages).collect())
    assert bag(warc.warc_round_trip(spark, pages.union(pages)).collect()) == bag(one + one)


def test_chunk_table(spark, pages):
    """Chunks put together are the payload, digests run along, and archives roll over."""
    folder = shared_path(spark, "warc")
    manifest = warc.write_archives(warc.planned(pages.where("page_id is not null")), folder, archive_bytes=200)
    assert manifest.count() > 4 and manifest.agg(F.sum("records")).first()[0] == 11
    found: dict[str, list] = {}
    for r in warc.read_chunks(manifest, folder).collect():
        assert r["size"] == len(r["data"]) <= warc.CHUNK
        found.setdefault(r["record_id"], []).append(r)
    html = {f"urn:page:{r['page_id']}": r["html"] or "" for r in pages.where("page_id is not null").collect()}
    assert set(found) == set(html)
    assert max(map(len, found.values())) == 5
    for name, chunks in found.items():
        chunks.sort(key=lambda r: r["chunk"])
        digest = hashlib.sha256()
        for i, r in enumerate(chunks):
            digest.update(r["data"])
            assert (r["chunk"], r["running_sha256"], r["last"]) == (i, digest.hexdigest(), i == len(chunks) - 1)
        if chunks[0]["record_type"] == "response":
            assert b"".join(r["data"] for r in chunks).decode() == html[name]
    name = manifest.first()["archive"]
    system, root = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
    data = gzip.decompress(system.open_input_stream(f"{root}/{name}", compression=None).read())
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: ") and data.endswith(b"\r\n\r\n")


def test_reader_takes_bounded_pieces():
    """A payload of zeros packs a thousandfold; pieces stay small while it is read."""
    payload = b"\0" * (20 << 20)
    record = b"".join(bytes(p) for p in warc._record(1, None, payload, "d", None))
    members = warc._Members(io.BytesIO(gzip.compress(record)))
    size = members.until(b"\r\n\r\n")
    assert size
    while members.more():
        assert len(members.packed) <= 2 * warc.CHUNK
        members.held = b""


def test_warc_rows_agree_with_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    result = con.execute(llm.ORACLES["op5_warc_chunks"])
    names = [d[0] for d in result.description]
    assert bag(llm.QUERIES["op5_warc_chunks"](spark, sf_dir).select(*names).collect()) == bag(result.fetchall())


# ---- vectors ----------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int, node string, weight string, least string, n string"


def _vectors(spark, rows):
    ship_package(spark)
    return spark.createDataFrame([(i, v, 1, "x", "x", "x", "x") for i, v in rows], VECTORS).repartition(3)


def _expected(rows, cosine=0.95):
    fine = [
        k for k, (i, v) in enumerate(rows)
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    units = {k: plain.unit([np.array(rows[k][1], np.float32).astype(float)])[0] for k in fine}
    linked = lambda i, j: i in units and j in units and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    label = plain.components(len(rows), lambda i, j: linked(order[i], order[j]))
    out = []
    for at, k in enumerate(order):
        links = sum(1 for j in units if j != k and linked(k, j)) if k in units else 0
        root = rows[order[label[at]]][0]
        out.append((rows[k][0], links, root, None if rows[k][0] is None else rows[k][0] == root if k in units else True))
    return bag(out)


def _clustered(seed, n, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dims))
    x = np.where(rng.random((n, 1)) < 0.6, centres[rng.integers(0, 8, n)] + rng.normal(size=(n, dims)) * 0.22, rng.normal(size=(n, dims)))
    return [(int(i), [float(v) for v in np.float32(row)]) for i, row in zip(rng.permutation(n) * 3, x, strict=True)]


@pytest.mark.parametrize(("n", "block"), [(150, 8192), (260, 24)])
def test_vectors(spark, n, block):
    rows = _clustered(n, n)
    assert bag(cover_tree.vector_groups(_vectors(spark, rows), block=block).collect()) == _expected(rows)


def test_cells_hold_what_is_close(spark):
    """Clustered vectors: cells by distance, several levels, and few pairs of cells are left."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(40, 12))
    x = plain.unit(np.repeat(centres, 50, axis=0) + rng.normal(size=(2000, 12)) * 0.03)
    ship_package(spark)
    rows = [(i, 1, [float(c) for c in v]) for i, v in enumerate(x)]
    found = spark.createDataFrame(rows, "node bigint, weight bigint, embedding array<double>").repartition(4)
    vectors = found.mapInArrow(cover_tree._units, "node bigint, weight bigint, v binary")
    members, tree, depth = cover_tree.cells_of(vectors, 60)
    assert depth >= 1 and members.count() == 2000
    reach = (2 - 2 * 0.95) ** 0.5
    pairs = [tuple(r) for r in cover_tree.cell_pairs(tree, depth, reach).collect()]
    cell = {r["node"]: r["cell"] for r in members.select("node", "cell").collect()}
    leaves = {r["cell"]: r for r in tree.where("leaf").collect()}
    assert set(cell.values()) == set(leaves)
    for node, name in cell.items():
        centre = np.frombuffer(leaves[name]["centre"])
        assert np.linalg.norm(x[node] - centre) <= leaves[name]["radius"] + 1e-7
    near = np.argwhere(x @ x.T >= 0.95)
    assert {tuple(sorted((cell[i], cell[j]))) for i, j in near.tolist()} <= set(pairs)
    assert len(pairs) < len(leaves) ** 2 / 8
    sizes = [r["n"] for r in leaves.values()]
    assert sum(n <= 60 for n in sizes) >= 0.9 * len(sizes)
    links = cover_tree.links_of(found, 0.95, 60)
    counts = {r[0]: r[1] for r in links.where("b is null").groupBy("a").agg(F.sum("n")).collect()}
    expected = (x @ x.T >= 0.95).sum(axis=1) - 1
    assert all(counts.get(i, 0) == n for i, n in enumerate(expected.tolist()))


def test_cells_that_distances_do_not_part(spark):
    """One dense group, larger than a block by far, and vectors of two lengths."""
    rng = np.random.default_rng(13)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(1 + rng.normal(size=(150, 6)) * 1e-4)]
    rows += [(1000 + i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(60, 3)))]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in rows]
    assert bag(cover_tree.vector_groups(_vectors(spark, rows), block=10).collect()) == _expected(rows)


def test_turned_vectors(spark, sf_dir):
    found = llm.QUERIES["turned_vector_groups"](spark, sf_dir).collect()
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    result = con.execute(llm.ORACLES["turned_vector_groups"])
    names = [d[0] for d in result.description]
    assert bag([tuple(r[n] for n in names) for r in found]) == bag(result.fetchall())
    assert min(r["n_links"] for r in found) >= 1 and max(r["n_links"] for r in found) >= 2


def test_vector_edges(spark):
    rows = _clustered(7, 30)
    rows += [(900 + i, rows[0][1]) for i in range(6)] + [(950, [2 * x for x in rows[1][1]])]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [None] + [1.0] * 15), (1004, [float("nan")] + [1.0] * 15)]
    rows += [(1005, [float("inf")] + [1.0] * 15), (1006, [1.0, 2.0]), (1007, [1.0, 2.1]), (None, rows[0][1]), (1008, [3e38] * 16)]
    assert bag(cover_tree.vector_groups(_vectors(spark, rows), block=8).collect()) == _expected(rows)
    assert cover_tree.vector_groups(_vectors(spark, rows).where("false")).count() == 0
    assert bag(cover_tree.vector_groups(_vectors(spark, rows[37:40])).collect()) == _expected(rows[37:40])


@pytest.mark.parametrize("level", [0, 1, cover_tree.top_level(0.95)])
def test_dense_group_by_bounds(level):
    """Bounds alone link close nodes, and opened nodes agree with the full matrix."""
    rng = np.random.default_rng(2)
    x = plain.unit(rng.normal(size=(1, 8)) + rng.normal(size=(1500, 8)) * np.repeat([0.02, 0.15, 0.6], 500)[:, None])
    links = cover_tree.Links(np.ones(len(x), np.int64))
    top = cover_tree.made_nodes(x, np.arange(len(x)), *cover_tree.opened(x, np.arange(len(x)), level))
    cover_tree.traverse(x, top, None, 0.95, links)
    assert (links.count == (x @ x.T >= 0.95).sum(axis=1) - 1).all()
    for node in top:
        assert (np.sqrt(np.maximum(2 - 2 * x[node.rows] @ node.centre, 0)) <= node.radius + 1e-7).all()


@pytest.mark.parametrize("held", [50, 1 << 16])
def test_noisy_copies_give_a_spanning_forest(held, monkeypatch):
    """Nodes of one vector each, all of them linked: edges do not grow with the pairs."""
    monkeypatch.setattr(cover_tree, "HELD", held)
    rng = np.random.default_rng(3)
    x = plain.unit(np.repeat(rng.normal(size=(2, 384)), 200, axis=0) + rng.normal(size=(400, 384)) * 0.21)
    links = cover_tree.Links(np.ones(len(x), np.int64))
    top = cover_tree.made_nodes(x, np.arange(len(x)), *cover_tree.opened(x, np.arange(len(x)), cover_tree.top_level(0.95)))
    assert len(top) > 300
    cover_tree.traverse(x, top, None, 0.95, links)
    near = x @ x.T >= 0.95
    assert (links.count == near.sum(axis=1) - 1).all() and links.count.sum() > 50 * len(x)
    assert sum(map(len, links.edges)) <= 2 * len(x) + held
    edges = {tuple(e) for e in links.forest().tolist()}
    assert len(edges) < len(x)
    joined = plain.components(len(x), lambda i, j: (i, j) in edges or (j, i) in edges)
    assert joined == plain.components(len(x), lambda i, j: near[i, j])


def test_net_covers_and_separates():
    x = plain.unit(np.random.default_rng(4).normal(size=(700, 6)))
    owner = cover_tree.net(x, 0.5)
    first = {o: np.flatnonzero(owner == o)[0] for o in np.unique(owner)}
    assert all(np.linalg.norm(x[i] - x[first[o]]) <= 0.5 + 1e-9 for i, o in enumerate(owner))
    centres = x[list(first.values())]
    assert (np.linalg.norm(centres[:, None] - centres[None], axis=2) + 9 * np.eye(len(centres)) > 0.5 - 1e-9).all()


def test_given_vectors(spark, sf_dir):
    rows = [(r["vec_id"], list(r["embedding"])) for r in read(spark, sf_dir, "embeddings").collect()]
    assert bag(llm.QUERIES["op9_cover_tree"](spark, sf_dir).collect()) == _expected(rows)


# ---- quality ----------------------------------------------------------------


def _auc(score, label):
    good, bad = score[label == 1], score[label == 0]
    return ((good[:, None] > bad[None, :]).mean() + (good[:, None] == bad[None, :]).mean() / 2)


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.1"
    scored = llm.QUERIES["op6_compression_classifier"](spark, folder).where("held_out")
    rows = scored.join(read(spark, folder, "labels"), "doc_id").select("score", "quality", "predicted").collect()
    score, label, predicted = (np.array([r[i] for r in rows]) for i in range(3))
    assert _auc(score, label) > 0.97
    assert (predicted[label == 1] == 1).mean() > 0.97
    assert ((score >= 0) & (score <= 1)).all()


def test_quality_edges(spark, docs, empty):
    labels = read(spark, "/root/testdata/sf0.01", "labels")
    scored = quality.quality_scores(docs, labels).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in scored)
    assert quality.quality_scores(empty, labels).count() == 0
    none = quality.quality_scores(docs, labels.where("false")).select("score").distinct().collect()
    assert len(none) == 1 and none[0][0] == pytest.approx(0.5)
    one = quality.fit(docs, labels.withColumn("quality", F.lit(1)))
    assert 0 <= one.score("any text") <= 1
    odd = labels.union(labels).union(spark.createDataFrame([(None, 1, 0), (0, None, 0), (1, 7, 0)], labels.schema))
    assert quality.quality_scores(docs, odd).count() == docs.count()
    kept = quality.keep_likely_good(docs, labels)
    assert kept.columns == docs.columns


def test_quality_does_not_learn_from_the_held_out_fold(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    turned = labels.withColumn("quality", F.when(quality.fold() == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(docs, turned) == quality.fit(docs, labels)


def test_quality_by_a_plain_version(spark, sf_dir):
    """The same sample, dictionaries and curve, and the scores, in plain loops."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    texts = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
    spots = {r[0]: (r[1], r[0]) for r in labels.select("doc_id", F.xxhash64("doc_id")).collect()}
    label = {r[0]: r[1] for r in labels.select("doc_id", "quality").collect()}
    folds = {i: zlib.crc32(str(i).encode()) % 4 for i in label}
    order = sorted(label, key=spots.get)
    stretch = 900

    def learnt(i):
        text = texts[i]
        start = spots[i][0] % (len(text) - stretch + 1) if len(text) > stretch else 0
        return text[start : start + stretch]

    def first(ids, limit):
        out, size = [], 0
        for i in ids:
            size += len(learnt(i).encode()) + 1
            if size > limit:
                break
            out.append(i)
        return out

    good, bad = ([i for i in order if folds[i] < 2 and label[i] == q][:20] for q in (1, 0))
    good, bad, rest = first(good, 15_000), first(bad, 15_000), first([i for i in order if folds[i] == 3][:15], 9000)
    model = quality.fit(docs, labels, dictionary_texts=20, curve_texts=15, stretch=stretch, dictionary_bytes=15_000, curve_bytes=9000)
    assert model.bad == b"\n".join(learnt(i).encode() for i in bad)
    whole = b"\n".join(learnt(i).encode() for i in good)
    assert whole.startswith(model.good) and 0 < len(rest) < 16

    def difference(text):
        data, total = text.encode(), 0
        for start in range(0, len(data), 4096):
            sizes = []
            for words in (model.bad, model.good):
                packer = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)
                sizes.append(len(packer.compress(data[start : start + 4096])))
            total += sizes[0] - sizes[1]
        return total / len(data) if data else 0.0

    x, y = np.array([difference(learnt(i)) for i in rest]), np.array([label[i] for i in rest])
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z, w, b = (x - x.mean()) / x.std(), 0.0, 0.0
    for _ in range(60_000):  # plain gradient steps
        p = 1 / (1 + np.exp(-(w * z + b)))
        w, b = w + 0.05 * ((target - p) @ z - 1e-3 * w), b + 0.05 * ((target - p).sum() - 1e-6 * b)
    for r in quality.with_score(docs, model).select("text", "score").collect():
        at = w * (difference(r["text"]) - x.mean()) / x.std() + b
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-at)), abs=1e-4)


def test_long_texts_are_learnt_from(spark):
    """By a stretch of theirs; none drops out of the sample for its length."""
    rows = [(i, ("good words here " if i % 2 else "bad stuff now ") * 4000) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(docs, labels)
    assert b"good words" in model.good and b"bad stuff" in model.bad
    assert model.score("good words here " * 20) > 0.5 > model.score("bad stuff now " * 20)


def test_pipeline_of_no_documents(spark, empty, sf_dir):
    made = empty.select("doc_id", "text", "lang", F.col("spans").alias("source"), "n_chars")
    columns = made.columns
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, made, sf_dir)
        assert made.count() == 0
        assert name == "packing" or made.columns == columns


def test_length_does_not_matter():
    model = quality.Classifier(b"abc def ghi jkl mno " * 20, b"xyz uvw rst " * 20, 1.0, 0.0)
    short = "abc def ghi jkl mno pqr " * 171
    assert model.difference(short) > 0
    assert model.difference(short * 50) == pytest.approx(model.difference(short), rel=0.1)


# ---- pipeline ---------------------------------------------------------------


def test_pipeline(spark, sf_dir):
    """Each stage beside a plain version on that stage's own input."""
    docs = read(spark, sf_dir, "documents").persist()
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    made = stages["quality_classifier"](spark, docs, sf_dir).persist()
    assert bag(made.collect()) == bag(r for r in docs.collect() if model.score(r["text"] or "") >= 0.7)
    before, made = made, stages["quality_rules"](spark, made, sf_dir).persist()
    base = {r["doc_id"] for r in before.collect() if plain.rule_measures(r["text"])[-1]}
    kept = {r["doc_id"] for r in made.collect()}
    assert kept and not kept & base and kept | base <= {r["doc_id"] for r in before.collect()}
    before, made = made, stages["near_duplicates"](spark, made, sf_dir).persist()
    rows = sorted(before.select("doc_id", "text").collect())
    prints = np.array([plain.fingerprint(t) for _, t in rows], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    label = plain.components(len(rows), lambda i, j: near[i, j])
    assert {r["doc_id"] for r in made.collect()} == {rows[i][0] for i in set(label)}
    before, made = made, stages["personal_data"](spark, made, sf_dir).persist()
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert made.columns == docs.columns
    for r in made.collect():
        assert plain.personal(r["text"])[:2] == (0, 0)
        if plain.personal(texts[r["doc_id"]])[:4] == (0, 0, 0, 0):
            assert r["text"] == texts[r["doc_id"]]
    pieces = stages["packing"](spark, made, sf_dir)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in made.collect()}
    assert bag(corpus_pipeline.run(spark, sf_dir).drop("sequence_id", "offset").collect()) == bag(pieces.drop("sequence_id", "offset").collect())


def test_every_numbered_query_is_registered():
    import __spark_entry__ as driver

    names = list(driver.queries())
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names
    assert set(driver.oracle_sql()) <= set(names)
    assert os.path.exists(corpus_pipeline.__file__)


def test_vectors_are_sent_by_shelves_of_blocks(spark):
    """Without structure a vector meets all blocks, but is sent once a shelf: no more copies than shelves; links as by all pairs."""
    ship_package(spark)
    rng = np.random.default_rng(8)
    some = rng.normal(size=(600, 16))
    data = np.r_[some, some[:200] + 0.05 * rng.normal(size=(200, 16))]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    rows += [(1000 + i, [float(i), 1.0]) for i in range(5)]  # other lengths lie on shelves of their own
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    units = data / np.sqrt((data**2).sum(axis=1))[:, None]
    links = (units @ units.T >= 0.95).sum(axis=1) - 1
    found = {r["vec_id"]: r["n_links"] for r in cover_tree.vector_groups(df, block=16).collect()}
    assert [found[i] for i in range(800)] == links.tolist()
    tree = spark.createDataFrame([(f"16.{i}", 10 + i, True) for i in range(50)], "cell string, n bigint, leaf boolean")
    shelves = cover_tree.shelves_of(tree, 16)
    assert shelves.select("home").distinct().count() == shelves.count() > 2 * cover_tree.SHELVES
    assert shelves.select("shelf").distinct().count() <= cover_tree.SHELVES + 2
