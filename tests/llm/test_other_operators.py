"""Vectors, records, classifiers and the pipeline."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import embedding_dedup, queries, quality, toxicity, warc
from tallyframe.llm.components import components
from tallyframe.llm.shared import crc_remainder

SMALL = "/root/testdata/sf0.001"


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(1000 + i, 1001 + i) for i in range(50)]
    pairs += [(5, 5), (None, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(4)
    y = rng.normal(0, 2, (500, 8))
    point = embedding_dedup.nearest_points(y)
    around = embedding_dedup.minimal_vectors()
    assert len(around) == 240 and np.allclose((around**2).sum(axis=1), 2)
    mine = ((y - point) ** 2).sum(axis=1)
    assert all((((y - point - v) ** 2).sum(axis=1) >= mine - 1e-9).all() for v in around)


def test_embedding_near_duplicates(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for i in range(200):
        v = base[i % 40] + rng.normal(size=64) * (0.15 if i % 2 else 0.35)
        rows.append((100 + i, v.tolist()))
    rows += [(900 + i, base[0].tolist()) for i in range(30)]
    rows += [(1000, None), (1001, [0.0] * 64), (1002, [math.nan] * 64), (1003, [None] * 64), (1004, [1.0, 2.0]), (1005, [2.0, 4.0]),
             (1006, []), (1007, [math.inf] + [1.0] * 63), (None, base[0].tolist()), (1008, (base[1] * 1e200).tolist())]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, component_id int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame).collect()}
    assert len(got) == len(rows)
    usable = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, found = {i: 0 for i, _ in rows}, 0
    for i, a in usable:
        for j, b in usable:
            if i != j and len(a) == len(b):
                x, y = a / np.abs(a).max(), b / np.abs(b).max()
                links[i] += x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.9
    total = sum(links.values())
    for i, n in links.items():
        assert got[i].n_links <= n, i
        found += got[i].n_links
    assert total > 1500 and found >= 0.95 * total
    assert all(got[i].n_links == 0 and got[i].kept for i in (1000, 1001, 1002, 1003, 1006, 1007, None))
    assert got[1005].component_id == 1004 and got[929].n_links >= 30 and got[929].component_id == 0
    assert embedding_dedup.near_duplicates(frame.where("false")).count() == 0


def test_records(spark):
    page = ('<!DOCTYPE html><html lang="de"><head><title>A &amp; B</title><style>p{}</style></head><body><!-- <a href="/no">x</a> -->'
            '<h1>One</h1><p>two <b>three</b>\nfour<br>five &lt;6&gt; <a title="a>b" href="/x">link</a> <a href="/x">again</a>'
            '<script>var t="</p>";</script></body></html>')  # fmt: skip
    rows = [(1, "http://h.example/a/b", page), (2, None, None), (3, "::bad", "<p"), (4, "http://h.example/", ""), (1, "http://h.example/a/b", page)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, records string")
    made = warc.derivatives(warc.responses(pages), keep=["page_id"])
    got = made.withColumn("raw", warc.serialised(made)).collect()
    assert len(got) == 10
    first = {r.record_type: r for r in got if r.page_id == 1}
    text, meta = first["conversion"], first["metadata"]
    assert text.block == "One\ntwo three four\nfive <6> link again"
    assert "title: A & B\r\n" in meta.block and meta.block.count("outlink: ") == 1 and "outlink: http://h.example/x\r\n" in meta.block
    assert text.refers_to == meta.refers_to and text.concurrent_to == meta.record_id and meta.concurrent_to == text.record_id
    for r in got:
        block = r.block.encode()
        assert r.block_digest == "sha256:" + hashlib.sha256(block).hexdigest() and r.content_length == len(block)
        head, _, rest = r.raw.partition("\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
        assert rest.encode()[: int(fields["Content-Length"])] == block and fields["WARC-Refers-To"] == r.refers_to
        if r.page_id == 1:
            assert r.payload_digest == "sha256:" + hashlib.sha256(page.encode()).hexdigest()
    assert warc.derivatives(warc.responses(pages.where("false"))).count() == 0


@pytest.mark.parametrize("page, text", [
    ("<html><head><title>t</title><body><p>Hello</p></body></html>", "Hello"),
    ("<head lang='a>b'>\n<meta x><link y/><base><!-- c --><script>s</script><title>a <b></title><p>one<p>two", "one\ntwo"),
    ("<head><title>t</title>bare text<p>x", "bare text\nx"),
    ("<HEAD><title>t</title></HEAD ><body>x<header>y</header>", "x\ny"),
    ("<head><title>t</title></html>late", "late"),
    ("<head><title>never closed<body><p>x", "never closed\nx"),
    ("<head><noscript><link></head><p>x", "x"),
    ("a<svg width='1/2>' />b<svg><text>no</text></svg>c<svg/>d", "ab cd"),
    ("<p>a<svg><path>b<p>c", "ab\nc"),
    ("a<template>n<template>o</template>p</template>b<noscript>q</noscript>c", "a b c"),
    ("a<svg>b<template>c</svg>d</template>e", "a e"),
    ("a<noscript>b<p>c<noscript>d</noscript>e", "ab\nc e"),
    ("<style-guide>a</style-guide><head-x>b</head-x><svg-icon>c</svg-icon><scripts>d", "abcd"),
    ("a<script>b</scripts>c</script >d<style>e", "a d"),
    ("<head>" * 3 + "<title>x</title>" + "<svg>" * 3 + "a", "a"),
])
def test_text_after_open_elements(page, text):
    assert warc.plain_text(page) == text


def test_many_open_elements():
    n = 20_000
    assert warc.plain_text("<head><title>" * n + "<svg>" * n + "<template><noscript>" * n + "</svg>" * n + "end") == "end"


@pytest.mark.parametrize("rate, label", [(quality.rate, "quality"), (toxicity.rate, "toxic")])
def test_classifiers(spark, rate, label):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    odd = spark.createDataFrame([(None, None), (-1, ""), (-2, "x " * 50_000), (-2, "y")], "doc_id long, text string")
    some = docs.select("doc_id", "text").unionByName(odd).withColumn("score", F.lit("clash"))
    more = labels.select("doc_id", label).union(spark.createDataFrame([(None, 1), (-1, None), (-9, 1)], f"doc_id long, {label} int"))
    out = rate(some, more, lambda i: crc_remainder(i, 4) != 1).select("row.doc_id", "score", "predicted")
    assert out.count() == some.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    known = labels.where(crc_remainder(F.col("doc_id"), 4) == 1).select("doc_id", F.col(label).alias("y"))
    right = out.join(known, "doc_id").agg(F.avg((F.col("predicted") == F.col("y")).cast("double"))).first()[0]
    assert right >= 0.93
    assert rate(some, more.where("false"), lambda i: F.lit(True)).where("score is null").count() == 0
    assert rate(some.where("false"), more, lambda i: F.lit(True)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    extra = spark.createDataFrame(
        [(None, "lone text", "en", "s", 9), (None, None, None, None, None), (1_000_001, "mail ann@example.org now", "en", "s", 24)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").unionByName(extra)
    clean = p.drop_toxic(spark, docs, SMALL)
    single = p.drop_near_duplicates(spark, clean, SMALL)
    pure = p.drop_contaminated(spark, single, SMALL)
    safe = p.hide_personal_data(spark, pure, SMALL)
    for frame in (clean, single, pure, safe):
        assert frame.columns == docs.columns
    ids = {r.doc_id for r in safe.select("doc_id").collect()}
    assert None in ids and 1_000_001 in ids and safe.where("doc_id is null").count() == 2
    assert safe.where("doc_id = 1000001").first().text == "mail [EMAIL] now"
    kept = [r.doc_id for r in single.where("doc_id is not null").collect()]
    assert len(kept) == len(set(kept)) < docs.count()
    assert safe.count() == pure.count() <= single.count()
    assert [name for name, _ in p.STAGES][-1] == "packing" and p.run(spark, SMALL).count() > 0


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    import corpus_pipeline as p

    text = lambda word: " ".join(f"{word}{i}" for i in range(100))
    near = lambda word: f"{text(word)} more"
    rows = [(106, text("x"), "a"), (106, text("y"), "a"), (300, near("x"), "a"), (200, near("y"), "a"), (106, near("y"), "b"),
            (106, text("x"), "b"), (106, "", "a"), (106, None, "a"), (107, "", "a"), (50, near("z"), "a"), (60, text("z"), "a"),
            (None, text("x"), "a"), (None, text("x"), "a")]
    rows += [(9, text(f"one{i}by"), "a") for i in range(30)]
    frames = [spark.createDataFrame(x, "doc_id long, text string, lang string") for x in (rows, rows[::-1])]
    outs = [sorted((tuple(r) for r in p.drop_near_duplicates(spark, f.repartition(3), SMALL).collect()), key=str) for f in frames]
    assert outs[0] == outs[1]
    kept = [(i, t) for i, t, _ in outs[0]]
    assert kept.count((106, text("x"))) == 1 and sum(i == 106 and (t or "").startswith("y0") for i, t in kept) == 1
    assert not {200, 300, 60} & {i for i, _ in kept} and (50, near("z")) in kept
    assert sum(i == 106 and not t for i, t in kept) == 1 and (107, "") in kept
    assert [i for i, _ in kept].count(9) == 30 and [i for i, _ in kept].count(None) == 2 and len(kept) == 37


def test_registered_queries(spark):
    names = list(queries.queries())
    assert [n for n in names if n.startswith("op")] == sorted((n for n in names if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert len(names) == 14 and set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    import duckdb

    connection = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    want = connection.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = queries.queries()[name](spark, SMALL).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)
