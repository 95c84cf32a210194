"""Operator 7 against a brute-force version, operator 10 on held-out labels and small hierarchies."""

import base64
import gzip
import hashlib
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from studylantern.llm import quality, queries, warc
from studylantern.llm.common import shared_folder


def expected(pages, least=0):
    groups = defaultdict(list)
    for page_id, _, html in pages:
        groups[html or ""].append(page_id)
    out = []
    for page_id, _, html in pages:
        raw, same = (html or "").encode(), groups[html or ""]
        newest = max((i for i in same if i is not None), default=None)
        revisit = len(same) > 1 and len(raw) >= least and page_id != newest
        out.append((page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", newest if revisit else None))
    return sorted(out, key=str)


def captures(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


PAGES = [
    (1, "http://a.com/x", "<p>same</p>"), (2, "http://a.com/x", "<p>same</p>"), (9, "https://www.b.org/Y?q=1", "<p>same</p>"), (3, None, None), (4, "", ""), (5, "http://[bad", "é\r\n\r\nWARC/1.1\r\n"),
    (6, "http://c.net:8080/a\r\nX: y", "long " * 50_000), (6, "http://c.net:8080/", "long " * 50_000), (None, "http://a.com/", "<p>same</p>"), (None, "http://d.com/", "alone"), (7, "http://d.com/", "é\r\n\r\nWARC/1.1\r\n"),
]


@pytest.mark.parametrize("least", [0, 12])
def test_archive_matches_brute_force(spark, least):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, captured string")
    assert captures(warc.archive(pages, least)) == expected(PAGES, least)
    assert warc.archive(pages.limit(0)).count() == 0


def test_op7_over_the_table(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    out = queries.op7_warc(spark, sf)
    assert captures(out) == expected(pages)
    rows = sorted(out.collect(), key=lambda r: (r["merge_range"], r["merge_position"]))
    order = [(r["url_key"], r["captured"], r["page_id"]) for r in rows]
    assert order == sorted(order)


def test_files_are_warc(spark):
    path = f"{shared_folder(spark)}/test-warc-{random.random()}"
    pages = spark.createDataFrame([(*p, "2020-01-01T00:00:00Z") for p in PAGES], "page_id long, url string, html string, captured string")
    warc.write_warc(warc.label_copies(pages), path, file_records=3)
    seen = [h for r in spark.read.format("binaryFile").load(path).collect() if r["path"].endswith(".gz") for _, h, _ in warc.records(gzip.decompress(r["content"]))]
    assert len(seen) == len(PAGES) and sum(h["WARC-Type"] == "revisit" for h in seen) == 5
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.records(b"HTTP/1.1 200\r\n\r\n"))


def test_captures_without_time_come_first(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", "x", "2021-01-01T00:00:00Z"), (2, "http://a.org/", "y", None), (3, "http://a.org/", None, "2020-01-01T00:00:00Z")], "page_id long, url string, html string, at string")
    rows = sorted(warc.archive(pages, captured=F.col("at")).collect(), key=lambda r: (r["merge_range"], r["merge_position"]))
    assert [(r["page_id"], r["captured"]) for r in rows] == [(2, None), (3, "2020-01-01T00:00:00Z"), (1, "2021-01-01T00:00:00Z")]


def test_files_are_bounded_in_bytes(spark):
    pages = spark.range(60).select(F.col("id").alias("page_id"), F.lit("http://a.org/").alias("url"), F.expr("repeat(concat('ab', id), cast(if(id % 10 = 0, 4000, 20) as int))").alias("html"), F.lit("2021").alias("captured"))
    path = f"{shared_folder(spark)}/warc-bytes-{random.random()}"
    warc.write_warc(warc.label_copies(pages.coalesce(1)), path, file_records=50, file_bytes=100_000)
    files = [gzip.decompress(r["content"]) for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).collect() if r["path"].endswith(".gz")]
    assert sum(len(list(warc.records(f))) for f in files) == 60 and max(map(len, files)) < 100_000 and len(files) >= 3
    assert warc.read_runs(spark, path).count() == 60


def test_ranges_follow_the_number_of_captures(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 40)
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("http://a.org/").alias("url"), F.col("id").cast("string").alias("html"))
    rows = sorted(warc.archive(pages).collect(), key=lambda r: (r["merge_range"], r["merge_position"]))
    assert [r["page_id"] for r in rows] == list(range(400)) and len({r["merge_range"] for r in rows}) >= 8


def test_url_keys():
    assert warc.url_key("https://www.B.org/Y?q=A") == "org,b)/y?q=a" and warc.url_key("http://c.net:8080") == "net,c:8080)/"


def test_loser_tree_merges_any_runs():
    rng = random.Random(4)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randrange(9), j) for _ in range(rng.choice((0, 1, 5, 30)))) for j in range(k)]
        assert list(warc.loser_tree_merge(runs, lambda r: r)) == sorted(x for r in runs for x in r)


def test_op10_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    train = labels.filter("doc_id % 2 = 0")
    model = quality.fit(docs, train)
    assert model.held_out_accuracy > 0.97
    rows = quality.classify(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").select("quality", "q_keep").collect()
    good, bad = ([r["q_keep"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.1


def test_op10_scores_every_row(spark, sf, odd_docs):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    out = queries.op10_quality(spark, sf)
    assert out.count() == n and out.filter("q_keep IS NULL OR isnan(q_score)").count() == 0
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (5, None)], "doc_id long, quality int")
    for docs in (odd_docs, odd_docs.limit(0)):
        scored = quality.classify(docs, quality.fit(docs, labels), host_col="n", path_col="bin")
        assert scored.count() == docs.count() and scored.columns[:4] == docs.columns and not scored.filter("q_keep IS NULL").count()
    flat = quality.fit(odd_docs, labels.limit(0))
    assert flat.prior == 0 and math.isnan(flat.held_out_accuracy)


def test_sparse_paths_shrink_to_their_host(spark):
    rows = [("good", "a", 3.0)] * 400 + [("good", "b", 2.0)] * 300 + [("bad", "a", -3.0)] * 300 + [("bad", "b", -3.0)] * 200 + [("bad", "new", 3.0), ("solo", None, 3.0), (None, "x", -3.0)]
    sites, share = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, evidence double"))
    got = {(r["host"], r["path"]): r for r in sites.collect()}
    p = 1 / (1 + math.exp(-3))
    assert len(got) == 7 and 0.5 < share < 0.6
    assert got[("good", "a")]["path_posterior"] > 0.9 > 0.2 > got[("bad", "a")]["path_posterior"]
    assert got[("bad", "a")]["path_posterior"] < got[("bad", "new")]["path_posterior"] < p
    assert share < got[("solo", None)]["host_posterior"] < p and got[(None, "x")]["host_posterior"] < share


def test_posteriors_against_plain_sums(spark):
    rng = random.Random(6)
    rows = [(f"h{rng.randrange(6)}", f"p{rng.randrange(5)}", rng.gauss(1.5, 1)) for _ in range(300)] + [(None, "x", -2.0), ("rare", None, 4.0)]
    sites, share = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, evidence double"))
    got = {(r["host"], r["path"]): (r["host_posterior"], r["path_posterior"]) for r in sites.collect()}
    soft = [(h, p, 1 / (1 + math.exp(-e))) for h, p, e in rows]

    def sums(key):
        out = {}
        for r in soft:
            good, n = out.get(key(r), (0.0, 0))
            out[key(r)] = (good + r[2], n + 1)
        return out

    def strength(groups, above):
        """Variance of one document over that between groups, less one."""
        between = sum(n * (good / n - above(k)) ** 2 for k, (good, n) in groups.items())
        spread = [above(k) * (1 - above(k)) for k in groups]
        tau = max((between - sum(spread)) / sum(n for _, n in groups.values()), 1e-6)
        return min(max(sum(spread) / len(spread) / tau - 1, 1.0), 1e6)

    everything = sum(s for _, _, s in soft) / len(soft)
    hosts, paths = sums(lambda r: r[0]), sums(lambda r: r[:2])
    k = strength(hosts, lambda _: everything)
    by_host = {h: (good + k * everything) / (n + k) for h, (good, n) in hosts.items()}
    k = strength(paths, lambda key: by_host[key[0]])
    assert abs(share - everything) < 1e-9 and got.keys() == paths.keys()
    for key, (good, n) in paths.items():
        want = (by_host[key[0]], (good + k * by_host[key[0]]) / (n + k))
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[key], want, strict=True))


def test_the_site_decides_ambiguous_documents(spark):
    """The same text of even evidence is kept on a good site and rejected on a bad one."""
    shouted = [0.0] * 10
    shouted[8] = -2.0
    model = quality.Model((0.0,) * 10, (1.0,) * 10, tuple(shouted), 4.0, 0.0, 1.0)
    good, bad, even = "word " * 40, "!!!! " * 40, "word !!!! " * 20
    docs = [(good, "good", 0)] * 60 + [(bad, "bad", 0)] * 60 + [(even, "good", 2), (even, "bad", 2)]
    frame = spark.createDataFrame([(i, *d, "en") for i, d in enumerate(docs)], "doc_id long, text string, source string, q_score int, lang string")
    out = quality.classify(frame, model, prefix="own_").filter("q_score = 2").collect()
    assert all(abs(r["own_evidence"]) < 1e-6 for r in out)
    assert {r["source"]: r["own_keep"] for r in out} == {"good": True, "bad": False}


def test_features_do_not_depend_on_neighbours(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("Añ 12!! w* "), F.col("id")).alias("text"))
    model = quality.Model((0.0,) * 10, (1.0,) * 10, tuple(range(1, 11)), 0.0, 0.0, 1.0)
    a = {r["doc_id"]: r["evidence"] for r in quality.with_evidence(docs.coalesce(1), model).collect()}
    b = {r["doc_id"]: r["evidence"] for r in quality.with_evidence(docs.repartition(7), model).collect()}
    assert a == b
