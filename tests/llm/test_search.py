import gzip
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tests.llm.helpers import ODD, docs

from hyperstrata.llm import decontamination, licenses, neighbours, warc


def test_neighbours_recall_and_scores(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = neighbours.nearest(table, F.col("vec_id") % 50 == 0).collect()
    rows = {r["vec_id"]: np.array(r["embedding"], "f8") for r in table.collect()}
    hits = 0
    for q in (k for k in rows if k % 50 == 0):
        score = {k: float(rows[q] @ v / (np.linalg.norm(rows[q]) * np.linalg.norm(v))) for k, v in rows.items() if k != q}
        top = sorted(score, key=lambda k: (-score[k], k))[:5]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert all(abs(m[2] - score[m[1]]) < 1e-12 for m in mine)
        hits += len({m[1] for m in mine} & set(top))
    assert hits >= 0.9 * len(got)


def test_neighbours_estimates_stay_within_bounds():
    rng = np.random.default_rng(0)
    x, q = rng.normal(size=(2000, 64)), rng.normal(size=(20, 64))
    turn = neighbours.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    bits, scalars = neighbours.encode(x, turn)
    assert bits.shape == (2000, neighbours.CODE // 8)
    est, err = neighbours.estimate(q, bits, scalars, turn)
    true = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    assert (np.abs(est - true) <= err).mean() > 0.9 and abs((est - true).mean()) < 5e-3


def test_neighbours_odd_rows_and_ties(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 3)
    monkeypatch.setattr(neighbours, "QUERIES", 2)
    monkeypatch.setattr(neighbours, "MEET", 1)
    monkeypatch.setattr(neighbours, "RERANK", 2)
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 2.0]), (3, [2.0, 0.0]), (2, [3.0, 0.0]), (2, [3.0, 0.0]), (1, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 1.0]), (10, [1.0, 1.0]), (100, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit(1)).withColumn("score", F.lit(2))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in neighbours.nearest(table, F.col("vec_id") % 50 == 0).collect()}
    assert [got[0, k][0] for k in range(1, 6)] == [2, 2, 3, 10, 50]
    assert got[0, 1][1] == 1.0 and got[0, 3][1] == 1.0
    assert {q for q, _ in got} == {0, 50}
    assert neighbours.nearest(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_neighbours_with_a_vector_that_a_third_of_the_rows_share(spark, monkeypatch):
    """Only few of its rows are candidates, and the answers are those of brute force."""
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    monkeypatch.setattr(neighbours, "MEET", 2)
    monkeypatch.setattr(neighbours, "RERANK", 40)
    rng = np.random.default_rng(3)
    hot = rng.normal(size=8)
    rows = [(k, (hot if k % 3 == 0 else hot + rng.normal(size=8) * rng.choice([0.01, 1.0])).tolist()) for k in range(600)] + [(0, hot.tolist())] * 20
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    valid = table.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"), F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("row"))
    assert neighbours.codes(valid, 5).count() == 400 + 5 + 5  # of the shared vector: five rows of id 0, then five more ids
    got = neighbours.nearest(table, F.col("vec_id") % 50 == 0).collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    wanted, mine = {}, {}
    for k in sorted({k for k in ids.tolist() if k % 50 == 0}):
        other = np.flatnonzero(ids != k)
        score = neighbours.cosines(x[ids == k][0], x[other])
        wanted[k] = [(int(ids[other[t]]), float(score[t])) for t in neighbours.best(ids[other], score, 5)]
    for r in sorted(got, key=lambda r: r["rank"]):
        mine.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    zero = mine.pop(0)
    assert len(zero) == 21 * 5 and set(zero) == set(wanted.pop(0))  # the repeated query is asked each time
    assert set(mine) == set(wanted)
    same = sum((Counter(mine[k]) & Counter(wanted[k])).total() for k in mine)
    assert same >= 0.9 * 5 * len(mine)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("offset", F.lit(1)).withColumn("payload", F.lit("x"))


def test_warc_round_trip(spark, tmp_path):
    rows = [(k, f"http://h/{k}", random.Random(k).choice(["same", "équal ☃", f"own {k}" * (k + 1), ""])) for k in range(60)]
    rows += [(70, None, None), (71, "http://x/\r\ninjected: y", "own"), (None, "u", "same"), (0, "http://h/0b", rows[0][2])]
    folder = str(tmp_path / "warc")
    index = warc.write_warc(pages(spark, rows), folder)
    got = warc.read_warc(index, folder).collect()
    assert len(got) == len(rows) == index.count()
    first = {}
    for k, _, html in rows:
        if k is not None:
            first[html or ""] = min(first.get(html or "", k), k)
    for r in got:
        if r["record_type"] == "response":
            body = bytes(r["payload"]).decode()
            assert len(r["payload"]) == r["payload_bytes"] and warc.payload_digest(bytes(r["payload"])) == r["payload_digest"]
            assert r["page_id"] == first[body]
        else:
            assert r["payload"] is None and r["refers_to"] in first.values()
    by_id = {(r["page_id"], r["url"]): r for r in got}
    for k, url, html in rows:
        r = by_id[k, None if url is None else re.sub(r"[\r\n]+", " ", url)]
        assert r["payload_bytes"] == len((html or "").encode()) and r["payload_digest"] == warc.payload_digest((html or "").encode())
        assert r["refers_to"] == (None if first[html or ""] == k else first[html or ""])
    raw = b"".join(gzip.open(f, "rb").read() for f in sorted((tmp_path / "warc").glob("*.warc.gz")))
    assert raw.count(b"WARC/1.1\r\n") == len(rows) and b"\r\ninjected" not in raw
    some = warc.read_warc(index.where("page_id in (3, 41)"), folder).collect()
    assert {r["page_id"] for r in some} == {3, 41}


def test_warc_payloads_under_the_limit_are_all_responses(spark, tmp_path):
    index = warc.write_warc(pages(spark, [(1, "a", "xx"), (2, "b", "xx"), (3, "c", "xxx"), (4, "d", "xxx")]), str(tmp_path / "w"), min_bytes=3)
    assert sorted((r["page_id"], r["record_type"]) for r in index.collect()) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]
    empty = str(tmp_path / "e")
    assert warc.read_warc(warc.write_warc(pages(spark, []), empty), empty).count() == 0


def test_warc_ranges_join_near_reads():
    assert warc.ranges([(100, 10), (0, 10), (12, 5)], gap=2, most_bytes=100) == [(0, 17, [(0, 10), (12, 5)]), (100, 110, [(100, 10)])]
    assert len(warc.ranges([(0, 10), (10, 10)], gap=5, most_bytes=15)) == 2


def plain_tiles(item, doc, k):
    """Greedy string tiling by looking at every pair of places."""
    item_free, doc_free, tiles = [True] * len(item), [True] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and item_free[i + n] and doc_free[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < k:
            return tiles
        tiles.append((i, j, n))
        for x in range(n):
            item_free[i + x] = doc_free[j + x] = False


def test_tiling_equals_plain_greedy_tiling():
    rng = random.Random(2)
    for _ in range(300):
        item = np.array([rng.randrange(1, 4) for _ in range(rng.randint(2, 14))], "u4")
        doc = np.array([rng.randrange(0, 4) for _ in range(rng.randint(0, 24))], "u4")
        k = rng.randint(2, 4)
        mine, plain = decontamination.tile(item, doc, k), plain_tiles(item.tolist(), doc.tolist(), k)
        assert sum(t[2] for t in mine) == sum(t[2] for t in plain)
        assert sorted(t[2] for t in mine) == sorted(t[2] for t in plain)
        for i, j, n in mine:
            assert (item[i : i + n] == doc[j : j + n]).all()


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_decontamination_catches_reordered_passages(spark, monkeypatch):
    words = [f"w{k}" for k in range(30)]
    item = " ".join(words)
    turned = " ".join([*words[15:], "then", *words[:15]])
    rows = [(1, f"before {item.upper()}, after"), (2, f"x {turned} y"), (3, " ".join(words[:12]) + " and no more"), (4, "clean text of its own words only"), (5, " ".join(reversed(words))), *ODD[:3], (None, item), (6, item), (6, item)]
    items = [(7, item), (8, None), (9, ""), (10, "short one"), (11, "…")]
    found = decontamination.contaminated(docs(spark, rows), benchmark(spark, items)).collect()
    assert sorted((r["doc_id"] or -1, r["item_id"]) for r in found) == [(-1, 7), (1, 7), (2, 7), (6, 7), (6, 7)]
    assert [r["n_tiles"] for r in found if r["doc_id"] == 2] == [2]
    table = docs(spark, rows)
    kept = decontamination.without_contaminated(table, benchmark(spark, items))
    assert kept.columns == table.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 3, 4, 5]
    monkeypatch.setattr(decontamination, "BITMAP_BITS", 64)  # a full bitmap finds the same
    again = decontamination.contaminated(docs(spark, rows), benchmark(spark, items)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert decontamination.contaminated(docs(spark, []), benchmark(spark, items)).count() == 0
    assert decontamination.contaminated(docs(spark, rows), benchmark(spark, [])).count() == 0


def test_decontamination_against_all_pairs(spark, sf):
    """No pair is lost by the seeds: every document is tiled with every item."""
    table, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    hashes = decontamination.word_hashes()
    own = [(r["item_id"], hashes(r["text"])) for r in items.collect()]
    wanted = set()
    for r in table.collect():
        doc = hashes(r["text"])
        for key, item in own:
            covered = sum(t[2] for t in decontamination.tile(item, doc, min(5, len(item)))) / len(item)
            wanted |= {(r["doc_id"], key, round(covered, 9))} if covered >= decontamination.THRESHOLD else set()
    assert {(r["doc_id"], r["item_id"], round(r["coverage"], 9)) for r in decontamination.contaminated(table, items).collect()} == wanted


def test_tiling_of_repetitive_texts_ends_soon():
    import time

    began, word = time.time(), np.uint64(7)
    assert sum(t[2] for t in decontamination.tile(np.full(2000, word), np.full(30_000, word), 5)) == 2000
    period = np.arange(40_000, dtype="u8") % 3
    assert sum(t[2] for t in decontamination.tile(period[:3000], period, 5)) == 3000
    assert time.time() - began < 20


def test_decontamination_finds_planted_items(spark, sf):
    table, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    clean = lambda t: " ".join(decontamination.words(t)[k].decode() for k in range(len(decontamination.words(t))))
    texts = {r["doc_id"]: clean(r["text"]) for r in table.collect()}
    wanted = {(d, r["item_id"]) for r in items.collect() for d, t in texts.items() if clean(r["text"]) in t}
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(table, items).collect()}
    assert wanted and wanted <= found


def plain_phrases(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = []
    for label, phrase in licenses.PHRASES:
        p = phrase.split()
        places += [(k, label) for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
    return len(words), sorted(places)


def test_license_phrases_against_brute_force(spark):
    rng = random.Random(4)
    pool = "Under the MIT license, Apache License: Version 2 cc BY-nc by nc K licenſe x 4.0 ~".split()
    rows = [(k, " ".join(rng.choices(pool, k=rng.randint(0, 40)))) for k in range(150)] + ODD + [(900, "cc by nc " * 4000), (901, "Released under the MIT License."), (902, "Licensed under CC BY-NC 4.0."), (903, "Apache License, Version 2.0")]
    got = licenses.scan(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    mine = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], tuple(sorted((s["start"], s["label"]) for s in r["spans"] if s["phrase"]))) for r in got)
    wanted = sorted((d if d is not None else -1, plain_phrases(t)[0], tuple(plain_phrases(t)[1])) for d, t in rows)
    assert mine == wanted
    assert licenses.scan(docs(spark, [])).count() == 0


def test_license_texts_survive_small_changes(spark):
    label, text = licenses.TEXTS[0]
    words = text.split()
    changed = words[:10] + ["really"] + words[10:20] + words[22:]
    rows = [(1, "x " + text.title() + " y"), (2, " ".join(changed)), (3, " ".join(words[:8]))]
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, rows)).collect()}
    assert [s["label"] for s in got[1]["spans"]] == [label] and got[1]["score"] == 1.0
    assert [s["label"] for s in got[2]["spans"]] == [label] and 0.6 <= got[2]["score"] < 1
    assert not got[3]["spans"] and 0 < got[3]["score"] < 0.6


def test_license_notices_repeated_back_to_back(spark):
    rows = [(n, "x " + "All rights reserved. " * n) for n in (1, 2, 3, 40)] + [(100, "rights reserved all rights"), (101, "all rights reserved, y all rights reserved")]
    got = {r["doc_id"]: [(s["label"], s["start"], s["end"]) for s in r["spans"]] for r in licenses.scan(docs(spark, rows)).collect()}
    label = "all-rights-reserved"
    assert all(sorted(got[n]) == [(label, 1 + 3 * k, 4 + 3 * k) for k in range(n)] for n in (1, 2, 3, 40))
    assert got[100] == [] and got[101] == [(label, 0, 3), (label, 4, 7)]
