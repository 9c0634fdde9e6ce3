import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from tests.llm.helpers import ODD, components
from tests.llm.test_dedup import plain_fingerprint, plain_line_dedup
from tests.llm.test_models import labelled
from tests.llm.test_search import plain_tiles
from tests.llm.test_tokens import library, one_by_one

from hyperstrata.llm import decontamination, language_id, packing, queries
from hyperstrata.llm.common import give_back


def fixture(spark, folder):
    rng = np.random.default_rng(12)
    rows = labelled(120)
    item = " ".join(f"t{chr(97 + k)}st" for k in range(26))
    rows += [(500 + k, rows[3 * k][1] + " the the and", "en") for k in range(8)]
    rows += [(600 + k, rows[k][1], "de") for k in range(6)]
    rows += [(700, "the and ing her " * 20 + "\n" + item + "\nthe ent", "en"), (701, "the ing her and " * 9 + item + " and the", "en")]
    rows += [(800 + k, f"own words {' '.join(rng.choice(['the', 'and', 'her', 'ing'], 12))}\nthis line is in all of these texts number {k}", "en") for k in range(5)]
    rows += [(900, None, "en"), (901, "", "en"), (902, "12 34", None), (903, "the and " * 2500, "en")]
    full = [(d, t, lang, "s", None if t is None else len(t)) for d, t, lang in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    items = [(1, item), (2, "nothing holds these five words at all")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def test_pipeline_against_brute_force(spark, tmp_path):
    rows, items = fixture(spark, str(tmp_path))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model = language_id.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    kept = []
    for d, t, _ in rows:
        words = language_id.text_words(t)
        if words:
            buckets = [b for w in words for b in language_id.word_buckets(w)]
            if model.scores(model.logits[buckets].mean(0, dtype="f8")[None])[1][0] >= language_id.REJECT_BELOW:
                kept.append((d, t))
    assert 900 not in {d for d, _ in kept} and len(kept) > 130
    kept = [(d, t) for d, t, _, _ in plain_line_dedup(kept)]
    fps = [plain_fingerprint(t) for _, t in kept]
    roots = components(len(kept), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    kept = [min((kept[k] for k, r in enumerate(roots) if r == root), key=lambda x: x[0]) for root in set(roots)]
    clean = []
    for d, t in kept:
        found, bad = decontamination.words(t), False
        for _, text in items:
            item = decontamination.words(text)
            bad |= sum(n for _, _, n in plain_tiles(item, found, 5)) >= decontamination.THRESHOLD * len(item) if len(found) < 500 else False
        if not bad:
            clean.append((d, t))
    exact = library("byte_bpe_50k.json")
    want = []
    for d, t in clean:
        ids = exact(t) + bytes(4)
        want += [(d, p, a, n, zlib.crc32(ids[4 * a : 4 * (a + n)])) for p, (a, n) in enumerate(packing.cut(len(ids) // 4, 2048))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    assert len({r["sequence_id"] for r in got}) == one_by_one([r["length"] for r in got], 2048)
    ids = {r["doc_id"] for r in got}
    assert not ids & {700, 701} and 903 in ids


def test_stages_keep_the_columns_and_stand_odd_rows(spark, tmp_path):
    fixture(spark, str(tmp_path))
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            assert name == corpus_pipeline.STAGES[-1][0] or out.columns == table.columns
            out.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]


def test_each_stage_begins_by_giving_freed_memory_back(spark, tmp_path, monkeypatch):
    fixture(spark, str(tmp_path))
    docs, given = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    assert give_back(spark)
    monkeypatch.setattr(corpus_pipeline, "give_back", given.append)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs.limit(0), str(tmp_path))
        assert given == [spark] * (k + 1)


def test_queries_are_registered():
    names = queries.queries()
    assert [k for k in range(1, 11) if sum(n.startswith(f"op{k}_") for n in names) != 1] == []
    assert set(queries.oracle_sql()) <= set(names) and corpus_pipeline.ORACLE_SQL is None
    assert public_tokenizers.path("byte_bpe_50k.json")
