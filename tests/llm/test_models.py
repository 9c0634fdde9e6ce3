import math
import os
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tests.llm.helpers import ODD, docs

from hyperstrata.llm import attention, language_id, lm_scoring, queries
from hyperstrata.llm.encoding import encoder

WORDS = public_tokenizers.path("word_bpe_49k.json")


def labelled(n=160):
    rng = np.random.default_rng(3)
    syllables = {"en": "the and ing ion her ent".split(), "de": "sch der ung ich ein ü".split(), "fr": "eau que ment é les aux".split()}
    rows = []
    for k in range(n):
        lang = list(syllables)[k % 3]
        rows.append((k, " ".join("".join(rng.choice(syllables[lang], 2)) for _ in range(rng.integers(3, 40))), lang if k % 11 else None))
    return rows


def test_language_id_held_out_accuracy(spark, sf):
    got = {r["doc_id"]: r for r in queries.op1_language_id(spark, sf).collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [d for d in got if got[d]["held_out"]]
    assert {d for d in got if zlib.crc32(str(d).encode()) % 3 == 1} == set(held)
    assert np.mean([got[d]["lang_pred"] == truth[d] for d in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_id_odd_rows_and_unknown_text(spark):
    model = language_id.fit(docs(spark, labelled()))
    got = language_id.predict(docs(spark, [*ODD, (50, "日本語の文章です これは")]), model).collect()
    assert len(got) == len(ODD) + 1
    none = [r for r in got if r["doc_id"] in (1, 2, 3, 7)]
    assert all(r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"] for r in none)
    assert all(r["lang_pred"] in model.languages for r in got if r["doc_id"] in (4, 5, 6, 50))
    table = docs(spark, [*labelled(), (500, None), (501, "42")])
    kept = language_id.recognised(table, model)
    assert kept.columns == table.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert not ids & {500, 501} and len(ids) >= 155


def test_language_id_without_labels_or_rows(spark):
    none = language_id.fit(docs(spark, [(1, "text", None)]))
    assert [(r["lang_pred"], r["score"]) for r in language_id.predict(docs(spark, [(1, "text")]), none).collect()] == [("und", 0.0)]
    assert language_id.predict(docs(spark, []), none).count() == 0
    one = language_id.fit(docs(spark, [(k, f"nur eine sprache {k}", "de") for k in range(9)]))
    assert {r["lang_pred"] for r in language_id.predict(docs(spark, [(1, "text")]), one).collect()} == {"de"}


def test_language_id_is_learned_in_a_task(spark, monkeypatch):
    """The driver gets the model alone, neither the sample nor the learning; labelled texts may all lack letters."""
    driver, train = os.getpid(), language_id.train

    def elsewhere(*args):
        assert os.getpid() != driver
        return train(*args)

    monkeypatch.setattr(language_id, "train", elsewhere)
    model = language_id.fit(docs(spark, labelled()))
    assert model.languages == ["de", "en", "fr"] and model.logits.shape == (language_id.BUCKETS, 3)
    none = language_id.fit(docs(spark, [(1, "12 34", "en"), (2, "", "de")]))
    assert [(r["lang_pred"], r["score"]) for r in language_id.predict(docs(spark, [(1, "text")]), none).collect()] == [("und", 0.0)]


def test_language_id_takes_many_texts_at_once(monkeypatch):
    """All words and n-grams of a part's texts are found as arrays, as one by one; those of Latin-1 texts without a loop over them."""
    import random

    import pyarrow as pa

    words, buckets, rng = language_id.text_words, language_id.word_buckets, random.Random(4)
    latin = list("abAB '\n\t  ,!019éÉß×÷ñªºµÿ_-\xa0\x85")
    some = lambda letters: ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(300)]
    plain = [None, "", "   ", "é", "ÀÖØÞ", "a\x00b", *some(latin)]
    texts = [*plain, "²", "m²", "½", "Σας ΟΔΟΣ İ", "日本語 x", *(t for _, t in ODD), *some([*latin, *"²³¼ĄąİΣς日本🙂"])]
    model = language_id.Model(["a", "b", "c"], np.random.default_rng(1).normal(0, 0.5, (language_id.BUCKETS, 3)).astype("f4"), np.zeros(3, "f4"))
    for part in (4_000_000, 50):
        monkeypatch.setattr(language_id, "PART", part)
        best, score = language_id.best_languages(model, pa.array(texts))
        seen = 0
        for low, high in language_id.parts_of(pa.array(texts)):
            for places, found in language_id.listed(texts[low:high]):
                stops = np.cumsum(found.sizes).tolist()
                cuts = list(zip([0, *stops], stops))
                for k, (a, b), (at, counts) in zip(places + low, cuts, language_id.bags_of(found, cuts)):
                    assert [found.words[n] for n in found.number[a:b]] == words(texts[k])
                    assert dict(zip(at.tolist(), counts.tolist())) == Counter(x for w in words(texts[k]) for x in buckets(w))
                    seen += 1
        assert seen == len(texts)
        for text, b, s in zip(texts, best, score):
            each = [x for w in words(text) for x in buckets(w)]
            if each:
                want, p = model.scores(model.logits[each].mean(0, dtype="f8")[None])
                assert b == want[0] and abs(s - p[0]) < 1e-12
            else:
                assert (b, s) == (-1, 0)
    never = lambda *_: 1 / 0
    monkeypatch.setattr(language_id, "text_words", never)
    monkeypatch.setattr(language_id, "word_buckets", never)
    assert (language_id.best_languages(model, pa.array(plain))[0] == best[: len(plain)]).all()


def in_a_row(texts):
    """(ids, begins, sizes) of some id sequences."""
    sizes = np.array([len(t) for t in texts], "i8")
    return np.concatenate([np.zeros(0, "i8"), *texts]), np.cumsum(sizes) - sizes, sizes


def test_attention_gradient_against_differences():
    rng = np.random.default_rng(0)
    vocab = attention.vocabulary(rng.integers(0, 50, 6000))
    ids = rng.integers(0, 6000, (3, attention.WINDOW + 1))
    rows, targets = vocab.row[ids[:, :-1]], vocab.cls[ids[:, 1:]]
    weight = np.arange(attention.WINDOW) < np.array([[attention.WINDOW], [7], [20]])
    flat = attention.start(vocab) + rng.normal(0, 0.05, attention.SIZE).astype("f4")
    loss = lambda f: attention.step(f.copy(), np.zeros(attention.SIZE, "f4"), rows, targets, weight, 0.0)
    memory, moved = np.zeros(attention.SIZE, "f4"), flat.copy()
    attention.step(moved, memory, rows, targets, weight, 1.0)
    size = np.sqrt(memory)  # the first step keeps the squared gradient
    for name, view in attention.parts(np.arange(attention.SIZE)).items():
        for j in rng.permutation(view.ravel()[: 20_000])[:200]:
            if size[j] < 2e-2:
                continue
            up, down = flat.copy(), flat.copy()
            up[j] += 5e-3
            down[j] -= 5e-3
            slope = (loss(up) - loss(down)) / 1e-2
            assert abs(abs(slope) - size[j]) < 0.2 * size[j] + 3e-3, name
            assert slope * (moved[j] - flat[j]) < 0, name


def test_attention_scores_each_id_once_and_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    n = 300
    vocab = attention.vocabulary(rng.integers(0, 90, n))
    flat = attention.start(vocab) + rng.normal(0, 0.1, attention.SIZE).astype("f4")
    p = attention.parts(flat)

    def plain(text):
        """One id after another, each in the window that scores it."""
        total = 0.0
        for t in range(1, len(text)):
            k = max(0, -(-(t - attention.WINDOW) // attention.STRIDE))
            window = np.zeros(attention.WINDOW, "i8")
            have = text[attention.STRIDE * k : t]
            window[: len(have)] = have
            h = attention._forward(p, vocab.row[window][None])["h"][len(have) - 1]
            group, member = divmod(int(vocab.cls[text[t]]), attention.MEMBERS)
            z = attention._logits(p, h[None], np.array([group]))[1][0].astype("f8")
            first, second = z[: attention.GROUPS], z[attention.GROUPS :]
            total += first[group] - np.log(np.exp(first).sum()) + second[member] - np.log(np.exp(second).sum()) + vocab.log_share[text[t]]
        return total

    texts = [rng.integers(0, n, m) for m in (1, 2, 3, 31, 32, 33, 34, 56, 57, 58, 81, 200)]
    got = attention.log_probabilities(flat, vocab, *in_a_row(texts))
    assert np.allclose(got, [plain(t) for t in texts], atol=2e-3)
    start = rng.integers(0, n, 40)
    each = attention.log_probabilities(flat, vocab, *in_a_row([np.append(start, k) for k in range(n)]))
    before = attention.log_probabilities(flat, vocab, *in_a_row([start]))[0]
    assert abs(np.exp(each - before).sum() - 1) < 1e-3
    assert len(attention.log_probabilities(flat, vocab, *in_a_row([]))) == 0


def test_training_lowers_the_loss():
    rng = np.random.default_rng(2)
    pattern = np.tile(np.arange(10), 10)
    windows = [pattern[k % 10 : k % 10 + attention.WINDOW + 1] for k in range(256)]
    vocab = attention.vocabulary(np.bincount(np.concatenate(windows), minlength=50))
    start = attention.start(vocab)
    trained = attention.train(start, vocab, *in_a_row(windows), 12, 0.05, 1)
    held = in_a_row([np.tile(np.arange(10), 6)])
    assert attention.log_probabilities(trained, vocab, *held)[0] > attention.log_probabilities(start, vocab, *held)[0] + 20


def plain_base(rows, train):
    split = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    import re

    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", split(t)), None]
    counts = Counter(w for d, t in rows if train(d) for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for d, t in rows:
        own = tokens(t)
        score = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own)
        out.append((d, len(own), sum(counts[w] > 0 for w in own), total, round(score, 6)))
    return out


def test_lm_base_scores_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "WORDS", 9)  # so that there are many segments
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(rng.choice(["A", "b", "The", "cat,", "é", "zebra", f"w{k}"], rng.integers(0, 30)))) for k in range(60)] + [r for r in ODD if r[0] not in (5, 6)] + [(6, "long " * 3000)]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    from hyperstrata.llm.common import doc_crc

    got = lm_scoring.score(docs(spark, rows), WORDS, learn_from=F.pmod(doc_crc(F.col("doc_id")), F.lit(7)) != 2).collect()
    mine = Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)
    assert mine == Counter(plain_base(rows, lambda d: not held(d)))
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_word_ids_are_text_ids():
    get, enc = lm_scoring.word_encoder(WORDS), encoder(WORDS)
    for _, text in ODD:
        assert b"".join(map(get, lm_scoring.words(text))) == enc.encode_bytes(text)


def test_words_met_once_are_not_kept():
    get, enc, exact = lm_scoring.word_encoder(WORDS), encoder(WORDS), encoder(WORDS).tokenizer
    kept, rng = enc._get.__self__, np.random.default_rng(12)
    words = ["".join(rng.choice(list(letters), rng.integers(1, 30))) for letters in ("abcxyz", "abcÀé", "ab'st.", "aB", "a1-中", "ſKİa") for _ in range(50)]
    for word in words:
        assert get(word.encode()) == np.array(exact.encode(word, add_special_tokens=False).ids, "<u4").tobytes(), word
    get(b"onlyhereandnowhereelse")
    assert "onlyhereandnowhereelse" not in kept


def test_words_are_encoded_ahead_together(monkeypatch):
    """A group's words are encoded side by side, those of small and other ASCII characters without a call of the library's model for each."""
    from hyperstrata.llm.encoding import Encoder

    exact, rng = encoder(WORDS).tokenizer, np.random.default_rng(13)
    plain = {"".join(rng.choice(list("abcst'.,0-"), rng.integers(1, 30))).encode() for _ in range(300)}
    other = {"".join(rng.choice(list("abÀé\x00\x1c\x7f中ſİ"), rng.integers(1, 30))).encode() for _ in range(100)}
    every = [*plain, *other, b"x" * 100]
    fresh = Encoder(WORDS)
    with fresh.ahead(every):
        for word in every:
            assert fresh.encode_word(word) == np.array(exact.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes(), word
    assert not fresh._known
    want = list(map(Encoder(WORDS).encode_word, plain))
    monkeypatch.setattr(Encoder, "_unit", lambda *_: 1 / 0)
    fresh = Encoder(WORDS)
    with fresh.ahead(list(plain)):
        assert list(map(fresh.encode_word, plain)) == want


def test_lm_with_nothing_to_learn_from_and_of_nothing(spark):
    got = lm_scoring.score(docs(spark, [(1, "a b"), (2, None)]), WORDS, learn_from=F.lit(False)).collect()
    assert {(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got} == {(1, 3, 0, 0), (2, 1, 0, 0)}
    assert all(r["base_score"] == 0 for r in got)
    assert lm_scoring.score(docs(spark, []), WORDS).count() == 0


def test_windows_cover_every_id_once():
    size = attention.WINDOW + 1
    for m in (1, 2, 3, 32, 33, 34, 65, 66, 200):
        owner, number, first = attention.windows(np.array([0, m]), np.array([m, 5]), attention.WINDOW)
        mine = [(f, min(size, m - attention.WINDOW * n)) for o, n, f in zip(owner, number, first) if o == 0]
        assert [t for f, real in mine for t in range(f + 1, f + real)] == list(range(1, m))
        assert list(first[owner == 1]) == [m]


def test_segments_hold_every_id_of_every_text(spark, monkeypatch):
    """Sequences made from segments are the whole texts, and the trainers are told every id of them."""
    rows, enc = [*ODD, (8, "some words of a text " * 400)], encoder(WORDS)
    end = enc.tokenizer.get_vocab_size()
    monkeypatch.setattr(lm_scoring, "TOKENS", 300)  # so that there are many segments
    cut = lm_scoring.segments(docs(spark, rows), F.col("doc_id") != 7, WORDS, end)
    found, learned = Counter(), 0
    for r in cut.collect():
        stream, begins, sizes = lm_scoring.sequences(bytes(r["places"]), bytes(r["id_sizes"]), bytes(r["ids"]))
        found.update((k, stream[b : b + n].tobytes()) for k, b, n in zip(r["keys"], begins, sizes))
        assert stream[0] == end
    close = np.uint32(end).tobytes()
    assert found == Counter((k, close + enc.encode_bytes(t) + close) for k, t in rows)
    vocab = attention.vocabulary(np.ones(end + 1, "i8"))
    start = attention.start(vocab)
    got = lm_scoring.trained(cut, start, vocab).groupBy("at").agg(F.sum("n").alias("n"), F.sum("weighted").alias("w")).collect()
    assert {r["n"] for r in got} == {sum(len(enc.encode(t)) + 1 for k, t in rows if k not in (None, 7))}
    assert len(got) == attention.SIZE and any(abs(r["w"] / r["n"] - start[r["at"]]) > 1e-3 for r in got)


def test_lm_encodes_each_word_of_the_corpus_once(spark, monkeypatch, tmp_path):
    """However many segments list a word, one look-up tells all of them its count and ids."""
    rng, log, real = np.random.default_rng(8), str(tmp_path / "encoded"), lm_scoring.word_encoder

    def noting(path):
        get = real(path)

        def one(word):
            with open(log, "ab") as f:
                f.write(word + b"\n")
            return get(word)

        return one

    monkeypatch.setattr(lm_scoring, "word_encoder", noting)
    monkeypatch.setattr(lm_scoring, "TOKENS", 40)  # so that there are many segments
    monkeypatch.setattr(lm_scoring, "LISTED", 60, raising=False)  # and many groups of words
    rows = [(k, " ".join(rng.choice(["The", "cat,", "é", "\x1cx", "zebra's", *(f"w{k % 7}{j}" for j in range(9))], rng.integers(0, 20)))) for k in range(80)]
    end = encoder(WORDS).tokenizer.get_vocab_size()
    table = lm_scoring.segments(docs(spark, rows).repartition(4), F.col("doc_id") % 3 != 0, WORDS, end)
    cut = table.collect()
    all_words = {w for _, t in rows for w in lm_scoring.words(t)}
    with open(log, "rb") as f:
        assert sorted(f.read().split(b"\n")[:-1]) == sorted(all_words)
    counts, texts, get = Counter(w for k, t in rows if k % 3 for w in lm_scoring.words(t)), dict(rows), real(WORDS)
    assert len(cut) > 8 and sum(r["distinct"] for r in cut) == len(counts)
    assert (sum(r["inside"] for r in cut), sum(r["documents"] for r in cut)) == (counts.total(), sum(k % 3 > 0 for k, _ in rows))
    for r in cut:
        own = Counter(w for k in r["keys"] if k % 3 for w in lm_scoring.words(texts[k]))
        whole = [w for k in r["keys"] for w in [*lm_scoring.words(texts[k]), None]]
        places, found, n = lm_scoring._numbers(r["places"]), lm_scoring._numbers(r["found"], "<i8"), lm_scoring._numbers(r["n"], "<i8")
        sizes, ids = lm_scoring._numbers(r["id_sizes"]), lm_scoring._numbers(r["ids"])
        assert len(places) == len(whole) and len(set(places)) == len(sizes) == len(found) + 1
        for w, at in zip(whole, places):
            stop = int(sizes[: at + 1].sum())
            mine = ids[stop - int(sizes[at]) : stop].tobytes()
            assert (at == 0 and list(np.frombuffer(mine, "u4")) == [end]) if w is None else (found[at - 1], n[at - 1], mine) == (counts[w], own[w], get(w))


    every = lm_scoring.warm_windows(table, 1.0).collect()
    windows = Counter()
    for k, t in rows:
        ids = np.concatenate([[end], *(np.frombuffer(get(w), "u4") for w in lm_scoring.words(t)), [end]]).astype("u4")
        windows.update(ids[at : at + attention.WINDOW + 1].tobytes() for at in range(0, len(ids) - 1, attention.WINDOW) if k % 3)
    assert Counter(bytes(r["ids"])[: 4 * r["n"]] for r in every) == windows
    vocab = attention.vocabulary(np.ones(end + 1, "i8"))
    assert lm_scoring.trained(table, attention.start(vocab), vocab).count() <= 4 * attention.SIZE  # a model of each task that cut texts


def test_lm_of_texts_without_words_and_of_giant_ones(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "PART", 50)  # so that few bytes close a segment
    end = encoder(WORDS).tokenizer.get_vocab_size()
    none = lm_scoring.segments(docs(spark, [(1, None), (2, " \n")]).coalesce(1), None, WORDS, end).collect()
    assert [(list(lm_scoring._numbers(r["places"])), r["documents"], r["inside"], r["distinct"]) for r in none] == [([0, 0], 2, 0, 0)]
    rows = [(k, "x" * 500 + f"{k % 3} y") for k in range(9)]
    cut = lm_scoring.segments(docs(spark, rows).coalesce(1), None, WORDS, end)
    got = [(len(r["keys"]), r["inside"], r["distinct"]) for r in cut.collect()]
    assert len(got) > 3 and sum(x[0] for x in got) == 9 and sum(x[1] for x in got) == 18 and sum(x[2] for x in got) == 4


def test_lm_tables_are_written_by_workers(spark, monkeypatch):
    """Spark's writer, which starts processes beside an executor's JVM for each file, writes no table of the scoring; the result is in few parts."""
    from pyspark.sql import DataFrameWriter

    never = lambda *_, **__: 1 / 0
    monkeypatch.setattr(DataFrameWriter, "parquet", never)
    monkeypatch.setattr(DataFrameWriter, "save", never)
    monkeypatch.setattr(lm_scoring, "TOKENS", 300)  # so that there are many segments
    rows = [*ODD, *((k, f"some words of text {k} " * 40) for k in range(10, 50))]
    table = docs(spark, rows).repartition(16)
    got = lm_scoring.score(table, WORDS)
    assert got.rdd.getNumPartitions() < 16
    mine = Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got.collect())
    assert mine == Counter(plain_base(rows, lambda d: True))


def test_lm_returns_heap_before_its_result_is_written(spark):
    """The JVMs' whole heaps are collected behind the last stage of the scoring, so that they return what is not in use."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    collections = lambda: sum(b.getCollectionCount() for b in beans() if "Young" not in b.getName() and "Concurrent" not in b.getName())
    before = collections()
    got = lm_scoring.score(docs(spark, [(1, "a b"), (2, None)]), WORDS)
    assert collections() > before
    assert {(r["doc_id"], r["n_tokens"]) for r in got.collect()} == {(1, 3), (2, 1)}


def test_kept_tables_replace_what_other_attempts_left(spark, tmp_path):
    from hyperstrata.llm.common import kept, reading, row_places

    folder = f"file:{tmp_path}/a folder"
    os.mkdir(f"{tmp_path}/a folder")
    for name in ("part-00000.parquet", "part-00001.parquet.0123.part"):
        with open(f"{tmp_path}/a folder/{name}", "wb") as f:
            f.write(b"half a file")

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                yield batch.slice(k, 1)

    table = kept(spark.range(9).repartition(3), run, "id long", folder)
    assert sorted(r["id"] for r in table.collect()) == list(range(9))
    assert sorted(r["id"] for r in row_places(table).mapInArrow(reading(run, ["id"]), "id long").collect()) == list(range(9))
    assert kept(spark.range(0), run, "id long", f"{folder}/none").count() == 0


def test_texts_are_split_as_words_are():
    import pyarrow as pa

    texts = [*(t for _, t in ODD), " a\x0bB\x1cc\x85d\xa0e \r\n", "\x0c", "ÀÉ İ\tK"]
    for some in (pa.array(texts), pa.array(texts)[3:], pa.array([], "string"), pa.array([None, ""], "string")):
        flat, sizes = lm_scoring.split_texts(some)
        each = [lm_scoring.words(t) for t in some.to_pylist()]
        assert list(sizes) == [len(x) for x in each]
        assert [w.encode() for w in flat.to_pylist()] == [w for x in each for w in x]


def test_lm_beats_its_unigrams_on_held_out_texts(spark, sf):
    """The attention model uses what it sees: it beats the smoothed counts of subword ids."""
    from hyperstrata.llm.common import doc_crc

    table = spark.read.parquet(f"{sf}/documents.parquet")
    learn = F.pmod(doc_crc(F.col("doc_id")), F.lit(7)) != 2
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(table, WORDS, learn_from=learn).collect()}
    enc, rows = encoder(WORDS), table.collect()
    end = enc.tokenizer.get_vocab_size()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2]
    counts = np.ones(end + 1)
    for r in rows:
        if r not in held:
            np.add.at(counts, np.append(enc.encode(r["text"]), end), 1)
    logs = np.log10(counts / counts.sum())
    unigrams = sum(logs[np.append(enc.encode(r["text"]), end)].sum() for r in held)
    assert sum(got[r["doc_id"]] for r in held) > unigrams
