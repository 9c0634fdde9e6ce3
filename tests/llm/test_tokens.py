import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tests.llm.helpers import ODD, docs
from tokenizers import Tokenizer

from hyperstrata.llm import encoding, packing, token_files
from hyperstrata.llm.encoding import Encoder

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda text: np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("name", FILES)
def test_pieces_encode_like_whole_texts(name):
    exact, mine = library(name), Encoder(public_tokenizers.path(name), cache_entries=50)
    letters = list("abAB '\n\t  .,!?0123éÉß×÷ñ  \x1c\x85<|>$́İΣςx日🙂") + ["'s", "'ll", "<|endoftext|>", "  ", " the", "ing "]
    rng = random.Random(3)
    for text in [t or "" for _, t in ODD[:-2]] + ["".join(rng.choices(letters, k=rng.randint(0, 25))) for _ in range(4000)]:
        assert mine.encode_bytes(text) == exact(text), repr(text)


def default_library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("name", FILES)
def test_many_texts_encode_side_by_side(name, monkeypatch):
    """Like the library, whatever the parts; units of Latin-1 texts without a call of the library's model for each."""
    exact, mine = default_library(name), Encoder(public_tokenizers.path(name), special=True)
    simple = list("abABstmdrevl'' \n  .,!?012éÉßñ$") + ["'s", "'ll", "'re", "'ve", "'m", "  ", " the", "ing ", "interest", "aaaa"]
    other = simple + list("\t\x1c\x85<|>×日ſİ🙂") + ["<|endoftext|>"]
    rng = random.Random(5)
    some = lambda letters, n: ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(n)]
    plain = [None, "", " ", "\n", "'", "'s", "''", "a", *some(simple, 2000)]
    texts = [*plain, *(t for _, t in ODD[:-2]), "x" * 70, "é" * 40 + " y" + "z" * 100 + "'s", *some(other, 2000)]
    for part in (2_000_000, 300):
        monkeypatch.setattr(encoding, "PART", part)
        for text, ids in zip(texts, mine.encode_all(iter(texts)), strict=True):
            assert ids == exact(text or ""), repr(text)
    monkeypatch.setattr(Encoder, "_unit", lambda *_: 1 / 0)
    fresh = Encoder(public_tokenizers.path(name), special=True)
    assert list(fresh.encode_all(plain)) == list(mine.encode_all(plain))


MARKED = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>  x", "é <|startoftext|>日<|endoftext|>\n\n a", "<|ENDOFTEXT|> <|endoftext|", "a  <|endoftext|>  b"]


@pytest.mark.parametrize("name", FILES)
def test_special_tokens_in_texts_get_their_ids(name):
    exact, mine = default_library(name), Encoder(public_tokenizers.path(name), special=True)
    letters = list("abAB '\n\t  .,01é\x1c<|>日") + ["'s", "<|endoftext|>", "<|endoftext|>", "<|startoftext|>", "  ", " the"]
    rng = random.Random(8)
    for text in [*MARKED, *[t or "" for _, t in ODD[:-2]], *["".join(rng.choices(letters, k=rng.randint(0, 25))) for _ in range(3000)]]:
        assert mine.encode_bytes(text) == exact(text), repr(text)


def test_files_and_pieces_hold_the_ids_of_special_tokens(spark, tmp_path):
    rows = list(enumerate([*MARKED, "none"]))
    exact = default_library(FILES[1])
    got = packing.token_pieces(docs(spark, rows), public_tokenizers.path(FILES[1]), max_len=64, end_id=0).collect()
    assert sorted((r["doc_id"], bytes(r["ids"])) for r in got) == [(d, exact(t) + bytes(4)) for d, t in rows]
    exact, folder = default_library(FILES[0]), str(tmp_path / "tokens")
    token_files.write_token_files(docs(spark, rows), folder, public_tokenizers.path(FILES[0]), end_id=2, shards=2)
    got = token_files.read_token_files(spark, folder).collect()
    assert sorted((r["doc_id"], bytes(r["ids"])) for r in got) == [(d, exact(t) + (2).to_bytes(4, "little")) for d, t in rows]


def test_cut_puts_the_short_piece_first():
    assert packing.cut(5, 2) == [(0, 1), (1, 2), (3, 2)]
    assert packing.cut(4, 2) == [(0, 2), (2, 2)]
    assert packing.cut(1, 2) == [(0, 1)]


def one_by_one(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        room = [r for r in bins if r >= n]
        if room:
            bins.remove(min(room))
            bins.append(min(room) - n)
        else:
            bins.append(capacity - n)
    return len(bins)


def test_plan_equals_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(200):
        capacity = rng.randint(1, 30)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 80))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        plan, sequences = packing.best_fit_plan(histogram, capacity)
        assert sequences == one_by_one(lengths, capacity)
        used = {}
        for n in histogram:
            ranks = sorted(r for length, rank, count, _, _ in plan if length == n for r in range(rank, rank + count))
            assert ranks == list(range(histogram[n]))
        for length, _, count, first, offset in plan:
            for s in range(first, first + count):
                used.setdefault(s, []).append((offset, length))
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity


def test_packing_covers_every_id_once(spark):
    rows = ODD + [(100 + k, "the same words") for k in range(50)] + [(200 + k, "x " * k) for k in range(40)]
    path, exact = public_tokenizers.path(FILES[1]), library(FILES[1])
    pieces = packing.token_pieces(docs(spark, rows), path, max_len=64, end_id=0)
    packed = packing.pack(pieces, 64)
    got = packed.collect()
    texts = [np.frombuffer(exact(t or "") + bytes(4), "<u4") for _, t in rows]
    assert sum(r["length"] for r in got) == sum(map(len, texts))
    lengths = [r["length"] for r in got]
    assert len({r["sequence_id"] for r in got}) == one_by_one(lengths, 64)
    wanted = sorted((rows[k][0] or -1, p, a, n, t[a : a + n].tobytes()) for k, t in enumerate(texts) for p, (a, n) in enumerate(packing.cut(len(t), 64)))
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in got) == wanted
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], bytes(r["ids"])))
    joined = {r["sequence_id"]: bytes(r["input_ids"]) for r in packing.packed_sequences(packed).collect()}
    for s, parts in by_sequence.items():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert joined[s] == b"".join(ids for _, _, ids in sorted(parts))
    digests = packing.token_pieces(docs(spark, rows), path, max_len=64, end_id=0, payload="crc32").collect()
    assert sorted(r["ids_crc32"] for r in digests) == sorted(zlib.crc32(bytes(r["ids"])) for r in got)


def test_packing_of_nothing(spark):
    assert packing.pack(packing.token_pieces(docs(spark, []), public_tokenizers.path(FILES[1])), 2048).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    rows = ODD + [(1000 - k, f"document number {k} " * (k % 7)) for k in range(120)]
    path, exact = public_tokenizers.path(FILES[0]), library(FILES[0])
    folder = str(tmp_path / "tokens")
    manifest = token_files.write_token_files(docs(spark, rows), folder, path, end_id=2, shards=3)
    got = token_files.read_token_files(spark, folder).collect()
    end = (2).to_bytes(4, "little")
    wanted = sorted(((d if d is not None else -1), exact(t or "") + end) for d, t in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, bytes(r["ids"])) for r in got) == wanted
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"])
        at += r["n_tokens"]
    keys = [r["doc_id"] if r["doc_id"] is not None else -1 for r in sorted(got, key=lambda r: r["start"])]
    assert keys == sorted(keys) and manifest["n_tokens"] == at
    assert [x.tobytes() for x in token_files.read_document(folder, 4)] == [exact("one") + end] * 2
    assert token_files.read_document(folder, 999_999) == []


def test_token_files_encode_texts_together(spark, tmp_path, monkeypatch):
    """Texts go to the encoder as they come, many at once, and none by itself."""
    from types import SimpleNamespace

    real, rows = token_files.encoder, [(k, f"document number {k} " * (k % 5)) for k in range(40)]

    def together(path, **more):
        enc = real(path, **more)
        return SimpleNamespace(tokenizer=enc.tokenizer, encode_all=enc.encode_all)

    monkeypatch.setattr(token_files, "encoder", together)
    path, exact, folder = public_tokenizers.path(FILES[0]), library(FILES[0]), str(tmp_path / "tokens")
    token_files.write_token_files(docs(spark, rows), folder, path, end_id=2, shards=2)
    got = {r["doc_id"]: bytes(r["ids"]) for r in token_files.read_token_files(spark, folder).collect()}
    assert got == {k: exact(t) + (2).to_bytes(4, "little") for k, t in rows}


def test_token_files_of_nothing_and_of_another_dictionary(spark, tmp_path):
    path = public_tokenizers.path(FILES[0])
    empty = str(tmp_path / "empty")
    token_files.write_token_files(docs(spark, []), empty, path, end_id=2)
    assert token_files.read_token_files(spark, empty).count() == 0
    folder = str(tmp_path / "tokens")
    manifest = token_files.write_token_files(docs(spark, [(k, f"word{k} again") for k in range(30)]), folder, path, end_id=2, shards=1)
    with open(folder + "/dictionary.zdict", "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError, match="another dictionary"):
        token_files.Shard(folder, manifest["shards"][0]["name"], manifest["dictionary_sha256"])
    assert json.loads(open(folder + "/manifest.json").read()) == manifest
