"""Language-model scores of whole texts: a causal self-attention model on subword ids.

What is learned, all from the rows that satisfy ``learn_from``:

* counts of all words (the word model, ``base_score``);
* counts of all subword ids, made from the word counts (classes, shares and biases
  of the attention model);
* the attention model's weights: first on at most ``WARM`` windows on the driver,
  then on windows that cover every training text whole. Each task trains on all
  texts of its partition, one pass without a restart, one segment after another in
  random order; the weights of the tasks are averaged on the executors.

Segments: texts are cut into words once. Each task writes runs of consecutive
documents as segments, rows of one table: the segment's own word list (at most
``WORDS`` words, or those of one document) with counts, and the documents as numbers
into that list. The lists meet in groups by the words' crc32; there each word of the
corpus is counted and encoded once, and what returns is, for each listed word, its
count and its subword ids, to which the segment's documents are read from its file.
All later work is on numbers.

Scale: texts and documents are not shuffled. Lists go to groups in blocks, one for each segment and
group that share words; a word stands at most once in a segment, so no group is hot,
and the number of groups grows with the lists. The driver gets one number per subword
id, one per weight, and the warm-up windows.

Cases: a null or empty text holds the end alone; a null id counts as the empty text
in the split; repeated rows are scored each by itself; with nothing to learn from,
counts are 0 and the model is untrained; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import functools
import math
import zlib
from bisect import bisect_left

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperstrata.llm import attention
from hyperstrata.llm.common import LOWER_ASCII, filesystem, give_back_heap, kept, new_folder, part_of, reading, row_places
from hyperstrata.llm.encoding import encoder

WORDS, TOKENS = 150_000, 800_000  # of a segment's list and of its documents
LISTED = 500_000  # listed words that meet in a group, on average
PART = 8_000_000  # bytes of text split at once
ROWS = 1 << 33  # row groups of a file at most
WARM, WARM_EPOCHS, WARM_RATE, RATE = 4096, 3, 0.05, 0.02


def words(text: str | None) -> list[bytes]:
    """The words of a text; ``split_texts`` tells those of many."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER_ASCII).split()


def word_encoder(tokenizer_path: str):
    """word -> bytes of its subword ids, not kept: each word of the corpus is asked for once.

    The tokenizer drops white space and lower-cases, so the ids of the words, one
    after another, are those of the text.
    """
    enc = encoder(tokenizer_path)
    if enc.byte_level:
        raise ValueError("words need a tokenizer that drops white space")
    return enc.encode_word


def split_texts(texts):
    """(words of all texts one after another, number of words of each) of an Arrow array."""
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat, sizes = lists.flatten(), np.asarray(pc.list_value_length(lists)).astype("i8")
    empty = np.asarray(pc.equal(flat, "").cast("uint8")).astype(bool)
    if empty.any():  # texts that are empty, begin or end with white space
        sizes -= np.bincount(np.repeat(np.arange(len(sizes)), sizes)[empty], minlength=len(sizes))
        flat = flat.filter(pc.not_equal(flat, ""))
    return flat, sizes


@functools.cache
def _zstd() -> tuple:
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _zip(values) -> bytes:
    return _zstd()[0].compress(values)


def _unzip(packed: bytes) -> bytes:
    return _zstd()[1].decompress(packed)


def _numbers(packed: bytes, kind: str = "<u4") -> np.ndarray:
    return np.frombuffer(_unzip(packed), kind)


def _binary(sizes: np.ndarray, data: bytes):
    """Byte strings that stand one after another, as an Arrow array."""
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum(sizes, dtype="i8")])
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), starts[1], ..."""
    stops = np.cumsum(sizes)
    return np.arange(stops[-1] if len(stops) else 0) + np.repeat(starts - stops + sizes, sizes)


def _lists(docs: DataFrame, learn: Column, id_col: str, text_col: str, folder: str) -> DataFrame:
    """The segments before their words are encoded: ``segment`` (the task's number and, in ``ROWS``, that of the row group
    of its file), ``task``, keys, train flags, ``places`` (see ``segments``), ``words`` (in the order of their crc32) with ``word_sizes`` and training counts ``n``, and totals.
    """
    kind = dict(docs.dtypes)[id_col]

    def cut(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        keys, train, sizes, held = [], np.zeros(0, bool), np.zeros(0, "i8"), []
        task, made = TaskContext.get().partitionId(), 0

        def row():
            """The first documents held, as a segment."""
            nonlocal keys, train, sizes, held, made
            whole = pa.concat_arrays(held)
            ends = np.cumsum(sizes)
            most = min(len(sizes), 1 + int(np.searchsorted(ends + np.arange(1, len(ends) + 1), TOKENS)))
            coded = whole[: ends[most - 1]].dictionary_encode()
            number = np.asarray(coded.indices)
            seen = np.concatenate([[0], np.maximum.accumulate(number) + 1])[ends[:most]]  # words listed by the end of each document
            n = min(most, 1 + int(np.searchsorted(seen, WORDS)))
            stop, list_ = ends[n - 1], coded.dictionary[: seen[n - 1]].cast(pa.large_binary())
            hashes = np.fromiter(map(zlib.crc32, list_.to_pylist()), "u4", len(list_))
            order = np.argsort(hashes, kind="stable")
            rank = np.empty(len(order), "u4")
            rank[order] = np.arange(1, len(order) + 1)
            number = np.take(rank, number[:stop])
            places = np.zeros(stop + n, "<u4")
            places[np.arange(stop) + np.repeat(np.arange(n), sizes[:n])] = number
            counts = np.bincount(number[np.repeat(train[:n], sizes[:n])], minlength=len(order) + 1)[1:].astype("<i8")
            list_ = list_.take(pa.array(order))
            starts = np.frombuffer(list_.buffers()[1], "i8")[list_.offset : list_.offset + len(list_) + 1] if len(list_) else np.zeros(1, "i8")
            data = list_.buffers()[2][starts[0] : starts[-1]] if len(list_) else b""
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], "int32"), a)
            binary = lambda x: pa.array([_zip(x)], pa.binary())
            long = lambda x: pa.array([x], "int64")
            out = pa.RecordBatch.from_arrays(
                [long(task * ROWS + made), pa.array([task], "int32"), one(pa.array(keys[:n], key_type)), one(pa.array(train[:n])), binary(places.tobytes()), binary(np.diff(starts).astype("<u4").tobytes()), binary(data), binary(counts.tobytes()), long(len(list_)), long(int(train[:n].sum())), long(int(counts.sum()))],
                names=["segment", "task", "keys", "train", "places", "word_sizes", "words", "n", "listed", "documents", "inside"],
            )
            keys, train, sizes, held, made = keys[n:], train[n:], sizes[n:], [whole[stop:]], made + 1
            return out

        for batch in batches:
            key_type, lengths = batch.schema.field(0).type, pc.binary_length(batch.column(1)).fill_null(0)
            parts = np.flatnonzero(np.diff(np.cumsum(np.asarray(lengths), dtype="i8") // PART)) + 1
            for low, high in zip([0, *parts], [*parts, len(batch)]):
                some = batch.slice(low, high - low)
                flat, more = split_texts(some.column(1))
                keys += some.column(0).to_pylist()
                train = np.append(train, np.array(some.column(2).to_pylist(), bool))
                sizes = np.append(sizes, more)
                held.append(flat)
                while keys and (sizes.sum() + len(sizes) >= TOKENS or sum(x.nbytes for x in held) >= 8 * PART):
                    yield row()
        while keys:
            yield row()

    out = f"segment long, task int, keys array<{kind}>, train array<boolean>, places binary, word_sizes binary, words binary, n binary, listed long, documents long, inside long"
    return kept(docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), learn.alias("learn")), cut, out, folder)


def _looked_up(lists: DataFrame, tokenizer_path: str) -> DataFrame:
    """For each segment and group of words, in the order of the list: ``found``, their counts in all training

    texts (int64), and their subword ids; ``distinct``, how many of those with a count are listed in no earlier segment.
    """
    total = lists.agg(F.sum("listed")).first()[0] or 0
    groups = max(1, -(-total // LISTED))

    def blocks(batches):
        import pyarrow as pa

        for batch in batches:
            for segment, word_sizes, packed, n in zip(*(batch.column(k).to_pylist() for k in range(4))):
                sizes, data, n = _numbers(word_sizes), _unzip(packed), _numbers(n, "<i8")
                at = np.concatenate([[0], np.cumsum(sizes, dtype="i8")]).tolist()
                crc = lambda k: zlib.crc32(data[at[k] : at[k + 1]])
                bounds = [*(bisect_left(range(len(sizes)), -(-(g << 32) // groups), key=crc) for g in range(groups)), len(sizes)]
                group = [g for g in range(groups) if bounds[g] < bounds[g + 1]]
                cuts = [(bounds[g], bounds[g + 1]) for g in group]
                binary = lambda x: pa.array(map(_zip, x), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group, "int64"), pa.array([segment] * len(cuts), "int64"), binary(sizes[a:b].tobytes() for a, b in cuts), binary(data[at[a] : at[b]] for a, b in cuts), binary(n[a:b].tobytes() for a, b in cuts)],
                    names=["group", "segment", "word_sizes", "words", "n"],
                )

    def look_up(met):
        import pyarrow as pa

        met = met.sort_by("segment")  # so that a task run again tells the same
        column = lambda name: met.column(name).to_pylist()
        each = [_numbers(x) for x in column("word_sizes")]
        coded = _binary(np.concatenate(each), b"".join(map(_unzip, column("words")))).dictionary_encode()
        number = np.asarray(coded.indices)
        count = np.bincount(number, np.concatenate([_numbers(x, "<i8") for x in column("n")])).astype("<i8")
        words = coded.dictionary.to_pylist()
        with encoder(tokenizer_path).ahead(words):
            ids = list(map(word_encoder(tokenizer_path), words))
        sizes = np.fromiter((len(x) // 4 for x in ids), "<u4", len(ids))
        flat, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes, dtype="i8") - sizes
        known = np.concatenate([[0], np.cumsum(count > 0)])
        cuts = np.cumsum([0, *map(len, each)])
        # words are numbered in the order of their first places
        new = known[np.concatenate([[0], np.maximum.accumulate(number) + 1])[cuts]]
        own = [number[a:b] for a, b in zip(cuts, cuts[1:])]
        binary = lambda x: pa.array(map(_zip, x), pa.binary())
        return pa.table(
            {
                "group": met.column("group"),
                "segment": met.column("segment"),
                "found": binary(count[x].tobytes() for x in own),
                "distinct": pa.array(np.diff(new), "int64"),
                "id_sizes": binary(sizes[x].tobytes() for x in own),
                "ids": binary(np.take(flat, _spans(starts[x], sizes[x].astype("i8"))).tobytes() for x in own),
            }
        )

    met = row_places(lists).mapInArrow(reading(blocks, ["segment", "word_sizes", "words", "n"]), "group long, segment long, word_sizes binary, words binary, n binary")
    return met.groupBy("group").applyInArrow(look_up, "group long, segment long, found binary, distinct long, id_sizes binary, ids binary")


def segments(docs: DataFrame, learn_from: Column | None, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """keys and train flags of a segment's documents; ``places``, the numbers (uint32) of all words,

    0 after each document; ``n`` and ``found``, the counts of words 1, 2, ... in the segment's and in all training
    texts (int64); ``id_sizes`` and ``ids`` (uint32), the subword ids of words 0, 1, 2, ...; all compressed;
    ``documents`` and ``inside``, its training documents and their words; ``distinct`` sums to that of all words;
    ``task``, the one that cut it.
    """
    learn = F.lit(True) if learn_from is None else F.coalesce(learn_from, F.lit(False))
    kind = dict(docs.dtypes)[id_col]
    folder = new_folder(docs.sparkSession, "lists")
    lists = _lists(docs, learn, id_col, text_col, folder)

    def joined(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        fs, root = filesystem(folder)
        one, end = np.uint32(1).astype("<u4").tobytes(), int(end_id).to_bytes(4, "little")

        def row(segment, blocks):
            with fs.open_input_file(part_of(root, segment // ROWS)) as f:
                own = pq.ParquetFile(f).read_row_group(segment % ROWS, ["task", "keys", "train", "places", "n", "documents", "inside"])
            found, id_sizes, ids, distinct = zip(*blocks)
            whole = lambda each, first: pa.array([_zip(b"".join([first, *map(_unzip, each)]))], pa.binary())
            more = {"found": whole(found, b""), "id_sizes": whole(id_sizes, one), "ids": whole(ids, end), "distinct": pa.array([sum(distinct)], "int64")}
            return pa.RecordBatch.from_pydict({name: own.column(name).combine_chunks() for name in own.column_names} | more)

        last, blocks = None, []
        for batch in batches:
            for segment, *block in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5))):
                if segment != last and blocks:
                    yield row(last, blocks)
                    blocks = []
                last = segment
                blocks.append(block)
        if blocks:
            yield row(last, blocks)

    out = f"task int, keys array<{kind}>, train array<boolean>, places binary, n binary, documents long, inside long, found binary, id_sizes binary, ids binary, distinct long"
    none = F.lit(_zip(b""))  # so that a segment without words is there too
    every = lists.select("segment", F.lit(-1).cast("long").alias("group"), none.alias("found"), none.alias("id_sizes"), none.alias("ids"), F.lit(0).cast("long").alias("distinct"))
    looked = _looked_up(lists, tokenizer_path).select(every.columns)
    return kept(every.union(looked).repartition("segment").sortWithinPartitions("segment", "group"), joined, out, new_folder(docs.sparkSession, "segments"))


def subword_counts(cut: DataFrame, documents: int, size: int, end_id: int) -> np.ndarray:
    """Counts of all subword ids in the training texts, from the word lists' counts."""

    def count(batches):
        import pyarrow as pa

        total = np.zeros(size, "i8")
        for batch in batches:
            for n, sizes, ids in zip(*(batch.column(k) for k in range(3))):
                n = np.concatenate([[0], _numbers(n.as_py(), "<i8")])
                total += np.bincount(_numbers(ids.as_py()), np.repeat(n, _numbers(sizes.as_py())), size).astype("i8")
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, "int32"), pa.array(total[at])], names=["id", "n"])

    out = np.zeros(size, "i8")
    for r in row_places(cut).mapInArrow(reading(count, ["n", "id_sizes", "ids"]), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    out[end_id] = documents
    return out


def _layout(places: bytes, id_sizes: bytes) -> tuple:
    """(starts, stops, begins, sizes): where each word's ids start in the list and stop in the stream of a segment

    that follows its first end, and the sequences of its documents in the stream that has it.
    """
    numbers, sizes = _numbers(places), _numbers(id_sizes).astype("i8")
    stops = np.cumsum(np.take(sizes, numbers))
    ends = stops[numbers == 0]  # places of the ends in the stream
    begins = np.concatenate([[0], ends[:-1]])
    return np.take(np.cumsum(sizes) - sizes, numbers), stops, begins, ends - begins + 1


def sequences(places: bytes, id_sizes: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, begins, sizes) of a segment's documents as sequences of subword ids.

    Each starts with the end id of the document before it and closes with its own.
    """
    starts, stops, begins, sizes = _layout(places, id_sizes)
    flat = _numbers(ids)
    stream = np.take(flat, _spans(starts, np.diff(stops, prepend=0)))
    return np.concatenate([flat[:1], stream]), begins, sizes  # all begins with an end


def _trained_sequences(batch):
    """The sequences of the training documents of each segment in a batch."""
    for train, places, id_sizes, ids in zip(*(batch.column(k) for k in range(4))):
        mask = np.array(train.as_py(), bool)
        if mask.any():
            stream, begins, sizes = sequences(places.as_py(), id_sizes.as_py(), ids.as_py())
            yield stream, begins[mask], sizes[mask]


_TRAINING = ["train", "places", "id_sizes", "ids"]


def warm_windows(cut: DataFrame, share: float) -> DataFrame:
    """draw, n and ids (WINDOW + 1 uint32, n of them real) of a share of all training windows."""

    def pick(batches):
        import pyarrow as pa

        for batch in batches:
            for train, places, id_sizes, ids in zip(*(batch.column(k) for k in range(4))):
                mask = np.array(train.as_py(), bool)
                starts, stops, begins, sizes = _layout(places.as_py(), id_sizes.as_py())
                begins, sizes, flat = begins[mask], sizes[mask], _numbers(ids.as_py())
                owner, number, first = attention.windows(begins, sizes, attention.WINDOW)
                draw = np.random.default_rng(zlib.crc32(flat, zlib.crc32(stops))).integers(0, 1 << 40, len(first))
                some = np.flatnonzero(draw < share * (1 << 40))
                # places in the stream after the first end; those before and behind it are not real or an end
                at = first[some, None] + np.arange(attention.WINDOW + 1) - 1
                word = np.searchsorted(stops, np.clip(at, 0, stops[-1] - 1), side="right")
                back = np.take(stops, word) - at  # from the word's stop
                got = np.take(flat, np.take(starts, word) + np.take(np.diff(stops, prepend=0), word) - back, mode="clip")
                got = np.where(at < 0, flat[0], got).astype("<u4")
                real = np.minimum(attention.WINDOW + 1, sizes[owner[some]] - attention.WINDOW * number[some])
                yield pa.RecordBatch.from_arrays([pa.array(draw[some]), pa.array(real, "int32"), pa.array([x.tobytes() for x in got], pa.binary())], names=["draw", "n", "ids"])

    return row_places(cut).mapInArrow(reading(pick, _TRAINING), "draw long, n int, ids binary")


def trained(cut: DataFrame, flat: np.ndarray, vocab: attention.Vocabulary) -> DataFrame:
    """at, weighted and n: of each task, its weights times the n ids that it was trained to tell.

    There are no more tasks than those that cut the texts, so that none learns from less.
    """
    sent = cut.sparkSession.sparkContext.broadcast((flat, vocab))
    tasks = cut.agg(F.countDistinct("task")).first()[0]

    def trainer(batches):
        import pyarrow as pa

        own, vocab = sent.value
        memory, n = attention.fresh_memory(), 0
        for batch in batches:
            for stream, begins, sizes in _trained_sequences(batch):
                own = attention.train(own, vocab, stream, begins, sizes, 1, RATE, seed=n, memory=memory)
                n += int(sizes.sum()) - len(sizes)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(attention.SIZE), "int32"), pa.array(own.astype("f8") * n), pa.array(np.full(attention.SIZE, n), "int64")], names=["at", "weighted", "n"])

    return row_places(cut).coalesce(max(1, tasks)).mapInArrow(reading(trainer, _TRAINING), "at int, weighted double, n long")


def fit(cut: DataFrame, documents: int, end_id: int) -> tuple[np.ndarray, attention.Vocabulary]:
    """(weights, vocabulary) of a model of all training documents of the segments."""
    per_id = subword_counts(cut, documents, end_id + 1, end_id)
    vocab = attention.vocabulary(per_id)
    flat = attention.start(vocab)
    if not documents:
        return flat, vocab
    share = min(1.0, 1.2 * WARM * attention.WINDOW / per_id.sum())
    warm = warm_windows(cut, share).orderBy("draw", "ids").limit(WARM).collect()
    sizes = np.array([r["n"] for r in warm], "i8")
    ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in warm])
    begins = np.arange(len(warm)) * (attention.WINDOW + 1)
    flat = attention.train(flat, vocab, ids, begins, sizes, WARM_EPOCHS, WARM_RATE, seed=1)
    averaged = trained(cut, flat, vocab).groupBy("at").agg((F.sum("weighted") / F.sum("n")).alias("value")).collect()  # one row per weight
    flat = flat.copy()
    for r in averaged:
        flat[r["at"]] = r["value"]
    return flat, vocab


def score(docs: DataFrame, tokenizer_path: str, learn_from: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score and n_subwords of each row."""
    kind = dict(docs.dtypes)[id_col]
    end_id = encoder(tokenizer_path).tokenizer.get_vocab_size()
    cut = segments(docs, learn_from, tokenizer_path, end_id, id_col, text_col)
    seen = cut.agg(*(F.sum(name).alias(name) for name in ("documents", "inside", "distinct"))).first()
    documents = seen["documents"] or 0
    total = (seen["inside"] or 0) + documents
    distinct = (seen["distinct"] or 0) + (documents > 0)
    below = math.log10(total + 1 * (distinct + 1))
    sent = docs.sparkSession.sparkContext.broadcast(fit(cut, documents, end_id))

    def run(batches):
        import pyarrow as pa

        flat, vocab = sent.value
        for batch in batches:
            for keys, places, found, id_sizes, ids in zip(*(batch.column(k) for k in range(5))):
                found = np.concatenate([[documents], _numbers(found.as_py(), "<i8")])
                word = _numbers(places.as_py())
                ends = np.flatnonzero(word == 0)
                firsts = np.concatenate([[0], ends[:-1] + 1])
                stream, begins, sizes = sequences(places.as_py(), id_sizes.as_py(), ids.as_py())
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.values,
                        pa.array(ends - firsts + 1, "int64"),
                        pa.array(np.add.reduceat(np.take((found > 0).astype("i8"), word), firsts)),
                        pa.array(np.add.reduceat(np.take(np.log10(found + 1.0) - below, word), firsts)),
                        pa.array(attention.log_probabilities(flat, vocab, stream, begins, sizes) / math.log(10)),
                        pa.array(sizes - 1, "int64"),
                    ],
                    names=[id_col, "n_tokens", "n_known", "base_score", "score", "n_subwords"],
                )

    out = f"{id_col} {kind}, n_tokens long, n_known long, base_score double, score double, n_subwords long"
    # kept, so that few tasks are left to write the result: Spark starts processes for each file (see ``kept``)
    scored = kept(row_places(cut), reading(run, ["keys", "places", "found", "id_sizes", "ids"]), out, new_folder(docs.sparkSession, "scores"))
    give_back_heap(docs.sparkSession)  # before those processes start
    return scored.select(id_col, "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "n_subwords")
