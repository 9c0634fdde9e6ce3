"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is lower-cased and cut into runs of letters; each run, marked at both ends,
gives its character n-grams, and each n-gram a bucket by crc32. The embeddings of
all n-grams of a text are averaged and a linear softmax gives the languages. The
model is trained by stochastic gradient descent in numpy, on whole texts and on
short fragments of them, so that short texts are met in training too.

Calibration: a fifth of the sample is kept apart; a temperature is fitted on it,
so that the score, the top probability, is near the share of right answers. A text
is rejected if it has no letter or its score is under ``REJECT_BELOW``: then it is
likelier wrong than right.

Scale: the model is fitted on a bounded sample: of each of the ``LANGUAGES`` commonest
languages the ``SAMPLE_PER_LANGUAGE`` labelled rows with the smallest hashes of id and
text, so that copies of one text are drawn no more than other rows; their n-gram
counts are made on the executors, one task learns from them, and the driver gets the
model alone. Prediction is one pass without a shuffle, ``PART`` characters of texts (or one
text) at once: the model is linear, so each of their different words has one vector of summed
logits. Texts of Latin-1 characters are cut into words as one array of bytes.

Cases: null texts and texts without a letter get ``und`` and score 0; with no
labelled row that has a letter all do; rows with a null language are not learned from but get a
prediction; repeated rows are predicted alike; an empty table gives no rows; other
columns are ignored. Rows with a null id count as in the training part (the crc32
of an empty text) when a split is asked for.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hyperstrata.llm.common import keep_rows, releasing

BUCKETS, WIDTH, SIZES = 1 << 15, 16, (1, 2, 3, 4)
LANGUAGES, SAMPLE_PER_LANGUAGE, EPOCHS, STEPS, RATE = 512, 1500, 4, 20_000, 0.5
REJECT_BELOW = 0.5
PART = 4_000_000
_RUNS = re.compile(r"[^\W\d_]+").findall


def word_buckets(word: str) -> list[int]:
    marked = f"<{word}>".encode("utf-8", "surrogatepass") if word.isascii() else None
    if marked is not None:  # bytes are characters
        return [zlib.crc32(marked[a : a + n]) % BUCKETS for n in SIZES for a in range(len(marked) - n + 1)]
    text = f"<{word}>"
    return [zlib.crc32(text[a : a + n].encode("utf-8", "surrogatepass")) % BUCKETS for n in SIZES for a in range(len(text) - n + 1)]


def text_words(text: str | None) -> list[str]:
    """Runs of letters; a run without a letter proper (superscripts) does not count."""
    return [w for w in _RUNS((text or "").lower()) if w.isascii() or any(map(str.isalpha, w))]


def _latin_table() -> bytes:
    """For bytes.translate: Latin-1 letters in lower case, other characters of words as NUL, the rest as spaces."""
    kept = [(c, chr(c).lower()) for c in range(256) if _RUNS(chr(c))]
    table = bytearray(b" " * 256)
    for c, low in kept:
        table[c] = ord(low) if low.isalpha() else 0
    return bytes(table)


_LATIN = _latin_table()


@dataclass
class Listed:
    """The words of some texts: the different ones, and the number of each in a row."""

    words: list[str]
    number: np.ndarray
    sizes: np.ndarray  # words of each text


def _latin_words(texts: list[bytes]) -> Listed:
    """Of texts that ``_LATIN`` has translated."""
    import pyarrow as pa

    data = np.frombuffer(b" ".join([b"", *texts, b""]), "u1")
    letter = data != 32
    edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    starts, stops = edges[::2], edges[1::2]
    before = np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in texts)]))
    offsets = np.concatenate([[0], np.cumsum(stops - starts)])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[letter])]).dictionary_encode()
    return Listed([w.decode("latin-1") for w in words.dictionary.to_pylist()], np.asarray(words.indices), np.diff(before))


def _other_words(texts: list[str]) -> Listed:
    number: dict[str, int] = {}
    each = [text_words(t) for t in texts]
    flat = np.fromiter((number.setdefault(w, len(number)) for words in each for w in words), "i8")
    return Listed(list(number), flat, np.fromiter(map(len, each), "i8", len(each)))


def listed(texts: list[str | None]) -> list[tuple[np.ndarray, Listed]]:
    """(places among the texts, words as ``text_words`` tells them) of those of Latin-1 letters and of the others."""
    latin, other = ([], []), ([], [])
    for k, text in enumerate(texts):
        try:
            data = (text or "").encode("latin-1").translate(_LATIN)
        except UnicodeEncodeError:
            data = b"\0"
        at, some = other if b"\0" in data else latin
        at.append(k)
        some.append(text if some is other[1] else data)
    return [(np.array(at, "i8"), f(some)) for (at, some), f in ((latin, _latin_words), (other, _other_words)) if at]


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype="u4")
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table.astype("u4")


_CRC = _crc_table()
_LEADS = ((0x80, 0, 0), (0x800, 6, 0xC0), (0x10000, 12, 0xE0), (0x110000, 18, 0xF0))  # of UTF-8: below, shift, mark


def _crc_more(state: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """The running crc32 after one more character in UTF-8 of each state."""
    wide = np.flatnonzero(chars >= 0x80)
    out = _CRC[(state ^ chars) & 255] ^ state >> 8
    if len(wide):
        code, own = chars[wide], state[wide]
        size = 1 + np.searchsorted([x[0] for x in _LEADS], code, "right")
        for n, (_, shift, mark) in enumerate(_LEADS[1:], 2):
            some = size == n
            if some.any():
                c, s = code[some], own[some]
                for k, byte in enumerate([c >> shift | mark, *(c >> low & 63 | 0x80 for low in range(shift - 6, -1, -6))]):
                    s = _CRC[(s ^ byte.astype("u4")) & 255] ^ s >> 8
                own[some] = s
        out[wide] = own
    return out


def buckets_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, starts): a column for each place of the marked words in a row, a row for each n of ``SIZES``
    with the bucket of the n-gram from there, ``BUCKETS`` where the word ends before; the words' first places.
    """
    chars = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter(map(len, words), "i8", len(words)) + 2
    stops = np.cumsum(sizes)
    left = np.repeat(stops, sizes) - np.arange(len(chars))
    out, state = np.full((len(SIZES), len(chars)), BUCKETS, "i8"), np.full(len(chars), 0xFFFFFFFF, "u4")
    for n in range(1, max(SIZES) + 1):
        state = _crc_more(state[: max(0, len(chars) - n + 1)], chars[n - 1 :])
        if n in SIZES:
            row, inside = out[SIZES.index(n)], np.flatnonzero(left >= n)
            row[inside] = (state[inside] ^ np.uint32(0xFFFFFFFF)) % BUCKETS
    return out, stops - sizes


def bags_of(found: Listed, fragments: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of the n-grams of some runs of words, each given by its first word and the one behind it."""
    table, starts = buckets_of(found.words)
    table = table.T
    stops = np.append(starts[1:], len(table))
    out = []
    for a, b in fragments:
        word, times = np.unique(found.number[a:b], return_counts=True)
        sizes = stops[word] - starts[word]
        ends = np.cumsum(sizes)
        places = np.arange(sizes.sum()) + np.repeat(starts[word] - ends + sizes, sizes)
        counts = np.bincount(table[places].ravel(), np.repeat(times, sizes * len(SIZES)), BUCKETS + 1)[:BUCKETS]
        at = np.flatnonzero(counts)
        out.append((at.astype("u2"), counts[at].astype("u4")))
    return out


def _shares(counts: np.ndarray) -> np.ndarray:
    return (counts / counts.sum()).astype("f4")


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # bucket x language: embeddings times the softmax weights
    bias: np.ndarray
    temperature: float = 1.0

    def scores(self, mean_logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the best language, calibrated probability) for each row."""
        z = (mean_logits + self.bias) / self.temperature
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        return p.argmax(1), p.max(1)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, languages: list[str], seed: int = 7) -> Model:
    """Stochastic gradient descent, one text at a time, with a falling rate."""
    rng = np.random.default_rng(seed)
    embeddings = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype("f4")
    weights, bias = np.zeros((WIDTH, len(languages)), "f4"), np.zeros(len(languages), "f4")
    epochs = max(EPOCHS, -(-STEPS // len(bags)))  # a small sample is seen more often
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            rate = np.float32(RATE * (1 - done / steps))
            at, share = bags[k][0], _shares(bags[k][1])
            rows = embeddings[at]
            mean = share @ rows
            z = mean @ weights + bias
            z -= z.max()
            grad = np.exp(z)
            grad /= grad.sum()
            grad[labels[k]] -= 1
            back = weights @ grad
            weights -= rate * np.outer(mean, grad)
            bias -= rate * grad
            # shares are small, so embeddings take a step scaled up to the size of a text
            embeddings[at] = rows - (rate * 20) * share[:, None] * back
            done += 1
    return Model(languages, embeddings @ weights, bias)


def calibrate(model: Model, bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """Fit the temperature by the likelihood of labels not trained on.

    The targets are softened as by a rule of succession, so that a sample without
    an error does not make every score 1.
    """
    if not bags or len(model.languages) < 2:
        return model
    soft = 1 / (len(bags) + 2)
    z = np.stack([_shares(counts) @ model.logits[at] for at, counts in bags]) + model.bias
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 20, 61):
        y = z / t
        y -= y.max(1, keepdims=True)
        right = (1 - soft) * y[np.arange(len(y)), labels] + soft * y.mean(1)
        loss = (np.log(np.exp(y).sum(1)) - right).mean()
        best = min(best, (float(loss), float(t)))
    model.temperature = best[1]
    return model


def sample_of(rows: DataFrame, counts: dict[str, int], id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """text, lang and draw: at most SAMPLE_PER_LANGUAGE rows of each language in ``counts``.

    A share of twice as many is drawn first, so that the texts of few rows are ranked.
    """
    unit = 1 << 30
    shares = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(unit, 2 * unit * SAMPLE_PER_LANGUAGE // n + unit // n)))])
    draw = F.xxhash64(id_col, text_col, lang_col)
    drawn = rows.where(F.pmod(draw, F.lit(unit)) < shares[F.col(lang_col)]).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), draw.alias("draw"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("draw", F.lit(unit)), "draw"))
    return drawn.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_PER_LANGUAGE).drop("rank")


def _untrained() -> Model:
    return Model([], np.zeros((BUCKETS, 0), "f4"), np.zeros(0, "f4"))


def fit(docs: DataFrame, learn_from: Column | None = None, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """A model of the rows that satisfy ``learn_from`` and have a text and a language."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if learn_from is not None:
        rows = rows.where(learn_from)
    commonest = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    counts = {r["lang"]: r["n"] for r in commonest.collect()}
    if not counts:
        return _untrained()
    languages = sorted(counts)
    sample = sample_of(rows, counts, id_col, text_col, lang_col)

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            kept, (langs, draws) = [], (batch.column(k).to_pylist() for k in (1, 2))
            for low, high in parts_of(batch.column(0)):
                for places, found in listed(batch.column(0)[low:high].to_pylist()):
                    ends, names, cuts = np.cumsum(found.sizes).tolist(), [], []
                    for k, end, n in zip((places + low).tolist(), ends, found.sizes.tolist()):
                        if n:  # the whole text, and one fragment of three to ten words of it
                            draw, first = draws[k], end - n
                            size = 3 + draw % 8
                            at = first + (draw >> 8) % max(1, n - size + 1)
                            names += [(langs[k], str(2 * draw)), (langs[k], str(2 * draw + 1))]
                            cuts += [(first, end), (at, min(end, at + size))]
                    kept += [(*name, *(x.tobytes() for x in own)) for name, own in zip(names, bags_of(found, cuts))]
            columns = list(zip(*kept)) or [(), (), (), ()]
            types = (pa.string(), pa.string(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["lang", "draw", "at", "counts"])

    def learn(batches):
        import pyarrow as pa

        got = sorted((row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(4)))), key=lambda r: (r[1], r[0]))
        if not got:
            return
        label = {lang: k for k, lang in enumerate(languages)}
        bags = [(np.frombuffer(r[2], "u2"), np.frombuffer(r[3], "u4")) for r in got]
        labels = np.array([label[r[0]] for r in got], "i8")
        apart = np.array([zlib.crc32(r[1].encode()) % 5 == 0 for r in got], bool)
        take = lambda mask: ([b for b, m in zip(bags, mask) if m], labels[mask])
        model = calibrate(train(*take(~apart), languages), *take(apart)) if (~apart).any() else train(bags, labels, languages)
        columns = ([model.logits.tobytes()], pa.binary()), ([model.bias.tobytes()], pa.binary()), ([model.temperature], pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(*c) for c in columns], names=["logits", "bias", "temperature"])

    bags = sample.mapInArrow(releasing(count), "lang string, draw string, at binary, counts binary")
    got = bags.repartition(1).mapInArrow(releasing(learn), "logits binary, bias binary, temperature double").collect()
    if not got:  # no labelled text has a letter
        return _untrained()
    (fitted,) = got
    return Model(languages, np.frombuffer(fitted["logits"], "f4").reshape(BUCKETS, -1), np.frombuffer(fitted["bias"], "f4"), fitted["temperature"])


def parts_of(texts) -> list[tuple[int, int]]:
    """Runs of an Arrow array of texts, of about ``PART`` bytes or one text each."""
    import pyarrow.compute as pc

    cuts = np.flatnonzero(np.diff(np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0)), dtype="i8") // PART)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)]))


def best_languages(model: Model, texts) -> tuple[np.ndarray, np.ndarray]:
    """Of an Arrow array of texts: the index of the best language, -1 for none, and its calibrated probability."""
    best, score = np.full(len(texts), -1), np.zeros(len(texts))
    columns = [np.append(column, 0).astype("f8") for column in model.logits.T]  # no n-gram counts as BUCKETS
    for low, high in parts_of(texts) if model.languages else []:
        for places, found in listed(texts[low:high].to_pylist()):
            some = np.flatnonzero(found.sizes)
            if not len(some):
                continue
            first = (np.cumsum(found.sizes) - found.sizes)[some]
            table, starts = buckets_of(found.words)
            total = lambda places, of=starts, number=found.number, first=first: np.add.reduceat(np.take(np.add.reduceat(places, of), number), first)
            n = total((table < BUCKETS).sum(0))
            means = np.stack([total(np.take(column, table).sum(0)) for column in columns], 1) / n[:, None]
            best[low + places[some]], score[low + places[some]] = model.scores(means)
    return best, score


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score and rejected of each row."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        names = pa.array([*model.languages, "und"])
        for batch in batches:
            best, score = best_languages(model, batch.column(1))
            pred = names.take(pa.array(np.where(best < 0, len(names) - 1, best)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pred, pa.array(score), pc.or_(pa.array(score < REJECT_BELOW), pc.equal(pred, "und"))], names=[id_col, "lang_pred", "score", "rejected"])

    return docs.select(id_col, text_col).mapInArrow(releasing(run), f"{id_col} {kind}, lang_pred string, score double, rejected boolean")


def recognised(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that are not rejected, with all their columns."""

    return keep_rows(docs, text_col, lambda texts: best_languages(model, texts)[1] >= REJECT_BELOW)
