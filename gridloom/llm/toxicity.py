"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of toxic texts that ordinary texts hardly
hold (whole words and their beginnings), one on words of ordinary texts.  Every word of a text,
between spaces, is a window; its compressed length under the ordinary dictionary less that under
the toxic one is its gain.  A text's counts and shares of windows whose gain reaches each
threshold are weighed by a logistic calibration, fitted on the same labelled sample.

The filter before training matters: dictionaries trained on raw toxic and ordinary texts, with
windows of several words, can't tell the classes apart where toxic texts are mostly ordinary
words (figures in the README).

The fit takes at most SAMPLE labelled ids (chosen by a hash); Spark counts the sample's windows
and makes its features, so that the driver gets the windows that pass the filter and one row of
numbers an id.  Scoring takes whole texts of all rows.

Defined cases: a null text counts as empty; an empty text, or one without letters, has no
windows and scores as the calibration gives for none; very long texts are taken whole; without
labelled rows of both classes every score is 0; labels repeated for an id count as toxic if one
is; rows repeated for an id are one row of the fit, and of several texts the one of least hash is
taken; rows with a null id are scored but never learned from (held_out is null for them); empty
tables give no rows; other columns pass, but for score and predicted, which are replaced.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, blocks, held_out, materialise, with_fields

#: Labelled ids that the fit takes at most.
SAMPLE = 6_000
#: Shares of toxic texts that toxic windows must be in, of which the fit chooses one, and of
#: ordinary texts that ordinary words must be in: at most 1 / share times a text's windows can be.
TOXIC_SHARES, ORDINARY_SHARE = (0.01, 0.02), 0.002
#: A toxic window is in ordinary texts less often than this share of its toxic frequency.
CONTRAST = 0.02
#: Bytes of the ordinary dictionary; the toxic one has TOXIC_TIMES those of its distinct windows.
ORDINARY_BYTES, TOXIC_TIMES = 65_536, 2
#: Lengths of word beginnings that may mark toxic texts, beside whole words.
BEGINNINGS = (4, 5, 6)
#: Follows each window and ends each dictionary: zstandard looks for no match in the last bytes.
CARRIER = bytes(range(0x80, 0xA0))
LEVEL = 19
#: Gains are clipped to this range; thresholds are its positive part.
LOW, HIGH = -2, 10
REMEMBERED = 150_000
WORDS = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


class _Gains(dict):
    """Word to its gain, as a byte from 0."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        import zstandard

        super().__init__()

        def compressor(content: bytes):
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False).compress

        self.toxic, self.ordinary = compressor(toxic), compressor(ordinary)

    def __missing__(self, word: bytes) -> bytes:
        window = b" " + word + b" " + CARRIER
        gain = len(self.ordinary(window)) - len(self.toxic(window))
        out = self[word] = bytes([min(HIGH, max(LOW, gain)) - LOW])
        return out

    def features(self, text: str | None) -> np.ndarray:
        """Counts and shares of windows at each threshold, and the number of windows."""
        words = WORDS.findall((text or "").encode().lower())
        gains = np.bincount(np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint8), minlength=HIGH - LOW + 1)
        if len(self) > REMEMBERED:
            self.clear()
        reached = gains[::-1].cumsum()[::-1][1 - LOW :]
        n = max(1, len(words))
        return np.concatenate([np.log1p(reached), np.log1p(100 * reached / n), np.minimum(reached, 1), [np.log(n)]])


class Model:
    """Dictionaries and calibration: a few kilobytes."""

    def __init__(self, toxic: bytes, ordinary: bytes, weights: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.toxic, self.ordinary, self.weights, self.mean, self.scale = toxic, ordinary, weights, mean, scale

    def scores(self, features: np.ndarray) -> np.ndarray:
        x = np.hstack([np.ones((len(features), 1)), (features - self.mean) / self.scale])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def _dictionary(windows: list[bytes], size: int, segment: int) -> bytes:
    """Content of a trained dictionary; the frequent windows themselves where there are too few to train on."""
    import zstandard

    samples = [b"".join(windows[i : i + 2]) for i in range(0, len(windows), 2)]
    try:
        # The head of entropy tables, some 300 bytes at most, is not content.
        content = zstandard.train_dictionary(size + 300, samples, k=segment, d=6).as_bytes()[-size:]
    except zstandard.ZstdError:
        content = b"".join(w for w, _ in reversed(Counter(windows).most_common()))[-size:]
    return content + CARRIER


def windows_of(text: str | None) -> set[bytes]:
    """The words of a text as windows, and their beginnings."""
    words = set(WORDS.findall((text or "").encode().lower()))
    return {b" " + w + b" " for w in words} | {b" " + w[:k] for w in words for k in BEGINNINGS if len(w) > k}


def _count_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label) to (window, toxic, ordinary): numbers of texts that hold a window, summed in each block."""
    for batch in blocks(batches, "text"):
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for s, label in zip(batch.column(0), batch.column(1).to_pylist()):
            counts[label].update(windows_of(s.as_py()))
        keys = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(pa.array([counts[k][w] for w in keys], pa.int64()) for k in (1, 0))], names=["window", "toxic", "ordinary"])


def _marks(kept: dict[bytes, int]) -> list[bytes]:
    """Toxic windows, each as often as toxic texts hold it."""
    # A beginning that one longer mark nearly accounts for says nothing new.
    order = sorted(kept)
    spent = set()
    for i, m in enumerate(order):
        for o in order[i + 1 :]:
            if not o.startswith(m):
                break
            if kept[o] >= 0.6 * kept[m]:
                spent.add(m)
                break
    return [m for m in order if m not in spent for _ in range(kept[m])]


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps on the penalised likelihood."""
    w = np.zeros(x.shape[1])
    penalty = np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def dictionaries(toxic: dict[bytes, int], ordinary: dict[bytes, int], leasts: Sequence[float]) -> list[tuple[bytes, bytes]]:
    """Trained on windows with the numbers of texts that hold them; one pair for each least number of toxic windows."""
    draw = random.Random(0)
    usual = [w for w, c in sorted(ordinary.items()) for _ in range(min(c, 50))]
    draw.shuffle(usual)
    known, out = _dictionary(usual, ORDINARY_BYTES, 32), []
    for least in leasts:
        marks = _marks({w: c for w, c in toxic.items() if c >= least})
        draw.shuffle(marks)
        out.append((_dictionary(marks, max(256, TOXIC_TIMES * sum(map(len, set(marks)))), 16), known))
    return out


def _features(pairs: list[tuple[bytes, bytes]]):
    """(text, label, part) to the features under each pair of dictionaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = [_Gains(*pair) for pair in pairs]
        for batch in blocks(batches, "text"):
            x = [np.concatenate([g.features(s.as_py()) for g in gains]) for s in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["x", "label", "part"])

    return run


def _trained(sample: DataFrame, shares: Sequence[float]) -> list[tuple[bytes, bytes]]:
    """Dictionaries of (text, label) rows, copies of a text counting once; none without both classes."""
    sample = sample.select("text", "label").distinct()
    size = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}  # two rows
    if len(size) < 2:
        return []
    counted = sample.mapInArrow(_count_windows, "window binary, toxic long, ordinary long").groupBy("window").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    leasts = [max(2.0, s * size[1]) for s in shares]
    often = F.col("toxic") >= min(leasts)
    apart = F.col("ordinary") / size[0] < CONTRAST * F.col("toxic") / size[1]
    usual = (F.col("ordinary") >= max(2.0, ORDINARY_SHARE * size[0])) & (F.substring("window", -1, 1) == F.lit(b" "))
    counted = counted.where((often & apart) | usual).select("window", F.when(often & apart, F.col("toxic")).alias("toxic"), F.when(usual, F.col("ordinary")).alias("ordinary"))
    found = counted.toArrow().to_pylist()
    return dictionaries(*({bytes(r["window"]): r[k] for r in found if r[k] is not None} for k in ("toxic", "ordinary")), leasts)


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = x.mean(0), x.std(0) + 1e-9
    return _logistic(np.hstack([np.ones((len(x), 1)), (x - mean) / scale]), y), mean, scale


def _numbers(sample: DataFrame, pairs: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and parts: SAMPLE rows of numbers."""
    made = sample.mapInArrow(_features(pairs), "x array<double>, label int, part int").toArrow()
    x, y, part = np.array(made["x"].to_pylist()), made["label"].to_numpy(), made["part"].to_numpy()
    order = np.lexsort((*x.T, part, y))  # sums do not depend on the order in which tasks end
    return x[order], y[order].astype(float), part[order]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """Fit on labelled rows that are not held out, SAMPLE of them at most; None without both classes.

    The least share of toxic windows is the one of TOXIC_SHARES that is best for a third of the
    sample when trained on the rest; then all of the sample is learned from.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(id_col).agg(F.least(F.max(F.col(label).cast("int")), F.lit(1)).alias("label"))
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE)
    # At most SAMPLE ids: a proven bound for the broadcast, and for the rows, as each id gives one.
    rows = docs.select(id_col, F.struct(F.xxhash64(text).alias("hash"), F.col(text).alias("text")).alias("found")).join(F.broadcast(chosen), id_col)
    one = rows.groupBy(id_col).agg(F.min("found").alias("found"), F.first("label").alias("label"))
    # Copies of a text are in one part.
    part = F.pmod(F.coalesce("found.hash", F.lit(0)), F.lit(3)).cast("int")
    # A few rows of whole texts, which several jobs read: dealt so that several tasks share them.
    sample = materialise(one.select(F.col("found.text").alias("text"), F.col("label"), part.alias("part")).repartition(16), "toxic-sample")
    share, tried = TOXIC_SHARES[0], _trained(sample.where("part > 0"), TOXIC_SHARES)
    if tried:
        x, y, at = _numbers(sample, tried)
        losses = []
        for own in np.split(x, len(tried), axis=1):
            weights, mean, scale = _calibrated(own[at > 0], y[at > 0])
            said, label = Model(b"", b"", weights, mean, scale).scores(own[at == 0]) >= 0.5, y[at == 0]
            # Wrong ones of each class alike; what has no rows says nothing.
            losses.append(sum(np.mean(said[label == k] != k) for k in (0, 1) if (label == k).any()))
        share = TOXIC_SHARES[int(np.argmin(losses))]
    pairs = _trained(sample, [share])
    if not pairs:
        return None
    x, y, _ = _numbers(sample, pairs)
    return Model(*pairs[0], *_calibrated(x, y))


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add score (0 to 1) and predicted (1 from 0.5)."""
    if model is None:
        return docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = _Gains(model.toxic, model.ordinary)
        for batch in blocks(batches, text):
            column = batch.column(batch.schema.get_field_index(text))
            x = np.array([gains.features(s.as_py()) for s in column])
            found = model.scores(x) if len(x) else np.array([])
            yield append(batch, {"score": pa.array(found, pa.float64()), "predicted": pa.array((found >= 0.5).astype(np.int32))})

    return docs.mapInArrow(run, with_fields(docs, [("score", T.DoubleType()), ("predicted", T.IntegerType())]))
