"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text.
Each window of a document (a word between fixed pads) is compressed with both;
a window speaks for toxicity by the bytes that the toxic dictionary saves over
the ordinary one. Thresholds on the saving, and the weights that turn a
document's windows into a score, are calibrated on labelled rows that did not
train the dictionaries.

Defined results: a null text counts as empty; an empty text, or one without
words, scores as a document without any window that speaks for toxicity; a
null ``doc_id`` has remainder 0 and is scored like any other; repeated rows get
equal scores, one row each; columns besides the id and the text are ignored.
Very long words are cut into overlapping windows.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import hash_sample, map_arrow

#: Training reads at most this many documents of each label, those with the
#: least hash of their id, and the different words of their whole texts.
SAMPLE_DOCS = 3000
#: Bytes of the part of a dictionary that both share and of the part of its own.
SHARED_BYTES, OWN_BYTES = 6144, 3072
#: Windows hold at most so many characters of a word, and overlap by half.
WINDOW = 48
#: Fixed bytes round a window: the compressor finds no matches near the end of
#: its input and stores very small inputs as they are.
HEAD, TAIL = bytes(range(1, 17)), bytes(range(200, 216))
#: Most words whose savings a worker remembers.
REMEMBERED = 400_000
REJECT_AT = 0.7
EDGE = " .,!?;:\"()|'*#$%&- "
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def windows(word: str) -> list[str]:
    if len(word) <= WINDOW:
        return [word]
    return [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def words(text: str) -> list[str]:
    return [w for w in (x.strip(EDGE) for x in SPACE.split(text.lower())) if w]


def _grams(word: str) -> set[str]:
    w = f"^{word[:WINDOW]}$"
    return {w[i : i + n] for n in (4, 5, 6) for i in range(len(w) - n + 1)}


def _packed(ranked: list[str], size: int) -> bytes:
    """The first of ``ranked`` that fit, the foremost last: zstandard codes near matches in fewer bits."""
    out, used = [], 0
    for w in ranked:
        piece = b" " + w.encode()
        if used + len(piece) > size:
            break
        out.append(piece)
        used += len(piece)
    return b"".join(reversed(out)) + b" "


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k not in ("by_toxic", "by_ordinary", "known")}

    def _compressor(self, content: bytes) -> zstd.ZstdCompressor:
        params = zstd.ZstdCompressionParameters(
            format=zstd.FORMAT_ZSTD1_MAGICLESS, strategy=zstd.STRATEGY_GREEDY, min_match=4, window_log=17, hash_log=15,
            chain_log=16, search_log=8, target_length=64, write_checksum=0, write_content_size=0, write_dict_id=0,
        )
        return zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=params)

    def start(self) -> Model:
        self.by_toxic, self.by_ordinary, self.known = self._compressor(self.toxic), self._compressor(self.ordinary), {}
        return self

    def saving(self, word: str) -> tuple[int, float]:
        """Bytes that the toxic dictionary saves on a word, and those as a share of it: the best of its windows."""
        got = self.known.get(word)
        if got is None:
            got = (-99, -9.0)
            for w in windows(word):
                x = HEAD + b" " + (raw := w.encode("utf-8", "replace")) + b" " + TAIL
                saved = len(self.by_ordinary.compress(x)) - len(self.by_toxic.compress(x))
                got = max(got, (saved, saved / (len(raw) + 2)))
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = got
        return got

    def features(self, text: str) -> list[float]:
        found = [self.saving(w) for w in set(words(text))]
        strong = sorted((s * r for s, r in found if s >= 3 and r > 0), reverse=True)[:3] + [0.0] * 3
        return [
            *strong[:3],
            math.log1p(sum(s >= 4 and r >= 0.35 for s, r in found)),
            math.log1p(sum(s >= 4 and r >= 0.5 for s, r in found)),
            math.log1p(len(found)),
        ]

    def score(self, text: str) -> float:
        z = float(np.append((np.array(self.features(text)) - self.centre) / self.scale, 1.0) @ self.weights)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train(toxic: list[str], ordinary: list[str]) -> Model:
    """Dictionaries from two of three documents, thresholds and weights from the rest."""
    if not toxic or not ordinary:
        # nothing to compare with: all documents score low
        return Model(HEAD, HEAD, np.array([0.0] * 6 + [-5.0]), np.zeros(6), np.ones(6))
    fit = [[t for i, t in enumerate(texts) if len(texts) < 3 or i % 3] for texts in (toxic, ordinary)]
    tune = [[t for i, t in enumerate(texts) if len(texts) < 3 or i % 3 == 0] for texts in (toxic, ordinary)]
    df = [Counter(), Counter()]
    for c, texts in zip(df, fit, strict=True):
        for t in texts:
            c.update({w[:WINDOW] for w in words(t)})
    grams = [Counter(), Counter()]
    for c, by_word in zip(grams, df, strict=True):
        for w, n in by_word.items():
            for g in _grams(w):
                c[g] += n
    n_toxic, n_ordinary = len(fit[0]), len(fit[1])
    odds = {g: math.log((n + 0.1) / (n_toxic + 1)) - math.log((grams[1][g] + 0.5) / (n_ordinary + 1)) for g, n in grams[0].items() if n >= max(3, n_toxic // 150)}
    telling = {g for g, v in odds.items() if v > 3.5}
    marked = Counter({w: n for w, n in df[0].items() if not telling.isdisjoint(_grams(w)) and (n + 0.1) / (n_toxic + 1) > 4 * df[1][w] / (n_ordinary + 1)})
    plain = [w for w, _ in sorted(df[1].items(), key=lambda x: (-x[1], x[0])) if w not in marked]
    shared = _packed(plain, SHARED_BYTES)
    ranked = [w for w, _ in sorted(marked.items(), key=lambda x: (-x[1], x[0]))]
    own = _packed(ranked, OWN_BYTES)
    rest = plain[shared.count(b" ") - 1 :]
    model = Model(own + shared + HEAD + TAIL, _packed(rest, OWN_BYTES) + shared + HEAD + TAIL, np.zeros(7), np.zeros(6), np.ones(6))
    for _ in range(3):
        # the ordinary dictionary's own part takes on what the toxic one saves on in ordinary documents
        model.start()
        hard = {w: n * s for w in plain if (n := df[1][w]) and (s := model.saving(w)[0]) >= 3}
        if not hard:
            break
        rest = list(dict.fromkeys([*sorted(hard, key=lambda w: (-hard[w], w)), *rest]))
        model.ordinary = _packed(rest, OWN_BYTES) + shared + HEAD + TAIL
    model.start()
    x = np.array([model.features(t) for texts in tune for t in texts])
    y = np.array([1.0] * len(tune[0]) + [0.0] * len(tune[1]))
    model.centre, model.scale = x.mean(0), x.std(0) + 1e-6
    model.weights = _logistic(np.c_[(x - model.centre) / model.scale, np.ones(len(x))], y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on a bounded sample of the labelled rows outside the held-out fold.

    The sample is chosen among the labels, which are narrow, and its ids (at
    most twice ``SAMPLE_DOCS``) are broadcast to the scan of the texts. Of rows
    that repeat a label's id the first by text is read.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    chosen = None
    for toxic in (1, 0):
        part = hash_sample(known.where(F.col("toxic") == toxic).distinct(), SAMPLE_DOCS, "doc_id")
        chosen = part if chosen is None else chosen.unionAll(part)
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))

    def said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # training asks only which words a text has; the driver gets each once
        at = columns.index("text")
        for b in batches:
            found = pa.array([" ".join(sorted(set(words(x.as_py() or "")))) for x in b.column(at)], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), found)

    columns = texts.columns
    by = {0: [], 1: []}
    for r in sorted(map_arrow(texts, said, texts.schema).collect(), key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id)):
        by[r.toxic].append(r.text or "")
    return train(by[1], by[0])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` as (doc_id, text, score): every whole text, in the scan's own tasks, without a shuffle."""
    packed = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(packed).start()
        for b in batches:
            got = pa.array([m.score(x.as_py() or "") for x in b.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, got], [*b.schema.names, "score"])

    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(df, run, "doc_id long, text string, score double")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""
    return score(docs, fit(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= REJECT_AT).cast("int").alias("predicted")
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, that are not rejected."""
    model = pickle.dumps(fit(docs, labels))
    columns, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(model).start()
        at = columns.index("text")
        for b in batches:
            yield b.filter(pa.array([m.score(x.as_py() or "") < REJECT_AT for x in b.column(at)], pa.bool_()))

    return map_arrow(docs, run, schema)
