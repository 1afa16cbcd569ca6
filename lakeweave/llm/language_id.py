"""Language identification by prediction by partial matching (PPM).

One byte-context tree per language, of order ``order`` with escape method C: in a
context seen ``t`` times with ``d`` different followers, a follower seen ``c`` times has
probability c / (t + d); all others share d / (t + d) and are predicted by the next
shorter context; below order 0 all bytes are alike. Statistics are frozen after
training, so every (context, byte) has one exact code length per language. These
are laid out as one table: a context of ``order`` bytes maps to the row of its
longest suffix that any language has seen, and a row holds the code lengths of each
byte in all languages. Scoring a text is two array lookups a byte.

Bytes are folded first: A-Z to a-z, every run of ASCII non-letters to one space.

Training reads a bounded sample of the labelled rows: at most ``sample_docs`` whole
texts a language, those with the smallest hash of identifier and text, so that rows
that share an identifier (or have none) are drawn one by one and no labelled language
is lost; a repeated row counts once. The model's size is checked against ``max_cells``
before it is built: beyond that the sample is halved in every language. Prediction uses the text alone and reads all of it.

Defined results: a null text or one without a letter (Unicode category L) is
``und`` with score 0; equal code lengths go to the language that sorts first;
repeated rows get equal results; with nothing to learn from, all is ``und``; an
empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, release

UND = "und"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
#: Bytes of evidence that the score trusts at most.
TRUST = 64
#: Positions scored at once.
SLICE = 1 << 20
#: Bytes of text judged in one call, unless one text is longer.
CALL_BYTES = 4 << 20
#: Cells (contexts x symbols x languages) that a model may have: 4 bytes each when it is broadcast.
MAX_CELLS = 32_000_000


def fold(text: bytes) -> bytes:
    return b" ".join(text.translate(_FOLD).split())


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


@dataclass
class Model:
    """``row[context] * n_symbols + symbol`` is a position in ``bits``: [positions, languages]."""

    languages: list[str]
    order: int
    symbol: np.ndarray
    n_symbols: int
    row: np.ndarray
    bits: np.ndarray


class ModelTooLarge(ValueError):
    """The sample's model would have more cells than allowed."""


def train(samples: list[tuple[str, bytes]], order: int = 3, max_cells: int | None = None) -> Model:
    """A model from (language, text) pairs."""
    languages = sorted({lang for lang, _ in samples})
    joined = {lang: b"".join(b" " * order + fold(t) for k, t in samples if k == lang) for lang in languages}
    seen = sorted(set(b"".join(joined.values())) | {32})
    symbol = np.full(256, len(seen), np.int64)  # the last symbol stands for all unseen bytes
    symbol[seen] = np.arange(len(seen))
    n = len(seen) + 1
    streams = {lang: symbol[np.frombuffer(t, np.uint8)] for lang, t in joined.items()}

    def codes(s: np.ndarray, k: int) -> np.ndarray:
        """The number of each window of ``k`` symbols."""
        out = np.zeros(max(0, len(s) - k + 1), np.int64)
        for j in range(k):
            out = out * n + s[j : len(s) - k + 1 + j]
        return out

    contexts = [np.unique(np.concatenate([codes(s, k)[: len(s) - k] for s in streams.values()] or [np.zeros(0, np.int64)])) if k else np.zeros(1, np.int64) for k in range(order + 1)]
    if max_cells is not None and sum(map(len, contexts)) * n * len(languages) > max_cells:
        raise ModelTooLarge(f"{sum(map(len, contexts))} contexts of {n} symbols in {len(languages)} languages")
    prob: list[np.ndarray] = []
    for k, known in enumerate(contexts):
        level = np.empty((len(known), n, len(languages)))
        for j, lang in enumerate(languages):
            s = streams[lang]
            at = np.searchsorted(known, codes(s, k)[: len(s) - k]) if k else np.zeros(len(s), np.int64)
            count = np.bincount(at * n + s[k:], minlength=len(known) * n).reshape(len(known), n).astype(float)
            total, different = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
            below = prob[-1][np.searchsorted(contexts[k - 1], known % n ** (k - 1)) if k > 1 else np.zeros(len(known), np.int64), :, j] if k else np.full((1, n), 1.0 / n)
            whole = np.maximum(total + different, 1)
            level[:, :, j] = np.where(total == 0, below, np.where(count > 0, count / whole, different / whole * below))
        prob.append(level)
    starts = np.cumsum([0] + [len(c) for c in contexts])
    every = np.arange(n**order)
    row = np.zeros(n**order, np.int32)
    for k in range(1, order + 1):
        part = every % n**k
        at = np.minimum(np.searchsorted(contexts[k], part), len(contexts[k]) - 1)
        hit = contexts[k][at] == part
        row[hit] = starts[k] + at[hit]
    bits = -np.log2(np.concatenate(prob)).astype(np.float32).reshape(-1, len(languages))
    return Model(languages, order, symbol.astype(np.int32), n, row, bits)


def code_lengths(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each folded text in each language, and the texts' lengths."""
    pad = b" " * model.order
    sizes = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), len(model.languages)))
    ends = np.cumsum(sizes + model.order)
    data = np.frombuffer(b"".join(x for t in texts for x in (pad, t)), np.uint8)
    for lo in range(0, len(data), SLICE):
        hi = min(len(data), lo + SLICE)
        s = model.symbol[data[max(0, lo - model.order) : hi]]
        lead = lo - max(0, lo - model.order)
        if lead < model.order:
            s = np.concatenate([np.zeros(model.order - lead, np.int32), s])
        context = s[: hi - lo].copy()
        for j in range(1, model.order):
            context = context * model.n_symbols + s[j : hi - lo + j]
        cost = model.bits[model.row[context] * model.n_symbols + s[model.order :]]
        first, last = np.searchsorted(ends, [lo, hi - 1], side="right")
        for doc_cut in (np.concatenate([[lo], ends[first:last]]),):
            sums = np.add.reduceat(cost, doc_cut - lo, axis=0, dtype=np.float64)
            out[first : last + 1] += sums
        # the padding in front of each text is not part of it
        begin = ends - sizes - model.order
        for j in range(model.order):
            at = begin + j
            inside = np.flatnonzero((at >= lo) & (at < hi))
            out[inside] -= cost[at[inside] - lo]
    return out, sizes


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample_docs: int = 400, sample_bytes: int = 16 << 20, order: int = 3, seed: int = 5, max_cells: int = MAX_CELLS, max_languages: int = 1000) -> Model | None:
    """Trains on ``sample_docs`` labelled texts a language at most; None if there are none.

    Of a language with more than ``sample_bytes`` in them, the first that fit, one at least.
    """
    h = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col), F.lit(seed))
    labelled = docs.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(label_col).alias("label"), F.col(text_col).alias("text"), h.alias("h"))
    # which texts are drawn is decided on hashes alone, a row for each different one
    light = materialize(labelled.groupBy("label", "h").agg(F.max(F.octet_length("text")).alias("n")), "hashes")
    counts = light.groupBy("label").count().limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} values of {label_col}")
    # the window needs sample_docs rows a language: thin by hash first, so that what it sorts doesn't grow with the table
    shares = docs.sparkSession.createDataFrame([(r["label"], min(1.0, 4.0 * sample_docs / r["count"])) for r in counts], f"_name {docs.schema[label_col].dataType.simpleString()}, share double")
    thin = light.join(F.broadcast(shares), F.col("label") == F.col("_name")).filter(F.pmod("h", F.lit(1 << 40)) < F.col("share") * F.lit(float(1 << 40)))
    by_hash = Window.partitionBy("label").orderBy("h")
    ranked = thin.withColumn("k", F.row_number().over(by_hash)).filter(F.col("k") <= sample_docs)
    ranked = ranked.withColumn("bytes", F.sum("n").over(by_hash)).filter((F.col("k") == 1) | (F.col("bytes") <= sample_bytes))
    drawn = ranked.select(F.col("label").alias("_label"), F.col("h").alias("_h"), "k")  # languages * sample_docs rows at most
    found = labelled.join(F.broadcast(drawn), (F.col("label") == F.col("_label")) & (F.col("h") == F.col("_h")))
    rows = found.groupBy("label", "k").agg(F.min("text").alias("text")).select("label", "k", F.col("text").cast("binary").alias("text")).collect()
    discard(light)
    samples = sorted((r["label"], r["k"], bytes(r["text"])) for r in rows)
    while samples:
        try:
            return train([(lang, text) for lang, _, text in samples], order, max_cells)
        except ModelTooLarge:
            keep = max(k for _, k, _ in samples) // 2
            if not keep:
                raise
            samples = [x for x in samples if x[1] <= keep]
    return None


def slices(part: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of at most 512 rows and some CALL_BYTES of text."""
    sizes = np.cumsum([x or 0 for x in pa.compute.binary_length(part.column(column)).to_pylist()])
    lo = 0
    while lo < part.num_rows:
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + CALL_BYTES, "right")))
        hi = min(hi, lo + 512)
        yield part.slice(lo, hi - lo)
        lo = hi


def judge(model: Model | None, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and bits a byte of each text."""
    names, scores, rates = [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    known = [k for k, t in enumerate(texts) if t is not None and model is not None and has_letter(t)]
    if known:
        folded = [fold(texts[k]) for k in known]
        bits, sizes = code_lengths(model, folded)
        n = np.maximum(sizes, 1)
        best = bits.argmin(1)
        weight = np.exp2(-(bits - bits.min(1, keepdims=True)) * np.minimum(1.0, TRUST / n)[:, None])
        for j, k in enumerate(known):
            names[k] = model.languages[best[j]]
        scores[known] = weight.max(1) / weight.sum(1)
        rates[known] = bits.min(1) / n
    return names, scores, rates


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, lang_pred, score, bits_per_byte: one row per row of ``docs``.

    The model is broadcast; ``fit`` checks its size (some 10 MB at 4 languages).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                names, scores, rates = judge(shared.value, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores), pa.array(rates)], names=["id", "lang_pred", "score", "bits_per_byte"])
        release()

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"id {id_type}, lang_pred string, score double, bits_per_byte double")


def held_out(id_col: str):
    """Rows never learnt from: every third by CRC-32 of the identifier's text."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that have no language, columns unchanged."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep: list[bool] = []
            texts = pa.RecordBatch.from_arrays([batch.column(at).cast(pa.binary())], names=["text"])
            for part in slices(texts, 0):
                keep += [x != UND for x in judge(shared.value, part.column(0).to_pylist())[0]]
            yield batch.filter(pa.array(keep, pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)
