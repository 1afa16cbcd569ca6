"""Quality rules: a linear-chain CRF labels lines, content share decides retention.

Each line with a word gets a few real-valued features (:data:`FEATURES`). A
two-state chain (content, boilerplate) scores a labelling by per-line weights and
by transitions; Viterbi finds the best one, and a document stays if content lines
hold at least ``min_content`` of its word bytes. Weights maximise the conditional
likelihood (forward-backward, gradient ascent) of line labels that a bounded sample
of labelled documents gives: all lines of a good document are content, the lines of
a bad one boilerplate but for those that look like good ones. The sample has ``sample_docs`` documents a class, all
lines of each. Without labels of both classes the seed lines
:data:`SEED` are learnt.

Before that, base rules: fewer than ``min_words`` words, or more than half of the
words in three-word windows that the text repeats, fail.

Defined results: a null text counts as empty and fails; only ASCII white space
separates words; rows are judged one by one, so ties, repeats and order don't
matter, and a very long text is read whole; an empty table gives an empty result.
Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
FEATURES = ["bias", "symbol_share", "upper_share", "digit_share", "one_word", "short", "pipe_or_bang_words", "symbol_words", "repeats", "link_or_markup"]
CONTENT, BOILERPLATE = 0, 1

#: Lines to learn from where no document is labelled: (label, lines of one document).
SEED = [
    (CONTENT, ["The river rises in the hills above the town and turns west.", "Its water is cold until late in the summer, and few people swim there.", "Farmers along the banks use it for their fields."]),
    (CONTENT, ["We measured each sample three times.", "The mean of the three values is given in the table below, and the spread was small."]),
    (BOILERPLATE, ["Home | About | Contact | Login |", "Shop | Cart | Help | Terms |", "CLICK!! HERE!! NOW!! FREE!!", "### $$$ sale### now$$$ buy%%% %%%"]),
    (BOILERPLATE, ["<a href=x> | next | prev |", "BUY!! NOW!! CHEAP!! DEALS!!", "word*** word&&& word### word$$$ word%%%", "Menu | Search | Menu | Search |"]),
]

_UPPER, _DIGIT, _SYMBOL = (bytes(sorted(x.encode())) for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", SYMBOLS))
_OTHERS = {k: bytes(set(range(256)) - set(k)) for k in (_UPPER, _DIGIT, _SYMBOL)}


def line_features(line: bytes, words: list[bytes], repeated: bool) -> list[float]:
    size, n = len(line), len(words)
    symbol, upper, digit = (len(line.translate(None, _OTHERS[k])) for k in (_SYMBOL, _UPPER, _DIGIT))
    marked = line.count(b"| ") + line.count(b"!!") + line.endswith(b"|")
    ends = line.count(b"###") + line.count(b"***") + line.count(b"$$$") + line.count(b"%%%") + line.count(b"&&&")
    return [1.0, min(1.0, 4.0 * symbol / size), upper / size, digit / size, float(n == 1), float(n < 5), min(1.0, marked / n), min(1.0, ends / n), float(repeated), float(b"</" in line or b"://" in line)]


class _Memo(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def repeat_words(hashes: np.ndarray) -> int:
    """Words in three-word windows that occur twice or more."""
    if len(hashes) < 4:
        return 0
    with np.errstate(over="ignore"):
        key = (hashes[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + (hashes[2:] >> np.uint64(7)) * np.uint64(0x165667B19E3779F9))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(hashes), bool)
    window = np.concatenate([order[1:][same], order[:-1][same]])
    for j in range(3):
        twice[window + j] = True
    return int(twice.sum())


def read_document(text: str | None, memo: dict) -> tuple[list[int], list[list[float]], list[int]]:
    """Base counts, the features of lines with a word, and those lines' word bytes."""
    text = text or ""
    rows: list[list[float]] = []
    weight: list[int] = []
    words: list[bytes] = []
    seen: set[bytes] = set()
    dup = 0
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        own = line.split()
        if own:
            repeated = line in seen
            dup += repeated
            seen.add(line)
            words += own
            rows.append(line_features(line, own, repeated))
            weight.append(sum(map(len, own)))
    hashes = np.fromiter((memo[w] for w in words), np.uint64, len(words))
    chars = len(text) - sum(map(text.count, _SPACES))
    return [len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeat_words(hashes)], rows, weight


def viterbi(x: np.ndarray, emit: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The best labelling of lines ``x``: [lines, features]; ``emit``: [2, features]; ``step``: [2, 2]."""
    scores = (x @ emit.T).tolist()
    (a00, a01), (a10, a11) = step.tolist()
    c, b = scores[0]
    back = []
    for sc, sb in scores[1:]:
        from_c, from_b = c + a00 >= b + a10, c + a01 >= b + a11
        back.append((from_c, from_b))
        c, b = (c + a00 if from_c else b + a10) + sc, (c + a01 if from_b else b + a11) + sb
    label = CONTENT if c >= b else BOILERPLATE
    out = [label]
    for from_c, from_b in reversed(back):
        label = CONTENT if (from_c if label == CONTENT else from_b) else BOILERPLATE
        out.append(label)
    return np.array(out[::-1])


def line_labels(samples: list[tuple[int, np.ndarray]], steps: int = 300, rate: float = 2.0) -> list[tuple[np.ndarray, np.ndarray]]:
    """(labels, features) of each document's lines, from (class, features) of documents.

    A bad document also has ordinary lines. A logistic regression of lines on their
    documents' classes, both classes weighing the same, finds those that look like
    the lines of good documents; they are content. Bad documents without any other
    line teach nothing and are left out.
    """
    x = np.concatenate([rows for _, rows in samples])
    y = np.concatenate([np.full(len(rows), c, float) for c, rows in samples])
    weight = np.where(y == BOILERPLATE, 0.5 / max(1, (y == BOILERPLATE).sum()), 0.5 / max(1, (y == CONTENT).sum()))
    w = np.zeros(len(FEATURES))
    for _ in range(steps):
        w -= rate * (x.T @ (weight * (1 / (1 + np.exp(-x @ w)) - y)))
    out = []
    for c, rows in samples:
        labels = np.where((c == BOILERPLATE) & (rows @ w > 0), BOILERPLATE, CONTENT)
        if c == CONTENT or labels.any():
            out.append((labels, rows))
    return out


def train(samples: list[tuple[np.ndarray, np.ndarray]], steps: int = 120, rate: float = 1.0, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Emission and transition weights from (labels, features) of documents' lines.

    Lines are laid out by their place in the document, longest documents first, so
    that memory holds each line once, however long one document is.
    """
    samples = sorted(samples, key=lambda s: -len(s[1]))
    sizes = np.array([len(rows) for _, rows in samples])
    longest, k = sizes[0], len(FEATURES)
    alive = np.array([(sizes > t).sum() for t in range(longest)])
    start = np.concatenate([[0], np.cumsum(alive)])
    at = [start[: len(rows)] + j for j, (_, rows) in enumerate(samples)]  # where the lines of a document are
    x, y, each = np.zeros((start[-1], k)), np.zeros(start[-1], int), np.zeros(start[-1])
    for own, (labels, rows) in zip(at, samples):
        x[own], y[own], each[own] = rows, labels, 1 / np.sqrt(len(rows))  # a document weighs as the root of its lines
    last, near = np.array([own[-1] for own in at]), np.arange(alive[0], start[-1])
    far = near - np.repeat(alive[:-1], alive[1:])  # the line before each line of near
    doc = np.arange(start[-1]) - np.repeat(start[:-1], alive)
    emit, step = np.zeros((2, k)), np.zeros((2, 2))
    gold_emit = np.stack([(each * (y == c)) @ x for c in (0, 1)])
    gold_step = np.array([[each[near] @ ((y[far] == c) & (y[near] == d)) for d in (0, 1)] for c in (0, 1)])
    mass = each.sum()
    for _ in range(steps):
        e = x @ emit.T
        alpha, beta = e.copy(), np.zeros_like(e)
        for t in range(1, longest):
            lo, n = start[t], alive[t]
            before = alpha[start[t - 1] : start[t - 1] + n]
            alpha[lo : lo + n] += np.logaddexp(before[:, :1] + step[0], before[:, 1:] + step[1])
        for t in range(longest - 2, -1, -1):
            lo, n = start[t + 1], alive[t + 1]
            after = e[lo : lo + n] + beta[lo : lo + n]
            beta[start[t] : start[t] + n] = np.logaddexp(after[:, :1] + step[:, 0], after[:, 1:] + step[:, 1])
        z = np.logaddexp(alpha[last, 0], alpha[last, 1])[doc]
        node = np.exp(alpha + beta - z[:, None]) * each[:, None]
        edge = np.exp(alpha[far, :, None] + step + (e + beta)[near, None, :] - z[near, None, None]) * each[near, None, None]
        emit += rate * ((gold_emit - node.T @ x) / mass * 4 - decay * emit)
        step += rate * ((gold_step - edge.sum(0)) / mass - decay * step)
    return emit, step


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = 200, seed: int = 3):
    """Weights from ``sample_docs`` labelled documents a class at most, else from the seed lines."""
    first = Window.partitionBy("good").orderBy("h", "_id")
    marked = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), (F.col(label_col) > 0).alias("good"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("h")).distinct()
    # the window needs 2 * sample_docs rows: thin by hash first, so that a large label table isn't sorted in two tasks
    counts = {r["good"]: r["count"] for r in marked.groupBy("good").count().collect()}
    share = F.when(F.col("good"), 4.0 * sample_docs / max(1, counts.get(True, 0))).otherwise(4.0 * sample_docs / max(1, counts.get(False, 0)))
    thin = marked.filter(F.pmod("h", F.lit(1 << 20)) / F.lit(float(1 << 20)) < share)
    drawn = thin.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= sample_docs).select("_id", "good")
    # of rows that repeat an identifier the one with the smallest hash of its text: 2 * sample_docs rows at most
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).filter(F.col("_text").isNotNull())  # other columns may have any name
    found = texts.join(F.broadcast(drawn), F.col("_doc") == F.col("_id"))
    rows = found.groupBy("_id", "good").agg(F.min_by("_text", F.sha2("_text", 256)).alias("_text")).select("good", "_text").collect()
    memo = _Memo()
    samples = [(CONTENT if good else BOILERPLATE, np.array(read_document(text, memo)[1]).reshape(-1, len(FEATURES))) for good, text in sorted(map(tuple, rows))]
    samples = [(y, x) for y, x in samples if len(x)]
    if {y for y, _ in samples} != {CONTENT, BOILERPLATE}:
        samples = [(y, np.array(read_document("\n".join(lines), memo)[1])) for y, lines in SEED]
    return train(line_labels(samples))


def score_quality(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat: float = 0.5, min_content: float = 0.5) -> DataFrame:
    """Returns id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share."""
    emit, step = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo()
        for batch in batches:
            counts, kept, failed, share = [], [], [], []
            for text in batch.column(1):
                base, rows, weight = read_document(text.as_py(), memo)
                content = 0.0
                if rows:
                    labels = viterbi(np.array(rows), emit, step)
                    content = float(np.dot(labels == CONTENT, weight) / sum(weight))
                bad = base[0] < min_words or base[4] > max_repeat * base[0]
                counts.append(base)
                failed.append(bad)
                share.append(content)
                kept.append(not bad and content >= min_content)
            columns = np.array(counts, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in columns), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_()), pa.array(share, pa.float64())], names=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"])

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
