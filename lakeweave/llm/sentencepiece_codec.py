"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed here (protobuf wire format, no generated code) and rebuilt:
normaliser (precompiled map, extra spaces, dummy prefix), the metaspace marker,
piece scores (Unigram models as they are; BPE models as merges ranked by the merged
piece's score) and byte fallback. If no piece has a marker behind another character,
no piece can cross a word's start: then the rebuilt tokenizer's pre-tokenizer cuts
texts at markers, Unigram models at each word, which lets the library's cache know words,
BPE models at each RUN_WORDS words, since a slice costs more than the merges of its
words and runs don't recur (no cache); else it works on unsplit texts.

Whole texts are encoded in multithreaded batches (``threads`` a task), and the emitted
ids are decoded again, by the bytes of each piece (bytes that are no UTF-8 go to the
sentencepiece library). Parity with that library is verified on every whole text:
where ids differ, its own are taken and ``parity`` is false.

The file's bytes are broadcast: their size is that of the model, whatever the input.
A call holds ``CALL_BYTES`` of text at most, or one text if it is longer; only a call's
texts leave Arrow at once.

Defined results: null text is empty, and empty text has no tokens; the marker
character U+2581 in a text decodes to a space, as in SentencePiece, and lone
surrogates can't occur; control pieces (``<s>``) in a text are ordinary text, and so
are names of byte pieces (``<0x41>``; a rebuilt Unigram model takes them for the
byte, so such texts have no parity); rows are coded one by one, whole, so ties and
repeats don't matter; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: The public vocabulary file of this environment; a parameter everywhere.
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text encoded in one call: the libraries hold some hundred bytes for each of them.
CALL_BYTES = 1 << 18
#: Rows encoded in one call.
CALL_ROWS = 512
#: Words that a BPE model merges at once.
RUN_WORDS = 32
#: Token ids decoded in one call.
CALL_IDS = 1 << 18


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
            else:
                raise ValueError(f"wire type {kind} is not known")
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass
class Spec:
    """What a model file says, as far as coding needs it."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True

    def ids(self, *kinds: int) -> list[int]:
        return [k for k, (_, _, kind) in enumerate(self.pieces) if kind in kinds]


def parse_model(data: bytes) -> Spec:
    spec = Spec()
    for number, value in wire(data):
        if number == 1:
            piece = dict(wire(value))
            spec.pieces.append((piece.get(1, b"").decode("utf-8"), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(wire(value))
            spec.kind, spec.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
            if trainer.get(24, 0):
                raise ValueError("models with the marker behind words can't be rebuilt")
        elif number == 3:
            norm = dict(wire(value))
            spec.charsmap, spec.dummy_prefix, spec.remove_extra, spec.escape = norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1))
    return spec


def merges(spec: Spec) -> list[tuple[str, str]]:
    """All ways to make a piece of two others, best merged piece first."""
    rank = {piece: k for k, (piece, _, kind) in enumerate(spec.pieces) if kind in (NORMAL, USER_DEFINED)}
    found = []
    for piece, k in rank.items():
        for cut in range(1, len(piece)):
            a, b = piece[:cut], piece[cut:]
            if a in rank and b in rank:
                found.append((-spec.pieces[k][1], k, rank[a], rank[b], a, b))
    return [(x[4], x[5]) for x in sorted(found)]


def splitter(spec: Spec):
    """The pre-tokenizer that cuts at words' starts, or None if a piece can cross a word's start."""
    from tokenizers import Regex, pre_tokenizers

    pieces = [piece for piece, _, kind in spec.pieces if kind in (NORMAL, USER_DEFINED)]
    if not spec.escape or any(MARK in piece.lstrip(MARK) for piece in pieces):
        return None
    if spec.kind == BPE:
        return pre_tokenizers.Split(Regex(f"(?:{MARK}+[^{MARK}]*){{1,{RUN_WORDS}}}|[^{MARK}]+"), "isolated")
    if any(piece.startswith(MARK * 2) for piece in pieces):  # runs of markers stay together
        return pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    return pre_tokenizers.Metaspace(MARK, "never", True)


def only_marks(spec: Spec) -> bool:
    """Whether the normaliser does no more than to mark spaces."""
    return spec.escape and not spec.charsmap and not spec.remove_extra


def build(spec: Spec):
    """The tokenizers-library tokenizer of a model."""
    from tokenizers import Regex, Tokenizer, models, normalizers

    unknown = spec.ids(UNKNOWN)[0]
    if spec.kind == BPE:
        vocab = {piece: k for k, (piece, _, _) in enumerate(spec.pieces)}
        model = models.BPE(vocab, merges(spec), unk_token=spec.pieces[unknown][0], fuse_unk=True, byte_fallback=spec.byte_fallback, cache_capacity=0)
    elif spec.kind == UNIGRAM:
        # pieces that no text may match get a space in their name: marked texts have none; byte pieces need their names
        known = [(piece if kind in (NORMAL, USER_DEFINED, BYTE) else f" {piece}", score) for piece, score, kind in spec.pieces]
        model = models.Unigram(known, unknown, spec.byte_fallback)
    else:
        raise ValueError("only Unigram and BPE models can be rebuilt")
    tokenizer = Tokenizer(model)
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.remove_extra:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    if spec.escape:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if (split := splitter(spec)) is not None:
        tokenizer.pre_tokenizer = split
    return tokenizer


def surfaces(spec: Spec) -> list[bytes]:
    """The bytes that each piece stands for."""
    out = []
    for piece, _, kind in spec.pieces:
        if kind == BYTE:
            out.append(bytes([int(piece[3:5], 16)]))
        elif kind in (CONTROL, UNKNOWN):
            out.append(b"" if kind == CONTROL else " \u2047 ".encode())
        else:
            out.append(piece.replace(MARK, " ").encode())
    return out


class Codec:
    """Encodes and decodes batches of whole texts; made once a Python worker."""

    def __init__(self, data: bytes, threads: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        import sentencepiece

        self.spec, self.threads = parse_model(data), threads
        self.fast = build(self.spec)
        if marks := only_marks(self.spec):
            # the same steps as plain text replacement; the library's own keep a table of offsets for each character
            from tokenizers import normalizers

            self.fast.normalizer = normalizers.Sequence([])
        self.marks = marks
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.bytes = np.zeros(len(self.spec.pieces), bool)
        self.bytes[self.spec.ids(BYTE)] = True
        self.surface = surfaces(self.spec)

    def normalize(self, texts: list[str]) -> list[str]:
        """What the rebuilt tokenizer is given: marked texts, or raw ones where its own normaliser does more."""
        if not self.marks:
            return texts
        lead = MARK if self.spec.dummy_prefix else ""
        return [lead + t.replace(" ", MARK) if t else t for t in texts]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[bool], list[str]]:
        """Ids of each text, whether both libraries agree on them, and the texts decoded from them."""
        ours = [x.ids for x in self.fast.encode_batch_fast(self.normalize(texts), add_special_tokens=False)]
        ids = self.plain.encode(texts, num_threads=self.threads)
        return ids, [a == b for a, b in zip(ours, ids)], self.decode(ids)

    def decode(self, ids: list[list[int]]) -> list[str]:
        out, surface = [], self.surface
        for x in ids:
            try:
                text = b"".join([surface[i] for i in x]).decode("utf-8")
            except UnicodeDecodeError:
                out.append(self.plain.decode(x))
                continue
            if self.spec.remove_extra:
                text = text.lstrip(" ")
            elif self.spec.dummy_prefix and text[:1] == " ":
                text = text[1:]
            out.append(text)
        return out


_codecs: dict[tuple[str, int], Codec] = {}


def codec(data: bytes, threads: int) -> Codec:
    key = hashlib.sha256(data).hexdigest(), threads
    if key not in _codecs:
        _codecs[key] = Codec(data, threads)
    return _codecs[key]


def calls(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Where each call's texts begin, and these: CALL_ROWS texts and CALL_BYTES at most, or one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(ends):
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CALL_BYTES, "right"))
        hi = max(lo + 1, min(hi, lo + CALL_ROWS))
        yield lo, [text or "" for text in texts.slice(lo, hi - lo).to_pylist()]
        lo = hi


def coded(own: Codec, id_: pa.Array, texts: list[str], with_ids: bool) -> pa.RecordBatch:
    """The result rows of one call."""
    ids, same, back = own.encode(texts)
    ids = [np.array(x, np.int32) for x in ids]
    offsets = np.cumsum([0] + [len(x) for x in ids])
    columns = {
        "id": id_,
        "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids))) if with_ids else None,
        "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
        "n_byte_tokens": pa.array([int(own.bytes[x].sum()) for x in ids], pa.int64()),
        "ids_sha256": pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]),
        "decoded_sha256": pa.array([hashlib.sha256(x.encode("utf-8")).hexdigest() for x in back]),
        "round_trip": pa.array([x == t.replace(MARK, " ") for x, t in zip(back, texts)], pa.bool_()),
        "parity": pa.array(same, pa.bool_()),
    }
    columns = {k: v for k, v in columns.items() if v is not None}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


SCHEMA = "ids array<int>, n_tokens long, n_byte_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean, parity boolean"


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = DEFAULT_MODEL, threads: int = 2, with_ids: bool = True) -> DataFrame:
    """Returns id, ids, n_tokens, n_byte_tokens, ids_sha256, decoded_sha256, round_trip, parity: one row per row of ``docs``.

    ``ids_sha256`` is over the ids as little-endian 32-bit integers, ``decoded_sha256``
    over the decoded text in UTF-8; ``round_trip``: the decoded text is the text
    (U+2581 read as a space). ``with_ids`` false leaves ``ids`` out.
    """
    with open(model_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, threads)
        release()  # what building it, or another stage in this worker, has left
        for batch in batches:
            for at, texts in calls(batch.column(1)):
                yield coded(own, batch.column(0).slice(at, len(texts)), texts, with_ids)
            batch = texts = None  # before the next one is read
        release()

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, " + (SCHEMA if with_ids else SCHEMA.removeprefix("ids array<int>, "))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode(tokens: DataFrame, ids_col: str = "ids", model_path: str = DEFAULT_MODEL, threads: int = 2, out: str = "decoded") -> DataFrame:
    """``tokens`` with the column ``out``: the text of its ids (null ids: null)."""
    with open(model_path, "rb") as file:
        shared = tokens.sparkSession.sparkContext.broadcast(file.read())
    at = tokens.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, threads)
        for batch in batches:
            sizes = np.cumsum([0 if x is None else x for x in batch.column(at).value_lengths().to_pylist()])
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + CALL_IDS, "right")))
                part = batch.slice(lo, hi - lo)
                ids = part.column(at).to_pylist()
                texts = own.decode([x or [] for x in ids])
                text = pa.array([None if x is None else t for x, t in zip(ids, texts)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, text], names=[*part.schema.names, out])
                lo = hi
        release()

    from pyspark.sql.types import StringType, StructType

    return tokens.mapInArrow(run, StructType([*tokens.schema.fields]).add(out, StringType()))
