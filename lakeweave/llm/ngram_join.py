"""N-gram Jaccard join as a blocked sparse matrix product.

The matrix has a row per text and a column per word n-gram (``shingle`` words). Overlap
counts are entries of the product of this matrix with its transpose; it is computed in
tiles, and only where size-derived bounds leave a pair open:

1. *Column counts.* Columns are cut into blocks by hash range, a task each. A block counts
   the rows of each column and keeps entries of columns with two rows or more: any other
   entry can't add to an overlap. Columns that many rows of one task's input share are
   split: their rows stay in packed records that are dealt evenly, only counts go to the
   block, and the totals come back to the records.
2. *Row bound.* A partner at Jaccard ``t`` overlaps a row of size n in at least
   ceil(t n) columns. A row with fewer entries left has no partner and goes.
3. *Prefix bound.* With entries ordered by column count (rare first), two rows that
   link meet in one of their first (entries left) - ceil(t n) + 1 columns. Only those
   columns make candidates; passages that many documents share come last in the
   order and make none.
4. *Product with pivots.* In each candidate column one row is the pivot, that with the most
   frequent entries (of a family of copies, its original). Pivots and the rows that meet
   them within the size bound are dealt to tiles; a tile multiplies its sparse rows with
   its sparse pivots, accumulates the overlap counts and emits the pairs that reach the
   bound, reduced to a spanning forest. Families of copies collapse here, in time linear
   in their size: a family of any size is many tiles.
5. *Product of the rest.* What still meets in a column without being connected is grouped
   into clusters. All rows of a cluster but those of its largest component are pivots of
   further tiles, by size class (classes are a factor 1 / t apart, so only equal and
   adjacent ones can link). Rows of the largest component are never compared with each
   other, and a row is sent once for each block of pivots.

Every pair that could link and isn't connected yet is compared, so components are
exact, while pairs inside a component needn't be written. Rows are texts with equal
shingle sets, known by a 128-bit hash of the whole set; shingles are 64-bit hashes (some
text of ten million words has two alike with odds of 3e-6).

The number of blocks follows from the bytes of all texts, so that a task's share is the
same at every size.

Words are maximal runs of non-space (ASCII space), A-Z lower-cased. A text with
fewer words than a shingle is one shingle; null or wordless texts have none and link
with nothing. Repeated rows have equal sets and so one component; a null identifier
counts as larger than any other; an empty table gives an empty result. Only the
named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, release, shuffle_partitions
from .components import components

#: Matrix entries a task packs at once.
FLUSH = 1_000_000
#: A column with so many rows in one flush is split.
HOT = 16
#: Copies of a split column's total, each for a share of its records.
SALTS = 16
#: Bytes of text to a block, some four million entries.
BLOCK_BYTES = 24_000_000
#: Bytes of packed entries to a batch.
BATCH_BYTES = 4 << 20
#: Entries multiplied at once.
STEP = 1 << 15
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63]
ENTRIES, DOCUMENT, SPLIT, TOTAL = 0, 1, 2, 3
NAME = "S16"


class _Memo(dict):
    """64-bit hashes of words; starts anew when it is large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def shingles(text: bytes | None, size: int, memo: dict) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a text."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter((memo[w] for w in words), np.uint64, len(words))
    width = min(size, len(words))
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total = total * np.uint64(_ODD[k % 5] + 2 * k) + h[k : k + n]
    total = np.sort(_mix(total))
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def by_run(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(keys)))


def part_of(names: np.ndarray, parts: int) -> np.ndarray:
    """The part that owns each row, by its first seven bytes."""
    lead = np.frombuffer(names.tobytes(), ">u8")[::2].astype(np.uint64) >> np.uint64(8)
    return (lead % np.uint64(parts)).astype(np.int64)


def _packed(part: np.ndarray, row: np.ndarray, names: np.ndarray, h: np.ndarray, extra: np.ndarray | None = None) -> Iterator[tuple]:
    """(part, names, counts, hashes, extra) for each part; input sorted by part, then row, a position in ``names``."""
    starts, sizes = by_run(part)
    for s, n in zip(starts, sizes):
        at = slice(s, s + n)
        first, counts = by_run(row[at])
        yield int(part[s]), names[row[at][first]].tobytes(), counts.astype(np.uint32).tobytes(), h[at].astype("<u8").tobytes(), None if extra is None else extra[at].astype(np.uint32).tobytes()


class _Out:
    """Arrow batches of packed entries, document rows and split columns."""

    def __init__(self, id_type: pa.DataType):
        self.types = {"part": pa.int32(), "kind": pa.int8(), "rows": pa.binary(), "counts": pa.binary(), "hashes": pa.binary(), "extra": pa.binary(), "id": id_type, "row": pa.binary(), "n": pa.int64(), "column": pa.int64()}

    def batch(self, **columns) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.nulls(size, t) if k not in columns else columns[k] if isinstance(columns[k], pa.Array) else pa.array(columns[k], t) for k, t in self.types.items()], names=list(self.types))

    def entries(self, packed) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for piece in packed:
            held.append(piece)
            size += sum(len(x) for x in piece[1:] if x is not None)
            if size >= BATCH_BYTES:
                yield self._entries(held)
                held, size = [], 0
        if held:
            yield self._entries(held)

    def _entries(self, packed: list[tuple]) -> pa.RecordBatch:
        part, rows, counts, hashes, extra = zip(*packed)
        return self.batch(part=part, kind=[ENTRIES] * len(part), rows=rows, counts=counts, hashes=hashes, extra=extra)


def schema_of(id_type: str) -> str:
    return f"part int, kind byte, rows binary, counts binary, hashes binary, extra binary, id {id_type}, row binary, n long, column long"


def _columns_of(pieces: list[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the rows, each once, and (row, hash) of packed entries."""
    names, code = np.unique(np.concatenate([np.frombuffer(r, NAME) for r, _, _ in pieces]), return_inverse=True)
    counts = np.concatenate([np.frombuffer(c, np.uint32) for _, c, _ in pieces])
    return names, np.repeat(code, counts), np.concatenate([np.frombuffer(h, "<u8") for _, _, h in pieces])


def incidence(docs: DataFrame, id_col: str, text_col: str, size: int, parts: int) -> DataFrame:
    """Packed entries by column block, columns to split, and a row for each document."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, keys, sets, held, out, flushes = _Memo(), [], [], 0, None, 0

        def flush() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(h) for h in sets])
            names, h, row = np.array(keys, NAME), np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            part = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.uint32)
            order = np.argsort(h)
            starts, runs = by_run(h[order])
            hot = np.flatnonzero(runs >= HOT)
            if len(hot):
                at = order[np.concatenate([np.arange(starts[k], starts[k] + runs[k]) for k in hot])]
                cut = np.concatenate([[0], np.cumsum(runs[hot])])
                column = h[at[cut[:-1]]].view(np.int64)
                dealt = ((h[at[cut[:-1]]] ^ np.uint64(flushes * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(parts)).astype(np.int32)
                rows = [names[row[at[cut[k] : cut[k + 1]]]].tobytes() for k in range(len(hot))]
                yield out.batch(part=dealt, kind=[SPLIT] * len(hot), rows=rows, column=column)
                yield out.batch(part=part[at[cut[:-1]]].astype(np.int32), kind=[TOTAL] * len(hot), n=runs[hot].astype(np.int64), column=column)
                cold = np.ones(len(h), bool)
                cold[at] = False
                part, row, h = part[cold], row[cold], h[cold]
            order = np.argsort(part.astype(np.uint16) if parts < 65536 else part, kind="stable")
            yield from out.entries(_packed(part[order], row[order], names, h[order]))

        for batch in batches:
            out = out or _Out(batch.schema.field(0).type)
            known: set[bytes] = set()
            row, n = [], []
            for text in batch.column(1):
                h = shingles(text.as_py(), size, memo)
                key = xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None
                row.append(key)
                n.append(len(h))
                if key is not None and key not in known:
                    known.add(key)
                    keys.append(key)
                    sets.append(h)
                    held += len(h)
                    if held >= FLUSH:
                        yield from flush()
                        keys, sets, held, flushes = [], [], 0, flushes + 1
            yield out.batch(part=[j % parts for j in range(len(row))], kind=[DOCUMENT] * len(row), id=batch.column(0), row=row, n=n)
        if sets:
            yield from flush()
        memo.clear()
        keys, sets = [], []
        release()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema_of(id_type))


def shared_entries(blocks: DataFrame, parts: int) -> DataFrame:
    """Step 1 in each block; entries that stay go on by row, with their column's count, and split columns get their totals."""

    def block(pieces: list[tuple[bytes, bytes, bytes]], split: dict[int, int], out: _Out) -> Iterator[pa.RecordBatch]:
        names, row, h = _columns_of(pieces) if pieces else (np.zeros(0, NAME), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        columns = np.array(sorted(split), np.int64).view(np.uint64)
        columns, more = np.sort(columns), np.array([split[int(c)] for c in np.sort(columns).view(np.int64)], np.int64)
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        shared = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(h) else np.zeros(0, bool)
        if len(columns):
            shared |= np.isin(h[order], columns)
        order = order[shared]
        row, h = row[order], h[order]
        order = np.lexsort((row, h))
        row, h = row[order], h[order]
        fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, bool)
        row, h = row[fresh], h[fresh]  # one task's copies were one row already, other tasks' are dropped here
        starts, sizes = by_run(h)
        if len(columns):
            at = np.minimum(np.searchsorted(columns, h[starts]), len(columns) - 1)
            sizes_all = sizes + np.where(columns[at] == h[starts], more[at], 0) if len(starts) else sizes
            here = np.searchsorted(h[starts], columns)
            inside = np.minimum(here, max(0, len(starts) - 1))
            own = np.where(h[starts][inside] == columns, sizes[inside], 0) if len(starts) else np.zeros(len(columns), np.int64)
            yield out.batch(part=[0] * len(columns), kind=[TOTAL] * len(columns), n=more + own, column=columns.view(np.int64))
        else:
            sizes_all = sizes
        count = np.repeat(sizes_all, sizes)
        keep = count > 1
        row, h, count = row[keep], h[keep], np.minimum(count[keep], 0xFFFFFFFF)
        part = part_of(names, parts)[row] if len(row) else row
        order = np.lexsort((row, part))
        yield from out.entries(_packed(part[order], row[order], names, h[order], count[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, dict]] = {}
        out = None
        for batch in batches:
            out = out or _Out(batch.schema.field("id").type)
            part, kind = batch.column("part").to_pylist(), np.array(batch.column("kind").to_pylist())
            for k in np.flatnonzero(kind == ENTRIES):
                held.setdefault(part[k], ([], {}))[0].append(tuple(batch.column(c)[int(k)].as_py() for c in ("rows", "counts", "hashes")))
            for k in np.flatnonzero(kind == TOTAL):
                split, column = held.setdefault(part[k], ([], {}))[1], batch.column("column")[int(k)].as_py()
                split[column] = split.get(column, 0) + batch.column("n")[int(k)].as_py()
            yield batch.filter(pa.array((kind == DOCUMENT) | (kind == SPLIT)))
        for part in list(held):
            yield from block(*held.pop(part), out)
        release()

    return blocks.mapInArrow(run, blocks.schema)


def split_entries(entries: DataFrame, parts: int) -> DataFrame:
    """Entries of split columns by row: the records of a column meet its total in SALTS shares."""
    salt = F.pmod(F.xxhash64("rows"), F.lit(SALTS)).cast("int")
    records = entries.filter(F.col("kind") == SPLIT).select("column", "rows", salt.alias("salt"))
    totals = entries.filter(F.col("kind") == TOTAL).groupBy("column").agg(F.sum("n").alias("n")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, 256) for b in batches for lo in range(0, b.num_rows, 256)):
            each = [np.frombuffer(x, NAME) for x in batch.column("rows").to_pylist()]
            sizes = [len(x) for x in each]
            names, row = np.unique(np.concatenate(each), return_inverse=True)
            h = np.repeat(np.array(batch.column("column").to_pylist(), np.int64), sizes)
            count = np.repeat(np.minimum(np.array(batch.column("n").to_pylist(), np.int64), 0xFFFFFFFF), sizes)
            part = part_of(names, parts)[row]
            order = np.lexsort((row, part))
            packed = list(zip(*_packed(part[order], row[order], names, h[order].view(np.uint64), count[order])))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(packed, (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "rows", "counts", "hashes", "extra"])

    joined = records.join(totals.hint("shuffle_hash"), ["column", "salt"]).select("column", "rows", "n")
    return joined.mapInArrow(run, "part int, rows binary, counts binary, hashes binary, extra binary")


def candidates(entries: DataFrame, parts: int, percent: int) -> DataFrame:
    """Steps 2 and 3: row, n, prefix (its length), weight, entries (rare columns first) of rows that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: dict[bytes, int] = {}
        pieces, extra = [], []
        for batch in batches:
            for rows, counts, hashes, more, row, n in zip(*(batch.column(c).to_pylist() for c in ("rows", "counts", "hashes", "extra", "row", "n"))):
                if rows is None:
                    sizes[row] = n
                else:
                    pieces.append((rows, counts, hashes))
                    extra.append(np.frombuffer(more, np.uint32))
        if not pieces:
            return
        names, row, h = _columns_of(pieces)
        count, pieces, extra = np.concatenate(extra), None, None
        order = np.lexsort((h, count, row))
        row, h, count = row[order], h[order], count[order]
        if len(row):  # a text that was in several flushes has its split columns twice
            fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
            row, h, count = row[fresh], h[fresh], count[fresh]
        whole = names.tobytes()
        found: list[tuple] = []
        for s, k in zip(*by_run(row)):
            name = whole[16 * row[s] : 16 * row[s] + 16]
            n = sizes[name]
            need = -(-percent * n // 100)
            if k >= need:
                found.append((name, n, int(k - need + 1), float(np.log(count[s : s + k]).sum() / n), h[s : s + k].view(np.int64)))
            if len(found) >= 2000:
                yield _survivors(found)
                found = []
        if found:
            yield _survivors(found)
        del row, h, count, order, found
        release()

    return entries.select("part", "rows", "counts", "hashes", "extra", "row", "n").mapInArrow(run, "name binary, n long, prefix int, weight double, entries array<long>")


def _survivors(found: list[tuple]) -> pa.RecordBatch:
    name, n, prefix, weight, entries = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(name, pa.binary()), pa.array(n, pa.int64()), pa.array(prefix, pa.int32()), pa.array(weight, pa.float64()), pa.array(entries, pa.list_(pa.int64()))], names=["name", "n", "prefix", "weight", "entries"])


def deal(df: DataFrame, parts: int, *, column: str = "part") -> DataFrame:
    """Rows to the partitions that ``column`` names: block k is partition k, so blocks stay even."""
    return df.repartitionById(parts, F.col(column)) if hasattr(df, "repartitionById") else df.repartition(parts, column)


def enough(overlap, n, m, percent: int):
    """percent <= 100 * overlap / union, in integers."""
    return 100 * overlap >= percent * (n + m - overlap)


class Tile:
    """Some sparse pivot rows, to multiply sparse rows with."""

    def __init__(self, pivots: list[tuple[int, int, int, np.ndarray]]):
        self.key, self.n, self.root = (np.array([p[k] for p in pivots], np.int64) for k in range(3))
        columns = np.concatenate([p[3] for p in pivots])
        pivot = np.repeat(np.arange(len(pivots)), [len(p[3]) for p in pivots])
        order = np.argsort(columns, kind="stable")
        self.columns, self.pivot = columns[order], pivot[order]

    def overlaps(self, sets: list[np.ndarray]) -> np.ndarray:
        """The product: overlap counts [rows, pivots], accumulated over STEP entries at a time."""
        size = len(sets) * len(self.key)
        out = np.zeros(size, np.int64)
        columns, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        for lo in range(0, len(columns), STEP):
            c, r = columns[lo : lo + STEP], row[lo : lo + STEP]
            first = np.searchsorted(self.columns, c, "left")
            times = np.searchsorted(self.columns, c, "right") - first
            r, first, before = np.repeat(r, times), np.repeat(first, times), np.repeat(np.cumsum(times) - times, times)
            out += np.bincount(r * len(self.key) + self.pivot[first + np.arange(len(r)) - before], minlength=size)
        return out.reshape(len(sets), len(self.key))

    def links(self, key: np.ndarray, n: np.ndarray, root: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(a, b): links of rows of different roots, as a spanning forest: a row with its first pivot, that with the others."""
        hit = enough(self.overlaps(sets), n[:, None], self.n[None, :], percent) & (root[:, None] != self.root[None, :])
        r, p = np.nonzero(hit)
        starts, sizes = by_run(r)
        first = np.repeat(p[starts], sizes) if len(r) else p
        more = np.unique(first * len(self.key) + p)
        a, b = self.key[more // len(self.key)], self.key[more % len(self.key)]
        return np.concatenate([key[r[starts]], a[a != b]]) if len(r) else a, np.concatenate([self.key[p[starts]], b[a != b]]) if len(r) else b


def product(tasks: DataFrame, rows: DataFrame, percent: int, parts: int) -> DataFrame:
    """Links (a, b) of the tiles in ``tasks``: tile, chunk, side (0: pivot), row, root. They are between roots."""
    full = tasks.join(rows.select("row", "n", "entries"), "row")
    dealt = full.repartition(parts, "tile", "chunk").sortWithinPartitions("tile", "chunk", "side").select("tile", "chunk", "side", "row", "n", "root", "entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivots, tile = None, [], None

        def sets_of(part: pa.RecordBatch) -> list[np.ndarray]:
            values, cut = part.column("entries").flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(part.column("entries").value_lengths().to_numpy())])
            return [values[cut[k] : cut[k + 1]] for k in range(part.num_rows)]

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("tile", "chunk", "side")])
            cuts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)]))
            for lo, hi in zip(cuts, np.append(cuts[1:], batch.num_rows)):
                here = tuple(keys[:2, lo])
                if here != at:
                    at, pivots, tile = here, [], None
                for start in range(lo, hi, 256):
                    part = batch.slice(start, min(256, hi - start))
                    n, root = (part.column(c).to_numpy() for c in ("n", "root"))
                    sets = sets_of(part)
                    if keys[2, lo] == 0:
                        pivots += list(zip(root.tolist(), n.tolist(), root.tolist(), (x.copy() for x in sets)))
                    elif pivots:
                        tile = tile or Tile(pivots)
                        a, b = tile.links(root, n, root, sets, percent)
                        if len(a):
                            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        release()

    return dealt.mapInArrow(run, "a long, b long")


def tiles(pivots: DataFrame, members: DataFrame, chunk_rows: int, most: int) -> DataFrame:
    """Tasks of ``product`` from (tile, row, root) of pivots and of the rows to compare: rows in even chunks, pivots with each; ``most`` bounds the tiles."""
    chunks = materialize(members.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(chunk_rows))).cast("int").alias("chunks")), "chunks", most)
    own = members.join(chunks, "tile").select("tile", F.pmod(F.xxhash64("row", F.lit(5)), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("side"), "row", "root")
    each = pivots.join(chunks, "tile").select("tile", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("side"), "row", "root")
    return own.unionByName(each)


def pivot_links(rows: DataFrame, meets: DataFrame, percent: int, block_rows: int, parts: int, most: tuple[int, int]) -> DataFrame:
    """Step 4: links between rows and the pivots of the columns in which they meet; ``most``: counts of ``rows`` and ``meets``."""
    best = meets.groupBy("column").agg(F.max(F.struct("weight", "row", "n")).alias("pivot"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    near = (100 * F.least("n", "pivot.n") >= percent * F.greatest("n", "pivot.n")) & (F.col("row") != F.col("pivot.row"))
    pairs = materialize(meets.join(best, "column").filter(near).select("row", F.col("pivot.row").alias("pivot")).distinct(), "pairs", most[1])
    used = pairs.select(F.col("pivot").alias("row")).distinct()
    weight = materialize(used.join(rows.select("row", "n"), "row"), "pivots", most[0])
    total = weight.agg(F.count(F.lit(1)), F.sum("n")).first()
    n_tiles = max(parts, 2 * total[0] // block_rows, (total[1] or 0) // 4_000_000)
    tile = lambda c: F.pmod(F.xxhash64(c, F.lit(3)), F.lit(n_tiles)).alias("tile")
    pivots = weight.select(tile("row"), "row", F.col("row").alias("root"))
    members = pairs.select(tile("pivot"), "row", F.col("row").alias("root")).distinct()
    links = materialize(product(tiles(pivots, members, block_rows, n_tiles), rows, percent, parts), "links")
    discard(pairs, weight)
    return links


def rest_links(rows: DataFrame, meets: DataFrame, roots: DataFrame, percent: int, block_rows: int, parts: int, most: tuple[int, int]) -> DataFrame:
    """Step 5: links between rows that meet in a column and aren't connected by ``roots``; ``most`` as in step 4."""
    known = roots.select(F.col("node").alias("row"), "root")
    at = materialize(meets.select("column", "row", "n").join(known, "row", "left").withColumn("root", F.coalesce("root", "row")), "meets", most[1])
    open_ = materialize(at.groupBy("column").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("column", "least"), "open", most[1])
    inside = materialize(at.join(open_, "column").select("row", "n", "root", "least"), "inside", most[1])
    clusters = components(inside.select(F.col("root").alias("a"), F.col("least").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("cluster"))
    # classes a factor 100 / percent apart: rows that link are in the same or in adjacent ones
    grade = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    members = materialize(inside.select("row", "n", "root").distinct().join(clusters, "root").withColumn("grade", grade), "members", most[0])
    largest = members.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("cluster").agg(F.max(F.struct("k", "root"))["root"].alias("main"))
    loose = materialize(members.join(largest, "cluster").filter("root <> main").drop("main"), "loose", most[0])
    blocks = materialize(loose.groupBy("cluster", "grade").agg(F.greatest(F.ceil(2 * F.count(F.lit(1)) / F.lit(float(block_rows))), F.ceil(F.sum("n") / F.lit(4e6))).cast("int").alias("blocks")), "blocks", most[0])
    name = lambda block: F.xxhash64("cluster", "grade", block).alias("tile")  # noqa: E731  # tiles that share a name are compared as one
    pivots = loose.join(blocks, ["cluster", "grade"]).select(name(F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")), "row", "root")
    reach = members.select("cluster", "row", "root", F.explode(F.array(F.col("grade") - 1, F.col("grade"), F.col("grade") + 1)).alias("grade"))
    compared = reach.join(blocks, ["cluster", "grade"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    links = materialize(product(tiles(pivots, compared.select(name(F.col("block")), "row", "root"), block_rows, most[0]), rows, percent, parts), "more_links")
    discard(at, open_, inside, members, loose, blocks)
    return links


def joined_roots(roots: DataFrame, more: DataFrame) -> DataFrame:
    """``roots`` (node, root) once the components ``more`` of links between its roots are joined."""
    moved = roots.join(more.select(F.col("node").alias("_node"), F.col("root").alias("_root")), F.col("root") == F.col("_node"), "left")
    return moved.select("node", F.coalesce("_root", "root").alias("root")).unionByName(more.join(roots.select("node"), "node", "left_anti"))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 75, block_rows: int = 256) -> DataFrame:
    """Returns id, n_shingles, component_id: one row per row of ``docs``."""
    size, n_docs = docs.agg(F.sum(F.octet_length(text_col)), F.count(F.lit(1))).first()
    parts = max(shuffle_partitions(docs.sparkSession), -(-(size or 0) // BLOCK_BYTES))
    blocks = deal(incidence(docs, id_col, text_col, shingle, parts), parts)
    entries = materialize(shared_entries(blocks, parts), "entries")
    texts = entries.filter(F.col("kind") == DOCUMENT).select("id", "row", "n")
    owner = F.pmod(F.conv(F.hex(F.substring("row", 1, 7)), 16, 10).cast("long"), F.lit(parts)).cast("int")  # as part_of
    sized = entries.filter(F.col("kind") == ENTRIES).select("part", "rows", "counts", "hashes", "extra").unionByName(split_entries(entries, parts))
    sized = sized.unionByName(texts.filter("row IS NOT NULL").groupBy("row").agg(F.first("n").alias("n")).withColumn("part", owner), allowMissingColumns=True)
    rows = materialize(candidates(deal(sized, parts), parts, percent).withColumn("row", F.monotonically_increasing_id()), "rows")
    meets = materialize(rows.select("row", "n", "weight", F.explode(F.slice("entries", 1, F.col("prefix"))).alias("column")), "prefixes")
    most = rows.count(), meets.count()
    first = pivot_links(rows, meets, percent, block_rows, parts, most)
    roots = components(first)
    more = rest_links(rows, meets, roots, percent, block_rows, parts, most)
    if more.limit(1).count():
        roots = materialize(joined_roots(roots, components(more)), "all_roots", most[0])
    keyed = texts.filter("row IS NOT NULL")
    least = keyed.groupBy("row").agg(F.min("id").alias("least")).withColumnRenamed("row", "name")
    known = rows.select("name", F.col("row").alias("node")).join(roots, "node").select("name", "root")
    answer = materialize(known.join(least, "name"), "roots", most[0])
    smallest = answer.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = answer.select("name", "root").join(smallest, "root").select("name", "component_id")
    alone = least.join(known, "name", "left_anti").select("name", F.col("least").alias("component_id"))
    final = materialize(linked.unionByName(alone), "classes", n_docs)
    discard(rows, meets, first, more, answer)
    out = keyed.join(final, F.col("row") == F.col("name")).select("id", F.col("n").alias("n_shingles"), "component_id")
    none = texts.filter("row IS NULL").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return out.unionByName(none)
