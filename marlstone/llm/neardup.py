"""Near-duplicate sets of words by PartEnum signatures.

The feature domain (words) is partitioned into 2**20 cells by hash. Cells are ranked by how many sets touch them,
rarest first. For a size band (a set of a words against partners of like size) the similarity threshold bounds how
many of a set's cells a partner may lack; every set therefore enumerates subsets of its rarest cells, and any two
sufficiently similar sets of compatible size share the signature made of their rarest common cells. A subset grows
(one, two, three, at most four cells) until the number of sets expected under it is small. The enumeration is
complete, so no similar pair is lost; whatever a signature brings together is then filtered by packed 82-bit
parity sketches, whose distance never exceeds that of the sets, and at last compared word by word.

Texts with equal word sets are one class. Blank texts and those under min_words words are in no pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from marlstone.llm.wordscan import mix, parts, scan
from marlstone.session import cut

CELL_BITS = 20
WORD_BITS = 40
_M50 = np.uint64((1 << 50) - 1)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: A signature may bring together this share of all sets, at most SIG_MOST sets, as far as the cells' counts tell.
SIG_SHARE, SIG_MOST = 0.002, 1_000
#: A larger bucket is compared in blocks, as tasks of their own.
BUCKET_MOST, BLOCK = 16_384, 8_192
#: Buckets under this size are compared together.
SMALL = 40
#: Signatures of a set that are on disk at a time, and signature rows worth a pass; more are made in further passes.
AT_ONCE, WORTH = 32, 16_000_000
#: Signature rows of a task, about: 4 MB are compared in one, and a million are gathered before they are sent.
TASK_ROWS, SENT_ROWS = 200_000, 1 << 20
ROW = np.dtype([("sig", "<u4"), ("kl", "<u4"), ("kb", "<u8"), ("sk", "<u4")])
SETS = "sid string, did string, kb long, kl long, sk long, n int, words binary"


def size_code(n: np.ndarray) -> np.ndarray:
    """Six bits for a size: itself under 48, above in steps of 12 %."""
    return np.where(n < 48, n, np.minimum(63, 48 + np.floor(np.log(np.maximum(n, 48) / 48) / np.log(1.12)))).astype(np.uint64)


def size_most() -> np.ndarray:
    """The largest size of each code; the last has none."""
    return np.array([*range(48), *(int(48 * 1.12 ** (i + 1)) + 1 for i in range(15)), 1 << 40], dtype=np.int64)


def size_least() -> np.ndarray:
    return np.array([*range(48), *(int(48 * 1.12**i) - 1 for i in range(16))], dtype=np.int64)


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, word), sorted, each word of a row once; a word has WORD_BITS bits."""
    number, row, _, _ = scan(texts)
    key = np.unique((row.astype(np.uint64) << np.uint64(WORD_BITS)) | (number >> np.uint64(64 - WORD_BITS)))
    return (key >> np.uint64(WORD_BITS)).astype(np.int64), key & np.uint64((1 << WORD_BITS) - 1)


def pack(words: np.ndarray) -> np.ndarray:
    """Five bytes a word."""
    return np.ascontiguousarray(words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).reshape(-1)


def unpack(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets in words) of a column of packed sets."""
    blobs = blobs.cast(pa.large_binary())
    offsets = np.frombuffer(blobs.buffers()[1], dtype=np.int64)[blobs.offset : blobs.offset + len(blobs) + 1]
    data = np.frombuffer(blobs.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].reshape(-1, 5)
    wide = np.zeros((len(data), 8), dtype=np.uint8)
    wide[:, :5] = data
    return wide.view("<u8").reshape(-1), (offsets - offsets[0]) // 5


def _sets(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in parts(batch.column(2)):
            row, words = distinct_words(texts)
            if not len(row):
                continue
            n = np.bincount(row, minlength=len(texts))
            words = words[(n >= min_words)[row]]
            rows = np.flatnonzero(n >= min_words)
            if not len(rows):
                continue
            n = n[rows]
            ends = np.cumsum(n)
            heads = ends - n
            a, b = mix(words), mix(words + np.uint64(0x5851F42D4C957F2D))
            key = mix(np.add.reduceat(a, heads))
            place = b % np.uint64(82)
            bits = np.bitwise_xor.reduceat(np.where(place < 50, np.uint64(1) << (place % np.uint64(50)), np.uint64(0)), heads)
            more = np.bitwise_xor.reduceat(np.where(place >= 50, np.uint64(1) << (place - np.minimum(place, np.uint64(50))), np.uint64(0)), heads)
            kb = bits | (size_code(n) << np.uint64(50)) | ((key >> np.uint64(32) & np.uint64(0xFF)) << np.uint64(56))
            blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(np.concatenate([[0], ends * 5]).astype(np.int64)), pa.py_buffer(pack(words))]).cast(pa.binary())
            at = pa.array(rows + first)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(kb.astype(np.int64)), pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(more.astype(np.int64)), pa.array(n.astype(np.int32)), blob],
                names=["sid", "did", "kb", "kl", "sk", "n", "words"],
            )


def word_sets(df: DataFrame, id_col: str, doc_col: str | None, text_col: str, min_words: int) -> DataFrame:
    """(sid, did, kb, kl, sk, n, words) of every row with an id and at least min_words distinct words.

    (kb, kl) names the word set: kb holds 50 sketch bits, the size and 8 bits of its hash, kl 32 more.
    """
    rows = df.select(F.col(id_col).cast("string").alias("sid"), (F.col(doc_col).cast("string") if doc_col else F.lit(None).cast("string")).alias("did"), F.col(text_col).alias("text"))
    return rows.where("sid is not null and text is not null").mapInArrow(lambda it: _sets(it, min_words), SETS)


def cell_counts(sets: DataFrame) -> np.ndarray:
    """How many rows touch each cell; 2**CELL_BITS numbers whatever the data's size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                words, _ = unpack(batch.column(0))
                total += np.bincount((words & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64), minlength=1 << CELL_BITS)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + (1 << 16)].astype(np.int32)), pa.array(total[at[k : k + (1 << 16)]])], names=["cell", "n"])

    got = sets.select("words").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << CELL_BITS, dtype=np.int64)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return np.minimum(out, (1 << 43) - 1)


def only_classes(df: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of df whose class (kb, kl) is in named; both sides' rows meet in a semi join.

    Before it moves, df is thinned by a bitmap of 2**CELL_BITS bits over the hashes of the named classes.
    """
    cells = 1 << CELL_BITS
    got = named.select(F.pmod("kl", F.lit(cells)).cast("int").alias("c")).distinct().toArrow()
    bits = np.zeros(cells, dtype=bool)
    bits[got.column("c").to_numpy()] = True
    sent = df.sparkSession.sparkContext.broadcast(np.packbits(bits))  # 128 kB

    @F.pandas_udf("boolean")
    def maybe(kl: pd.Series) -> pd.Series:
        c = kl.to_numpy() % cells
        return pd.Series((sent.value[c >> 3] >> (7 - (c & 7)) & 1).astype(bool))

    return df.where(maybe("kl")).join(named, ["kb", "kl"], "left_semi")


class Plan:
    """The integer bounds of one threshold."""

    def __init__(self, threshold: float, min_words: int):
        self.t, self.min_words = Fraction(threshold).limit_denominator(10_000), min_words
        self.deepest = max(1, min(4, self.overlap(min_words, min_words) - 1))

    def overlap(self, a, b):
        """The least overlap of similar sets of a and b words."""
        p, q = self.t.numerator, self.t.denominator
        return -((-p * (a + b)) // (p + q))

    def lacking(self, a):
        """Most words of a set of a words that a similar set of any size can lack."""
        p, q = self.t.numerator, self.t.denominator
        return a - (-((-p * a) // q))

    def distance(self, a, b):
        return a + b - 2 * self.overlap(a, b)

    def farthest(self, least: int, most: int) -> int:
        """The largest distance of similar sets with least to most words together; it is not monotone in their sum.

        It grows by q - p when the sum grows by p + q, so the last p + q sums hold the maximum.
        """
        sums = np.arange(max(least, most - self.t.numerator - self.t.denominator + 1), most + 1)
        return int(self.distance(sums, 0).max())


def signatures(words: np.ndarray, offsets: np.ndarray, counts: np.ndarray, total: int, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) for the sets words[offsets[i]:offsets[i + 1]]."""
    n = np.diff(offsets)
    most = max(1.0, min(SIG_SHARE * total, SIG_MOST))
    out_i, out_s = [], []
    width_of = np.maximum(32, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    for width in np.unique(width_of):
        group = np.flatnonzero(width_of == width)
        step = max(1, (1 << 22) // (int(width) ** 2))
        for k in range(0, len(group), step):
            i, s = _enumerate(group[k : k + step], int(width), words, offsets, n, counts, total, plan, most)
            out_i += i
            out_s += s
    if not out_i:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_i), np.concatenate(out_s)


def _enumerate(rows, width, words, offsets, n, counts, total, plan, most):
    size = n[rows]
    pos = np.arange(width)
    inside = pos < size[:, None]
    cell = (words[np.minimum(offsets[rows][:, None] + pos, len(words) - 1)] & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64)
    key = np.where(inside, (counts[cell].astype(np.uint64) << np.uint64(CELL_BITS)) | cell.astype(np.uint64), _NONE)
    key.sort(axis=1)
    twice = (key[:, 1:] == key[:, :-1]) & (key[:, 1:] != _NONE)
    if twice.any():
        key[:, 1:][twice] = _NONE
        key.sort(axis=1)
    held = key != _NONE
    count = np.where(held, (key >> np.uint64(CELL_BITS)), np.uint64(1)).astype(np.float64)
    share = count / total
    usable = held & (count > 1)  # a cell that one row touches is shared with nobody
    lacking = plan.lacking(size)
    part = mix(key + np.uint64(0x9E3779B97F4A7C15))
    out_i, out_s = [], []

    level = [(np.arange(len(rows)), np.zeros(len(rows), np.uint64), np.full(len(rows), float(total)), np.zeros(len(rows), np.int64))]
    for depth in range(plan.deepest):
        after = []
        for at, chosen, expected, start in level:
            last = np.minimum(lacking[at] + depth, width - 1)
            low, high = int(start.min(initial=width)), int(last.max(initial=-1)) + 1
            step = max(1, (1 << 21) // max(1, high - low))
            pos = np.arange(low, high)
            for k in range(0, len(at), step):
                a, s = at[k : k + step], start[k : k + step, None]
                i, j = np.nonzero((pos >= s) & (pos <= last[k : k + step, None]) & usable[a, low:high])
                a, j = a[i], j + low
                e = expected[k : k + step][i] * share[a, j]
                h = mix(chosen[k : k + step][i] * np.uint64(3) + part[a, j])
                done = (e <= most) | (depth + 1 >= plan.deepest)
                out_i.append(rows[a[done]])
                out_s.append(h[done])
                go = ~done
                if go.any():
                    after.append((a[go], h[go], e[go], j[go] + 1))
        level = after
    return out_i, out_s


def _rows(batch: pa.RecordBatch, table: np.ndarray, total: int, plan: Plan, slices: int, own: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature rows, their 64-bit signatures) of one batch, those of slice own."""
    kb, kl, sk = (batch.column(i).to_numpy() for i in (0, 1, 2))
    words, offsets = unpack(batch.column(3))
    at, sig = signatures(words, offsets, table, total, plan)
    if slices > 1:
        keep = (sig >> np.uint64(56)) % np.uint64(slices) == own
        at, sig = at[keep], sig[keep]
    rec = np.empty(len(at), dtype=ROW)
    rec["sig"] = (sig & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    rec["kb"], rec["kl"], rec["sk"] = kb[at].view(np.uint64), kl[at].astype(np.uint32), sk[at].astype(np.uint32)
    return rec, sig


def _emit(batches: Iterator[pa.RecordBatch], counts, total: int, plan: Plan, buckets: int, slices: int = 1, own: int = 0) -> Iterator[pa.RecordBatch]:
    """Blobs of signature rows by bucket; copies of a set that this task has seen lately are skipped."""
    table, seen, held = counts.value, set(), []

    def out() -> pa.RecordBatch:
        rec, sig = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        held.clear()
        bucket = ((sig >> np.uint64(32) & np.uint64(0xFFFFFF)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rec, bucket = rec[order], bucket[order]
        heads = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        ends = np.r_[heads[1:], len(bucket)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[heads].astype(np.int32)), pa.array([rec[s:e].tobytes() for s, e in zip(heads, ends)], pa.binary())], names=["bucket", "blob"])

    for batch in batches:
        new = []
        for i, k in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if k not in seen:
                seen.add(k)
                new.append(i)
        if len(seen) > 200_000:
            seen.clear()
        if not new:
            continue
        rec, sig = _rows(batch.take(pa.array(new, pa.int64())), table, total, plan, slices, own)
        if len(rec):
            held.append((rec, sig))
        if sum(len(h[0]) for h in held) >= SENT_ROWS:
            yield out()
    if held:
        yield out()


def signature_rows(sets: DataFrame, counts, total: int, plan: Plan) -> int:
    """About how many signature rows the sets have, from those of a 64th of the word sets by their hash; it sizes tasks only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            if batch.num_rows:
                n += len(_rows(batch, counts.value, total, plan, 1, 0)[0])
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    few = sets.where(F.pmod("kl", F.lit(64)) == 0).select("kb", "kl", "sk", "words")
    return 64 * max(few.mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0, total // 64)


class _Compare:
    """Pairs of signature rows whose sketches allow the threshold."""

    def __init__(self, plan: Plan):
        self.plan, most = plan, size_most()
        self.most, self.least = most, size_least()
        a = np.minimum(most, 1 << 20)
        low = self.least
        self.allowed = np.array([[plan.farthest(int(lx + ly), int(x + y)) for ly, y in zip(low, a)] for lx, x in zip(low, a)])
        #: The most that is allowed to codes up to these.
        self.top = np.maximum.accumulate(np.maximum.accumulate(self.allowed, axis=0), axis=1)
        self.fits = np.array([[plan.overlap(int(lx), int(ly)) <= min(int(x), int(y)) for ly, y in zip(low, a)] for lx, x in zip(low, a)])

    @staticmethod
    @lru_cache(maxsize=4)
    def of(threshold: Fraction, min_words: int) -> _Compare:
        return _Compare(Plan(threshold, min_words))

    def refine(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        cx, cy = ((v["kb"] >> np.uint64(50) & np.uint64(63)).astype(np.int64) for v in (x, y))
        far = np.bitwise_count((x["kb"] ^ y["kb"]) & _M50).astype(np.int64) + np.bitwise_count(x["sk"] ^ y["sk"])
        return (far <= self.allowed[cx, cy]) & self.fits[cx, cy] & ((x["kb"] != y["kb"]) | (x["kl"] != y["kl"]))

    def block(self, x: np.ndarray, y: np.ndarray, same: bool) -> list[np.ndarray]:
        """Index pairs into x and y."""
        top = int(self.top[int((x["kb"] >> np.uint64(50) & np.uint64(63)).max()), int((y["kb"] >> np.uint64(50) & np.uint64(63)).max())])
        out, kx, ky = [], x["kb"] & _M50, y["kb"] & _M50
        for s in range(0, len(x), 256):
            for t in range(s if same else 0, len(y), 2048):
                i, j = np.nonzero(np.bitwise_count(kx[s : s + 256, None] ^ ky[None, t : t + 2048]) <= top)
                i, j = i + s, j + t
                if same:
                    keep = i < j
                    i, j = i[keep], j[keep]
                ok = self.refine(x[i], y[j])
                if ok.any():
                    out.append(np.stack([i[ok], j[ok]]))
        return out


def _pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows (kb1, kl1, kb2, kl2), the smaller class first, each once."""
    a = np.stack([x["kb"].view(np.int64), x["kl"].astype(np.int64), y["kb"].view(np.int64), y["kl"].astype(np.int64)], axis=1)
    swap = (a[:, 0] > a[:, 2]) | ((a[:, 0] == a[:, 2]) & (a[:, 1] > a[:, 3]))
    a[swap] = a[swap][:, [2, 3, 0, 1]]
    return np.unique(a, axis=0)


def _pair_batch(a: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.binary())
    return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(a[:, i])) for i in range(4)), pa.nulls(len(a), pa.int64()), none, none], names=["kb1", "kl1", "kb2", "kl2", "task", "x", "y"])


FOUND = "kb1 long, kl1 long, kb2 long, kl2 long, task long, x binary, y binary"


def _compare(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """The candidate pairs of one partition of signature rows; blocks of buckets over BUCKET_MOST come out as work for others."""
    blobs: dict[int, list[bytes]] = {}
    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            blobs.setdefault(b, []).append(blob)
    compare = _Compare.of(plan.t, plan.min_words)
    for b in list(blobs):
        rec = np.frombuffer(b"".join(blobs.pop(b)), dtype=ROW)
        order = (rec["sig"].astype(np.uint64) << np.uint64(32)) | rec["kl"]
        at = np.argsort(order)
        rec, order = rec[at], order[at]
        rec = rec[np.r_[True, (order[1:] != order[:-1]) | (rec["kb"][1:] != rec["kb"][:-1])]]  # a set that several tasks sent
        sig, kb = rec["sig"], np.ascontiguousarray(rec["kb"])
        heads = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        size = np.diff(np.r_[heads, len(sig)])
        found = []
        own = np.repeat(size, size)
        code = (kb >> np.uint64(50) & np.uint64(63)).astype(np.int64)
        top = int(compare.top[code.max(), code.max()])
        at = np.flatnonzero((own > 1) & (own < SMALL))  # small buckets all at once, row against the row lag places on
        for lag in range(1, SMALL):
            if lag in (1, 3, 6, 12, 24):
                at = at[own[at] > lag]
                s_at, k_at = sig[at], kb[at] & _M50
            if lag >= len(at):
                break
            i = np.flatnonzero((np.bitwise_count(k_at[lag:] ^ k_at[:-lag]) <= top) & (s_at[lag:] == s_at[:-lag]))
            if len(i):
                x, y = at[i], at[i + lag]
                ok = compare.refine(rec[x], rec[y])
                found.append((x[ok], y[ok]))
        for h, s in zip(heads[size >= SMALL].tolist(), size[size >= SMALL].tolist()):
            if s <= BUCKET_MOST:
                for i, j in compare.block(rec[h : h + s], rec[h : h + s], True):
                    found.append((i + h, j + h))
                continue
            cuts = [*range(h, h + s, BLOCK), h + s]
            blocks = [rec[p:q].tobytes() for p, q in zip(cuts, cuts[1:])]
            for p in range(len(blocks)):
                for q in range(p, len(blocks)):
                    task = int(mix(np.array([int(sig[h]) * 4_000_037 + p * 2_003 + q], dtype=np.uint64))[0] >> np.uint64(1))
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(4)), pa.array([task], pa.int64()), pa.array([blocks[p]], pa.binary()), pa.array([blocks[q] if q > p else None], pa.binary())], names=["kb1", "kl1", "kb2", "kl2", "task", "x", "y"])
        if found:
            yield _pair_batch(_pairs(rec[np.concatenate([f[0] for f in found])], rec[np.concatenate([f[1] for f in found])]))


def _work(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    compare = _Compare.of(plan.t, plan.min_words)
    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a = np.frombuffer(x, dtype=ROW)
            b = np.frombuffer(y, dtype=ROW) if y is not None else a
            got = compare.block(a, b, y is None)
            if got:
                ij = np.concatenate(got, axis=1)
                p = _pairs(a[ij[0]], b[ij[1]])
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(p[:, i])) for i in range(4)], names=["kb1", "kl1", "kb2", "kl2"])


def _verify(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    p, q = plan.t.numerator, plan.t.denominator
    for batch in batches:
        if not batch.num_rows:
            continue
        (x, ox), (y, oy) = unpack(batch.column(4)), unpack(batch.column(5))
        nx, ny = np.diff(ox), np.diff(oy)
        pair = np.concatenate([np.repeat(np.arange(len(nx)), nx), np.repeat(np.arange(len(ny)), ny)]).astype(np.uint64)
        key = np.sort((pair << np.uint64(WORD_BITS)) | np.concatenate([x, y]))
        both = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(WORD_BITS)).astype(np.int64), minlength=len(nx))
        either = nx + ny - both
        ok = both * q >= p * either
        if ok.any():
            kept = batch.select(["kb1", "kl1", "kb2", "kl2"]).filter(pa.array(ok))
            yield kept.append_column("similarity", pa.array((both / either)[ok]))


def class_pairs(sets: DataFrame, threshold: float, min_words: int) -> DataFrame:
    """(kb1, kl1, kb2, kl2, similarity): each pair of different word sets with at least that similarity, once.

    sets is read several times; the caller persists it.
    """
    spark, plan = sets.sparkSession, Plan(threshold, min_words)
    total = sets.count()
    if not total:
        return spark.createDataFrame([], "kb1 long, kl1 long, kb2 long, kl2 long, similarity double")
    counts = spark.sparkContext.broadcast(cell_counts(sets))  # 2**CELL_BITS numbers, 8 MB at any scale
    rows = signature_rows(sets, counts, total, plan)
    slices = max(1, -(-rows // max(AT_ONCE * total, WORTH)))
    tasks = max(rows // slices // TASK_ROWS, min(spark.sparkContext.defaultParallelism, rows // slices // 10_000), 1)

    def candidates(own: int) -> DataFrame:
        """Candidates that passed the sketches, and the blocks of the largest buckets, of one slice of the signatures."""
        blobs = sets.select("kb", "kl", "sk", "words").mapInArrow(lambda it: _emit(it, counts, total, plan, tasks, slices, own), "bucket int, blob binary")
        return cut(blobs.repartitionById(tasks, "bucket").mapInArrow(lambda it: _compare(it, plan), FOUND))

    found = reduce(DataFrame.unionByName, [candidates(own) for own in range(slices)])
    few = found.where("task is null").select("kb1", "kl1", "kb2", "kl2")
    work = found.where("task is not null").repartition("task").select("x", "y").mapInArrow(lambda it: _work(it, plan), "kb1 long, kl1 long, kb2 long, kl2 long")
    pairs = few.unionByName(work).distinct()
    pairs = cut(pairs)
    named = pairs.select(F.col("kb1").alias("kb"), F.col("kl1").alias("kl")).union(pairs.select("kb2", "kl2")).distinct()
    words = only_classes(sets.select("kb", "kl", "words"), named).groupBy("kb", "kl").agg(F.first("words").alias("words"))
    one = words.select(F.col("kb").alias("kb1"), F.col("kl").alias("kl1"), F.col("words").alias("x"))
    two = words.select(F.col("kb").alias("kb2"), F.col("kl").alias("kl2"), F.col("words").alias("y"))
    both = pairs.join(one, ["kb1", "kl1"]).join(two, ["kb2", "kl2"]).select("kb1", "kl1", "kb2", "kl2", "x", "y")
    return both.mapInArrow(lambda it: _verify(it, plan), "kb1 long, kl1 long, kb2 long, kl2 long, similarity double")


def similar_pairs(df: DataFrame, id_col: str, doc_col: str, text_col: str, threshold: float = 0.7, min_words: int = 12) -> DataFrame:
    """(sentence_id_a, sentence_id_b, similarity): pairs of different ids with different documents, smaller id first.

    Similarity is the number of distinct words in both over those in either. An id delivered with several texts
    counts with each of them, its best similarity is kept. Rows without id, document or text have no pairs. All
    pairs come out, copies included: use near_duplicate_groups for a form whose size follows the rows.
    """
    sets = word_sets(df, id_col, doc_col, text_col, min_words).persist(StorageLevel.MEMORY_AND_DISK)
    near = cut(class_pairs(sets, threshold, min_words))
    members = sets.where("did is not null").select("sid", "did", "kb", "kl")
    copied = sets.groupBy("kb", "kl").count().where("count > 1").select("kb", "kl")
    wanted = near.select(F.col("kb1").alias("kb"), F.col("kl1").alias("kl")).union(near.select("kb2", "kl2")).union(copied).distinct()
    members = only_classes(members, cut(wanted)).distinct()
    a = members.select(F.col("kb").alias("kb1"), F.col("kl").alias("kl1"), F.col("sid").alias("sid1"), F.col("did").alias("did1"))
    b = members.select(F.col("kb").alias("kb2"), F.col("kl").alias("kl2"), F.col("sid").alias("sid2"), F.col("did").alias("did2"))
    apart = near.join(a, ["kb1", "kl1"]).join(b, ["kb2", "kl2"]).where("did1 <> did2 and sid1 <> sid2").select("sid1", "sid2", "similarity")
    alike = a.join(b, (F.col("kb1") == F.col("kb2")) & (F.col("kl1") == F.col("kl2")) & (F.col("sid1") < F.col("sid2")) & (F.col("did1") != F.col("did2"))).select("sid1", "sid2", F.lit(1.0).alias("similarity"))
    return (
        apart.unionByName(alike)
        .groupBy(F.least("sid1", "sid2").alias("sentence_id_a"), F.greatest("sid1", "sid2").alias("sentence_id_b"))
        .agg(F.max("similarity").alias("similarity"))
    )


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of the graph (a, b): its connected components, root the smallest node. Nodes without edges are absent.

    Large-star and small-star rounds; each shuffles edges alone, none gathers a component. It raises if rounds are too few.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = cut(small.where("u <> v").distinct())
        same = new.count() == e.count() and not new.exceptAll(e).take(1)
        e = new
        if same:
            break
    else:
        raise RuntimeError(f"the components did not settle in {rounds} rounds")
    return e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct().join(e.select(F.col("u").alias("node")).distinct(), "node", "left_anti"))


def _across(sets: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, ids, active) of the class pairs and copies whose rows have different ids and documents.

    edges are the class pairs of near with such rows, ids link classes that share an id, active are the classes with
    such rows in an edge or among their own copies. Of a class up to five members stand for all: one, the two of least
    and greatest document without its id, and the two of least and greatest id without its document. Whatever id and
    document a row of another class has, if any member differs in both, one of the five does.
    """
    by = ["kb", "kl"]
    copied = sets.groupBy(*by).count().where("count > 1").select(*by)
    wanted = near.select(F.col("kb1").alias("kb"), F.col("kl1").alias("kl")).union(near.select("kb2", "kl2")).union(copied).distinct()
    members = cut(only_classes(sets.where("did is not null").select("sid", "did", *by), cut(wanted)).distinct())
    one = members.groupBy(*by).agg(F.min(F.struct("sid", "did")).alias("one"))
    doc = F.when(F.col("sid") != F.col("one.sid"), F.struct("did", "sid"))
    own = F.when(F.col("did") != F.col("one.did"), F.struct("sid", "did"))
    few = members.join(one, by).groupBy(*by).agg(F.first("one").alias("a"), F.min(doc).alias("b"), F.max(doc).alias("c"), F.min(own).alias("d"), F.max(own).alias("e"))
    few = cut(few.select(*by, F.filter(F.array(*(F.when(F.col(x).isNotNull(), F.struct(F.col(f"{x}.sid").alias("sid"), F.col(f"{x}.did").alias("did"))) for x in "abcde")), lambda m: m.isNotNull()).alias("m")))
    differ = lambda x, y: F.exists(x, lambda p: F.exists(y, lambda q: (p["sid"] != q["sid"]) & (p["did"] != q["did"])))
    x, y = (few.select(F.col("kb").alias(f"kb{i}"), F.col("kl").alias(f"kl{i}"), F.col("m").alias(f"m{i}")) for i in (1, 2))
    edges = cut(near.join(x, ["kb1", "kl1"]).join(y, ["kb2", "kl2"]).where(differ("m1", "m2")).select("kb1", "kl1", "kb2", "kl2"))
    active = cut(edges.select(F.col("kb1").alias("kb"), F.col("kl1").alias("kl")).union(edges.select("kb2", "kl2")).union(few.where(differ("m", "m")).select(*by)).distinct())
    held = members.select("sid", *by).distinct().join(active, by, "left_semi")
    least = held.groupBy("sid").agg(F.min(F.struct(*by)).alias("l"), F.count("*").alias("n")).where("n > 1").select("sid", "l")
    ids = held.join(least, "sid").where("kb <> l.kb or kl <> l.kl").select(F.col("l.kb").alias("kb1"), F.col("l.kl").alias("kl1"), F.col("kb").alias("kb2"), F.col("kl").alias("kl2")).distinct()
    return edges, ids, active


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.7, min_words: int = 12, doc_col: str | None = None) -> DataFrame:
    """(id, class_id, group_id, links): one row for each id and word set; links counts similar other word sets.

    Copies share a class; groups are the connected classes, named by their smallest class. Ids whose text is null,
    blank or short are left out. Repeated rows give one row.

    With doc_col groups are those of the pairs of similar_pairs: a link needs rows of different ids and documents, an
    id of several texts joins their groups, and an id without a pair, or without a document, has a group of its own.
    """
    sets = word_sets(df, id_col, doc_col, text_col, min_words).persist(StorageLevel.MEMORY_AND_DISK)
    near = cut(class_pairs(sets, threshold, min_words))
    name = lambda b, l: F.concat_ws("-", F.hex(b), F.hex(l))
    named = lambda pairs: pairs.select(name(F.col("kb1"), F.col("kl1")).alias("a"), name(F.col("kb2"), F.col("kl2")).alias("b"))
    ids = active = None
    if doc_col:
        near, ids, active = _across(sets, near)
    edges = named(near)
    links = edges.select(F.col("a").alias("class_id")).union(edges.select("b")).groupBy("class_id").agg(F.count("*").alias("links"))
    groups = components(edges.union(named(ids)) if doc_col else edges).select(F.col("node").alias("class_id"), F.col("root").alias("group_id"))
    if not doc_col:
        rows = sets.select(F.col("sid").alias("id"), name(F.col("kb"), F.col("kl")).alias("class_id")).distinct()
        return rows.join(groups.join(links, "class_id"), "class_id", "left").select("id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    kept = active.select("kb", "kl", name(F.col("kb"), F.col("kl")).alias("class_id")).join(groups, "class_id", "left").join(links, "class_id", "left")
    kept = kept.select("kb", "kl", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    rows = sets.groupBy("sid", "kb", "kl").agg(F.max(F.col("did").isNotNull()).alias("has")).join(kept, ["kb", "kl"], "left")
    paired = F.col("has") & F.col("group_id").isNotNull()
    class_id = name(F.col("kb"), F.col("kl"))
    return rows.select(F.col("sid").alias("id"), class_id.alias("class_id"), F.when(paired, F.col("group_id")).otherwise(F.concat_ws("-", class_id, F.col("sid"))).alias("group_id"), F.when(paired, F.col("links")).otherwise(0).alias("links"))
