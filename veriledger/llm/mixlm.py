"""Language model scoring by online logistic context mixing.

A text is its tokens, lower-cased, each followed by a space, and an end mark. Its bytes are coded
in order, each as the decisions of a Huffman tree that the two bytes before it in the token pick. For
a decision, predictors
look up hashed contexts that run over the whole text - the last 2 and 4 bytes, across token
borders, the beginning of the token, and that with the token before - in counts of the training
rows, and one more predictor counts what the text itself has had after such a beginning. Their
stretched probabilities are added with weights that a gate picks by how often the two longest
contexts were seen; a final stage maps the sum to a probability (in scoring, by steps of 1/32). Weights and final stage start from
what they learn online over all training rows, whose own occurrence is left out of the counts; while a
text is read its weights move down the coding cost's gradient, and its own counters count, after
every piece of it (256 bytes, later pieces are longer). All bits' costs add up to the score.

Counts cover all training rows. Tables grow with the training bytes, from SLOT_BITS[0] to
SLOT_BITS[1] bits a context - what a worker can hold; beyond that, contexts share slots. Token
counts are exact at any size: blocks of documents send their distinct tokens to ranges of tokens (by
hash), which add them up and answer.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriledger.llm.arrays import keep_memory
from veriledger.llm.common import discard, store

FOLDS, HELD_OUT = 7, 2
#: Bytes of text of a block, and of the corpus for each range of tokens.
BLOCK, RANGE = 8 << 20, 16 << 20
#: Least and most bits of slot numbers of the large tables; training bytes for each slot between.
SLOT_BITS, SLOT_BYTES = (22, 24), 64
#: Contexts: last 2 and 4 bytes, beginning of the token, that and the token before; those that are
#: counted at once.
ORDERS, N_CONTEXTS = (2, 4), 4
BEGUN, AFTER = 2, 3
TOGETHER = ((0, 1), (BEGUN, AFTER))
#: Slots of the tables that are merged and sent on their own; training text for each counting task.
PART, COUNTED = 1 << 17, 64 << 20
PRIOR, SEEN = 0.03, (0.5, 2.5, 15.5)
#: Nodes of a tree with its escape; pairs of bytes with less than this share of all have no tree of
#: their own.
NODES, RARE = 512, 2**-14
N_INPUTS, GATES, STEPS = N_CONTEXTS + 2, 32, 49  # contexts, own history, bias
ROOM = 8  # numbers that a cell's weights take
#: Bytes of text worked on at once, mixed at once, and brought together when they are counted; bits of
#: a symbol.
CHUNK, MIXED, SORTED, SYMBOL_BITS = 1 << 15, 1 << 17, 2 << 20, 32
#: Ends of a text's pieces, then every PIECE bytes.
ENDS, PIECE = (256, 512, 1024, 2048, 4096, 8192), 8192
RATE, CALM = 1.0, 48.0
END = b"\n"  # the token that ends a text; words can't have it


def held_out(doc_id):
    """crc32 of the id's text leaves HELD_OUT over FOLDS. A null id reads as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def expand(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def pack(a: np.ndarray) -> bytes:
    return squeeze(a.tobytes())


def unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(expand(b), kind)


# ---------------------------------------------------------------- bytes, contexts, decisions


def slot_bits(train_bytes: int) -> tuple[int, ...]:
    """Bits of the slot numbers of each context's table."""
    large = min(max(int(np.log2(max(train_bytes, 1) / SLOT_BYTES + 1)), SLOT_BITS[0]), SLOT_BITS[1])
    return 20, large, large, large


def huffman(often: dict[int, int]) -> dict[int, list[int]]:
    """2 * inner node + bit of each decision of a symbol; nodes near the root have small numbers."""
    heap = [(n, b, None) for b, n in often.items()]
    heapq.heapify(heap)
    number = NODES
    while len(heap) > 1:
        x, y = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (x[0] + y[0], number, (x, y)))
        number += 1
    level, inner, out = [(heap[0], [])], 0, {}
    while level:
        after = []
        for (_, b, kids), path in level:
            if kids is None:
                out[b] = path
                continue
            after += [(kid, [*path, 2 * inner + bit]) for bit, kid in enumerate(kids)]
            inner += 1
        level = after
    return out


class Code:
    """Huffman codes of bytes, one for each frequent pair of bytes before, or else byte before. Bytes
    that were not seen there follow an escape, with eight decisions. keys: three bytes as a number,
    the last one lowest; often: how often they come."""

    def __init__(self, keys: np.ndarray, often: np.ndarray):
        self.tree = np.zeros(1 << 16, np.int32)
        eight = np.array([[2 * (256 + (1 << i | b >> 8 - i)) + (b >> 7 - i & 1) for i in range(8)] for b in range(256)], np.int16)
        depths, flat, size = [], [], 0
        firsts = []

        def add(symbols: np.ndarray, n: np.ndarray) -> int:
            nonlocal size
            paths = huffman({-1: 1} | dict(zip(symbols.tolist(), (n * 256).tolist(), strict=True)))
            escape = np.array(paths.pop(-1), np.int16)
            depth, first = np.full(256, len(escape) + 8), np.empty(256, np.int64)
            other = np.setdiff1d(np.arange(256), symbols)
            first[other] = size + np.arange(len(other)) * (len(escape) + 8)
            flat.append(np.concatenate([np.tile(escape, (len(other), 1)), eight[other]], 1).ravel())
            size += flat[-1].size
            for b, path in paths.items():
                depth[b], first[b] = len(path), size
                flat.append(np.array(path, np.int16))
                size += len(path)
            depths.append(depth)
            firsts.append(first)
            return len(depths) - 1

        def summed(of: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            found, at = np.unique(of, return_inverse=True)
            return found, np.bincount(at, n, len(found)).astype(np.int64)

        add(*summed(keys & 255, often))
        one, pair = keys >> 8 & 255, keys >> 8
        for b in np.unique(one).tolist():
            here = one == b
            self.tree[np.arange(256) << 8 | b] = add(*summed(keys[here] & 255, often[here]))
        pairs, n = summed(pair, often)
        for p in pairs[(n >= RARE * often.sum()) & (pairs & 255 != 32)].tolist():
            here = slice(*np.searchsorted(pair, [p, p + 1]))
            self.tree[p] = add(keys[here] & 255, often[here])
        self.depth, self.first = (np.concatenate(x) for x in (depths, firsts))
        self.both = np.concatenate(flat)

    def symbols(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """tree * 256 + byte of each byte; a text begins as after a space."""
        return self.tree.take(before(data, starts)) * 256 + data

    def decisions(self, symbols: np.ndarray, groups: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """(place of its byte, 2 * node + bit) of all decisions; where the decisions of groups of bytes
        end, if it is given where their bytes end."""
        d = self.depth.take(symbols)
        ends = np.cumsum(d)
        of = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        of[ends[:-1]] = 1  # every byte has a decision
        np.cumsum(of, out=of)
        at = (self.first.take(symbols) - ends + d).take(of)
        at += np.arange(len(of))
        both = self.both.take(at).astype(np.int64)
        return (of, both) if groups is None else (of, both, ends[groups - 1])


def before(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The two bytes before each byte, as a number; spaces before a text."""
    wide = data.astype(np.int32)
    last, second = (np.concatenate([np.full(k, 32, np.int32), wide[:-k]])[: len(wide)] for k in (1, 2))
    last[starts], second[starts], second[np.minimum(starts + 1, len(wide) - 1)] = 32, 32, 32
    return second << 8 | last


def stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, each with its end; where each begins). Texts are words with one space
    between."""
    whole = [t + b" \n" if t else END for t in texts]
    size = np.fromiter(map(len, whole), np.int64, len(whole))
    return np.frombuffer(b"".join(whole), np.uint8), np.cumsum(size) - size


def earlier(of: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """What stands k bytes before; 0 for the first k bytes of a text, whatever texts lie there."""
    out = np.zeros_like(of)
    out[k:] = of[:-k]
    for j in range(k):
        out[(starts + j)[starts + j < len(of)]] = 0
    return out


def added(at: np.ndarray, cells: int, first: np.ndarray | float, second: np.ndarray | float, by: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums of two columns, times `by`, in each cell: both at once, as a complex number."""
    two, out = np.empty(len(at), np.complex64), np.zeros(cells, np.complex64)
    for v, part in ((first, two.real), (second, two.imag)):
        if by is None or np.isscalar(v):
            part[:] = v if by is None else v * by
        else:
            np.multiply(v, by, out=part)
    np.add.at(out, at, two)
    return out.real, out.imag


def contexts(data: np.ndarray, starts: np.ndarray, bits: tuple[int, ...], which: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """(for each of these contexts the slot of a byte's node 0 in its table - node n has that number
    xor n, so that nodes near the root lie in one line of the cache -; whether a byte begins a token).
    After the last table comes, for BEGUN, the hash itself."""
    n = len(data)
    begins = np.zeros(n, bool)
    begins[1:] = data[:-1] == 32
    begins[starts] = True
    wide, found = data.astype(np.uint64) + np.uint64(1), {}
    if min(which) < len(ORDERS):
        last, have = earlier(wide, starts, 1), 1
        for i, k in enumerate(ORDERS):  # each has twice the bytes of the one before
            while have < k:
                more = earlier(last, starts, have)
                more <<= np.uint64(9 * have)
                more |= last
                last, have = more, 2 * have
            if i in which:
                found[i] = last.copy()
    if max(which) >= BEGUN:  # beginnings of tokens: a polynomial hash, as a running sum
        first = np.flatnonzero(begins)
        size = np.diff(np.append(first, n))
        place = np.arange(n) - np.repeat(first, size)
        power = np.cumprod(np.full(int(size.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
        total = np.concatenate([[np.uint64(0)], np.cumsum(wide * power.take(place))])
        found[BEGUN] = total[:-1] - np.repeat(total[first], size) + np.uint64(0xD6E8FEB86659FD93) * place.astype(np.uint64)
        word = total[first + size] - total[first]
        before = np.concatenate([[np.uint64(0)], word[:-1]])
        before[np.searchsorted(first, starts)] = 0  # a text's first token has none before it
        if AFTER in which:
            found[AFTER] = found[BEGUN] ^ np.repeat((before + np.uint64(1)) * np.uint64(0xA24BAED4963EE407), size)
    out = []
    for k in which:
        h = found[k]
        h += np.uint64(k + 1)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        out.append((h >> np.uint64(64 - bits[k])).astype(np.int64))
    if BEGUN in which:
        out.append(found[BEGUN])
    return out, begins


def pieces(texts: list[bytes], size: int = CHUNK) -> Iterator[list[bytes]]:
    """Lists of texts of about `size` bytes."""
    some, n = [], 0
    for t in texts:
        some.append(t)
        n += len(t)
        if n >= size:
            yield some
            some, n = [], 0
    if some:
        yield some


def count(texts: list[bytes], code: Code, bits: tuple[int, ...], which: tuple[int, ...], counts: list[np.ndarray]) -> None:
    """Adds the decisions of texts to the counts of these contexts, at 2 * slot + bit. Equal bytes in
    equal contexts are brought together by a sort, so that their decisions are added once."""
    times: dict[int, list[bytes]] = {}
    for text, n in Counter(texts).items():
        times.setdefault(n, []).append(text)
    for n, alike in times.items():
        for many in pieces(alike, SORTED):
            keys: list[list[np.ndarray]] = [[] for _ in which]
            for some in pieces(many):
                data, starts = stream(some)
                symbols = code.symbols(data, starts)
                base, _ = contexts(data, starts, bits, which)
                for b, k in zip(base, keys, strict=False):
                    b <<= SYMBOL_BITS
                    b |= symbols
                    k.append(b)
            for k, table in zip(keys, counts, strict=True):
                _add(np.concatenate(k), n, code, table)


def _add(keys: np.ndarray, n: int, code: Code, table: np.ndarray) -> None:
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    often = (np.diff(np.append(first, len(keys))) * n).astype(np.uint32)
    keys = keys.take(first)
    for lo in range(0, len(keys), CHUNK):
        some = keys[lo : lo + CHUNK]
        of, both = code.decisions(some & ((1 << SYMBOL_BITS) - 1))
        at = (some >> SYMBOL_BITS << 1).take(of)
        at ^= both
        np.add.at(table, at, often[lo : lo + CHUNK].take(of))


SCALE = np.float32(1 / 2048)
#: Steps of a sum of stretched probabilities, up to 12 either way, for which costs and errors are kept.
FINE, SUMS = 32, 2 * 12 * 32
#: The coding error, bit less its probability, at 2 * step + bit.
ERROR = (np.arange(2) - 1 / (1 + np.exp(12 - (np.arange(SUMS)[:, None] + 0.5) / FINE))).astype(np.float32).ravel()


class Model:
    """Predictions by slot (see quantise), byte code, mixer weights and final stage. Teaching reads
    `less`, scoring reads `s`; the other one may be absent."""

    def __init__(self, bits: tuple[int, ...], code: Code, less: list[np.ndarray], s: list[np.ndarray]):
        self.bits, self.code, self.less, self.s = bits, code, less, s
        self.w = np.zeros((N_INPUTS, GATES), np.float32)
        self.w[:N_CONTEXTS] = 0.3
        self.final = np.tile(np.linspace(-12, 12, STEPS, dtype=np.float32), GATES)

    def __setstate__(self, state: dict) -> None:
        """NumPy's own memory has large pages, a pickle's bytes don't."""
        self.__dict__.update(state)
        self.less, self.s = ([a.copy() for a in x] for x in (self.less, self.s))

    @staticmethod
    def quantise(n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(less, s). s: 2048 times the stretched probability of each slot, its last two bits for how
        often the slot was seen: never, once or twice, up to 15 times, more. less: the same at
        2 * slot + bit, with one such bit fewer."""
        seen = np.flatnonzero(n0 + n1)
        n0, n1, size = n0[seen], n1[seen], len(n0)

        def stretched(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
            s = np.rint(np.clip(np.log((n1 + PRIOR) / (n0 + PRIOR)), -12, 12) / SCALE).astype(np.int16)
            return s & ~np.int16(3) | sum((n0 + n1 > x).astype(np.int16) for x in SEEN)

        less, s = np.zeros((size, 2), np.int16), np.zeros(size, np.int16)
        less[seen, 0], less[seen, 1] = stretched(np.maximum(n0 - 1, 0), n1), stretched(n0, np.maximum(n1 - 1, 0))
        s[seen] = stretched(n0, n1)
        return less.ravel(), s

    def prices(self) -> np.ndarray:
        """Cost of a bit, by the final stage, at (gate * SUMS + step of the sum) * 2 + bit."""
        at = (np.arange(SUMS) + 0.5) * ((STEPS - 1) / SUMS)
        y = np.stack([np.interp(at, np.arange(STEPS), f) for f in self.final.reshape(GATES, STEPS)])
        return np.logaddexp(0, np.stack([y, -y], -1)).astype(np.float32).ravel()

    def costs(self, texts: list[bytes], teach: bool = False) -> np.ndarray:
        """log2 of the probability of each text. teach: in place of that, learn the start of weights
        and final stage from texts that are among those counted, leaving each decision out once."""
        out = np.zeros(len(texts))
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        at, prices = 0, None if teach else self.prices()
        for some in pieces([texts[i] for i in order], MIXED):
            out[order[at : at + len(some)]] = self._some(some, teach, prices)
            at += len(some)
        return out

    def _some(self, texts: list[bytes], teach: bool, prices: np.ndarray | None = None) -> np.ndarray:
        if prices is None and not teach:
            prices = self.prices()
        data, starts = stream(texts)
        lanes, size = len(starts), np.diff(np.append(starts, len(data)))
        base, begins = contexts(data, starts, self.bits, tuple(range(N_CONTEXTS)))
        # the own counters of each text: 4 slots a byte
        room = 4 * size + NODES
        base[-1] = ((base[-1] >> np.uint64(32)) * np.repeat(room - NODES, size).astype(np.uint64) >> np.uint64(32)).astype(np.int64) + np.repeat(np.cumsum(room) - room, size)
        own = np.full(int(room.sum()), 0.4 + 0.4j, np.complex64)  # of 0, of 1: taken at once
        counts = own.view(np.float32)
        table = self.less if teach else self.s
        for b in base if teach else base[-1:]:
            b <<= 1
        cells = GATES if teach else lanes * GATES
        group, symbols = begins.astype(np.int64), self.code.symbols(data, starts)
        if not teach:
            group += np.repeat(np.arange(0, cells, GATES), size)
        # predictions are added as 2048ths, their weights are scaled instead; a cell's weights lie together
        scale = np.array([SCALE] * N_CONTEXTS + [1, 1], np.float32)
        w = np.zeros((cells // GATES, GATES, ROOM), np.float32)
        w[:, :, :N_INPUTS] = (self.w * scale[:, None]).T
        w = w.reshape(cells, ROOM)
        rows = w.view(f"V{4 * ROOM}").ravel()
        total = np.zeros(lanes)
        done, end = 0, 0
        while end < (longest := int(size.max())):  # all texts' pieces of the same place
            done, end = end, min(ENDS[bisect_right(ENDS, end)] if end < ENDS[-1] else end + PIECE, longest)
            here = np.flatnonzero(size > done)
            n = np.minimum(size[here], end) - done
            ends = np.cumsum(n)
            by = np.arange(int(ends[-1]))
            by += np.repeat(starts[here] + done - ends + n, n)
            of, both, ends = self.code.decisions(symbols.take(by), ends)
            of = by.take(of)
            node, bit, x, gate = None if teach else both >> 1, both & 1, [], 0
            for k in range(N_CONTEXTS):
                at = base[k].take(of)
                at ^= both if teach else node
                s = table[k].take(at)
                x.append(s.astype(np.float32))
                if k >= BEGUN:
                    s &= 3
                    s <<= 1 if k == BEGUN else 3
                    gate = gate + s
            cell = group.take(of)
            cell += gate
            mine = base[-1].take(of)
            mine += both
            if done:  # a text's first piece has nothing before it
                had = own.take(mine >> 1)
                x.append(np.log(had.imag / had.real))
            own_w = rows.take(cell).view(np.float32).reshape(-1, ROOM)
            z = own_w[:, N_INPUTS - 1].copy()
            for k, v in enumerate(x):
                z += own_w[:, k] * v
            np.minimum(np.maximum(z, np.float32(-11.9), out=z), np.float32(11.9), out=z)
            if teach:
                f = z * 2
                f += 24
                low = f.astype(np.int64)
                f -= low
                cell_at = cell * STEPS
                cell_at += low
                y = self.final.take(cell_at)
                y += (self.final.take(cell_at + 1) - y) * f
                cell_at += f > 0.5
                bit = bit.astype(np.float32)
                off, n = added(cell_at, GATES * STEPS, bit - 1 / (1 + np.exp(-y)), 1.0)
                self.final += off / (n + np.float32(CALM))
                error = bit - 1 / (1 + np.exp(-z))
            else:
                z += 12
                z *= FINE
                step = z.astype(np.int64)
                step *= 2
                step += bit
                error = ERROR.take(step)
                step += (cell & (GATES - 1)) * (2 * SUMS)
                total[here] += np.add.reduceat(prices.take(step), np.concatenate([[0], ends[:-1]]), dtype=np.float64)
                if end == longest:
                    break
            x += [0.0] * (N_CONTEXTS + 1 - len(x)) + [1.0]
            calm = RATE / (np.bincount(cell, minlength=cells) + CALM)
            for k in range(0, N_INPUTS, 2):
                for j, off in enumerate(added(cell, cells, x[k], x[k + 1], error), k):
                    w[:, j] += calm * float(scale[j]) ** 2 * off
            if end < longest:
                np.add.at(counts, mine, np.float32(1))
        if teach:
            self.w = w[:, :N_INPUTS].T / scale[:, None]
        return total / -np.log(2)


# ---------------------------------------------------------------- passes over the data

ROW = ["kind", "block", "range", "doc_id", "held_out", "n_tokens", "a", "b"]
BYTES, DOC, ASK, WORDS = 3, 2, 1, 0


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), id_type, pa.bool_(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ROW)


def encode(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows DOC (a text's words), ASK (a block's distinct tokens of a range, with their training
    counts) and BYTES (a block's training bytes by the two before), stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        task, block = TaskContext.get().partitionId(), 0
        learned: Counter[bytes] = Counter()
        other: set[bytes] = set()
        whole: list[bytes] = []
        size, id_type = 0, pa.int64()

        def flush() -> Iterator[pa.RecordBatch]:
            words = [*learned, *(w for w in other if w not in learned)]
            counts = np.zeros(len(words), np.uint32)
            counts[: len(learned)] = np.fromiter(learned.values(), np.uint32, len(learned))
            rng = np.fromiter((zlib.crc32(w) % ranges for w in words), np.int64, len(words))
            order, name, asks = np.argsort(rng, kind="stable"), task << 24 | block, []
            edge = np.flatnonzero(np.diff(rng[order], prepend=-1, append=-1))
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                at = order[lo:hi]
                asks.append((ASK, name, int(rng[at[0]]), None, None, len(at), squeeze(b" ".join([words[i] for i in at])), pack(counts[at])))
            if whole:
                parts = [before(data, starts) << 8 | data for data, starts in map(stream, pieces(whole))]
                keys, often = np.unique(np.concatenate(parts), return_counts=True)
                asks.append((BYTES, name, 0, None, None, 0, pack(keys.astype(np.int32)), pack(often.astype(np.int64))))
            yield _batch(asks, id_type)

        for batch in batches:
            id_type, rows = batch.column("doc_id").type, []
            for doc_id, out, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text"), strict=True):
                words = (text.as_py() or "").encode("utf-8", "replace").lower().split()
                data = b" ".join(words)
                if out:
                    other.update(words)
                    other.add(END)
                else:
                    learned.update(words)
                    learned[END] += 1
                    whole.append(data)
                rows.append((DOC, task << 24 | block, 0, doc_id, out, len(words) + 1, squeeze(data), None))
                size += len(data)
                if size >= BLOCK:
                    yield from flush()
                    learned, other, whole, size, block = Counter(), set(), [], 0, block + 1
            for lo in range(0, len(rows), 512):
                yield _batch(rows[lo : lo + 512], id_type)
        if learned or other:
            yield from flush()

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return store(rows.mapInArrow(run, f"kind int, block long, range int, doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, n_tokens long, a binary, b binary"), "lm-blocks")


def vocabulary(asked: DataFrame) -> DataFrame:
    """range, words, counts (packed), n, v: every range's tokens; stored. A task holds the distinct
    tokens of one range while messages stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, counts = None, {}

        def out() -> pa.RecordBatch:
            c = np.fromiter(counts.values(), np.int64, len(counts))
            cols = [[current], [squeeze(b" ".join(counts))], [pack(c)], [int(c.sum())], [int((c > 0).sum())]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["range", "words", "counts", "n", "v"])

        for batch in batches:
            for r, a, b in zip(*(batch.column(c).to_pylist() for c in ("range", "a", "b")), strict=True):
                if r != current and current is not None:
                    yield out()
                    counts = {}
                current, get = r, counts.get
                for w, c in zip(expand(a).split(b" "), unpack(b, np.uint32).tolist(), strict=True):
                    counts[w] = get(w, 0) + c
        if current is not None:
            yield out()

    sent = asked.select("range", "a", "b").repartition("range").sortWithinPartitions("range")
    return store(sent.mapInArrow(run, "range int, words binary, counts binary, n long, v long"), "lm-vocabulary")


def byte_code(blocks: DataFrame) -> Code:
    """The code of the training bytes; a sum for each three bytes (2**24 at most) reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, often = np.zeros(0, np.int32), np.zeros(0, np.int64)
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                keys, at = np.unique(np.concatenate([keys, unpack(a, np.int32)]), return_inverse=True)
                often = np.bincount(at, np.concatenate([often, unpack(b, np.int64)])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(often)], ["key", "n"])

    found = blocks.where(F.col("kind") == BYTES).select("a", "b").mapInArrow(run, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").toArrow()
    return Code(found.column("key").to_numpy(), found.column("n").to_numpy())


def tables(texts: DataFrame, code: Code, bits: tuple[int, ...], tasks: int) -> DataFrame:
    """part, less, s: quantised counts of all slots over all training texts (a), stored: each task
    counts its texts, one context after the other, parts of the tables are merged apart."""
    parts = [-(-(1 << b) // PART) for b in bits]
    first = np.cumsum([0, *parts])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        held = [expand(a) for batch in batches for a in batch.column("a").to_pylist()]
        for which in TOGETHER if held else ():
            counts = [np.zeros(2 * PART * parts[k], np.uint32) for k in which]
            count(held, code, bits, which, counts)
            for k, table in zip(which, counts, strict=True):
                for i in range(parts[k]):
                    if (own := table[2 * PART * i : 2 * PART * (i + 1)]).any():
                        yield pa.RecordBatch.from_arrays([pa.array([int(first[k]) + i], pa.int32()), pa.array([pack(own)], pa.binary())], ["part", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total = None, None

        def out() -> pa.RecordBatch:
            less, s = Model.quantise(*total.reshape(-1, 2).T.astype(np.float64))
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([pack(less)], pa.binary()), pa.array([pack(s)], pa.binary())], ["part", "less", "s"])

        for batch in batches:
            for part, b in zip(batch.column("part").to_pylist(), batch.column("n"), strict=True):
                if part != current and current is not None:
                    yield out()
                    total = None
                n = unpack(b.as_py(), np.uint32)
                current, total = part, n.astype(np.uint64) if total is None else total + n
        if current is not None:
            yield out()

    partial = texts.select("a").repartition(tasks).mapInArrow(counted, "part int, n binary")
    return store(partial.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "part int, less binary, s binary"), "lm-tables")


def table(merged: DataFrame, bits: tuple[int, ...], name: str) -> list[np.ndarray]:
    """One column of tables(), less or s, as an array for each context; of bounded size."""
    parts, wide = [-(-(1 << b) // PART) for b in bits], PART * (2 if name == "less" else 1)
    first = np.cumsum([0, *parts])
    out = [np.zeros(wide * p, np.int16) for p in parts]
    for r in merged.select("part", name).toLocalIterator():
        k = int(np.searchsorted(first, r["part"], "right")) - 1
        lo = (r["part"] - first[k]) * wide
        out[k][lo : lo + wide] = unpack(r[name], np.int16)
    return out


def taught(texts: DataFrame, model) -> tuple[np.ndarray, np.ndarray] | None:
    """Weights and final stage after training texts: each task reads a stream of its own, results
    are averaged by their bytes. One row reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        own = Model(model.value.bits, model.value.code, model.value.less, [])
        some, size, seen = [], 0, 0
        for batch in batches:
            for a in batch.column("a").to_pylist():
                some.append(expand(a))
                size += len(some[-1]) + 2
                if size >= 8 * MIXED:
                    own.costs(some, True)
                    some, size, seen = [], 0, seen + size
        if some:
            own.costs(some, True)
        if seen := seen + size:
            both = np.concatenate([own.w.ravel(), own.final]).astype(np.float64) * seen
            yield pa.RecordBatch.from_arrays([pa.array(range(len(both) + 1), pa.int32()), pa.array([float(seen), *both])], ["i", "x"])

    rows = {r["i"]: r["x"] for r in texts.select("a").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()}
    if not rows:
        return None
    values = np.array([rows[i] for i in range(1, len(rows))]) / rows[0]
    n = N_INPUTS * GATES
    return values[:n].reshape(N_INPUTS, GATES).astype(np.float32), values[n:].astype(np.float32)


def answers(asked: DataFrame, vocab: DataFrame) -> DataFrame:
    """block, range, a, b: the words of each ASK row and their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            out = []
            for kind, block, r, a, b in zip(*(batch.column(x).to_pylist() for x in ("kind", "block", "range", "a", "b")), strict=True):
                words = expand(a).split(b" ")
                if kind == WORDS:
                    counts = dict(zip(words, unpack(b, np.int64).tolist(), strict=True))
                else:
                    out.append((block, r, a, pack(np.fromiter(map(counts.__getitem__, words), np.int64, len(words)))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "range", "a", "b"])

    sent = asked.select("kind", "block", "range", "a", F.lit(None).cast("binary").alias("b"))
    sent = sent.union(vocab.select(F.lit(WORDS), F.lit(0).cast("long"), "range", "words", "counts"))
    return sent.repartition("range").sortWithinPartitions("range", "kind").mapInArrow(run, "block long, range int, a binary, b binary")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) and
    bits_per_byte for every row of docs, learned from the rows that aren't held out.

    Null texts are empty: their end is their only token. With nothing to learn from, counts are 0
    and every decision starts even. Repeated rows count and are scored each, and alike; very long
    texts are read whole, in pieces; extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    about = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()
    size = int(about["bytes"] or 0)
    blocks = encode(docs, max(8, size // RANGE))
    asked, learned = blocks.where(F.col("kind") == ASK), blocks.where((F.col("kind") == DOC) & ~F.col("held_out"))
    vocab = vocabulary(asked)
    sums = vocab.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    total, types = int(sums["n"] or 0), int(sums["v"] or 0)
    code, bits = byte_code(blocks), slot_bits(size)
    merged = tables(learned, code, bits, max(6, -(-size // COUNTED)))
    teacher = spark.sparkContext.broadcast(Model(bits, code, table(merged, bits, "less"), []))
    start = taught(learned, teacher)
    teacher.destroy()
    model = Model(bits, code, [], table(merged, bits, "s"))
    discard(merged)
    if start:
        model.w, model.final = start
    shared = spark.sparkContext.broadcast(model)
    floor = np.log10(total + types + 1) if total else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by block, its answers first."""
        keep_memory()
        current, counts, held, size, id_type = None, {}, [], 0, None
        lm = shared.value

        def out() -> pa.RecordBatch:
            texts = list(dict.fromkeys(t for *_, t in held))  # equal texts are scored once
            bits_ = dict(zip(texts, lm.costs(texts).tolist(), strict=True))
            rows = [(*row, bits_[t] * np.log10(2), -bits_[t] / (len(t) + 2 if t else 1)) for *row, t in held]
            kinds = (id_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

        for batch in batches:
            id_type = batch.column("doc_id").type
            for kind, block, doc_id, out_, n, a, b in zip(*(batch.column(x).to_pylist() for x in ("kind", "block", "doc_id", "held_out", "n_tokens", "a", "b")), strict=True):
                if block != current:
                    current, counts = block, {}
                text = expand(a)
                if kind == ASK:
                    counts.update(zip(text.split(b" "), unpack(b, np.int64).tolist(), strict=True))
                    continue
                c = np.fromiter(map(counts.__getitem__, [*(text.split(b" ") if text else []), END]), np.int64, n)
                held.append((doc_id, out_, n, int((c > 0).sum()), total, float(np.log10(c + 1.0).sum() - n * floor), text))
                size += len(text)
                if size >= BLOCK:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    id_type = dict(docs.dtypes)["doc_id"]
    answered = answers(asked, vocab).select(F.lit(ASK).alias("kind"), "block", "range", F.lit(None).cast(id_type).alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(0).cast("long").alias("n_tokens"), "a", "b")
    both = answered.unionByName(blocks.where(F.col("kind") == DOC)).repartition("block").sortWithinPartitions("block", "kind")
    return both.mapInArrow(run, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


__all__ = ["Code", "Model", "score"]
