"""Fuzzy line deduplication by MinHash.

Every distinct line of a task is cut into character shingles, and one-permutation MinHash (each
shingle hash goes to one of BANDS * ROWS bins, a bin keeps its least, empty bins borrow from the
next) gives its signature, for a line with too few different shingles to fill the bins as many hash
functions do, and lines near that border have both;
BANDS keys of ROWS values each make two lines of Jaccard similarity 0.8
meet in some bucket with a chance of 99.8 %. Rows carry 64-bit line hashes, never lines.

Lines that share a bucket with another line go to it with their text, once for all buckets of the
same members. The task that receives a bucket looks at each pair of it that its links so far leave
apart, by exact Jaccard similarity of the sets of shingles (as 64-bit hashes), and passes on only
the links of a spanning forest. A bucket too large for a task is dealt out by the rarest shingles
of its lines - two lines of similarity t share one of their first n - ceil(t * n) + 1 shingles in
any common order - and what is large even then in pairs of blocks, so every pair of a bucket is
looked at whatever its size. Components come from a distributed union-find, and the first line of
each, by doc_id and line number, stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriledger.llm.common import bounded_broadcast, discard, quoted, store
from veriledger.llm.components import connected_components

SHINGLE, BANDS, ROWS, SIMILARITY = 7, 16, 5, 0.8
BINS = BANDS * ROWS
SPACE = "\t\n\x0b\x0c\r "
#: Different shingles from which a line fills nearly all bins.
FULL = 2 * BINS
#: Characters worked on at once.
CHUNK = 1 << 16
#: Lines and characters of a bucket that one task compares.
MEMBERS, CHARACTERS = 4096, 1 << 22
#: Most line hashes that are broadcast (some 75 bytes each in the driver, 30 MB in all); more are
#: joined by a shuffle.
IDS = 400_000


def shingles(line: str) -> set[str]:
    """The character shingles of a line; a shorter line is one shingle."""
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def jaccard(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles, line after line; how many each line has)."""
    text = np.frombuffer("".join(lines).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    code = np.zeros(len(text) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        code *= np.uint64(0x9E3779B97F4A7C15)
        code += text[k : len(code) + k]
    code ^= code >> np.uint64(32)
    code *= np.uint64(0xD6E8FEB86659FD93)
    code ^= code >> np.uint64(29)
    inside = np.ones(len(code), bool)  # no shingle reaches into the next line
    ends = np.cumsum(size)[:-1]
    for k in range(1, SHINGLE):
        inside[ends - k] = False
    return code[inside], size - SHINGLE + 1


def distinct(code: np.ndarray, n: np.ndarray, least: int) -> np.ndarray:
    """How many different shingles each line has; of a line with less than `least` in all, all."""
    out, mine = n.copy(), np.repeat(n >= least, n)
    if mine.any():
        size = n[n >= least]
        bits = int(len(size)).bit_length()
        both = code[mine] >> np.uint64(bits) | np.repeat(np.arange(len(size), dtype=np.uint64) << np.uint64(64 - bits), size)
        both.sort()  # line after line, since a line's number is in the high bits
        out[n >= least] = np.add.reduceat(np.concatenate([[True], both[1:] != both[:-1]]), np.cumsum(size) - size, dtype=np.int64)
    return out


def _pieces(line: str) -> Iterator[np.ndarray]:
    """The hashes of a very long line's shingles, in pieces that overlap."""
    step = 8 * CHUNK
    for i in range(0, len(line) - SHINGLE + 1, step):
        yield codes([line[i : i + step + SHINGLE - 1]])[0]


def signed(lines: list[str], least: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """(places in lines, a row of BINS minima for each): lines of FULL different shingles or more are
    signed by one hash function, those of fewer by many, and those of which a line that is similar by
    `least` may have FULL or more by both, since two lines meet only if they are signed alike."""
    floor = max(1, int(np.ceil(least * FULL - 1e-9)))
    if len(lines) == 1 and len(lines[0]) > 16 * CHUNK:
        found = np.zeros(0, np.uint64)
        for code in _pieces(lines[0]):
            if len(found := np.union1d(found, code)) >= FULL:
                return np.zeros(1, np.int64), _borrowed(np.min([_least(c, np.array([len(c)])) for c in _pieces(lines[0])], axis=0))
        code, n = found, np.array([len(found)])
        d = n
    else:
        code, n = codes(lines)
        d = distinct(code, n, floor)
    which, out = [], []
    for mine, sign in ((d < FULL, _many_hashes), (d >= floor, _one_hash)):
        if mine.any():
            which.append(np.flatnonzero(mine))
            out.append(sign(code if mine.all() else code[np.repeat(mine, n)], n[mine]))
    return np.concatenate(which), np.concatenate(out)


def signatures(lines: list[str]) -> np.ndarray:
    """A row of BINS minima for each line, its first of signed(); lines have at least SHINGLE characters."""
    which, rows = signed(lines)
    place, first = np.unique(which, return_index=True)
    return rows[first]


def _many_hashes(code: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Least value of each line's shingles (n of them a line) under BINS hash functions."""
    first, out = np.cumsum(n) - n, np.empty((len(n), BINS), np.int64)
    low, high = (code & np.uint64(0xFFFFFFFF)).astype(np.uint32), (code >> np.uint64(32)).astype(np.uint32)
    for k in range(BINS):
        mixed = low * np.uint32((2 * k + 1) * 0x9E3779B1 & 0xFFFFFFFF)
        mixed ^= high
        mixed *= np.uint32((2 * k + 1) * 0x85EBCA6B & 0xFFFFFFFF)
        mixed ^= mixed >> np.uint32(15)
        out[:, k] = np.minimum.reduceat(mixed, first)
    return out


EMPTY = np.int64(1 << 40)


def _least(code: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Least value of each line's shingles in each bin, EMPTY where there is none."""
    cell = (code >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)
    out = np.full(len(n) * BINS, EMPTY, np.int64)
    place = np.repeat(np.arange(len(n)) * BINS, n) + cell.astype(np.int64)
    np.minimum.at(out, place, (code & np.uint64(0xFFFFFFFF)).astype(np.int64))
    return out.reshape(-1, BINS)


def _borrowed(out: np.ndarray) -> np.ndarray:
    """Empty bins take the value of the next filled one, around the end; its distance is mixed in."""
    twice = np.concatenate([out, out], 1)
    at = np.where(twice < EMPTY, np.arange(2 * BINS), 4 * BINS)
    near = np.minimum.accumulate(at[:, ::-1], 1)[:, ::-1][:, :BINS]
    return np.take_along_axis(twice, near, 1) + (near - np.arange(BINS)) * 0x1F123BB5


def _one_hash(code: np.ndarray, n: np.ndarray) -> np.ndarray:
    return _borrowed(_least(code, n))


def band_keys(sig: np.ndarray) -> np.ndarray:
    """BANDS 64-bit keys a line."""
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sig), BANDS)).copy()
    for r in range(ROWS):
        key = (key ^ sig[:, r::ROWS].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(31)
    return key


def buckets(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """key, h: members of buckets with two different lines or more, stored."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # the last lines of this task; others may repeat
        lines, hashes, size, keys, owners, n = [], [], 0, [], [], 0

        def sign_lines() -> None:
            which, rows = signed(lines, least)
            keys.append(band_keys(rows))
            owners.append(np.array(hashes, np.uint64)[which])

        def out() -> pa.RecordBatch:
            key, h = np.concatenate(keys), np.repeat(np.concatenate(owners), BANDS)
            return pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(h.view(np.int64))], ["key", "h"])

        for batch in batches:
            for text in batch.column("text"):
                for raw in (text.as_py() or "").split("\n"):
                    line = raw.strip(SPACE)
                    if len(line) < SHINGLE:
                        continue
                    h = xxhash.xxh64_intdigest(line.encode("utf-8", "replace"), 42)
                    if h in seen:
                        continue
                    if len(seen) >= 1 << 20:
                        seen.clear()
                    seen.add(h)
                    if lines and size + len(line) > CHUNK:
                        sign_lines()
                        lines, hashes, size = [], [], 0
                    lines.append(line)
                    hashes.append(h)
                    size += len(line)
                    n += 1
                    if n >= 1024:
                        sign_lines()
                        yield out()
                        lines, hashes, size, keys, owners, n = [], [], 0, [], [], 0
        if n:
            sign_lines()
            yield out()

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; those under a key that has only one hash go. Nothing is held
        but the first row of the last key."""
        held, open_ = None, None  # its only (key, h); a key known to have several
        for batch in batches:
            key, h = batch.column("key").to_numpy(), batch.column("h").to_numpy()
            if not len(key):
                continue
            if held:
                key, h = np.concatenate([[held[0]], key]), np.concatenate([[held[1]], h])
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
            several = np.logical_or.reduceat(h != h[first][group], first)
            several[0] |= key[0] == open_
            held, open_ = (None, key[-1]) if several[-1] else ((key[-1], h[-1]), None)
            if (many := several[group]).any():
                yield pa.RecordBatch.from_arrays([pa.array(key[many]), pa.array(h[many])], ["key", "h"])

    every = docs.select("text").mapInArrow(sign, "key long, h long")
    return store(every.repartition("key").sortWithinPartitions("key").mapInArrow(shared, "key long, h long"), "line-buckets")


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line (trimmed), h of every line that isn't empty."""
    raw = docs.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "raw"))
    return raw.select("doc_id", "line_no", F.btrim("raw", F.lit(SPACE)).alias("line")).where("line <> ''").select("*", F.xxhash64("line").alias("h"))


def forest(sets: list[np.ndarray], groups: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links (i, j) that span the components of sets (sorted, distinct) of which two in a group are
    linked by a similarity of `least` or more. Pairs that the links so far join, or whose sizes rule
    a link out, aren't compared."""
    n = np.array([len(s) for s in sets])
    if len(sets) == 2:
        if n.min() < least * n.max():
            return []
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if both / (n.sum() - both) >= least else []
    size, place = np.unique(np.concatenate(sets), return_inverse=True)
    begin, flag, root, out = np.concatenate([[0], np.cumsum(n)]), np.zeros(len(size), bool), np.arange(len(sets)), []
    for group in groups:
        of_group, ends = None, np.concatenate([[0], np.cumsum(n[group])])
        for k, i in enumerate(group[:-1].tolist()):
            after = group[k + 1 :]
            at = np.flatnonzero((root[after] != root[i]) & (np.minimum(n[i], n[after]) >= least * np.maximum(n[i], n[after])))
            if not len(at):
                continue
            mine = place[begin[i] : begin[i + 1]]
            flag[mine] = True
            if 4 * len(at) > len(after):
                if of_group is None:
                    of_group = np.concatenate([place[begin[j] : begin[j + 1]] for j in group.tolist()])
                both = np.add.reduceat(flag[of_group[ends[k + 1] :]], ends[k + 1 : -1] - ends[k + 1], dtype=np.int64)[at]
            else:
                both = np.array([np.count_nonzero(flag[place[begin[j] : begin[j + 1]]]) for j in after[at].tolist()])
            flag[mine] = False
            rest = after[at]
            for j in rest[both / (n[i] + n[rest] - both) >= least].tolist():
                if root[j] != root[i]:
                    root[root == root[j]] = root[i]
                    out.append((i, j))
    return out


def long_similarity(a: str, b: str, step: int = 1 << 20, parts: int = 16) -> float:
    """Jaccard similarity of two very long lines: shingles are hashed in pieces and compared one
    part of the hashes at a time, so that memory holds a part of them."""

    def part(line: str, k: int) -> np.ndarray:
        pieces = (codes([line[i : i + step + SHINGLE - 1]])[0] for i in range(0, len(line) - SHINGLE + 1, step))
        return np.unique(np.concatenate([p[p % np.uint64(parts) == k] for p in pieces]))

    both = every = 0
    for k in range(parts):
        x, y = part(a, k), part(b, k)
        same = len(np.intersect1d(x, y, assume_unique=True))
        both, every = both + same, every + len(x) + len(y) - same
    return both / every


def links_in_groups(members: DataFrame, least: float) -> DataFrame:
    """src, dst: a spanning forest of the links inside each group. members: part, grp, h, line; the
    groups of a part are compared together, since they have many pairs in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo: list[tuple[dict[int, str], dict[int, list[int]]]] = []  # of a part: lines by hash, hashes by group
        current, lines, groups, size = None, {}, {}, 0

        def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["src", "dst"])

        def out() -> pa.RecordBatch:
            found: list[tuple[int, int]] = []
            code, n = codes([line for lines, _ in todo for line in lines.values()])
            sets, at = [np.unique(x) for x in np.split(code, np.cumsum(n)[:-1])], 0
            for lines, groups in todo:
                h, number = list(lines), {x: i for i, x in enumerate(lines)}
                of = [np.array([number[x] for x in g]) for g in groups.values()]
                found += [(h[i], h[j]) for i, j in forest(sets[at : at + len(h)], of, least)]
                at += len(h)
            return batch_of(found)

        def long_ones(lines: dict[int, str], groups: dict[int, list[int]]) -> pa.RecordBatch:
            pairs = {(a, b) for g in groups.values() for i, a in enumerate(g) for b in g[i + 1 :]}
            return batch_of([(a, b) for a, b in sorted(pairs) if long_similarity(lines[a], lines[b]) >= least])

        def ended() -> Iterator[pa.RecordBatch]:
            nonlocal todo, size
            if len(lines) < 2:
                return
            chars = sum(map(len, lines.values()))
            # a large part in its groups, so that no more than CHARACTERS are worked on at once
            for own in [groups] if chars <= CHARACTERS // 4 else [{k: g} for k, g in groups.items()]:
                mine = lines if own is groups else {h: lines[h] for g in own.values() for h in g}
                if len(mine) > 1 and sum(map(len, mine.values())) > 2 * CHARACTERS:
                    yield long_ones(mine, own)
                    continue
                todo.append((mine, own))
                size += sum(map(len, mine.values()))
                if size >= 2 * CHUNK:
                    yield out()
                    todo, size = [], 0

        for batch in batches:
            for part, grp, h, line in zip(*(batch.column(c).to_pylist() for c in ("part", "grp", "h")), batch.column("line"), strict=True):
                if part != current:
                    yield from ended()
                    current, lines, groups = part, {}, {}
                if h not in lines:
                    lines[h] = line.as_py()
                groups.setdefault(grp, []).append(h)
        yield from ended()
        if todo:
            yield out()

    return members.repartition("part").sortWithinPartitions("part", "grp", "h").mapInArrow(run, "src long, dst long")


def sized(met: DataFrame, texts: DataFrame) -> DataFrame:
    """grp, part (the least hash: a line is in few groups), n, chars, stored: one group of all those
    that have the same members."""
    one = met.join(texts.select("h", F.length("line").alias("chars")), "h")
    one = one.groupBy("grp").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum(F.xxhash64("h").cast("decimal(38,0)")).alias("same"), F.min("h").alias("low"))
    return store(one.where("n > 1").groupBy("n", "chars", "same", "low").agg(F.min("grp").alias("grp")).select("grp", F.col("low").alias("part"), "n", "chars"), "line-groups")


def _is_large(n: str = "n", chars: str = "chars"):
    return (F.col(n) > MEMBERS) | (F.col(chars) > CHARACTERS)


def by_rare_shingles(large: DataFrame, least: float) -> DataFrame:
    """grp, h: the members (grp, h, line) of large groups, dealt out by the shingles that fewest of
    their group have: as many a line as two similar ones can't all differ in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grp, h, line in zip(batch.column("grp").to_pylist(), batch.column("h").to_pylist(), batch.column("line"), strict=True):
                found = np.unique(codes([line.as_py()])[0]).view(np.int64)
                same = [pa.array(np.full(len(found), x, np.int64)) for x in (grp, h)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(found)], ["grp", "h", "s"])

    every = store(large.mapInArrow(run, "grp long, h long, s long"), "line-shingles")
    often = every.groupBy("grp", "s").agg(F.count("*").alias("df"))
    n = F.count("*").over(Window.partitionBy("grp", "h"))
    place = F.row_number().over(Window.partitionBy("grp", "h").orderBy("df", "s"))
    ranked = every.join(often, ["grp", "s"]).select("grp", "h", "s", "df", n.alias("n"), place.alias("place"))
    # two in a group at least, or nobody meets there
    return ranked.where((F.col("df") > 1) & (F.col("place") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1)).select(F.xxhash64("grp", "s").alias("grp"), "h")


def in_blocks(met: DataFrame, info: DataFrame) -> DataFrame:
    """grp, h: members of large groups, once for each pair of blocks of their group."""
    parts = F.greatest(F.ceil(F.col("n") / MEMBERS), F.ceil(F.col("chars") / CHARACTERS)).cast("int")
    mine = met.join(info.select("grp", parts.alias("parts")), "grp").withColumn("mine", F.pmod(F.xxhash64(F.lit(1), "h"), F.col("parts")).cast("int"))
    pairs = mine.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return pairs.select(F.xxhash64("grp", F.least("mine", "other"), F.greatest("mine", "other")).alias("grp"), "h")


def candidate_links(met: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """src, dst, stored: links that span the components inside every bucket of met (key, h)."""
    met = met.select(F.col("key").alias("grp"), "h").distinct()
    info = sized(met, texts)
    with_text = lambda m: m.join(texts, "h").select("part", "grp", "h", "line")
    found = [links_in_groups(with_text(met.join(info.where(~_is_large()).select("grp", "part"), "grp")), least)]
    large = info.where(_is_large()).select("grp", "part")
    if not large.isEmpty():
        met = store(by_rare_shingles(with_text(met.join(large, "grp")), least).distinct(), "line-rare")
        info = sized(met, texts)
        found.append(links_in_groups(with_text(met.join(info.where(~_is_large()).select("grp", F.col("grp").alias("part")), "grp")), least))
        if not info.where(_is_large()).isEmpty():
            found.append(links_in_groups(with_text(in_blocks(met, info.where(_is_large())).withColumn("part", F.col("grp"))), least))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return store(out.distinct(), "line-links")


def line_components(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """node, root: hashes of lines that are linked to another line, and the least hash they reach."""
    met = buckets(docs, least)
    ids = store(met.select("h").distinct(), "line-ids")
    texts = store(lines_of(docs).join(bounded_broadcast(ids, IDS), "h", "left_semi").groupBy("h").agg(F.min("line").alias("line")), "line-texts")
    links = candidate_links(met, texts, least)
    out = store(connected_components(links), "line-components")
    discard(met, ids, texts, links)
    return out


def dedup_lines(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, line_no, component_id, keep for every non-empty line of docs.

    Lines are trimmed. component_id is the least hash in a line's component, keep marks the first
    line of it by doc_id (null first) and number. Lines shorter than a shingle have only their exact
    copies beside them; null and empty texts have no lines; of repeated rows each line is kept once;
    ties (rows of one doc_id) go to the row read first. Very long lines are signed and compared in
    pieces. Extra columns are ignored; an empty table gives no rows.
    """
    comp = line_components(docs, least)
    place = store(lines_of(docs).select("doc_id", "line_no", "h", F.monotonically_increasing_id().alias("row")), "lines")
    first = place.groupBy("h").agg(F.min(F.struct("doc_id", "line_no", "row")).alias("first"))
    rooted = store(first.join(comp, first["h"] == comp["node"], "left").select("h", F.coalesce("root", "h").alias("root"), "first"), "line-roots")
    # a line linked to no other is its own root; only the rest have to find the first of theirs
    linked = rooted.where("root <> h").select("root").distinct()
    kept = rooted.join(linked, "root").groupBy("root").agg(F.min("first").alias("kept"))
    label = rooted.join(kept, "root", "left").select("h", F.col("root").alias("component_id"), F.coalesce("kept", "first").getField("row").alias("kept_row"))
    return place.join(label, "h").select("doc_id", "line_no", "component_id", (F.col("row") == F.col("kept_row")).alias("keep"))


def keep_first_lines(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """docs with text cut to the lines kept, in order; columns and rows stay. Rows may share a
    doc_id or have none: each is a row of its own. A null or empty text becomes an empty one."""
    rows = store(docs.withColumn("__row", F.monotonically_increasing_id()), "line-docs")
    kept = dedup_lines(rows.select(F.struct("doc_id", "__row").alias("doc_id"), "text"), least).where("keep").select(F.col("doc_id.__row").alias("__id"), "line_no")
    numbers = kept.groupBy("__id").agg(F.array_sort(F.collect_list("line_no")).alias("__kept"))
    out = rows.join(numbers, rows["__row"] == numbers["__id"], "left")
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    text = F.array_join(F.transform(F.coalesce("__kept", F.array().cast("array<int>")), lambda i: F.get(split, i)), "\n")
    return out.withColumn("text", text).select(*quoted(docs.columns))
