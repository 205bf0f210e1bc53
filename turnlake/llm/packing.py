"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents become token ids plus an end id; only those longer than a sequence are cut.
Full pieces are sequences of their own. The others are dealt by row id over problems of
about ``shard`` pieces, and each problem is evolved by ``islands`` populations, each a
task of its own. An individual is a grouping of pieces into sequences. Crossover injects
whole well-filled sequences of one parent into the other, drops the sequences that now
hold a piece twice, and best-fits the displaced pieces. Between epochs an island's elite
migrates to its neighbour. An epoch ends early at the lower bound, but never before a few
crossovers. Pieces of a problem's less-filled sequences are dealt anew, with those of other
problems, until one is left.

Edge cases: a null or empty text is its end id alone; an empty table gives an empty
result; repeated rows are packed one by one; other columns are ignored.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import bounded_batches, materialize
from turnlake.llm.tokenizing import default_path, encoder

CAPACITY = 2048
SHARD = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
#: Crossovers an epoch: always, and at most while above the lower bound.
LEAST_GENERATIONS, GENERATIONS = 2, 16
#: The emptiest sequences of a parent, which its child deals anew.
OPENED = 4
#: Sequences filled less than this share are opened again in the next round.
LOW_FILL = 0.97
ROUNDS = 4
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Tokenise (doc_id, text) once: one row per piece of at most capacity ids."""
    path = tokenizer or default_path()
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.ids(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


class _Fit:
    """Open sequences by free room; best fit is the lowest set bit at or above a length."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.mask = capacity, [[] for _ in range(capacity + 1)], 0

    def put_open(self, members: list[int], room: int) -> None:
        self.rooms[room].append(members)
        self.mask |= 1 << room

    def place(self, item: int, length: int) -> None:
        above = self.mask >> length
        if above:
            room = length + (above & -above).bit_length() - 1
            members = self.rooms[room].pop()
            if not self.rooms[room]:
                self.mask ^= 1 << room
        else:
            room, members = self.capacity, []
        members.append(item)
        self.put_open(members, room - length)

    def groups(self) -> list[list[int]]:
        return [m for at in self.rooms for m in at]


def _fitness(groups: list[list[int]], length: list[int], capacity: int) -> tuple[int, float]:
    return _score(_filled(groups, length), capacity)


def _best_fit(order: list[int], length: list[int], capacity: int) -> list[list[int]]:
    fit = _Fit(capacity)
    for i in order:
        fit.place(i, length[i])
    return fit.groups()


Filled = list[tuple[int, list[int]]]  # (tokens, pieces) per sequence


def _filled(groups: list[list[int]], length: list[int]) -> Filled:
    return [(sum([length[i] for i in g]), g) for g in groups]


def _score(groups: Filled, capacity: int) -> tuple[int, float]:
    """Fewer sequences first, then well-filled ones beside nearly empty ones."""
    return -len(groups), sum([n * n for n, _ in groups]) / capacity**2


def _cross(one: Filled, two: Filled, length: list[int], capacity: int, rng: random.Random) -> Filled:
    """A child of one: some of two's well-filled sequences are put in whole; sequences of one
    that now hold a piece twice, and its OPENED emptiest, give up what is left of them; these
    displaced pieces first take the place of shorter ones where they fill a sequence better,
    then go where they fit best."""
    good = sorted(two, key=lambda g: -g[0])[: max(1, len(two) // 2)]
    given = rng.sample(good, rng.randint(1, max(1, len(good) // 2)))
    inside = {i for _, g in given for i in g}
    kept, free = list(given), []
    for n, g in sorted(one, key=lambda g: -g[0])[: max(0, len(one) - OPENED)]:
        if inside.isdisjoint(g):
            kept.append((n, g))
        else:
            free += [(length[i], i) for i in g if i not in inside]
    for _, g in sorted(one, key=lambda g: -g[0])[max(0, len(one) - OPENED) :]:
        free += [(length[i], i) for i in g if i not in inside]
    free.sort()
    fit = _Fit(capacity)
    for n, g in kept:
        room, members = capacity - n, list(g)
        if room and free:
            for at, x in enumerate(members):
                k = bisect_right(free, (length[x] + room, 1 << 62)) - 1
                if k >= 0 and free[k][0] > length[x]:
                    longer, y = free.pop(k)
                    insort(free, (length[x], x))
                    members[at] = y
                    room -= longer - length[x]
                    if not room:
                        break
        fit.put_open(members, room)
    for n, i in reversed(free):
        fit.place(i, n)
    return [(capacity - room, g) for room, at in enumerate(fit.rooms) for g in at]


def evolve(length: list[int], elites: list[list[list[int]]], capacity: int, seed: int, population: int = POPULATION, generations: int = GENERATIONS, trace: Counter | None = None) -> list[list[int]]:
    """One epoch of one island: the best grouping found. elites: groupings to start from; the
    rest of the population is best fit in orders that mix length with chance, the first by
    length alone. A generation is a crossover whose child replaces the worst individual if it
    is better. LEAST_GENERATIONS always run; beyond them an island stops at the lower bound."""
    rng = random.Random(seed)
    least = -(-sum(length) // capacity)
    pool = list(elites)
    while len(pool) < population:
        chance = rng.random() ** 2 * capacity if pool else 0.0
        key = [n + chance * rng.random() for n in length] if chance else length
        pool.append(_best_fit(sorted(range(len(length)), key=lambda i: -key[i]), length, capacity))
    scored = []
    for k, groups in enumerate(pool):
        filled = _filled(groups, length)
        scored.append((_score(filled, capacity), -k, filled))
    scored.sort(reverse=True)
    for step in range(generations):
        if step >= LEAST_GENERATIONS and -scored[0][0][0] <= least or len(scored) < 2:
            break
        a, b = sorted(rng.sample(range(len(scored)), 2))
        child = _cross(scored[a][2], scored[b][2], length, capacity, rng)
        score = _score(child, capacity)
        better = score > scored[-1][0]
        if trace is not None:
            trace.update(crossovers=1, taken=int(better), best=int(score > scored[0][0]))
        if better:
            scored[-1] = (score, -len(pool) - step, child)
            scored.sort(reverse=True)
    return [g for _, g in scored[0][2]]


STATE = "shard long, island int, uids binary, lengths binary, groups binary, n_groups int, fit double"


def _numbered(groups: list[list[int]], n: int) -> bytes:
    of = np.empty(n, np.int32)
    for k, g in enumerate(groups):
        of[g] = k
    return of.tobytes()


def _grouped(of: bytes) -> list[list[int]]:
    groups: dict[int, list[int]] = {}
    for i, k in enumerate(np.frombuffer(of, np.int32).tolist()):
        groups.setdefault(k, []).append(i)
    return list(groups.values())


def _row(shard: int, island: int, uids: np.ndarray, lengths: np.ndarray, best: list[list[int]], capacity: int) -> dict:
    n, fit = _fitness(best, lengths.tolist(), capacity)
    return {"shard": shard, "island": island, "uids": uids.astype(np.int64).tobytes(), "lengths": lengths.astype(np.int32).tobytes(), "groups": _numbered(best, len(uids)), "n_groups": -n, "fit": float(fit)}


def _first_epoch(capacity: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "uid"], ascending=[False, True])
        uids, lengths = frame["uid"].to_numpy(), frame["length"].to_numpy()
        best = evolve(lengths.tolist(), [], capacity, seed=hash((int(key[0]), int(key[1]))))
        return pd.DataFrame([_row(int(key[0]), int(key[1]), uids, lengths, best, capacity)])

    return run


def _next_epoch(capacity: int, epoch: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        uids, lengths = np.frombuffer(frame["uids"].iloc[0], np.int64), np.frombuffer(frame["lengths"].iloc[0], np.int32)
        best = evolve(lengths.tolist(), [_grouped(x) for x in frame["groups"]], capacity, seed=hash((int(key[0]), int(key[1]), epoch)))
        return pd.DataFrame([_row(int(key[0]), int(key[1]), uids, lengths, best, capacity)])

    return run


def _placed(capacity: int):
    """A problem's best grouping as rows (uid, length, grp, offset, fill)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                of, lengths, uids = (np.frombuffer(r[k], t) for k, t in (("groups", np.int32), ("lengths", np.int32), ("uids", np.int64)))
                order = np.argsort(of, kind="stable")
                grp, size = of[order], lengths[order].astype(np.int64)
                ends = np.cumsum(size)
                first = np.r_[True, grp[1:] != grp[:-1]]
                base = np.maximum.accumulate(np.where(first, ends - size, 0))
                fill = np.bincount(of, weights=lengths)[grp].astype(np.int64)
                n = len(grp)
                yield pa.RecordBatch.from_pydict({"uid": pa.array(uids[order]), "length": pa.array(size), "shard": pa.array(np.full(n, r["shard"], np.int64)), "grp": pa.array(grp.astype(np.int64)), "offset": pa.array(ends - size - base), "fill": pa.array(fill)})

    return run


def pack(sized: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS, low_fill: float = LOW_FILL) -> DataFrame:
    """Pack rows (uid long, unique; length long, 1 to capacity) into sequences: (uid,
    sequence_id, offset)."""
    spark = sized.sparkSession
    full = sized.where(F.col("length") == capacity).select("uid", (F.col("uid") + F.lit(1 << 61)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done, left, last = [full], sized.where(F.col("length") < capacity).select("uid", "length"), None
    for turn in range(ROUNDS):
        n = left.count()
        if n == 0:
            break
        shards = -(-n // shard)
        dealt = left.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(shards)))
        state = dealt.withColumn("island", F.explode(F.array(*(F.lit(i) for i in range(islands))))).groupBy("shard", "island").applyInPandas(_first_epoch(capacity), STATE)
        for epoch in range(1, epochs):
            state = materialize(state)
            to = F.array(F.col("island"), (F.col("island") + 1) % F.lit(islands))
            state = state.withColumn("island", F.explode(F.array_distinct(to))).groupBy("shard", "island").applyInPandas(_next_epoch(capacity, epoch), STATE)
        best = state.groupBy("shard").agg(F.max_by(F.struct("uids", "lengths", "groups"), F.struct(-F.col("n_groups"), "fit")).alias("b"))
        best = best.select("shard", "b.*").mapInArrow(_placed(capacity), "uid long, length long, shard long, grp long, offset long, fill long")
        best = materialize(best)
        again = shards > 1 and turn + 1 < ROUNDS
        keep = best.where(F.col("fill") >= low_fill * capacity) if again else best
        done.append(keep.select("uid", (F.lit(turn) * F.lit(1 << 56) + F.col("shard") * F.lit(1 << 22) + F.col("grp")).cast("long").alias("sequence_id"), "offset"))
        if not again:
            break
        left = best.where(F.col("fill") < low_fill * capacity).select("uid", "length")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, **parameters) -> DataFrame:
    """Tokenise, cut and pack docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    p = materialize(pieces(docs, capacity, tokenizer).withColumn("uid", F.monotonically_increasing_id()))
    return p.join(pack(p.select("uid", "length"), capacity, **parameters), "uid").drop("uid")
