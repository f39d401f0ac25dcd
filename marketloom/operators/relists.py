"""Relist candidates found inside tasks: rows go once to their segment, and pairs are looked at there in slices of arrays.

A task gets whole blocks of a segment (brand, model, year). Candidates are sorted by gate and time, so an original's
candidates are slices; rows that the rules can't tell apart are one. Nothing that grows with the pairs leaves a task
or is held by it, beyond ``PAIRS`` at once.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import adaptive_window, sold
from .enrich import with_segment
from .storage import checkpointed

SEGMENT = ["brand", "model", "year"]
#: Pairs that a task looks at together, rows of a segment that meet in one block, rows of a group of blocks.
PAIRS, BLOCK, GROUP = 1 << 15, 50_000, 20_000
DAY = 86_400_000_000


@dataclass(frozen=True)
class Rules:
    """What pairs are judged by. ``equal``: fields that must agree if both are known. ``grown``: a number whose gain must lie
    between -noise and noise + rate * days (at least one day), if known. Scores are in hundredths: ``near``: (field, distance,
    points within it, points beyond); ``agree``: (field, points). ``start``, ``least``: where scores begin, and the least that counts.
    """

    equal: tuple[str, ...] = ()
    grown: str | None = None
    noise: float = 0.0
    rate: float = 0.0
    near: tuple[tuple[str, float, int, int], ...] = ()
    agree: tuple[tuple[str, int], ...] = ()
    start: int = 50
    least: float = 0.0

    @property
    def fields(self) -> list[str]:
        return [*self.equal, *([self.grown] if self.grown else []), *[x[0] for x in self.near], *[x[0] for x in self.agree]]


def blocks(df: DataFrame, dom: DataFrame | None, key: str, columns: list[str], most: int = BLOCK) -> tuple[DataFrame, bool]:
    """Rows with ``columns`` and what the matching needs, by ``_at``, and whether segments were cut.

    A segment of more than ``most`` rows is dealt into n parts and has n x n blocks; the originals of a part meet the candidates
    of every part. ``df`` is read several times, so it should be stored.
    """
    rows = df.where(F.col("duplicate_of").isNull())
    for k in SEGMENT:
        rows = rows.where(F.col(k).isNotNull())
    large = rows.groupBy(*SEGMENT).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    large = checkpointed(large.select(*[F.col(k).alias(f"_s_{k}") for k in SEGMENT], F.ceil(F.col("_n") / most).cast("int").alias("_deals")), "large-segments")
    cut = not large.isEmpty()
    n = df.count()
    # its stored size tells whether it goes to the tasks
    dom = checkpointed(dom.select("brand", "model", "generation", "dom_median"), "days-on-market") if dom is not None else None
    rows = with_segment(rows, dom, ["dom_median"]) if dom is not None else rows.withColumn("dom_median", F.lit(None).cast("double"))
    gone = F.unix_micros(F.when(sold(), F.col("deactivated_at")))
    rows = rows.withColumns({"_seen": F.unix_micros("first_seen_at"), "_gone": gone, "_end": gone + adaptive_window(F.col("dom_median")).cast("long") * DAY})
    rows = rows.select(*dict.fromkeys([*SEGMENT, key, *columns]), "_seen", "_gone", "_end").where("_seen is not null or _gone is not null")
    if cut:
        # at most rows / ``most`` segments
        on = [F.col(k) == F.col(f"_s_{k}") for k in SEGMENT]
        rows = rows.join(F.broadcast(large), on[0] & on[1] & on[2], "left").drop(*[f"_s_{k}" for k in SEGMENT])
        deals = F.coalesce("_deals", F.lit(1))
        own, every = F.pmod(F.xxhash64(key), deals).cast("int"), F.sequence(F.lit(0), deals - 1)
        at = lambda i, j, o: F.struct((i * deals + j).alias("block"), F.lit(o).alias("o"))
        met = F.concat(F.transform(every, lambda i: at(i, own, False)), F.when(F.col("_gone").isNotNull(), F.transform(every, lambda j: at(own, j, True))).otherwise(F.array().cast("array<struct<block:int,o:boolean>>")))
        rows = rows.withColumn("_met", F.explode(met)).withColumns({"_block": F.col("_met.block"), "_seen": F.when(~F.col("_met.o"), F.col("_seen")), "_gone": F.when(F.col("_met.o"), F.col("_gone"))}).drop("_met", "_deals")
        rows = rows.where("_seen is not null or _gone is not null")
    else:
        rows = rows.withColumn("_block", F.lit(0))
    cores = df.sparkSession.sparkContext.defaultParallelism
    rows = rows.withColumn("_at", F.pmod(F.xxhash64(*SEGMENT, "_block"), F.lit(max(4 * cores, n // GROUP))).cast("int"))
    return rows.repartition(max(2 * cores, n // (10 * GROUP)), "_at"), cut


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Whole numbers that are equal for equal values; 0 for null."""
    found = pc.dictionary_encode(column).unify_dictionaries().combine_chunks()
    found = found.chunk(0) if isinstance(found, pa.ChunkedArray) else found
    return pc.fill_null(pc.add(found.indices.cast(pa.int64()), 1), 0).to_numpy(zero_copy_only=False)


def _ordered(column: pa.ChunkedArray) -> np.ndarray:
    """Codes in the order of the values."""
    found = pc.dictionary_encode(column).unify_dictionaries().combine_chunks()
    found = found.chunk(0) if isinstance(found, pa.ChunkedArray) else found
    place = np.empty(len(found.dictionary) + 1, np.int64)
    place[0] = 0
    place[1 + pc.sort_indices(found.dictionary).to_numpy()] = np.arange(1, len(found.dictionary) + 1)
    return place[pc.fill_null(pc.add(found.indices.cast(pa.int64()), 1), 0).to_numpy(zero_copy_only=False)]


def _numbers(column: pa.ChunkedArray, unlike: float) -> np.ndarray:
    """Doubles with NaN for null, and ``unlike`` for NaN, which is no unknown and near to nothing."""
    v = pc.if_else(pc.is_nan(column.cast(pa.float64())), unlike, column.cast(pa.float64()))
    return pc.fill_null(v, float("nan")).to_numpy()


def _together(*codes: np.ndarray) -> np.ndarray:
    """One code for each combination."""
    out, size = np.zeros(len(codes[0]), np.int64), 1
    for c in codes:
        own = int(c.max(initial=0)) + 1
        if size * own >= 1 << 62:
            out = np.unique(out, return_inverse=True)[1]
            size = int(out.max(initial=0)) + 1
        out, size = out * own + c, size * own
    return out


def _steps(o: np.ndarray, c: np.ndarray, distance: float) -> tuple[np.ndarray, list[np.ndarray], int]:
    """(the step of each candidate from 1, 0 without a value; for originals the steps that may hold a near candidate, -1 for none; how many steps)."""
    wide = distance * (1 + 1e-9)
    o, c = np.floor(o / wide), np.floor(c / wide)
    told = np.unique(c[~np.isnan(c)])
    place = lambda v: np.searchsorted(told, v)
    mine = []
    for k in (-1, 0, 1):
        at = np.minimum(place(o + k), max(len(told) - 1, 0))
        mine.append(np.where(told[at] == o + k, at + 1, -1) if len(told) else np.full(len(o), -1))
    return np.where(np.isnan(c), 0, place(c) + 1), [np.zeros(len(o), np.int64), *mine], len(told) + 1


@dataclass
class _Rows:
    """The arrays of a group of blocks, a place for each row."""

    table: pa.Table
    key: str
    rules: Rules
    codes: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        t = self.table
        self.keys = _ordered(t[self.key])
        self.block = np.unique(_together(*[_codes(t[k]) for k in [*SEGMENT, "_block"]]), return_inverse=True)[1]
        times = {k: (pc.fill_null(t[k], 0).to_numpy(), t[k].is_valid().to_numpy()) for k in ("_seen", "_gone", "_end")}
        self.seen, self.is_c = times["_seen"]
        self.gone, self.is_o = times["_gone"]
        self.end = np.where(self.is_o, times["_end"][0], 0)
        # instants by rank, so that a block and an instant make one number
        self.instants, at = np.unique(np.concatenate([self.seen, self.gone, self.end]), return_inverse=True)
        self.seen_at, self.gone_at, self.end_at = at.reshape(3, -1)
        self.codes = {k: _codes(t[k]) for k in self.rules.fields}
        both = lambda k: (_numbers(t[k], -np.inf), _numbers(t[k], np.inf))
        self.near, self.distance = {x[0]: both(x[0]) for x in self.rules.near}, {x[0]: x[1] for x in self.rules.near}
        self.grown = both(self.rules.grown) if self.rules.grown else None
        self.places = np.empty(t.num_rows, np.int64)
        self.places[np.lexsort((self.keys, self.seen_at))] = np.arange(t.num_rows)

    def kinds(self, rows: np.ndarray, *times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of rows that the rules can't tell apart: the one of the least key, the kind of each row, and how many they are."""
        rows_by_key = rows[np.argsort(self.keys[rows], kind="stable")]
        told = _together(self.block[rows_by_key], *[t[rows_by_key] for t in times], *[c[rows_by_key] for c in self.codes.values()])
        _, first, kind, n = np.unique(told, return_index=True, return_inverse=True, return_counts=True)
        back = np.empty(self.table.num_rows, np.int64)
        back[rows_by_key] = kind
        return rows_by_key[first], back[rows], n

    def odd(self) -> np.ndarray:
        """Rows whose key is also seen after it was sold: they may meet themselves."""
        size = int(self.keys.max(initial=0)) + 1
        seen, gone = np.full(size, -1), np.full(size, len(self.instants))
        np.maximum.at(seen, self.keys[self.is_c], self.seen_at[self.is_c])
        np.minimum.at(gone, self.keys[self.is_o], self.gone_at[self.is_o])
        return (seen > gone)[self.keys]

    def slices(self, o: np.ndarray, c: np.ndarray, close: list[str] = []) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:  # noqa: B006
        """(candidates in order, and for slices of them: whose they are, first, end): pairs within the window that agree in ``equal``.

        Of the ``close`` fields, known for all originals, only candidates without a value or in the same or the next step are told.
        """
        gate = _together(np.zeros(self.table.num_rows, np.int64), *[self.codes[k] for k in self.rules.equal])
        gates, gate = np.unique(gate, return_inverse=True)
        own = np.zeros((len(gates), len(self.rules.equal)), np.int64)
        for i, k in enumerate(self.rules.equal):
            own[gate, i] = self.codes[k]
        steps = [_steps(*(x[at] for x, at in zip(self.near[k], (o, c), strict=True)), self.distance[k]) for k in close]
        n = len(self.instants)
        at = self.block[c] * len(gates) + gate[c]
        for near, _, size in steps:
            at = at * size + near
        at = at * n + self.seen_at[c]
        order = np.lexsort((self.places[c], at))
        c, at = c[order], at[order]
        mine, there, whose, first, end = gate[o], set(gate[c].tolist()), [], [], []
        for g in np.unique(mine):
            whom = np.flatnonzero(mine == g)
            fits = ((own == own[g]) | (own == 0) | (own[g] == 0)).all(axis=1)
            for h in np.flatnonzero(fits):
                for tried in itertools.product(*[range(len(x[1])) for x in steps]) if h in there else []:
                    which = whom
                    for (_, own_step, _), i in zip(steps, tried, strict=True):
                        which = which[own_step[i][which] >= 0]
                    base = self.block[o[which]] * len(gates) + h
                    for (_, own_step, size), i in zip(steps, tried, strict=True):
                        base = base * size + own_step[i][which]
                    a, b = (np.searchsorted(at, base * n + t[o[which]], "right") for t in (self.gone_at, self.end_at))
                    some = b > a
                    whose.append(which[some])
                    first.append(a[some])
                    end.append(b[some])
        none = [np.zeros(0, np.int64)]
        return c, *(np.concatenate(x or none) for x in (whose, first, end))

    def pairs(self, o: np.ndarray, c: np.ndarray, apart: bool, close: list[str] = []) -> Iterator[tuple[np.ndarray, np.ndarray]]:  # noqa: B006
        """(places in ``o``, rows of candidates) of pairs that pass, by original, gate and time, about ``PAIRS`` at once."""
        c, whose, first, end = self.slices(o, c, close)
        r = self.rules
        if r.grown:
            km = self.grown[0][o], self.grown[1][c]
        seen, gone, counts = self.seen[c], self.gone[o], end - first
        upto = np.cumsum(counts)
        a = 0
        while a < len(whose):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
            n, mine = counts[a:b], whose[a:b]
            who = np.repeat(mine, n)
            at = np.arange(n.sum()) + np.repeat(first[a:b] - (np.cumsum(n) - n), n)
            a = b
            ok = np.ones(len(at), bool) if not apart else self.keys[o[who]] != self.keys[c[at]]
            if r.grown:
                gain = km[1][at] - np.repeat(km[0][mine], n)
                days = (seen[at] - np.repeat(gone[mine], n)) / DAY
                # an unknown gain is neither
                ok &= ~(gain < -r.noise) & ~(gain > r.rate * np.maximum(days, 1.0) + r.noise)
            yield who[ok], c[at[ok]]

    def scores(self, o: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = np.full(len(o), self.rules.start, np.int64)
        for k, within, plus, minus in self.rules.near:
            far = np.abs(self.near[k][0][o] - self.near[k][1][c])
            out += plus * (far <= within) + minus * (far > within)
        for k, plus in self.rules.agree:
            out += plus * ((self.codes[k][o] == self.codes[k][c]) & (self.codes[k][o] > 0))
        return np.minimum(out, 100)


def _looked_at(rows: _Rows, merged: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(originals, the kind of each, candidates, how many each stands for, whether keys must be told apart)."""
    odd = rows.odd()
    o, c = np.flatnonzero(rows.is_o & ~odd), np.flatnonzero(rows.is_c)
    if len(o) and len(c) and not merged:
        yield o, (o, np.arange(len(o))), c, np.ones(len(c), np.int64), False
    elif len(o) and len(c):
        likes, _, n = rows.kinds(c, rows.seen_at)
        kinds, kind, _ = rows.kinds(o, rows.gone_at, rows.end_at)
        yield kinds, (o, kind), likes, n, False
    o = np.flatnonzero(rows.is_o & odd)
    if len(o) and len(c):
        yield o, (o, np.arange(len(o))), c, np.ones(len(c), np.int64), True


def _grown_counts(rows: _Rows, o: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(pairs of each original, originals that need a look at their pairs) without the pairs, for whole numbers.

    A gain beyond noise + rate * days is one of c's number * u - seen over the original's, with u microseconds for each unit
    that a day allows. Where the times of day differ, a sum that is met exactly is left to the pairs, as doubles may round it away.
    """
    r, t = rows.rules, rows.table
    u = DAY / r.rate if r.rate else 0
    if not pa.types.is_integer(t[r.grown].type) or u < 1 or u % 1 or r.noise % 1:
        return None
    km, known, u, noise = pc.fill_null(t[r.grown], 0).to_numpy().astype(np.int64), t[r.grown].is_valid().to_numpy(), int(u), int(r.noise)
    if np.abs(km).max(initial=0) > 10**9 or np.abs(rows.instants).max(initial=0) > 4 * 10**18:
        return None
    c, whose, first, end = rows.slices(o, c)
    own, whole = km[o[whose]], len(np.unique(rows.instants % DAY)) <= 1
    # from one day on the limit grows
    grows = first + _below(_ranks(rows.seen[c], rows.gone[o[whose]] + DAY - 1), first, end)
    value = lambda v, missing: np.where(known[c], v, missing)
    low, top = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    lost = _below(_ranks(value(km[c], top), own - noise - 1), first, end)
    lost += (grows - first) - _below(_ranks(value(km[c], low), own + int(r.rate) + noise), first, grows)
    risen, limit = value(km[c] * u - rows.seen[c], low), (own + noise) * u - rows.gone[o[whose]]
    inside = _below(_ranks(risen, limit), grows, end)
    lost += (end - grows) - inside
    n, asked = np.zeros(len(o), np.int64), np.zeros(len(o), bool)
    np.add.at(n, whose, end - first - np.where(known[o[whose]], lost, 0))
    if not whole:
        asked[whose[(inside > _below(_ranks(risen, limit - 1), grows, end)) & known[o[whose]]]] = True
    return n, np.flatnonzero(asked)


def _ranks(values: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values by rank, and how many distinct ones each limit reaches."""
    told, at = np.unique(values, return_inverse=True)
    return at, np.searchsorted(told, limits, "right")


def _below(ranked: tuple[np.ndarray, np.ndarray], first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many values at ``first`` up to ``end`` are at or under the limit: values are parted bit by bit (a wavelet matrix), the slices with them."""
    v, x = ranked
    out = np.zeros(len(first), np.int64)
    for bit in range(max(int(v.max(initial=0)), int(x.max(initial=0))).bit_length() - 1, -1, -1):
        one = (v >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        a, b, up = zeros[first], zeros[end], (x >> bit & 1).astype(bool)
        out += np.where(up, b - a, 0)
        first, end = np.where(up, zeros[-1] + first - a, a), np.where(up, zeros[-1] + end - b, b)
        v = np.concatenate([v[~one], v[one]])
    return out


def count_in(table: pa.Table, key: str, rules: Rules, told_gap: bool = True) -> pa.Table:
    """``o_<key>, n, gap`` of originals that have pairs; without ``told_gap`` gap is null and pairs are counted without looking at them."""
    rows, found = _Rows(table, key, rules), []
    of = np.zeros(table.num_rows, np.int64)
    for kinds, (o, kind), c, weight, apart in _looked_at(rows, merged=told_gap or not rules.grown):
        n, first = np.zeros(len(kinds), np.int64), np.full(len(kinds), np.iinfo(np.int64).max)
        of[c] = weight
        counted = None if apart or told_gap or not rules.grown else _grown_counts(rows, kinds, c)
        if not rules.fields and not apart:
            # all of a slice are pairs
            c, whose, a, b = rows.slices(kinds, c)
            sums = np.concatenate([[0], np.cumsum(of[c])])
            n[whose], first[whose] = sums[b] - sums[a], rows.seen[c[a]]
        else:
            asked = np.arange(len(kinds))
            if counted:
                n, asked = counted
                n[asked] = 0
            for who, at in rows.pairs(kinds[asked], c, apart):
                if len(who):
                    starts = np.flatnonzero(np.diff(who, prepend=-1))
                    np.add.at(n, asked[who[starts]], np.add.reduceat(of[at], starts))
                    np.minimum.at(first, asked[who[starts]], np.minimum.reduceat(rows.seen[at], starts))
        some = n[kind] > 0
        found.append((o[some], n[kind][some], (first[kind][some] - rows.gone[o[some]]) / DAY))
    o, n, gap = (np.concatenate([np.asarray(x[i]) for x in found] or [np.zeros(0)]) for i in range(3))
    gap = pa.array(gap.astype(float), mask=np.full(len(gap), not told_gap))
    return pa.table({f"o_{key}": table[key].take(pa.array(o.astype(np.int64))), "n": n.astype(np.int64), "gap": gap})


def best_in(table: pa.Table, key: str, rules: Rules, keep: list[str]) -> pa.Table:
    """``o_*, c_*`` of the ``keep`` columns, gap_days and score: each original with the candidate of the highest score, then the shortest gap, then the least key.

    Pairs that are near in all numbers are looked at first; an original whose best can't be reached by others is done then.
    """
    rows, found = _Rows(table, key, rules), []
    by_place = np.argsort(rows.places)
    near = [x[0] for x in rules.near]
    passes = []
    for beyond in itertools.product((False, True), repeat=len(near)):
        top = rules.start + sum(x[3] if far else x[2] for x, far in zip(rules.near, beyond, strict=True)) + sum(x[1] for x in rules.agree)
        passes.append((-min(top, 100), [k for k, far in zip(near, beyond, strict=True) if not far]))
    for kinds, (o, kind), c, _, apart in _looked_at(rows):
        best = np.full(len(kinds), np.iinfo(np.int64).min)
        known = np.ones(len(kinds), bool)
        for k in near:
            known &= ~np.isnan(rows.near[k][0][kinds])
        for top, close in sorted(passes, key=lambda x: (x[0], -len(x[1]))):
            reached = known & (best <= (-top << 32)) & (-top / 100 >= rules.least)
            asked = np.flatnonzero(reached | ~known if not close else reached)
            if not len(asked):
                continue
            for who, at in rows.pairs(kinds[asked], c, apart, close):
                who = asked[who]
                score = rows.scores(kinds[who], at)
                ok = score / 100 >= rules.least
                who, value = who[ok], (score[ok] << 32) - rows.places[at[ok]]
                if len(who):
                    starts = np.flatnonzero(np.diff(who, prepend=-1))
                    np.maximum.at(best, who[starts], np.maximum.reduceat(value, starts))
        best = best[kind]
        o, best = o[best > np.iinfo(np.int64).min], best[best > np.iinfo(np.int64).min]
        score = -(-best >> 32)
        found.append((o, by_place[(score << 32) - best], score))
    o, c, score = (np.concatenate([x[i] for x in found] or [np.zeros(0, np.int64)]) for i in range(3))
    sides = {f"{side}_{k}": table[k].take(pa.array(at)) for side, at in (("o", o), ("c", c)) for k in keep}
    return pa.table({**sides, "gap_days": (rows.seen[c] - rows.gone[o]) / DAY, "score": score / 100})


def in_groups(rows: DataFrame, fn: Callable[[pa.Table], pa.Table], schema: T.StructType) -> DataFrame:
    return rows.groupBy("_at").applyInArrow(fn, schema)
