"""K-means of many samples of the same rows at once: each pass over the rows serves the fits of all samples."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.scratch import discard, materialise
from panelspark.shipping import ship

#: Rounds of seeding, steps and tolerance, as Spark's own K-means has them.
ROUNDS, STEPS, TOLERANCE, LOCAL_STEPS = 2, 20, 1e-4, 30
WORD = 62


def uniform(h: np.ndarray, seeds: list[int], salt: int) -> np.ndarray:
    """Numbers in (0, 1) for each row's hash and each seed."""
    salts = np.array([np.random.default_rng([s & (2**62 - 1), salt]).integers(2**64, dtype=np.uint64) for s in seeds], dtype=np.uint64)
    z = h.astype(np.int64).view(np.uint64)[:, None] ^ salts
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) + 0.5) / 2**53


def merged(a: tuple | None, b: tuple) -> tuple:
    """Counts, means and sums of squared deviations of two parts together."""
    if a is None:
        return b
    n = a[0] + b[0]
    by = np.maximum(n, 1)
    gap = b[1] - a[1]
    return n, a[1] + gap * b[0] / by, a[2] + b[2] + gap * gap * a[0] * b[0] / by


class Space:
    """Standardised coordinates of each sample: x stands at (x - mean) / sd, a missing x at 0, a constant feature at 0."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray):
        self.origin = mean[0]
        self.mean, self.inverse = mean - self.origin, np.divide(1.0, sd, out=np.zeros_like(sd), where=sd > 0)

    def shifted(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = ~np.isnan(x)
        return np.where(known, x - self.origin, 0.0), known.astype(float)

    def place(self, r: int, x: np.ndarray) -> np.ndarray:
        x0, known = self.shifted(x)
        return (x0 - known * self.mean[r]) * self.inverse[r]

    def norms(self, x0: np.ndarray, known: np.ndarray, sets: list[int]) -> np.ndarray:
        w, m = self.inverse[sets] ** 2, self.mean[sets]
        return np.maximum((x0 * x0) @ w.T - 2 * x0 @ (m * w).T + known @ (m * m * w).T, 0.0)

    def nearest(self, x0: np.ndarray, known: np.ndarray, sets: list[int], centres: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each row and set: the nearest centre, and its squared distance less the row's norm."""
        label, least = np.empty((len(x0), len(sets)), dtype=np.int64), np.empty((len(x0), len(sets)))
        many = {len(c) for c in centres}
        for n in many:  # one product for all sets with so many centres
            at = [i for i, c in enumerate(centres) if len(c) == n]
            c = np.stack([centres[i] for i in at])
            w = c * self.inverse[[sets[i] for i in at]][:, None]
            m = w * self.mean[[sets[i] for i in at]][:, None]
            flat = lambda a: a.reshape(-1, a.shape[-1]).T
            score = ((c * c).sum(-1).reshape(-1) - 2 * (x0 @ flat(w) - known @ flat(m))).reshape(len(x0), len(at), n)
            label[:, at] = score.argmin(-1)
            least[:, at] = score.min(-1)
        return label, least

    def costs(self, x0: np.ndarray, known: np.ndarray, sets: list[int], centres: list[np.ndarray]) -> np.ndarray:
        norm = self.norms(x0, known, sets)
        cost = norm + self.nearest(x0, known, sets, centres)[1]
        return np.where(cost > 1e-12 * (1 + norm), cost, 0.0)


def local_kmeans(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of the weighted points by K-means++, then moved until none changes its centre."""
    rng = np.random.default_rng(seed & (2**62 - 1))
    chosen = [int(rng.choice(len(points), p=weights / weights.sum()))]
    distance = lambda c: ((points[:, None] - c[None]) ** 2).sum(-1)
    while len(chosen) < k:
        mass = weights * distance(points[chosen]).min(1)
        chosen.append(int(rng.choice(len(points), p=mass / mass.sum())) if mass.sum() > 0 else chosen[0])
    centres, before = points[chosen].copy(), None
    for _ in range(LOCAL_STEPS):
        label = distance(centres).argmin(1)
        if before is not None and (label == before).all():
            break
        before = label
        for c in range(k):
            own = weights * (label == c)
            centres[c] = own @ points / own.sum() if own.sum() > 0 else points[rng.integers(len(points))]
    return centres


class Samples:
    """Rows written once: their features, a hash of their id and the samples that hold them. Sample 0 holds all."""

    def __init__(self, rows: DataFrame, features: list[str], runs: int, share: float, seed: int):
        self.features, self.n_sets, self.seeds = features, runs + 1, [seed, *(seed + r for r in range(runs))]
        drawn = [F.pmod(F.xxhash64(F.lit(s), F.col("point_id")), F.lit(1000)) < int(1000 * share) for s in self.seeds[1:]]
        words = [sum((F.when(d, F.lit(1 << b)).otherwise(F.lit(0)).cast("long") for b, d in enumerate(drawn[at : at + WORD])), F.lit(0).cast("long")) for at in range(0, runs, WORD)]
        self.rows = materialise(rows.select(*(F.col(f).cast("double").alias(f"x{j}") for j, f in enumerate(features)), F.xxhash64("point_id").alias("h"), *(w.alias(f"w{k}") for k, w in enumerate(words))), "samples")
        ship(rows.sparkSession)

    def gathered(self, work: Callable[[Iterator[tuple]], object]) -> list:
        """What work makes of each task's batches (x, hash, members), in the order of the tasks."""
        d, runs = len(self.features), self.n_sets - 1

        def read(batches):
            for batch in batches:
                if batch.num_rows:
                    x = np.column_stack([batch.column(j).to_numpy(zero_copy_only=False).astype(float) for j in range(d)])
                    held = [np.ones(len(x), dtype=bool)]
                    for r in range(runs):
                        held.append((batch.column(d + 1 + r // WORD).to_numpy() >> np.int64(r % WORD)) & 1 == 1)
                    yield x, batch.column(d).to_numpy(), np.column_stack(held)

        def task(batches):
            found = work(read(batches))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([pickle.dumps(found)], pa.binary())], names=["part", "found"])

        got = self.rows.mapInArrow(task, "part int, found binary").collect()
        return [x for r in sorted(got, key=lambda r: r["part"]) if (x := pickle.loads(r["found"])) is not None]


def _start(samples: Samples) -> tuple[Space, list[np.ndarray]]:
    """Each sample's mean and deviation, and a row of each drawn at random as its first centre."""
    seeds = samples.seeds

    def work(batches):
        total, n, best, row = None, 0, np.full(len(seeds), np.inf), None
        for x, h, held in batches:
            known, m = ~np.isnan(x), held.astype(float)
            c = m.T @ known
            x0 = np.where(known, x, 0.0)
            at = x0.sum(0) / np.maximum(known.sum(0), 1)
            x0 = np.where(known, x - at, 0.0)
            s = m.T @ x0
            part = c, at + s / np.maximum(c, 1), np.maximum(m.T @ (x0 * x0) - s * s / np.maximum(c, 1), 0.0)
            total, n = merged(total, part), n + m.sum(0)
            u = np.where(held, uniform(h, seeds, 0), np.inf)
            i = u.argmin(0)
            least = u[i, range(len(seeds))]
            row = x[i] if row is None else np.where((least < best)[:, None], x[i], row)
            best = np.minimum(best, least)
        return total and (total, n, best, row)

    parts = samples.gathered(work)
    total = None
    for p in parts:
        total = merged(total, p[0])
    n = sum(p[1] for p in parts)
    if total is None or (n == 0).any() or (total[0] == 0).any():
        raise ValueError("a sample holds no rows, or no value of a feature")
    sd = np.sqrt(total[2] / np.maximum(n - 1, 1)[:, None])
    space, first = Space(total[1], sd), np.argmin([p[2] for p in parts], axis=0)
    return space, [space.place(r, parts[first[r]][3][r][None]) for r in range(len(seeds))]


def _seeded(samples: Samples, space: Space, centres: list[np.ndarray], k: int) -> list[np.ndarray]:
    """K-means||: twice about 2 k rows by their share of the cost, then k centres of what was drawn, weighed by rows nearest."""
    seeds, sets, wanted = samples.seeds, list(range(len(samples.seeds))), 2.0 * k
    for salt in range(1, ROUNDS + 1):

        def draw(batches, salt=salt, centres=centres):
            total, kept = np.zeros(len(sets)), []
            for x, h, held in batches:
                cost = np.where(held, space.costs(*space.shifted(x), sets, centres), 0.0)
                total += cost.sum(0)
                # The sum of all rows is not known yet, but it is no less than the sum so far.
                i, r = np.nonzero(uniform(h, seeds, salt) * total < wanted * cost)
                kept += [(int(b), float(v), x[a]) for a, b, v in zip(i, r, uniform(h[i], seeds, salt)[range(len(i)), r] / cost[i, r], strict=True)]
            return total, [c for c in kept if c[1] * total[c[0]] < wanted]

        parts = samples.gathered(draw)
        total = sum(p[0] for p in parts)
        more = [[x for p in parts for r, v, x in p[1] if r == s and v * total[s] < wanted] for s in sets]
        centres = [np.unique(np.vstack([centres[s], space.place(s, np.array(more[s]))]), axis=0) if more[s] else centres[s] for s in sets]

    def weigh(batches):
        counts = [np.zeros(len(c)) for c in centres]
        for x, _, held in batches:
            label, _ = space.nearest(*space.shifted(x), sets, centres)
            for s in sets:
                counts[s] += np.bincount(label[held[:, s], s], minlength=len(centres[s]))
        return counts

    parts = samples.gathered(weigh)
    weights = [sum(p[s] for p in parts) for s in sets]
    return [local_kmeans(centres[s], weights[s], k, seeds[s]) if len(centres[s]) > k else centres[s] for s in sets]


def _moved(samples: Samples, space: Space, centres: list[np.ndarray]) -> list[np.ndarray]:
    """Lloyd's steps; a sample whose centres stay takes part no more."""
    active = list(range(len(centres)))
    for _ in range(STEPS):
        k = max(len(centres[s]) for s in active)

        def add(batches, sets=tuple(active), centres=tuple(centres), k=k):
            sums = 0.0
            for x, _, held in batches:
                x0, known = space.shifted(x)
                label, _ = space.nearest(x0, known, list(sets), [centres[s] for s in sets])
                mark = ((label[:, :, None] == np.arange(k)) & held[:, list(sets)][:, :, None]).reshape(len(x), -1).astype(float)
                sums = sums + mark.T @ np.hstack([x0, known, np.ones((len(x), 1))])
            return sums if np.ndim(sums) else None

        sums = sum(samples.gathered(add)).reshape(len(active), k, -1)
        d, still = len(samples.features), []
        for s, q in zip(active, sums, strict=True):
            q = q[: len(centres[s])]
            new = (q[:, :d] - q[:, d : 2 * d] * space.mean[s]) * space.inverse[s] / np.maximum(q[:, -1:], 1)
            new = np.where(q[:, -1:] > 0, new, centres[s])
            if (((new - centres[s]) ** 2).sum(1) > TOLERANCE**2).any():
                still.append(s)
            centres[s] = new
        active = still
        if not active:
            break
    return centres


def sample_fits(rows: DataFrame, features: list[str], k: int, runs: int, share: float, seed: int) -> np.ndarray:
    """(runs, k, k) counts of all rows by the label of the fit on all rows and that of the fit on each hashed sample."""
    samples = Samples(rows, features, runs, share, seed)
    space, centres = _start(samples)
    centres = _moved(samples, space, _seeded(samples, space, centres, k))
    sets = list(range(len(centres)))

    def count(batches):
        cells = np.zeros((k, len(sets) * k))
        for x, _, _ in batches:
            label, _ = space.nearest(*space.shifted(x), sets, centres)
            mark = (label[:, :, None] == np.arange(k)).astype(float)
            cells += mark[:, 0].T @ mark.reshape(len(x), -1)
        return cells

    cells = sum(samples.gathered(count)).reshape(k, len(sets), k)
    discard(samples.rows)
    return cells[:, 1:].transpose(1, 0, 2)


def agreement_of(cells: np.ndarray) -> tuple[float | None, float]:
    """Adjusted Rand index and variation of information (nats) from a table of counts, as controls.agreement() has them."""
    pairs = lambda n: float((n * (n - 1) / 2).sum())
    bits = lambda n: float((n[n > 0] * np.log(n[n > 0])).sum())
    a, b, n = cells.sum(1), cells.sum(0), float(cells.sum())
    vi = max(0.0, (bits(a) + bits(b) - 2 * bits(cells)) / n)
    if n < 2:
        return None, vi
    expected, most = pairs(a) * pairs(b) / (n * (n - 1) / 2), (pairs(a) + pairs(b)) / 2
    return 1.0 if most == expected else (pairs(cells) - expected) / (most - expected), vi
