"""The best sections of many queries under many trials, in one pass over sections with counts by field.

A section's scores under all trials are computed only if it can still come among a query's best: the terms' largest
shares over all trials bound them. What is left out is behind the kept rows under every trial, so the result is exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Sections bounded at once, queries bounded at once, sections scored at once.
BLOCK, QUERIES, STEP = 1000, 256, 64
#: Bounds are single precision and scores are rounded to six digits: so much is left between them.
SLACK, ROUNDED = 1e-4, 2e-6


class Best:
    """The rows of one query that are among its best (depth rows, per_file of a file) under any trial."""

    def __init__(self, n_trials: int, depth: int, per_file: int):
        self.depth, self.per_file = depth, per_file
        self.rows: list[tuple[str, int]] = []
        self.scores = np.empty((0, n_trials))
        self.last = np.full(n_trials, -np.inf)  # the score of the last of the best
        self.ranks = np.empty((0, n_trials), np.int32)  # 0: not among the best

    def add(self, rows: list[tuple[str, int]], scores: np.ndarray) -> None:
        if not rows:
            return
        rows, scores = self.rows + rows, np.concatenate([self.scores, scores])
        order = sorted(range(len(rows)), key=rows.__getitem__)  # equal scores: by file and line, argmax takes the first
        rows, scores = [rows[i] for i in order], scores[order]
        number: dict[str, int] = {}
        files = np.array([number.setdefault(f, len(number)) for f, _ in rows])
        taken = np.zeros((len(number), scores.shape[1]), np.int32)
        live, ranks, trials = scores.copy(), np.zeros(scores.shape, np.int32), np.arange(scores.shape[1])
        for rank in range(1, self.depth + 1):
            at = live.argmax(axis=0)
            best = live[at, trials]
            some = trials[best > -np.inf]
            ranks[at[some], some] = rank
            live[at[some], some] = -np.inf
            taken[files[at[some]], some] += 1
            full = some[taken[files[at[some]], some] >= self.per_file]
            if len(full):
                live[:, full] = np.where(files[:, None] == files[at[full]], -np.inf, live[:, full])
        self.last = best
        kept = np.flatnonzero(ranks.any(axis=1))
        self.rows, self.scores, self.ranks = [rows[i] for i in kept], scores[kept], ranks[kept]


class Sweep:
    """trials: heading, meta, crumb, k1, b of each (arrays); means: tokens by field; queries: distinct terms of each, by number."""

    def __init__(self, n_docs: float, means: list[float], df: dict[str, int], queries: list[list[str]], trials: dict[str, list[float]], depth: int, per_file: int, least_length: float, coverage: float, zones: dict[str, float], digits: int):
        t = {k: np.array(v) for k, v in trials.items()}
        self.weights = np.stack([t["heading"], t["meta"], t["crumb"], np.ones(len(t["b"]))])
        self.k1, self.b, self.average = t["k1"], t["b"], np.array(means) @ self.weights
        self.least_length, self.coverage, self.zones, self.digits = least_length, coverage, zones, 10.0**digits
        self.terms = sorted(df)
        number = {x: i for i, x in enumerate(self.terms)}
        self.idf = np.array([math.log(1 + (n_docs - df[x] + 0.5) / (df[x] + 0.5)) for x in self.terms])
        self.known = pa.array(self.terms, pa.string())
        self.queries = [np.array(sorted(number[x] for x in q if x in number), np.int64) for q in queries]
        self.best = [Best(len(t["b"]), depth, per_file) for _ in queries]
        self.parts = []
        for begin in range(0, len(queries), QUERIES):
            part = range(begin, min(begin + QUERIES, len(queries)))
            table = np.zeros((len(self.terms), len(part)), np.float32)
            for i, q in enumerate(part):
                table[self.queries[q], i] = 1
            self.parts.append((part, table))

    def add(self, batch: pa.RecordBatch) -> None:
        """A batch of file_id, zone, line, the four n_<field>, counts (term and the four f_<field>)."""
        for at in range(0, batch.num_rows, BLOCK):
            self._block(batch.slice(at, BLOCK))

    def _block(self, batch: pa.RecordBatch) -> None:
        counts = batch.column(7)
        flat = counts.flatten()
        code = pc.fill_null(pc.index_in(flat.field(0), self.known), -1).to_numpy(zero_copy_only=False)
        section = counts.value_parent_indices().to_numpy()
        ours = np.flatnonzero(code >= 0)
        if not len(ours):
            return
        code, section = code[ours].astype(np.int64), section[ours].astype(np.int64)
        f = np.stack([flat.field(i).to_numpy()[ours] for i in range(1, 5)], axis=1).astype(np.int64)
        n = np.stack([batch.column(i).to_numpy() for i in range(3, 7)], axis=1)
        long = np.maximum(n @ self.weights, self.least_length) / self.average
        damp = self.k1 * (1 - self.b + self.b * long)
        weight = np.array([self.zones.get(z, 1.0) for z in batch.column(1).to_pylist()])
        # Many terms of a section have the same counts: their shares differ by idf alone.
        pattern, first, alike = self._patterns(section, f)
        tf = pattern @ self.weights
        below = tf + damp[section[first]]
        at = np.full((batch.num_rows, len(self.terms)), -1, np.int32)
        at[section, code] = np.arange(len(code), dtype=np.int32)
        used = np.unique(code)
        place = np.searchsorted(used, code)
        scale = self._scale()
        share = np.zeros((batch.num_rows, len(used)), np.float32)
        share[section, place] = self.idf[code] * (tf * (self.k1 + 1) / below / scale).max(axis=1)[alike]
        has = (share > 0).astype(np.float32)
        rows = None
        for part, table in self.parts:
            table = table[used]
            here = has @ table
            bound = share @ table * (1 + self.coverage * (here - 1)) * weight[:, None].astype(np.float32)
            least = np.array([self._least(q, scale) for q in part])
            for i in np.flatnonzero(((here > 0) & (bound >= least)).any(axis=0)):
                q = part[i]
                found = np.flatnonzero((here[:, i] > 0) & (bound[:, i] >= least[i]))
                found = found[np.argsort(-bound[found, i], kind="stable")]
                rows = rows or list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
                for begin in range(0, len(found), STEP):
                    some = found[begin : begin + STEP]
                    some = some[bound[some, i] >= self._least(q, scale)]
                    if not len(some):
                        break
                    total, hits = 0.0, 0
                    for term in self.queries[q]:
                        p = at[some, term]
                        there = p >= 0
                        u = alike[p]
                        total = total + np.where(there[:, None], self.idf[term] * tf[u] * (self.k1 + 1) / below[u], 0.0)
                        hits = hits + there
                    score = total * (1 + self.coverage * (hits - 1))[:, None] * weight[some][:, None]
                    self.best[q].add([rows[s] for s in some], np.floor(score * self.digits + 0.5) / self.digits)

    @staticmethod
    def _patterns(section: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct counts within sections, the first posting of each, and each posting's number among them."""
        sizes = f.max(axis=0) + 1
        if float(section.max() + 1) * math.prod(map(float, sizes)) < 2**62:
            key = section.copy()
            for i in range(f.shape[1]):
                key = key * sizes[i] + f[:, i]
            _, first, alike = np.unique(key, return_index=True, return_inverse=True)
        else:
            _, first, alike = np.unique(np.column_stack([section, f]), axis=0, return_index=True, return_inverse=True)
        return f[first], first, alike.reshape(-1)

    def _scale(self) -> np.ndarray:
        """Trials score on scales of their own: the bounds are compared in units of their last scores so far."""
        full = [x.last for x in self.best if np.isfinite(x.last).all() and (x.last > 0).all()]
        return np.mean([x / x.mean() for x in full], axis=0) if full else np.ones(len(self.b))

    def _least(self, q: int, scale: np.ndarray) -> float:
        return ((self.best[q].last - ROUNDED) / scale).min() * (1 - SLACK)
