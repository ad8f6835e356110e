"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, votes by distance, calibrated.

Features are words and the starts of words. Every feature whose share of toxic and of
other examples differs clearly is indexed, however many there are; the rest, such as the
common words of a language, say nothing about the label and make no part of a vector. Examples are sorted into blocks of similar ones;
for each feature a block keeps its largest weight, so blocks that cannot reach the
k-th best similarity are not scored, and the k nearest are exact.

The labelled rows that are learned from are bounded (``EXAMPLES`` and ``CALIBRATION``
per class, chosen by a hash of the id), so is what is sent to the tasks. Every row of
the table to score is scored over its whole text. A null or blank text, or one without
an indexed feature, has no neighbour and gets the score that such documents deserve.
Without labels of both classes every score is the share of toxic labels. Rows with
several labels count as toxic if one of them says so; null labels are ignored.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queryscope.llm.common import stored

EXAMPLES, CALIBRATION = 4000, 2000  # labelled rows per class, at most
LEAST_ROWS, LEAST_ODDS, SURE = 4, 6.0, 1.64  # examples with a feature, and the odds of one class that it must surely (in deviations) give
NEIGHBOURS, BLOCK = 15, 32
PRIOR = 0.25  # weight of the vote that no neighbour gives
PREFIXES, REPEATS = (4, 5, 7), (2, 3)  # lengths of starts, and numbers of different words with one start
THRESHOLD = 0.7

_WORD = re.compile(r"\w+")


def features(text: str | None) -> Counter:
    """Words, starts of longer words (marked ``^``) and starts that several words share (``*2``, ``*3``), with their counts."""
    words = Counter(_WORD.findall((text or "").lower()))
    starts: dict[str, list[int]] = {}
    for w, n in words.items():
        for p in PREFIXES:
            if len(w) > p:
                starts.setdefault("^" + w[:p], []).append(n)
    out = Counter(words)
    for start, counts in starts.items():
        out[start] = sum(counts)
        for r in REPEATS:
            if len(counts) >= r:
                out[f"{start}*{r}"] = sum(counts)
    return out


@dataclass
class Index:
    """Examples as unit vectors in inverted lists with block maxima."""

    ids: np.ndarray
    toxic: np.ndarray
    idf: dict[str, float]
    lists: dict[str, tuple] = field(default_factory=dict)  # feature -> examples, weights, blocks, block starts, block maxima

    @classmethod
    def build(cls, ids: list[int], toxic: list[int], counts: list[dict[str, int]]) -> "Index":
        df = Counter(f for c in counts for f in c)
        idf = {f: math.log((1 + len(ids)) / (1 + n)) + 1 for f, n in df.items()}
        vectors = [cls._unit(c, idf) for c in counts]
        # examples that share their strongest features lie side by side
        order = sorted(range(len(ids)), key=lambda i: (sorted(vectors[i].items(), key=lambda x: (-x[1], x[0]))[:2], ids[i]))
        index = cls(np.array([ids[i] for i in order], np.int64), np.array([toxic[i] for i in order], np.int64), idf)
        posted: dict[str, list] = {}
        for at, i in enumerate(order):
            for f, w in vectors[i].items():
                posted.setdefault(f, []).append((at, w))
        for f, post in posted.items():
            at, w = np.array([p[0] for p in post]), np.array([p[1] for p in post])
            blocks, starts = np.unique(at // BLOCK, return_index=True)
            index.lists[f] = (at, w, blocks, np.append(starts, len(at)), np.maximum.reduceat(w, starts))
        return index

    @staticmethod
    def _unit(counts: dict[str, int], idf: dict[str, float]) -> dict[str, float]:
        v = {f: (1 + math.log(n)) * idf[f] for f, n in counts.items() if f in idf}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {f: x / size for f, x in v.items()} if size else {}

    def _scores(self, query: dict[str, float], chosen: np.ndarray, out: np.ndarray) -> None:
        """Add the similarities of all examples in the chosen blocks."""
        for f, q in query.items():
            at, w, blocks, starts, _ = self.lists[f]
            use = chosen[blocks]
            if use.all():
                out[at] += q * w
            elif use.any():
                inside = np.repeat(use, np.diff(starts))
                out[at[inside]] += q * w[inside]

    def nearest(self, counts: dict[str, int], k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """(positions, similarities) of the k nearest examples, ties by position; only positive similarities."""
        query = self._unit({f: n for f, n in counts.items() if f in self.lists}, self.idf)
        if not query:
            return np.empty(0, np.int64), np.empty(0)
        bound = np.zeros(-(-len(self.ids) // BLOCK))
        for f, q in query.items():
            bound[self.lists[f][2]] += q * self.lists[f][4]
        scores, done = np.zeros(len(self.ids)), np.zeros(len(bound), bool)
        first = np.argsort(-bound, kind="stable")[:-(-k // BLOCK) + 1]
        done[first] = True
        self._scores(query, done, scores)
        least = np.partition(scores, -k)[-k] if len(scores) > k else 0.0
        rest = ~done & (bound >= least - 1e-12) & (bound > 0)
        if rest.any():
            self._scores(query, rest, scores)
        best = np.argsort(-scores, kind="stable")[:k]
        best = best[scores[best] > 0]
        return best, scores[best]

    def vote(self, counts: dict[str, int]) -> tuple[float, np.ndarray, np.ndarray]:
        """Share of toxic neighbours by squared similarity, drawn to zero where neighbours are far."""
        at, sim = self.nearest(counts)
        weight = sim * sim
        return float((weight * self.toxic[at]).sum() / (weight.sum() + PRIOR)), at, sim


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a rising curve through (x, y) with weights, by pooling neighbours that fall."""
    pools: list[list[float]] = []
    for v in np.unique(x):
        own = x == v
        pools.append([float(v), float((w[own] * y[own]).sum()), float(w[own].sum())])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[2] + b[0] * b[2]) / (a[2] + b[2]), a[1] + b[1], a[2] + b[2]])
    return np.array([p[0] for p in pools]), np.array([(p[1] + 0.05) / (p[2] + 0.1) for p in pools])


@dataclass
class Model:
    index: Index
    knots: np.ndarray
    values: np.ndarray

    def judge(self, text: str | None):
        """(score, neighbours as (id, similarity, label))."""
        known = self.index.lists
        vote, at, sim = self.index.vote({f: n for f, n in features(text).items() if f in known}) if known else (0.0, np.empty(0, np.int64), np.empty(0))
        score = float(np.clip(np.interp(vote, self.knots, self.values), 0.0, 1.0))
        return score, [(int(self.index.ids[a]), float(s), int(self.index.toxic[a])) for a, s in zip(at[:3], sim[:3])]


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def examples(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> tuple[DataFrame, dict[int, int]]:
    """Stored (doc_id, toxic, calibrates, text) of the chosen labelled rows, and the numbers of all labelled rows per class."""
    known = labels.filter(~held_out(F.col(key)) & F.col(key).isNotNull() & F.col(label).isNotNull())
    known = known.select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("y")).groupBy("id").agg((F.max("y") > 0).cast("int").alias("y"))
    h = F.xxhash64("id", F.lit("examples"))
    chosen = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(h, "id").limit(EXAMPLES + CALIBRATION)
        chosen = part if chosen is None else chosen.unionByName(part)
    sizes = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    # the chosen rows have a bound, so they can be sent to all tasks; equal texts count once, toxic if one of them is
    found = docs.select(F.col(key).cast("long").alias("d"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("d") == F.col("id"))
    plain = F.sha2(F.lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))), 256)
    once = found.groupBy(plain.alias("plain")).agg(F.min("id").alias("id"), F.max("y").alias("y"), F.min_by("text", "id").alias("text"))
    turn = F.pmod(F.xxhash64("id", F.lit("turn")), F.lit(EXAMPLES + CALIBRATION)) < CALIBRATION
    return stored(once.select("id", "y", turn.alias("calibrates"), "text"), "toxicity-examples"), sizes


def choose_features(rows: DataFrame) -> list[str]:
    """All features with a clear association, counted by documents."""

    def work(batches):
        seen = {0: Counter(), 1: Counter()}
        for b in batches:
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[y].update(features(text).keys())
        names = sorted(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][f] for f in names], pa.int64()), pa.array([seen[0][f] for f in names], pa.int64())], names=["f", "pos", "neg"])

    sizes = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return []
    p, n = float(sizes[1]), float(sizes[0])
    counted = rows.select("y", "text").mapInArrow(work, "f string, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = lambda x, of: F.log((F.col(x) + 0.5) / (of + 1))
    ratio = F.abs(odds("pos", p) - odds("neg", n))
    sure = ratio - SURE * F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    clear = counted.select("f", sure.alias("sure"), F.greatest("pos", "neg").alias("most")).filter((F.col("most") >= LEAST_ROWS) & (F.col("sure") >= math.log(LEAST_ODDS)))
    return sorted(r.f for r in clear.select("f").collect())


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Index and calibration from the bounded sample of labelled rows that are not held out."""
    rows, sizes = examples(docs, labels, key, text, label)
    total = sum(sizes.values())
    base = sizes.get(1, 0) / total if total else 0.0
    empty = Index(np.empty(0, np.int64), np.empty(0, np.int64), {})
    chosen = set(choose_features(rows.filter("not calibrates")))
    if not chosen:
        return Model(empty, np.array([0.0]), np.array([base]))

    def work(batches):
        for b in batches:
            found = [{f: n for f, n in features(t).items() if f in chosen} for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))], names=["id", "y", "calibrates", "f", "n"])

    got = rows.mapInArrow(work, "id long, y int, calibrates boolean, f array<string>, n array<long>").collect()
    got = sorted(((r.calibrates, r.id, r.y, dict(zip(r.f, r.n))) for r in got), key=lambda r: r[:2])
    own = [r for r in got if not r[0] and r[3]]
    index = Index.build([r[1] for r in own], [r[2] for r in own], [r[3] for r in own])
    tries = [r for r in got if r[0]] or [r for r in got]
    x, y = np.array([index.vote(r[3])[0] for r in tries]), np.array([r[2] for r in tries], float)
    # the sample has its own share of toxic rows; weights bring back that of all labelled rows
    share = y.mean()
    w = np.where(y == 1, base / share if share else 1.0, (1 - base) / (1 - share) if share < 1 else 1.0)
    return Model(index, *isotonic(x, y, w))


def with_scores(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("score", "neighbours")) -> DataFrame:
    """The rows as they are, with a score and the nearest examples; no shuffle."""
    from pyspark.sql.types import _parse_datatype_string

    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, own = docs.columns.index(text), list(docs.columns)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))

    def work(batches):
        for b in batches:
            found = [shared.value.judge(t) for t in b.column(at).to_pylist()]
            near = [[{"doc_id": i, "similarity": s, "toxic": y} for i, s, y in n] for _, n in found]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([s for s, _ in found], pa.float64()), pa.array(near, kind)], names=[*own, *names])

    schema = _parse_datatype_string(f"{names[0]} double, {names[1]} array<struct<doc_id:bigint,similarity:double,toxic:int>>")
    for f in reversed(docs.schema.fields):
        schema.fields.insert(0, f)
        schema.names.insert(0, f.name)
    return docs.mapInArrow(work, schema)


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Per row: key, held_out, score, predicted, neighbours."""
    model = train(docs, labels, key, text, label)
    scored = with_scores(docs.select(F.col(key), F.col(text).alias("t")), model, "t")
    return scored.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "neighbours")
