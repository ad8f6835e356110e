"""Alignment of two tokenizers over the same bytes, anchored at white space.

A text is tokenised in full by both. Byte offsets where a token of either ends, and
where the next token of either begins with a space, are anchors; the offsets are
compared, so an anchor is never a guess. Anchors cut a document into windows, pairs of
short runs of token ids. What a window's ids say about groups and overlaps depends on
the ids alone, so it is worked out once per window and remembered by them.

Corpus-wide, a pair of ids counts the documents that link it. The most frequent pairs
(``HANDED_OUT``, a fixed bound) go to the tasks as sorted arrays; all others are joined
by pair, so every link of every document has its exact count.

Texts that are null or empty, and texts that a tokenizer does not give back byte by
byte, have no tokens. Special tokens in a text are plain text. Repeated rows are
documents of their own; a null id is kept. Columns other than the id and the text are
not read. A single text must fit into a task.
"""
from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryscope.llm.common import stored, text_runs

HANDED_OUT = 1 << 20  # pairs in the tasks' memory, at most
REMEMBERED = 1 << 19  # windows a task remembers before it begins anew
_SHIFT = 15  # a pair is one number: the first id, then 15 bits of the second
_B = 1 << 30  # marks ids of the second vocabulary within a window
_HELD = 1 << 21  # pairs a task holds before equal ones are added up


def byte_level_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


# --- fixed value: how byte-level vocabularies of this kind split a text before merging ---
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_SETTLED = re.compile("[\x00-\u024f]*")


class ByteLevel:
    """A byte-level vocabulary of the tokenizers library.

    Where a vocabulary's merges stand in the order of their ids, ranks of bytes say the same, and
    a faster library merges by ranks. It gets the texts whose characters have had the same classes
    in all versions of Unicode; all other texts go to the vocabulary's own library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        alphabet, special = byte_level_alphabet(), {t.content for t in self.library.get_added_tokens_decoder().values()}
        vocab = self.library.get_vocab()
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = token.encode() if token in special else bytes(alphabet[c] for c in token)
        ranks = {self.bytes[i]: i for token, i in vocab.items() if token not in special}
        self.fast = self._ranked(path, ranks)

    def _ranked(self, path: str, ranks: dict[bytes, int]):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        model, split = said["model"], said["pre_tokenizer"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        alphabet = byte_level_alphabet()
        merged = [ranks.get(bytes(alphabet[c] for c in a + b)) for a, b in pairs]
        plain = split == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and said["normalizer"] is None
        rising = None not in merged and merged == sorted(merged) and len(ranks) == 256 + len(merged)
        return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}) if plain and rising and not model.get("ignore_merges") else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [e.ids for e in self.library.encode_batch([" " + t for t in texts], add_special_tokens=False)]
        out = [self.fast.encode_ordinary(" " + t) if _SETTLED.fullmatch(t) else None for t in texts]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(rest, self.library.encode_batch([" " + texts[i] for i in rest], add_special_tokens=False) if rest else ()):
            out[i] = e.ids
        return out


class Pieces:
    """A sentencepiece model; it sets the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.library.get_piece_size()):
            piece = self.library.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.library.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a's token, b's token) of all overlaps in order, and the number of overlaps of each of a's tokens, from the byte offsets where tokens end."""
    starts_a = np.concatenate(([0], ends_a[:-1]))
    first = np.searchsorted(ends_b, starts_a, "right")
    counts = np.searchsorted(ends_b, ends_a, "left") + 1 - first
    at_a = np.repeat(np.arange(len(ends_a)), counts)
    at_b = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first[at_a]
    return at_a, at_b, counts


class Windows(dict):
    """Number of each window by its ids, with tables by number: groups, their text, and the links' pairs one after the other."""

    def __init__(self, sizes: tuple[np.ndarray, np.ndarray]):
        super().__init__()
        self.sizes, self.said = sizes, []
        self.groups, self.starts, self.lengths = (np.zeros(0, np.int64) for _ in range(3))
        self.pairs = np.zeros(0, np.int32)
        # an id with the sign behind it: between ids, between sides, behind a group
        self.text = np.array([f"{i}{sign}" for sign in ",|;" for i in range(max(map(len, sizes)))], object)

    def learn(self, keys: list[bytes]) -> None:
        """Work out new windows, all at once: laid end to end they are one text whose windows are known."""
        packed = np.frombuffer(b"".join(keys), np.int32)
        of_b = packed >= _B
        a, b = packed[~of_b], packed[of_b] - _B
        ends_a, ends_b = (np.cumsum(size[ids]) for size, ids in zip(self.sizes, (a, b)))
        last = np.cumsum([len(k) // 4 for k in keys])
        last_b = np.cumsum(of_b)[last - 1]
        last_a = last - last_b
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        at_a, at_b, counts = overlaps(ends_a, ends_b)
        # groups in order, each with a's tokens, then b's
        group = np.concatenate([np.searchsorted(both, e) * 2 + side for side, e in enumerate((ends_a, ends_b))])
        order = np.argsort(group, kind="stable")
        closes = np.append(group[order][1:] != group[order][:-1], True)
        sign = np.where(closes, 1 + group[order] % 2, 0)
        shown = self.text[np.concatenate([a, b])[order] + sign * (len(self.text) // 3)]
        upto = last.tolist()
        self.said += ["".join(shown[i:j]) for i, j in zip([0, *upto], upto)]
        links = np.cumsum(counts)[last_a - 1]
        done = np.searchsorted(both, ends_a[last_a - 1]) + 1
        step = lambda upto: np.diff(upto, prepend=0)
        self.groups = np.concatenate([self.groups, step(done)])
        self.starts = np.concatenate([self.starts, len(self.pairs) + links - step(links)])
        self.lengths = np.concatenate([self.lengths, step(links)])
        self.pairs = np.concatenate([self.pairs, a[at_a] << _SHIFT | b[at_b]])
        self.update(zip(keys, range(len(self), len(self) + len(keys))))

    def links(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs that the windows link, and how often."""
        distinct, times = np.unique(found, return_counts=True)
        lengths = self.lengths[distinct]
        at = np.arange(lengths.sum()) + np.repeat(self.starts[distinct] - (np.cumsum(lengths) - lengths), lengths)
        pairs, place = np.unique(self.pairs[at], return_inverse=True)
        return pairs, np.bincount(place, np.repeat(times, lengths)).astype(np.int32)


class Aligner:
    """Both vocabularies, and the windows seen so far."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        if len(self.b.bytes) > 1 << _SHIFT or len(self.a.bytes) > 1 << (31 - _SHIFT):
            raise ValueError("vocabularies are too large for pairs of 31 bits")
        self.sizes = tuple(np.array([len(x) for x in v.bytes]) for v in (self.a, self.b))
        self.marked = tuple(np.array([x[:1] == b" " for x in v.bytes]) for v in (self.a, self.b))
        self.windows = Windows(self.sizes)

    def tokens(self, texts: list) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Id arrays of each text, or None where there are no tokens."""
        out: list = [None] * len(texts)
        there = [i for i, t in enumerate(texts) if t]
        chosen = [texts[i] for i in there]
        for i, t, x, y in zip(there, chosen, self.a.encode(chosen), self.b.encode(chosen)):
            whole = b" " + t.encode()
            if b"".join(map(self.a.bytes.__getitem__, x)) == whole and b"".join(map(self.b.bytes.__getitem__, y)) == whole:
                out[i] = np.array(x, np.int32), np.array(y, np.int32)
        return out

    def anchors(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows begin in both, with the ends of both: token numbers behind ends that both share before marked tokens."""
        ends = [np.cumsum(size[ids]) for size, ids in zip(self.sizes, (x, y))]
        before = [e[:-1][m[ids[1:]]] for e, m, ids in zip(ends, self.marked, (x, y))]
        shared = np.intersect1d(*before, assume_unique=True)
        return tuple(np.concatenate(([0], np.searchsorted(e, shared) + 1, [len(e)])) for e in ends)

    def keys(self, x: np.ndarray, y: np.ndarray) -> list[bytes]:
        """The packed ids of each window, a's and then b's, which have a bit of their own."""
        at_a, at_b = self.anchors(x, y)
        # both sides of each window side by side, so that a window is one slice
        place = np.concatenate([np.repeat(2 * np.arange(len(at) - 1) + side, np.diff(at)) for side, at in enumerate((at_a, at_b))])
        packed = np.concatenate([x, y | _B])[np.argsort(place, kind="stable")].tobytes()
        cuts = (4 * (at_a + at_b)).tolist()
        return [packed[i:j] for i, j in zip(cuts, cuts[1:])]

    def documents(self, texts: list) -> list[tuple | None]:
        """(n_a, n_b, groups, links, digest of the groups, distinct linked pairs, how often each is linked) of each text, or None."""
        if len(self.windows) >= REMEMBERED:
            self.windows = Windows(self.sizes)
        own, found = self.windows, self.tokens(texts)
        keys = [self.keys(*pair) if pair else [] for pair in found]
        new = dict.fromkeys(chain.from_iterable(keys))
        if new := [k for k in new if k not in own]:
            own.learn(new)
        said, out = own.said, []
        for pair, document in zip(found, keys):
            if pair is None:
                out.append(None)
                continue
            at = list(map(own.__getitem__, document))
            digest = hashlib.sha256("".join(map(said.__getitem__, at))[:-1].encode()).hexdigest()
            numbers = np.array(at)
            out.append((len(pair[0]), len(pair[1]), int(own.groups[numbers].sum()), int(own.lengths[numbers].sum()), digest, *own.links(numbers)))
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(path_a: str, path_b: str) -> Aligner:
    """One per worker process and pair of vocabularies."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def aligned(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, k, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of every row; the distinct pairs and how often each is linked, as packed int32."""

    def work(batches):
        own = _aligner(path_a, path_b)
        for b in batches:
            texts = b.column(2).to_pylist()
            for lo, hi in text_runs(texts):
                none = (0, 0, 0, 0, "", b"", b"")
                out = [(*d[:5], d[5].tobytes(), d[6].tobytes()) if d else none for d in own.documents(texts[lo:hi])]
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]], names=names)

    names = ["row", "k", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(work, "row long, k long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, a, n, best): documents that link the pair, and whether no other pair of its first id has more; added up in each task first."""

    def work(batches):
        held, counts, waiting = np.empty(0, np.int32), np.empty(0, np.int64), []

        def folded():
            pairs = np.concatenate([held, *waiting])
            n = np.concatenate([counts, *[np.ones(len(w), np.int64) for w in waiting]])
            distinct, place = np.unique(pairs, return_inverse=True)
            return distinct, np.bincount(place, n, len(distinct)).astype(np.int64)

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts)], names=["pair", "n"])

        size = 0
        for b in batches:
            for p in b.column(0).to_pylist():
                waiting.append(np.frombuffer(p, np.int32))
                size += len(waiting[-1])
                if size >= _HELD:
                    held, counts = folded()
                    waiting, size = [], 0
                    if len(held) >= _HELD:  # what is counted goes out, so memory has a bound
                        yield batch()
                        held, counts = np.empty(0, np.int32), np.empty(0, np.int64)
        held, counts = folded()
        if len(held):
            yield batch()

    counted = stored(rows.select("pairs").mapInArrow(work, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    counted = counted.withColumn("a", F.shiftright("pair", _SHIFT))
    top = counted.groupBy("a").agg(F.max("n").alias("most"))
    return counted.join(top, "a").select("pair", "a", "n", (F.col("n") == F.col("most")).alias("best"))


def rated(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows of ``aligned`` with n_best and count_sum instead of the pairs."""
    limit = HANDED_OUT
    frequent = counts.orderBy(F.desc("n"), "pair").limit(limit).select("pair", "n", "best").toPandas().sort_values("pair")
    arrays = frequent["pair"].to_numpy(np.int32), frequent["n"].to_numpy(np.int64), frequent["best"].to_numpy(bool)
    shared = rows.sparkSession.sparkContext.broadcast(arrays)

    def work(batches):
        known, n, best = shared.value
        for b in batches:
            out = []
            for p, t in zip(b.column(7).to_pylist(), b.column(8).to_pylist()):
                pairs, times = np.frombuffer(p, np.int32), np.frombuffer(t, np.int32).astype(np.int64)
                place = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
                hit = known[place] == pairs if len(known) else np.zeros(len(pairs), bool)
                place = place[hit]
                out.append((int((times[hit] * best[place]).sum()), int((times[hit] * n[place]).sum()), pairs[~hit], times[~hit]))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:7], *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]], names=names)

    names = ["row", "k", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "other", "other_times"]
    found = rows.mapInArrow(work, "row long, k long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, other array<int>, other_times array<long>")
    if len(arrays[0]) < limit:  # nothing is left to join
        return found.drop("other", "other_times")
    found = stored(found, "aligned-partly")
    rest = found.select("row", F.explode(F.arrays_zip("other", "other_times")).alias("o")).select("row", F.col("o.other").alias("pair"), F.col("o.other_times").alias("times"))
    rest = rest.join(counts.select("pair", "n", "best"), "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    both = found.drop("other", "other_times").join(rest, "row", "left")
    add = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).cast("long").alias(a)
    return both.select(*names[:7], add("n_best", "more_best"), add("count_sum", "more_sum"))


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = stored(aligned(docs, path_a, path_b, key, text), "aligned", compression="zstd")
    out = rated(rows, stored(pair_counts(rows), "pairs"))
    return out.select(F.col("k").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def pair_table(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, n, best) of every linked pair of ids: a map from one vocabulary to the other with its evidence."""
    rows = stored(aligned(docs, path_a, path_b, key, text), "aligned", compression="zstd")
    return pair_counts(rows).select("a", F.col("pair").bitwiseAND((1 << _SHIFT) - 1).alias("b"), "n", "best")
