"""Token ids of documents in files of entropy-coded blocks, written in ascending order of the document id.

1. documents are dealt by ranges of the id and sorted; each task tokenizes its range
   and stores blocks of whole documents,
2. ids are counted over all documents into one frequency table, at most one row per
   id of the vocabulary,
3. every run of blocks becomes a file (header, blocks, index, trailer); a stored row
   per block names file, place and size,
4. blocks are read, checked and decoded independently of each other.

A null text is empty and has only the end id. Null ids come first; equal ids are
ordered by the texts' hashes and all kept. Files carry a new name per task attempt and
only those that stored rows name are read. Other columns are not read.
"""
from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from queryscope.llm import rans
from queryscope.llm.common import file_system, shared_folder, stored

END_ID = 2
BLOCK_TOKENS = 1 << 19
# chunks of text whose ids a Python worker remembers, in two generations of this size
REMEMBERED = 700_000

_FILE_MAGIC, _END_MAGIC = b"QRF1", b"QRE1"
_INDEX, _INDEX_BYTES = "<QQQQ", 32  # place, bytes, documents, tokens
_BLOCKS = "part int, block int, file string, place long, bytes long, docs long, tokens long"
_workers: dict = {}


class ChunkTokenizer:
    """Ids of texts by chunks between ASCII white space, which no token of a tokenizer with word ends crosses.

    The ids of a chunk are those that the library gives; a chunk met before is not
    encoded again. A chunk that is a word of plain letters between marks is three runs
    to the library's own splitting, so the word goes to a copy of the tokenizer that
    leaves out the normalizing and splitting which such words do not need.
    """

    MARKS = ".,;:!?()\""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.words = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.words.normalizer = None
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        size = self.library.get_vocab_size()
        self.ends = np.array([(self.library.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks = {"": b""}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of plain letters: the last id of each is one with a word end."""
        out = {}
        for i in range(0, len(words), 2000):
            run = words[i:i + 2000]
            ids = np.array(self.words.encode_batch_fast([" ".join(run)], add_special_tokens=False)[0].ids, "<u4")
            cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            if len(cuts) != len(run) + 1:
                raise ValueError("this tokenizer marks no word ends")
            data = ids.tobytes()
            out.update((w, data[a:b]) for w, a, b in zip(run, cuts, cuts[1:]))
        return out

    def _encode(self, chunks: list[str]) -> None:
        plain, rest, bare = [], [], []
        for c in chunks:
            if c.isascii() and c.isalpha():
                bare.append(c)
                continue
            right = c.rstrip(self.MARKS)
            word = right.lstrip(self.MARKS)
            lower = word.lower()
            # below U+0250 letters are composed already and lower-case one by one
            if lower.isalpha() and max(lower) < "\u0250" and len(lower) == len(word):
                plain.append((c, right[:len(right) - len(word)], lower, c[len(right):]))
            else:
                rest.append(c)
        unknown = list({m for _, a, _, z in plain for m in (a, z) if m not in self.marks})
        self.marks.update(zip(unknown, self._whole(unknown)))
        lowered = [c.lower() for c in bare]
        ids = self._words(list({*lowered, *(w for _, _, w, _ in plain)}))
        self.young.update(zip(bare, map(ids.__getitem__, lowered)))
        self.young.update((c, self.marks[a] + ids[w] + self.marks[z]) for c, a, w, z in plain)
        self.young.update(zip(rest, self._whole(rest)))

    def _known(self, chunks: list[str]) -> list[bytes]:
        """Ids of different chunks."""
        young, old = self.young, self.old
        found = list(map(young.get, chunks))
        missing = [i for i, ids in enumerate(found) if ids is None]
        unseen = []
        for i in missing:
            ids = old.get(chunks[i])
            if ids is None:
                unseen.append(chunks[i])
            else:
                young[chunks[i]] = ids
        self._encode(unseen)
        for i in missing:
            found[i] = young[chunks[i]]
        if len(young) > REMEMBERED:
            self.young, self.old = {}, young
        return found

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        import pyarrow.compute as pc

        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = lists.flatten().dictionary_encode()
        at, found = words.indices.to_numpy(), self._known(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, starts = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        each = sizes[at]
        upto = np.concatenate([[0], np.cumsum(each)])
        tokens = flat[np.repeat(starts[at] - upto[:-1], each) + np.arange(upto[-1])]
        return tokens, np.diff(upto[lists.offsets.to_numpy()])


def _tokenizer(path: str) -> ChunkTokenizer:
    if path not in _workers:
        _workers[path] = ChunkTokenizer(path)
    return _workers[path]


def _forget() -> None:
    """Drop the tokenizers of this Python worker: Spark goes on with the same workers, and their chunks would stay until the application ends."""
    if _workers:
        _workers.clear()
        pa.default_memory_pool().release_unused()


def _runs(texts: pa.Array, most: int = 6_000_000):
    """(first, after last) of runs of texts of bounded size."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    a = 0
    while a < len(texts):
        z = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + most, "right")))
        yield a, z
        a = z


def tokenize(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks in order: (part, block, width, keys, known, lengths, ids); ids take ``width`` bytes, as many as the vocabulary needs."""
    width = 2 if max(_tokenizer(tokenizer).library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4

    def work(batches):
        part, block = TaskContext.get().partitionId(), 0
        keys, lengths, parts, size = [], [], [], 0

        def flush():
            known = np.array([k is not None for k in keys], np.uint8).tobytes()
            arrays = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([width], pa.int32()), pa.array([np.array([k or 0 for k in keys], "<i8").tobytes()]), pa.array([known]), pa.array([np.array(lengths, "<u4").tobytes()]), pa.array([b"".join(parts)])]
            return pa.RecordBatch.from_arrays(arrays, names=["part", "block", "width", "keys", "known", "lengths", "ids"])

        for b in batches:
            own, texts = b.column(0).to_pylist(), b.column(1)
            for a, z in _runs(texts):
                tokens, sizes = _tokenizer(tokenizer).ids(texts.slice(a, z - a))
                data = np.insert(tokens, np.cumsum(sizes), end_id).astype(f"<u{width}").tobytes()
                at = 0
                for k, n in zip(own[a:z], (sizes + 1).tolist()):
                    keys.append(k)
                    lengths.append(n)
                    parts.append(data[at:at + width * n])
                    at += width * n
                    size += n
                    if size >= block_tokens:
                        yield flush()
                        block += 1
                        keys, lengths, parts, size = [], [], [], 0
        if keys:
            yield flush()

    given = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).withColumn("h", F.xxhash64("t"))
    dealt = given.repartitionByRange(F.col("k").asc_nulls_first(), F.col("h")).sortWithinPartitions(F.col("k").asc_nulls_first(), "h")
    return dealt.select("k", "t").mapInArrow(work, "part int, block int, width int, keys binary, known binary, lengths binary, ids binary")


def count_ids(blocks: DataFrame) -> DataFrame:
    """(id, n) over all blocks; each task adds up before the shuffle. It follows the tokenizing, so its tasks give that memory back."""

    def work(batches):
        _forget()
        total = np.zeros(0, np.int64)
        for b in batches:
            for width, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = np.bincount(np.frombuffer(data, f"<u{width}"))
                if len(n) > len(total):
                    total, n = n, total
                total[:len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    return blocks.select("width", "ids").mapInArrow(work, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def frequency_table(counts: DataFrame) -> DataFrame:
    """Stored (id, freq); one row per counted id, so the vocabulary bounds it."""
    rows = counts.toArrow()
    spark = counts.sparkSession
    if not rows.num_rows:
        return spark.createDataFrame([], "id long, freq long")
    ids, n = rows.column("id").to_numpy(), rows.column("n").to_numpy()
    by_id = np.zeros(ids.max() + 1, np.int64)
    by_id[ids] = n
    freq = rans.Table.scaled(by_id)
    at = np.flatnonzero(freq)
    return stored(spark.createDataFrame(pa.table({"id": at, "freq": freq[at]})), "token-frequencies")


def load_table(frequencies: DataFrame) -> np.ndarray:
    rows = frequencies.toArrow()
    ids = rows.column("id").to_numpy()
    freq = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.int64)
    freq[ids] = rows.column("freq").to_numpy()
    return freq


def write_files(blocks: DataFrame, frequencies: DataFrame, folder: str) -> DataFrame:
    """Encode blocks into files, one for each run of blocks in a task; returns a row per block."""
    shared = blocks.sparkSession.sparkContext.broadcast(load_table(frequencies))

    def work(batches):
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        table, out, index, name, at, last = rans.Table(shared.value), None, [], "", 0, None

        def close():
            listed = b"".join(struct.pack(_INDEX, *x) for x in index)
            out.write(listed + struct.pack("<II4s", len(index), zlib.crc32(listed), _END_MAGIC))
            out.close()

        for b in batches:
            for part, block, width, keys, known, lengths, ids in zip(*[c.to_pylist() for c in b.columns]):
                if last != (part, block - 1):
                    if out:
                        close()
                    name, index = f"tokens-{part:06d}-{block:06d}-{uuid.uuid4().hex}.rans", []
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                    head = _FILE_MAGIC + struct.pack("<I", zlib.crc32(shared.value.astype("<i8").tobytes()))
                    out.write(head)
                    at = len(head)
                named = [k if ok else None for k, ok in zip(np.frombuffer(keys, "<i8").tolist(), known)]
                tokens = np.frombuffer(ids, f"<u{width}")
                data = rans.pack_block(named, np.frombuffer(lengths, "<u4"), tokens, table)
                out.write(data)
                index.append((at, len(data), len(named), len(tokens)))
                row = (part, block, name, at, len(data), len(named), len(tokens))
                kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=[f.split()[0] for f in _BLOCKS.split(", ")])
                at, last = at + len(data), (part, block)
        if out:
            close()

    return blocks.select("part", "block", "width", "keys", "known", "lengths", "ids").mapInArrow(work, _BLOCKS)


def file_index(data: bytes) -> list[tuple[int, int, int, int]]:
    """(place, bytes, documents, tokens) of every block, from a file's own index."""
    n, crc, magic = struct.unpack("<II4s", data[-12:])
    listed = data[-12 - n * _INDEX_BYTES:-12]
    if data[:4] != _FILE_MAGIC or magic != _END_MAGIC or zlib.crc32(listed) != crc:
        raise ValueError("not a whole file of token blocks")
    return list(struct.iter_unpack(_INDEX, listed))


def read_files(written: DataFrame, frequencies: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document, block by block."""
    shared = written.sparkSession.sparkContext.broadcast(load_table(frequencies))
    # places of files first, then of blocks within each: the one-task window has a row per file
    files = written.groupBy("part", "file").agg(F.min("block").alias("b"), F.sum("tokens").alias("n"))
    earlier = Window.orderBy("part", "b").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(F.col("file").alias("f"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = written.withColumn("inside", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(files, F.col("file") == F.col("f"))

    def work(batches):
        system, path = file_system(folder)
        table = rans.Table(shared.value)
        for b in batches:
            for r in b.to_pylist():
                with system.open_input_file(f"{path}/{r['file']}") as f:
                    f.seek(r["place"])
                    block = rans.Block(f.read(r["bytes"]))
                data = block.ids(table).astype("<u4").tobytes()
                ends = np.cumsum(block.lengths.astype(np.int64))
                starts = ends - block.lengths
                each = [data[4 * a:4 * z] for a, z in zip(starts.tolist(), ends.tolist())]
                columns = [pa.array(block.keys, pa.int64()), pa.array(starts + r["start"]), pa.array(block.lengths.astype(np.int64)), pa.array([zlib.crc32(x) for x in each], pa.int64()), pa.array(each, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    n = max(1, written.count() // 4)
    todo = placed.select("file", "place", "bytes", (F.col("base") + F.col("inside")).alias("start")).repartition(n)
    return todo.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def write_tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame, str]:
    """Write the files of ``docs``; returns (rows per block, frequency table, folder)."""
    blocks = stored(tokenize(docs, tokenizer, key, text, end_id, block_tokens), "token-blocks", compression="zstd")
    frequencies = frequency_table(count_ids(blocks))
    folder = shared_folder(docs.sparkSession, "tokens")
    return stored(write_files(blocks, frequencies, folder), "token-files"), frequencies, folder
