"""Token files: exact round trips, segments on their own, and damage."""
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from queryscope.llm import queries, rans, token_files
from queryscope.llm.common import file_system
from queryscope.llm.queries_tokens import vocabulary


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


def plain(rows, library):
    out, start = [], 0
    for k, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("n", [1, 2, 63, 64, 5000, 300_000])
def test_blocks_round_trip(n):
    rnd = np.random.default_rng(n)
    ids = np.minimum(rnd.zipf(1.3, n), 49_000).astype(np.uint32)
    table = rans.Table(rans.Table.scaled(np.bincount(ids)))
    data = rans.pack_block([5, None], np.array([n - 1, 1]), ids, table, lanes=256, every=32)
    block = rans.Block(data)
    assert block.keys == [5, None] and np.array_equal(block.ids(table), ids)
    for i in range(block.segments):  # each checkpoint decodes without the others
        size = block.lanes * block.every
        assert np.array_equal(block.segment(i, table), ids[i * size:(i + 1) * size])
    p = np.bincount(ids)[ids] / n
    if n == 300_000:
        assert block.segments > 10 and len(block.words) * 32 < -np.log2(p).sum() * 1.02 + 64 * 256


def test_one_symbol_and_damage():
    ids = np.full(1000, 7, np.uint32)
    table = rans.Table(rans.Table.scaled(np.bincount(ids)))
    data = rans.pack_block([1], np.array([1000]), ids, table)
    assert np.array_equal(rans.Block(data).ids(table), ids)
    for at in (40, len(data) - 1):
        with pytest.raises(ValueError):
            rans.Block(data[:at] + bytes([data[at] ^ 1]) + data[at + 1:])


TEXTS = [None, "", "  ", "Hello, World's best-of 2024!", "É́ á ́b İstanbul ΑΣ ΣΑΣ", "nbsp here\x1cthere z \x0b\x0cq", "<|endoftext|> and<|startoftext|>x", "don't 'tis I'LL we've", "日本語 テキスト 😀👍🏽",
         "a" * 20000, "x1y22z333 " * 50, "‍ zero​width", "don't\n'll\t've 's"]


def test_chunks_give_the_library_ids(library):
    tok = token_files.ChunkTokenizer(vocabulary())
    for _ in range(2):  # with an empty and with a filled memory
        tokens, sizes = tok.ids(pa.array(TEXTS))
        for t, got in zip(TEXTS, np.split(tokens, np.cumsum(sizes)[:-1])):
            assert got.tolist() == library.encode(t or "", add_special_tokens=False).ids, t


def test_known_chunks_are_looked_up_once():
    class Counted(dict):
        asked = 0

        def _count(name):
            def ask(self, *args):
                Counted.asked += 1
                return getattr(dict, name)(self, *args)
            return ask

        get, __contains__, __getitem__ = _count("get"), _count("__contains__"), _count("__getitem__")

    tok, chunks = token_files.ChunkTokenizer(vocabulary()), ["word", "Word", "(word)", "naïve", "x1"]
    first = tok._known(chunks)
    tok.young = Counted(tok.young)
    assert tok._known(chunks) == first and Counted.asked == len(chunks)


def test_odd_rows(spark, library, monkeypatch):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(-5, "minus"), (2**40, "far")]
    df = spark.createDataFrame([(t, k, 1) for k, t in rows] + [("none one", None, 1)], "text string, doc_id long, start int").repartition(4)
    written, table, folder = token_files.write_tokens(df, vocabulary(), block_tokens=100)
    got = [tuple(r) for r in token_files.read_files(written, table, folder).drop("ids").orderBy("start").collect()]
    assert got == plain(sorted([(None, "none one"), *rows], key=lambda r: (r[0] is not None, r[0] or 0)), library)
    # the files' own indexes name the same blocks, in ascending order of the ids
    system, path = file_system(folder)
    freq = rans.Table(token_files.load_table(table))
    keys = []
    for f in sorted({r.file for r in written.collect()}):
        with system.open_input_file(f"{path}/{f}") as s:
            data = s.read()
        for at, size, docs, tokens in token_files.file_index(data):
            block = rans.Block(data[at:at + size])
            assert len(block.keys) == docs and len(block.ids(freq)) == tokens
            keys += block.keys
    assert keys == [None, *sorted(k for k, _ in rows)]
    with pytest.raises(ValueError):
        token_files.file_index(data[:-1])


def test_repeated_ids_stay(spark):
    df = spark.createDataFrame([(1, "b c"), (1, "a"), (1, "a")], "doc_id long, text string")
    got = token_files.read_files(*token_files.write_tokens(df, vocabulary())).collect()
    assert sorted(r.n_tokens for r in got) == [2, 2, 3] and sorted(r.start for r in got)[0] == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read_files(*token_files.write_tokens(df, vocabulary())).count() == 0


def test_query_over_table(spark, sf, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    got = [tuple(r) for r in queries.QUERIES["op5_token_files"](spark, sf).orderBy("start").collect()]
    assert got == plain(rows, library)


def test_workers_give_the_tokenizer_back(spark):
    """Later steps run in the same Python workers, which must not keep the remembered chunks."""

    def held(batches):
        from queryscope.llm import token_files as module

        kept = sum(1 + len(t.young) + len(t.old) for t in module._workers.values())
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([kept] * b.num_rows, pa.int64())], names=["kept"])

    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('word', id, ' and more') AS text")
    blocks = token_files.stored(token_files.tokenize(docs, vocabulary(), block_tokens=100), "test-blocks")
    counts = token_files.count_ids(blocks.repartition(200))
    assert counts.selectExpr("sum(n)").first()[0] > 4000
    assert spark.range(200).repartition(200).mapInArrow(held, "kept long").selectExpr("sum(kept)").first()[0] == 0
