"""Cross-tokenizer alignment against a plain version over byte offsets."""
import bisect
import hashlib
import random
from collections import Counter, defaultdict
from itertools import accumulate

import pytest
import sentencepiece
from tokenizers import Tokenizer

from queryscope.llm import queries, token_align as T
from queryscope.llm.queries_tokens import vocabulary

SMALL = "/root/testdata/sf0.01"
A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def spans(tokens):
    out, at = [], 0
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def plain(rows, libraries):
    a_lib, b_lib = libraries
    alphabet = T.byte_level_alphabet()
    docs, counts = [], Counter()
    for k, t in rows:
        links, doc = [], (k, 0, 0, 0, "")
        if t:
            whole = (" " + t).encode()
            a = [(i, bytes(alphabet[c] for c in a_lib.id_to_token(i))) for i in a_lib.encode(" " + t, add_special_tokens=False).ids]
            b = []
            for i in b_lib.encode(t):
                p = b_lib.id_to_piece(i)
                b.append((i, bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode()))
            if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b):
                sa, sb = spans(a), spans(b)
                ends = sorted({e for _, _, e in sa} & {e for _, _, e in sb})
                groups = [([], []) for _ in ends]
                for side, tokens in enumerate((sa, sb)):
                    for i, _, e in tokens:
                        groups[bisect.bisect_left(ends, e)][side].append(str(i))
                groups = [f"{','.join(x)}|{','.join(y)}" for x, y in groups]
                j = 0
                for i, s, e in sa:
                    while sb[j][2] <= s:
                        j += 1
                    m = j
                    while m < len(sb) and sb[m][1] < e:
                        links.append((i, sb[m][0]))
                        m += 1
                doc = (k, len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest())
        docs.append((doc, links))
        counts.update(set(links))
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    return sorted(((*d[:4], len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), d[4]) for d, links in docs), key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


ODD = [None, "", " ", "  two  spaces ", "\n\ttabs\r\n", "one", "one", "x<|endoftext|>y <s> </s> <unk> <0x41>", "▁ low line", "naïve café — 日本語のテキスト 🙂👍🏽", "a b　c", "\x00\x1f\x7f", "don't we'll 12345 67.89%", "ﬁ ligature ①", "é composed", "ab " * 40_000, "z" * 30_000, "\U0010ffff end"]


def test_query_over_table(spark, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert got(queries.QUERIES["op12_token_alignment"](spark, SMALL)) == plain(rows, libraries)


@pytest.mark.parametrize("handed", [1 << 20, 5])
def test_odd_rows(spark, libraries, monkeypatch, handed):
    monkeypatch.setattr(T, "HANDED_OUT", handed)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "one two"), (3, "one two"), (3, "one two")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, row int, pairs int")
    assert got(T.align(df, A, B)) == plain(rows, libraries)
    assert T.align(df.limit(0), A, B).count() == 0


def test_anchors_are_shared_ends_before_marked_tokens():
    own = T.Aligner(A, B)
    for t in (t for t in ODD if t):
        pair = own.tokens([t])[0]
        if pair is None:
            continue
        cuts = own.anchors(*pair)
        starts = [[0, *accumulate(len(v.bytes[i]) for i in ids)] for v, ids in zip((own.a, own.b), pair)]
        assert [starts[0][c] for c in cuts[0]] == [starts[1][c] for c in cuts[1]]
        for c, d in zip(cuts[0][1:-1], cuts[1][1:-1]):
            assert own.a.bytes[pair[0][c]][:1] == b" " == own.b.bytes[pair[1][d]][:1]


def test_windows_are_remembered_within_a_bound(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 3)
    own, texts = T.Aligner(A, B), ["one two three four five one two", None, "six seven eight nine"]
    first, again = own.documents(texts), own.documents(texts)
    assert first[1] is again[1] is None and len(own.windows) == 9
    assert all(x[:5] == y[:5] and (x[5] == y[5]).all() and (x[6] == y[6]).all() for x, y in zip(first[::2], again[::2]))


def test_ranks_give_the_librarys_ids(libraries):
    rnd = random.Random(9)
    parts = [" ", " ", " ", "  ", "\n", "\t", " \n", "\x1c", "\x85", "\u00a0", "\u2003", "\u3000", "word", "Word,", "don't", "12", "½", "ö", "e\u0301", "\u0301", "日本", "🙂", "▁", "</s>", "<|endoftext|>", "x" * 70, "\x00", "ʰ", "ª²"]
    texts = ["".join(rnd.choice(parts[:k]) for _ in range(rnd.randint(1, 25))) for k in (10, len(parts)) for _ in range(2000)]
    texts += ["".join(chr(rnd.randrange(0x250)) for _ in range(40)) for _ in range(2000)]
    own = T.ByteLevel(A)
    assert own.fast is not None and any(T._SETTLED.fullmatch(t) for t in texts)
    assert own.encode(texts) == [e.ids for e in libraries[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_pair_table(spark):
    df = spark.createDataFrame([(1, "the cat"), (2, "the dog"), (3, None)], "doc_id long, text string")
    found = {(r.a, r.b): (r.n, r.best) for r in T.pair_table(df, A, B).collect()}
    own = T.Aligner(A, B)
    x, y = own.tokens(["the"])[0]
    assert found[int(x[0]), int(y[0])] == (2, True) and all(b for _, b in found.values())
