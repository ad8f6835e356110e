"""The pipeline stage by stage against plain versions."""
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from queryscope.llm import decontaminate as D, mixing, queries, simhash, toxicity
from queryscope.llm.common import stored
from queryscope.llm.queries_mixing import POWERS, topic
from test_circulant import plain_groups as set_groups
from test_decontaminate import plain_best
from test_mixing import plain_fit
from test_simhash import plain_fp, plain_groups
from test_token_files import library, plain  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in C.STAGES:
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        out.append(docs)
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_names_and_columns(spark, steps):
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixture", "tokens"] and C.ORACLE_SQL is None
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(s.columns == columns for s in steps[:4]) and steps[4].columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_toxic_documents_go(spark, steps):
    scored = queries.QUERIES["op1_toxicity"](spark, SF).filter("predicted = 0")
    assert ids(steps[0]) == ids(scored)


def joined_groups(rows):
    """(id, text) -> smallest id that either kind of link reaches."""
    parent = {k: k for k, _ in rows}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for groups in (plain_groups([(k, plain_fp(t)) for k, t in rows]), set_groups(rows, 5)):
        for k, _, c in groups:
            x, y = root(k), root(c)
            parent[max(x, y)] = min(x, y)
    return {k: root(k) for k, _ in rows}


def test_one_of_each_group_stays(steps):
    groups = joined_groups([(r.doc_id, r.text) for r in steps[0].collect()])
    kept = ids(steps[1])
    assert len(kept) == len(set(groups.values())) == len({groups[k] for k in kept})


def test_near_copies_go(spark):
    """Every pair of five-word similarity 0.8 is found among the rows of a larger table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    groups = joined_groups(rows)
    kept = ids(stored(C.drop_near_duplicates(spark, docs, SF), "test-near"))
    assert len(kept) == len(set(groups.values())) == len({groups[k] for k in kept})
    near = {}
    for k, _, c in set_groups(rows, 5):
        near.setdefault(c, []).append(k)
    assert sum(len(m) > 1 for m in near.values()) > 5 and all(len(set(m) & set(kept)) <= 1 for m in near.values())


def test_clashing_names_and_empty_tables(spark):
    columns = ["doc_id", "text", "lang", "source", "ROW", "toxicity_score", "Toxicity_Neighbours", "node", "component_id", "cell_0_s0", "sampled", "k", "t"]
    rows = [(i, f"these are some words of row {i // 2} and some more words to fill it", "en", "s", *range(i, i + 9)) for i in range(8)]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} int" for c in columns[4:])
    for frame in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = stored(frame, "test-names")
        for name, stage in C.STAGES:
            before = {r.doc_id: tuple(r) for r in docs.collect()} if name != "tokens" else {}
            docs = stored(stage(spark, docs, SF), f"test-names-{name}")
            if name != "tokens":
                assert docs.columns == columns and all(before[r.doc_id] == tuple(r) for r in docs.collect())
            if name == "near_duplicates":
                assert docs.count() == len(before) // 2
        assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_leaks_go(spark, steps):
    items = [D.plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r.doc_id for r in steps[1].collect() if all(plain_best(p, D.plain(r.text)) > D.budget(len(p)) for p in items)]
    assert ids(steps[2]) == sorted(clean)


def test_mixture_is_a_sample(spark, steps):
    """A plain fit of the cells gives the probabilities that decide with each id's hash."""
    docs = steps[2].withColumns({"topic": topic(), "n": mixing.words(F.col("text"))}).collect()
    cell = {r.doc_id: (r.source or "", r.lang or "", r.topic) for r in docs}
    tokens = Counter()
    for r in docs:
        tokens[cell[r.doc_id]] += r.n
    shares = []
    for axis, margin in enumerate(mixing.MARGINS):
        sums = Counter()
        for c, n in tokens.items():
            sums[c[axis]] += n
        powered = {v: n ** POWERS[margin] for v, n in sums.items() if n}
        shares.append({v: x / sum(powered.values()) for v, x in powered.items()})
    cells = {c: float(n) for c, n in tokens.items() if n}
    whole, fitted = sum(cells.values()), plain_fit(cells, shares, mixing.KEEP, 24)
    p = {c: fitted[c] * whole * mixing.KEEP / cells[c] for c in cells}
    chance = {k: int(hashlib.md5(f"{k}:mix".encode()).hexdigest()[:13], 16) / 16**13 for k in cell}
    sure = [k for k in cell if abs(chance[k] - p.get(cell[k], 1.0)) > 1e-4]
    kept = set(ids(steps[3]))
    assert len(sure) > len(cell) - 3 and all((k in kept) == (chance[k] < p.get(cell[k], 1.0)) for k in sure)


def test_tokens(steps, library):  # noqa: F811
    rows = sorted((r.doc_id, r.text) for r in steps[3].collect())
    assert [tuple(r) for r in steps[4].orderBy("start").collect()] == plain(rows, library)


def test_run(spark, steps):
    assert sorted(map(tuple, C.run(spark, SF).collect())) == sorted(map(tuple, steps[4].collect()))


def test_repeated_rows_and_nulls(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "x"), (None, "a b c d", "y"), (2, None, "x"), (3, "", "x"), (4, "other words are here", None)]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string, row string"), "test-rows")
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and kept.count() == 3
    benchmark = spark.createDataFrame([(1, "words are here"), (2, None)], "item_id long, text string")
    assert sorted(r.doc_id or 0 for r in D.clean(docs, benchmark).collect()) == [0, 1, 1, 2, 3]
    scored = toxicity.with_scores(docs, toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int")), "text", ("s", "n"))
    assert scored.count() == 6 and scored.columns == [*docs.columns, "s", "n"]
