"""Hard-negative mining and the fill-in-middle transformation, against brute force."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import fill_in_middle, hard_negatives
from shelfspark.llm.lemp import Index, exact_scores
from tests.llm.data import ODD, documents, sha

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5, low=80, every=100):
    """Rows as the query's contract has them, one by one."""
    known = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        known[(i, label, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v))] = None
    out = []
    for i, label, q in known:
        if i % every:
            continue
        scored = [(sum(a * b for a, b in zip(q, x)), j, m, x) for j, m, x in known if (j, m, x) != (i, label, q) and len(x) == len(q)]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for p, j, m, _ in [s for s in scored if s[2] == label][:k]:
            near = [s for s in scored if s[2] != label and low * p <= 100 * s[0] <= 100 * p][:k]
            out += [(i, j, n + 1, s[1], p, s[0]) for n, s in enumerate(near)]
    return sorted(out)


def mined(spark, rows, **how):
    table = spark.createDataFrame(rows, SCHEMA)
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[c] for c in columns) for r in hard_negatives.hard_negatives(table, **how).collect())


def vectors(n=900, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, dim))
    x = centre[rng.integers(0, 12, n)] * rng.choice([0.2, 1, 3], (n, 1)) + 0.4 * rng.normal(size=(n, dim))
    return [(i, [float(v) for v in row], int(label)) for i, (row, label) in enumerate(zip(x, rng.integers(0, 10, n)))]


@pytest.mark.parametrize("how", [{}, {"shard_floats": 1000, "block_rows": 3}])
def test_negatives_equal_brute_force(spark, how):
    rows = vectors()
    assert mined(spark, rows, **how) == brute(rows)


def test_ties_repeats_nulls_and_odd_vectors(spark):
    same = [1.0, 0.5, -0.25]
    rows = [(100 * i, same, i % 2) for i in range(6)] + [(100, same, 1), (101, same, 1), (101, same, 0), (103, [2.0, 1.0, -0.5], 0)]
    rows += [(None, same, 1), (104, None, 1), (105, same, None), (106, [1.0, None, 0.0], 1), (107, [1.0, float("nan"), 0.0], 0),
             (108, [float("inf"), 0.0, 0.0], 0), (200, [0.0, 0.0, 0.0], 1), (110, [1.0, 2.0], 0), (111, [1.0, 2.0], 1), (300, [], 1), (400, [], 0), (501, [], 1)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(1, same, 1)]) == []
    wide = spark.createDataFrame(vectors(200), SCHEMA).withColumns({"id": F.lit("x"), "score": F.lit(1), "shard": F.lit(None).cast("int")})
    assert hard_negatives.hard_negatives(wide).count() == len(brute(vectors(200)))


def test_pruning_loses_no_vector_and_scores_are_exact():
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.normal(size=(3000, 8)) * rng.choice([0.01, 1, 4], (3000, 1))).astype(np.int64)
    index = Index(x, np.arange(3000), np.zeros(3000, np.int64))
    seen = 0
    for q in x[:40]:
        scores = x @ q
        for least in (1, int(np.quantile(scores, 0.9)), int(np.quantile(scores, 0.999)), int(scores.max()) + 1):
            if least <= 0:
                continue
            found = []
            index.search(q, lambda rows: rows, lambda: least, lambda rows, s: found.extend(rows[s >= least].tolist()))
            assert sorted(found) == np.flatnonzero(scores >= least).tolist()
            seen += len(found)
    assert seen
    big = np.array([[1 << 31, -(1 << 30), 1], [3, 2, 1]])
    assert exact_scores(big[0], big).tolist() == [sum(int(a) * int(b) for a, b in zip(big[0], r)) for r in big]


def test_focus_ranges_prune():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(size=(4000, 16))).astype(np.int64)
    index, met = Index(x, np.arange(4000), np.zeros(4000, np.int64)), []
    best = int((x @ x[0]).max())
    index.search(x[0], lambda rows: rows, lambda: best, lambda rows, s: met.append(len(rows)))
    assert sum(met) < 400


# -- fill in the middle ----------------------------------------------------------------

def expected(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    raw = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(raw[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_transformation_equals_brute_force_and_comes_back(spark):
    rng = np.random.default_rng(4)
    pool = ["word", " ", "é", "<", "P>", "<S", "\n", "日本", "x<M>y", "123", "Zß", "😀"]
    texts = [*ODD, *("".join(rng.choice(pool, rng.integers(0, 30))) for _ in range(300)), "a" * 100_000 + "é" * 50_000, "<P>", "<S>x", "<P", ">"]
    docs = documents(spark, texts, first=-20).unionAll(documents(spark, ["one two", "one two", "three"], first=3)).withColumn("n", F.lit("clash"))
    docs = docs.unionByName(spark.createDataFrame([(None, "no id at all", "x")], "doc_id long, text string, n string"))
    got = fill_in_middle.restored(fill_in_middle.transformed(docs)).collect()
    want = sorted(str((r.doc_id, *expected(r.doc_id, r.text), r.text or "")) for r in docs.collect())
    assert sorted(str((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored)) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.restored(fill_in_middle.transformed(docs.limit(0))).count() == 0


def test_marks_over_text_borders_and_empty_parts():
    import pyarrow as pa
    rng = np.random.default_rng(5)
    pool = ["", "a", "é<", "<P", "P>", "abc d", "\n\nZ9ß", "S>", "ab"]
    for _ in range(300):
        texts = ["".join(rng.choice(pool, rng.integers(0, 4))) for _ in range(rng.integers(0, 8))]
        data, bounds = fill_in_middle.buffer_of(pa.array(texts, pa.string()))
        units = fill_in_middle.Units(data, bounds)
        whole = [not t or any(m in t for m in ("<P>", "<S>", "<M>")) for t in texts]
        form = np.array(["plain" if w else str(rng.choice(["psm", "spm", "plain"])) for w in whole], object)
        a, b = (rng.integers(0, 100, len(texts)) % (units.n + 1) for _ in range(2))
        out, out_bounds = fill_in_middle.scatter(data, bounds, units.byte_of(np.minimum(a, b)), units.byte_of(np.maximum(a, b)), form)
        back, back_bounds = fill_in_middle.gather(out, out_bounds, form)
        assert fill_in_middle.strings(back, back_bounds).to_pylist() == texts


def test_digest_columns_are_those_of_the_texts(spark):
    row = fill_in_middle.op13_fill_in_middle(spark, "/root/testdata/sf0.001").where("doc_id = 1").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id = 1").first().text
    assert (row.n, row.form, row.prefix_chars, row.middle_chars) == expected(1, text)[:4]
    assert row.output_sha256 == sha(expected(1, text)[4]) and row.restored_sha256 == sha(text)
