"""Line dedup, suffix-array dedup, Jaccard join, embedding near-dedup and the pipeline, against brute force."""

import re
import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenizers import Tokenizer

import corpus_pipeline
from shelfspark.llm import embedding_dedup, jaccard_join, language_id, line_dedup, queries, suffix_dedup
from shelfspark.llm.common import tokenizer_path
from shelfspark.llm.graph import components
from shelfspark.llm.hnsw import Hnsw
from shelfspark.llm.repeats import Runs, SuffixArray
from tests.llm.data import ODD, documents, sha

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    want = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, SMALL).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_components_of_a_chain_a_star_and_a_cycle(spark):
    edges = [(i, i + 1) for i in range(10, 30)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 10 for i in range(11, 31)}, **{i: 100 for i in range(101, 140)}, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- lines -------------------------------------------------------------------------

def brute_lines(rows):
    first = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = line_dedup.line_key(line)
            if len(key.decode()) >= 10:
                first[key] = min(doc, first.get(key, doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if first.get(line_dedup.line_key(x), doc) >= doc]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out)


def test_line_runs_over_several_batches(spark):
    rng = np.random.default_rng(5)
    pool = [f"  Some common Line {i} \t" for i in range(12)] + ["short", "", "É" * 10, "é" * 10, "x" * 5000]
    rows = [(int(d), "\n".join(rng.choice(pool, rng.integers(0, 8)))) for d in range(40)] + [(50, None), (51, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n, fanout in ((1, 2), (5, 2)):
        got = sorted(tuple(r) for r in line_dedup.line_report(docs, n=n, fanout=fanout).collect())
        assert got == brute_lines(rows)
    # Rows that share an id, or have none, lose only their own text's lines.
    shared = spark.createDataFrame([(1, "a repeated long line"), (7, "one more different line"), (7, "a repeated long line\nzz"),
                                    (None, "totally other words here\nsecond own line here"), (None, "a repeated long line\nand what follows it"),
                                    (None, "and what follows it")], "doc_id long, text string")
    for n in (1, 3):
        kept = sorted((r.doc_id or 99, r.text) for r in line_dedup.dedup_lines(shared, n=n).collect())
        assert kept == [(1, "a repeated long line"), (7, "one more different line"), (7, "zz"), (99, "and what follows it"), (99, "and what follows it"),
                        (99, "totally other words here\nsecond own line here")]
    left = sorted((r.doc_id or 99, r.text) for r in line_dedup.dedup_lines(shared.unionAll(documents(spark, ["a repeated long line\n \n", "", None], 50)),
                                                                             drop_emptied=True).collect() if r.text)
    assert (50, "") not in left and not [i for i, _ in left if i == 50]
    plan = line_dedup.batches(spark.read.parquet(f"{SMALL}/documents.parquet"), 3)[1]._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThan(doc_id" in plan
    same = spark.createDataFrame([(1, "a repeated line", 9), (1, "a repeated line", 8), (None, "a repeated line", 7), (2, None, 6)],
                                 "doc_id long, text string, dropped int")
    kept = sorted((r.doc_id or 99, r.text, r.dropped) for r in line_dedup.dedup_lines(same).collect())
    assert kept == [(1, "a repeated line", 8), (1, "a repeated line", 9), (2, None, 6), (99, "", 7)]
    assert line_dedup.line_report(docs.limit(0)).count() == 0


# -- repeats -----------------------------------------------------------------------

def covered(strings, least):
    seen, marks = {}, [bytearray(len(s)) for s in strings]
    for i, s in enumerate(strings):
        for p in range(len(s) - least + 1):
            seen.setdefault(s[p:p + least], []).append((i, p))
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                marks[i][p:p + least] = b"\1" * least
    return marks


def test_suffix_array_covers_what_brute_force_covers():
    rng = np.random.default_rng(6)
    for _ in range(150):
        letters, least = int(rng.choice([1, 2, 3, 200])), int(rng.choice([3, 5, 8]))
        strings = [bytes(rng.integers(0, letters, rng.integers(least, 60)).tolist()) for _ in range(rng.integers(1, 7))]
        if rng.random() < 0.5:
            strings.append(strings[0] + strings[-1])
        array = SuffixArray(strings, [len(s) - least + 1 for s in strings])
        want = b"\0".join(bytes(m) for m in covered(strings, least)) + b"\0"
        assert array.covered(least).tolist() == [bool(b) for b in want]
        for length, first, last in array.maximal(least):
            places = array.at[first:last + 1]
            shared = {bytes(b"\0".join(strings)[p:p + length]) for p in places.tolist()}
            assert len(shared) == 1 and len(places) > 1 and (len(set(array.left_symbol[first:last + 1].tolist())) > 1
                                                             or array.left_symbol[first] < 0)
        runs, seen = Runs(strings, least, 3), {}
        for t, s, c, v in zip(runs.text, runs.start, runs.count, runs.anchor):
            for p in range(s, s + c):
                assert seen.setdefault(strings[t][p:p + least], v) == v


def test_suffix_array_holds_few_bytes_per_place():
    rng = np.random.default_rng(8)
    base = rng.integers(32, 127, 400).astype(np.uint8)
    strings = []
    for _ in range(800):  # near copies of one passage
        copy = base.copy()
        copy[rng.integers(0, 400, 2)] = 33
        strings.append(copy.tobytes())
    tracemalloc.start()
    try:
        array = SuffixArray(strings, [201] * 800)
        marks = array.covered(200)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert marks.tolist() == [bool(b) for b in b"\0".join(bytes(m) for m in covered(strings, 200)) + b"\0"]
    assert peak < 64 * array.places


def test_long_runs_of_one_anchor_equal_brute_force(spark):
    """Runs that repeat inside are few and long: they are bounded by bytes, not by their number."""
    texts = [f"{i:03d}" + "-" * (300 + 7 * i) + f"end {i}" for i in range(12)] + ["=" * 70_000, "." * 59, "plain"]
    docs = documents(spark, texts)
    raw = [t.encode() for t in texts]
    found = suffix_dedup.runs(docs, 60, 4, hot_bytes=2_000).where("text_needed").groupBy("hot").count().collect()
    assert {r.hot: r["count"] for r in found}[True] >= 13
    for hot_bytes in (2_000, 1 << 22):
        spans = suffix_dedup.repeat_spans(docs, 60, hot_bytes=hot_bytes)
        assert spans.count() < 200  # windows are united
        got = sorted(suffix_dedup.without_repeats(docs, 60, hot_bytes=hot_bytes).collect())
        assert [bytes(r.kept) for r in got] == [bytes(x for x, g in zip(t, m) if not g) for t, m in zip(raw, covered(raw, 60))]


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeats_equal_brute_force(spark, hot):
    rng = np.random.default_rng(7)
    words = [f"{w}é" for w in range(40)]
    base = " ".join(rng.choice(words, 60))
    texts = [base, base[5:], base + " end", " ".join(rng.choice(words, 50)) + base[:120], "ab" * 150, "q" * 700, *ODD, base]
    docs = documents(spark, texts)
    got = sorted(suffix_dedup.repeat_report(docs, size=60, hot_runs=hot).collect())
    raw = [(t or "").encode() for t in texts]
    want = []
    for i, m in enumerate(covered(raw, 60)):
        kept = bytes(x for x, g in zip(raw[i], m) if not g)
        spans = sum(1 for p in range(len(m)) if m[p] and (p == 0 or not m[p - 1]))
        want.append((i, len(raw[i]), sum(m), spans, kept))
    parts = sorted(tuple(r) for r in suffix_dedup.without_repeats(docs, 60, hot).select("doc_id", "n_removed", "n_spans", "kept").collect())
    assert [(d, n, s, bytes(k)) for d, n, s, k in parts] == [(w[0], w[2], w[3], w[4]) for w in want]
    assert [(r.n_bytes, r.n_removed, r.n_spans) for r in got] == [w[1:4] for w in want]
    twice = spark.createDataFrame([(1, base), (1, base), (None, base)], "doc_id long, text string")
    assert all(r.n_removed == len(base.encode()) for r in suffix_dedup.repeat_report(twice, 60).collect())
    assert suffix_dedup.repeat_report(docs.limit(0)).count() == 0


# -- near copies --------------------------------------------------------------------

def brute_components(texts, percent=75):
    sets = []
    for t in texts:
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        w = [x for x in re.split("[ \t-\r]+", w) if x]
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    return [(i, len(s), label[i]) for i, s in enumerate(sets)]


def test_jaccard_components_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    vocabulary = [f"v{i}" for i in range(300)]
    texts = list(ODD) + ["one two", "One TWO", "one two three four five six", "one two three four five"]
    for _ in range(6):
        base = list(rng.choice(vocabulary, rng.integers(20, 90)))
        for _ in range(9):
            copy = list(base)
            for at in rng.integers(0, len(copy), rng.integers(0, 4)):
                copy[at] = str(rng.choice(vocabulary))
            texts.append(" ".join(copy[rng.integers(0, 6):]))
    docs = documents(spark, texts)
    for frequent in (2, 5, 32):  # the class of frequent tokens changes the signatures, never the result
        monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
        assert sorted(tuple(r) for r in jaccard_join.classes_and_components(docs).collect()) == brute_components(texts)
    kept = jaccard_join.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute_components(texts)})
    odd = spark.createDataFrame([(None, "same words here"), (3, "same words here"), (3, "same words here"), (9, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard_join.classes_and_components(odd).collect())
    assert got == [(0, 1, 0), (3, 1, 3), (3, 1, 3), (9, 0, 9)]
    assert jaccard_join.classes_and_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [60, 75, 90])
def test_components_at_other_similarities_and_of_copies_that_do_not_link(spark, monkeypatch, percent):
    """Many edits of one text: most copies share nearly all shingles and link with nothing."""
    rng = np.random.default_rng(12)
    base, texts = [f"b{i}" for i in range(60)], []
    for i in range(60):
        copy = list(base)
        for at in rng.choice(60, rng.integers(0, 6), replace=False):
            copy[at] = f"e{i}x{at}" if rng.random() < 0.8 else f"common{at}"
        texts.append(" ".join(copy))
    texts += [" ".join(base[:40]), " ".join(base[:52]), " ".join(base + base[:9])]
    for frequent in (2, 32):
        monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
        got = sorted(tuple(r) for r in jaccard_join.classes_and_components(documents(spark, texts), percent=percent).collect())
        assert got == brute_components(texts, percent)


def test_percent_and_clashing_columns(spark):
    docs = documents(spark, ["one two three four five six", "one two three four five six", "other"])
    with pytest.raises(ValueError):
        jaccard_join.classes_and_components(docs, percent=50)
    wide = docs.withColumns({"component_id": F.lit(7), "n_shingles": F.lit("x"), "rep": F.lit(None).cast("long")})
    kept = jaccard_join.keep_one(wide)
    assert kept.columns == wide.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2]


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(9)
    for _ in range(300):
        n = int(rng.integers(3, 200))
        a = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(0, 1 << 60, rng.integers(0, 1 + n // 12)).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (len(a) + len(b) - both):
            continue
        keys = jaccard_join.token_keys(np.union1d(a, b), 64)
        for share in (0, 0.3, 0.8, 1):
            frequent = np.sort(keys[rng.random(len(keys)) < share])
            x, y = (set(np.concatenate(jaccard_join.signatures(t, frequent, 75, 64)[:2]).tolist()) for t in (a, b))
            assert x & y


def test_linked_sets_meet_at_a_low_level():
    """Sets that share no rare token share a pair whose level is within what both may lose at their sizes, not at the worst partner's."""
    rng, seen = np.random.default_rng(19), 0
    for _ in range(300):
        base = np.unique(rng.integers(0, 1 << 60, int(rng.integers(8, 250))).astype(np.uint64))
        a, b = (np.unique(np.concatenate([base[rng.random(len(base)) < share], rng.integers(0, 1 << 60, rng.integers(0, 1 + len(base) // 9)).astype(np.uint64)]))
                for share in rng.uniform(0.88, 1, 2))
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (len(a) + len(b) - both):
            continue
        frequent = np.sort(jaccard_join.token_keys(base, 64))
        (rare_a, sig_a, level_a, plain_a), (rare_b, sig_b, level_b, plain_b) = (jaccard_join.signatures(t, frequent, 75, 64) for t in (a, b))
        if plain_a or plain_b:
            continue
        assert not len(np.intersect1d(rare_a, rare_b)) and level_a.min() >= 1
        total = -(-75 * (len(a) + len(b)) // 175)
        low_a, low_b = (set(sig[level <= len(t) - len(rare) - total + 1].tolist()) for t, rare, sig, level in ((a, rare_a, sig_a, level_a), (b, rare_b, sig_b, level_b)))
        assert low_a & low_b
        seen += 1
    assert seen > 50


def test_last_round_meets_pairs_at_few_signatures(spark, monkeypatch):
    """Copies with differing edits, most of them too far apart to link: pairs used to meet at every signature that they share."""
    rng = np.random.default_rng(20)
    base, texts = [f"b{i}" for i in range(150)], []
    for i in range(160):
        copy = list(base)
        for at in rng.choice(150, rng.integers(2, 6), replace=False):
            copy[at] = f"e{i}x{at}"
        texts.append(" ".join(copy))
    made, meetings = [], jaccard_join.last_meetings

    def counting(now, scratch, percent):
        pairs = meetings(now, scratch, percent).where("a < b AND ca != c").localCheckpoint()
        sets = now.select("sig", "rep")
        shared = sets.withColumnRenamed("rep", "a").join(sets.withColumnRenamed("rep", "b"), "sig").join(pairs.select("a", "b").distinct(), ["a", "b"])
        made.append((pairs.count(), shared.count()))
        return pairs

    monkeypatch.setattr(jaccard_join, "last_meetings", counting)
    got = sorted(tuple(r) for r in jaccard_join.classes_and_components(documents(spark, texts)).collect())
    assert got == brute_components(texts)
    assert 0 < 3 * made[0][0] <= made[0][1]


def test_a_rare_signature_is_not_merged_with_a_pair_of_the_same_sets(spark):
    rows = [(sig, rep, rep, rep, level) for sig, level in ((1, 3), (2, 0), (3, 3), (4, 1)) for rep in (7, 8, 9)]
    now = spark.createDataFrame(rows, "sig long, rep long, d1 long, c long, level int")
    assert sorted(r.sig for r in jaccard_join.one_per_group(now, "level").collect()) == [1, 2, 4]
    assert [r.sig for r in jaccard_join.one_per_group(now).collect()] == [1]


def test_one_scan_counts_tokens_and_lists_every_document(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", 2)
    texts = [None, "", "a b c d e f", "x a b c d e", "q r", "q r"]
    docs = documents(spark, texts).union(spark.createDataFrame([(None, "null id here")], "doc_id long, text string")).repartition(3)
    rows = [tuple(r) for r in jaccard_join.counted(docs, 5, 8).collect()]
    assert sorted(n for key, n, *_ in rows if key is not None) == [2, 2]
    sets = jaccard_join.shingle_sets([(t or "").encode() for t in texts] + [b"null id here"], 5)
    want = [(i, len(s), *jaccard_join.digest(s)) for i, s in zip([0, 1, 2, 3, 4, 5, None], sets)]
    assert sorted((r[2], r[1], *r[3:]) for r in rows if r[0] is None and r[2] is not None) == want[:6]
    assert [(r[2], r[1], *r[3:]) for r in rows if r[0] is None and r[2] is None] == want[6:]


def test_shingle_sets_do_not_depend_on_runs(monkeypatch):
    texts = [" ".join(f"w{(i * j) % 91}" for j in range(i * 7 % 200)).encode() for i in range(80)]
    whole = jaccard_join.shingle_sets(texts, 5)
    for run in (1, 100, 5000):
        monkeypatch.setattr(jaccard_join, "RUN_BYTES", run)
        assert all(np.array_equal(a, b) for a, b in zip(whole, jaccard_join.shingle_sets(texts, 5), strict=True))
        assert jaccard_join.shingle_sets([], 5) == []
    long = b"some words " * 150_000  # longer than the powers that are kept
    assert len(jaccard_join.shingle_sets([long], 5)[0]) == 2


# -- vectors ------------------------------------------------------------------------

def clustered(n=700, dim=24, seed=10):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(0, n, 5):
        for j in range(1, 1 + i % 4):
            x[i + j] = 3 * x[i] + 0.9 * rng.normal(size=dim)
    x[n // 2:n // 2 + 60] = x[0] + 0.15 * rng.normal(size=(60, dim))
    return x.astype(np.float32)


def test_graph_finds_links_and_whole_groups():
    x = clustered(3000)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = Hnsw.build(x).audited(0.9, 0.98)
    q, node = graph.within(x, 0.9)
    found = np.zeros((len(x), len(x)), bool)
    found[q, node] = True
    true = x @ x.T >= 0.9
    assert found[true].mean() >= 0.99 and not found[~true].any()


def test_embedding_links_equal_brute_force(spark):
    x = clustered()
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(9000, None), (9001, [0.0] * 24), (9002, [float("nan")] * 24), (9003, []), (9004, [1.0, 2.0]), (None, rows[0][1]), (9005, rows[0][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit("x"))
    unit = np.concatenate([x, x[:1]]).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    ids = [*range(len(x)), 9005]
    label = np.array(ids)
    while True:
        new = np.array([min([label[i], *label[link[i]]]) for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(table).collect()}
    n_links = np.array([got[i].n_links for i in ids])
    assert n_links.sum() >= 0.99 * link.sum() and (n_links <= link.sum(1)).all()
    assert np.mean([got[i].component_id == c for i, c in zip(ids, label.tolist())]) >= 0.99
    for i in (9000, 9001, 9002, 9003, 9004):
        assert tuple(got[i]) == (i, 0, i, True)
    assert tuple(got[None]) == (None, 0, None, False)
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


# -- pipeline -----------------------------------------------------------------------

def stage(spark, name, docs):
    return corpus_pipeline.written(dict(corpus_pipeline.STAGES)[name](spark, docs, SMALL), f"test-{name}")


def test_pipeline_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(90).withColumns({"dropped": F.lit(1), "ids": F.lit("x"), "hit": F.lit(None).cast("string")})
    rows = {r.doc_id: r for r in docs.collect()}
    first = next(r for r in rows.values() if r.text and len(r.text.split()) > 60)
    benchmark = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    made = [(5000, first.text), (5001, "123 456"), (5002, " ".join(first.text.split())), (None, None), (5003, None), (5003, ""),
            (5004, f"the new line that holds {max(benchmark, key=len)} and some more of the words that follow")]
    docs = docs.unionByName(spark.createDataFrame(made, "doc_id long, text string"), allowMissingColumns=True)
    columns = docs.columns

    after = stage(spark, "language_id", docs)
    model = language_id.train(docs)
    want = sorted(r.doc_id for r in docs.collect() if (p := language_id.predict([r.text], model)[0])[0] != "und" and p[1] >= language_id.MIN_SCORE)
    assert sorted(r.doc_id for r in after.collect()) == want and not {5001, 5003, None} & set(want) and {5000, 5002} <= set(want)
    assert after.columns == columns

    before, after = after.collect(), stage(spark, "line_dedup", after)
    kept = dict((d, (n, text)) for d, n, text in brute_kept([(r.doc_id, r.text) for r in before]))
    want = sorted((d, text) for d, (n, text) in kept.items() if not n or text.strip(line_dedup.BLANKS))
    assert sorted((r.doc_id, r.text) for r in after.collect()) == want and after.columns == columns

    before, after = after.collect(), stage(spark, "jaccard_join", after)
    ids = [r.doc_id for r in before]
    want = sorted({ids[c] for _, _, c in brute_components([r.text for r in before])})  # rows are in no order: any representative of a group
    got = sorted(r.doc_id for r in after.collect())
    groups = {}
    for i, _, c in brute_components([r.text for r in before]):
        groups.setdefault(c, []).append(ids[i])
    assert got == sorted(min(g) for g in groups.values()) and len(got) == len(want) and after.columns == columns
    assert 5002 not in got or first.doc_id not in got                  # the same words on one line are a near copy

    before, after = after.collect(), stage(spark, "decontamination", after)
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower())  # noqa: E731  (the test's texts are ASCII where it matters)
    grams = {tuple(w[i:i + 10]) for w in map(words, benchmark) for i in range(max(1, len(w) - 9)) if w}
    def hit(text):
        w = words(text)
        return any(tuple(w[i:i + n]) in grams for n in {len(g) for g in grams} for i in range(len(w) - n + 1))
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in before if not hit(r.text)) and after.columns == columns
    assert 5004 in {r.doc_id for r in before} and 5004 not in {r.doc_id for r in after.collect()}

    before, after = after.collect(), stage(spark, "bpe_codec", after)
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = sorted((r.doc_id, len(ids := library.encode(r.text or "", add_special_tokens=False).ids), sha(library.decode(ids, skip_special_tokens=False))) for r in before)
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in after.collect()) == want


def brute_kept(rows):
    first = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = line_dedup.line_key(line)
            if len(key.decode()) >= 10:
                first[key] = min(doc, first.get(key, doc))
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if first.get(line_dedup.line_key(x), doc) >= doc]
        yield doc, len(lines) - len(kept), "\n".join(kept)


def test_pipeline_of_an_empty_table_and_of_null_texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for some in (docs.limit(0), docs.limit(3).withColumn("text", F.lit(None).cast("string"))):
        for name, _ in corpus_pipeline.STAGES:
            some = stage(spark, name, some)
        assert some.count() == 0
