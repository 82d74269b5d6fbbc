"""Language ID, personal data, decontamination, and the tokenizer operators, against brute force or the library."""

import hashlib
import pickle
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from shelfspark.llm import bpe_codec, decontamination, language_id, pii, token_counts, token_file
from shelfspark.llm.bpe import bpe_of, read_spec
from shelfspark.llm.common import tokenizer_path
from shelfspark.llm.gru import ByteGru
from shelfspark.llm.wavelet import WaveletMatrix
from tests.llm.data import ODD, SCHEMA, documents, sha

BYTE_LEVEL, WORD_LEVEL = "byte_bpe_50k.json", "word_bpe_49k.json"


# -- tokenizers -----------------------------------------------------------------

def texts():
    rng = np.random.default_rng(1)
    letters = list("abc ABC 'sS\t\n\r 12.,<|>\x1c\x85\xa0éßÑ²") + [chr(c) for c in rng.integers(0x100, 0x2FFF, 60)]
    made = ["".join(rng.choice(letters, rng.integers(1, 80))) for _ in range(300)]
    return [*made, *ODD, "<|endoftext|>a <|endoftext|> b<|startoftext|>", "ΑΣ ΟΔΟΣ", "İ", "don't I'LL we've", "a" * 5000 + " " * 3000]


@pytest.mark.parametrize("name", [BYTE_LEVEL, WORD_LEVEL])
def test_merges_equal_the_library(name):
    spec, library = read_spec(tokenizer_path(name)), Tokenizer.from_file(tokenizer_path(name))
    bpe = bpe_of(spec)
    for text in texts():
        if text is None:
            continue
        ids = []
        for part in bpe.parts(text):
            ids += [bpe.special[part]] if part in bpe.special else [i for w in bpe.pre_tokens(part) for i in bpe.merge(w)]
        assert ids == library.encode(text, add_special_tokens=False).ids, text[:80]


def test_transducer_gives_each_word_its_ids_and_no_other_word():
    words = {w.encode(): [i, i + 1] for i, w in enumerate(["", "a", "ab", "abc", "bc", "xbc", "é", "tion", "nation", "station"])}
    automaton = bpe_codec.Transducer.mapped(bpe_codec.Transducer.compile(words).dump())
    asked = [*words, b"b", b"abcd", b"x", b"stat", b"\xff"]
    for word, number in zip(asked, automaton.numbers(asked).tolist()):
        assert (automaton.output(number) if number >= 0 else None) == words.get(word)
    assert len(automaton.final) < sum(len(w) for w in words)  # suffixes are shared
    empty = bpe_codec.Transducer.mapped(bpe_codec.Transducer.compile({}).dump())
    assert empty.numbers([b"a", b""]).tolist() == [-1, -1]


def test_codec_equals_the_library_whatever_the_lexicon(spark):
    docs, library = documents(spark, texts()), Tokenizer.from_file(tokenizer_path(BYTE_LEVEL))
    want = []
    for t in texts():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    for size in (0, 50, 1 << 16):
        got = sorted(bpe_codec.encode_decode(docs, tokenizer_path(BYTE_LEVEL), size).collect())
        assert [tuple(r)[1:] for r in got] == want
    assert bpe_codec.encode_decode(docs.limit(0), tokenizer_path(BYTE_LEVEL)).count() == 0


def test_token_counts_equal_the_library(spark):
    library = Tokenizer.from_file(tokenizer_path(WORD_LEVEL))
    got = sorted(token_counts.token_counts(documents(spark, texts()), tokenizer_path(WORD_LEVEL), limit=20).collect())
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts()]
    assert [(r.n_bytes, r.n_tokens, r.over_limit) for r in got] == [(len((t or "").encode()), n, n > 20) for t, n in zip(texts(), want)]


def repeated(spark):
    """Rows that share an id or have none, equal rows among them, and columns of the operators' own names."""
    rows = [(None, "no id here"), (None, "no id here"), (None, None), (3, "zz top"), (3, "a first"), (3, "a first"), (9, "")]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS n_tokens", "1 AS ids", "2.0 AS score", "'y' AS bucket", "'en' AS lang")


def by_text(rows):
    return sorted(rows, key=repr)


def test_tokenizer_operators_give_a_row_for_every_row(spark):
    docs = repeated(spark)
    byte, word = (Tokenizer.from_file(tokenizer_path(n)) for n in (BYTE_LEVEL, WORD_LEVEL))
    texts_ = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = bpe_codec.encode_decode(docs, tokenizer_path(BYTE_LEVEL)).collect()
    assert by_text((r.doc_id, r.n_tokens, r.decoded_sha256) for r in got) == by_text(
        (i, len(byte.encode(t, add_special_tokens=False).ids), sha(t)) for i, t in texts_)
    got = token_counts.token_counts(docs, tokenizer_path(WORD_LEVEL)).collect()
    assert by_text((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == by_text(
        (i, len(t.encode()), len(word.encode(t, add_special_tokens=False).ids)) for i, t in texts_)


def test_token_file_orders_missing_and_equal_ids(spark, tmp_path):
    path = str(tmp_path / "index")
    token_file.write_index(repeated(spark), path, tokenizer_path(BYTE_LEVEL), shards=2)
    library, at = Tokenizer.from_file(tokenizer_path(BYTE_LEVEL)), 0
    want = []
    for i, t in [(None, ""), (None, "no id here"), (None, "no id here"), (3, "a first"), (3, "a first"), (3, "zz top"), (9, "")]:  # null ids first, then by text
        ids = np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = sorted(map(tuple, token_file.documents_of(token_file.read_index(spark, path)).collect()), key=lambda r: r[1])
    assert got == want


def test_language_of_repeated_rows_and_clashing_columns(spark):
    docs = repeated(spark)
    model = ByteGru(["de", "en"], hidden=4)
    got = language_id.languages(docs, model).collect()
    assert len(got) == 7 and not any(r.held_out for r in got if r.doc_id is None)
    assert len({(r.doc_id, r.lang_pred, r.score) for r in got}) == 5
    assert {r.lang_pred for r in got if r.doc_id == 9} == {"und"}
    kept = language_id.with_known_language(docs, model, min_score=0)
    assert kept.columns == docs.columns and kept.count() == 5
    alike = spark.createDataFrame([(1, f"word {i % 150}", "en") for i in range(300)], "doc_id long, text string, lang string")
    assert language_id.train(alike, sample_docs=20, rounds=1) is not None


def test_proved_words_are_one_token():
    bpe, library = bpe_of(read_spec(tokenizer_path(WORD_LEVEL))), Tokenizer.from_file(tokenizer_path(WORD_LEVEL))
    proved = sorted(token_counts.proved_whole(bpe))
    assert len(proved) > 30000
    assert all(len(library.encode(w, add_special_tokens=False).ids) == 1 for w in proved[::50])


def test_wavelet_matrix_against_numpy():
    rng = np.random.default_rng(2)
    for n, bits in ((0, 3), (1, 3), (513, 4), (3000, 6)):
        tokens = rng.integers(0, 1 << bits, n).astype(np.uint16)
        m = WaveletMatrix.build(tokens, bits)
        assert (m.tokens() == tokens).all()
        assert all(m.access(i) == tokens[i] for i in range(min(n, 100)))
        for t in range(4):
            assert m.positions(t) == np.flatnonzero(tokens == t).tolist()
            assert m.rank(t, n // 2) == (tokens[:n // 2] == t).sum()
    with pytest.raises(IndexError):
        m.select(0, n)


def test_token_file_round_trip(spark, tmp_path):
    library, path = Tokenizer.from_file(tokenizer_path(BYTE_LEVEL)), str(tmp_path / "index")
    token_file.write_index(documents(spark, texts()), path, tokenizer_path(BYTE_LEVEL), segment_tokens=500, shards=3)
    index, at = token_file.read_index(spark, path), 0
    rows = sorted(token_file.documents_of(index).collect(), key=lambda r: r.doc_id)
    counted = found = 0
    for row, text in zip(rows, texts(), strict=True):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert tuple(row)[1:] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
        counted += int((ids == 64).sum())
        found += int((ids == 2).sum())
    assert token_file.count(index, 64) == counted and token_file.count(index, 2) == found
    assert token_file.occurrences(index, 2).count() == found
    token_file.write_index(documents(spark, []), str(tmp_path / "none"), tokenizer_path(BYTE_LEVEL))
    assert token_file.documents_of(token_file.read_index(spark, str(tmp_path / "none"))).count() == 0


# -- language -----------------------------------------------------------------------

def test_gradients_equal_differences():
    rng = np.random.default_rng(3)
    net = ByteGru(["a", "b"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, valid, y = rng.integers(97, 103, (4, 12)).astype(np.uint8), np.array([12, 5, 12, 9]), np.array([0, 1, 1, 0])
    _, grads = net.loss(x, valid, y)
    for k, v in net.p.items():
        at = (99, 2) if k[0] == "W" else tuple(0 for _ in v.shape)
        old = v[at]
        v[at] = old + 1e-4
        up, _ = net.loss(x, valid, y)
        v[at] = old - 1e-4
        down, _ = net.loss(x, valid, y)
        v[at] = old
        assert abs((up - down) / 2e-4 - grads[k][at]) < 1e-3


def test_held_out_accuracy_and_edge_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.train(docs, rounds=120)
    got = {r.doc_id: r for r in language_id.languages(docs, model).collect()}
    true = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in true if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r.held_out} == set(held)
    assert np.mean([got[i].lang_pred == true[i] for i in held]) >= 0.95
    odd = documents(spark, [None, "", "123 !!", "the and of", "x" * 200_000])
    rows = sorted(language_id.languages(odd, model).collect())
    assert [r.lang_pred for r in rows[:3]] == ["und"] * 3 and all(0 <= r.score <= 1 for r in rows)
    kept = language_id.with_known_language(odd, model)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {3}
    nothing = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language_id.languages(nothing).first().lang_pred == "und"
    assert language_id.languages(docs.limit(0)).count() == 0


# -- personal data ------------------------------------------------------------------

def brute_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(4)
    made = ["".join(rng.choice(list("0123456789 .-+@ab()"), rng.integers(1, 60))) for _ in range(4000)]
    for text in [*made, "4111 1111 1111 1111", "a@b.c@d.e.f", "1.2.3.4.5.6.7.8", "x@y"]:
        assert pii.base_spans(text) == brute_spans(text), text


def test_scans_are_linear_on_runs():
    for unit in ("a", "1", "1 ", "+1", "a@", "1.", ":", "("):
        pii.base_spans(unit * 50_000)
        pii.proposals(unit * 20_000)


def test_numbers_in_many_groups_are_found_whole():
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    texts = [d["text"] for d in docs if d["text"] and re.search("[0-9@]", d["text"])]
    model = pii.PiiModel(sorted(r for t in texts for r in pii.training_rows(t)))
    for number, kind in (("00 33 1 23 45 67 89 01", pii.PHONE), ("00 49 3 01 23 45 67", pii.PHONE), ("41. 11. 11. 11. 11. 11. 11. 11", pii.CARD),
                         ("41/ 11/ 11/ 11/ 11/ 11/ 11/ 11", pii.CARD)):
        text = f"call or pay {number} today"
        span = (12, kind, 12 + len(number))
        assert span in pii.proposals(text), number
        assert pii.find([text], model)[0][1] == [span], number


def test_glued_numbers_and_bare_spellings_are_proposed():
    for text, span, kind in (("x 4111.1111.1111.1111/123456 y", "4111.1111.1111.1111", pii.CARD), ("0612345678/0612345679", "0612345679", pii.PHONE),
                             ("0612345678-0612345679-12", "0612345678", pii.PHONE), ("bob AT example DOT com", "bob AT example DOT com", pii.EMAIL)):
        at = text.index(span)
        assert (at, kind, at + len(span)) in pii.proposals(text), text


def test_redaction_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "mail a@b.com", "x", 5, None)], SCHEMA + ", spans string, n_email int, kind string")
    row = pii.redact(docs, pii.PiiModel([])).first()
    assert row.asDict() == {"doc_id": 1, "text": "mail <EMAIL>", "spans": "x", "n_email": 5, "kind": None}


def test_model_adds_spelled_out_addresses_and_keeps_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.train(docs)
    odd = documents(spark, ["write bob.x [at] mail.example.com now", "bob@mail.example.com", None, "", "no data, order 9914969043960559 here"])
    rows = sorted(pii.personal_data(odd, model).collect())
    assert rows[0].spans == "email:6:33" and rows[0].n_email == 0
    assert (rows[1].n_email, rows[1].spans) == (1, "email:0:20")
    assert rows[1].base_sha256 == sha("email:0:20") and rows[2].base_sha256 == sha("")
    assert [r.spans for r in rows[2:]] == ["", "", ""]
    redacted = {r.doc_id: r.text for r in pii.redact(odd, model).collect()}
    assert redacted[0] == "write <EMAIL> now" and redacted[2] is None
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_training_sample_is_bounded_whatever_the_ids(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "PiiModel", seen.append)
    for first, texts in ((None, [f"mail a{i}@b.com" for i in range(300)]), (None, ["mail a@b.com"] * 300), (0, [f"mail a{i}@b.com" for i in range(300)])):
        docs = spark.createDataFrame([(first if first is None else i, t) for i, t in enumerate(texts)], SCHEMA)
        pii.train(docs, sample_docs=20)
    per_text = len(pii.training_rows("mail a1@b.com"))
    spread, copies, distinct = (len(rows) / per_text for rows in seen)
    assert 0 < spread <= 40 and copies <= 40 and 0 < distinct <= 40


# -- decontamination -----------------------------------------------------------------

def test_windows_short_items_blocks_and_removal(spark):
    words = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(5, 17))), (2, "Short Item"), (3, None), (4, ""), (None, "lost item"),
                                   (1, " ".join(f"w{i}" for i in range(5, 17)))], "item_id long, text string")
    docs = documents(spark, [words, words.upper().replace(" ", "; "), "a short, item b", "w5 w6 w7", None, "", "the lost-item!"])
    want = [(30, 12, 1, "1", True), (30, 12, 1, "1", True), (4, 2, 1, "2", True), (3, 0, 0, "", False), (0, 0, 0, "", False),
            (0, 0, 0, "", False), (3, 2, 0, "", True)]
    want = [(a, b, c, sha(d), e) for a, b, c, d, e in want]
    for block in (decontamination.BLOCK_BYTES, 30):
        got = sorted(decontamination.contamination(docs, bench, block_bytes=block).collect())
        assert [tuple(r)[1:] for r in got] == want
    assert sorted(r.doc_id for r in decontamination.decontaminate(docs, bench).collect()) == [3, 4, 5]
    cut = {r.doc_id: r.text for r in decontamination.decontaminate(docs, bench, remove="spans").collect()}
    assert cut[2] == "a  b" and cut[3] == "w5 w6 w7" and cut[4] is None
    assert decontamination.contamination(docs.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in decontamination.contamination(docs, bench.limit(0)).collect())


def test_a_block_of_windows_stays_small():
    rng = np.random.default_rng(6)
    pool = [f"word{i}" for i in range(20_000)]
    items = [(i, " ".join(rng.choice(pool, 150))) for i in range(1000)]
    size = sum(len(t) for _, t in items)
    windows = decontamination.TestWindows(items, 10)
    assert len(pickle.dumps(windows)) < 8 * size
    twice = decontamination.TestWindows(items + [(5000, items[7][1]), (5001, items[7][1] + " tail")], 10)
    _, covered, found = twice.scan([items[7][1].encode(), b"", items[8][1].upper().encode()])
    assert found == [{7, 5000, 5001}, set(), {8}] and covered.all()


def test_spans_are_cut_alike_whatever_the_block_size(spark):
    """Overlapping windows of several items, and clean words that only a cut would make neighbours."""
    w = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate([w[5:17], w[12:24], w[14:26], w[:5] + w[26:32], ["left", "right"]])],
                                  "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(w), 7), (1, "left " + " ".join(w[5:17]) + " right", 8), (None, None, 9)], SCHEMA + ", hit int")
    want = [(1, " ".join(w[:5]) + "  " + " ".join(w[26:]), 7), (1, "left  right", 8), (None, None, 9)]
    for block in (decontamination.BLOCK_BYTES, 60):
        got = decontamination.decontaminate(docs, bench, remove="spans", block_bytes=block)
        assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=lambda r: r[2]) == want, block


def test_pass_through_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 7, "x", None)], SCHEMA + ", n_hit int, words string, lang string")
    bench = spark.createDataFrame([(1, "zzz")], "item_id long, text string")
    assert decontamination.decontaminate(docs, bench).first() == docs.first()
    assert hashlib.sha256(b"").hexdigest() == sha("")
