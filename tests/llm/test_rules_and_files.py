"""Operators with one right answer: rules, token files, pieces, revisits, and the pipeline."""

import random
import re
import zlib
from collections import Counter
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

import corpus_pipeline
from noticewindows.llm import piece_viterbi, quality_rules, store, token_files, warc_revisits

ODD = [None, "", " \n\t", "a", "a b", "a a a a", "x y z\nx y z\n \nx y z", "# b * c", "é ÀB c\x1fd\x85e", "The " * 60, "of the and " * 9000]


def documents(spark, texts=ODD):
    rows = [(i, t, "en", "src", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_quality_counts_equal_brute_force(spark):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("ab c\n#|\tthe ") for _ in range(rng.randint(0, 200))) for _ in range(60)]
    docs = documents(spark, texts).selectExpr("*", "'x' AS kept", "'y' AS n_words", "1 AS n_lines")
    got = quality_rules.apply_rules(docs).orderBy("doc_id").collect()
    for r, text in zip(got, texts, strict=True):
        want = brute_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, text
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_quality_keeps_prose_and_drops_junk(spark):
    rng = random.Random(1)
    prose = " ".join(rng.choice("the of and house garden river stone cloud winter people between".split()) for _ in range(120))
    junk = " ".join(f"w{i}###" for i in range(120))
    table = " | ".join(f"cell{i}" for i in range(120))
    docs = documents(spark, [prose, junk, table, None]).selectExpr("*", "1 AS kept", "2 AS row")
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert [r.doc_id for r in kept.collect()] == [0]
    assert quality_rules.apply_rules(docs.limit(0)).collect() == []


def test_token_files_equal_the_library(spark):
    rng = random.Random(2)
    alphabet = list("ab é\n\t  '1.,  \x85\x1f日本<|endoftext|>s't'll")
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rng.shuffle(texts)
    tokenizer = Tokenizer.from_file(token_files.default_vocabulary())
    path = store.fresh_folder(spark, "tokens")
    token_files.write(token_files.encode(documents(spark, texts).selectExpr("*", "1 AS ids", "2 AS part"), metadata=("lang",), parts=4), path)
    got = {r.doc_id: r for r in token_files.digest(spark, path).collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    few = token_files.read(spark, path, ("doc_id", "lang", "n_tokens"), low=5, high=7)
    assert sorted(r.doc_id for r in few.collect()) == [5, 6, 7]
    empty = store.fresh_folder(spark, "tokens")
    token_files.write(token_files.encode(documents(spark, []), parts=2), empty)
    assert token_files.digest(spark, empty).collect() == []


def test_token_files_order_repeated_and_null_ids(spark):
    rows = [(2, "b"), (None, "n"), (2, "a"), (1, "c")]
    path = store.fresh_folder(spark, "tokens")
    token_files.write(token_files.encode(spark.createDataFrame(rows, "doc_id long, text string"), parts=3), path)
    starts = sorted((r.start, r.doc_id) for r in token_files.digest(spark, path).collect())
    assert [d for _, d in starts] == [None, 1, 2, 2] and [s for s, _ in starts] == [0, 2, 4, 6]


def test_pieces_equal_the_library_and_decode(spark):
    rng = random.Random(3)
    alphabet = list("abetnr  é\n\t  '1.,\u0085日本▁<0x0A>sthe ")
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(400)] + [" " * 40 + "x", "a" * 5000]
    model = sentencepiece.SentencePieceProcessor(model_file=piece_viterbi.default_model())
    docs = documents(spark, texts).selectExpr("*", "1 AS ids", "2 AS n_pieces")
    got = {r.doc_id: r for r in piece_viterbi.encode(docs).collect()}
    assert all(got[i].ids == model.encode(t or "") for i, t in enumerate(texts))
    back = {r.doc_id: r.text for r in piece_viterbi.decode(piece_viterbi.encode(docs)).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))
    digest = piece_viterbi.encode(docs, digest=True).collect()
    assert all(r.round_trip for r in digest)
    assert piece_viterbi.encode(docs.limit(0)).collect() == []
    assert piece_viterbi.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).collect()[0].text == ""


def test_unigram_pass_finds_the_best_sum():
    pieces = piece_viterbi.Pieces(piece_viterbi.default_model(), piece_viterbi.UNIGRAM)
    words = sorted(["▁there", "▁these", "▁then", "▁th", "▁"])

    def best(word):
        total = [0.0] + [float("-inf")] * len(word)
        for end in range(1, len(word) + 1):
            for begin in range(end):
                if word[begin:end] in pieces.scores:
                    total[end] = max(total[end], total[begin] + pieces.scores[word[begin:end]])
        return total[-1]

    for word, found in zip(words, pieces.segment_sorted(words), strict=True):
        assert "".join(found) == word and sum(pieces.scores[p] for p in found) == pytest.approx(best(word))


RECORDS = "record_id long, url string, captured_at timestamp, kind string, profile string, status int, headers array<struct<name: string, value: string>>, payload string, canonical int"


def test_revisits(spark):
    at = lambda day: datetime(2024, 1, day)
    not_modified = warc_revisits.NOT_MODIFIED
    tag = lambda x: [("ETag", x), ("Content-Type", "a")]
    rows = [
        (1, "http://A.com/x/", at(1), "response", None, 200, [*tag('"1"'), ("Date", "old")], "p1", 0),
        (2, "https://www.a.com/x#f", at(3), "response", None, 200, tag('"2"'), "p2", 0),
        (3, "a.com/x?utm_a=1", at(2), "revisit", not_modified, 304, [("etag", 'W/"1"'), ("DATE", "new"), ("Content-Length", "0")], None, 0),
        (4, "http://a.com:80/x", at(4), "revisit", not_modified, 304, tag('"1"'), None, 0),
        (5, "http://a.com/x", at(1), "revisit", not_modified, 304, tag('"1"'), None, 0),
        (6, None, at(4), "revisit", not_modified, 304, None, None, 0),
        (7, "http://a.com/x", None, "revisit", not_modified, 304, [], None, 0),
        (8, "http://a.com/x", at(5), "revisit", not_modified, 304, None, None, 0),
        (9, "http://a.com/x", at(4), "revisit", "other", 304, None, None, 0),
        (10, "http://a.com/x", at(3), "response", None, 404, tag('"9"'), "p9", 0),
        (4, "http://a.com:80/x", at(4), "revisit", not_modified, 304, tag('"1"'), None, 0),
        (11, "http://b.com/?b=2&a=1", at(1), "response", None, 200, [("Last-Modified", "d")], "p11", 0),
        (12, "http://b.com/?a=1&b=2", at(2), "revisit", not_modified, 304, [("last-modified", "d")], None, 0),
    ]
    for parts in (1, 7):
        found = warc_revisits.resolve(spark.createDataFrame(rows, RECORDS), parts).collect()
        got = {r.record_id: r for r in found}
        assert len(found) == 8
        outcome = {i: (r.response_id, r.outcome) for i, r in got.items()}
        assert outcome == {3: (1, "resolved"), 4: (2, "validator_mismatch"), 5: (None, "no_earlier_response"), 6: (None, "no_url"), 7: (None, "no_time"), 8: (2, "no_validator"), 12: (11, "resolved")}
        assert got[3].payload == "p1" and got[4].payload is None
        assert [tuple(h) for h in got[3].headers] == [("Content-Type", "a"), ("etag", 'W/"1"'), ("DATE", "new")]
    assert warc_revisits.resolve(spark.createDataFrame([], RECORDS), 2).collect() == []


def test_hot_url_is_spread_and_right(spark):
    n = 400
    rows = [(i, "http://hot.com/", datetime(2024, 1, 1 + i // 24, i % 24), "response" if i % 9 == 0 else "revisit", None if i % 9 == 0 else warc_revisits.NOT_MODIFIED, 200, [("etag", "x")], f"p{i}", 0) for i in range(n)]
    rows = [r for r in rows if r[2].month == 1]
    found = warc_revisits.resolve(spark.createDataFrame(rows, RECORDS), 6)
    assert {r.record_id: r.response_id for r in found.collect()} == {i: i - i % 9 for i in range(n) if i % 9}


def test_pipeline_stages(spark, tmp_path):
    vocabulary = "the of and house garden river stone cloud winter people between road light morning under letter small green".split()

    def prose(k):
        rng = random.Random(k)
        return " ".join(rng.choice(vocabulary) + (str(rng.randint(0, 99)) if i % 3 else "") for i in range(120))

    item = " ".join(f"bench{i}" for i in range(30))
    near = prose(1).split()
    near[10] = "changed"
    texts = [prose(0), prose(1), " ".join(near), prose(2) + " " + item, "### " * 80, None, "", prose(0)]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    out = corpus_pipeline.run(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r.doc_id for r in out] == [0, 1]
    model = sentencepiece.SentencePieceProcessor(model_file=piece_viterbi.default_model())
    assert [r.ids for r in out] == [model.encode(texts[0]), model.encode(texts[1])]


def test_stages_take_empty_tables(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_word_spans_of_sliced_columns():
    from noticewindows.llm.textblocks import Words

    whole = pa.array(["skip me", None, " a\tbb \n", "", "ccc"])
    words = Words(whole.slice(1), lower=True)
    assert words.offsets.tolist() == [0, 0, 2, 2, 3]
    assert words.hashes.tolist() == Words(pa.array(["A BB CCC"]), lower=True).hashes.tolist()
    long = Words(pa.array(["x" * 3_000_000, "x" * 3_000_000 + "y", "x" * 3_000_000]))
    assert long.hashes[0] == long.hashes[2] != long.hashes[1]
