"""Packing, repair of conversations and alignment of tokenizers against brute force and the libraries themselves."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from noticewindows.llm import span_alignment, token_files, turn_repair, window_packing

BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "a", "x <|endoftext|> y", "two  blanks\n\n\tand\rlines\r\n x;\r\ny", "é 日本語 \U0001f600 ñandú\xa0x 　 y ▂", "▁ mark", "nul\x00 <0x0A> <s> </s>", "ab" * 3000, "\n", "\nfirst", " \t first", "The end. " * 700, "‍́\U0001f468‍\U0001f469"]


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def mixed_texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "house", "straße", "日本", "\U0001f600", "naïve", "x;\r", "foo_bar", "1234", "don't", "́"]
    return ["".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t", "\r", ""]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


# -- packing ---------------------------------------------------------------------------------------------------


def first_fit_by_hand(counts, length):
    """Remaining capacities after best-fit decreasing, one piece after the other."""
    room = []
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            fits = [i for i, r in enumerate(room) if r >= size]
            if fits:
                room[min(fits, key=lambda i: room[i])] -= size
            else:
                room.append(length - size)
    return sorted(room)


@pytest.mark.parametrize("length", [8, 31, 64])
def test_bulk_packing_equals_one_piece_at_a_time(length):
    rng = random.Random(length)
    for _ in range(60):
        counts = {s: rng.choice([0, 1, 2, 5, 9]) for s in range(1, length + 1)}
        counts = {s: n for s, n in counts.items() if n}
        runs, first = window_packing.best_fit(counts, length)
        filled = defaultdict(list)
        for size, n in counts.items():
            for piece in range(first[size], first[size] + n):
                k = np.searchsorted(runs[:, 0], piece, "right") - 1
                filled[int(runs[k, 1] + piece - runs[k, 0])].append((int(runs[k, 2]), size))
        assert sorted(filled) == list(range(len(filled)))
        rooms = []
        for pieces in filled.values():
            at = 0
            for offset, size in sorted(pieces):
                assert offset == at
                at += size
            rooms.append(length - at)
        assert sorted(rooms) == first_fit_by_hand(counts, length)


def test_plan_does_not_grow_with_the_corpus():
    few = {s: 1 + s % 7 for s in range(1, 1025)}
    many = {s: n * 10**9 for s, n in few.items()}
    assert len(window_packing.best_fit(many, 1024)[0]) < 20_000


@pytest.mark.parametrize("parts, limit", [(1, 1_000_000), (5, 0)])
def test_packed_pieces_hold_every_id_once(spark, monkeypatch, parts, limit):
    monkeypatch.setattr(window_packing, "BROADCAST_COUNTS", limit)
    texts = TEXTS + mixed_texts(1, 40)
    docs = documents(spark, texts).selectExpr("*", "1 AS start", "2 AS sequence_id", "'x' AS part").repartition(parts)
    packed = window_packing.pack(docs, length=64)
    rows = packed.collect()
    library = Tokenizer.from_file(BYTE_LEVEL)
    ids = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(ids[r.doc_id]) and r.length == len(r.ids)
        ids[r.doc_id] += r.ids
        assert 0 < r.length <= 64
    for i, text in enumerate(texts):
        assert ids[i] == [*library.encode(text or "", add_special_tokens=False).ids, 0], text
        assert all(r.doc_tokens == len(ids[i]) for r in rows if r.doc_id == i)
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append(r)
    rooms = []
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        rooms.append(64 - at)
    assert sorted(rooms) == first_fit_by_hand(Counter(r.length for r in rows), 64)
    for r in window_packing.windows(packed, 64, pad_id=7).collect():
        want = [i for p in sorted(windows[r.sequence_id], key=lambda p: p.offset) for i in p.ids]
        n = len(want)
        assert r.n_tokens == n
        assert r.ids == want + [7] * (0 if n & (n - 1) == 0 else 64 - n)


def test_packing_of_nothing_and_repeated_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert window_packing.pack(docs).collect() == []
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None), (3, None)], "doc_id long, text string")
    rows = window_packing.pack(docs).collect()
    assert sorted((r.doc_id is None, r.length) for r in rows) == [(False, 1), (False, 1), (True, 3), (True, 3)]
    assert {r.sequence_id for r in rows} == {0}


def test_op11_on_given_documents(spark):
    spark_rows = window_packing.op11_window_packing(spark, "/root/testdata/sf0.001").collect()
    library = Tokenizer.from_file(BYTE_LEVEL)
    given = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    used = Counter()
    for r in spark_rows:
        ids = [*library.encode(given[r.doc_id] or "", add_special_tokens=False).ids, 0]
        part = np.array(ids[r.start : r.start + r.length], "<u4")
        assert (r.doc_tokens, r.length, r.ids_crc32) == (len(ids), len(part), zlib.crc32(part.tobytes()))
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024
    assert len(used) <= 1.02 * sum(used.values()) / 1024 + 1


# -- alignment -------------------------------------------------------------------------------------------------


def tokens_by_hand(text, library, pieces):
    """Token ids and bytes of A and B, from whole texts."""
    alphabet = span_alignment.byte_alphabet()
    a = library.encode(" " + text, add_special_tokens=False)
    b = pieces.encode(text)
    a_bytes = [bytes(alphabet[c] for c in t) for t in a.tokens]
    b_bytes = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
    whole = (" " + text).encode()
    if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return [], [], [], []
    return a.ids, list(np.cumsum([len(x) for x in a_bytes])), b, list(np.cumsum([len(x) for x in b_bytes]))


def alignment_by_hand(texts):
    library = Tokenizer.from_file(BYTE_LEVEL)
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    made, counts = [], Counter()
    for text in texts:
        a, a_end, b, b_end = tokens_by_hand(text or "", library, pieces)
        links = []
        for i, (x, to) in enumerate(zip(a, a_end, strict=True)):
            begin = a_end[i - 1] if i else 0
            for k, (y, end) in enumerate(zip(b, b_end, strict=True)):
                if (b_end[k - 1] if k else 0) < to and begin < end:
                    links.append((x, y))
        counts.update(links)
        groups = []
        for end in sorted(set(a_end) & set(b_end)):
            low = groups[-1][0] if groups else 0
            groups.append((end, [x for x, e in zip(a, a_end, strict=True) if low < e <= end], [y for y, e in zip(b, b_end, strict=True) if low < e <= end]))
        made.append((a, a_end, b, b_end, links, groups))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    rows = []
    for a, _, b, _, links, groups in made:
        shown = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for _, g, h in groups)
        rows.append((len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(shown.encode()).hexdigest() if a else ""))
    return made, counts, rows


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_alignment_equals_brute_force(spark, limit):
    texts = [t for t in TEXTS if t is None or len(t) < 2000] + ["ab" * 100] + mixed_texts(2, 60)
    docs = documents(spark, texts).selectExpr("*", "1 AS n_a", "2 AS links", "3 AS pair").repartition(3)
    _, _, want = alignment_by_hand(texts)
    got = span_alignment.summarise(docs, broadcast_pairs=limit).orderBy("doc_id").collect()
    for r, w, text in zip(got, want, texts, strict=True):
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == w, text


def test_aligned_spans_are_those_of_the_libraries(spark):
    texts = TEXTS + mixed_texts(3, 60)
    library = Tokenizer.from_file(BYTE_LEVEL)
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = span_alignment.align(documents(spark, texts)).orderBy("doc_id").collect()
    for r, text in zip(got, texts, strict=True):
        assert (r.a_ids, r.a_ends, r.b_ids, r.b_ends) == tokens_by_hand(text or "", library, pieces), text


def test_pair_counts_cover_all_rows(spark, monkeypatch):
    monkeypatch.setattr(span_alignment, "CACHE_BYTES", 1000)
    texts = mixed_texts(4, 30) * 3
    _, counts, _ = alignment_by_hand(texts)
    got = span_alignment.pair_counts(documents(spark, texts).repartition(4))
    assert {(r.a_id, r.b_id): r.n for r in got.collect()} == counts
    best = {b: max(n for (_, y), n in counts.items() if y == b) for _, b in counts}
    assert all(r.best == (r.n == best[r.b_id]) for r in got.collect())


def test_workers_keep_of_alignment_only_what_figures_need():
    texts = mixed_texts(5, 40)
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts, pa.string())})
    files = span_alignment.default_files()
    listed = list(span_alignment._listed(files, "text", True)(iter([batch])))
    lean, full = span_alignment.aligner(files, spans=False), span_alignment.aligner(files)
    full.chunks(batch.column(1))
    assert len(lean.keys) == len(full.keys) and set(lean.flat) == {"links", "text"}
    assert lean._size() < 0.7 * full._size()
    links = pa.concat_arrays([b.column("links") for b in listed])
    pairs = np.unique(links.flatten().to_numpy())

    class Table:
        value = (pairs, np.ones(len(pairs), np.int64), np.ones(len(pairs), np.int8))

    rows = [b.drop_columns(["counts"]) for b in listed if b.column("counts").null_count]
    out = list(span_alignment._looked_up(Table)(iter(rows)))
    assert sum(b.num_rows for b in out) == len(texts)
    assert all(b.column("n_best").to_pylist() == b.column("n_links").to_pylist() for b in out)
    assert not span_alignment._ALIGNERS


def test_alignment_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert span_alignment.summarise(docs).collect() == []
    docs = spark.createDataFrame([(None, None), (None, "")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in span_alignment.summarise(docs).select("doc_id", "n_a", "count_sum", "groups_sha256").collect()] == [(0, 0, "")] * 2


def test_special_tokens_follow_the_plain_call(spark):
    library = Tokenizer.from_file(BYTE_LEVEL)
    got = token_files.encode(documents(spark, TEXTS)).orderBy("doc_id").collect()
    for r, text in zip(got, TEXTS, strict=True):
        assert r.ids == [*library.encode(text or "", add_special_tokens=False).ids, 2], text


def test_chunks_are_encoded_in_small_batches():
    texts = [f"w{i} v{i}" for i in range(3000)]
    encoder, sizes = token_files.ChunkEncoder(BYTE_LEVEL), []

    class Library:
        def encode_batch_fast(self, pieces, **options):
            sizes.append(len(pieces))
            return library.encode_batch_fast(pieces, **options)

    library, encoder.tokenizer = encoder.tokenizer, Library()
    ids, offsets = encoder.encode(pa.array(texts), 2)
    assert sum(sizes) == 6000 and max(sizes) <= 2000
    for i in (0, 1999, 2999):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == [*library.encode(texts[i], add_special_tokens=False).ids, 2]


# -- conversations ---------------------------------------------------------------------------------------------

BLANKS = " \t\n\x0b\x0c\r"


def damage_by_hand(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        digest = hashlib.sha256(f"{role}\0{text}".encode()).digest()
        out[conv] += [((turn is not None, turn or 0, role, digest), turn, role, text)] * (2 if kind == 3 else 1)
    return {c: [r[1:] for r in sorted(rows, key=lambda r: r[0])] for c, rows in out.items()}


def cheapest(rows, i, state, known):
    """(cost, audit) of the least way from row ``i`` in role state ``state`` to the end."""
    if (i, state) in known:
        return known[i, state]
    known[i, state] = (10**9, "")  # a way back to here is no way
    found = [(0, "")] if i == len(rows) and state in "0a" else []
    asks = {"0": "u", "s": "u", "u": "a", "a": "u"}[state]
    moves = [(5, "I", i, asks)]
    if i < len(rows):
        fault, initial = rows[i]
        moves.append((2, "D", i + 1, state))
        if fault not in ("blank", "duplicate"):
            extra = 5 if fault == "truncated" else 0
            moves.append((1 + extra, "R", i + 1, asks))
            if initial == asks or (initial == "s" and state == "0"):
                moves.append((extra, "K", i + 1, initial))
    found += [(c + rest[0], e + rest[1]) for c, e, k, s in moves for rest in [cheapest(rows, k, s, known)]]
    known[i, state] = min(found)
    return known[i, state]


def repair_by_hand(rows):
    seen, faults = set(), []
    for _, role, text in rows:
        solid = text.rstrip(BLANKS)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    cost, audit = min(cheapest([(f, r[1][:1]) for f, r in zip(faults, rows, strict=True)], i, "0", {}) for i in [0])
    made, at, state = [], 0, "0"
    for edit in audit:
        asks = "a" if state == "u" else "u"
        if edit in "KRI":
            role = rows[at][1] if edit == "K" else {"u": "user", "a": "assistant"}[asks]
            made.append((role, "" if edit == "I" else rows[at][2]))
            state = role[0]
        at += edit != "I"
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    n = Counter(faults)
    text = "\n".join(f"{r}:{t}" for r, t in made)
    return (gaps, n["blank"], n["duplicate"], n["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest()), made


def random_conversations(seed, n, longest=9):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "agent"])
            text = rng.choice(["Yes.", "No!", "so", "", " \n", None, "Why?", "a b. ", "tail\x0b", "é.", f"n{turn}."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None, -2]), role, text))
    return rows + rows[: n // 3] + [(None, 1, "user", "Yes."), (None, None, "assistant", "No!"), (None, 5, "user", "x")]


def conversation_table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("block", [4096, 2])
def test_repair_equals_brute_force(spark, monkeypatch, tmp_path, block):
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    rows = random_conversations(5, 250)
    table = conversation_table(spark, rows).selectExpr("*", "1 AS pos", "2 AS code", "3 AS digest").repartition(4)
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in turn_repair.op12_turn_repair(spark, str(tmp_path)).collect()}
    want = damage_by_hand(rows)
    assert got.keys() == want.keys()
    for conv, given in want.items():
        assert got[conv] == repair_by_hand(given)[0], (conv, given)


def test_repaired_turns_are_right_conversations(spark):
    rows = [r for r in random_conversations(6, 120) if r[0] is not None]
    rows = [(c, t, r or " ", x or " ") for c, t, r, x in rows]
    _, turns = turn_repair.repair(conversation_table(spark, rows))
    got = defaultdict(list)
    for r in turns.orderBy("conv_id", "place").collect():
        got[r.conv_id].append((r.role, r.text))
    sorted_rows = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{r[2]}\0{r[3]}".encode()).digest())):
        sorted_rows[c].append((t, r, x))
    for conv, given in sorted_rows.items():
        assert got[conv] == repair_by_hand(given)[1], given
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in got[conv]))


def test_crossings_of_long_conversations_equal_a_whole_pass():
    rng = random.Random(8)
    for n in (1, 2, 3, 17, 400):
        codes = bytes(rng.choice([0, 1, 1, 2, 2, 3, 5, 9, 10, 6]) for _ in range(n))
        rows = [("blank" if c & 4 else "truncated" if c & 8 else "", "suax"[c & 3]) for c in codes]
        known = {}
        for i in range(n, -1, -1):  # from the end, so that recursion stays flat
            for state in "0sua":
                cheapest(rows, i, state, known)
        states = turn_repair.crossings([*[turn_repair.TABLES[c] for c in codes], turn_repair.CLOSE], 0, 0)
        audit = "".join(turn_repair.WAYS[c][p, q][1] for c, p, q in zip(codes, states, states[1:], strict=False))
        assert audit + turn_repair.CLOSING[states[-2], 0][1] == known[0, "0"][1]


def test_repair_of_nothing_and_of_one_long_conversation(spark, monkeypatch):
    conversations, turns = turn_repair.repair(conversation_table(spark, []))
    assert conversations.collect() == [] and turns.collect() == []
    monkeypatch.setattr(turn_repair, "BLOCK", 64)
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"n{t}.") for t in range(3000)]
    conversations, turns = turn_repair.repair(conversation_table(spark, rows).repartition(3))
    r = conversations.collect()[0]
    assert (r.cost, r.audit, r.gaps, r.illegal) == (0, "K" * 3000, 0, 0)
    assert turns.count() == 3000
