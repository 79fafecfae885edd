"""SentencePiece encoding and decoding by a Viterbi pass that words with a common prefix share.

The marked words of a slab of texts (a run of blanks, written as the mark, and the characters after it) are made
distinct and sorted; the sorted list is a trie in depth-first order.  The forward pass keeps one state per character
of the current path: the last piece of the best segmentation of that prefix and where it starts.  The next word keeps
the states of the prefix that it shares with the word before and adds only its own characters.

Unigram models maximise the sum of piece scores.  In merge models a segmentation is admissible when no pair of
neighbouring pieces would have been merged across its border; exactly one segmentation of each prefix is, so the
forward pass finds the result of the merges without carrying them out.  Characters without a piece become byte pieces.

Defined results: null and empty texts have no pieces.  A mark character in a text counts as a blank, as in the format
itself.  Rows are encoded on their own, repeated rows alike; decoding invalid byte sequences gives U+FFFD.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticewindows.llm.textblocks import released, slabs, text_bytes
from noticewindows.llm.token_files import ChunkEncoder

MARK = "▁"
SLAB_BYTES = 1 << 20
KNOWN_PAIRS = 500_000  # judged piece pairs a task remembers
MERGE, UNIGRAM = "merge", "unigram"
UNKNOWN_PENALTY = 10.0


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The pieces of a model file and the forward pass over them."""

    def __init__(self, model_file: str, kind: str = MERGE):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        self.kind, n = kind, model.get_piece_size()
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids = np.zeros(256, np.int32)
        self.bytes_of: list[bytes] = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.ids[piece] = i
                self.scores[piece] = model.get_score(i)
                self.bytes_of.append(piece.replace(MARK, " ").encode())
        self.lowest = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.ids), default=1)
        if kind == MERGE:
            self._learn_chains()
        self.pairs: dict[tuple[str, str], bool] = {}

    # -- merge models ----------------------------------------------------------------------------------------

    def _parts(self, piece: str) -> tuple[str, str] | None:
        """The two parts that the last merge of ``piece`` on its own joins; None if merges do not end in it."""
        now = list(piece)
        while len(now) > 2:
            joined = [self.scores.get(a + b) for a, b in zip(now, now[1:], strict=False)]
            best = max((s for s in joined if s is not None), default=None)
            if best is None:
                return None
            k = joined.index(best)
            now[k : k + 2] = [now[k] + now[k + 1]]
        return (now[0], now[1]) if len(now) == 2 else None

    def _learn_chains(self) -> None:
        """For every piece that merges reach: the pieces at its right and left border over time, with their scores."""
        self.right: dict[str, tuple[tuple[str, float], ...]] = {}
        self.left: dict[str, tuple[tuple[str, float], ...]] = {}
        first = float("inf")
        for piece in sorted(self.ids, key=len):
            if len(piece) == 1:
                self.right[piece] = self.left[piece] = ((piece, first),)
                continue
            parts = self._parts(piece)
            if parts and parts[0] in self.left and parts[1] in self.right:
                self.right[piece] = (*self.right[parts[1]], (piece, self.scores[piece]))
                self.left[piece] = (*self.left[parts[0]], (piece, self.scores[piece]))

    def stays_apart(self, a: str, b: str) -> bool:
        """Whether merges leave the border between pieces ``a`` and ``b``: no pair of what stands at its two sides is
        joined before one of the sides grows on its own.  The left side goes first among equals, the border second."""
        ends, starts, scores = self.right.get(a), self.left.get(b), self.scores
        if ends is None or starts is None:
            return True
        i = j = 0
        none = float("-inf")
        while True:
            grow_a = ends[i + 1][1] if i + 1 < len(ends) else None
            grow_b = starts[j + 1][1] if j + 1 < len(starts) else None
            across = scores.get(ends[i][0] + starts[j][0])
            if across is not None and (grow_a is None or across > grow_a) and (grow_b is None or across >= grow_b):
                return False
            if grow_a is None and grow_b is None:
                return True
            if (none if grow_a is None else grow_a) >= (none if grow_b is None else grow_b) and grow_a is not None:
                i += 1
            else:
                j += 1

    # -- the forward pass ------------------------------------------------------------------------------------

    def segment_sorted(self, words: list[str]) -> list[list[str]]:
        """Pieces of each of the sorted ``words``; states of a shared prefix are reused."""
        usable = self.right if self.kind == MERGE else self.scores
        starts: list[int] = [0]  # where the last piece of each prefix starts
        lasts: list[str] = [""]
        totals: list[float] = [0.0]
        merge, longest, pairs, scores = self.kind == MERGE, self.longest, self.pairs, self.scores
        out: list[list[str]] = []
        previous = ""
        for word in words:
            top = min(len(previous), len(word))
            shared = 0
            while shared < top and previous[shared] == word[shared]:
                shared += 1
            del starts[shared + 1 :], lasts[shared + 1 :], totals[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                found, at, best = word[end - 1], end - 1, totals[end - 1] + self.lowest
                for begin in range(max(0, end - longest), end):
                    piece = word[begin:end]
                    if piece not in usable:
                        continue
                    if not merge:
                        total = totals[begin] + scores[piece]
                        if total > best or begin == end - 1 and found not in scores:
                            found, at, best = piece, begin, total
                        continue
                    if begin:
                        pair = (lasts[begin], piece)
                        apart = pairs.get(pair)
                        if apart is None:
                            if len(pairs) >= KNOWN_PAIRS:
                                pairs.clear()
                            apart = pairs[pair] = self.stays_apart(*pair)
                        if not apart:
                            continue
                    found, at = piece, begin
                    break
                starts.append(at)
                lasts.append(found)
                totals.append(best)
            pieces, end = [], len(word)
            while end:
                pieces.append(lasts[end])
                end = starts[end]
            out.append(pieces[::-1])
            previous = word
        return out

    def piece_ids(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        return [found] if found is not None else self.byte_ids[list(piece.encode())].tolist()


class PieceEncoder(ChunkEncoder):
    """Encodes text columns; distinct marked words are segmented once, in sorted order."""

    def __init__(self, model_file: str, kind: str = MERGE):
        self.pieces = Pieces(model_file, kind)
        self.flat_bytes = np.frombuffer(b"".join(self.pieces.bytes_of), np.uint8)
        self.byte_sizes = np.array([len(b) for b in self.pieces.bytes_of], np.int64)
        self.byte_place = np.cumsum(self.byte_sizes) - self.byte_sizes
        self.fallback = np.zeros(len(self.byte_sizes), dtype=bool)
        self.fallback[self.pieces.byte_ids] = True
        multi = {c for p in self.pieces.ids if len(p) > 1 for c in p}
        self.line_alone = "\n" not in multi
        self._forget()

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        marked = [p.replace(" ", MARK) for p in pieces]
        order = sorted(range(len(marked)), key=marked.__getitem__)
        ids: list[list[int]] = [[]] * len(marked)
        of = self.pieces.piece_ids
        for k, found in zip(order, self.pieces.segment_sorted([marked[k] for k in order]), strict=True):
            ids[k] = [i for p in found for i in of(p)]
        size = np.fromiter((len(x) for x in ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.int32, int(size.sum())), size

    def _starts(self, data: np.ndarray, where: np.ndarray) -> np.ndarray:
        cut = np.zeros(len(data) + 1, dtype=bool)
        blank = data == 32
        cut[1:-1] = blank[1:] & ~blank[:-1] if len(data) else False
        if self.line_alone:
            line = np.flatnonzero(data == 10)
            cut[line] = True
            cut[line + 1] = True
        cut[where] = True
        cut[len(data)] = False
        return np.flatnonzero(cut)

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The bytes to encode: marks in the text are blanks, every text that is not empty gets a leading blank."""
        data, where = text_bytes(column)
        if MARK.encode() in data.tobytes():
            data, where = text_bytes(pc.replace_substring(column, MARK, " "))
        full = np.flatnonzero(np.diff(where))
        data = np.insert(data, where[:-1][full], 32)
        return data, where + np.concatenate([[0], np.cumsum(np.diff(where) > 0)])

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, where = self.texts(column)
        return self.encode_bytes(data, where, self._starts(data, where), None)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the texts of id lists and their offsets, without the leading blank."""
        sizes = self.byte_sizes[ids]
        before = np.concatenate([[0], np.cumsum(sizes)])
        data = self.flat_bytes[np.repeat(self.byte_place[ids] - before[:-1], sizes) + np.arange(before[-1])]
        where = before[offsets]
        first = where[:-1][np.diff(where) > 0]
        first = first[data[first] == 32]
        gone = np.zeros(len(data) + 1, np.int64)
        gone[first + 1] = 1
        return np.delete(data, first), where - np.cumsum(gone)[where]

    def decode_texts(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        data, where = self.decode(ids, offsets)
        raw = data.tobytes()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(where[:-1], where[1:], strict=True)]


_ENCODERS: dict[tuple[str, str], PieceEncoder] = {}


def encoder(model_file: str, kind: str) -> PieceEncoder:
    """One encoder per worker process; its tables take a second to build."""
    if (model_file, kind) not in _ENCODERS:
        _ENCODERS[model_file, kind] = PieceEncoder(model_file, kind)
    return _ENCODERS[model_file, kind]


def _encode(model_file: str, kind: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_file, kind)
        for batch in slabs(released(batches), "_text", SLAB_BYTES):
            column = batch.column(batch.num_columns - 1)
            ids, offsets = own.encode_column(column)
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            names = [f.name for f in batch.schema][:-1]
            count = pa.array(np.diff(offsets))
            falls = np.concatenate([[0], np.cumsum(own.fallback[ids])])
            made = {"n_pieces": count, "n_bytes": pa.array(falls[offsets[1:]] - falls[offsets[:-1]])}
            if digest:
                little = ids.astype("<u4")
                back, at = own.decode(ids, offsets)
                data, where = own.texts(column)
                raw, want = back.tobytes(), data.tobytes()
                pairs = zip(offsets[:-1], offsets[1:], at[:-1], at[1:], where[:-1], where[1:], strict=True)
                found = [(zlib.crc32(little[a:b]), raw[c:d] == want[e + 1 : f]) for a, b, c, d, e, f in pairs]
                made["ids_crc32"] = pa.array([x for x, _ in found], pa.int64())
                made["round_trip"] = pa.array([x for _, x in found], pa.bool_())
            else:
                made["ids"] = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*kept, *made.values()], names=[*names, *made])

    return run


def encode(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", model_file: str | None = None, kind: str = MERGE, digest: bool = False) -> DataFrame:
    """The columns ``keep`` with ``n_pieces``, ``n_bytes`` (byte pieces) and ``ids``; with ``digest`` the unsigned crc32
    of the ids as little-endian 32-bit numbers and whether decoding gives the text again, in place of the ids."""
    kept = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    given = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]
    last = "ids_crc32 long, round_trip boolean" if digest else "ids array<int>"
    return kept.mapInArrow(_encode(model_file or default_model(), kind, digest), ", ".join([*given, "n_pieces long, n_bytes long", last]))


def _decode(model_file: str, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_file, kind)
        for batch in batches:
            rows = [np.array(x or [], np.int64) for x in batch.column(batch.num_columns - 1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
            texts = own.decode_texts(np.concatenate([np.zeros(0, np.int64), *rows]), offsets)
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], names=[*[f.name for f in batch.schema][:-1], "text"])

    return run


def decode(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids", model_file: str | None = None, kind: str = MERGE) -> DataFrame:
    """The columns ``keep`` and the ``text`` of the id lists; a null list gives an empty text."""
    kept = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids}`").alias("_ids"))
    given = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]
    return kept.mapInArrow(_decode(model_file or default_model(), kind), ", ".join([*given, "text string"]))


def op9_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
