"""Alignment of the tokens of two tokenizers over the same text: byte-level merges (A) and sentence pieces (B).

Both libraries report spans: character offsets of A, spans of the piece messages of B.  Where a token begins at or after
the end of the one before, its border lies between characters and is a coarse cut that maps to a byte.  Borders inside
a character (parts of multibyte characters in A, byte pieces in B) are refined: they are counted in decoded token bytes
from the last coarse cut.  Bytes where tokens of both end close a group.  The union of all ends cuts a text into
segments; each segment lies in one A and one B token, and each overlapping pair has exactly one segment: its link.

The work is done once per distinct chunk of a worker.  A chunk is a run of blanks and the word after it, cut only where
no token of either vocabulary could cross (that is read from the vocabularies), so tokens, groups and links of a text
are those of its chunks in order.

Counts of id pairs cover the whole corpus: each task sums its own, Spark adds them up.  Documents are aligned once;
their links are written to the shared folder and read again when the counts are known.  The pair table is broadcast
while it has at most ``BROADCAST_PAIRS`` rows; a larger one is joined with the links of the documents.

Defined results: null and empty texts, and texts that the tokens do not spell byte by byte, have no tokens.  Rows stand
on their own, repeated rows and ids alike; ids may be null.  An empty table gives no rows.  Only the named columns are
read, so other names cannot clash.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticewindows.llm import store
from noticewindows.llm.textblocks import WHITE, slabs, span_hashes, text_bytes
from noticewindows.llm.token_files import ODD_SPACE

MARK = "▁"
SLAB_BYTES = 1 << 20
ROW_GROUP_BYTES = 16 << 20  # of the links on disk, so that writers hold little
CACHE_BYTES = 64 << 20  # of aligned chunks in a worker; beyond that it starts anew
BATCH = 5_000  # chunks that the libraries encode at once
BROADCAST_PAIRS = 2_000_000  # rows of 17 bytes


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def ragged(place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions place[i] .. place[i] + size[i] - 1 of all i, in order."""
    before = np.cumsum(size) - size
    return np.repeat(place - before, size) + np.arange(int(size.sum()))


class Strings:
    """Byte strings by number, and their concatenation for arrays of numbers."""

    def __init__(self, items: list[bytes]):
        self.flat = np.frombuffer(b"".join(items), np.uint8)
        self.size = np.array([len(x) for x in items], np.int64)
        self.place = np.cumsum(self.size) - self.size

    def joined(self, numbers: np.ndarray) -> np.ndarray:
        return self.flat[ragged(self.place[numbers], self.size[numbers])]


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, all others
    take the code points from 256 on in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def refined(clean: np.ndarray, coarse: np.ndarray, lengths: np.ndarray, first: np.ndarray, base: np.ndarray) -> np.ndarray:
    """End byte of each token.  ``clean``: its end is a coarse cut at byte ``coarse``; other ends are counted in decoded
    bytes from the last cut, or from ``base``, the start of the token's chunk, whose first token is ``first``."""
    total = np.cumsum(lengths)
    place = np.arange(len(lengths))
    last = np.maximum.accumulate(np.where(clean, place, -1))
    inside = last >= first
    from_cut = coarse[np.maximum(last, 0)] + total - total[np.maximum(last, 0)]
    from_start = base + total - total[first] + lengths[first]
    return np.where(inside, from_cut, from_start)


class Aligner:
    """Aligned chunks of a worker.  Tokens and their ends are kept only with ``spans``; figures and links do without."""

    def __init__(self, byte_level: str, pieces: str, spans: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True  # their spelling in a text is ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        alphabet, entries = byte_alphabet(), self.a.get_vocab(with_added_tokens=True)
        named = [""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            named[i] = entry
        self.a_bytes = Strings([bytes(alphabet[c] for c in x) if all(c in alphabet for c in x) else x.encode() for x in named])
        spelled = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = Strings([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(spelled)])
        self.digits = Strings([str(i).encode() for i in range(max(len(named), len(spelled)))])
        self.cuts = self._cuts(spelled)
        self.mark = self.b.piece_to_id(MARK)
        self.spans = spans
        self._forget()

    @staticmethod
    def _cuts(spelled: list[str]) -> np.ndarray:
        """Bytes that may start a chunk: blanks that stand in no piece after something solid, nor, unless they are
        spaces, right after the mark."""
        blanks = {chr(b) for b in np.flatnonzero(WHITE)}
        crossed = set()
        for piece in spelled:
            shown = piece.replace(MARK, " ")
            for before, after in zip(shown, shown[1:], strict=False):
                if after in blanks and (before not in blanks or (before == " " and after != " ")):
                    crossed.add(after)
        out = np.zeros(256, dtype=bool)
        out[[ord(c) for c in blanks - crossed]] = True
        return out

    def _forget(self) -> None:
        whole, small = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.keys = np.zeros(0, np.uint64)
        # of each chunk: number of A and B tokens, groups, links and characters of its digest, and where each begins
        self.n = {"a": small, "b": small, "groups": small, "links": small, "text": whole}
        self.place = {k: whole for k in (("a", "b") if self.spans else ()) + ("links", "text")}
        self.right = np.zeros(0, dtype=bool)
        self.flat = {k: small for k in (("a", "a_end", "b", "b_end") if self.spans else ())}
        self.flat |= {"links": whole, "text": np.zeros(0, np.uint8)}

    def _size(self) -> int:
        held = [self.keys, self.right, *self.n.values(), *self.place.values(), *self.flat.values()]
        return sum(x.nbytes for x in held)

    # -- tokens of new chunks --------------------------------------------------------------------------------

    def _spans_a(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, begin and end characters and number of tokens."""
        found = self.a.encode_batch(chunks, add_special_tokens=False)
        ids = [e.ids for e in found]
        size = np.fromiter((len(x) for x in ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(size.sum()))
        spans = np.fromiter((c for e in found for span in e.offsets for c in span), np.int64, 2 * len(flat)).reshape(-1, 2)
        return flat, spans[:, 0], spans[:, 1], size

    def _spans_b(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, begin and end bytes of the piece messages and number of tokens.  The library writes a mark before every
        text: it stands for the space that begins a chunk, and is taken off where a chunk begins otherwise."""
        spaced = [c.startswith(" ") for c in chunks]
        found = self.b.encode([c[1:] if s else c for c, s in zip(chunks, spaced, strict=True)], return_type="proto", num_threads=1)
        alone = [(self.mark, 0, 0)]  # a last space of a text; on its own the library writes nothing for it
        spans = [[(p.id, p.begin, p.end) for p in m.pieces] if c != " " else alone for m, c in zip(found, chunks, strict=True)]
        rows = [s for message in spans for s in message]
        size = np.fromiter((len(x) for x in spans), np.int64, len(spans))
        table = np.array(rows, np.int64).reshape(-1, 3)
        shift = np.repeat(np.array(spaced, np.int64), size)
        first = np.cumsum(size) - size
        odd = ~np.array(spaced, dtype=bool) & (size > 0)
        gone = first[odd]  # the mark of chunks that do not begin with a space
        begin, end = table[:, 1] + shift, table[:, 2] + shift
        begin[first[np.array(spaced, dtype=bool) & (size > 0)]] = 0
        keep = np.ones(len(table), dtype=bool)
        keep[gone] = False
        size[odd] -= 1
        return table[keep, 0].astype(np.int32), begin[keep], end[keep], size

    def _learn(self, keys: np.ndarray, chunks: list[bytes]) -> None:
        made = [self._align(chunks[k : k + BATCH]) for k in range(0, len(chunks), BATCH)]
        at = np.searchsorted(self.keys, keys)
        for name in self.place:
            size = np.concatenate([m["n"][name] for m in made])
            place = len(self.flat[name]) + np.cumsum(size) - size
            self.place[name] = np.insert(self.place[name], at, place)
        for name in self.n:
            self.n[name] = np.insert(self.n[name], at, np.concatenate([m["n"][name] for m in made]))
        self.right = np.insert(self.right, at, np.concatenate([m["right"] for m in made]))
        for name in self.flat:
            self.flat[name] = np.concatenate([self.flat[name], *[m["flat"][name] for m in made]])
        self.keys = np.insert(self.keys, at, keys)

    def _ends(self, ids, clean, coarse, n, decoded: Strings, base) -> np.ndarray:
        chunk = np.repeat(np.arange(len(n)), n)
        first = (np.cumsum(n) - n)[chunk]
        return refined(clean, coarse, decoded.size[ids], first, base[chunk])

    @staticmethod
    def _spells(made: np.ndarray, sizes: np.ndarray, n: np.ndarray, data: np.ndarray, base: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the decoded bytes of each chunk are its own."""
        total = np.concatenate([[0], np.cumsum(sizes)])
        upto = np.cumsum(n)
        got = total[upto] - total[upto - n]
        right = got == length
        compared = np.repeat(right, length)
        ours = made[ragged((total[upto] - got)[right], got[right])]
        wrong = np.zeros(len(data) + 1, np.int64)
        wrong[1:][compared] = ours != data[compared]
        wrong = np.cumsum(wrong)
        return right & (wrong[base + length] == wrong[base])

    def _align(self, chunks: list[bytes]) -> dict:
        texts = [c.decode("utf-8") for c in chunks]
        data = np.frombuffer(b"".join(chunks), np.uint8)
        length = np.array([len(c) for c in chunks], np.int64)
        base = np.cumsum(length) - length
        characters = np.flatnonzero((data & 0xC0) != 0x80)  # first byte of each character
        first_char = np.searchsorted(characters, base)
        edges = np.append(characters, len(data))

        a, begin, end, n_a = self._spans_a(texts)
        chunk_a = np.repeat(np.arange(len(texts)), n_a)
        last = np.zeros(len(a), dtype=bool)
        last[np.cumsum(n_a)[n_a > 0] - 1] = True
        clean = last | (np.append(begin[1:], 0) >= end)
        coarse = edges[first_char[chunk_a] + end]
        a_end = self._ends(a, clean, coarse, n_a, self.a_bytes, base)
        right = self._spells(self.a_bytes.joined(a), self.a_bytes.size[a], n_a, data, base, length)

        b, begin, end, n_b = self._spans_b(texts)
        chunk_b = np.repeat(np.arange(len(texts)), n_b)
        last = np.zeros(len(b), dtype=bool)
        last[np.cumsum(n_b)[n_b > 0] - 1] = True
        at = base[chunk_b] + end
        on_edge = np.zeros(len(data) + 1, dtype=bool)
        on_edge[edges] = True
        clean = (last | (np.append(begin[1:], 0) >= end)) & (end > begin) & on_edge[np.minimum(at, len(data))]
        b_end = self._ends(b, clean, at, n_b, self.b_bytes, base)
        right &= self._spells(self.b_bytes.joined(b), self.b_bytes.size[b], n_b, data, base, length)

        # tokens of chunks that are not spelled are left out
        keep_a, keep_b = right[chunk_a], right[chunk_b]
        a, a_end, b, b_end = a[keep_a], a_end[keep_a], b[keep_b], b_end[keep_b]
        n_a, n_b = n_a * right, n_b * right
        closes_a = np.isin(a_end, b_end, assume_unique=True)
        closes_b = np.isin(b_end, a_end, assume_unique=True)
        ends = np.union1d(a_end, b_end)  # one segment, hence one link, ends at each
        links = (a[np.searchsorted(a_end, ends)].astype(np.int64) << 32) | b[np.searchsorted(b_end, ends)]
        upto = base + length
        count = lambda marks: np.searchsorted(marks, upto, "right") - np.searchsorted(marks, base, "right")
        text, n_text = self._digest(a, closes_a, b, closes_b, n_a, n_b)
        return {
            "right": right,
            "n": {"a": n_a, "b": n_b, "groups": count(a_end[closes_a]), "links": count(ends), "text": n_text},
            "flat": {
                "a": a,
                "a_end": (a_end - np.repeat(base, n_a)).astype(np.int32),
                "b": b,
                "b_end": (b_end - np.repeat(base, n_b)).astype(np.int32),
                "links": links,
                "text": text,
            },
        }

    def _digest(self, a, closes_a, b, closes_b, n_a, n_b) -> tuple[np.ndarray, np.ndarray]:
        """``a1,a2|b1;`` of every group in order, and the characters of each chunk."""
        group_a = np.cumsum(closes_a) - closes_a
        group_b = np.cumsum(closes_b) - closes_b
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        ids = np.concatenate([a, b])[order]
        comma, bar, end = (ord(c) for c in ",|;")
        after = np.concatenate([np.where(closes_a, bar, comma), np.where(closes_b, end, comma)])[order]
        size = self.digits.size[ids]
        out = np.empty(int(size.sum()) + len(ids), np.uint8)
        place = np.cumsum(size + 1) - size - 1
        out[ragged(place, size)] = self.digits.joined(ids)
        out[place + size] = after
        written = np.concatenate([[0], np.cumsum(size + 1)])
        upto = np.cumsum(n_a + n_b)  # tokens of a chunk stay together: its groups end with it
        return out, written[upto] - written[upto - n_a - n_b]

    # -- texts -----------------------------------------------------------------------------------------------

    def chunks(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the texts, each with a space before it: number of the (known) chunk of every place, the n + 1 offsets of
        the texts in them, how often each chunk occurs, and the bytes of every text.  Empty texts have no chunks."""
        data, where = text_bytes(column)
        full = np.flatnonzero(np.diff(where))
        data = np.insert(data, where[:-1][full], 32)
        where = where + np.concatenate([[0], np.cumsum(np.diff(where) > 0)])
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[1:-1] = self.cuts[data[1:]] & ~WHITE[data[:-1]] if len(data) else False
        cut[where] = True
        cut[len(data)] = False
        starts = np.flatnonzero(cut)
        odd = np.unique(np.searchsorted(where, np.array([m.start() for m in ODD_SPACE.finditer(data.tobytes())], np.int64), "right") - 1)
        keep = np.ones(len(starts), dtype=bool)
        for i in odd:  # other white space: the text is one chunk
            a, b = np.searchsorted(starts, (where[i], where[i + 1]))
            keep[a + 1 : b] = False
        starts = starts[keep]
        ends = np.append(starts[1:], len(data))[: len(starts)]
        keys, first, inverse, times = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True, return_counts=True)
        if self._size() > CACHE_BYTES:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            self._learn(keys[new], [data[starts[k] : ends[k]].tobytes() for k in first[new]])
            at = np.searchsorted(self.keys, keys)
        self.seen, self.times = at, times
        return at[inverse], np.searchsorted(starts, where), ends - starts, np.diff(where)

    def spelled(self, chunk: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether all chunks of a text are right, and there are any."""
        good = np.concatenate([[0], np.cumsum(self.right[chunk])])
        n = np.diff(offsets)
        return (n > 0) & (good[offsets[1:]] - good[offsets[:-1]] == n)


_ALIGNERS: dict[tuple[str, str, bool], Aligner] = {}


def aligner(files: tuple[str, str], spans: bool = True) -> Aligner:
    if (*files, spans) not in _ALIGNERS:
        _ALIGNERS[*files, spans] = Aligner(*files, spans)
    return _ALIGNERS[*files, spans]


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values.astype(np.int32)))


def _spans(files: tuple[str, str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(files)
        for batch in slabs(batches, text, SLAB_BYTES):
            place = batch.schema.get_field_index(text)
            chunk, offsets, length, _ = align.chunks(batch.column(place))
            good = align.spelled(chunk, offsets)
            of = np.repeat(np.arange(len(good)), np.diff(offsets))
            start = np.cumsum(length) - length
            start -= start[offsets[:-1][of]] if len(of) else start  # bytes of the text before each chunk
            inside = good[of] if len(of) else np.zeros(0, dtype=bool)
            chunk, of, start = chunk[inside], of[inside], start[inside]
            made = []
            for side in ("a", "b"):
                n = align.n[side][chunk]
                at = ragged(align.place[side][chunk], n)
                per_row = np.bincount(of, weights=n, minlength=len(good)).astype(np.int64)
                made.append((f"{side}_ids", _lists(align.flat[side][at], per_row)))
                made.append((f"{side}_ends", _lists(align.flat[f"{side}_end"][at] + np.repeat(start, n), per_row)))
            kept = [(f.name, batch.column(i)) for i, f in enumerate(batch.schema) if i != place]
            yield pa.RecordBatch.from_arrays([c for _, c in kept + made], names=[n for n, _ in kept + made])

    return run


class _Counts:
    """Links of id pairs, summed over what a task has seen."""

    def __init__(self):
        self.pairs, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, align: Aligner, chunk: np.ndarray) -> None:
        seen, times = np.unique(chunk, return_counts=True)
        n = align.n["links"][seen]
        links = align.flat["links"][ragged(align.place["links"][seen], n)]
        found, inverse = np.unique(np.concatenate([self.pairs, links]), return_inverse=True)
        weight = np.concatenate([self.counts, np.repeat(times, n)])
        self.pairs, self.counts = found, np.bincount(inverse, weights=weight, minlength=len(found)).astype(np.int64)

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in range(0, len(self.pairs), 1 << 16):
            yield self.pairs[k : k + (1 << 16)], self.counts[k : k + (1 << 16)]


def _listed(files: tuple[str, str], text: str, rows: bool):
    """Figures and links of every row, then rows of their own with the task's counts of id pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, sums, kept = aligner(files, spans=False), _Counts(), []
        for batch in slabs(batches, text, SLAB_BYTES):
            place = batch.schema.get_field_index(text)
            chunk, offsets, _, _ = align.chunks(batch.column(place))
            good = align.spelled(chunk, offsets)
            kept = [(f.name, f.type, batch.column(i)) for i, f in enumerate(batch.schema) if i != place]
            sums.add(align, chunk[np.repeat(good, np.diff(offsets))])
            if rows:
                yield _figures(align, chunk, offsets, good, kept)
        for pairs, counts in sums.blocks():
            none = [(name, pa.nulls(1, kind)) for name, kind, _ in kept]
            zero = [(f"n_{k}", pa.array([0], pa.int64())) for k in ("a", "b", "groups", "links")]
            made = [*none, *zero, ("groups_sha256", pa.array([""], pa.string()))]
            made += [("links", pa.array([pairs], pa.list_(pa.int64()))), ("counts", pa.array([counts], pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([c for _, c in made], names=[n for n, _ in made])

    return run


def _figures(align: Aligner, chunk: np.ndarray, offsets: np.ndarray, good: np.ndarray, kept: list) -> pa.RecordBatch:
    figure = {f"n_{k}": _sums(align.n[k][chunk], offsets) * good for k in ("a", "b", "groups", "links")}
    digits, size = align.flat["text"], align.n["text"]
    hashes = []
    for i in range(len(good)):
        if not good[i]:
            hashes.append("")
            continue
        own = chunk[offsets[i] : offsets[i + 1]]
        shown = digits[ragged(align.place["text"][own], size[own])]
        hashes.append(hashlib.sha256(shown[:-1].data).hexdigest())
    n = align.n["links"][chunk] * np.repeat(good, np.diff(offsets))
    links = align.flat["links"][ragged(align.place["links"][chunk], n)]
    made = [*[(name, column) for name, _, column in kept], *[(k, pa.array(v)) for k, v in figure.items()], ("groups_sha256", pa.array(hashes, pa.string()))]
    made.append(("links", pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(figure["n_links"])).astype(np.int32)), pa.array(links))))
    made.append(("counts", pa.nulls(len(good), pa.list_(pa.int64()))))
    return pa.RecordBatch.from_arrays([c for _, c in made], names=[n for n, _ in made])


def _looked_up(table):
    """Sums over the links of each row from the broadcast counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _ALIGNERS.clear()  # workers that aligned texts go on with the table instead
        pairs, counts, best = table.value
        index = pd.Index(pairs)
        for batch in batches:
            column = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            links = column.pop("links")
            ends = links.offsets.to_numpy().astype(np.int64)
            at = index.get_indexer(links.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]])
            for name, values in (("n_best", best), ("count_sum", counts)):
                column[name] = pa.array(_sums(values[at].astype(np.int64), ends - ends[0]))
            yield pa.RecordBatch.from_arrays(list(column.values()), names=list(column))

    return run


def _input(df: DataFrame, text: str, keep: tuple[str, ...]) -> tuple[DataFrame, str]:
    kept = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_aligned text"))
    return kept, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields[:-1])


def align(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), files: tuple[str, str] | None = None) -> DataFrame:
    """Kept columns, ``a_ids, a_ends, b_ids, b_ends``: tokens and their end bytes in a space and the text."""
    kept, given = _input(df, text, keep)
    lists = "a_ids array<int>, a_ends array<int>, b_ids array<int>, b_ends array<int>"
    return kept.mapInArrow(_spans(files or default_files(), "_aligned text"), given + lists)


FIGURES = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _list(df: DataFrame, text: str, keep: tuple[str, ...], files: tuple[str, str], rows: bool) -> DataFrame:
    kept, given = _input(df, text, keep)
    found = kept.mapInArrow(_listed(files, "_aligned text", rows), given + FIGURES + ", links array<bigint>, counts array<bigint>")
    found, path = found.withColumn("_row", F.monotonically_increasing_id()), store.fresh_folder(df.sparkSession, "links")
    found.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(found.schema).parquet(path)


def _pairs(listed: DataFrame) -> DataFrame:
    each = listed.filter("counts IS NOT NULL").select(F.explode(F.arrays_zip("links", "counts")).alias("x")).select(F.col("x.links").alias("pair"), F.col("x.counts").alias("n"))
    pairs = store.stored(each.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    pairs = pairs.select(F.shiftright("pair", 32).cast("int").alias("a_id"), b_id.alias("b_id"), "n", "pair")
    most = pairs.groupBy("b_id").agg(F.max("n").alias("most"))
    return pairs.join(most, "b_id").select("a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best"), "pair")


def pair_counts(df: DataFrame, text: str = "text", files: tuple[str, str] | None = None) -> DataFrame:
    """``a_id, b_id, n, best``: links of each id pair in the whole corpus; ``best``: the most that the B id has."""
    return _pairs(_list(df, text, (), files or default_files(), rows=False)).drop("pair")


def summarise(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), files: tuple[str, str] | None = None, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Kept columns, ``n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum`` of every row.

    Texts are aligned once; their links wait in the shared folder until the corpus counts are known."""
    spark = df.sparkSession
    listed = _list(df, text, keep, files or default_files(), rows=True)
    pairs = store.stored(_pairs(listed).select("pair", "n", "best"), "pair-counts")
    rows = listed.filter("counts IS NULL").drop("counts")
    if pairs.count() <= broadcast_pairs:
        found, n, best = (pairs.toArrow().combine_chunks().column(i).to_numpy() for i in range(3))
        table = spark.sparkContext.broadcast((found, n, best.astype(np.int8)))
        schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name not in ("links", "_row")]
        return rows.drop("_row").mapInArrow(_looked_up(table), ", ".join([*schema, "n_best long, count_sum long"]))
    links = rows.select("_row", F.explode("links").alias("pair")).groupBy("_row", "pair").agg(F.count("*").alias("times"))
    sums = links.join(pairs, "pair").groupBy("_row")
    sums = sums.agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = rows.drop("links").join(sums, "_row", "left").drop("_row")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})


def op13_span_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return summarise(documents).select(*columns)
