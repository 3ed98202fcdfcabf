"""Word-memoised encoding with a public BPE vocabulary.

The vocabulary's normaliser turns white space into one space and its
pre-tokeniser drops that space, so no token crosses white space, no
canonical composition does, and no special string contains any. Encoding a
text is therefore the concatenation of encoding its pieces between ASCII
white space; the library itself encodes each distinct piece, special strings
included. ``WordEncoder`` remembers those pieces (a memo of bounded bytes), which
saves most of the library's work on natural text. Pieces of plain
letters and signs go straight to the library's BPE model.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    """The library's tokenizer for ``path``, without truncation or padding."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest
    for the characters from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


# Pieces the pre-tokeniser provably splits into one run of letters and one run
# of signs, either of them possibly empty. Latin-1 letters are their own
# canonical composition. Every other piece goes to the library as a whole.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)"
                    "([!-&(-/:-;=?@\\[-^`{}~]*)")

def text_slices(column: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a column as bytes, in lists of about ``limit`` bytes, each
    with the row of its first text: a batch is never held twice."""
    column = column.cast(pa.large_binary())
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(column):
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield lo, column.slice(lo, hi - lo).to_pylist()
        lo = hi


@dataclass
class Encoded:
    """Ids of several texts, one after the other."""

    ids: np.ndarray      # uint32, all texts
    counts: np.ndarray   # int64, ids of each text

    @property
    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)


_SPAN = 4096
#: Powers of an odd number, one per place in a word, for hashing.
_POWERS = np.cumprod(np.full(_SPAN, 0x9E3779B97F4A7C15, np.uint64))


def _spans(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places of several spans, one after the other."""
    ends = np.cumsum(lens)
    at = np.repeat(starts - (ends - lens), lens)
    at += np.arange(len(at))
    return at


class MemoEncoder:
    """Ids of texts whose pieces between ASCII white space encode on their own.

    The distinct pieces of a slice of texts are found by Arrow; only they are
    looked up. The memo is held in flat arrays (sorted hashes, the pieces' bytes,
    their ids), and a found piece is compared byte by byte, so a hash never
    decides a result. ``memo_words`` and ``memo_bytes`` (all arrays together)
    bound memory only: a full memo keeps the pieces that were met again since
    the last time, or starts anew if those are more than half of it.
    """

    ROW_BYTES = 48  # per piece, without its bytes and ids

    def __init__(self, vocab_size: int, memo_words: int = 1 << 20, memo_bytes: int = 48 << 20):
        self.memo_words, self.memo_bytes = memo_words, memo_bytes
        self.dtype = np.uint16 if vocab_size <= 65536 else np.uint32
        self._keep(np.zeros(0, np.int64))

    def _encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of each piece."""
        raise NotImplementedError

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.dtype().dtype.char, ids).tobytes()

    def fold(self, texts: list[bytes]) -> list[bytes]:
        """The texts with spellings merged that have the same ids."""
        return texts

    # -------------------------------------------------------------- the memo

    def _keep(self, rows: np.ndarray) -> None:
        """Keep only these rows of the memo, in this order."""
        if len(rows):
            letters = self.letters_flat[_spans(self.word_starts[rows], self.word_lens[rows])]
            flat = self.flat[_spans(self.starts[rows], self.lens[rows])]
            hashes, word_lens, lens = self.hashes[rows], self.word_lens[rows], self.lens[rows]
        else:
            letters, flat = np.zeros(0, np.uint8), np.zeros(0, self.dtype)
            hashes = np.zeros(0, np.uint64)
            word_lens = lens = np.zeros(0, np.int32)
        self.hashes, self.letters_flat, self.word_lens = hashes, letters, word_lens
        self.flat, self.lens = flat, lens
        self.word_starts = np.cumsum(word_lens, dtype=np.int64) - word_lens
        self.starts = np.cumsum(lens, dtype=np.int64) - lens
        self.met = np.zeros(len(rows), bool)
        self.order = np.argsort(hashes, kind="stable").astype(np.int32)
        self.sorted = hashes[self.order]

    def memory(self) -> int:
        return (self.ROW_BYTES * len(self.lens) + len(self.letters_flat)
                + self.flat.itemsize * len(self.flat))

    def _make_room(self, n: int) -> None:
        if len(self.lens) + n <= self.memo_words and self.memory() <= self.memo_bytes:
            return
        rows = np.nonzero(self.met)[0]
        size = self.ROW_BYTES * len(rows) + int(self.word_lens[rows].sum()
                                                + self.flat.itemsize * self.lens[rows].sum())
        half = 2 * (len(rows) + n) <= self.memo_words and 2 * size <= self.memo_bytes
        self._keep(rows if half else rows[:0])

    def _learn(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray, hashes: np.ndarray) -> None:
        packed = []
        for lo in range(0, len(starts), 20_000):
            packed += self._encode_pieces([data[a:a + n].tobytes() for a, n in zip(
                starts[lo:lo + 20_000].tolist(), lens[lo:lo + 20_000].tolist())])
        n_ids = np.fromiter(map(len, packed), np.int32, len(packed)) // self.flat.itemsize
        first = len(self.lens)
        self.word_starts = np.concatenate([
            self.word_starts, len(self.letters_flat) + np.cumsum(lens, dtype=np.int64) - lens])
        self.starts = np.concatenate([
            self.starts, len(self.flat) + np.cumsum(n_ids, dtype=np.int64) - n_ids])
        self.letters_flat = np.concatenate([self.letters_flat, data[_spans(starts, lens)]])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(packed), self.dtype)])
        self.word_lens = np.concatenate([self.word_lens, lens.astype(np.int32)])
        self.lens = np.concatenate([self.lens, n_ids])
        self.hashes = np.concatenate([self.hashes, hashes])
        self.met = np.concatenate([self.met, np.zeros(len(lens), bool)])
        by_hash = np.argsort(hashes, kind="stable")
        at = np.searchsorted(self.sorted, hashes[by_hash])
        self.sorted = np.insert(self.sorted, at, hashes[by_hash])
        self.order = np.insert(self.order, at, (first + by_hash).astype(np.int32))

    def _rows(self, words: pa.Array) -> np.ndarray:
        """Memo rows of distinct ``words`` (large binary); all are in the memo
        afterwards, and keep their rows until the next call."""
        _, offsets, data = words.buffers()
        ends = np.frombuffer(offsets, np.int64)[words.offset:words.offset + len(words) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        starts, lens = ends[:-1], np.diff(ends)
        self._make_room(len(words))
        values = data[ends[0]:ends[-1]].astype(np.uint64) + np.uint64(1)
        place = _spans(np.zeros(len(lens), np.int64), lens) % _SPAN
        # the sums of no bytes are zero: reduceat needs a value per word
        sums = np.concatenate([[np.uint64(0)], np.cumsum(values * _POWERS[place])])
        hashes = sums[ends[1:] - ends[0]] - sums[starts - ends[0]]
        hashes ^= hashes >> np.uint64(29)
        rows = np.full(len(words), -1, np.int64)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
            found = self.order[at].astype(np.int64)
            same = np.nonzero((self.sorted[at] == hashes) & (self.word_lens[found] == lens))[0]
            own = self.letters_flat[_spans(self.word_starts[found[same]], lens[same])]
            unlike = np.concatenate([[0], np.cumsum(own != data[_spans(starts[same], lens[same])])])
            stops = np.cumsum(lens[same])
            same = same[unlike[stops] == unlike[stops - lens[same]]]
            rows[same] = found[same]
            self.met[rows[same]] = True
        new = np.nonzero(rows < 0)[0]
        if len(new):
            rows[new] = np.arange(len(self.lens), len(self.lens) + len(new))
            self._learn(data, starts[new], lens[new], hashes[new])
        return rows

    def _lookup(self, words: pa.Array) -> np.ndarray:
        distinct = words.dictionary_encode()
        return self._rows(distinct.dictionary)[distinct.indices.to_numpy()]

    # -------------------------------------------------------------- encoding

    def pieces(self, texts: list[bytes]):
        """Groups of texts of a bounded size: (first text, pieces of each text,
        memo rows of all pieces). Rows tell pieces apart, and hold until the
        next group is asked for."""
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and size < 2 << 20:
                size += len(texts[hi])
                hi += 1
            held = pa.array(self.fold(texts[lo:hi]), pa.large_binary())
            # bytes that are no UTF-8 stay as they are: white space is ASCII
            held = pa.LargeStringArray.from_buffers(len(held), *held.buffers()[1:])
            split = pc.ascii_split_whitespace(held)
            stops, words = split.offsets.to_numpy(), split.values.cast(pa.large_binary())
            # white space at a text's ends gives empty pieces
            real = pc.not_equal(pc.binary_length(words), 0)
            stops = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[stops]
            yield lo, np.diff(stops), self._lookup(words.filter(real))
            lo = hi

    def counts(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for first, sizes, rows in self.pieces(texts):
            lens = np.concatenate([[0], np.cumsum(self.lens[rows], dtype=np.int64)])
            ends = np.cumsum(sizes)
            out[first:first + len(sizes)] = lens[ends] - lens[ends - sizes]
        return out

    def ids_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' ids one after the other, and the ends of each one's ids."""
        lens = self.lens[rows]
        ends = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
        return self.flat[_spans(self.starts[rows], lens)].astype(np.uint32), ends

    def encode(self, texts: list[bytes]) -> Encoded:
        counts = np.zeros(len(texts), np.int64)
        parts = []
        for first, sizes, rows in self.pieces(texts):
            ids, ends = self.ids_of(rows)
            parts.append(ids)
            stops = np.cumsum(sizes)
            counts[first:first + len(sizes)] = ends[stops] - ends[stops - sizes]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return Encoded(ids, counts)


RUNS = 50_000  # pre-tokens remembered between pieces


class WordEncoder(MemoEncoder):
    """The tokenizers library's ids for a vocabulary such as ``WORD_BPE``."""

    def __init__(self, path: str, **memo):
        self.tokenizer = load_tokenizer(path)
        self.letters = _byte_letters()
        self.runs: dict[str, bytes] = {}
        super().__init__(self.tokenizer.get_vocab_size(), **memo)

    def fold(self, texts: list[bytes]) -> list[bytes]:
        # A-Z would be lower-cased anyway, but for special strings
        return [t if b"<|" in t else t.lower() for t in texts]

    def _run(self, run: str) -> bytes:
        """Packed ids of one pre-token (lower case)."""
        ids = self.runs.get(run)
        if ids is None:
            letters = run if run.isascii() else "".join(map(self.letters.__getitem__, run.encode()))
            ids = self.runs[run] = self._pack(
                [t.id for t in self.tokenizer.model.tokenize(letters)])
        return ids

    def _encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        out: list = [None] * len(pieces)
        other: list[int] = []
        for k, piece in enumerate(pieces):
            text = piece.decode("utf-8", "replace")
            plain = _PLAIN.fullmatch(text)
            if plain is None:
                other.append(k)
                continue
            letters, signs = plain.groups()
            if not signs:
                out[k] = self._run(letters.lower()) if letters else b""
            else:
                out[k] = (self._run(letters.lower()) if letters else b"") + self._run(signs)
        if other:
            for k, found in zip(other, self.tokenizer.encode_batch_fast(
                    [pieces[k].decode("utf-8", "replace") for k in other],
                    add_special_tokens=False)):
                out[k] = self._pack(found.ids)
        if len(self.runs) > RUNS:
            self.runs = {}
        return out


class PieceEncoder(MemoEncoder):
    """A sentencepiece vocabulary's ids, word by word."""

    def __init__(self, path: str, **memo):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        super().__init__(self.model.vocab_size(), **memo)
        self.is_byte = np.array([self.model.is_byte(k) for k in range(self.model.vocab_size())])

    def _encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        return list(map(self._pack, self.model.encode(
            [p.decode("utf-8", "replace") for p in pieces], num_threads=1)))


_ENCODERS: dict[str, MemoEncoder] = {}


def encoder(path: str):
    """This process's encoder for ``path`` (workers are reused, so the memo
    outlives a task)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = (PieceEncoder if path.endswith(".model") else WordEncoder)(path)
    return _ENCODERS[path]
