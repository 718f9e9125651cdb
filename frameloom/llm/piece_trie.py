"""SentencePiece encoding and decoding: shared-prefix Viterbi over a trie of distinct marked words."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import freed, packed, slices

MARK = "▁"
#: A unit: marks and what follows up to the next mark. No piece has a mark after another character, so none reaches over.
UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Texts that need UNIT: the others can be split at spaces, and before line ends.
ODD = f"^ | $|  | \n|{MARK}"
#: What a Python worker keeps from batch to batch: pairs of pieces that it has judged, and repeated words with their ids;
#: words of more characters than LONG are never kept. Some 20 MB each at most.
KEPT_PAIRS, KEPT_WORDS, LONG = 250_000, 100_000, 32


@dataclass(frozen=True)
class Vocabulary:
    """pieces, scores and byte values (-1: none) by id; bpe: whether pieces are merged by score, else summed."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    byte_of: tuple[int, ...]
    usable: tuple[bool, ...]
    unknown: int
    bpe: bool


def vocabulary(model: bytes) -> Vocabulary:
    """The vocabulary of a SentencePiece model without normalisation that puts a mark in front of texts."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    spec = proto.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only models without normalisation that mark the start of words are supported")
    piece = proto.SentencePiece
    pieces = tuple(p.piece for p in proto.pieces)
    if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in pieces):
        raise ValueError("a piece reaches over a word's start or a line's end")
    return Vocabulary(
        pieces,
        tuple(p.score for p in proto.pieces),
        tuple(int(p.piece[3:5], 16) if p.type == piece.BYTE else -1 for p in proto.pieces),
        tuple(p.type in (piece.NORMAL, piece.USER_DEFINED) for p in proto.pieces),
        next(i for i, p in enumerate(proto.pieces) if p.type == piece.UNKNOWN),
        proto.trainer_spec.model_type == proto.trainer_spec.BPE,
    )


class Encoder:
    """Ids of marked words. Words are sorted and gone through as a trie in depth-first order: the forward cells of the
    prefix that a word shares with the one before it are kept, and only those of its own characters are computed.

    A cell of a prefix holds the start and id of its last piece. With a unigram vocabulary that piece ends the path with
    the highest sum of scores, which the cell holds too. With a BPE vocabulary sums of scores don't give what merging
    gives; but there, the pieces of a prefix that ends where a piece ends are the first pieces of the whole, and pieces
    stand next to each other if and only if merging their two strings gives just them. So the cell's piece is the one that
    may stand after the last piece of what is before it.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.ids = {p: i for i, p in enumerate(vocab.pieces) if vocab.usable[i]}
        self.bytes = {b: i for i, b in enumerate(vocab.byte_of) if b >= 0}
        self.tails = self._tails()
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.least = min(vocab.scores[i] for i in self.ids.values()) - 10 if self.ids else 0.0

    def _tails(self) -> dict[str, tuple[tuple[int, int], ...]]:
        """(length, id) of the pieces of two characters or more that may end where a string ends, longest first, by its last
        four characters; by its last three or two if no piece has those four. Above four the id is -1: to be looked up."""
        longer: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 1:
                longer.setdefault(p[-4:], set()).add(len(p))
        out = {}
        for tail, lengths in longer.items():
            known = [(n, self.ids[tail[-n:]]) for n in range(len(tail), 1, -1) if tail[-n:] in self.ids]
            out[tail] = (*((n, -1) for n in sorted(lengths, reverse=True) if n > 4), *known)
        return out

    def merged(self, text: str) -> list[int]:
        """The pieces of a short string by merging: the pair of the highest score first, the leftmost of equals."""
        parts, ids, scores = list(text), self.ids, self.vocab.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ids.get(p, -1) for p in parts]

    def may_follow(self, before: int, piece: int) -> bool:
        """Whether merging leaves `piece` whole after `before` (-1: the start, or a character that no piece has)."""
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        pieces = self.vocab.pieces
        known = self.merged(pieces[piece]) == [piece] if before < 0 else self.merged(pieces[before] + pieces[piece]) == [before, piece]
        self.pairs[before * 0x1000000 + piece] = known
        return known

    def candidates(self, word: str, end: int) -> tuple[tuple[int, int], ...]:
        tails = self.tails
        if end > 3:
            return tails.get(word[end - 4 : end]) or tails.get(word[end - 3 : end]) or tails.get(word[end - 2 : end]) or ()
        return tails.get(word[:end]) or (tails.get(word[1:3]) if end == 3 else None) or ()

    def _merge_cells(self, word: str, first: int, starts: list[int], last: list[int]) -> None:
        ids, pairs, tails = self.ids, self.pairs, self.tails
        for end in range(first, len(word) + 1):
            found = tails.get(word[end - 4 : end]) or tails.get(word[end - 3 : end]) or tails.get(word[end - 2 : end]) or () if end > 3 else self.candidates(word, end)
            for n, piece in found:
                if piece < 0:
                    if n > end or (piece := ids.get(word[end - n : end], -1)) < 0:
                        continue
                before = last[end - n]
                allowed = pairs.get(before * 0x1000000 + piece)
                if allowed is None:
                    allowed = self.may_follow(before, piece)
                if allowed:
                    starts.append(end - n)
                    last.append(piece)
                    break
            else:
                # a single character is never merged away unless a longer piece took it
                starts.append(end - 1)
                last.append(ids.get(word[end - 1], -1))

    def _sum_cells(self, word: str, first: int, starts: list[int], last: list[int], best: list[float]) -> None:
        for end in range(first, len(word) + 1):
            start, piece, score = end - 1, -1, best[end - 1] + self.least
            for n, i in (*self.candidates(word, end), (1, -1)):
                if i < 0 and n <= end:
                    i = self.ids.get(word[end - n : end], -1)
                if i >= 0 and n <= end and best[end - n] + self.vocab.scores[i] > score:
                    start, piece, score = end - n, i, best[end - n] + self.vocab.scores[i]
            starts.append(start)
            last.append(piece)
            best.append(score)

    def _spelt(self, c: str) -> list[int]:
        """A character that no piece has: its bytes, or the unknown piece."""
        if not self.bytes:
            return [self.vocab.unknown]
        return [self.bytes[b] for b in c.encode("utf-8")]

    def encode_words(self, words: list[str], times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words on end, and where each word's begin and end: bounds (len(words), 2). Words must be distinct;
        times: how often each occurs. Those that occur more than once are kept for later calls."""
        known = self.words
        order = sorted((k for k, w in enumerate(words) if w not in known), key=words.__getitem__)
        starts, last, best = [0], [-1], [0.0]
        out: list[int] = []
        fresh: dict[str, tuple[int, ...]] = {}
        again = (times > 1).tolist() if times is not None else [False] * len(words)
        bounds, bpe = np.zeros((len(words), 2), dtype=np.int64), self.vocab.bpe
        ends = []
        for at, shared in zip(order, shared_prefixes(words, order)):
            word = words[at]
            del starts[shared + 1 :], last[shared + 1 :], best[shared + 1 :]
            if bpe:
                self._merge_cells(word, shared + 1, starts, last)
            else:
                self._sum_cells(word, shared + 1, starts, last, best)
            end, path = len(word), []
            while end:
                piece, start = last[end], starts[end]
                if piece < 0:
                    path.extend(reversed(self._spelt(word[start:end])))
                else:
                    path.append(piece)
                end = start
            path.reverse()
            out += path
            ends.append(len(out))
            if again[at] and len(word) <= LONG:
                fresh[word] = tuple(path)
        bounds[order, 0], bounds[order, 1] = [0, *ends][: len(order)], ends
        if len(order) < len(words):
            rest = [k for k, w in enumerate(words) if w in known]
            at = len(out)
            sizes = [len(known[words[k]]) for k in rest]
            out.extend(chain.from_iterable(known[words[k]] for k in rest))
            bounds[rest, 1] = at + np.cumsum(sizes)
            bounds[rest, 0] = bounds[rest, 1] - sizes
        if len(known) + len(fresh) > KEPT_WORDS:
            known.clear()
        known.update(islice(fresh.items(), KEPT_WORDS))
        return np.array(out, dtype=np.int32), bounds


def shared_prefixes(words: list[str], order: list[int], block: int = 4096, most: int = 48):
    """For each word in order, how many characters it shares with the one before it, `most` at most; 0 for the first."""
    before = ""
    for s in range(0, len(order), block):
        part = [before[:most], *(words[k][:most] for k in order[s : s + block])]
        before = part[-1]
        wide = max(1, max(map(len, part)))
        points = np.array(part, dtype=f"<U{wide}").view(np.uint32).reshape(len(part), wide)
        differ = np.concatenate([points[1:] != points[:-1], np.ones((len(part) - 1, 1), dtype=bool)], axis=1).argmax(axis=1)
        sizes = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
        yield from np.minimum(differ, np.minimum(sizes[1:], sizes[:-1])).tolist()


@lru_cache(maxsize=2)
def _encoder(vocab: Vocabulary) -> Encoder:
    return Encoder(vocab)


def _units(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct marked words, each occurrence's index among them, and each text's bounds among the occurrences."""
    odd = np.asarray(pc.match_substring_regex(texts, ODD))
    plain = pc.if_else(pa.array(odd), "", texts)
    lists = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
    parts = lists.flatten().dictionary_encode()
    index = np.asarray(parts.indices, dtype=np.int64)
    counts = np.diff(np.asarray(lists.offsets, dtype=np.int64))
    # a part that starts with a line end follows without a space; the empty text has one part, and no pieces
    words = ["" if p == "" else p if p[0] == "\n" else MARK + p for p in parts.dictionary.to_pylist()]
    if texts and pc.any(pc.starts_with(plain, "\n")).as_py():  # the mark in front of a text that starts with a line end
        words.append(MARK)
        first = np.asarray(pc.starts_with(plain, "\n"))
        at = np.concatenate([[0], np.cumsum(counts)])[:-1][first]
        index[at] = len(words) - 1  # in place of the empty part before it
    if odd.any():
        own, rows = {}, np.flatnonzero(odd)
        found = [UNIT.findall(MARK + t.replace(" ", MARK)) for t in texts.take(pa.array(rows)).to_pylist()]
        pieces = np.split(index, np.cumsum(counts)[:-1])
        for row, units in zip(rows.tolist(), found):
            pieces[row] = np.array([own.setdefault(u, len(words) + len(own)) for u in units], dtype=np.int64)
        index, counts = np.concatenate(pieces), np.array([len(p) for p in pieces])
        words.extend(own)
    return words, index, np.concatenate([[0], np.cumsum(counts)])


def _ids(encoder: Encoder, texts: pa.Array) -> pa.ListArray:
    """The ids of each text, none of which is null."""
    words, index, bounds = _units(texts)
    flat, of = encoder.encode_words(words, np.bincount(index, minlength=len(words)))
    n = (of[:, 1] - of[:, 0])[index]
    ends = np.concatenate([[0], np.cumsum(n)])
    values = flat[np.repeat(of[index, 0] - ends[:-1], n) + np.arange(ends[-1])]
    return pa.ListArray.from_arrays(pa.array(ends[bounds], pa.int32()), pa.array(values))


class Decoder:
    """Texts of ids. The first piece of a text loses the space that its mark stands for."""

    def __init__(self, vocab: Vocabulary):
        control = {i for i, ok in enumerate(vocab.usable) if not ok and vocab.byte_of[i] < 0}
        table = [b"" if i in control else bytes([b]) if b >= 0 else p.replace(MARK, " ").encode() for i, (p, b) in enumerate(zip(vocab.pieces, vocab.byte_of))]
        table[vocab.unknown] = " ⁇ ".encode()
        self.n, self.empty = len(table), np.array([not t for t in table])
        self.table = pa.array([*table, *(t[1:] if t[:1] == b" " else t for t in table)], pa.binary())

    def texts(self, ids: pa.ListArray) -> pa.Array:
        """Null for null ids. Bytes that are no UTF-8 become U+FFFD."""
        there = pc.is_valid(ids)
        bounds = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(ids), 0), dtype=np.int64))])
        flat = np.asarray(ids.flatten(), dtype=np.int64)
        # of each text, the first piece that says anything
        says = np.concatenate([np.flatnonzero(~self.empty[flat]), [len(flat)]])
        first = says[np.searchsorted(says, bounds[:-1])]
        flat = flat.copy()
        flat[first[first < bounds[1:]]] += self.n
        found = self.table.take(pa.array(flat))
        offsets = np.frombuffer(found.buffers()[1], dtype=np.int32)[found.offset : found.offset + len(found) + 1]
        data = found.buffers()[2] or pa.py_buffer(b"")
        whole = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(offsets[bounds])), data])
        try:
            texts = whole.cast(pa.string())
        except pa.ArrowInvalid:
            texts = pa.array([t.decode("utf-8", "replace") for t in whole.to_pylist()], pa.string())
        return pc.if_else(there, texts, pa.scalar(None, pa.string()))


@lru_cache(maxsize=2)
def _decoder(vocab: Vocabulary) -> Decoder:
    return Decoder(vocab)


def encode(docs: DataFrame, vocab: Vocabulary, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with a column of the ids of every whole text, as the library gives them without begin or end ids.

    A null text counts as empty and has no ids. Other columns stay as they are; a column named ids_col is replaced. Words
    go through the trie once a slice of a few MB, and a worker keeps a bounded number of repeated ones for later slices.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    rows = packed(docs, text_col, without=(ids_col,))

    def run(batches):
        encoder = _encoder(shared.value)
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), _ids(encoder, pc.fill_null(part.column(1), ""))], ["row", "ids"])

    out = rows.mapInArrow(run, rows.select("row").schema.add("ids", ArrayType(IntegerType())))
    return out.select("row.*", F.col("ids").alias(ids_col))


def decode(df: DataFrame, vocab: Vocabulary, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df with a column of the text of every row's ids; null ids give null, no ids the empty text. Bytes that are no UTF-8
    become U+FFFD. Other columns stay as they are; a column named text_col is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(vocab)
    rows = packed(df, ids_col, without=(text_col,))

    def run(batches):
        decoder = _decoder(shared.value)
        for batch in batches:
            for part in (batch.slice(k, 500) for k in range(0, len(batch), 500)):
                yield pa.RecordBatch.from_arrays([part.column(0), decoder.texts(part.column(1))], ["row", "text"])

    return rows.mapInArrow(run, rows.select("row").schema.add("text", "string")).select("row.*", F.col("text").alias(text_col))


def encoded(docs: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids, n_tokens, decoded_sha256 and round_trip (decoding gives the text again) of every whole text.

    A null text counts as empty: no ids, a round trip. Repeated rows and null ids give a row each, an empty table none;
    other columns are ignored. Encoding, decoding and the digest are one step, so texts go to Python once and don't come
    back, and a task holds one Python worker.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        encoder, decoder = _encoder(shared.value), _decoder(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = _ids(encoder, part.column("text"))
                texts = decoder.texts(ids)
                digests = pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in texts], pa.string())
                n = pc.list_value_length(ids).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), ids, n, digests, pc.equal(texts, part.column("text"))], ["id", "ids", "n_tokens", "decoded_sha256", "round_trip"])
            freed()

    coded = rows.mapInArrow(run, "id long, ids array<int>, n_tokens long, decoded_sha256 string, round_trip boolean")
    return coded.withColumnRenamed("id", id_col)
