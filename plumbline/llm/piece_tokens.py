"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text becomes marked words: each space is the mark U+2581, and a word begins at a run of
marks. No piece holds a mark after another character, so no piece crosses a word's start and words can be encoded alone.

The distinct marked words of a slice are sorted, which is the depth-first order of their trie. Each word keeps the forward states of
the prefix that it shares with the word before and computes the rest.

* Unigram models: ``best[i]`` is the highest sum of piece scores over the first i characters. Characters that no piece
  covers cost the lowest score less 10.
* BPE models: the highest sum of scores is not their encoding (the scores are merge ranks), so the forward state is the last piece of the
  encoding of the first i characters. A piece extends the encoding of a prefix exactly if the merges of the prefix's last piece
  and the piece leave both whole, and one piece does at each i. This is the merge result itself, by the same traversal.

Uncovered characters become byte pieces, or the unknown id where the model has no byte pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import slices, small_batches

MARK = "▁"
WORDS = re.compile(rf"{MARK}+[^{MARK}]*|[^{MARK}]+")
UNKNOWN_COST = 10.0
KEPT_BYTES = 40_000_000  # of words and their encodings that a process keeps; beyond, only those of the last slice stay
WORD_BYTES = 200  # what a kept word takes besides its letters and ids
KEPT_PAIRS = 300_000
CHUNK_CHARS = 1_000_000  # of a text that are split at a time
SLICE_BYTES = 1_000_000  # of texts that are encoded at a time
# fixed values of the model format: kinds of pieces
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2  # kind of model; 1 is unigram


@dataclass
class Vocabulary:
    pieces: list[str]
    bpe: bool
    ends: dict[str, int]  # every piece with its id, every other end of a piece with -1
    scores: list[float]
    byte_ids: list[int] | None
    unknown_id: int
    unknown_score: float
    data: list[bytes]  # what each id decodes to
    dummy_prefix: bool
    coded: dict[str, bytes] = field(default_factory=dict)  # ids of pieces and of uncovered ends, as bytes
    fits: dict[str, dict[str, bool] | None] = field(default_factory=dict)  # per piece what may stand before it; None for other ends
    pairs: int = 0

    def __post_init__(self) -> None:
        self.fits = {end: {} if k >= 0 else None for end, k in self.ends.items()}
        self.coded = {end: np.int32(k).tobytes() for end, k in self.ends.items() if k >= 0}

    def encoding(self, before: bytes, last: str) -> bytes:
        """Ids of a prefix, given those up to its last piece. Uncovered characters are their bytes, or one unknown id a run."""
        known = self.coded.get(last)
        if known is None:
            if self.byte_ids is None:
                unknown = np.int32(self.unknown_id).tobytes()
                return before if before[-4:] == unknown else before + unknown
            known = np.array([self.byte_ids[b] for b in last.encode("utf-8", "surrogatepass")], np.int32).tobytes()
        return before + known

    def merges(self, text: str) -> list[str]:
        """BPE by definition: the best-scored neighbours first, the leftmost on ties."""
        out = list(text)
        while len(out) > 1:
            top, at = None, -1
            for k in range(len(out) - 1):
                which = self.ends.get(out[k] + out[k + 1], -1)
                if which >= 0 and (top is None or self.scores[which] > top):
                    top, at = self.scores[which], k
            if top is None:
                break
            out[at:at + 2] = [out[at] + out[at + 1]]
        return out

    def side_by_side(self, left: str, right: str) -> bool:
        """Whether merging ``left + right`` gives just the two; remembered in ``fits``."""
        self.pairs += 1
        if self.pairs > KEPT_PAIRS:
            self.pairs = 1
            for known in filter(None, self.fits.values()):
                known.clear()
        found = self.fits[right][left] = self.merges(left + right) == ([left, right] if left else [right])
        return found


@lru_cache(maxsize=2)
def load(model_file: str) -> Vocabulary:
    """Pieces, scores and kinds of a model file. Each process reads it once."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(model_file, "rb") as f:
        model.ParseFromString(f.read())
    pieces = [p.piece for p in model.pieces]
    kinds = [p.type for p in model.pieces]
    scores = [p.score for p in model.pieces]
    usable = [k for k, kind in enumerate(kinds) if kind in (NORMAL, USER)]
    for k in usable:
        if MARK in pieces[k].lstrip(MARK):
            raise ValueError(f"piece {k} holds a mark after another character")
    lowest = min((scores[k] for k in usable if kinds[k] == NORMAL), default=0.0)
    highest = max((scores[k] for k in usable if kinds[k] == NORMAL), default=0.0)
    data = []
    for piece, kind in zip(pieces, kinds):
        if kind == BYTE:
            data.append(bytes([int(piece[3:5], 16)]))
        elif kind in (CONTROL, UNUSED):
            data.append(b"")
        elif kind == UNKNOWN:
            data.append(" ⁇ ".encode())
        else:
            data.append(piece.replace(MARK, " ").encode())
    bytes_of = {int(pieces[k][3:5], 16): k for k, kind in enumerate(kinds) if kind == BYTE}
    ends = {pieces[k][i:]: -1 for k in usable for i in range(1, len(pieces[k]))} | {pieces[k]: k for k in usable}
    return Vocabulary(
        pieces, model.trainer_spec.model_type == BPE, ends, [len(p) * highest - 0.1 if kind == USER else s for p, s, kind in zip(pieces, scores, kinds)],
        [bytes_of[b] for b in range(256)] if len(bytes_of) == 256 else None, next((k for k, kind in enumerate(kinds) if kind == UNKNOWN), 0),
        lowest - UNKNOWN_COST, data, model.normalizer_spec.add_dummy_prefix)


def shared(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n - 1  # the first difference lies in [low, high]
    while low < high:
        mid = (low + high) // 2
        if a[low:mid + 1] == b[low:mid + 1]:
            low = mid + 1
        else:
            high = mid
    return low


def extend_by_score(word: str, start: int, v: Vocabulary, best: list[float], ids: list[bytes]) -> None:
    ends, scores, missing = v.ends, v.scores, v.unknown_score
    for i in range(start + 1, len(word) + 1):
        top, at = best[i - 1] + missing, i - 1
        for j in range(i - 1, -1, -1):
            k = ends.get(word[j:i])
            if k is None:
                break
            if k >= 0 and best[j] + scores[k] >= top:  # on ties the longer last piece
                top, at = best[j] + scores[k], j
        best.append(top)
        ids.append(v.encoding(ids[at], word[at:i]))


def extend_by_merges(word: str, start: int, v: Vocabulary, last: list[str], ids: list[bytes]) -> None:
    fits, check, coded = v.fits, v.side_by_side, v.coded
    for i in range(start + 1, len(word) + 1):
        j, end = i - 1, word[i - 1]
        known = fits.get(end)
        if known is None:  # a character is a symbol even where it is no piece
            known = fits[end] = {}
        while True:
            if known is not None:
                fit = known.get(last[j])
                if fit or fit is None and check(last[j], end):
                    break
            j -= 1
            end = word[j:i]
            if end not in fits:  # no piece reaches further back: ask the definition
                end = v.merges(word[:i])[-1]
                j = i - len(end)
                break
            known = fits[end]
        last.append(end)
        piece = coded.get(end)
        ids.append(ids[j] + piece if piece is not None else v.encoding(ids[j], end))


def encode_words(words: Iterable[str], v: Vocabulary) -> Iterator[tuple[str, bytes]]:
    """The ids of each distinct word, in sorted order, as the bytes of an int32 array. A state carries the ids of its prefix, so nothing is traced back."""
    state: list = [""] if v.bpe else [0.0]  # of the current path in the trie
    ids = [b""]
    extend = extend_by_merges if v.bpe else extend_by_score
    before = ""
    for word in sorted(words):
        keep = shared(before, word)
        del state[keep + 1:], ids[keep + 1:]
        extend(word, keep, v, state, ids)
        before = word
        yield word, ids[-1]


class WordIndex(dict):
    """Numbers of the words met, and their encodings by number; a new word gets the next number when it is looked up."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []
        self.starts, self.lengths, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.letters = 0

    def __missing__(self, key: str) -> int:
        k = self[key] = len(self)
        self.fresh.append(key)
        return k

    def encode_fresh(self, v: Vocabulary) -> None:
        """Encode the words numbered since the last call, sorted into one trie."""
        if not self.fresh:
            return
        place = {word_of(key): self[key] for key in self.fresh}
        found = list(encode_words(place, v))
        lengths = np.zeros(len(self), np.int64)
        lengths[:len(self.lengths)] = self.lengths
        order = np.array([place[w] for w, _ in found], np.int64)
        lengths[order] = many = np.array([len(x) // 4 for _, x in found], np.int64)
        starts = np.zeros(len(self), np.int64)
        starts[:len(self.starts)] = self.starts
        starts[order] = len(self.pool) + np.cumsum(many) - many
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(x for _, x in found), np.int32)])
        self.starts, self.lengths = starts, lengths
        self.letters += sum(map(len, self.fresh))
        self.fresh = []

    def size(self) -> int:
        return len(self) * WORD_BYTES + self.letters + self.pool.nbytes

    def ids_of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after another, and how many each has."""
        many = self.lengths[codes]
        ends = np.cumsum(many)
        return self.pool[np.repeat(self.starts[codes] - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)], many

    def keep_only(self, codes: np.ndarray) -> None:
        """Forget all words but these, and number them anew."""
        keep = np.zeros(len(self), bool)
        keep[codes] = True
        keys = [k for k, code in self.items() if keep[code]]
        pool, many = self.ids_of(np.array([self[k] for k in keys], np.int64))
        self.clear()
        self.update(zip(keys, range(len(keys))))
        self.pool, self.lengths, self.starts = pool, many, np.cumsum(many) - many
        self.letters = sum(map(len, keys))


def word_of(key: str) -> str:
    """The marked word of a key. A key is the word less its single mark, or a mark and the word if it is another kind of word."""
    return key[1:] if key.startswith(MARK) else MARK + key


def chunks(text: str, size: int) -> Iterator[str]:
    """The text in parts of about ``size`` characters, each but the first beginning at a run of spaces: no word is cut."""
    at = 0
    while len(text) - at > size:
        to = at + size
        while True:
            to = text.find(" ", to)
            if to <= 0 or text[to - 1] not in (" ", MARK):
                break
            to += 1
        if to < 0:
            break
        yield text[at:to]
        at = to
    yield text[at:] if at else text


def word_keys(text: str, vocabulary: Vocabulary, size: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """The keys of a text's words, a list for each chunk."""
    if vocabulary.dummy_prefix:
        text = " " + text
    for chunk in chunks(text, size):
        if chunk.startswith(" ") and not chunk.endswith(" ") and "  " not in chunk and MARK not in chunk:
            yield chunk[1:].split(" ")
        else:
            words = WORDS.findall(chunk.replace(" ", MARK))
            yield [w[1:] if w.rfind(MARK) == 0 else MARK + w for w in words]


def encode_texts(texts: Iterable[str | None], vocabulary: Vocabulary, known: WordIndex | None = None) -> list[np.ndarray]:
    """Ids of each text. ``known`` holds encodings met before and is filled; null and empty texts have none."""
    index = known if isinstance(known, WordIndex) else WordIndex()
    number = index.__getitem__
    codes, ends = [], [0]
    for text in texts:
        total = ends[-1]
        for keys in word_keys(text, vocabulary) if text else ():
            codes.append(np.fromiter(map(number, keys), np.int64, len(keys)))
            total += len(keys)
        ends.append(total)
    index.encode_fresh(vocabulary)
    flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    ids, many = index.ids_of(flat)
    places = np.r_[0, np.cumsum(many)][np.array(ends)]
    if index.size() > KEPT_BYTES:
        index.keep_only(np.unique(flat))
        if index.size() > KEPT_BYTES // 2:
            index.keep_only(np.zeros(0, np.int64))
    return [ids[lo:hi] for lo, hi in zip(places, places[1:])]


@lru_cache(maxsize=2)
def piece_bytes(model_file: str) -> pa.Array:
    """What each id decodes to, and nothing for the place after the last one."""
    return pa.array([*load(model_file).data, b""], pa.binary())


def joined_bytes(ids: pa.Array, pieces: pa.Array) -> tuple[np.ndarray, memoryview]:
    """The bytes of all ids one after another, and where each begins; ids beyond the vocabulary and null ones have none."""
    last = len(pieces) - 1
    plain = np.asarray(ids.fill_null(last) if ids.null_count else ids)
    plain = np.where((plain < 0) | (plain > last), last, plain)
    taken = pieces.take(pa.array(plain, pa.int32()))
    places = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset:taken.offset + len(taken) + 1]
    return places, memoryview(taken.buffers()[2]) if taken.buffers()[2] is not None else memoryview(b"")


def text_of(data: bytes, dummy_prefix: bool) -> str:
    """The text of decoded bytes: the dummy mark taken off, bytes that are no text replaced."""
    out = data.decode("utf-8", "replace")
    return out[1:] if dummy_prefix and out.startswith(" ") else out


def decode_ids(ids: Iterable[int], vocabulary: Vocabulary) -> str:
    """The text of one list of ids: marks as spaces, bytes joined; ids beyond the vocabulary are left out."""
    n = len(vocabulary.data)
    return text_of(b"".join([vocabulary.data[k] for k in ids if k is not None and 0 <= k < n]), vocabulary.dummy_prefix)


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id, ids`` of every whole text, with the columns named in ``keep``.

    No shuffle: the distinct words are those of a slice, and a process keeps a bounded number of bytes of encodings between slices and tasks. Null and empty texts have an
    empty list; a text may hold U+2581 itself, which reads as a space. Repeated rows stay. ``model_file`` is a path that every executor has.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)
    names = ["doc_id", *keep, "ids"]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text") + ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, known = load(model_file), word_index(model_file)
        for batch in batches:
            for part in slices(batch, size=SLICE_BYTES):
                ids = encode_texts(part.column(1).to_pylist(), vocabulary, known)
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], lists], names)

    return rows.mapInArrow(run, ddl)


def decode(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids", keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id, ids, text`` of every list of ids, with the columns named in ``keep``; a null list decodes to null."""
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"), *keep)
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, dummy_prefix = piece_bytes(model_file), load(model_file).dummy_prefix
        for batch in batches:
            for part in id_slices(batch):
                lists = part.column(1)
                places, data = joined_bytes(lists.flatten(), pieces)
                ends = np.r_[0, np.cumsum([len(x) if x.is_valid else 0 for x in lists])]
                texts = [text_of(bytes(data[places[lo]:places[hi]]), dummy_prefix) if x.is_valid else None for x, lo, hi in zip(lists, ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "text"])

    return rows.mapInArrow(run, ddl)


def id_slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in slices of about ``size`` ids, a row at least."""
    ends = np.r_[0, np.cumsum([len(x) if x.is_valid else 0 for x in batch.column(1)])]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


@lru_cache(maxsize=2)
def word_index(model_file: str) -> WordIndex:
    """The words that this process has encoded with a model."""
    return WordIndex()
