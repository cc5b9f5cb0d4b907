"""SentencePiece encoding and decoding for merge-type vocabularies.

A text becomes symbols, one for each character, with spaces written as U+2581 and one
such mark in front. An agenda holds the adjacent pairs whose join is a piece of the
vocabulary, best score first and leftmost among equals. The best pair is merged, its new
neighbours enter the agenda, and pairs whose symbols have changed since are passed
over. Symbols that are no piece in the end become byte pieces.

No merge can span two characters that stand next to each other in no piece of the
vocabulary. Texts are cut there first, so each agenda is short, and the ids of segments
that were met before are looked up. The tables are bounded; once that of words is full, further
words, as long ones always, are merged once for each batch of rows.

The library is the judge: every word that was merged is encoded by it as well, batch
by batch, and a difference is an error. A word is put behind a character that no piece holds, so
that the ids of both add up. ``library_differences`` compares whole texts. Decoding is the
library's ``decode``.

Defined results: a null text counts as empty and has no ids; the empty text decodes to the
empty text; repeated rows each get a row; extra columns are ignored; an empty table gives
an empty result. Texts of any length are taken whole.
"""

import hashlib
import heapq
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom.llm.texts import as_bytes, id_type, slices

SPACE = "▁"

# A character of the private use area: it joins with none.
ALONE = "\ue000"

# Words and segments that a task keeps the ids of.
KNOWN_WORDS = 300_000
KNOWN_SEGMENTS = 150_000


class MergePieces:
    """A merge-type model whose normalisation is the identity with one leading space mark."""

    def __init__(self, model: str):
        self.library = library = sentencepiece.SentencePieceProcessor(model_file=model)
        size = library.get_piece_size()
        self.unknown = library.unk_id()
        self.ids, self.scores, self.bytes = {}, {}, [None] * 256
        for i in range(size):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i)):
                self.ids[piece] = i
                self.scores[piece] = library.get_score(i)
        if library.encode(" a  b") != library.encode(" a  b".replace(" ", SPACE)) or library.encode(""):
            raise ValueError("only models that keep spaces as they are can be encoded")
        self.joined = {piece[i:i + 2] for piece in self.ids for i in range(len(piece) - 1)}
        if any(ALONE in piece for piece in self.ids):
            raise ValueError("the character that words are checked behind is part of a piece")
        self.segments = {}
        self.words = _Words(self)
        self.split = self._word_pattern()

    def _word_pattern(self):
        """Cuts a text into words, only between characters that never join; None for no cuts.

        A word is a run of space marks, a run of punctuation, and the rest up to the next
        of either. ``bound`` are the few characters that do join with punctuation behind them.
        """
        if any(pair[1] == SPACE and pair[0] != SPACE for pair in self.joined):
            return None
        plain = string.ascii_letters + string.digits
        marks = {c for c in string.punctuation + "\n\r\t" if not any(x + c in self.joined for x in plain)}
        bound = {a for a, b in self.joined if b in marks and a not in marks and a != SPACE}
        inside = lambda chars: "".join(map(re.escape, sorted(chars)))
        rest = f"[^{SPACE}{inside(marks)}]*"
        more = f"(?:(?<=[{inside(bound)}])[{inside(marks)}]+{rest})*" if bound else ""
        return re.compile(f"{SPACE}+[{inside(marks)}]*{rest}{more}|[{inside(marks)}]+{rest}{more}|"
                          f"[^{SPACE}{inside(marks)}]+{more}" if marks else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    def merge(self, segment: str) -> list:
        """Ids of one segment, by the agenda of its adjacent pairs."""
        symbols = list(segment)
        scores, ends = self.scores, list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        agenda = []
        for i in range(len(symbols) - 1):
            score = scores.get(symbols[i] + symbols[i + 1])
            if score is not None:
                agenda.append((-score, i, symbols[i] + symbols[i + 1]))
        heapq.heapify(agenda)
        last = len(symbols)
        while agenda:
            _, left, joint = heapq.heappop(agenda)
            right = ends[left]
            if symbols[left] is None or right >= last or len(joint) != len(symbols[left]) + len(symbols[right] or "") \
                    or symbols[left] + symbols[right] != joint:
                continue
            symbols[left], symbols[right] = joint, None
            after = ends[left] = ends[right]
            if after < last:
                before[after] = left
                score = scores.get(joint + symbols[after])
                if score is not None:
                    heapq.heappush(agenda, (-score, left, joint + symbols[after]))
            first = before[left]
            if first >= 0:
                score = scores.get(symbols[first] + joint)
                if score is not None:
                    heapq.heappush(agenda, (-score, first, symbols[first] + joint))
        out = []
        for symbol in symbols:
            if symbol is not None:
                found = self.ids.get(symbol)
                if found is not None:
                    out.append(found)
                elif self.bytes[0] is None:
                    out.append(self.unknown)
                else:
                    out += [self.bytes[b] for b in symbol.encode()]
        return out

    def segment_ids(self, word: str) -> list:
        """Ids of a word, segment by segment between characters that never join."""
        joined, out, start = self.joined, [], 0
        for i in range(1, len(word) + 1):
            if i == len(word) or word[i - 1:i + 1] not in joined:
                segment = word[start:i]
                start = i
                found = self.segments.get(segment)
                if found is None:
                    found = self.merge(segment)
                    if len(self.segments) < KNOWN_SEGMENTS and len(segment) < 64:
                        self.segments[segment] = found
                out += found
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        if not text:
            return np.empty(0, np.int32)
        marked = SPACE + text.replace(" ", SPACE)
        words = self.split(marked) if self.split else [marked]
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), np.int32)

    def check_new_words(self) -> None:
        """Compare the words that were merged since the last call with the library."""
        new, self.words.new = self.words.new, {}
        front = self.library.encode(ALONE)
        found = self.library.encode([ALONE + word.replace(SPACE, " ") for word in new], num_threads=1)
        for (word, merged), ids in zip(new.items(), found, strict=True):
            if front + np.frombuffer(self.words.get(word, merged), np.int32).tolist() != ids:
                raise ValueError(f"the library encodes {word!r} as {ids[len(front):]}")


class _Words(dict):
    """Packed ids of words; a word that is not there is merged, and is new until it is checked."""

    def __init__(self, pieces: MergePieces):
        super().__init__()
        self.pieces, self.new = pieces, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.new.get(word)
        if ids is None:
            ids = self.new[word] = np.array(self.pieces.segment_ids(word), np.int32).tobytes()
            if len(self) < KNOWN_WORDS and len(word) < 64:
                self[word] = ids
        return ids


_MODELS = {}


def pieces_of(model: str) -> MergePieces:
    """The model of this task's process, loaded once."""
    if model not in _MODELS:
        _MODELS[model] = MergePieces(model)
    return _MODELS[model]


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row's whole text."""
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in slices(batches):
            made = [pieces.encode((t or b"").decode()) for t in as_bytes(batch.column(1))]
            pieces.check_new_words()
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(made)], ["doc_id", "ids"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(encoded, f"doc_id {id_type(docs, id_col)}, ids array<int>")


def _lists(arrays: list) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def token_digests(encoded: DataFrame, model: str) -> DataFrame:
    """The rows of ``encode_documents`` with their digests, decoded by the library."""
    kept = f"doc_id {id_type(encoded, 'doc_id')}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, ids array<int>"

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = pieces_of(model).library
        decimals = [str(i) for i in range(library.get_piece_size())]
        for batch in slices(batches):
            column, counts, ids_digest, text_digest = batch.column(1), [], [], []
            values = np.asarray(column.flatten())
            stops = np.cumsum(np.asarray(column.value_lengths())).tolist()
            for start, stop in zip([0, *stops[:-1]], stops, strict=True):
                ids = values[start:stop].tolist()
                counts.append(len(ids))
                ids_digest.append(hashlib.sha256(",".join([decimals[i] for i in ids]).encode()).hexdigest())
                text_digest.append(hashlib.sha256(library.decode(ids).encode() if ids else b"").hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digest, pa.string()),
                 pa.array(text_digest, pa.string()), column],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"],
            )

    return encoded.mapInArrow(digested, kept)


def library_differences(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id): rows whose whole text the library encodes to other ids."""
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in slices(batches):
            texts = [(t or b"").decode() for t in as_bytes(batch.column(1))]
            wanted = pieces.library.encode(texts, num_threads=1)
            other = [pieces.encode(t).tolist() != ids for t, ids in zip(texts, wanted, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(other, pa.bool_()))], ["doc_id"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(compared, f"doc_id {id_type(docs, id_col)}")
