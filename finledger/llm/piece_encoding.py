"""SentencePiece encoding and decoding: exact merge-type (BPE) ids by backtracking.

A merge-type model joins, again and again, the neighbours whose concatenation
is the piece of the highest score (leftmost of equals). Its result is the one
sequence of pieces in which every two neighbours, merged anew on their own, stay
the same two pieces. So a text is encoded from left to right:

* an Aho-Corasick automaton gives the longest piece at each position;
* a piece is taken if it is compatible with the one before it, which is found by
  re-merging the two (and remembered); else its next shorter prefix is tried;
* where no prefix fits, the position is marked as failed in a bitfield, the last
  piece is given up and shortened. A prefix of the text has one encoding only, so a
  failed position never needs a second look, and the work stays linear.

The normaliser is the model's own. Where no piece holds the space mark behind another
character, no merge crosses the start of a word, and a text is encoded word by word
with the words' ids remembered; otherwise the whole text is one stretch.
Characters without a piece become their UTF-8 bytes' pieces.

Texts are read once, in one pass without a shuffle; a task holds a few MB of text, the model and
bounded memories of words and pairs. Decoding joins the pieces' bytes.

Defined cases: a null text is empty and gives the end id alone, which decodes to
the empty text; very long texts and words are encoded whole; repeated rows are encoded each; an empty table gives an
empty result; columns of the input pass through, the added ones get leading underscores where their name is taken. On
decoding, null ids give a null text, and an id beyond the vocabulary is an error, as in the library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from finledger.llm._common import free_name, in_pieces

MARK = "▁"           # stands for a space inside pieces
_BATCH = 4 << 20          # characters (encoding) or ids (decoding) of one batch
_WORDS = 1_000_000        # remembered words (about 230 bytes each)
_PAIRS = 500_000          # remembered pairs of tokens
_SHORT = 64               # longer words are not remembered
_NONE: dict[int, bool] = {}


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A merge-type model as tables. The library reads the file and normalises; it never encodes or decodes here."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalize: Callable[[str], str] = sp.normalize
        self.end = sp.eos_id()
        self.ids, self.score, self.byte_ids = {}, {}, [None] * 256
        self.bytes_of: list[bytes] = []
        self.controls = {i for i in range(sp.get_piece_size()) if sp.is_control(i)}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes_of.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i):
                self.bytes_of.append(b"")
            elif sp.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode())
            else:
                self.bytes_of.append(piece.replace(MARK, " ").encode())
                if not sp.is_unused(i):
                    self.ids[piece], self.score[piece] = i, sp.get_score(i)
        if None in self.byte_ids:
            raise ValueError("the model needs a piece for every byte")
        self.prefixed = sp.normalize("a").startswith(MARK)     # texts get a space in front, which decoding takes away
        self.starts_marked = {i for p, i in self.ids.items() if p.startswith(MARK)}
        self.in_words = not any(MARK in p.lstrip(MARK) for p in self.ids)
        # tokens are numbers: the ids of pieces, and from there on characters that are no pieces
        self.text_of = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.size = [len(p) for p in self.text_of]
        self.n_pieces = len(self.text_of)
        self.code = "H" if self.n_pieces <= 1 << 16 else "I"
        self.characters: dict[str, int] = {}
        self.shorter_of: dict[int, int] = {}
        self.pairs: dict[int, dict[int, bool]] = {}
        self.n_pairs = 0
        self.words: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}
        self._automaton = None

    @property
    def automaton(self):
        """Of the pieces that stand: merging their characters gives them. Others never appear in a result."""
        if self._automaton is None:
            import ahocorasick

            self.standing = {p for p in self.ids if self.merged(p) == [p]}
            self._automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for p in self.standing:
                self._automaton.add_word(p, self.ids[p])
            self._automaton.make_automaton()
        return self._automaton

    def merged(self, text: str) -> list[str]:
        """Plain merging of a short text: the best pair first, the leftmost of equals."""
        parts, score = list(text), self.score.get
        pairs = [score(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, s in enumerate(pairs):
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = score(parts[at - 1] + parts[at])
            if at < len(pairs):
                pairs[at] = score(parts[at] + parts[at + 1])

    def character(self, c: str) -> int:
        """The token of one character."""
        i = self.ids.get(c)
        if i is None:
            i = self.characters.get(c)
        if i is None:
            i = self.characters[c] = len(self.text_of)
            self.text_of.append(c)
            self.size.append(1)
        return i

    def shorter(self, token: int) -> int:
        """The longest proper prefix that stands; -1 for a character."""
        known = self.shorter_of.get(token)
        if known is None:
            text = self.text_of[token]
            n = next((n for n in range(len(text) - 1, 1, -1) if text[:n] in self.standing), 1)
            known = self.shorter_of[token] = -1 if len(text) == 1 else self.ids[text[:n]] if n > 1 else self.character(text[0])
        return known

    def _fits(self, a: int, b: int) -> bool:
        """Whether re-merging two tokens gives the same two."""
        if self.n_pairs >= _PAIRS:
            self.pairs.clear()
            self.n_pairs = 0
        x, y = self.text_of[a], self.text_of[b]
        known = self.merged(x + y) == [x, y]
        self.pairs.setdefault(a, {})[b] = known
        self.n_pairs += 1
        return known

    def split(self, text: str) -> list[int]:
        """The tokens of a normalised stretch, by backtracking."""
        n, size, pairs, shorter_of = len(text), self.size, self.pairs, self.shorter_of
        longest = [-1] * n
        for end, i in self.automaton.iter(text):   # ends ascend: the longest piece of a start comes last
            longest[end + 1 - size[i]] = i
        failed = None
        out: list[int] = []
        at, last = 0, -1
        while at < n:
            piece = longest[at]
            if piece < 0:
                piece = self.character(text[at])
            after = pairs.get(last, _NONE)
            while True:
                end = at + size[piece]
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    if last < 0:
                        break
                    fits = after.get(piece)
                    if fits is None:
                        fits = self._fits(last, piece)
                        after = pairs.get(last, _NONE)
                    if fits:
                        break
                piece = shorter_of[piece] if piece in shorter_of else self.shorter(piece)
                while piece < 0:
                    # no prefix fits here, nor will it later: give up the token before (a first one of one character always fits)
                    if failed is None:
                        failed = bytearray((n >> 3) + 1)
                    failed[at >> 3] |= 1 << (at & 7)
                    gone = out.pop()
                    at -= size[gone]
                    last = out[-1] if out else -1
                    after = pairs.get(last, _NONE)
                    piece = self.shorter(gone)
            out.append(piece)
            at, last = end, piece
        return out

    def ids_of(self, stretch: str) -> bytes:
        from array import array

        out, n = self.split(stretch), self.n_pieces
        if max(out, default=0) >= n:
            out = [x for i in out for x in ((i,) if i < n else map(self.byte_ids.__getitem__, self.text_of[i].encode()))]
        return array(self.code, out).tobytes()

    def _word_ids(self, word: str) -> bytes:
        """Ids of the space mark and a word that the newer memory lacks. Two memories: what is used again moves to the newer one."""
        known = self.older_words.get(word)
        if known is None:
            known = self.ids_of(MARK + word)
        if len(word) <= _SHORT:
            if len(self.words) >= _WORDS // 2:
                self.words, self.older_words = {}, self.words
            self.words[word] = known
        return known

    def encode(self, text: str) -> bytes:
        """Ids without the end id, as native numbers of :attr:`code`."""
        import re

        text = self.normalize(text)
        if not self.in_words:
            return self.ids_of(text)
        if MARK + MARK in text:
            stretches = re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", text)
            first = "" if text[0] == MARK else stretches.pop(0)
            words = [s[1:] for s in stretches]
        else:
            first, *words = text.split(MARK)
        known = self.words
        return self.ids_of(first) + b"".join([known.get(w) or self._word_ids(w) for w in words])

    def decode(self, ids: list[int]) -> str:
        import codecs

        try:
            codecs.lookup_error("a mark for each byte")
        except LookupError:
            codecs.register_error("a mark for each byte", lambda e: ("�" * (e.end - e.start), e.end))
        parts = [b"".join(map(self.bytes_of.__getitem__, part)) for part in self._between_controls(ids)]
        first = next((i for i in ids if self.bytes_of[i]), None)
        if self.prefixed and first in self.starts_marked:
            at = next(k for k, part in enumerate(parts) if part)
            parts[at] = parts[at][1:]
        return "".join(part.decode("utf-8", "a mark for each byte") for part in parts)

    def _between_controls(self, ids: list[int]) -> list[list[int]]:
        """Bytes on both sides of a control piece never form one character."""
        if not self.controls.intersection(ids[:-1]):
            return [ids]
        parts: list[list[int]] = [[]]
        for i in ids:
            if i in self.controls:
                parts.append([])
            else:
                parts[-1].append(i)
        return parts


def _loaded(path: str) -> Pieces:
    """The model of a Python worker: its memories serve all tasks that the worker runs."""
    import sys
    import types

    kept = sys.modules.setdefault("_piece_models", types.ModuleType("_piece_models")).__dict__.setdefault("by_path", {})
    if path not in kept:
        kept[path] = Pieces(path)
    return kept[path]


def _per_batch(df: DataFrame, column: str, added: list[StructField], size, convert, keep: list[str] | None) -> DataFrame:
    """The kept columns and those that ``convert()`` makes of another: values -> an Arrow array for each, a bounded batch at a time."""
    kept = df.columns if keep is None else keep
    names = [f"c{i}" for i in range(len(kept))]
    taken = list(kept)
    for f in added:
        taken.append(free_name(f.name, taken))
    made = [f"made{i}" for i in range(len(added))]
    fields = [StructField(n, df.schema[c].dataType) for n, c in zip(names, kept)]
    schema = StructType([*fields, *[StructField(n, f.dataType) for n, f in zip(made, added)]])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        make = convert()
        for b in batches:
            for some in in_pieces(range(b.num_rows), lambda i: size(b.column(0)[i]), _BATCH):
                part = b.slice(some[0], len(some))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *make(part.column(0))], [*names, *made])

    rows = df.select(F.col(f"`{column}`").alias("value"), *[F.col(f"`{c}`").alias(n) for n, c in zip(names, kept)])
    return rows.mapInArrow(run, schema).toDF(*taken)


def encode(docs: DataFrame, text: str = "text", model: str | None = None, end_id: bool = True, out: str = "ids",
           decoded: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds ``out``: the ids of the whole text as the model's library gives them, and the end id; with ``decoded`` also the text
    that those ids decode to. ``keep`` names the columns that stay (default: all)."""
    path = model or model_path()

    def convert():
        import numpy as np
        import pyarrow as pa

        pieces = _loaded(path)
        number = np.dtype(pieces.code)
        end = number.type(pieces.end).tobytes() if end_id else b""

        def make(texts):
            rows = [pieces.encode(t.as_py() or "") + end for t in texts]
            offsets = np.cumsum([0, *(len(r) // number.itemsize for r in rows)], dtype=np.int32)
            ids = np.frombuffer(b"".join(rows), dtype=number).astype(np.int32)
            columns = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))]
            if decoded:
                columns.append(pa.array([pieces.decode(np.frombuffer(r, dtype=number).tolist()) for r in rows], pa.string()))
            return columns
        return make

    added = [StructField(out, ArrayType(IntegerType())), *([StructField(decoded, StringType())] if decoded else [])]
    return _per_batch(docs, text, added, lambda t: len(t.as_py() or ""), convert, keep)


def decode(df: DataFrame, ids: str = "ids", model: str | None = None, out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Adds ``out``: the text of the ids."""
    path = model or model_path()

    def convert():
        import pyarrow as pa

        pieces = _loaded(path)
        return lambda rows: [pa.array([None if r is None else pieces.decode(r) for r in rows.to_pylist()], pa.string())]

    return _per_batch(df, ids, [StructField(out, StringType())], lambda r: len(r) if r.is_valid else 0, convert, keep)
