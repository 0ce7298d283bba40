"""Token ids of the public byte-level BPE vocabularies, as ``tokenizers`` gives them.

Natural text repeats its words, so each distinct piece is encoded once. A text
is cut only where both tokenizers cut it for certain: at a white-space
character between two others, and between Latin letters and the ASCII
punctuation that ends a piece. Such a run of letters or marks is one word of
the tokenizers' own rule and goes straight to their merge model; other pieces
go through the whole tokenizer. Arrow cuts the texts of a batch, numbers their
distinct pieces and looks them up, numpy puts the ids together. Known pieces
and words are kept in bounded Arrow tables of the Python worker, some 10 MB
(once one is full, further entries are encoded and not kept). Texts that can't be cut (runs of white space, text that
looks like a special token) are encoded whole. The ids are those of
``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import END_ID, lots

_HELD: dict[tuple[str, str], Encoder] = {}
LIMIT = 400_000                       # pieces kept by a worker, and parts of pieces
LONGEST = 64                          # characters of an entry that is kept
LOT = 8 << 20                         # bytes of text handled at once (or one text)

#: Latin letters, then ASCII punctuation to the end that no contraction begins.
_WORD_THEN_MARKS = r"\A(?P<w> ?[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<m>[!-&(-/:-@\[-`{-~][!-/:-@\[-`{-~]*)?\z"
#: Byte-level vocabularies write a byte as one character: printable ones as themselves, the others from U+0100 on in order.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARACTERS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[start:start + size] one after another, and where each begins (with the end behind)."""
    upto = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=upto[1:])
    at = np.repeat(start - upto[:-1], size)
    at += np.arange(upto[-1], dtype=np.int32)
    return flat[at], upto


class _Table:
    """Strings and their ids: those of string k stand in flat[start[k]:start[k] + size[k]]."""

    def __init__(self, dtype: np.dtype):
        self.strings = pa.array([], pa.string())
        self.flat, self.start, self.size = np.zeros(0, dtype), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def find(self, strings: pa.Array) -> np.ndarray:
        return np.array(pc.fill_null(pc.index_in(strings, value_set=self.strings), -1))

    def extended(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The arrays with further entries behind those of the table."""
        return (np.concatenate([self.flat, flat]), np.concatenate([self.start, (start + len(self.flat)).astype(np.int32)]),
                np.concatenate([self.size, size.astype(np.int32)]))

    def keep(self, strings: pa.Array, flat: np.ndarray, start: np.ndarray, size: np.ndarray, good: np.ndarray) -> None:
        """Add the entries that are ``good`` and not too long, as many as the table still takes."""
        rows = np.flatnonzero(good & (np.asarray(pc.utf8_length(strings)) <= LONGEST))[:max(0, LIMIT - len(self.strings))]
        if len(rows):
            flat, upto = _gather(flat, start[rows], size[rows])
            self.flat, self.start, self.size = self.extended(flat, upto[:-1], size[rows])
            self.strings = pa.concat_arrays([self.strings, strings.take(pa.array(rows))])


class Encoder:
    """Ids of ``dtype`` (an unsigned little-endian numpy type)."""

    def __init__(self, path: str, dtype: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype(dtype)
        self.end = np.array([END_ID], self.dtype)
        self.pieces, self.words = _Table(self.dtype), _Table(self.dtype)

        def plain(text: str) -> list[int]:
            return self.tokenizer.encode(text, add_special_tokens=False).ids

        # does white space belong to the tokens (byte-level), or is it dropped? does case count?
        self.keeps_blanks = plain("a b") != plain("a") + plain("b")
        self.folds_case = plain("ABC") == plain("abc")
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        # pieces that show that the text can't be cut: a special token; white space beside white space
        self.bad = re.compile("|".join(special + ([r"\A\Z", r"\A \Z", r"\A[^\S ](?s:.)", r"(?!\A)\s"] if self.keeps_blanks else []))
                              or r"(?!)")

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after another and how many each has, from one
        call: the library numbers the texts its tokens come from."""
        found = self.tokenizer.encode(texts, is_pretokenized=True, add_special_tokens=False)
        return np.array(found.ids, self.dtype), np.bincount(np.array(found.word_ids, np.int64), minlength=len(texts))

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that the tokenizer would not cut."""
        tokenize = self.tokenizer.model.tokenize
        ids, sizes = [], []
        for w in words:
            w = w.replace(" ", "\u0120") if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_CHARACTERS)
            found = [t.id for t in tokenize(w)]
            ids += found
            sizes.append(len(found))
        return np.array(ids, self.dtype), np.array(sizes, np.int64)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """flat, start and size of each word."""
        distinct = words.dictionary_encode()
        known = self.words.find(distinct.dictionary)
        missing = np.flatnonzero(known < 0)
        new = distinct.dictionary.take(pa.array(missing))
        flat, size = self._merge(new.to_pylist())
        start = np.cumsum(size) - size
        known[missing] = len(self.words.strings) + np.arange(len(missing))
        everything = self.words.extended(flat, start, size)
        self.words.keep(new, flat, start, size, np.ones(len(new), bool))
        k = known[np.asarray(distinct.indices)]
        return everything[0], everything[1][k], everything[2][k]

    def _new(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """flat, start and size of pieces not known yet, and which of them show that a text can't be cut."""
        cut = pc.extract_regex(pieces, _WORD_THEN_MARKS)
        plain = np.asarray(cut.is_valid())
        start, size, wrong = (np.zeros(len(pieces), t) for t in (np.int64, np.int64, bool))
        both = cut.filter(pa.array(plain))
        w, m = both.field("w"), pc.fill_null(both.field("m"), "")
        flat, at, n = self._words(pa.concat_arrays([pc.utf8_lower(w) if self.folds_case else w, m]))
        order = np.arange(2 * len(w)).reshape(2, -1).T.ravel()                 # each word, then its marks
        flat, upto = _gather(flat, at[order], n[order])
        start[plain], size[plain] = upto[:-1:2], upto[2::2] - upto[:-1:2]
        rest = np.flatnonzero(~plain)
        texts = pieces.take(pa.array(rest)).to_pylist()
        wrong[rest] = [self.bad.search(t) is not None for t in texts]
        rest, texts = rest[~wrong[rest]], [t for t, x in zip(texts, wrong[rest].tolist(), strict=True) if not x]
        if texts:
            more, size[rest] = self._encode(texts)
            start[rest] = len(flat) + np.cumsum(size[rest]) - size[rest]
            flat = np.concatenate([flat, more])
        return flat, start, size, wrong

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        if self.keeps_blanks:         # " word" and a line end are pieces of their own
            texts = pc.replace_substring(pc.replace_substring(texts, " ", "\x00 "), "\n", "\x00\n\x00")
            return pc.split_pattern(texts, "\x00")
        return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")

    def many(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a string array (null as empty), without the end id."""
        for part in lots(pa.RecordBatch.from_arrays([pc.fill_null(texts.cast(pa.string()), "")], names=["text"]), "text", LOT):
            yield from self._lot(part.column(0))
            pa.default_memory_pool().release_unused()

    def _lot(self, texts: pa.Array) -> Iterator[np.ndarray]:
        lists = self._cut(texts)
        ends = np.cumsum(np.asarray(pc.list_value_length(lists)).astype(np.int64))
        pieces = lists.flatten().dictionary_encode()
        del lists
        known = self.pieces.find(pieces.dictionary)
        missing = np.flatnonzero(known < 0)
        new = pieces.dictionary.take(pa.array(missing))
        flat, start, size, bad = self._new(new)
        known[missing] = len(self.pieces.strings) + np.arange(len(missing))
        wrong = np.zeros(len(self.pieces.strings) + len(missing), bool)
        wrong[len(self.pieces.strings):] = bad
        everything = self.pieces.extended(flat, start, size)
        self.pieces.keep(new, flat, start, size, ~bad)
        # ids of all pieces in a row (counted in 32 bits: a lot is LOT bytes or one text), then of each text
        k = known[np.asarray(pieces.indices)]
        ids, upto = _gather(everything[0], everything[1][k], everything[2][k])
        whole = np.zeros(len(texts), bool)
        if bad.any():
            whole[np.searchsorted(ends, np.flatnonzero(wrong[k]), "right")] = True
        if self.keeps_blanks:
            whole |= np.asarray(pc.match_substring(texts, "\x00"))
        del pieces, k, everything
        first = 0
        for i, (last, alone) in enumerate(zip(ends.tolist(), whole.tolist(), strict=True)):
            if alone:
                yield np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, self.dtype)
            else:
                yield ids[upto[first]:upto[last]]
            first = last

    def ids(self, text: str) -> bytes:
        return next(iter(self.many(pa.array([text])))).tobytes()


def encoder(path: str, dtype: str) -> Encoder:
    """The worker's encoder for a vocabulary file, made on first use."""
    if (path, dtype) not in _HELD:
        _HELD[path, dtype] = Encoder(path, dtype)
    return _HELD[path, dtype]
