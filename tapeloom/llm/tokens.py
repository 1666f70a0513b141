"""Token ids of whole texts with the tokenizers library.

Both vocabularies in use cut a text at white space, and between a letter or digit and the signs after it, before they merge
anything, so a text's ids are those of its pieces one after the other. About BLOCK_BYTES of texts at a time are cut by Arrow;
each distinct piece is encoded by the library once and remembered, up to KNOWN_BYTES in a worker, and numpy puts a text's
ids together. Signs are cut off behind ASCII letters and digits alone: other letters may end in a mark once they are
normalised, and marks go with the signs. A text goes to the library whole if white space in it can't be cut like that, or if
it may hold an added token such as <|endoftext|>, which the library, left at its default, finds before it cuts.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut at once, and bytes of words and ids that a worker remembers, about.
BLOCK_BYTES, KNOWN_BYTES = 4 << 20, 96 << 20
SIGNS = ".,!?;:%$&#*|"
_SPACE = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Where white space is a run that a cut before its spaces would break; white space for Arrow, signs for the vocabularies.
_RUN, _SEPARATORS = rf"[{_SPACE}] ([{_SPACE}]|\z)", r"[\x{1c}-\x{1f}]"


@functools.cache
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _marks(path: str) -> tuple[str, ...]:
    """A run of signs of each added token: a text without any of them holds no added token."""
    return tuple({max(re.findall(r"[^\w\s]+", t.content), key=len, default="") for t in _library(path).get_added_tokens_decoder().values()})


def ragged(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """pool[start : start + length] of every row, one after the other."""
    before, total = np.cumsum(length) - length, int(length.sum())
    kind = np.int32 if max(total, len(pool)) < 1 << 31 else np.int64
    at = np.repeat((start - before).astype(kind), length)
    at += np.arange(total, dtype=kind)
    return pool[at]


class Words:
    """Encoded words, whose ids are rows of a pool; row 0 has none. front: what stands before each word. When half of
    KNOWN_BYTES is full, the words are kept as the older half, from which those that come again are taken over."""

    def __init__(self, library, front: str):
        self.library, self.front = library, front
        #: Whether the vocabulary takes a word in capitals for the one in small letters.
        self.folds = library.encode("ABZ", add_special_tokens=False).ids == library.encode("abz", add_special_tokens=False).ids
        names = library.get_vocab(with_added_tokens=True)
        #: By id: a word's first token in a vocabulary with spaces, a word's last one in the other.
        self.edge = np.zeros(max(names.values()) + 1, bool)
        self.edge[[i for name, i in names.items() if (name[:1] == "\u0120" if front else name.endswith("</w>"))]] = True
        self.old = None
        self._clear()

    def _clear(self) -> None:
        self.row, self.size = {"": 0}, 0
        self.pool, self.start, self.length = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def rows(self, words: pa.StringArray) -> np.ndarray:
        """The rows of distinct words."""
        if self.size > KNOWN_BYTES // 2:
            self.old = (self.row, self.pool, self.start, self.length)
            self._clear()
        names = words.to_pylist()
        out = list(map(self.row.get, names))
        new = [k for k, r in enumerate(out) if r is None]
        if new and self.old:
            row, pool, start, length = self.old
            again = [k for k in new if names[k] in row]
            if again:
                rows = np.array([row[names[k]] for k in again])
                self._add(names, again, out, ragged(pool, start[rows], length[rows]), length[rows])
                new = [k for k in new if out[k] is None]
        if new:
            self._learn(words, names, new, out)
        return np.array(out, np.int64)

    def _add(self, names: list[str], at: list[int], out: list, ids: np.ndarray, length: np.ndarray) -> None:
        first, have = len(self.length), len(self.pool)
        self.pool, self.length = np.concatenate([self.pool, ids]), np.concatenate([self.length, length])
        self.start = np.concatenate([self.start, have + np.cumsum(length) - length])
        for r, k in enumerate(at, first):
            out[k] = self.row[names[k]] = r
        self.size += 200 * len(at) + 4 * len(ids)

    def _learn(self, words: pa.StringArray, names: list[str], new: list[int], out: list) -> None:
        """Words of ASCII letters alone go to the library as one text if its ids tell where a word starts or ends."""
        alpha = pc.ascii_is_alpha(words).to_numpy(zero_copy_only=False)
        rest = []
        for k in range(0, len(new), 20_000):
            some = new[k : k + 20_000]
            plain = [w for w in some if alpha[w]]
            rest += [w for w in some if not alpha[w]]
            ids = np.array(self.library.encode_batch_fast([self.front + (self.front or " ").join(names[w] for w in plain)], add_special_tokens=False)[0].ids, "<u4") if self.edge.any() else np.zeros(0, "<u4")
            at = np.flatnonzero(self.edge[ids])
            if plain and len(at) == len(plain):
                self._add(names, plain, out, ids, np.diff(np.append(at, len(ids)) if self.front else np.append(-1, at)))
            else:
                rest += plain
        for k in range(0, len(rest), 20_000):
            some = rest[k : k + 20_000]
            got = [e.ids for e in self.library.encode_batch_fast([self.front + names[w] for w in some], add_special_tokens=False)]
            self._add(names, some, out, np.array([i for e in got for i in e], "<u4"), np.array([len(e) for e in got], np.int64))


@functools.cache
def _words(path: str, front: str, kind: str = "word") -> Words:
    return Words(_library(path), front)


def forget() -> None:
    """Lets go of all words that this worker remembers."""
    _words.cache_clear()


def _entries(words: Words, signs: Words, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how many of each piece) of distinct pieces: those of the word and of the signs after it."""
    edges = lambda x: np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
    stems = pc.utf8_rtrim(pieces, SIGNS)
    raw, offsets, size = np.frombuffer(pieces.buffers()[2] or b"", np.uint8), edges(pieces), np.diff(edges(stems))
    last = raw[np.maximum(offsets[:-1] + size - 1, 0)] if len(raw) else np.zeros(len(pieces), np.uint8)
    letter = (size > 0) & (((last >= 48) & (last <= 57)) | (((last | 32) >= 97) & ((last | 32) <= 122)))
    cut = letter & (size < np.diff(offsets))
    one = stems if (cut | (size == np.diff(offsets))).all() else pc.if_else(pa.array(cut), stems, pieces)
    if words.folds:  # beyond ASCII a capital may go together with a mark otherwise than its small letter does
        one = pc.if_else(pc.string_is_ascii(one), pc.ascii_lower(one), one)
    known = one.dictionary_encode()
    a, b = words.rows(known.dictionary)[known.indices.to_numpy()], np.zeros(len(pieces), np.int64)
    if cut.any():  # the bytes behind the stems, as words of their own
        tail = offsets[1:][cut] - offsets[:-1][cut] - size[cut]
        ends = np.concatenate([[0], np.cumsum(tail)]).astype(np.int32)
        tails = pa.StringArray.from_buffers(len(tail), pa.py_buffer(ends), pa.py_buffer(ragged(raw, (offsets[1:][cut] - tail).astype(np.int64), tail))).dictionary_encode()
        b[cut] = signs.rows(tails.dictionary)[tails.indices.to_numpy()]
    both, length = np.stack([a, b], 1), np.stack([words.length[a], signs.length[b]], 1)
    out = np.empty(int(length.sum()), "<u4")
    mine = np.repeat(np.tile([True, False], len(a)), length.ravel())
    out[mine], out[~mine] = ragged(words.pool, words.start[both[:, 0]], length[:, 0]), ragged(signs.pool, signs.start[both[:, 1]], length[:, 1])
    return out, length.sum(1)


def encode(texts: pa.StringArray, path: str, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of the texts, without special tokens. spaced: the vocabulary keeps white space, and a space goes with
    the word after it; else white space is dropped."""
    library, bare = _library(path), _words(path, "")
    odd = pc.match_substring_regex(texts, _RUN if spaced else _SEPARATORS)
    for mark in _marks(path):
        odd = pc.or_(odd, pc.match_substring(texts, mark))
    if any_odd := pc.any(odd).as_py():
        plain = pc.if_else(odd, "", texts)
    else:
        plain = texts
    lists = pc.split_pattern(plain, " ") if spaced else pc.utf8_split_whitespace(plain)
    at = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
    pieces = lists.values
    known = pieces.dictionary_encode()
    kinds, index = known.dictionary, known.indices.to_numpy()
    ids, size = _entries(_words(path, " ") if spaced else bare, _words(path, "", "signs"), kinds)
    if spaced:  # a text's first piece has no space before it, an empty piece behind another is a space
        first = at[:-1][at[1:] > at[:-1]]
        index = index.copy()
        lead = pieces.take(pa.array(first)).dictionary_encode()
        heads = bare.rows(lead.dictionary)[lead.indices.to_numpy()]
        blank = np.flatnonzero(pc.equal(kinds, "").to_numpy(zero_copy_only=False))
        more, n = [ragged(bare.pool, bare.start[heads], bare.length[heads])], [bare.length[heads]]
        index[first] = len(kinds) + np.arange(len(first))
        if len(blank):
            space = np.array(library.encode(" ", add_special_tokens=False).ids, "<u4")
            rest = np.ones(len(index), bool)
            rest[first] = False
            index[rest & (index == blank[0])] = len(kinds) + len(first)
            more.append(space), n.append(np.array([len(space)]))
        ids, size = np.concatenate([ids, *more]), np.concatenate([size, *n])
    start = np.cumsum(size) - size
    counts = size[index]
    out = ragged(ids, start[index], counts)
    offsets = np.concatenate([[0], np.cumsum(counts)])[at - at[0]]
    if any_odd:
        parts, sizes, done = [], np.diff(offsets), 0
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            own = np.array(library.encode(texts[k].as_py(), add_special_tokens=False).ids, "<u4")
            parts += [out[done : offsets[k]], own]
            done, sizes[k] = offsets[k + 1], len(own)
        out, offsets = np.concatenate([*parts, out[done:]]), np.concatenate([[0], np.cumsum(sizes)])
    return out, offsets


def _blocks(column: pa.Array):
    """Runs of whole texts of about BLOCK_BYTES; a longer text is a run of its own."""
    column = pc.fill_null(column, "")
    ends = np.cumsum(pc.binary_length(column).to_numpy())
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_BYTES, "right")))
        yield column.slice(at, to - at)
        at = to


def _slices(text: str, spaced: bool):
    """A long text in parts of about BLOCK_BYTES characters that are cut where pieces are: before a space between two signs
    that are none."""
    at = 0
    while len(text) - at > 2 * BLOCK_BYTES:
        cut = re.compile(r"(?<=\S) (?=\S)").search(text, at + BLOCK_BYTES)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start() if spaced else cut.end()
    yield text[at:]


def encoded(batches, path: str, spaced: bool, end: int, key: str = "doc_id", text: str = "text"):
    """(key, ids as little-endian unsigned 32-bit bytes, the end id included) of every row of the batches in order."""
    last = np.array([end], "<u4").tobytes()
    for batch in batches:
        keys, row = batch.column(key).to_pylist(), 0
        for block in _blocks(batch.column(text)):
            if len(block) == 1 and block.nbytes > 2 * BLOCK_BYTES and not any(m in block[0].as_py() for m in _marks(path)):
                parts = [encode(pa.array([part]), path, spaced)[0].tobytes() for part in _slices(block[0].as_py(), spaced)]
                yield keys[row], b"".join([*parts, last])
            else:
                ids, offsets = encode(block, path, spaced)
                raw, offsets = ids.tobytes(), (4 * offsets).tolist()
                for k, a, b in zip(keys[row:], offsets, offsets[1:], strict=False):
                    yield k, raw[a:b] + last
            row += len(block)
