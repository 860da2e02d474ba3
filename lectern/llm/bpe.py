"""Byte-level BPE ids at corpus speed.

The ids are those of the ``tokenizers`` library and its vocabulary file. Its byte-level pre-tokenizer always starts a
new piece at a space before something else than white space, so texts are cut there, and a text's ids are put together
from those of its words. New words go through the library, many in one call: letters alone are one piece to it, signs
after them another, and a line's end between them a third; whatever else there is goes through its pre-tokenizer. Words
of these pieces are looked up and kept as columns, a piece at a time (a word has the same entry with and without signs).
A text with an added token's string in it goes through the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import only

END_OF_DOCUMENT = 2
#: Words remembered by a Python worker, twice at most: those of the last so many new ones, and those before them.
REMEMBERED = 500_000
#: Beginnings of texts remembered likewise.
HEADS = 20_000
#: Pieces remembered as columns by a Python worker, of either kind (about 40 bytes each); beyond, half of them go.
PIECES = 1_000_000
#: Bytes of text whose ids are put together at once, and at least whose words are looked up together.
TOGETHER, LOOKED_UP = 8 << 20, 32 << 20
#: Where a piece starts whatever stands before it, and what makes that differ from all single spaces (two of Unicode's white spaces).
CUT, RUN = re.compile(r" (?=\S)"), r"[\t-\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"
#: Signs that are split from the letters before them.
SIGNS = ".,;:!?"
#: Letters whatever the version of Unicode, and words of them, signs after them and single ends of lines before more of them.
LETTERS = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+"
SIMPLE = rf"\A{LETTERS}[{SIGNS}]*(?:\n{LETTERS}[{SIGNS}]*)*\z"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _flat(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4


def gathered(table: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``table`` one after another, and where each ends."""
    ends = np.cumsum(size)
    place = np.repeat(start - (ends - size), size)
    place += np.arange(len(place))
    return table[place], ends


class Remembered:
    """Pieces of text with their ids, as columns; ``share``: of ``PIECES``."""

    def __init__(self, share: float = 1) -> None:
        self.share = share
        self.texts = pa.array([], pa.large_string())
        self.ids, self.size, self.used = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.float32)

    def find(self, texts: pa.Array, learn: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A table of ids, and for each of some distinct texts where its own start there, and how many they are.

        ``learn`` gives new ones' ids one after another, and how many each has.
        """
        at = pc.index_in(texts, value_set=self.texts)
        new = texts.filter(pc.is_null(at))
        at = np.asarray(at.fill_null(-1)).astype(np.int64)
        if len(new):
            at[at < 0] = len(self.texts) + np.arange(len(new))
            ids, size = learn(new)
            self.texts, self.ids, self.size = pa.concat_arrays([self.texts, new]), np.concatenate([self.ids, ids]), np.concatenate([self.size, size])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.float32)])
        self.used /= 2
        self.used[at] += 1
        ids, size = self.ids, self.size
        start = np.cumsum(size) - size
        if len(size) > (most := int(PIECES * self.share)):
            # those used most, and of late
            kept = np.sort(np.argpartition(-self.used, most // 2)[: most // 2])
            self.ids, self.size, self.used, self.texts = gathered(ids, start[kept], size[kept])[0], size[kept], self.used[kept], self.texts.take(pa.array(kept))
        return ids, start[at], size[at]


class WordEncoder:
    """``share``: of what is looked up together and remembered at most; a smaller one takes less memory and more time."""

    def __init__(self, path: str, share: float = 1) -> None:
        self.share = share
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # for pieces in the pre-tokenizer's alphabet, one a line
        self.pieces = Tokenizer(self.tokenizer.model)
        self.pieces.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        self.alphabet = {10: 10} | {b: self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(b))[0][0] for b in range(128) if b != 10}
        shown = "".join(p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str("".join(map(chr, range(128, 0x800)))))
        for char, raw in zip(range(128, 0x800), zip(shown[::2], shown[1::2])):
            self.alphabet |= dict(zip(chr(char).encode(), raw))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        self.starts = np.zeros(self.size, bool)  # tokens that begin with a space, as a word's first one alone does
        self.starts[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("\u0120")]] = True
        self.known: dict[str, bytes] = {}  # by word, its ids after a space
        self.before: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}  # by a text's first word, its ids
        # letters after a space, and at the beginning of a text or line; signs and ends of lines after them
        self.spaced, self.leading, self.tails = (Remembered(share) for _ in range(3))

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, words: list[str]) -> None:
        """Words of letters alone."""
        for i in range(0, len(words), 5000):
            some = words[i : i + 5000]
            (encoded,) = self.pieces.encode_batch_fast([(" " + "\n ".join(some)).encode().decode("latin-1").translate(self.alphabet)], add_special_tokens=False)
            self._keep(some, encoded.ids)

    def _keep(self, words: list[str], ids: list[int]) -> None:
        ids = np.array(ids, "<u4")
        raw, at = ids.tobytes(), (4 * np.flatnonzero(self.starts[ids])).tolist()
        self.known.update({w: raw[a:b] for w, a, b in zip(words, at, [*at[1:], len(raw)], strict=True)})

    def _learn(self, words: set[str]) -> None:
        known, letters, signed, others = self.known, [], [], []
        for w in words:
            if w.isalpha():
                letters.append(w)
            elif (core := w.rstrip(SIGNS)).isalpha():
                signed.append((w, core, w[len(core) :]))
            else:
                others.append(w)
        self._encode([*{c for _, c, _ in signed if c not in known}.union(letters)])
        tails = [*{t for *_, t in signed}]
        ids = dict(zip(tails, self.whole(tails)))
        known.update({w: known[c] + ids[t] for w, c, t in signed})
        # with a space inside, a word does not start at each piece with a space
        odd = [w for w in others if not w or " " in w]
        known.update(zip(odd, self.whole([f" {w}" for w in odd])))
        plain = [*set(others).difference(odd)]
        for i in range(0, len(plain), 5000):
            some = plain[i : i + 5000]
            self._keep(some, self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids)

    def _after_space(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, each after a space."""
        if len(self.known) > REMEMBERED * self.share:
            self.known, self.before = {}, self.known
        new = {w for w in words if w not in self.known}
        again = {w: self.before[w] for w in new if w in self.before}
        self.known |= again
        self._learn(new.difference(again))
        return [*map(self.known.__getitem__, words)]

    def _first(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words that texts begin with."""
        if len(self.heads) > HEADS * self.share:
            self.heads = {}
        new = [w for w in words if w not in self.heads]
        self.heads.update(zip(new, self.whole(new)))
        return [*map(self.heads.__getitem__, words)]

    def _in_pieces(self, words: pa.Array, before: str) -> np.ndarray:
        """The ids of words of letters one after another, ``before`` before each, as the pieces between ends of lines."""
        found = [np.zeros(0, "<u4")]
        for i in range(0, len(words), 5000):
            text = before + f"\n{before}".join(words.slice(i, 5000).to_pylist())
            (encoded,) = self.pieces.encode_batch_fast([text.encode().decode("latin-1").translate(self.alphabet)], add_special_tokens=False)
            found.append(np.array(encoded.ids, "<u4"))
        return np.concatenate(found)

    def _spaced(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = self._in_pieces(words, " ")
        return ids, np.diff(np.r_[np.flatnonzero(self.starts[ids]), len(ids)])

    def _leading(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = self._in_pieces(words, " \n")  # a lone space tells where each begins
        space = self.starts[ids]
        return ids[~space], np.diff(np.r_[np.flatnonzero(space), len(ids)]) - 1

    def _tails(self, tails: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return _flat(self.whole(tails.to_pylist()))

    def _simple(self, words: pa.Array, leading: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that ``SIMPLE`` describes, and how many each has; those that are ``leading`` have no space before them."""
        lines = pc.split_pattern(words, "\n")
        borders, lines = np.asarray(lines.offsets, np.int64) - lines.offsets[0].as_py(), lines.flatten()
        first, last = np.ones(len(lines), bool), np.zeros(len(lines), bool)
        first[borders[:-1]], last[borders[1:] - 1] = leading, True
        letters = pc.utf8_rtrim(lines, SIGNS)
        # two stretches a line: its letters, and what follows them
        start, size, tables, at = np.zeros((len(lines), 2), np.int64), np.zeros((len(lines), 2), np.int64), [], 0
        signed = np.asarray(pc.binary_length(lines)) != np.asarray(pc.binary_length(letters))
        tailed = pa.array(signed | ~last)
        tails = pc.replace_substring_regex(lines.filter(tailed), rf"\A{LETTERS}", "")
        tails = pc.binary_join_element_wise(tails, pc.if_else(pa.array(last).filter(tailed), "", "\n").cast(pa.large_string()), pa.scalar("", pa.large_string()))
        for column, where, texts, known, learn in (
            (0, ~first, letters.filter(pa.array(~first)), self.spaced, self._spaced),
            (0, first, letters.filter(pa.array(first)), self.leading, self._leading),
            (1, signed | ~last, tails, self.tails, self._tails),
        ):
            coded = texts.dictionary_encode()
            table, begin, length = known.find(coded.dictionary, learn)
            index = np.asarray(coded.indices)
            start[where, column], size[where, column] = begin[index] + at, length[index]
            tables.append(table)
            at += len(table)
        ids, ends = gathered(np.concatenate(tables), start.ravel(), size.ravel())
        return ids, np.diff(np.r_[0, ends[2 * borders[1:] - 1]])

    def _looked_up(self, others: pa.Array, heads: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A table of ids, and for each of some distinct words where its own start, and how many they are: words after a space, then those that texts begin with."""
        words, leading = pa.concat_arrays([others, heads]), np.repeat([False, True], [len(others), len(heads)])
        simple = np.array(pc.match_substring_regex(words, SIMPLE))
        ids, length = self._simple(words.filter(pa.array(simple)), leading[simple])
        odd = [words.filter(pa.array(~simple & m)).to_pylist() for m in (~leading, leading)]
        odd_ids, odd_length = _flat([*self._after_space(odd[0]), *self._first(odd[1])])
        start, size = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        size[simple], size[~simple] = length, odd_length
        start[simple], start[~simple] = np.cumsum(length) - length, len(ids) + np.cumsum(odd_length) - odd_length
        return np.concatenate([ids, odd_ids]), start, size

    def _plain(self, slices: list[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and ends of slices of texts whose white space is single."""
        cut = []
        for texts in slices:
            split = pc.split_pattern(texts, " ")
            words, borders = split.flatten(), np.asarray(split.offsets) - split.offsets[0].as_py()
            first = np.zeros(len(words), bool)
            first[borders[:-1]] = True
            cut.append((first, borders, *(words.filter(pa.array(m)).dictionary_encode() for m in (~first, first))))
            del split, words
        others, heads = (pa.chunked_array([c[k] for c in cut]).unify_dictionaries() for k in (2, 3))
        table, start, size = self._looked_up(others.chunk(0).dictionary, heads.chunk(0).dictionary)
        heads_at = len(others.chunk(0).dictionary)
        for k, (first, borders, *_) in enumerate(cut):
            index = np.empty(len(first), np.int32)
            index[~first], index[first] = others.chunk(k).indices, heads_at + np.asarray(heads.chunk(k).indices)
            ids, ends = gathered(table, start[index], size[index])
            yield ids, ends[borders[1:] - 1]

    def encoded(self, slices: list[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each slice the ids of all texts one after another, as unsigned 32-bit integers, and where each text ends; null counts as empty."""
        slices, specials = [pc.fill_null(texts.cast(pa.large_string()), "") for texts in slices], []
        for texts in slices:
            special = np.array(pc.match_substring_regex(texts, RUN))
            for a in self.added:
                special |= np.array(pc.match_substring(texts, a))
            specials.append(special)
        plain = self._plain([t if not s.any() else t.filter(pa.array(~s)) for t, s in zip(slices, specials)])
        for texts, special, (ids, ends) in zip(slices, specials, plain):
            yield self._with_special(texts, special, ids, ends) if special.any() else (ids, ends)

    def _with_special(self, texts: pa.Array, special: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plain, parts = iter(np.split(ids, ends)[:-1]), []
        for text, other in zip(texts.to_pylist(), special):
            if not other:
                parts.append(next(plain))
            elif any(a in text for a in self.added):
                parts.append(np.frombuffer(self.whole([text])[0], "<u4"))
            else:
                head, *words = CUT.split(text)
                distinct = [*{*words}]
                known = dict(zip(distinct, self._after_space(distinct)))
                parts.append(np.frombuffer(b"".join([*self._first([head]), *map(known.__getitem__, words)]), "<u4"))
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ((ids, ends),) = self.encoded([pa.array(list(texts), pa.string())])
        return [x.tobytes() for x in np.split(ids, ends)[:-1]]


def documents(encoder: WordEncoder, batches: Iterator[pa.RecordBatch], together: int = TOGETHER) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of (doc_id, text) batches with their texts' ids, each text's followed by the end id, and where each text ends.

    ``together``: bytes of text in a slice; fewer take less memory and somewhat more time.
    """
    for batch in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), np.int64))
        at, parts, held = 0, [], 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            stop = int(np.searchsorted(size, before + together, side="right"))
            part = batch.slice(at, max(1, stop - at))
            at += part.num_rows
            parts.append(part)
            held += size[at - 1] - before
            if held >= LOOKED_UP * encoder.share or at == batch.num_rows:
                for part, (ids, ends) in zip(parts, encoder.encoded([p.column(1) for p in parts])):
                    yield part, np.insert(ids, ends, END_OF_DOCUMENT), ends + np.arange(1, len(ends) + 1)
                parts, held = [], 0
    pa.default_memory_pool().release_unused()  # the words' arrays, several times the text


_encoders: dict[tuple[str, float], WordEncoder] = {}


def encoder(path: str, share: float = 1) -> WordEncoder:
    """One for each worker process, until a task of another operator, vocabulary file or share begins."""
    only("bpe", _encoders.clear)
    if (path, share) not in _encoders:
        _encoders.clear()
        _encoders[path, share] = WordEncoder(path, share)
    return _encoders[path, share]
