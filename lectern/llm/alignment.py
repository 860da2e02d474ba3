"""Operator 12: tokens of two tokenizers aligned by the bytes that they stand for.

A text is encoded, with a space before it, by a byte-level BPE file (A) and, with the space that it adds itself, by a
sentencepiece model (B). A task takes some megabytes of text at a time: in a pandas frame of token starts a side, keyed by
document (the key is document and byte as one number: a document begins at byte 0 on both sides, so no match leaves it),
``merge_asof`` finds for each token start the other side's covering token; both directions together are the overlaps, and
overlaps with equal ends cut a document into groups. The tokens of a group are linked with each other.

What the corpus says of a pair of ids (in how many documents it is linked, whether that is the most of its A id) is
counted over blocks: a block, the texts taken together, sends each pair once, with the number of its documents that have
it, and receives one row a pair back. Pairs are never sent for each document. A document keeps its pairs as steps in the
block's list of pairs (commonest first), in the variable-length coding of operator 10.

A group's pairs are counted over its different ids where it has many tokens, so a long group that repeats itself stays small.

Defined results: null and empty texts, and those whose tokens' bytes differ from the text (a text with U+2581, say), have no
tokens, zeros and an empty digest; a row is a document, so repeated rows count as often as they occur; doc_id may be null;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import stored, table
from .token_output import decode, encode

#: Bytes of text that are encoded together, and of those that are aligned together and whose pairs are sent together.
ENCODED_BYTES, BLOCK_BYTES = 3 << 20, 2 << 20
#: Words that a worker remembers with both sides' ids, twice at most.
REMEMBERED = 220_000
#: Texts whose words can't be encoded one by one: with white space beside white space (A), or with spaces beside spaces or at the end (B).
ODD = f"{bpe.RUN}|  | \\z|^ |^\\z|\u2581"
#: Pairs of tokens of a group beyond which its ids are counted before they are paired.
WIDE = 4096
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class ByteSide(bpe.WordEncoder):
    """Byte-level BPE; strings of special tokens are plain text."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.added = []
        # bytes alone are split and merged, so unless texts are normalised before, nothing is lost
        self.exact = self.tokenizer.normalizer is None
        # the pre-tokenizer's alphabet: printable bytes stand for themselves, the others follow from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)}.difference(own)))}
        self.entries = [b""] * self.size
        for token, i in self.tokenizer.get_vocab().items():
            self.entries[i] = bytes(map(shown.__getitem__, token)) if all(c in shown for c in token) else token.encode()

    def words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word after a space."""
        self._learn({*words})
        found, self.known = self.known, {}
        return found


class PieceSide:
    """sentencepiece. No piece has a space after another sign, so a word's pieces don't depend on the words around it.

    What is encoded is compared with its pieces; once it differs, ``exact`` ends and whole texts are compared.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model, self.exact = sentencepiece.SentencePieceProcessor(model_file=path), True
        self.size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(self.size)]
        if any("\u2581" in p.lstrip("\u2581") for p in pieces):
            raise ValueError("a vocabulary whose pieces have several words can't be encoded word by word")
        self.entries = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]

    def whole(self, texts: list[str]) -> list[bytes]:
        """The ids of texts (or words), each with the space that the model puts before it."""
        found, entries = self.model.encode(texts, num_threads=1), self.entries
        if self.exact:
            self.exact = all(b"".join(map(entries.__getitem__, ids)) == b" " + t.encode() for ids, t in zip(found, texts) if t)
        return [np.array(ids, "<u4").tobytes() for ids in found]


@dataclass
class Tokens:
    """The tokens of some texts: ids, the text that each belongs to, and its bytes' places among all texts' bytes."""

    ids: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    stop: np.ndarray


class Aligner:
    def __init__(self, vocabularies: tuple[str, str]) -> None:
        self.sides = ByteSide(vocabularies[0]), PieceSide(vocabularies[1])
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.before: dict[str, tuple[bytes, bytes]] = {}
        self.sizes = [np.array([*map(len, s.entries)], np.int64) for s in self.sides]
        # a token's number and the sign after it: within a side, and at a side's end
        self.written = [np.array([f"{i}{sign}".encode() for sign in (",", "|;"[k]) for i in range(s.size)], object) for k, s in enumerate(self.sides)]

    def _known(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        """Both sides' ids of distinct words, each after a space."""
        if len(self.known) > REMEMBERED:
            self.known, self.before = {}, self.known
        known = self.known
        new = [w for w in words if w not in known]
        again = {w: self.before[w] for w in new if w in self.before}
        known |= again
        new = [w for w in new if w not in again]
        a = self.sides[0].words(new)
        known.update({w: (a[w], b) for w, b in zip(new, self.sides[1].whole(new))})
        return [*map(known.__getitem__, words)]

    def _plain(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """Either side's ids, and each text's number of them, of texts whose white space is single."""
        cut = pc.split_pattern(texts, " ")
        words, borders = cut.flatten().dictionary_encode(), np.asarray(cut.offsets) - cut.offsets[0].as_py()
        index, out = np.asarray(words.indices), []
        for ids in (zip(*self._known(words.dictionary.to_pylist())) if len(index) else ((), ())):
            table, size = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            start = np.cumsum(size) - size
            many, begin = size[index], start[index]
            ends = np.cumsum(many)
            total = int(ends[-1]) if len(ends) else 0
            at = np.repeat(begin - (ends - many), many)
            at += np.arange(total)
            out.append((table[at], np.diff(np.r_[0, ends][borders])))
        return out

    def encoded(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """Either side's ids of all texts, and each text's number of them; texts without tokens have none on either side."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.array(pc.match_substring_regex(texts, ODD))
        found = self._plain(texts.filter(pa.array(~odd)))
        rest = texts.filter(pa.array(odd)).to_pylist()
        whole = self.sides[0].encode([f" {t}" if t else "" for t in rest]), self.sides[1].whole(rest)
        out = []
        for (ids, n), own in zip(found, whole):
            count = np.zeros(len(texts), np.int64)
            count[~odd], count[odd] = n, [len(x) // 4 for x in own]
            if len(own):
                parts, others = iter(np.split(ids, np.cumsum(n)[:-1])) if len(n) else iter(()), iter(own)
                ids = np.concatenate([np.frombuffer(next(others), "<u4") if o else next(parts) for o in odd])
            out.append((ids, count))
        if all(side.exact for side in self.sides):
            return out
        raw, good = [f" {t}".encode() for t in texts.to_pylist()], np.ones(len(texts), bool)
        for side, (ids, n) in zip(self.sides, out):
            entries = side.entries
            good &= [b"".join(map(entries.__getitem__, own.tolist())) == t for own, t in zip(np.split(ids, np.cumsum(n)[:-1]), raw)]
        return [(ids[np.repeat(good, n)], np.where(good, n, 0)) for ids, n in out]

    def tokens(self, encoded: list[tuple[np.ndarray, np.ndarray]], first: int, last: int) -> tuple[Tokens, Tokens]:
        """Both sides' tokens of the texts ``first`` to ``last``."""
        out = []
        for (ids, count), sizes in zip(encoded, self.sizes):
            begin = int(count[:first].sum())
            count = count[first:last]
            own = ids[begin : begin + int(count.sum())]
            stop = np.cumsum(sizes[own])
            out.append(Tokens(own, np.repeat(np.arange(last - first), count), stop - sizes[own], stop))
        return out[0], out[1]

    def parts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Tokens, Tokens]]:
        """Slices of (doc_id, text) batches with their tokens."""
        for batch in batches_of(batches, ENCODED_BYTES):
            encoded, at = self.encoded(batch.column(1)), 0
            for part in batches_of(iter([batch]), BLOCK_BYTES):
                yield part, *self.tokens(encoded, at, at + part.num_rows)
                at += part.num_rows


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(vocabularies: tuple[str, str]) -> Aligner:
    """One for each worker process and pair of files."""
    if vocabularies not in _aligners:
        _aligners[vocabularies] = Aligner(vocabularies)
    return _aligners[vocabularies]


def overlapping(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of places in ``a`` and ``b`` whose bytes overlap, each once."""

    def frame(side: Tokens, name: str) -> pd.DataFrame:
        return pd.DataFrame({"place": side.doc << 40 | side.start, name: np.arange(len(side.ids))}, copy=False)

    left, right = frame(a, "a"), frame(b, "b")
    covers, covered = pd.merge_asof(left, right, on="place"), pd.merge_asof(right, left, on="place")
    at, bt = covered["a"].to_numpy(), covered["b"].to_numpy()
    new = a.start[at] != b.start[bt]  # those with equal starts are in both
    return np.r_[covers["a"].to_numpy(), at[new]], np.r_[covers["b"].to_numpy(), bt[new]]


@dataclass
class Groups:
    """The group of each token of either side, and by group its text and its first token and number of tokens of either side."""

    of: tuple[np.ndarray, np.ndarray]
    doc: np.ndarray
    first: tuple[np.ndarray, np.ndarray]
    count: tuple[np.ndarray, np.ndarray]


def grouped(a: Tokens, b: Tokens) -> Groups:
    at, bt = overlapping(a, b)
    same = a.stop[at] == b.stop[bt]
    of, first, count = [], [], []
    for side, last in ((a, at[same]), (b, bt[same])):
        ends = np.zeros(len(side.ids), np.int64)
        ends[last] = 1
        of.append(np.cumsum(ends) - ends)
        count.append(np.bincount(of[-1], minlength=int(same.sum())))
        first.append(np.cumsum(count[-1]) - count[-1])
    return Groups((of[0], of[1]), a.doc[first[0]], (first[0], first[1]), (count[0], count[1]))


def links(a: Tokens, b: Tokens, groups: Groups) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair of ids, number of links) in no order; a text may have a pair in several rows. A pair is ``A id << 32 | B id``."""
    n_a, n_b = groups.count
    many = n_a * n_b > WIDE
    size = np.where(many, 0, n_a * n_b)
    group = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)
    left = a.ids[groups.first[0][group] + inside // n_b[group]].astype(np.int64)
    right = b.ids[groups.first[1][group] + inside % n_b[group]].astype(np.int64)
    docs, pairs, times = [groups.doc[group]], [left << 32 | right], [np.ones(len(group), np.int64)]
    for g in np.flatnonzero(many):
        own = [np.unique(s.ids[f[g] : f[g] + c[g]], return_counts=True) for s, f, c in zip((a, b), groups.first, groups.count)]
        pairs.append((own[0][0].astype(np.int64)[:, None] << 32 | own[1][0].astype(np.int64)).ravel())
        times.append((own[0][1][:, None] * own[1][1]).ravel())
        docs.append(np.full(len(pairs[-1]), groups.doc[g]))
    return np.concatenate(docs), np.concatenate(pairs), np.concatenate(times)


def written(shared: Aligner, a: Tokens, b: Tokens, groups: Groups, texts: int) -> list[str]:
    """The digest of each text's groups: ``a1,a2|b1;a3|b2,b3``."""
    pieces = np.empty(len(a.ids) + len(b.ids), object)
    before = np.cumsum(groups.count[1]) - groups.count[1]
    for k, (side, other) in enumerate(((a, before), (b, np.cumsum(groups.count[0])))):
        last = np.zeros(len(side.ids), np.int64)
        last[groups.first[k] + groups.count[k] - 1] = 1
        # a token stands after the tokens of its side and, of the other side, those of the groups before (of B also its own group's)
        pieces[np.arange(len(side.ids)) + other[groups.of[k]]] = shared.written[k][side.ids + last * shared.sides[k].size]
    borders = np.cumsum(np.bincount(a.doc, minlength=texts) + np.bincount(b.doc, minlength=texts))
    return [hashlib.sha256(b"".join(pieces[s:e])[:-1]).hexdigest() if e > s else "" for s, e in zip(np.r_[0, borders[:-1]], borders)]


def batches_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Slices of (doc_id, text) batches of about ``size`` bytes of text."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), np.int64))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def overlaps(docs: DataFrame, vocabularies: tuple[str, str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each overlap of two tokens: doc_id, a, b (tokens' places in the document), a_id, b_id, grp, start, stop (the bytes in common, the space before the text included)."""
    files = vocabularies or default_vocabularies()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = aligner(files)
        for part, a, b in shared.parts(batches):
            groups = grouped(a, b)
            at, bt = overlapping(a, b)
            order = np.lexsort((bt, at))
            at, bt, doc = at[order], bt[order], a.doc[at[order]]
            texts = part.num_rows
            head = [np.cumsum(np.bincount(x, minlength=texts)) - np.bincount(x, minlength=texts) for x in (a.doc, b.doc, groups.doc)]
            begin = np.zeros(texts, np.int64)
            begin[a.doc[::-1]] = a.start[::-1]
            columns = [at - head[0][doc], bt - head[1][doc], a.ids[at], b.ids[bt], groups.of[0][at] - head[2][doc], np.maximum(a.start[at], b.start[bt]) - begin[doc], np.minimum(a.stop[at], b.stop[bt]) - begin[doc]]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", "a", "b", "a_id", "b_id", "grp", "start", "stop"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, a long, b long, a_id long, b_id long, grp long, start long, stop long")


ALIGNED = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs long, control binary, data binary, times binary, pairs array<long>, held array<long>"


def aligned(docs: DataFrame, vocabularies: tuple[str, str]) -> DataFrame:
    """One row a document. The first of a block has the block's pairs, commonest first, and in how many of its documents each is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shared, block = aligner(vocabularies), TaskContext.get().partitionId() << 32
        for part, a, b in shared.parts(batches):
            texts = part.num_rows
            groups = grouped(a, b)
            doc, pair, times = links(a, b, groups)
            n_links = np.bincount(doc, times, minlength=texts).astype(np.int64)
            code, pairs = pd.factorize(pair)
            keys, place = np.unique(doc * max(len(pairs), 1) + code, return_inverse=True)
            times = np.bincount(place, times, minlength=len(keys)).astype(np.int64)
            doc, code = keys // max(len(pairs), 1), keys % max(len(pairs), 1)
            held = np.bincount(code, minlength=len(pairs))
            order = np.lexsort((pairs, -held))
            rank = np.empty(len(pairs), np.int64)
            rank[order] = np.arange(len(pairs))
            code = rank[code]
            order_in = np.lexsort((code, doc))
            code, times = code[order_in], times[order_in]
            ends = np.cumsum(np.bincount(doc, minlength=texts))
            streams = [(*encode(np.diff(code[s:e], prepend=0)), *encode(times[s:e])) for s, e in zip(np.r_[0, ends[:-1]], ends)]
            firsts = [np.arange(texts) == 0] * 2
            lists = [pa.array([x if f else None for f in firsts[0]], pa.list_(pa.int64())) for x in (pairs[order], held[order])]
            counts = [np.bincount(x, minlength=texts) for x in (a.doc, b.doc, groups.doc)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(texts, block)), part.column(0), *[pa.array(c, pa.int64()) for c in (*counts, n_links)], pa.array(written(shared, a, b, groups, texts), pa.string()),
                 pa.array(np.diff(ends, prepend=0), pa.int64()), pa.array([x[0] for x in streams], pa.binary()), pa.array([x[1] for x in streams], pa.binary()),
                 pa.array([x[2] + x[3] for x in streams], pa.binary()), *lists],
                ["block", "doc_id", *COUNTS, "groups_sha256", "n_pairs", "control", "data", "times", "pairs", "held"],
            )
            block += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ALIGNED)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents a pair is linked, and whether no pair of its A id is in more.

    Spark knows the size of the file that the pairs' lists lie in, not how many pairs are in them, and would broadcast
    tables of any size; so all joins of pairs are sorted ones.
    """
    counts = blocks.groupBy("pair").agg(F.sum("held").alias("n"))
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    return counts.join(most.hint("merge"), F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of ``docs``."""
    rows = stored(aligned(docs, vocabularies or default_vocabularies()), "alignment", compression="zstd")
    # each pair of a block once
    blocks = rows.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "x")).select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    scored = blocks.select("block", "place", "pair").join(pair_counts(blocks).hint("merge"), "pair").select(F.col("block").alias("own"), "place", "n", "best")

    def run(own: pa.Table, found: pa.Table) -> pa.Table:
        place = found.column("place").to_numpy()
        n, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
        n[place], best[place] = found.column("n").to_numpy(), found.column("best").to_numpy(zero_copy_only=False)
        sums = []
        for size, control, data, times in zip(*(own.column(c).to_pylist() for c in ("n_pairs", "control", "data", "times"))):
            at = np.cumsum(decode(control, data, size).astype(np.int64))
            cut = -(-size // 4)
            times = decode(times[:cut], times[cut:], size).astype(np.int64)
            sums.append((int(times[best[at]].sum()), int((times * n[at]).sum())))
        n_best, total = zip(*sums) if sums else ((), ())
        out = [own.column(c) for c in ("doc_id", *COUNTS)] + [pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), own.column("groups_sha256")]
        return pa.table(out, ["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"])

    documents = rows.drop("pairs", "held").groupBy("block")
    result = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return documents.cogroup(scored.groupBy("own")).applyInArrow(run, result)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"))
