"""Documents packed into full token windows beside their lexical neighbours, found by BM25 over shards."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from operator import attrgetter
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.scratch import kept
from framelake.llm.text import checked_columns, slices, text_or_empty
from framelake.llm.tokens import load_tokenizer

#: Tokens and documents of a shard, the part of the corpus that one inverted index covers.
SHARD_TOKENS, SHARD_DOCS = 1 << 19, 4096
#: Bytes of text encoded at once: the more, the fewer of their pieces are new.
ENCODED_BYTES = 6 << 20
#: Pieces of a generation whose tokens a worker remembers.
REMEMBERED = 300_000
#: Saturation of term counts and weight of the document's length.
K1, B = 1.2, 0.75

_BLANK = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
#: A blank beside another, or one of another kind: such texts are cut one by one.
ODD_BLANKS = rf"[ \n][ \n]|[\x00{_BLANK}]"
_AT_BLANK = re.compile(rf"(?<=[^ \n\0{_BLANK}])(?=[ \n])")


class Piece(NamedTuple):
    """A stretch of a document's tokens: the place of its first one, and how many the document has."""

    doc_id: Any
    start: int
    doc_tokens: int
    ids: np.ndarray


def pieces_of(text: str) -> list[str]:
    """The text cut before each blank or line feed that follows something else, where byte-level BPE never merges."""
    return _AT_BLANK.split(text)


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it can be seen, else the next free one from 256 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in seen]
    return {b: b for b in seen} | {b: 256 + i for i, b in enumerate(hidden)}


#: A blank and Latin letters: one word for the tokenizer, whatever stands around it.
ONE_WORD = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+").fullmatch


TOKEN_ID = attrgetter("id")


class Encoder:
    """Token ids of whole texts; pieces met before are not encoded again.

    Two generations of pieces are remembered: when the younger one is full it becomes the older one, and what is
    met again of that comes back. A worker process keeps its encoder for all its tasks.
    """

    def __init__(self, content: str, kind: type, remembered: int = REMEMBERED) -> None:
        self.tokenizer, self.kind, self.remembered = load_tokenizer(content), kind, remembered
        self.letters = byte_letters()
        self.blank = chr(self.letters[0x20])
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def __call__(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text. Texts whose blanks stand alone are cut, and their equal pieces found, by Arrow for all texts at once."""
        column = column.cast(pa.large_string())
        plain = pc.invert(pc.match_substring_regex(column, ODD_BLANKS)).to_numpy(zero_copy_only=False)
        found: list[np.ndarray] = [np.zeros(0, self.kind)] * len(column)
        rows = np.flatnonzero(plain)
        for row, ids in zip(rows.tolist(), self._of_plain(column.take(pa.array(rows)))):
            found[row] = ids
        for row in np.flatnonzero(~plain).tolist():
            cut = pieces_of(column[row].as_py())
            self._learn(set(cut))
            found[row] = np.frombuffer(b"".join(map(self.known.__getitem__, cut)), self.kind)
        if len(self.known) > self.remembered:
            self.older, self.known = self.known, {"": b""}
        return found

    def _of_plain(self, column: pa.Array) -> list[np.ndarray]:
        marked = pc.replace_substring(pc.replace_substring(column, " ", "\0 "), "\n", "\0\n")
        cut = pc.split_pattern(marked, "\0")
        coded = cut.flatten().dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        self._learn(set(pieces))
        blobs = [self.known[p] for p in pieces]
        width = np.dtype(self.kind).itemsize
        size = np.array([len(x) // width for x in blobs], np.int64)
        first = np.cumsum(size) - size
        code = coded.indices.to_numpy(zero_copy_only=False)
        many = size[code]
        end = np.cumsum(many)
        at = np.repeat(first[code] - (end - many), many) + np.arange(int(end[-1]) if len(end) else 0)
        ids = np.frombuffer(b"".join(blobs), self.kind)[at]
        edge = np.concatenate([np.zeros(1, np.int64), end])[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        return [ids[x:y] for x, y in zip(edge[:-1].tolist(), edge[1:].tolist())]

    def spelt(self, piece: str) -> str:
        """The piece in the letters of the vocabulary, as the tokenizer hands it to its merges."""
        if piece.isascii():
            return piece.replace(" ", self.blank)
        return piece.encode().decode("latin-1").translate(self.letters)

    def _learn(self, pieces: set[str]) -> None:
        known, older = self.known, self.older
        new = pieces.difference(known)
        again = new.intersection(older)
        known.update(zip(again, map(older.__getitem__, again)))
        new -= again
        # A mark behind a letter is encoded by itself, so the word before it may be known.
        stems = {p: p[:-1] for p in new if p[-1] in ".,;:!?" and p[-2:-1].isalpha()}
        if stems:
            self._learn(set(stems.values()).union(p[-1] for p in stems))
            new.difference_update(stems)
        code, merged = self.kind().dtype.char, self.tokenizer.model.tokenize
        fresh = []
        for piece in new:
            if (piece.isascii() and piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha())) or ONE_WORD(piece):
                known[piece] = array(code, map(TOKEN_ID, merged(self.spelt(piece)))).tobytes()
            else:
                fresh.append(piece)
        for piece, found in zip(fresh, self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)):
            known[piece] = array(code, found.ids).tobytes()
        for piece, stem in stems.items():
            known[piece] = known[stem] + known[piece[-1]]


_encoders: dict[str, Encoder] = {}


def encoder_of(content: str, kind: type) -> Encoder:
    if content not in _encoders:
        _encoders.clear()
        _encoders[content] = Encoder(content, kind)
    return _encoders[content]


class ShardIndex:
    """BM25 inverted index of one shard; terms that half of its documents hold score nothing."""

    def __init__(self, pieces: list[Piece], size: int) -> None:
        n = len(pieces)
        lengths = np.array([len(p.ids) for p in pieces], np.int64)
        # Four bytes where they suffice; they sort several times faster.
        whole = np.uint32 if n * size < 1 << 32 else np.int64
        owner = np.repeat(np.arange(n, dtype=whole) * whole(size), lengths)
        flat, count = np.unique(owner + np.concatenate([p.ids for p in pieces]), return_counts=True)
        doc, self.term = (x.astype(np.int64) for x in np.divmod(flat, whole(size)))
        df = np.bincount(self.term, minlength=size)
        idf = np.maximum(0.0, np.log((n - df + 0.5) / (df + 0.5)))
        long = K1 * (1 - B + B * lengths / max(lengths.mean(), 1.0))
        weight = idf[self.term] * count * (K1 + 1) / (count + long[doc])
        self.edge = np.searchsorted(doc, np.arange(n + 1))
        scoring = np.flatnonzero(weight > 0)
        by_term = scoring[np.argsort(self.term[scoring], kind="stable")]
        self.holder, self.weight = doc[by_term], weight[by_term]
        self.df = np.where(idf > 0, df, 0)
        self.first = np.cumsum(self.df) - self.df
        self.n = n

    def scores(self, query: int) -> np.ndarray:
        """Score of every document of the shard for the terms of one of them."""
        terms = self.term[self.edge[query] : self.edge[query + 1]]
        many = self.df[terms]
        at = np.repeat(self.first[terms] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return np.bincount(self.holder[at], self.weight[at], self.n)


def fill_windows(pieces: list[Piece], window: int, size: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows of a shard and what is left for the next one.

    A seed is the rest of the document cut last or else the next unused one. Its unused neighbours fill the window
    by falling score where they fit whole; the best one left is cut to close it. Seeds without neighbours are
    followed by the next unused document.
    """
    index = ShardIndex(pieces, size)
    lengths = np.array([len(p.ids) for p in pieces], np.int64)
    unused, done, following = np.ones(len(pieces), bool), [], 0
    current: list[Piece] = []
    room, rest = window, None
    while True:
        if rest is None:
            while following < len(pieces) and not unused[following]:
                following += 1
            if following == len(pieces):
                return done, current
            seed, piece = following, pieces[following]
            unused[seed] = False
        else:
            seed, piece = rest
        rest = None
        taken = min(room, len(piece.ids))
        current.append(piece._replace(ids=piece.ids[:taken]))
        room -= taken
        if taken < len(piece.ids):
            rest = seed, piece._replace(start=piece.start + taken, ids=piece.ids[taken:])
        elif room:
            score = np.where(unused, index.scores(seed), 0.0)
            ranked = np.flatnonzero(score > 0)
            ranked = ranked[np.argsort(-score[ranked], kind="stable")]
            for i in ranked[lengths[ranked] <= room].tolist():
                if lengths[i] <= room:
                    current.append(pieces[i])
                    unused[i] = False
                    room -= int(lengths[i])
            left = ranked[unused[ranked]]
            if room and len(left):
                i = int(left[0])
                unused[i] = False
                rest = i, pieces[i]
        if not room:
            done.append(current)
            current, room = [], window


def in_powers(pieces: list[Piece]) -> list[list[Piece]]:
    """Sequences whose lengths are falling powers of two, which need no padding."""
    left, out, waiting = sum(len(p.ids) for p in pieces), [], list(reversed(pieces))
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out.append([])
        while room:
            piece = waiting.pop()
            out[-1].append(piece._replace(ids=piece.ids[:room]))
            if len(piece.ids) > room:
                waiting.append(piece._replace(start=piece.start + room, ids=piece.ids[room:]))
            room -= len(out[-1][-1].ids)
    return out


def _lexical_keys(size: int, seeds: tuple[int, ...] = (11, 12)) -> list[np.ndarray]:
    """For each seed the place of each token in a random order in which later merges, the rarer tokens, come first."""
    out = []
    for seed in seeds:
        drawn = np.random.default_rng(seed).exponential(size=size) / np.arange(1, size + 1)
        place = np.empty(size, np.int32)
        place[np.argsort(drawn)] = np.arange(size, dtype=np.int32)
        out.append(place)
    return out


def encoded(docs: DataFrame, tokenizer_json: str, end_id: int) -> DataFrame:
    """doc_id, ids (binary), k1, k2 of each row: its tokens with the end token, and the keys that bring like texts together.

    A key is the first of the document's tokens in a weighted random order, so two documents share it with the
    probability of their weighted Jaccard similarity.
    """
    with open(tokenizer_json, encoding="utf-8") as source:
        content = source.read()
    size = max(load_tokenizer(content).get_vocab_size(), end_id + 1)
    kind = id_type(size)
    _check(Encoder(content, kind))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, places = encoder_of(content, kind), _lexical_keys(size)
        for part in slices(batches, most=ENCODED_BYTES):
            found = encoder(part.column("text"))
            whole = [np.append(f, kind(end_id)) for f in found]
            first = np.cumsum([0, *map(len, whole[:-1])])
            flat = np.concatenate(whole)
            keys = [pa.array(np.minimum.reduceat(p[flat], first), pa.int32()) for p in places]
            yield pa.record_batch([part.column("doc_id"), pa.array([w.tobytes() for w in whole], pa.binary()), *keys], names=["doc_id", "ids", "k1", "k2"])

    rows = checked_columns(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    name = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(encode, f"doc_id {name}, ids binary, k1 int, k2 int").withMetadata("ids", {"bytes": np.dtype(kind).itemsize, "size": size})


def id_type(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


def pack_documents(
    docs: DataFrame, tokenizer_json: str, *, window: int = 2048, end_id: int = 1, shard_tokens: int = SHARD_TOKENS, shard_docs: int = SHARD_DOCS
) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset and ids (binary, little-endian 32 bits) of each piece.

    Every row's tokens and `end_id` go into sequences of `window` tokens; each token lies in one piece. Rows are
    range-partitioned and sorted by lexical keys, then by a hash of the id, so hot keys are split. A task reads its
    rows in order and holds one shard at a time: an inverted index of up to `shard_tokens` tokens or `shard_docs`
    rows. Seeds take their unused neighbours by BM25 until the window is full, the last one is cut and its rest is the next
    seed. A document longer than a window fills windows of its own with all but its last tokens. What a shard leaves over goes
    to the next; what a task leaves over (under `window` tokens) becomes sequences whose lengths are powers of two.
    Null text is empty and has the end token only. Equal rows stay separate documents; ids may be null or repeated.
    An empty table gives an empty result; columns other than doc_id and text are not read.
    The tokenizer must be a byte-level BPE that never merges over a blank (checked on a probe).
    """
    described = encoded(docs, tokenizer_json, end_id)
    facts = described.schema["ids"].metadata
    kind, size = id_type(facts["size"]), facts["size"]
    # Written first: range partitioning reads its input twice, and the tokens shall not be made twice.
    tokens = kept(described, "packing-tokens").withColumn("h", F.xxhash64("doc_id"))
    order = ["k1", "k2", "h", "doc_id", "ids"]
    ordered = tokens.repartitionByRange(*order[:4]).sortWithinPartitions(*order)
    name = tokens.schema["doc_id"].dataType.simpleString()
    id_kind = tokens.select("doc_id").schema

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 40
        shard: list[Piece] = []
        held = 0
        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                ids = np.frombuffer(raw.as_buffer(), kind)
                whole = (len(ids) - 1) // window * window
                for a in range(0, whole, window * 64):
                    windows = [[Piece(doc_id, s, len(ids), ids[s : s + window])] for s in range(a, min(a + window * 64, whole), window)]
                    yield _rows(windows, serial, id_kind)
                    serial += len(windows)
                shard.append(Piece(doc_id, whole, len(ids), ids[whole:].copy()))
                held += len(ids) - whole
                if held >= shard_tokens or len(shard) >= shard_docs:
                    done, shard = fill_windows(shard, window, size)
                    yield _rows(done, serial, id_kind)
                    serial += len(done)
                    held = sum(len(p.ids) for p in shard)
        if shard:
            done, shard = fill_windows(shard, window, size)
            yield _rows([*done, *in_powers(shard)], serial, id_kind)

    return ordered.select("doc_id", "ids").mapInArrow(
        pack, f"doc_id {name}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )


def windows(pieces: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and the ids of each whole sequence, ready for a trainer."""
    held = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))).alias("parts")
    )
    return held.select("sequence_id", "n_tokens", F.unhex(F.array_join("parts.ids", "")).alias("ids"))


def _rows(sequences: list[list[Piece]], serial: int, id_kind) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    flat = [(serial + i, p) for i, s in enumerate(sequences) for p in s]
    offsets = [o for s in sequences for o in np.cumsum([0, *(len(p.ids) for p in s[:-1])]).tolist()] if flat else []
    longs = lambda values: pa.array(values, pa.int64())
    return pa.record_batch(
        [
            pa.array([p.doc_id for _, p in flat], to_arrow_schema(id_kind).field(0).type),
            longs([p.start for _, p in flat]),
            longs([len(p.ids) for _, p in flat]),
            longs([p.doc_tokens for _, p in flat]),
            longs([i for i, _ in flat]),
            longs(offsets),
            pa.array([p.ids.astype("<u4").tobytes() for _, p in flat], pa.binary()),
        ],
        names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
    )


def _check(encoder: Encoder) -> None:
    ids = lambda t: encoder.tokenizer.encode(t, add_special_tokens=False).ids
    probe = "It's  one\n\ntwo \n three,\nfour.\t five <|endoftext|> six  \u00e9t\u00e9 na\u00efve! word? "
    if ids(probe) != encoder(pa.array([probe]))[0].tolist() or ids("a b c") != ids("a") + ids(" b") + ids(" c"):
        raise ValueError("this is no byte-level tokenizer that merges inside words only; texts cannot be cut before blanks")
