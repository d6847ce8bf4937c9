"""Byte-level BPE encoding and decoding by merge replay.

The distinct pieces of a chunk of documents are laid out as one run of symbols. An inverted index leads from a mergeable
pair (by the rank of the token that it makes) to the positions where it stands. Ranks are replayed in order; each merge
touches the symbol and its two neighbours only, and new pairs enter the index. Pieces are remembered, within a bound, so
a piece that later chunks repeat isn't replayed again.

A piece's result depends on the piece alone, so a task replays over the chunks that it holds: nothing is shuffled, no
vocabulary of the corpus is gathered, and a lost task is repeated by itself.
"""

from __future__ import annotations

import base64
import heapq
import string
from collections.abc import Callable, Iterable
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from veilspan.llm.base import groups_by_size, map_batches, pick, resident

CHUNK_CHARS = 2_000_000
MOST_PAIRS = 1_000_000
REMEMBERED_CHUNKS = 800_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class MergeReplay:
    """Encodes pieces by replaying the merges of a rank table over all of them at once."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.bytes_to_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.byte_pairs = np.full((256, 256), -1, np.int64)
        self.byte_pair_ranks: dict[int, int] = {}  # pair of ids to the rank that it makes, or -1
        for token, rank in ranks.items():
            if len(token) == 2:
                self.byte_pairs[token[0], token[1]] = rank
                self.byte_pair_ranks[int(self.bytes_to_ids[token[0]]) << 32 | int(self.bytes_to_ids[token[1]])] = rank
        self.pair_ranks = dict(self.byte_pair_ranks)

    def pair_rank(self, left: int, right: int) -> int:
        rank = self.pair_ranks[left << 32 | right] = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
        return rank

    def replay(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece (none of them empty), as little-endian unsigned 32-bit integers."""
        laid = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(piece) for piece in pieces])
        n = len(laid)
        last = np.zeros(n, bool)
        last[ends - 1] = True
        follows = np.arange(1, n + 1)
        follows[last] = -1
        before = np.arange(-1, n - 1)
        before[ends[:-1]] = -1
        piece_of = np.repeat(np.arange(len(pieces)), np.diff(ends, prepend=0)).tolist()
        symbols, follows, before = self.bytes_to_ids[laid].tolist(), follows.tolist(), before.tolist()

        first = np.full(n, -1, np.int64)
        first[:-1] = self.byte_pairs[laid[:-1], laid[1:]]
        first[last] = -1
        at = np.flatnonzero(first >= 0)
        at = at[np.argsort(first[at], kind="stable")]
        made, starts = np.unique(first[at], return_index=True)
        index = {int(rank): run.tolist() for rank, run in zip(made, np.split(at, starts[1:]), strict=True)} if len(at) else {}
        heap = list(index)
        heapq.heapify(heap)
        if len(self.pair_ranks) > MOST_PAIRS:
            self.pair_ranks = dict(self.byte_pair_ranks)
        known, pair_rank = self.pair_ranks.get, self.pair_rank
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            rank = pop(heap)
            positions = index.pop(rank)
            positions.sort()
            held = -1  # a piece where a merge made a pair that comes first; its further positions wait
            for i in positions:
                left = symbols[i]
                j = follows[i]
                if left < 0 or j < 0 or known(left << 32 | symbols[j]) != rank:
                    continue
                if piece_of[i] == held:
                    if rank in index:
                        index[rank].append(i)
                    else:
                        index[rank] = [i]
                        push(heap, rank)
                    continue
                symbols[i], symbols[j] = rank, -1
                after = follows[i] = follows[j]
                if after >= 0:
                    before[after] = i
                    right = symbols[after]
                    new = known(rank << 32 | right)
                    if new is None:
                        new = pair_rank(rank, right)
                    if new >= 0:
                        if new in index:
                            index[new].append(i)
                        else:
                            index[new] = [i]
                            push(heap, new)
                        if new <= rank:
                            held = piece_of[i]
                p = before[i]
                if p >= 0:
                    left = symbols[p]
                    new = known(left << 32 | rank)
                    if new is None:
                        new = pair_rank(left, rank)
                    if new >= 0:
                        if new in index:
                            index[new].append(p)
                        else:
                            index[new] = [p]
                            push(heap, new)
                        if new <= rank:
                            held = piece_of[i]
        final = np.array(symbols, np.int64)
        left = final >= 0
        raw = final[left].astype("<u4").tobytes()
        at = (4 * np.cumsum(left)[ends - 1]).tolist()
        return [raw[a:b] for a, b in zip([0, *at[:-1]], at, strict=True)]


class ChunkStore(dict):
    """Numbers of chunks, and by number their ids as little-endian unsigned 32-bit integers.

    A chunk is what stands between single spaces, with the space before it; a text's first chunk has none. A pattern that lets a space begin a
    piece, and none hold one further on, cuts a chunk alike wherever it stands, unless white space stands on both sides of its space: such a
    chunk is marked, and its text is encoded whole. A new chunk gets the next number at once; ``fresh`` holds those to learn.
    """

    FIRST = "\0"
    MARKED = ""  # not bytes, so a join that meets it fails

    def __init__(self, learn: Callable[[list[str]], list[bytes]], whole: Callable[[str], bytes], most: int) -> None:
        super().__init__()
        self.learn, self.whole, self.most = learn, whole, most
        self.ids: list[bytes | str] = []
        self.fresh: list[str] = []
        self.parted: bool | None = None  # whether signs behind letters are a piece of their own

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self.ids)
        self.ids.append(b"")
        self.fresh.append(chunk)
        return number

    def shorten(self) -> None:
        """Forgets half of the chunks where there are too many: those that came last, as chunks that come often come early."""
        if len(self.ids) > self.most:
            kept = list(islice(self.items(), self.most // 2))
            self.clear()
            self.update(kept)
            del self.ids[len(kept) :]

    def _learn_fresh(self) -> None:
        """Letters with signs behind them are two pieces, so only those of the letters and of the signs are asked for."""
        if self.parted is None:
            self.parted = all(self.learn([" ab" + tail]) == [self.learn([" ab"])[0] + self.learn([tail])[0]] for tail in (".", ",", "...", '."', "***", "'", "_)"))
        fresh, self.fresh = self.fresh, []
        asked, parted, ids = [], [], self.ids
        for chunk in fresh:
            if chunk[:1] == self.FIRST:
                asked.append(chunk)
            elif not chunk or chunk[0].isspace():
                ids[self[chunk]] = self.MARKED
            else:
                stem = chunk.rstrip(string.punctuation)
                if self.parted and len(stem) < len(chunk) and stem.isalpha():
                    parted.append((self[chunk], self[stem], self[self.FIRST + chunk[len(stem) :]]))
                else:
                    asked.append(chunk)
        asked += self.fresh  # stems and signs that weren't known
        self.fresh = []
        for chunk, found in zip(asked, self.learn([chunk[1:] if chunk[:1] == self.FIRST else " " + chunk for chunk in asked]), strict=True):
            ids[self[chunk]] = found
        for number, stem, tail in parted:
            ids[number] = ids[stem] + ids[tail]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        self.shorten()
        number = self.__getitem__
        cut: list[list[int] | None] = []
        for text in texts:
            if not text:
                cut.append([])
            elif self.FIRST in text:
                cut.append(None)
            else:
                parts = text.split(" ")
                parts[0] = self.FIRST + parts[0]
                cut.append(list(map(number, parts)))
        if self.fresh:
            self._learn_fresh()
        return [self._joined(text, numbers) for text, numbers in zip(texts, cut, strict=True)]

    def _joined(self, text: str | None, numbers: list[int] | None) -> bytes:
        if numbers is None:
            return self.whole(text)
        try:
            return b"".join(map(self.ids.__getitem__, numbers))
        except TypeError:
            return self.whole(text)


class Codec:
    """Text to ids and ids to bytes, by a rank file and the pattern that cuts text into pieces."""

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED_CHUNKS) -> None:
        self.model = MergeReplay(read_ranks(path))
        # White space is Unicode's property here, as in the rank file's own library.
        self.pieces = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.store = ChunkStore(self._learn, lambda text: self._learn([text])[0], remembered)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        return self.store.encode(texts)

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks: their distinct pieces are replayed together, as one corpus."""
        cut = [self.pieces.findall(chunk) for chunk in chunks]
        known: dict[str, bytes] = {}
        rest = []
        for piece in {piece for pieces in cut for piece in pieces}:
            rank = self.model.ranks.get(piece.encode())
            if rank is None:
                rest.append(piece)
            else:
                known[piece] = rank.to_bytes(4, "little")
        if rest:
            known.update(zip(rest, self.model.replay([piece.encode() for piece in rest]), strict=True))
        return [b"".join(map(known.__getitem__, pieces)) for pieces in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.model.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(path: str, pattern: str) -> Codec:
    return resident(("codec", path, pattern), lambda: Codec(path, pattern))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): each whole text's ids as little-endian unsigned 32-bit integers, and the bytes that they decode to.

    ``path`` and ``pattern`` name the vocabulary. A null or empty text gives no ids and no bytes. Repeated rows each give
    a row, null ids stay null, an empty table gives no rows, and further columns are ignored, whatever their names. A text
    is never cut: memory follows the longest text and ``CHUNK_CHARS``.
    """
    chosen = pick(docs, doc_id=id_col, text=text_col)

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        own = codec(path, pattern)
        sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(1).cast(pa.binary())]
        for start, end in groups_by_size(sizes, CHUNK_CHARS):
            part = batch.slice(start, end - start)
            ids = own.encode(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(ids, pa.binary()), pa.array([own.decode(x) for x in ids], pa.binary())],
                names=["doc_id", "ids", "decoded"],
            )

    return map_batches(chosen, run, f"doc_id {dict(chosen.dtypes)['doc_id']}, ids binary, decoded binary")


def decode_ids(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded): the bytes of ids in the form that ``round_trip`` returns; null ids give no bytes."""
    chosen = pick(encoded, doc_id=id_col, ids=ids_col)

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        own = codec(path, pattern)
        decoded = [own.decode(x or b"") for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.binary())], names=["doc_id", "decoded"])

    return map_batches(chosen, run, f"doc_id {dict(chosen.dtypes)['doc_id']}, decoded binary")
