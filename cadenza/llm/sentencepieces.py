"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

No piece of the vocabulary has a space behind another character, so a text falls into segments (spaces, then other
characters) that merge independently. The distinct segments of a slice are held as one flat array of symbols. A round
finds the smallest pair rank of every segment and merges it at its leftmost place, in all segments at once, then compacts
the array; rounds go on until no pair is left. Decoding maps ids back to bytes by one gather.

The vocabulary is read on the driver and sent to the tasks as tables; its size is fixed. Results equal the library's
(no normalisation, leading space added, byte fallback).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import bytesets as B

SPACE = "▁"
END = 2
SLICE = 4 << 20
#: Segments of more symbols merge from a heap instead of in rounds, one round each being a pass over the segment.
LONG = 256


def gather(table: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table's entries of `which`, end to end, and the bounds of each in the result."""
    own = lengths[which]
    bounds = np.concatenate(([0], np.cumsum(own)))
    return table[np.repeat(starts[which] - bounds[:-1], own) + np.arange(bounds[-1])], bounds


def _flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(x) for x in parts], dtype=np.int64)
    return np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths


class Vocabulary:
    """Tables of a BPE piece model: characters, mergeable pairs with their rank, bytes and decimal names of ids."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if any(a != SPACE and b == SPACE for i in plain for a, b in zip(names[i], names[i][1:])):
            raise ValueError("a piece runs over a space")
        score = {names[i]: model.get_score(i) for i in plain}
        order = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        symbol = {names[i]: i for i in plain}
        for name in [*symbol]:
            for c in name:
                symbol.setdefault(c, len(symbol) + n)
        self.span = n + len(symbol) + 1
        pairs: dict[int, tuple[int, int]] = {}
        for name in score:
            for cut in range(1, len(name)):
                a, b = symbol.get(name[:cut]), symbol.get(name[cut:])
                if a is not None and b is not None:
                    pairs[a * self.span + b] = (order[score[name]], symbol[name])
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], dtype=np.int32)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], dtype=np.int32)
        # Symbols that are a character but no piece, and characters not in the table, come out as bytes.
        self.n = n
        self.chars = {ord(c): i for c, i in symbol.items() if len(c) == 1}
        top = max(self.chars) + 1
        self.of_char = np.full(top, -1, dtype=np.int32)
        for c, i in self.chars.items():
            self.of_char[c] = i
        self.byte_ids = np.zeros(256, dtype=np.int32)
        out = []
        for i in range(n):
            if model.is_byte(i):
                value = int(names[i][3:5], 16)
                self.byte_ids[value] = i
                out.append(bytes([value]))
            elif model.is_control(i):
                out.append(b"")
            elif model.is_unknown(i):
                out.append(" ⁇ ".encode())
            else:
                out.append(names[i].replace(SPACE, " ").encode())
        self.bytes_of = _flat(out)
        self.names_of = _flat([f"{i} ".encode() for i in range(n)])

    def merge(self, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge every segment to its end; returns the symbols left and their bounds."""
        owner = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        last = len(self.keys) - 1
        none = np.iinfo(np.int32).max
        rank = merged = None
        while len(symbols):
            if rank is None:
                rank, merged = self._ranks(symbols, owner, none, last)
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            best = np.minimum.reduceat(rank, first)
            per = np.diff(np.concatenate((first, [len(owner)])))
            alive = best != none
            if not alive.all():
                stop = np.repeat(~alive, per)
                done.append((owner[stop], symbols[stop]))
                go = ~stop
                owner, symbols, rank, merged = owner[go], symbols[go], rank[go], merged[go]
                if not len(owner):
                    break
                best, per = best[alive], per[alive]
                first = np.cumsum(per) - per
            at_best = np.flatnonzero(rank == np.repeat(best, per))
            own = owner[at_best]
            left = at_best[np.concatenate(([True], own[1:] != own[:-1]))]
            symbols[left] = merged[left]
            keep = np.ones(len(symbols), dtype=bool)
            keep[left + 1] = False
            moved = np.cumsum(keep) - 1
            symbols, owner, rank, merged = symbols[keep], owner[keep], rank[keep], merged[keep]
            touched = moved[left]
            touched = np.concatenate((touched, touched[touched > 0] - 1))
            rank[touched], merged[touched] = self._ranks_at(symbols, owner, touched, none, last)
        if not done:
            return symbols, bounds
        owners = np.concatenate([x for x, _ in done])
        by = np.argsort(owners, kind="stable")
        return np.concatenate([x for _, x in done])[by], np.searchsorted(owners[by], np.arange(len(bounds)))

    def _ranks(self, symbols, owner, none, last):
        return self._ranks_at(symbols, owner, np.arange(len(symbols)), none, last)

    def _ranks_at(self, symbols, owner, at, none, last):
        after = np.minimum(at + 1, len(symbols) - 1)
        a, b = symbols[at].astype(np.int64), symbols[after].astype(np.int64)
        key = a * self.span + b
        place = np.minimum(np.searchsorted(self.keys, key), last)
        ok = (self.keys[place] == key) & (owner[at] == owner[after]) & (after > at) & (a >= 0) & (b >= 0)
        return np.where(ok, self.ranks[place], none).astype(np.int32), np.where(ok, self.merged[place], -1).astype(np.int32)

    def merge_long(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One long segment, from a heap of (rank, place); returns symbols and the place where each starts."""
        import heapq

        pair = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist())))
        own, n = symbols.tolist(), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def add(i):
            j = after[i]
            if j < n and own[i] >= 0 and own[j] >= 0 and (found := pair.get(own[i] * self.span + own[j])):
                heapq.heappush(heap, (found[0], i, own[i], own[j]))

        for i in range(n - 1):
            add(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if own[i] == a else n
            if j >= n or own[j] != b:
                continue
            own[i], own[j] = pair[a * self.span + b][1], -2
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            add(i)
            if before[i] >= 0:
                add(before[i])
        places = np.array([i for i in range(n) if own[i] != -2], dtype=np.int64)
        return np.array([own[i] for i in places], dtype=np.int32), places

    def encode(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each segment end to end, and bounds. Segments are UTF-8 with spaces as spaces."""
        if not segments:
            return np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
        points = np.frombuffer(b"".join(segments).decode().encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        points = np.where(points == 32, 0x2581, points)
        sizes = np.array([len(x.decode()) for x in segments], dtype=np.int64)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        # Symbols start as the character's symbol, or below zero for a character that no piece holds.
        known = np.where(points < len(self.of_char), self.of_char[np.minimum(points, len(self.of_char) - 1)], -1)
        symbols = np.where(known >= 0, known, -3 - points).astype(np.int32)
        long = np.flatnonzero(sizes > LONG)
        short = sizes <= LONG
        mask = np.repeat(short, sizes)
        out, out_bounds = self.merge(symbols[mask], np.concatenate(([0], np.cumsum(sizes[short]))))
        if len(long):
            parts = iter(np.split(out, out_bounds[1:-1]) if short.any() else [])
            parts = [self.merge_long(symbols[bounds[i]: bounds[i + 1]])[0] if sizes[i] > LONG else next(parts) for i in range(len(sizes))]
            out, out_bounds = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        loose = (out >= self.n) | (out < 0)
        if not loose.any():
            return out, out_bounds
        back = {i: c for c, i in self.chars.items()}
        counts = np.ones(len(out), dtype=np.int64)
        spelled = {i: chr(back[s] if s >= 0 else -3 - s).encode() for i, s in zip(np.flatnonzero(loose).tolist(), out[loose].tolist())}
        for i, x in spelled.items():
            counts[i] = len(x)
        starts = np.concatenate(([0], np.cumsum(counts)))
        ids = np.repeat(out, counts)
        for i, x in spelled.items():
            ids[starts[i]: starts[i + 1]] = self.byte_ids[list(x)]
        return ids, starts[out_bounds]


def segments_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the segments of texts that each begin with the added space; a text of that space alone has none."""
    space = data == 32
    if len(data) > 2:
        sign = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))  # the space sign itself merges like a space
        space[(sign[:, None] + np.arange(3)).ravel()] = True
    start = space.copy()
    start[1:] &= ~space[:-1]
    start[offsets[:-1]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(data))
    empty = offsets[:-1][np.diff(offsets) == 1]
    if len(empty):
        keep = ~np.isin(starts, empty)
        starts, ends = starts[keep], ends[keep]
    return starts, ends


def encode_slice(vocab: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a slice end to end, without end ids, and bounds by text."""
    starts, ends = segments_of(data, offsets)
    if not len(starts):
        return np.zeros(0, dtype=np.int32), np.zeros(len(offsets), dtype=np.int64)
    _, first, which = np.unique(B.word_hashes(data, starts, ends, fold=False), return_index=True, return_inverse=True)
    raw = data.tobytes()
    ids, bounds = vocab.encode([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())])
    flat, seg_bounds = gather(ids, bounds[:-1], np.diff(bounds), which)
    return flat, seg_bounds[np.searchsorted(starts, offsets)]


def decode_slice(vocab: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """UTF-8 of each id sequence: pieces end to end, the added space taken off, bytes that are no UTF-8 replaced."""
    text, at = gather(*vocab.bytes_of, ids)
    cuts = at[bounds].tolist()
    raw = text.tobytes()
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        own = raw[a:b]
        own = own[1:] if own[:1] == b" " else own
        try:
            own.decode()
        except UnicodeDecodeError:
            own = own.decode("utf-8", "replace").encode()
        out.append(own)
    return out


def _encoded(vocab_, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocab_.value
        for batch in batches:
            for i, j, data, offsets in B.slices(batch["t"], SLICE):
                ids, bounds = encode_slice(vocab, data, offsets)
                key = batch["doc_id"].slice(i, j - i)
                if keep_ids:
                    full = np.insert(ids, bounds[1:], END)
                    lists = pa.ListArray.from_arrays(pa.array((bounds + np.arange(len(bounds))).astype(np.int32)), pa.array(full))
                    yield pa.RecordBatch.from_arrays([key, lists], names=["doc_id", "ids"])
                    continue
                digits, at = gather(*vocab.names_of, ids)
                cuts, raw = at[bounds].tolist(), digits.tobytes()
                named = [hashlib.sha256(raw[a:b] + b"%d" % END).hexdigest() for a, b in zip(cuts[:-1], cuts[1:])]
                text = [hashlib.sha256(x).hexdigest() for x in decode_slice(vocab, ids, bounds)]
                yield pa.RecordBatch.from_arrays(
                    [key, pa.array(np.diff(bounds) + 1), pa.array(named), pa.array(text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def _open(docs: DataFrame, path: str, doc_id: str, text: str):
    vocab = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    return vocab, docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.concat(F.lit(" "), F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("t"))


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of each whole text and an end id, one row per row of `docs`.

    A null or empty text gives the end id alone. Repeated rows and null ids are encoded like any other. An empty table
    gives an empty result. Other columns are ignored, whatever their names.
    """
    vocab, texts = _open(docs, path, doc_id, text)
    return texts.mapInArrow(_encoded(vocab, True), "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids), as the library decodes; null ids count as none."""
    vocab = rows.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["ids"]
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            text = decode_slice(vocab.value, ids, np.concatenate(([0], np.cumsum(sizes))))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([x.decode() for x in text], pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded and decoded again in one pass, only digests kept."""
    vocab, texts = _open(docs, path, doc_id, text)
    return texts.mapInArrow(_encoded(vocab, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
