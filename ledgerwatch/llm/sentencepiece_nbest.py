"""SentencePiece encoding into the n best segmentations, and decoding.

The piece lattice of a text falls apart wherever no piece crosses: before a space mark that follows another
character, and around line ends if no piece holds one. The distinct parts of a batch are segmented once, with forward
and backward Viterbi scores of all their places in arrays; they give the best segmentation and what the second
best loses. A segmentation of a whole text among the n best departs from the best one only in the n - 1 parts whose
second choice loses least. For those parts, the forward scores are exact heuristics of a backward A* search over
the lattice, which yields their n best in order; a best-first search combines them to the n best of the text.

Scores are the model's piece scores. A character that is no piece becomes its byte pieces (or the unknown piece)
at ten below the lowest score in use. Ties go to the longer last piece, then to the earlier part.

Defined results: a null text is encoded like an empty one, into no pieces. Order and repetition of rows don't matter.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .tables import free_name
from .text import buffer_of, ragged, slices, sums_by, whole

MARK = "▁"
UNUSED = -1e8  # scores below are those of pieces kept out of the lattice's floor
REMEMBERED = 300_000  # parts that a task keeps between batches


class Model:
    """Pieces of a SentencePiece model, read from its file."""

    def __init__(self, path: str):
        import sentencepiece

        file = sentencepiece.SentencePieceProcessor(model_file=path)
        n = file.get_piece_size()
        self.pieces = [file.id_to_piece(i) for i in range(n)]
        special = [file.is_control(i) or file.is_unknown(i) or file.is_byte(i) or file.is_unused(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.scores = [file.get_score(i) for i in range(n)]
        self.floor = min(s for i, s in enumerate(self.scores) if not special[i] and s > UNUSED) - 10
        self.longest = max(map(len, self.ids))
        self.bytes = [i for i in range(n) if file.is_byte(i)]
        self.unknown = file.unk_id()
        self.loose_lines = not any("\n" in p for p in self.ids)
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a space mark after another character")
        # Bytes that a piece stands for; space marks are spaces.
        plain = [b"" if file.is_control(i) else " ⁇ ".encode() if file.is_unknown(i) else bytes([int(p[1:-1], 16)]) if file.is_byte(i)
                 else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.size = np.array([len(b) for b in plain], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.plain = np.frombuffer(b"".join(plain), np.uint8)
        self.score_array = np.array(self.scores)
        tree, pieces = {}, [-1]
        for p, i in self.ids.items():
            node = 0
            for c in p:
                key = node << 21 | ord(c)
                if key not in tree:
                    tree[key] = len(pieces)
                    pieces.append(-1)
                node = tree[key]
            pieces[node] = i
        self.tree_keys = np.array(sorted(tree), np.int64)
        self.tree_nodes = np.array([tree[k] for k in sorted(tree)], np.int64)
        self.tree_pieces = np.array(pieces, np.int64)
        self.forget()

    def segmentations(self, part: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best (score, ids) of a text in which spaces are marks, best first."""
        size, ids, scores, longest = len(part), self.ids, self.scores, self.longest
        best = [0.0] + [0.0] * size
        ending: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(size + 1)]
        for end in range(1, size + 1):
            top, edges = None, ending[end]
            for begin in range(max(0, end - longest), end):
                piece = ids.get(part[begin:end])
                if piece is not None:
                    edges.append((begin, scores[piece], (piece,)))
            if not edges or edges[-1][0] != end - 1:
                char = part[end - 1].encode()
                edges.append((end - 1, self.floor, tuple(self.bytes[b] for b in char) if self.bytes else (self.unknown,)))
            for begin, score, _ in edges:
                value = best[begin] + score
                if top is None or value > top:
                    top = value
            best[end] = top
        found = []
        heap = [(-best[size], size, 0, 0.0, None)]
        count = 0
        while heap and len(found) < n:
            _, at, _, score, path = heapq.heappop(heap)
            if at == 0:
                out = []
                while path is not None:
                    out.extend(path[0])
                    path = path[1]
                found.append((score, out))
                continue
            for begin, gain, piece in ending[at]:
                count += 1
                total = score + gain
                heapq.heappush(heap, (-(best[begin] + total), begin, count, total, (piece, path)))
        return found

    def alternatives(self, text: str, n: int) -> tuple[list[float], list[np.ndarray]]:
        """What each further one of a part's n best segmentations loses, and its ids."""
        key = (text, n)
        if key not in self.further:
            if len(self.further) >= REMEMBERED:
                self.further.clear()
            (score, _), *rest = self.segmentations(text.replace(" ", MARK), n)
            self.further[key] = [score - s for s, _ in rest], [np.array(x, np.int32) for _, x in rest]
        return self.further[key]

    def edges(self, chars: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All lattice edges of some parts, (begin, end, piece), by walking the tree of pieces from every character.
        Piece -1 is a character that is no piece. Places count through all parts, with one more place behind each."""
        n = np.diff(first)
        char = np.zeros(len(chars) + len(n), np.int64)
        place = np.arange(len(chars)) + np.repeat(np.arange(len(n)), n)
        char[place] = chars
        begin, node, at = place, np.zeros(len(chars), np.int64), place
        out = []
        single = np.zeros(len(char), bool)
        while len(begin):
            key = node << 21 | char[at]
            found = np.minimum(np.searchsorted(self.tree_keys, key), len(self.tree_keys) - 1)
            hit = (self.tree_keys[found] == key) & (char[at] > 0)
            begin, at, node = begin[hit], at[hit] + 1, self.tree_nodes[found[hit]]
            piece = self.tree_pieces[node]
            some = piece >= 0
            out.append((begin[some], at[some], piece[some]))
            if len(out) == 1:
                single[begin[some]] = True
        alone = place[~single[place]]
        out.append((alone, alone + 1, np.full(len(alone), -1, np.int64)))
        return tuple(np.concatenate([o[k] for o in out]) for k in range(3))

    def learn(self, parts: list[str]) -> None:
        """Best segmentation, score and loss of the second best of new parts: forward and backward Viterbi scores
        of all of them at once, place by place."""
        chars = np.frombuffer("".join(parts).replace(" ", MARK).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        first = np.concatenate([[0], np.cumsum(size)])
        begin, end, piece = self.edges(chars, first)
        score = np.where(piece >= 0, self.score_array[piece], self.floor)
        home = np.repeat(first[:-1] + np.arange(len(parts)), size + 1)  # each place's first place in its part
        places = len(chars) + len(parts)
        forward, backward = np.full(places, -np.inf), np.full(places, -np.inf)
        start, stop = first[:-1] + np.arange(len(parts)), first[1:] + np.arange(len(parts))
        forward[start], backward[stop] = 0.0, 0.0
        order = np.lexsort((begin, end, end - home[end]))  # step by step; within a place the longest piece first
        begin, end, piece, score = begin[order], end[order], piece[order], score[order]
        step = end - home[end]
        cuts = np.searchsorted(step, np.arange(1, int(step[-1]) + 2)) if len(step) else np.zeros(1, np.int64)
        chosen = np.zeros(places, np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            value = forward[begin[a:b]] + score[a:b]
            own = end[a:b]
            heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            top = np.maximum.reduceat(value, heads)
            forward[own[heads]] = top
            best = np.flatnonzero(value == np.repeat(top, np.diff(np.append(heads, len(own)))))
            ties = np.append(True, own[best[1:]] != own[best[:-1]])
            chosen[own[best[ties]]] = a + best[ties]
        back = np.lexsort((begin, -(begin - home[begin])))
        depth = (begin - home[begin])[back]
        ends = np.flatnonzero(np.append(np.diff(depth) != 0, True)) + 1 if len(back) else np.zeros(0, np.int64)
        for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()):
            e = back[a:b]
            np.maximum.at(backward, begin[e], score[e] + backward[end[e]])
        on_path = np.zeros(len(begin), bool)
        at, steps = stop[size > 0], []
        while len(at):
            e = chosen[at]
            on_path[e] = True
            steps.append(e)
            at = begin[e]
            at = at[at != home[at]]
        part_of = np.repeat(np.arange(len(parts)), size + 1)
        detour = np.where(on_path, -np.inf, forward[begin] + score + backward[end])
        second = np.full(len(parts), -np.inf)
        np.maximum.at(second, part_of[begin], detour)
        path = np.concatenate(steps) if steps else np.zeros(0, np.int64)
        path = path[np.argsort(begin[path], kind="stable")]
        ids = piece[path]
        count = np.ones(len(path), np.int64)
        lost = np.flatnonzero(ids < 0)
        spelled = {}
        for i in lost.tolist():  # characters that are no piece
            c = begin[path[i]]
            char = chr(chars[c - part_of[c]]).encode()
            spelled[i] = [self.bytes[b] for b in char] if self.bytes else [self.unknown]
            count[i] = len(spelled[i])
        where = np.cumsum(count) - count
        out = np.repeat(ids, count)
        for i, values in spelled.items():
            out[where[i] : where[i] + len(values)] = values
        length = np.bincount(part_of[begin[path]], weights=count, minlength=len(parts)).astype(np.int64)
        base, old = len(self.lengths), len(self.flat)
        self.known.update(zip(parts, range(base, base + len(parts))))
        self.flat = np.concatenate([self.flat, out.astype(np.int32)])
        self.begins = np.concatenate([self.begins, old + np.cumsum(length) - length])
        self.lengths = np.concatenate([self.lengths, length])
        self.totals = np.concatenate([self.totals, forward[stop]])
        self.losses = np.concatenate([self.losses, forward[stop] - second])

    def numbers(self, parts: list[str]) -> np.ndarray:
        """Places of parts in the arrays of what is known; learns the new ones."""
        new = [p for p in parts if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.forget()
            new = parts
        if new:
            self.learn(new)
        return np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.begins, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.totals, self.losses = np.zeros(0), np.zeros(0)
        self.further: dict[tuple[str, int], tuple[list[float], list[np.ndarray]]] = {}


@lru_cache(maxsize=4)
def model(path: str) -> Model:
    return Model(path)


def best_sums(places: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n smallest (loss, choices) over choices of one entry from each place; entry 0 loses nothing."""
    options = [[0.0, *losses] for losses in places]
    start = (0,) * len(options)
    heap, seen, out = [(0.0, start)], {start}, []
    while heap and len(out) < n:
        out.append(heapq.heappop(heap))
        chosen = out[-1][1]
        for i, c in enumerate(chosen):
            later = chosen[:i] + (c + 1,) + chosen[i + 1 :]
            if c + 1 < len(options[i]) and later not in seen:
                seen.add(later)
                heapq.heappush(heap, (sum(o[k] for o, k in zip(options, later)), later))
    return out


def spliced(ids: np.ndarray, changes: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """``ids`` with ids[a:b] replaced, for each of the changes (a, b, by) in order."""
    out, at = [], 0
    for a, b, by in changes:
        out += [ids[at:a], by]
        at = b
    return np.concatenate([*out, ids[at:]])


def parts_of(texts: pa.Array, loose_lines: bool) -> tuple[np.ndarray, pa.DictionaryArray, np.ndarray]:
    """All texts' bytes with one space before each, their parts as a dictionary, and each text's first part."""
    lead = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
    lead = pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar("", pa.large_string()), lead)
    flat, offsets = buffer_of(lead)
    space = flat == 0x20
    begin = np.zeros(len(flat), bool)
    begin[1:] = space[1:] & ~space[:-1]
    if loose_lines:
        line = flat == 0x0A
        begin |= line
        begin[1:] |= line[:-1]
    begin[offsets[:-1][np.diff(offsets) > 0]] = True
    at = np.flatnonzero(begin)
    bounds = np.append(at, len(flat))
    array = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat)))
    return flat, array.dictionary_encode(), np.searchsorted(at, offsets)


def encoded(texts: pa.Array, path: str, n: int) -> dict[str, object]:
    """For every text: ids of the best segmentation (flat, with offsets), and ids and scores of the n best."""
    own = model(path)
    texts = whole(texts)
    flat, parts, first = parts_of(texts, own.loose_lines)
    names = parts.dictionary.to_pylist()
    number = own.numbers(names)
    index = parts.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    place = number[index] if len(index) else index
    ids = own.flat[ragged(own.begins[place], own.lengths[place])]
    score, gap = own.totals[place], own.losses[place]
    count = sums_by(own.lengths[place], first)
    offsets = np.concatenate([[0], np.cumsum(count)])
    ends = np.cumsum(own.lengths[place])
    scores, lists = [], []
    for j, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        total, near = float(score[a:b].sum()), gap[a:b]
        some = np.arange(b - a)
        if len(some) > n - 1:
            limit = np.partition(near, n - 2)[n - 2] if n > 1 else -np.inf
            some = np.flatnonzero(near <= limit)[np.argsort(near[near <= limit], kind="stable")][: n - 1]
        some = [a + i for i in some.tolist() if np.isfinite(near[i])]
        further = [own.alternatives(names[index[i]], n) for i in some]
        sums = best_sums([losses for losses, _ in further], n)
        best, begin = ids[offsets[j] : offsets[j + 1]], offsets[j]
        scores.append([total - loss for loss, _ in sums])
        lists.append([best] + [spliced(best, sorted(
            [(ends[i] - own.lengths[place[i]] - begin, ends[i] - begin, further[m][1][c - 1]) for m, (i, c) in enumerate(zip(some, chosen)) if c], key=lambda x: x[0]))
            for _, chosen in sums[1:]])
    return {"ids": ids, "offsets": offsets, "scores": scores, "lists": lists, "texts": texts}


def decoded(ids: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of the texts that the pieces stand for, without the space that encoding put first."""
    own = model(path)
    size = own.size[ids]
    flat = own.plain[ragged(own.at[ids], size)]
    bounds = np.concatenate([[0], np.cumsum(size)])[offsets]
    keep = np.ones(len(flat), bool)
    some = np.diff(bounds) > 0
    keep[bounds[:-1][some]] = False
    return flat[keep], bounds - np.concatenate([[0], np.cumsum(some)])


def encode(docs: DataFrame, path: str, n: int = 4, ids: str = "list", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Adds to the columns ``keep`` of ``docs`` (default: all but text): n_bytes, ids of the best segmentation (or
    ids_sha256 of them as 32-bit little-endian integers with ``ids="digest"``), n_pieces, and of the n best, best first (fewer where there
    are fewer), nbest_scores, nbest_pieces (how many) and nbest_ids (or nbest_sha256); round_trip: whether the best pieces decode to the text."""
    fields = [c for c in docs.columns if c != "text"] if keep is None else list(keep)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    ids_name = "ids" if ids == "list" else "ids_sha256"
    new = ["n_bytes", ids_name, "n_pieces", "nbest_scores", "nbest_pieces", "nbest_ids" if ids == "list" else "nbest_sha256", "round_trip"]
    names = [free_name(docs.select(*fields), c) for c in new]
    new_kinds = ["bigint", "array<int>" if ids == "list" else "string", "bigint", "array<double>", "array<int>",
                 "array<array<int>>" if ids == "list" else "array<string>", "boolean"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = encoded(part.column("text"), path, n)
                flat, offsets = found["ids"], found["offsets"]
                text, bounds = buffer_of(found["texts"])
                back, ends = decoded(flat, offsets, path)
                if np.array_equal(bounds, ends) and np.array_equal(text, back):
                    same = np.ones(part.num_rows, bool)
                else:
                    raw, other = text.tobytes(), back.tobytes()
                    same = [raw[a:b] == other[c:d] for a, b, c, d in zip(bounds, bounds[1:], ends, ends[1:])]
                if ids == "list":
                    listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                    others = pa.array(found["lists"], pa.list_(pa.list_(pa.int32())))
                else:
                    view = memoryview(flat.astype("<i4"))
                    listed = pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(offsets.tolist(), offsets[1:].tolist())], pa.string())
                    others = pa.array([[hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in each] for each in found["lists"]], pa.list_(pa.string()))
                arrays = [pa.array(np.diff(bounds), pa.int64()), listed, pa.array(np.diff(offsets), pa.int64()),
                          pa.array(found["scores"], pa.list_(pa.float64())), pa.array([list(map(len, each)) for each in found["lists"]], pa.list_(pa.int32())), others, pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in fields] + arrays, names=fields + names)
        model(path).forget()  # Spark keeps the process for other tasks

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in fields] + [f"`{c}` {k}" for c, k in zip(names, new_kinds)])
    return docs.select(*[f"`{c}`" for c in fields if c != "text"], "text").mapInArrow(run, schema)


def decode(pieces: DataFrame, path: str, ids: str = "ids", name: str = "text") -> DataFrame:
    """Replaces the array column ``ids`` by the text that it stands for; null and empty arrays give ''. Pieces
    that don't form valid UTF-8 give U+FFFD where they don't."""
    fields = [c for c in pieces.columns if c != ids]
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [x or [] for x in batch.column(ids).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            flat, ends = decoded(np.array([i for x in lists for i in x], np.int64), offsets, path)
            raw = flat.tobytes()
            texts = pa.array([raw[a:b].decode(errors="replace") for a, b in zip(ends.tolist(), ends[1:].tolist())], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in fields] + [texts], names=fields + [name])

    return pieces.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in fields] + [f"`{name}` string"]))
