"""Merge-type (BPE) SentencePiece encoding and decoding by a score-ordered agenda of symbol pairs.

An agenda holds, for a segment of text, every adjacent pair of symbols whose concatenation is a
piece; the best score is popped first and, of equal scores, the leftmost. Segments end where no
piece of the vocabulary can reach across (before a run of spaces, around line feeds), which makes
their encodings independent. The agendas of all distinct segments of a batch advance together, one
pop each per round, as rows of a matrix; segments over LONG symbols use a heap.

Every Arrow batch is checked against the sentencepiece library: it encodes all distinct segments, put
together to lines that fall into the same segments. Should the two differ, the library encodes the
batch's texts, and column ``agenda_ok`` is false where its ids are others; the ids are then its own.

Nulls and empty texts: encoded as empty, which gives the begin and end ids alone. A null doc_id stays
null. Repeated rows are encoded alike. Very long texts are cut only at segment ends. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Segments of more symbols than this use a heap.
LONG = 40
#: Characters of text that one step of a batch encodes.
STEP = 8_000_000
#: Segments in one line of text that the library encodes for the check.
LINE = 5000
NONE = np.iinfo(np.int32).max


class Codec:
    """Vocabulary tables of one model file, and the library's processor."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        pieces = {sp.id_to_piece(i): i for i in normal}
        scores = {i: sp.get_score(i) for i in normal}
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        #: pieces by falling score; a symbol is its piece's place in this order
        self.by_rank = np.array(sorted(normal, key=lambda i: (-scores[i], i)), np.int32)
        rank = {int(p): r for r, p in enumerate(self.by_rank)}
        merged = sorted((-scores[i], rank[i]) for piece, i in pieces.items() if len(piece) > 1)
        #: symbols from here on share the lowest score: of these, the leftmost pair goes first
        self.floor = next((r for score, r in merged if score == merged[-1][0]), NONE)
        above = [score for score, r in merged if r < self.floor]
        if len(set(above)) != len(above):
            raise ValueError("only pieces of the lowest score may have equal scores")
        self.char = np.full(0x110000, -1, np.int32)
        for piece, i in pieces.items():
            if len(piece) == 1:
                self.char[ord(piece)] = rank[i]
        keys, values = [], []
        for piece, i in pieces.items():
            for k in range(1, len(piece)):
                if (left := pieces.get(piece[:k])) is not None and (right := pieces.get(piece[k:])) is not None:
                    keys.append(rank[left] * n + rank[right])
                    values.append(rank[i])
            if len(piece) > 1 and any(self.char[ord(c)] < 0 and c not in pieces for c in piece):
                raise ValueError("a piece holds a character that is no piece")
        self.n = n
        self._table(np.array(keys, np.int64), np.array(values, np.int32))
        crosses = re.compile(rf"[^{SPACE}]{SPACE}|.\n|\n.", re.S)
        whole = any(crosses.search(p) for p in pieces)
        self.segment = re.compile(r".+", re.S) if whole else re.compile(rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        prefix = sp.normalize("a b")
        self.prefix = SPACE if prefix.startswith(SPACE) else ""
        self.plain = prefix in (f"{SPACE}a{SPACE}b", f"a{SPACE}b") and sp.normalize("a  B \n\tｅ́ ") == f"{self.prefix}a{SPACE}{SPACE}B{SPACE}\n\tｅ́{SPACE}"

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressing table of pairs in two arrays."""
        self.bits = int(np.ceil(np.log2(max(4, 4 * len(keys)))))
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        self.probes = 1
        for key, slot, value in zip(keys.tolist(), self._slot(keys).tolist(), values.tolist(), strict=True):
            probe = 1
            while self.keys[slot] >= 0:
                slot, probe = (slot + 1) & ((1 << self.bits) - 1), probe + 1
            self.keys[slot], self.values[slot], self.probes = key, value, max(self.probes, probe)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbol that each pair merges to, or NONE."""
        keys = left.astype(np.int64) * self.n + right
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != -1) & (keys >= 0))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[slot[open_]] == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (self.keys[slot[open_]] != -1)]
        return out

    def _rounds(self, symbols: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Agendas of segments of equal length, as rows: one pop each per round.

        Returns the symbols, the characters kept for symbols outside the vocabulary, and each row's length.
        """
        rows, width = symbols.shape
        length = np.full(rows, width)
        if width < 2:
            return symbols, chars, length
        agenda = self.pair(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(rows, width - 1)
        live = np.arange(rows)
        place = np.arange(width)
        while len(live):
            a = agenda[live]
            at = a.argmin(axis=1)
            best = a[np.arange(len(live)), at]
            tied = np.flatnonzero((best >= self.floor) & (best != NONE))
            if len(tied):
                at[tied] = (a[tied] != NONE).argmax(axis=1)
                best[tied] = a[tied, at[tied]]
            going = best != NONE
            live, at, best, a = live[going], at[going], best[going], a[going]
            if not len(live):
                break
            s, c = symbols[live], chars[live]
            each = np.arange(len(live))
            take = np.minimum(place[None, :] + (place[None, :] > at[:, None]), width - 1)
            s, c = np.take_along_axis(s, take, 1), np.take_along_axis(c, take, 1)
            s[each, at] = best
            length[live] -= 1
            s[each, length[live]] = -1
            a = np.take_along_axis(a, np.minimum(take[:, :-1], width - 2), 1)
            a[each, np.minimum(length[live] - 1, width - 2)] = NONE
            has = at > 0
            a[each[has], at[has] - 1] = self.pair(s[each[has], at[has] - 1], best[has])
            has = at + 1 < length[live]
            a[each[has], at[has]] = self.pair(best[has], s[each[has], at[has] + 1])
            symbols[live], chars[live], agenda[live] = s, c, a
        return symbols, chars, length

    def _heap(self, segment: str) -> list[int]:
        """One long segment's agenda as a heap over a linked list of symbols."""
        code = np.frombuffer(segment.encode("utf-32-le"), np.uint32)
        sym = self.char[code].tolist()
        n = len(sym)
        first = self.pair(np.array(sym[:-1]), np.array(sym[1:])).tolist() if n > 1 else []
        heap = [(min(r, self.floor), i, r, sym[i], sym[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        prev, nxt, gone = list(range(-1, n - 1)), [*range(1, n), -1], [False] * n
        known: dict[tuple[int, int], int] = {}

        def push(i: int, j: int) -> None:
            pair = (sym[i], sym[j])
            if pair not in known:
                known[pair] = int(self.pair(np.array(pair[:1]), np.array(pair[1:]))[0])
            if known[pair] != NONE:
                heapq.heappush(heap, (min(known[pair], self.floor), i, known[pair], *pair))

        while heap:
            _, i, r, left, right = heapq.heappop(heap)
            j = nxt[i]
            if gone[i] or j < 0 or sym[i] != left or sym[j] != right:
                continue
            sym[i], gone[j] = r, True
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
                push(i, nxt[i])
            if prev[i] >= 0:
                push(prev[i], i)
        out: list[int] = []
        i = 0
        while i >= 0:
            out += [int(self.by_rank[sym[i]])] if sym[i] >= 0 else self.bytes[list(chr(code[i]).encode())].tolist()
            i = nxt[i]
        return out

    def segments(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct segments, flat, and where each ends."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        start = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(words) else np.zeros(0, np.int64)
        who, place, ids = [], [], []
        for width in np.unique(lengths):
            mine = np.flatnonzero(lengths == width)
            if width > LONG:
                for w in mine:
                    got = self._heap(words[w])
                    who.append(np.full(len(got), w))
                    place.append(np.arange(len(got)))
                    ids.append(np.array(got, np.int32))
                continue
            chars = code[start[mine][:, None] + np.arange(width)].astype(np.int32)
            symbols, chars, length = self._rounds(self.char[chars], chars)
            row, col = np.nonzero(np.arange(width)[None, :] < length[:, None])
            s = symbols[row, col]
            known = s >= 0
            who.append(mine[row[known]])
            place.append(col[known] * 4)
            ids.append(self.by_rank[s[known]])
            for r, k, c in zip(row[~known].tolist(), col[~known].tolist(), chars[row, col][~known].tolist(), strict=True):
                b = chr(c).encode()
                who.append(np.full(len(b), mine[r]))
                place.append(k * 4 + np.arange(len(b)))
                ids.append(self.bytes[list(b)])
        if not who:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        who_, place_, ids_ = np.concatenate(who), np.concatenate(place), np.concatenate(ids)
        order = np.lexsort((place_, who_))
        return ids_[order], np.cumsum(np.bincount(who_, minlength=len(words)))

    def agree(self, words: list[str], flat: np.ndarray, ends: np.ndarray) -> bool:
        """Whether the library encodes the distinct segments, in longer lines of text, as the agenda does."""
        spaced = np.array([w[0] == SPACE and w[-1] != SPACE for w in words], bool)
        lengths = np.diff(ends, prepend=0)
        for lead, mine in (("", np.flatnonzero(spaced)), ("\n", np.flatnonzero(~spaced))):
            for at in range(0, len(mine), LINE):
                held = mine[at : at + LINE]
                # a line of text that falls into exactly these segments; the library adds its prefix in front
                line = "".join(lead + words[w] for w in held)
                line = line.removeprefix(self.prefix) if not lead else line
                ids = np.array(self.library.encode(line.replace(SPACE, " "), num_threads=1), np.int32)
                size = lengths[held]
                stop = np.cumsum(size)
                own = flat[np.repeat((ends - lengths)[held] - (stop - size), size) + np.arange(stop[-1])]
                if lead:
                    own = np.insert(own, stop - size, self.bytes[ord("\n")])
                    ids = ids[len(self.prefix) :]
                if not np.array_equal(ids, own):
                    return False
        return True

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], bool]:
        """Ids of each text, with begin and end; whether the library agrees on all distinct segments."""
        index: dict[str, int] = {}
        used, per_text = [], []
        for text in texts:
            t = (self.prefix + text.replace(" ", SPACE)) if text else ""
            found = self.segment.findall(t if self.plain or not text else self.library.normalize(text))
            per_text.append(len(found))
            used += [index.setdefault(w, len(index)) for w in found]
        words = list(index)
        flat, ends = self.segments(words)
        word = np.array(used, np.int64)
        lengths = np.diff(ends, prepend=0)
        size, first = lengths[word], (ends - lengths)[word]
        stop = np.cumsum(size)
        ids = flat[np.repeat(first - (stop - size), size) + np.arange(stop[-1])] if len(word) else flat
        cut = np.concatenate([[0], stop])[np.cumsum(per_text)] if len(texts) else []
        begin, end = np.int32([self.library.bos_id()]), np.int32([self.library.eos_id()])
        return [np.concatenate([begin, x, end]) for x in np.split(ids, cut)[: len(texts)]], self.agree(words, flat, ends)


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def steps(texts: pa.Array, limit: int = STEP) -> Iterator[tuple[int, list[str]]]:
    """Runs of a batch's texts of about ``limit`` characters (one text at least), with their offset."""
    held, size, at = [], 0, 0
    for k, t in enumerate(texts):
        t = t.as_py() or ""
        if held and size + len(t) > limit:
            yield at, held
            held, size, at = [], 0, k
        held.append(t)
        size += len(t)
    if held:
        yield at, held


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, agenda_ok; with keep_ids also ids and decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            for at, texts in steps(batch.column(1)):
                ids, agree = own.encode(texts)
                same = [True] * len(texts)
                if not agree:
                    theirs = [np.array(x, np.int32) for x in own.library.encode(texts, add_bos=True, add_eos=True, num_threads=1)]
                    same = [np.array_equal(a, b) for a, b in zip(ids, theirs, strict=True)]
                    ids = theirs
                decoded = [own.library.decode(x.tolist()) for x in ids]
                out = {
                    "doc_id": batch.column(0).slice(at, len(texts)),
                    "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                    "ids_sha256": [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in decoded],
                    "agenda_ok": same,
                }
                if keep_ids:
                    out |= {"ids": pa.array([x.tolist() for x in ids], pa.list_(pa.int32())), "decoded": decoded}
                yield pa.RecordBatch.from_pydict(out)

    more = ", ids array<int>, decoded string" if keep_ids else ""
    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, agenda_ok boolean{more}"
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(run, schema)
