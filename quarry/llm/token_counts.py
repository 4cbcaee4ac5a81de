"""Exact token counts of every prefix by dynamic programming over byte-pair pieces.

A text falls apart where no piece of the vocabulary can reach across (before a run of spaces, at line
ends, between a letter and a stop). Within such a chunk, the encoding of each prefix is the encoding of a shorter prefix plus one
last piece, and just one piece fits: the one that stays whole beside the piece before it. So one pass
over the characters gives the count of every prefix, which answers truncation and budget questions
without encoding anything again. Each worker remembers the counts of the chunks it has seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks and piece pairs that a worker remembers, and characters of all these chunks; characters counted together; bits of the
#: hash tables' slots.
REMEMBERED, REMEMBERED_CHARS, BLOCK, SLOTS, PAIR_SLOTS = 400_000, 8 << 20, 1 << 20, 18, 20
#: From this length on a chunk goes ahead alone, character by character; so many characters are looked up together.
LONG, STRETCH = 512, 1 << 16
MARK = "▁"


class PrefixCounter:
    """Token counts of prefixes for a byte-pair model with byte fallback and spaces marked."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = range(model.get_piece_size())
        special = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        self.score = {model.id_to_piece(i).replace(MARK, " "): model.get_score(i) for i in ids if not special(i)}
        self.longest = max(map(len, self.score))
        probe = " a\tb  éａ \n"
        if model.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("the model changes texts before it splits them")
        if any(re.search("[^ ] ", p) for p in self.score):
            raise ValueError("a piece reaches across a space")
        joined = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        apart = "".join(c for c in "\n\t" if not any(c in x for x in joined))
        after = "".join(c for c in ",.!?:;" if not any(x[1] == c and re.match(r"[^\W\d_]", x[0]) for x in joined))
        more = rf"(?:(?<![^\W\d_])[{after}]+[^ {apart}{after}]*)*" if after else ""
        self._chunks = re.compile((rf"[{apart}]|" if apart else "") + rf"(?: +|[^ {apart}])[^ {apart}{after}]*{more}").findall
        self._pieces = [p for p in self.score if self._merged(p) == [p]]
        self._trie = _Ends(self._pieces)
        self._beside: dict[int, bool] = {}
        self._slot_keys, self._slot_fits = np.full(1 << PAIR_SLOTS, -1, np.int64), np.zeros(1 << PAIR_SLOTS, bool)
        self._totals: dict[str, int] = {}
        self._held = 0

    def _merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging the best pair, leftmost first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _name(self, number: int) -> str:
        return self._pieces[number] if number >= 0 else chr(-1 - number)

    def _fits(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether two pieces side by side stay as they are; answers are kept in slots."""
        keys = (before + (1 << 21)) << 22 | piece + (1 << 21)
        slots = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_SLOTS)).astype(np.int64)
        fits = self._slot_fits[slots]
        new = np.flatnonzero(self._slot_keys[slots] != keys)
        if len(new):
            if len(self._beside) > REMEMBERED:
                self._beside.clear()
            distinct, back = np.unique(keys[new], return_inverse=True)
            found = np.array([self._beside[k] if k in self._beside else self._tried(k) for k in distinct.tolist()])
            fits[new] = found[back]
            self._slot_keys[slots[new]], self._slot_fits[slots[new]] = keys[new], fits[new]  # of two keys in a slot the last stays
        return fits

    def _tried(self, key: int) -> bool:
        pair = [self._name((key >> 22) - (1 << 21)), self._name((key & (1 << 22) - 1) - (1 << 21))]
        fits = self._beside[key] = self._merged("".join(pair)) == pair
        return fits

    def prefix_table(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The token counts of all prefixes of all chunks, one after another, and where each chunk starts.

        A chunk of n characters has n + 1 counts, from the empty prefix on. The last piece of a prefix is the
        longest end that is a piece and fits beside the last piece of what stands before it. All chunks
        but the long ones go ahead together, a character at a time.
        """
        start = np.r_[0, np.cumsum([len(c) + 1 for c in chunks], dtype=np.int64)]
        if all(len(c) < LONG for c in chunks):
            return self._together(chunks, start), start
        counts = np.zeros(start[-1], np.int64)
        short = [i for i, c in enumerate(chunks) if len(c) < LONG]
        if short:
            some = [chunks[i] for i in short]
            at = np.r_[0, np.cumsum([len(c) + 1 for c in some], dtype=np.int64)]
            shift = np.repeat(start[short] - at[:-1], np.diff(at))
            counts[np.arange(at[-1]) + shift] = self._together(some, at)
        for i, c in enumerate(chunks):
            if len(c) >= LONG:
                counts[start[i] : start[i + 1]] = self._alone(c)
        return counts, start

    def _alone(self, chunk: str) -> np.ndarray:
        points = np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        counts, last, fits = np.zeros(len(points) + 1, np.int64), [0] * (len(points) + 1), self._beside
        most = self._trie.longest
        for low in range(0, len(points), STRETCH):
            first = max(0, low - most)
            own = points[first : low + STRETCH]
            position, length, piece, cost = self._ends(own, np.arange(1, len(own) + 1))
            keep = position >= low - first
            order = np.lexsort((-length[keep], position[keep]))
            done = -1
            table = counts[first : low + STRETCH + 1].tolist()
            for i, n, p, c in zip(*(x[keep][order].tolist() for x in (position, length, piece, cost))):
                if i == done:
                    continue
                before = i + 1 - n
                if before + first:
                    key = last[before + first] + (1 << 21) << 22 | p + (1 << 21)
                    fit = fits.get(key)
                    if not (self._tried(key) if fit is None else fit):
                        continue
                done = i
                last[i + 1 + first] = p
                table[i + 1] = table[before] + c
            counts[first : first + len(table)] = table
            if len(fits) > REMEMBERED:
                fits.clear()
        return counts

    def _ends(self, points: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, ...]:
        """Position, length, number and tokens of each piece that ends at a position; a character outside the vocabulary is its bytes."""
        position, length, piece = self._trie.matches(points, within)
        alone = np.ones(len(points), bool)
        alone[position[length == 1]] = False
        alone = np.flatnonzero(alone)
        position, length = np.r_[position, alone], np.r_[length, np.ones(len(alone), np.int64)]
        piece = np.r_[piece, -1 - points[alone]]
        return position, length, piece, np.where(piece >= 0, 1, 1 + (piece < -0x80) + (piece < -0x800) + (piece < -0x10000))

    def _together(self, chunks: list[str], start: np.ndarray) -> np.ndarray:
        size = np.diff(start) - 1
        counts, last = np.zeros(start[-1], np.int64), np.zeros(start[-1], np.int64)
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        within = np.arange(1, len(points) + 1) - np.repeat(np.r_[0, np.cumsum(size)][:-1], size)
        end = np.repeat(start[:-1], size) + within
        position, length, piece, cost = self._ends(points, within)
        order = np.argsort((within[position] << 8) - length, kind="stable")
        position, length, piece, cost = position[order], length[order], piece[order], cost[order]
        at = end[position]
        done = np.zeros(start[-1], bool)
        step = within[position] << 8 | length
        cuts = np.flatnonzero(np.r_[True, step[1:] != step[:-1]]) if len(step) else []
        for a, b in zip(cuts, [*cuts[1:], len(step)]):
            here = np.arange(a, b)[~done[at[a:b]]]
            if length[a] < within[position[a]]:
                here = here[self._fits(last[at[here] - length[a]], piece[here])]
            to = at[here]
            done[to] = True
            last[to] = piece[here]
            counts[to] = counts[to - length[a]] + cost[here]
        return counts

    def chunk_counts(self, chunk: str) -> list[int]:
        return self.prefix_table([chunk])[0].tolist()

    def chunks(self, text: str) -> list[str]:
        return self._chunks(" " + text.replace(MARK, " ")) if text else []

    def learn(self, chunks: list[list[str]]) -> None:
        """Count the chunks that are not known yet, all at once."""
        if len(self._totals) > REMEMBERED or self._held > REMEMBERED_CHARS:
            self._totals, self._held = {}, 0
        totals = self._totals
        new = list({c for own in chunks for c in own if c not in totals})
        if new:
            counts, start = self.prefix_table(new)
            totals.update(zip(new, counts[start[1:] - 1].tolist()))
            self._held += int(start[-1])

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of ``text[:i]`` for every i from 0 to its length."""
        counts, start = self.prefix_table(self.chunks(text))
        before = np.r_[0, np.cumsum(counts[start[1:] - 1])]
        every = counts + np.repeat(before[:-1], np.diff(start))
        inside = np.ones(len(counts), bool)
        inside[start[:-1]] = False
        return np.r_[0, every[inside][1:]]  # the mark in front is no character of the text

    def totals_and_fits(self, texts: list[str], limit: int) -> list[tuple[int, int]]:
        """Tokens of each text, and the length of its longest prefix of at most ``limit`` tokens."""
        split = [self.chunks(t) for t in texts]
        self.learn(split)
        known = self._totals.__getitem__
        out = []
        for text, chunks in zip(texts, split):
            total = sum(map(known, chunks))
            out.append((total, len(text) if total <= limit else self._fit(chunks, limit)))
        return out

    def _fit(self, chunks: list[str], limit: int) -> int:
        tokens = np.cumsum([self._totals[c] for c in chunks])
        last = int(np.searchsorted(tokens, limit, "right"))  # the first chunk that ends beyond the limit
        first = int(np.searchsorted(tokens, limit - self.longest))  # those before it go less far
        counts, start = self.prefix_table(chunks[first : last + 1])
        before = np.r_[0, tokens][first : last + 1]
        fits = np.flatnonzero(counts + np.repeat(before, np.diff(start)) <= limit)[-1]
        chunk = int(np.searchsorted(start, fits, "right")) - 1
        return max(0, sum(map(len, chunks[: first + chunk])) + int(fits - start[chunk]) - 1)


class _Ends:
    """A trie of the pieces read backwards; its edges in a table with open addressing."""

    def __init__(self, pieces: list[str]) -> None:
        codes = {c: i for i, c in enumerate(sorted(set("".join(pieces))), 1)}
        self.code = np.zeros(0x110000, np.int64)
        self.code[[ord(c) for c in codes]] = list(codes.values())
        self.width, self.longest = len(codes) + 1, max(map(len, pieces))
        edges: dict[int, int] = {}
        ends = [-1]
        for number, piece in enumerate(pieces):
            state = 0
            for c in reversed(piece):
                key = state * self.width + codes[c]
                state = edges.setdefault(key, len(ends))
                if state == len(ends):
                    ends.append(-1)
            ends[state] = number
        self.piece = np.array(ends, np.int64)
        self.keys, self.next = np.full(1 << SLOTS, -1, np.int64), np.zeros(1 << SLOTS, np.int64)
        keys = np.fromiter(edges, np.int64)
        for key, slot, state in zip(keys.tolist(), self._slot(keys).tolist(), edges.values()):
            while self.keys[slot] >= 0:
                slot = slot + 1 & (1 << SLOTS) - 1
            self.keys[slot], self.next[slot] = key, state

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def _step(self, keys: np.ndarray) -> np.ndarray:
        """The next state of each (state, code), -1 where there is none."""
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.next[slot], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slot[open_] = slot[open_] + 1 & (1 << SLOTS) - 1
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.next[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def matches(self, points: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each piece that ends at a position, within the position's chunk: position, length, number."""
        code = self.code[points]
        live, state, out = np.arange(len(points)), np.zeros(len(points), np.int64), []
        for length in range(1, self.longest + 1):
            state = self._step(state * self.width + code[live - length + 1])
            live, state = live[state >= 0], state[state >= 0]
            number = self.piece[state]
            whole = number >= 0
            out.append((live[whole], np.full(int(whole.sum()), length), number[whole]))
            more = within[live] > length
            live, state = live[more], state[more]
        return tuple(np.concatenate(x) for x in zip(*out))


@lru_cache(maxsize=2)
def counter(model_path: str) -> PrefixCounter:
    return PrefixCounter(model_path)


def _some(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about BLOCK characters."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", prefixes: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit, fit_chars; with ``prefixes`` also
    prefix_tokens, the token count of every prefix by characters.

    ``fit_chars`` is the length of the longest prefix within the limit. Null text counts as empty (0
    tokens). Texts are counted whole, however long. Each row is answered alone, so repeated rows and
    ids don't matter; an empty table gives an empty result, and other columns are not read.
    """
    fields = [("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("fit_chars", pa.int64())] + [("prefix_tokens", pa.list_(pa.int64()))] * prefixes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model_path)
        for batch in batches:
            texts, got = batch["text"].fill_null("").to_pylist(), []
            for few in _some(texts):
                got += own.totals_and_fits(few, limit)
            tokens = np.array([n for n, _ in got], np.int64)
            columns = [pa.compute.binary_length(batch["text"]).cast(pa.int64()).fill_null(0), tokens, tokens > limit, [f for _, f in got]]
            if prefixes:
                columns.append([own.prefix_counts(t) for t in texts])
            yield pa.RecordBatch.from_arrays([batch[id_col], *(pa.array(c, t) if not isinstance(c, pa.Array) else c for c, (_, t) in zip(columns, fields))], [id_col, *(n for n, _ in fields)])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + ", prefix_tokens array<long>" * prefixes)
