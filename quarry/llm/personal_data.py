"""Personal data: base patterns, and a linear-chain conditional random field over word shapes.

The field labels all pieces (letters, digits, single signs) of a text as beginning, inside or outside of
an email, ip, card or phone. Its features are the shapes of a piece and its neighbours; it is trained by
maximum likelihood from a small labelled table and decoded by Viterbi in numpy for many overlapping
blocks of pieces together. What it finds joins the base spans where it overlaps
none and keeps the form of its kind.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
Span = tuple[str, int, int]

# --- base patterns -------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (int(d) * 2 - 9 if int(d) > 4 else int(d) * 2) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """Around each at-sign, as a leftmost search finds them, in time linear in the text."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield "email", start, domain.end()
            low = domain.end()
        else:
            low = at + 1
        at = text.find("@", low)


def _ips(text: str) -> Iterator[Span]:
    for run in _DOTTED.finditer(text):
        parts = run.group().split(".")
        at = run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield "ip", at, end
            at = end + 1


def base_spans(text: str) -> list[Span]:
    """By kind, then start; matches that fail their kind's test are dropped."""
    out = [*_emails(text), *_ips(text)]
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 16 <= len(d := _only_digits(m.group())) <= 19 and _luhn(d)]
    return out + [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_only_digits(m.group())) <= 15]


# --- shapes --------------------------------------------------------------------------------------

_PIECE = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|\w")
#: What every span that ``_plausible`` accepts contains: a digit, an at-sign or the piece "at". Where it is
#: missing, nothing that the field could mark would stay.
_NEEDED = re.compile(r"[0-9@]|(?<![^\W\d_])at(?![^\W\d_])", re.I)
#: Pieces of a block that are its own, and those before and after that it shares with its neighbours.
CORE, MARGIN = 128, 48
#: Pieces decoded together.
TOGETHER = 200_000
_CUES = {w: i for i, w in enumerate("at dot com org net edu tel phone call fax mobile mail email version page isbn id no token card".split())}
_SIGNS = {c: i for i, c in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")}
SHAPES = 2 + len(_CUES) + 20 + 24 + len(_SIGNS) + 2
SLOTS = (-3, -2, -1, 0, 1, 2, 3)
GAPS = (0, 1)


_shapes: dict[str, int] = {}


def _known_shape(piece: str) -> int:
    """``_shape``, remembered for a bounded number of pieces."""
    shape = _shapes.get(piece)
    if shape is None:
        if len(_shapes) > 200_000:
            _shapes.clear()
        shape = _shapes[piece] = _shape(piece)
    return shape


def _shape(piece: str) -> int:
    """0 is outside of the window; then cue words, letters by case and length, digits by length (those of a card that pass its
    check apart), signs."""
    if piece in _SIGNS:
        return 2 + len(_CUES) + 44 + _SIGNS[piece]
    if "0" <= piece[0] <= "9":
        if 16 <= len(piece) <= 19 and _luhn(piece):
            return SHAPES - 1
        small = len(piece) < 4 and int(piece) < 256
        return 2 + len(_CUES) + 20 + (20 + len(piece) if small else min(len(piece), 20) - 1)
    if piece[0].isalpha():
        cue = _CUES.get(piece.lower())
        if cue is not None:
            return 2 + cue
        case = 0 if piece.islower() else 1 if piece.isupper() else 2 if piece.istitle() else 3
        return 2 + len(_CUES) + case * 5 + (len(piece) - 1 if len(piece) < 4 else 3 if len(piece) < 7 else 4)
    return 1


def stretches(text: str) -> Iterator[tuple[list[tuple[int, int]], int, int]]:
    """All pieces of a text in overlapping blocks: their spans, and the first and end of the block's own ones."""
    rest, held, core = _PIECE.finditer(text), [], 0
    while True:
        held += [m.span() for m in islice(rest, core + CORE + MARGIN - len(held))]
        end = min(core + CORE, len(held))
        if core == end:
            return
        yield held, core, end
        drop = max(0, end - MARGIN)
        held, core = held[drop:], end - drop


def pieces(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Shapes of successive pieces, and whether space stands before each."""
    shapes = np.array([_known_shape(text[a:b]) for a, b in spans], np.int64)
    place = np.array(spans, np.int64)
    gaps = np.ones(len(spans), np.int64)
    gaps[1:] = place[1:, 0] != place[:-1, 1]
    gaps[:1] = [a == 0 or text[a - 1].isspace() for a, _ in spans[:1]]
    return shapes, gaps


# --- the field -----------------------------------------------------------------------------------


class Field:
    """Weights of (slot, shape, label), (gap, label) and (label, label)."""

    def __init__(self) -> None:
        n = len(LABELS)
        self.shape, self.gap, self.move = np.zeros((len(SLOTS), SHAPES, n)), np.zeros((len(GAPS), 2, n)), np.zeros((n, n))
        self.forbid = np.array([[-1e4 if b[0] == "I" and a[2:] != b[2:] else 0.0 for b in LABELS] for a in LABELS])
        self.first = np.array([-1e4 if b[0] == "I" else 0.0 for b in LABELS])

    @staticmethod
    def padded(sequences: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shapes and gaps of each slot of each piece, and the lengths, for sequences side by side."""
        size = np.array([len(s) for s, _ in sequences])
        width, far = int(size.max()), max(SLOTS)
        shapes, gaps = np.zeros((len(size), width + 2 * far), np.int64), np.zeros((len(size), width + 2 * far), np.int64)
        for i, (s, g) in enumerate(sequences):
            shapes[i, far : far + len(s)], gaps[i, far : far + len(g)] = s, g
        around = np.stack([shapes[:, far + k : far + k + width] for k in SLOTS], axis=2)
        spaced = np.stack([gaps[:, far + k : far + k + width] for k in GAPS], axis=2)
        return around, spaced, size

    def emissions(self, around: np.ndarray, spaced: np.ndarray) -> np.ndarray:
        out = sum(self.shape[k][around[:, :, k]] for k in range(len(SLOTS)))
        return out + sum(self.gap[k][spaced[:, :, k]] for k in range(len(GAPS)))

    def fit(self, sequences: list[tuple[np.ndarray, np.ndarray]], labels: list[list[int]], rounds: int = 120, rate: float = 0.6, decay: float = 1e-4) -> Field:
        """Maximum likelihood with forward and backward sums, by steps scaled to past gradients. Sequences of like length go side by side."""
        n = len(LABELS)
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i][0]))
        parts = []
        for low in range(0, len(order), 100):
            own = order[low : low + 100]
            around, spaced, size = self.padded([sequences[i] for i in own])
            live = np.arange(around.shape[1])[None, :] < size[:, None]
            gold = np.zeros(live.shape, np.int64)
            for row, i in enumerate(own):
                gold[row, : len(labels[i])] = labels[i]
            parts.append((around, spaced, live, np.eye(n)[gold] * live[:, :, None]))
        past = [np.full_like(w, 1e-8) for w in (self.shape, self.gap, self.move)]
        for _ in range(rounds):
            gradients = [np.zeros_like(w) for w in (self.shape, self.gap, self.move)]
            for around, spaced, live, gold in parts:
                chance, moves = self._expected(around, spaced, live)
                diff = (gold - chance).reshape(-1, n)
                for gradient, where, slots in ((gradients[0], around, len(SLOTS)), (gradients[1], spaced, len(GAPS))):
                    for k in range(slots):
                        at = where[:, :, k].reshape(-1, 1) * n + np.arange(n)
                        gradient[k] += np.bincount(at.ravel(), diff.ravel(), minlength=gradient[k].size).reshape(-1, n)
                gradients[2] += np.einsum("rta,rtb->ab", gold[:, :-1], gold[:, 1:]) - moves
            for weight, gradient, seen in zip((self.shape, self.gap, self.move), gradients, past):
                gradient = gradient / len(sequences) - decay * weight
                seen += gradient**2
                weight += rate * gradient / np.sqrt(seen)
        return self

    def _expected(self, around: np.ndarray, spaced: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chance of each label at each piece, and expected numbers of each move from label to label."""
        score = self.emissions(around, spaced)
        own, move = np.exp(score - score.max(axis=2, keepdims=True)), np.exp(self.move + self.forbid)
        rows, width, n = own.shape
        ahead, behind, scale = np.zeros(own.shape), np.ones(own.shape), np.ones((rows, width, 1))
        ahead[:, 0] = own[:, 0] * np.exp(self.first)
        for t in range(width):
            if t:
                ahead[:, t] = np.where(live[:, t, None], (ahead[:, t - 1] @ move) * own[:, t], ahead[:, t - 1])
            scale[:, t] = np.maximum(ahead[:, t].sum(axis=1, keepdims=True), 1e-300)
            ahead[:, t] /= scale[:, t]
        moves = np.zeros((n, n))
        for t in range(width - 2, -1, -1):
            after = own[:, t + 1] * behind[:, t + 1] / scale[:, t + 1] * live[:, t + 1, None]
            behind[:, t] = np.where(live[:, t + 1, None], after @ move.T, 1.0)
            moves += (ahead[:, t].T @ after) * move
        chance = ahead * behind * live[:, :, None]
        return chance / np.maximum(chance.sum(axis=2, keepdims=True), 1e-300), moves

    def decode(self, sequences: list[tuple[np.ndarray, np.ndarray]]) -> list[list[int]]:
        """The best labels of each sequence; sequences of like length are decoded together."""
        out: list[list[int]] = [[] for _ in sequences]
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i][0]))
        group: list[int] = []
        for place, i in enumerate(order):
            group.append(i)
            longest = len(sequences[order[place + 1]][0]) if place + 1 < len(order) else None
            if longest is None or (len(group) + 1) * longest > TOGETHER:
                for j, own in zip(group, self._viterbi([sequences[j] for j in group])):
                    out[j] = own
                group = []
        return out

    def _viterbi(self, sequences: list[tuple[np.ndarray, np.ndarray]]) -> list[list[int]]:
        around, spaced, size = self.padded(sequences)
        score, move = self.emissions(around, spaced), self.move + self.forbid
        rows, width = around.shape[:2]
        best, came = score[:, 0] + self.first, np.zeros((rows, width, len(LABELS)), np.int8)
        live = np.arange(width)[None, :] < size[:, None]
        for t in range(1, width):
            every = best[:, :, None] + move[None]
            came[:, t] = np.where(live[:, t, None], every.argmax(axis=1), np.arange(len(LABELS))[None, :])
            best = np.where(live[:, t, None], every.max(axis=1) + score[:, t], best)
        label = np.zeros((rows, width), np.int64)
        label[:, -1] = best.argmax(axis=1)
        for t in range(width - 1, 0, -1):
            label[:, t - 1] = came[np.arange(rows), t, label[:, t]]
        return [row[:n].tolist() for row, n in zip(label, size.tolist())]


# --- the labelled table --------------------------------------------------------------------------


def labelled_table(rows: int = 1000, seed: int = 5) -> list[tuple[str, list[Span]]]:
    """A small table of texts with marked spans: each kind in several forms, among words, and numbers
    that are none (dates, versions, prices, long keys, ranges)."""
    rng = random.Random(seed)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(("tha", "ing", "er", "on", "re", "ção", "de", "li", "ß", "é", "to", "and")) for _ in range(rng.randint(1, 4)))
    host = lambda: rng.choice(("mail7", word(), "post-" + number(1))) + rng.choice((".example", "", "." + word())) + rng.choice((".com", ".org", ".net", ".de"))
    name = lambda: rng.choice((word() + "." + number(2), word(), word() + "_" + word(), word() + number(3)))
    local = lambda: rng.choice(("({a}) {b}-{c}", "{a}-{b}-{c}", "{a}.{b}.{c}", "({a}) {b} {c}", "{a} {b} {c}")).format(a=number(3), b=number(3), c=number(4))
    pairs = lambda: rng.choice(" -").join(["0" + number(1), *(number(2) for _ in range(4))])

    def card() -> str:
        digits = number(15)
        digits += next(str(d) for d in range(10) if _luhn(digits + str(d)))
        return rng.choice((digits, "-".join(digits[k : k + 4] for k in (0, 4, 8, 12)), " ".join(digits[k : k + 4] for k in (0, 4, 8, 12))))

    def failing() -> str:
        digits = number(16)
        return number(13) if _luhn(digits) else digits

    apart = lambda: rng.choice((" at ", " [at] ", " (at) ", "[at]", "(at)")).join((name(), host().replace(".", rng.choice((" dot ", " [dot] ", " (dot) ", ".")))))
    make = {
        "email": lambda: f"{name()}@{host()}" if rng.random() < 0.6 else apart(),
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: rng.choice((f"+{rng.randint(1, 99)} {local()}", local(), pairs(), f"+{number(2)} {number(3)} {number(7)}")),
    }
    other = (
        lambda: f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", lambda: f"{rng.randint(0, 23)}:{number(2)}", lambda: f"version {rng.randint(0, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 20)}",
        lambda: f"{number(rng.randint(1, 6))}.{number(2)}", lambda: f"{rng.randint(1900, 2000)}-{rng.randint(2001, 2099)}", lambda: f'token = "{rng.getrandbits(160):040x}"',
        lambda: number(rng.choice((3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 20))), lambda: f"#{number(5)}", lambda: f"${number(3)},{number(3)}", lambda: f"ISBN {number(3)}-{number(1)}-{number(4)}-{number(4)}-{number(1)}", lambda: f"page {number(3)}", lambda: f"id {number(8)}-{number(4)}", lambda: f"{word()} at {word()} dot", lambda: f"{word()} at {word()}. {word()}", lambda: f"{word()}{rng.choice('&%*#$')} at{rng.choice('&%*#$')} {word()}.", failing, lambda: f"@{word()}", lambda: f"{number(3)} {number(3)}", lambda: f"{number(4)} {number(4)}",
    )
    cues = {"phone": ("call ", "tel ", "phone ", "fax ", "mobile: "), "email": ("mail ", "email ", "email: ")}
    out = []
    for _ in range(rows):
        text, spans = "", []
        for _ in range(rng.randint(1, 5)):
            text += " ".join(word() for _ in range(rng.randint(0, 6))).capitalize() + " "
            if rng.random() < 0.5:
                kind = rng.choice(KINDS)
                value = make[kind]()
                text += rng.choice(cues[kind]) if kind in cues and rng.random() < 0.3 else ""
                spans.append((kind, len(text), len(text) + len(value)))
                text += value
            elif rng.random() < 0.8:
                text += rng.choice(other)()
            text += rng.choice((" ", ". ", ", ", "!! ", "\n"))
        out.append((text, spans))
    return out


def train(table: list[tuple[str, list[Span]]]) -> Field:
    """Pieces of a marked span begin or continue its kind."""
    sequences, labels = [], []
    for text, spans in table:
        own = [m.span() for m in _PIECE.finditer(text)]
        if not own:
            continue
        marks = [next(((f"B-{k}" if a == s else f"I-{k}") for k, s, e in spans if s <= a < e), "O") for a, _ in own]
        sequences.append(pieces(text, own))
        labels.append([LABELS.index(m) for m in marks])
    return Field().fit(sequences, labels)


@lru_cache(maxsize=1)
def standard_field() -> Field:
    return train(labelled_table())


_SPELLED = re.compile(r"[\w.%+-]+ at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+", re.I)
_BRACKETED = re.compile(r"[\w.%+-]+(?:@| ?[\[(] ?at ?[\])] ?)[A-Za-z0-9-]+(?:(?:\.| dot | ?[\[(] ?dot ?[\])] ?)[A-Za-z0-9-]+)+", re.I)


def _plausible(kind: str, text: str) -> bool:
    digits = _only_digits(text)
    if kind == "email":
        return bool(_SPELLED.fullmatch(text) or _BRACKETED.fullmatch(text))
    if kind == "ip":
        return [*_ips(text)] == [("ip", 0, len(text))]
    return 16 <= len(digits) <= 19 and _luhn(digits) if kind == "card" else 7 <= len(digits) <= 15 and not any(c.isalpha() for c in text)


def _marked(labels: list[int], first: int, end: int) -> Iterator[tuple[str, int, int]]:
    """Kind, first and last piece of each marked run that begins in ``first``..``end``."""
    for k in range(first, end):
        if (name := LABELS[labels[k]])[0] == "B":
            last = k
            while last + 1 < len(labels) and LABELS[labels[last + 1]] == f"I-{name[2:]}":
                last += 1
            yield name[2:], k, last


def found_spans(field: Field, texts: list[str]) -> list[list[Span]]:
    """What the field marks in each text and keeps the form of its kind."""
    out: list[list[Span]] = [[] for _ in texts]
    where: list[tuple] = []
    sequences: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0

    def flush() -> None:
        for (i, own, core, end), labels in zip(where, field.decode(sequences) if sequences else []):
            for kind, first, last in _marked(labels, core, end):
                a, b = own[first][0], own[last][1]
                if (not out[i] or out[i][-1][2] <= a) and _plausible(kind, texts[i][a:b]):
                    out[i].append((kind, a, b))
        where.clear()
        sequences.clear()

    for i, text in enumerate(texts):
        if not _NEEDED.search(text):
            continue
        for own, core, end in stretches(text):
            if _NEEDED.search(text, own[0][0], own[-1][1]):
                where.append((i, own, core, end))
                sequences.append(pieces(text, own))
                waiting += len(own)
            if waiting > TOGETHER:
                flush()
                waiting = 0
    flush()
    return out


def apart_from(more: list[Span], base: list[Span]) -> list[Span]:
    """Spans of ``more`` that overlap none of ``base``, after one sort of each."""
    begins = sorted((a, b) for _, a, b in base)
    reach = np.maximum.accumulate([0, *(b for _, b in begins)])
    starts = [a for a, _ in begins]
    return [s for s in more if reach[bisect_left(starts, s[2])] <= s[1]]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: list[tuple[str, list[Span]]] | None = None) -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added.

    Spans are kind:start:end in code points, end exclusive, by kind and start. ``spans`` has the base ones
    and what the field adds beside them. Null and empty texts have no spans. Rows are judged alone, so
    repeated rows and ids don't matter; an empty table gives an empty result. Texts are read whole, in
    time linear in their length. Only the two named columns are read.
    """
    held = docs.sparkSession.sparkContext.broadcast(standard_field() if table is None else train(table))
    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].fill_null("").to_pylist()
            rows = [[0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0] for _ in texts]
            own = [i for i, t in enumerate(texts) if _NEEDED.search(t)]
            for i, more in zip(own, found_spans(held.value, [texts[i] for i in own])):
                base = base_spans(texts[i])
                more = apart_from(more, base)
                rank = lambda s: (KINDS.index(s[0]), s[1])
                rows[i] = [*(sum(k == s[0] for s in base) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more, key=rank)), len(more)]
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch[id_col], *(pa.array([r[k] for r in rows], kinds[k]) for k in range(7))], [id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(find, f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
