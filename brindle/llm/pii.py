"""Personal data: patterns, and a character BiLSTM-CRF that adds to them.

Patterns find the base spans of each kind (leftmost, not overlapping; failing
matches dropped). A bidirectional LSTM over characters with CRF transitions,
trained in numpy, tags every character as outside or as part of an e-mail
address, IP address, card number or phone number. Texts are decoded in
overlapping windows; each character takes the tag of the window in whose middle
it lies most nearly, and runs of a tag over the whole text are the spans.
Spans that touch no base span are added to them.

A span holds a digit or an at sign: the labelled spans all do, and the decoder
is bound to it. So decoding starts from the windows that say what the characters
around these are, and goes on to the windows of whatever touches a tag, until
every run of a tag that was met is bounded. The spans are those of decoding all
windows, which the tests compare; windows that no such run reaches are left out.

Defined results: a null text counts as empty and has no spans; repeated rows
each get their row; a null ``doc_id`` is kept; texts of any length are decoded
in full; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import least_hashes, map_arrow, row_hash

KINDS = ("email", "ip", "card", "phone")
#: Training reads at most so many documents, the first by hash of their id and
#: text, and so many windows from anywhere in each. Decoding has no such bound.
SAMPLE_DOCS, SAMPLE_WINDOWS = 300, 6
TRAIN_WINDOWS, EPOCHS, HIDDEN, SEED = 2400, 8, 24, 7
#: What is set among the words of a training window: a kind, or a decoy.
DRAWN = (*KINDS, "phone", "phone", None, None, None, None)
WINDOW, STRIDE = 128, 64
#: Windows computed at once.
BATCH = 512
CUE = re.compile(r"[0-9@]")
CLASS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
#: A day, or two years: no phone number.
DATE = re.compile(r"(?<![0-9])(?:1[89]|20)[0-9]{2}-(?:(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])|(?:1[89]|20)[0-9]{2})(?![0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        n = int(ch) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """From each at sign outwards: the same matches as from left to right, in linear time."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in CLASS:
            start -= 1
        if at >= end and start < at and (m := DOMAIN.match(text, at)):
            end = m.end()
            out.append((start, end))
        elif at >= end:
            end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    if not CUE.search(text):
        return []
    out = [("email", *x) for x in _emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub(r"[\x20-]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(DIGITS.findall(m[0])) <= 15]
    return out


# --- the network -----------------------------------------------------------


def encode(text: str) -> np.ndarray:
    """Printable ASCII by itself; then white space, other letters, anything else."""
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = np.where((code >= 33) & (code < 127), code - 33 + 4, 3).astype(np.int16)
    out[(code == 32) | ((code >= 9) & (code <= 13))] = 1
    out[(code >= 0xC0) & (code < 0x250)] = 2
    return out


VOCABULARY, TAGS = 4 + 94, 1 + len(KINDS)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """Parameters, each with the two directions first where they differ."""

    def __init__(self, seed: int = SEED):
        r, h = np.random.default_rng(seed), HIDDEN
        self.p = {
            "input": r.normal(0, 0.3, (2, VOCABULARY, 4 * h)),
            "state": r.normal(0, 0.5 / np.sqrt(h), (2, h, 4 * h)),
            "bias": np.concatenate([np.zeros((2, 1, h)), np.ones((2, 1, h)), np.zeros((2, 1, 2 * h))], axis=2),
            "output": r.normal(0, 0.3, (2, h, TAGS)),
            "tag": np.zeros(TAGS),
            "move": np.eye(TAGS) * 0.5,
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def run(self, ids: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """Emissions (time, batch, tag) for ids (batch, time); id 0 is padding."""
        p, h = self.p, HIDDEN
        n, steps = ids.shape
        both = np.stack([ids, ids[:, ::-1]])
        state = np.zeros((2, n, h), np.float32)
        cell = np.zeros_like(state)
        hidden, kept = np.empty((steps, 2, n, h), np.float32), []
        which = np.arange(2)[:, None]
        for t in range(steps):
            z = p["input"][which, both[:, :, t]] + state @ p["state"] + p["bias"]
            gates, new = _sigmoid(z[..., : 3 * h]), np.tanh(z[..., 3 * h :])
            i, f, o = gates[..., :h], gates[..., h : 2 * h], gates[..., 2 * h :]
            before = cell
            cell = f * cell + i * new
            squashed = np.tanh(cell)
            state = o * squashed
            hidden[t] = state
            if keep:
                kept.append((i, f, o, new, before, squashed))
        emit = hidden[:, 0] @ p["output"][0] + hidden[::-1, 1] @ p["output"][1] + p["tag"]
        return emit, [both, hidden, kept]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Best tags (batch, time) by Viterbi."""
        emit, _ = self.run(ids)
        steps, n, _ = emit.shape
        back = np.empty((steps, n, TAGS), np.int8)
        best = emit[0]
        for t in range(1, steps):
            paths = best[:, :, None] + self.p["move"][None]
            back[t] = paths.argmax(1)
            best = paths.max(1) + emit[t]
        tags = np.empty((n, steps), np.int8)
        tags[:, -1] = best.argmax(1)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[t][np.arange(n), tags[:, t]]
        return tags

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """CRF loss and its gradient, averaged over the batch."""
        p, h = self.p, HIDDEN
        emit, (both, hidden, kept) = self.run(ids, keep=True)
        steps, n, _ = emit.shape
        lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
        ahead, behind = np.empty_like(emit), np.empty_like(emit)
        ahead[0], behind[-1] = emit[0], 0
        for t in range(1, steps):
            ahead[t] = lse(ahead[t - 1][:, :, None] + p["move"], 1) + emit[t]
            s = steps - 1 - t
            behind[s] = lse(p["move"][None] + (emit[s + 1] + behind[s + 1])[:, None, :], 2)
        total = lse(ahead[-1], 1)
        rows = np.arange(n)
        gold = emit.transpose(1, 0, 2)[rows[:, None], np.arange(steps), tags].sum(1) + p["move"][tags[:, :-1], tags[:, 1:]].sum(1)
        d_emit = np.exp(ahead + behind - total[None, :, None])
        step, row = np.arange(steps)[:, None], rows[None, :]
        d_emit[step, row, tags.T] -= 1
        moved = ahead[:-1, :, :, None] + p["move"] + (emit + behind)[1:, :, None, :] - total[:, None, None]
        d_move = np.exp(moved).sum((0, 1))
        np.add.at(d_move, (tags[:, :-1], tags[:, 1:]), -1)
        d_emit /= n
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["move"] = d_move / n
        g["tag"] = d_emit.sum((0, 1))
        g["output"][0] = np.tensordot(hidden[:, 0], d_emit, ((0, 1), (0, 1)))
        g["output"][1] = np.tensordot(hidden[::-1, 1], d_emit, ((0, 1), (0, 1)))
        d_hidden = np.stack([d_emit @ p["output"][0].T, (d_emit @ p["output"][1].T)[::-1]], axis=1)
        d_state = np.zeros((2, n, h), np.float32)
        d_cell = np.zeros_like(d_state)
        d_gates = np.empty((2, steps, n, 4 * h), np.result_type(d_emit, d_state))
        for t in range(steps - 1, -1, -1):
            i, f, o, new, before, squashed = kept[t]
            ds = d_hidden[t] + d_state
            dc = d_cell + ds * o * (1 - squashed**2)
            dz = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), ds * squashed * o * (1 - o), dc * i * (1 - new**2)], axis=2)
            d_cell = dc * f
            d_state = dz @ p["state"].transpose(0, 2, 1)
            d_gates[:, t] = dz
        g["bias"] = d_gates.sum((1, 2))[:, None]
        for d in range(2):
            shown = np.zeros((steps * n, VOCABULARY), d_gates.dtype)
            shown[np.arange(steps * n), both[d].T.ravel()] = 1
            g["state"][d] = np.tensordot(hidden[:-1, d], d_gates[d, 1:], ((0, 1), (0, 1)))
            g["input"][d] = shown.T @ d_gates[d].reshape(steps * n, -1)
        return float((total - gold).mean()), g

    def fit(self, ids: np.ndarray, tags: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.03) -> Tagger:
        r = np.random.default_rng(SEED)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, steps = 0, epochs * -(-len(ids) // batch)
        for _ in range(epochs):
            for part in np.array_split(r.permutation(len(ids)), -(-len(ids) // batch)):
                _, g = self.loss(ids[part], tags[part])
                size = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
                step += 1
                for k in self.p:
                    v = g[k] * min(1.0, 5.0 / (size + 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.99 * second[k] + 0.01 * v**2
                    move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                    self.p[k] = (self.p[k] - rate * (1 - 0.9 * step / steps) * move).astype(np.float32)
        return self


# --- labelled windows ------------------------------------------------------


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _invent(r: random.Random, kind: str) -> str:
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8)))
    if kind == "email":
        user = r.choice([word(), word() + r.choice("._-+") + word(), word() + "." + _digits(r, 2), word() + _digits(r, r.randint(1, 4))])
        return user + "@" + word() + r.choice(["", _digits(r, 1)]) + "." + r.choice(["com", "org", "net", "de", "example.com", "co.uk"])
    if kind == "ip":
        return ".".join(str(r.randint(0, 255)) for _ in range(4))
    if kind == "card":
        number = r.choice("3456") + _digits(r, 14)
        number += next(c for c in "0123456789" if luhn(number + c))
        return r.choice([number, number, " ".join(number[i : i + 4] for i in (0, 4, 8, 12)), "-".join(number[i : i + 4] for i in (0, 4, 8, 12))])
    a, b, c, pair = _digits(r, 3), _digits(r, 3), _digits(r, 4), lambda: _digits(r, 2)
    return r.choice([
        f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{r.randint(30, 99)} {a} {b}{c}", f"+1-{a}-{b}-{c}",
        f"{a}-{b}-{c}", f"{a}-{b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a}.{b}.{c}", f"0{a} {b}{c}", f"0{a} {b}{c}", f"0{pair()} {c}{_digits(r, 4)}", f"(0{a}) {b}{c}",
        f"+{r.randint(30, 99)} {pair()} {c} {_digits(r, 4)}", f"0{r.randint(1, 9)} {pair()} {pair()} {pair()} {pair()}",
    ])


def _isbn(r: random.Random) -> str:
    group, last = r.choice("01234579"), r.choice("0123456789")
    publisher = r.randint(2, 6)
    title = f"{group}-{_digits(r, publisher)}-{_digits(r, 8 - publisher)}-{last}"
    return r.choice([f"978-{title}", f"978-{title}", f"979-{title}", title, f"{title[:-1]}X", f"978 {title.replace('-', ' ')}", f"978{_digits(r, 10)}"])


def _dates(r: random.Random) -> str:
    """A date, a time, or a range of them."""
    year, month, day = (lambda: r.randint(1900, 2030)), (lambda: f"{r.randint(1, 12):02d}"), (lambda: f"{r.randint(1, 28):02d}")
    one = r.choice([lambda: f"{year()}-{month()}-{day()}", lambda: f"{year()}-{month()}-{day()}", lambda: f"{day()}.{month()}.{year()}", lambda: f"{month()}/{day()}/{year()}", lambda: str(year())])
    between = r.choice([" - ", " - ", "-", " to ", " \u2013 ", "/"])
    return r.choice([one(), one() + between + one(), one() + between + one(), f"{one()} {day()}:{month()}:{day()}", f"{year()}-{month()}-{day()}T{month()}:{day()}:{day()}", f"{year()}{month()}{day()}-{_digits(r, 4)}"])


def _order(r: random.Random) -> str:
    """Numbers of orders, invoices and parts."""
    n, letters = (lambda k: _digits(r, k)), r.choice(["ORD", "INV", "PO", "SKU", "No. ", "Order "])
    return r.choice([
        f"{n(3)}-{n(7)}-{n(7)}", f"{letters}-{r.randint(2000, 2030)}-{n(6)}", f"{letters}{n(8)}", f"#{n(r.randint(6, 10))}", f"{n(5)}-{n(5)}", f"{letters}{n(4)}-{n(4)}",
        f"{n(2)}-{n(7)}", f"{r.randint(1, 999)},{n(3)},{n(3)}", f"{r.randint(1, 99)} {n(3)} {n(3)}", f"{r.randint(1, 89)}.{n(4)} {r.randint(1, 179)}.{n(4)}",
    ])


def _decoy(r: random.Random) -> str:
    """Things with digits that are nobody's data."""
    hexes = "".join(r.choice("0123456789abcdef") for _ in range(r.choice([18, 32, 40])))
    form = r.random()
    if form < 0.6:
        return _isbn(r) if form < 0.2 else _dates(r) if form < 0.4 else _order(r)
    return r.choice([
        f"version {r.randint(1, 9)}.{r.randint(0, 20)}", f"Version {r.randint(1, 4)}.{r.randint(0, 9)}.", f"BY-NC {r.randint(1, 4)}.0",
        str(r.randint(1, 9999)), f"password={hexes}",
        f'token = "{hexes}"', "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), f"{r.randint(1, 999)},{_digits(r, 3)}",
        f"{r.randint(1, 99)}.{r.randint(0, 99)}%", f"@{hexes[:6]}", f"{r.randint(1, 12)}:{r.randint(10, 59)}", _digits(r, r.randint(5, 12)), f"#{r.randint(1, 99)}",
    ])


def labelled(texts: list[str], n: int = TRAIN_WINDOWS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Windows of real text with base spans and invented spans and decoys set among the words."""
    r = random.Random(seed)
    texts = [t for t in texts if t.strip()] or ["nothing to see here, only words and more words"]
    ids, tags = np.zeros((n, WINDOW), np.int16), np.zeros((n, WINDOW), np.int64)
    for row in range(n):
        text = r.choice(texts)
        at = r.randrange(max(1, len(text) - WINDOW))
        pieces, marks = re.split(r"(?<=[\x20\n])", text[at : at + WINDOW]), []
        for _ in range(r.choice([0, 1, 2, 3])):
            kind = r.choice(DRAWN)
            where = r.randrange(len(pieces) + 1)
            pieces.insert(where, (_invent(r, kind) if kind else _decoy(r)) + r.choice([" ", " ", ". ", ", ", "\n"]))
            marks = [(w + (w >= where), k) for w, k in marks] + [(where, kind)]
        window, label = "".join(pieces), np.zeros(sum(map(len, pieces)), np.int64)
        for kind, a, b in base_spans(window):
            label[a:b] = 1 + KINDS.index(kind)
        for where, kind in marks:
            if kind:
                a = sum(map(len, pieces[:where]))
                label[a : a + len(pieces[where].rstrip().rstrip(".,"))] = 1 + KINDS.index(kind)
        cut = r.randrange(max(1, len(window) - WINDOW)) if r.random() < 0.5 else 0
        window, label = window[cut : cut + WINDOW], label[cut : cut + WINDOW]
        ids[row, : len(window)], tags[row, : len(window)] = encode(window), label
    return ids, tags


# --- whole texts -----------------------------------------------------------


def owners(length: int, at: np.ndarray) -> np.ndarray:
    """For each position of a text the window in whose middle it lies most nearly: the text's ends are no windows' edges, and the earlier one wins ties."""
    last = at // STRIDE
    before = np.maximum(last - 1, 0)

    def middle(window: np.ndarray) -> np.ndarray:
        i, size = at - window * STRIDE, np.minimum(WINDOW, length - window * STRIDE)
        at_end = (window * STRIDE + WINDOW >= length) & (i >= size - WINDOW // 2)
        return np.where(((window == 0) & (i < WINDOW // 2)) | at_end, WINDOW, np.minimum(i, WINDOW - 1 - i))

    return np.where(middle(before) >= middle(last), before, last)


def tags_of(tagger: Tagger, texts: list[str], everything: bool = False) -> list[np.ndarray]:
    """Tags of each text's characters, -1 where not computed: all if ``everything``, else those that spans with a cue depend on."""
    coded, tags, wanted, done = [], [], [], []
    for text in texts:
        cues = np.array([m.start() for m in CUE.finditer(text)], np.int64)
        code = encode(text) if len(cues) or everything else np.zeros(0, np.int16)
        coded.append(code)
        tags.append(np.full(len(code), -1, np.int8))
        wanted.append(np.unique(owners(len(code), np.arange(len(code)) if everything else cues)) if len(code) else cues)
        done.append(set())
    jobs, reach = [(k, int(w)) for k, windows in enumerate(wanted) for w in windows], 1
    for k, w in jobs:
        done[k].add(w)
    while jobs:
        following = set()
        for at in range(0, len(jobs), BATCH):
            part = jobs[at : at + BATCH]
            ids = np.zeros((len(part), WINDOW), np.int16)
            for row, (k, w) in enumerate(part):
                x = coded[k][w * STRIDE : w * STRIDE + WINDOW]
                ids[row, : len(x)] = x
            for (k, w), got in zip(part, tagger.decode(ids), strict=True):
                place = np.arange(w * STRIDE, min(w * STRIDE + WINDOW, len(coded[k])))
                own = place[owners(len(coded[k]), place) == w]
                tags[k][own] = got[own - w * STRIDE]
                # what lies next to a tag may belong to its run
                tagged = own[got[own - w * STRIDE] > 0]
                for side in (-1, 1):
                    beside = tagged + side
                    beside = beside[(beside >= 0) & (beside < len(tags[k]))]
                    for v in np.unique(owners(len(tags[k]), beside)).tolist():
                        if v != w and v not in done[k]:
                            # a long run is followed by ever more windows at once
                            following.update((k, v + side * i) for i in range(reach))
        last = [-(-len(c) // STRIDE) for c in coded]
        jobs = sorted((k, w) for k, w in following if 0 <= w < last[k] and w not in done[k])
        for k, w in jobs:
            done[k].add(w)
        reach = min(2 * reach, 64)
    return tags


def tag_spans(tagger: Tagger, texts: list[str], everything: bool = False) -> list[list[tuple[str, int, int]]]:
    """Spans of each text, from overlapping windows reconciled over the whole of it."""
    out = []
    for text, t in zip(texts, tags_of(tagger, texts, everything), strict=True):
        spans, t = [], np.maximum(t, 0)
        if t.any():
            edges = np.flatnonzero(np.diff(np.concatenate([[0], t, [0]])))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if t[a]:
                    piece = text[a:b]
                    a, b = int(a + len(piece) - len(piece.lstrip())), int(b - len(piece) + len(piece.rstrip()))
                    if plausible(KINDS[t[a] - 1], text[a:b]):
                        spans.append((KINDS[t[a] - 1], a, b))
        out.append(spans)
    return out


def plausible(kind: str, piece: str) -> bool:
    """What every labelled span of a kind satisfies; the decoder is held to it."""
    digits = len(DIGITS.findall(piece))
    if kind == "email":
        return re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@.]{2,}", piece) is not None
    if kind == "ip":
        return re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", piece) is not None
    if kind == "card":
        return 16 <= digits <= 19 and re.fullmatch(r"[0-9][0-9\x20-]+[0-9]", piece) is not None and luhn(re.sub(r"[\x20-]", "", piece))
    if DATE.search(piece):
        return False
    return 8 <= digits <= 15 and re.fullmatch(r"[+(]?[0-9][\x20().0-9-]+[0-9]", piece) is not None and not re.fullmatch(r"[0-9]+", piece)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def fit(docs: DataFrame) -> Tagger:
    """Train on windows from anywhere in the whole texts of a bounded sample of the documents; only the windows reach the driver."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("length(text) > 0")
    picked = least_hashes(rows, SAMPLE_DOCS, "doc_id", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, x in zip(b.column("h").to_pylist(), b.column("text"), strict=True):
                r, text = random.Random(h), x.as_py()
                starts = [r.randrange(max(1, len(text) - WINDOW + 1)) for _ in range(SAMPLE_WINDOWS)]
                out.append([text[at : at + WINDOW] for at in starts])
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(out, pa.list_(pa.string()))], ["h", "windows"])

    chosen = rows.withColumn("h", row_hash("doc_id", "text")).where(F.col("h").isin(picked)).select("h", "text")
    found = map_arrow(chosen, cut, "h long, windows array<string>").groupBy("h").agg(F.first("windows").alias("windows"))
    return Tagger().fit(*labelled([w for r in sorted(found.collect()) for w in r.windows]))


def find(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """doc_id, base and added spans as arrays of (kind, start, end, text)."""
    packed = pickle.dumps(tagger)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pickle.loads(packed)
        for b in batches:
            for at in range(0, max(1, b.num_rows), 500):
                part = b.slice(at, 500)
                texts = [x or "" for x in part.column("text").to_pylist()]
                base = [base_spans(x) for x in texts]
                more = []
                for found, known in zip(tag_spans(t, texts), base, strict=True):
                    more.append([s for s in found if all(s[2] <= a or s[1] >= z for _, a, z in known)])
                rows = lambda all_spans: pa.array([[{"kind": k, "start": a, "end": z, "value": x[a:z]} for k, a, z in s] for s, x in zip(all_spans, texts, strict=True)], pa.list_(span))  # noqa: E731, B023
                every = [[*x, *y] for x, y in zip(base, more, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), rows(base), rows(more), pa.array([hashlib.sha256(joined(s).encode()).hexdigest() for s in base]), pa.array([joined(s) for s in every])],
                    ["doc_id", "base", "added", "base_sha256", "spans"],
                )

    kind = "array<struct<kind:string,start:long,end:long,value:string>>"
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, f"doc_id long, base {kind}, added {kind}, base_sha256 string, spans string")


def digest(docs: DataFrame) -> DataFrame:
    found = find(docs, fit(docs))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in KINDS], "base_sha256", "spans")
