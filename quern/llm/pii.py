r"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions for what they miss.

The network (embedding, one LSTM each way, a linear layer, a linear-chain CRF over O and B/I of four kinds) is written and
trained in numpy from labelled spans.  ``labelled_examples`` writes ``TRAIN_EXAMPLES`` of them (the documented bound): personal data in
many groupings and separators, with look-alikes (dates, prices, versions, serial numbers, hashes) left unlabelled.  ``python -m quern.llm.pii``
trains on them and writes ``pii_model.npz``, which ``default_model`` loads; the same seed gives the same model.

Whole texts are read in windows of 128 characters that overlap by half, so a span of fewer than 64 characters lies whole in
one of them.  Each window is decoded (Viterbi).  A longer span touches a window's edge: that window grows, by doubling, until the span ends inside it.
The windows' spans are reconciled over the whole text by weighted interval scheduling, a span's weight being its summed margin over O.
A method's span must hold a digit or an @, pass its kind's check (a card's digits by Luhn, a phone's number of digits, an address's numbers, one @
with a dotted host) and not touch a base span.  So a window without digit and @ can't contribute and isn't decoded, which changes no result.

One Arrow pass, no shuffle; the model (60 kB) travels with the function.  Texts of one Arrow batch are decoded together, windows
in blocks of ``BLOCK``, so memory follows the batch.

Defined cases: a null text is empty; offsets are code points, end exclusive; broken UTF-8 is replaced; null ids are kept;
repeated rows have equal results; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import ipaddress
import os
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, BLOCK = 128, 64, 1024
TRAIN_EXAMPLES, EPOCHS, SEED = 6144, 13, 11
TAGS = 1 + 2 * len(KINDS)
_DIM, _HIDDEN = 16, 28
MODEL = os.path.join(os.path.dirname(os.path.abspath(__file__)), "pii_model.npz")
_FORBIDDEN = -1e4

_LABELS = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@]")
_SPACES = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The pattern's leftmost matches, found from each @ outwards: the local part is the run before it, cut at the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (c := text[start - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            start -= 1
        if start < at and (m := _LABELS.match(text, at)):
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    found = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not re.search("[0-9]", text):
        return found
    if "." in text:
        found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-9:] if len(p) > 9 else p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_SPACES.sub("", m[0])) <= 15]
    return found


# --- the network


def _ids(text: str, width: int = WINDOW) -> np.ndarray:
    """0: beyond the text; ASCII by code; 128 letters, 129 other signs beyond ASCII."""
    raw = np.frombuffer(text[:width].encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = np.zeros(width, dtype=np.int64)
    out[: len(raw)] = np.where(raw < 128, np.maximum(raw, 1), np.where((raw > 0x2FF) & (raw < 0x370) | (raw > 0x1FFF) & (raw < 0x2C00), 129, 128))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Model:
    """Parameters by name; ``forward`` gives emissions (time, window, tag)."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        glorot = lambda a, b: rng.uniform(-1, 1, (a, b)).astype(np.float32) * np.sqrt(6 / (a + b)).astype(np.float32)
        h, d = _HIDDEN, _DIM
        self.p = {"E": rng.normal(0, 0.3, (130, d)).astype(np.float32), "Wo": glorot(2 * h, TAGS), "bo": np.zeros(TAGS, np.float32), "T": np.zeros((TAGS, TAGS), np.float32), "S": np.zeros(TAGS, np.float32)}
        for way in "fb":
            self.p |= {f"X{way}": glorot(d, 4 * h), f"H{way}": glorot(h, 4 * h), f"B{way}": np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32)}
        self.mask = np.zeros((TAGS, TAGS), np.float32)
        self.first = np.zeros(TAGS, np.float32)
        for j in range(2, TAGS, 2):  # I of a kind follows only its B or I; a window may begin inside a span
            self.mask[[i for i in range(TAGS) if i not in (j - 1, j)], j] = _FORBIDDEN

    def _way(self, ids: np.ndarray, way: str, keep: bool) -> tuple[np.ndarray, list]:
        p, h_size = self.p, _HIDDEN
        given = p["E"] @ p[f"X{way}"] + p[f"B{way}"]
        steps = ids.shape[1]
        h = c = np.zeros((len(ids), h_size), np.float32)
        out, kept = np.empty((steps, len(ids), h_size), np.float32), []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = given[ids[:, t]] + h @ p[f"H{way}"]
            gates = _sigmoid(z[:, : 3 * h_size])
            i, f, o, g = gates[:, :h_size], gates[:, h_size : 2 * h_size], gates[:, 2 * h_size :], np.tanh(z[:, 3 * h_size :])
            before_h, before_c = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                kept.append((t, i, f, o, g, tc, before_h, before_c))
        return out, kept

    def forward(self, ids: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        f, kf = self._way(ids, "f", keep)
        b, kb = self._way(ids, "b", keep)
        both = np.concatenate([f, b], axis=2)
        return both @ self.p["Wo"] + self.p["bo"], (both, kf, kb)

    def _back(self, ids: np.ndarray, way: str, kept: list, d_out: np.ndarray, grad: dict) -> None:
        p, n = self.p, len(ids)
        dh = dc = np.zeros((n, _HIDDEN), np.float32)
        d_given = np.zeros((130, 4 * _HIDDEN), np.float32)
        for t, i, f, o, g, tc, before_h, before_c in reversed(kept):
            dh = dh + d_out[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            grad[f"H{way}"] += before_h.T @ dz
            np.add.at(d_given, ids[:, t], dz)
            dh, dc = dz @ p[f"H{way}"].T, dc * f
        grad[f"B{way}"] += d_given.sum(axis=0)
        grad[f"X{way}"] += p["E"].T @ d_given
        grad["E"] += d_given @ p[f"X{way}"].T

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of the tags (window, time), and its gradient."""
        p, n = self.p, len(ids)
        emit, (both, kf, kb) = self.forward(ids, keep=True)
        steps, move = len(emit), p["T"] + self.mask
        alpha, beta = np.empty_like(emit), np.zeros_like(emit)
        alpha[0] = emit[0] + p["S"]
        for t in range(1, steps):
            alpha[t] = np.logaddexp.reduce(alpha[t - 1][:, :, None] + move, axis=1) + emit[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = np.logaddexp.reduce(move + (emit[t + 1] + beta[t + 1])[:, None, :], axis=2)
        log_z = np.logaddexp.reduce(alpha[-1], axis=1)
        d_emit = np.exp(alpha + beta - log_z[:, None])
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        for t in range(steps - 1):
            grad["T"] += np.exp(alpha[t][:, :, None] + move + (emit[t + 1] + beta[t + 1])[:, None, :] - log_z[:, None, None]).sum(axis=0)
        rows = np.arange(n)
        gold = p["S"][tags[:, 0]].sum() + sum(emit[t][rows, tags[:, t]].sum() for t in range(steps)) + move[tags[:, :-1], tags[:, 1:]].sum()
        np.add.at(grad["T"], (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
        grad["S"] = d_emit[0].sum(axis=0) - np.bincount(tags[:, 0], minlength=TAGS)
        for t in range(steps):
            d_emit[t][rows, tags[:, t]] -= 1
        flat = d_emit.reshape(-1, TAGS)
        grad["Wo"], grad["bo"] = both.reshape(-1, 2 * _HIDDEN).T @ flat, flat.sum(axis=0)
        d_both = d_emit @ p["Wo"].T
        self._back(ids, "f", kf, d_both[:, :, :_HIDDEN], grad)
        self._back(ids, "b", kb, d_both[:, :, _HIDDEN:], grad)
        return float((log_z.sum() - gold) / n), {k: (g / n).astype(np.float32) for k, g in grad.items()}

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (window, time) by Viterbi, and each tag's margin over O."""
        emit, _ = self.forward(ids)
        steps, move, n = len(emit), self.p["T"] + self.mask, len(ids)
        best, back = emit[0] + self.p["S"], np.empty((len(emit), n, TAGS), np.int8)
        for t in range(1, steps):
            scores = best[:, :, None] + move
            back[t] = scores.argmax(axis=1)
            best = scores.max(axis=1) + emit[t]
        tags, rows = np.empty((n, steps), np.int8), np.arange(n)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[t][rows, tags[:, t]]
        margin = np.take_along_axis(emit, tags.T[:, :, None].astype(np.int64), axis=2)[:, :, 0].T - emit[:, :, 0].T
        return tags, margin


def encode_example(text: str, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    tags = np.zeros(WINDOW, dtype=np.int64)
    for kind, a, b in spans:
        tags[a:b] = 2 + 2 * kind
        if a < WINDOW:
            tags[a] = 1 + 2 * kind
    return _ids(text), tags


def train(examples: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = EPOCHS, seed: int = SEED, batch: int = 64, rate: float = 0.012) -> Model:
    """Adam over (text of up to 64 characters, labelled spans); the same examples and seed give the same model."""
    model, rng = Model(seed), np.random.default_rng(seed)
    pairs = [encode_example(*e) for e in examples]
    ids, tags = np.stack([a for a, _ in pairs]), np.stack([b for _, b in pairs])
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step, total = 0, epochs * -(-len(ids) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            _, grad = model.loss(ids[own], tags[own])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            step += 1
            now = rate * min(1.0, 2 * (1 - step / (total + 1)))
            for k, g in grad.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.p[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def labelled_examples(n: int = TRAIN_EXAMPLES, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Windows of invented prose with labelled personal data and unlabelled look-alikes."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    some = lambda low, high: int(rng.integers(low, high + 1))
    digits = lambda k: "".join(str(int(d)) for d in rng.integers(0, 10, k))
    letters, plain_letters = "etaoinshrdlucmfwypvbgkéüñ", "etaoinshrdlucmfwypvbgk"

    def word() -> str:
        w = "".join(pick(letters) for _ in range(some(1, 9)))
        return w.upper() if rng.random() < 0.05 else w.capitalize() if rng.random() < 0.15 else w

    def plain(low: int = 2, high: int = 8) -> str:
        w = "".join(pick(plain_letters) for _ in range(some(low, high)))
        return w.capitalize() if rng.random() < 0.1 else w

    def grouped(groups: tuple[int, ...], sep: str) -> str:
        return sep.join(digits(k) for k in groups)

    def card() -> str:
        groups = pick([(4, 4, 4, 4), (4, 4, 4, 4), (4, 4, 4, 4), (4, 6, 5), (16,), (15,), (4, 4, 4, 4, 3), (6, 10)])
        return grouped(groups, pick([" ", "-", ".", "  ", "/", "_", " - ", "\u00a0", "\u2013"]))

    def phone() -> str:
        sep = pick([" ", "-", ".", " ", "-", "/", "\u00a0", " - ", "\u2013"])
        return pick([
            lambda: f"({digits(3)}) {grouped((3, 4), sep)}", lambda: f"({digits(3)}){grouped((3, 4), sep)}", lambda: grouped((3, 3, 4), sep), lambda: grouped((3, 3, 4), sep), lambda: f"0{grouped((3, 3, 4), sep)}", lambda: f"0{grouped((2, 3, 4), sep)}", lambda: f"0{grouped((3, 6), sep)}",
            lambda: f"0{grouped((1, 2, 2, 2, 2), sep)}", lambda: f"00{grouped((2, 2, 7), sep)}", lambda: f"00{grouped((2, 3, 3, 3), sep)}", lambda: f"00{grouped((2, 1, 2, 2, 2, 2), sep)}", lambda: f"+{digits(2)} {grouped((3, 6), sep)}", lambda: f"+1 ({digits(3)}) {grouped((3, 4), sep)}", lambda: f"+{digits(11)}",
            lambda: f"0{digits(2)}/{digits(8)}", lambda: f"0{grouped((4, 6), sep)}", lambda: f"(0{digits(some(2, 4))}) {grouped((3, 4), sep)}", lambda: f"1{sep}{grouped((3, 3, 4), sep)}",
        ])()

    def email() -> str:
        name = pick([plain, lambda: plain() + pick("._-") + plain(), lambda: plain() + digits(2), lambda: plain(1, 1) + "." + plain(3, 10), lambda: plain(6, 20) + pick("._+") + plain(6, 20)])()
        dot = pick([".", ".", ".", " . "])
        host = dot.join([*[plain(2, 10) for _ in range(some(1, 3))], pick(["com", "org", "net", "de", "edu", "fr", "io"])])
        return name + pick(["@", " @ ", " @ ", "@ ", " @", "  @  "]) + host

    def ip() -> str:
        numbers = [str(int(x)) for x in rng.integers(0, 256, 4)]
        six = lambda k: ":".join("".join(pick("0123456789abcdef") for _ in range(some(1, 4))) for _ in range(k))
        return pick([lambda: ".".join(numbers), lambda: " . ".join(numbers), lambda: " . ".join(numbers), lambda: ". ".join(numbers), lambda: six(8), lambda: six(some(1, 4)) + "::" + six(some(1, 3))])()

    def other() -> str:
        year = some(1900, 2030)
        hexed = lambda k: "".join(pick("0123456789abcdef") for _ in range(k))
        return pick([
            lambda: f"{year}-{digits(2)}-{digits(2)}", lambda: f"{year}", lambda: f"{digits(1)}.{digits(2)}", lambda: f"${digits(3)},{digits(3)}.{digits(2)}", lambda: f"v{digits(1)}.{digits(2)}.{digits(1)}", lambda: digits(some(1, 9)), lambda: digits(some(10, 14)), lambda: f"{digits(2)}:{digits(2)}:{digits(2)}",
            lambda: f"{digits(2)}/{digits(2)}/{year}", lambda: f"{digits(2)}.{digits(2)}.{year}", lambda: f"{year}-{digits(2)}-{digits(2)}T{digits(2)}:{digits(2)}:{digits(2)}", lambda: f"{digits(3)} {digits(3)} {digits(3)}", lambda: f"@{plain()}", lambda: f"{digits(1)}-{digits(1)}", lambda: hexed(20), lambda: f'token = "{hexed(40)}"', lambda: hexed(40),
            lambda: f"{digits(1)}, {digits(1)}, {digits(1)}, {digits(2)}", lambda: f"ISBN 978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", lambda: f"{year}-{year + 4}", lambda: f"{digits(2)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", lambda: " ".join(digits(some(1, 5)) for _ in range(5)),
            lambda: f"{digits(1)}.{digits(1)}.", lambda: f"{digits(2)}.{digits(3)}.{digits(3)}", lambda: f"{digits(3)}-{digits(2)}", lambda: f"{digits(1)} @ ${digits(2)}", lambda: f"{hexed(8)}-{hexed(4)}-{hexed(4)}-{hexed(4)}-{hexed(12)}", lambda: f"No. {digits(6)}", lambda: f"{digits(2)},{digits(3)},{digits(3)}", lambda: f"{digits(2)} x {digits(2)} x {digits(3)}", lambda: plain() + digits(some(1, 4)),
        ])()

    makers = (email, ip, card, phone)
    out = []
    while len(out) < n:
        text, spans = "", []
        while len(text) < WINDOW + 40:
            at = rng.random()
            if at < 0.2:
                kind = pick((0, 1, 2, 2, 3, 3, 3, 3))
                value = makers[kind]()
                text += pick(["", "", "", "(", '"', "<", ": "])
                spans.append((kind, len(text), len(text) + len(value)))
                text += value
            else:
                text += other() if at < 0.38 else word()
            text += pick([" ", " ", " ", " ", ", ", ". ", "\n", ": ", ") ", "; ", "!! ", '" ', " | "])
        start = some(0, max(0, len(text) - WINDOW))
        out.append((text[start : start + WINDOW], [(k, max(a - start, 0), min(b - start, WINDOW)) for k, a, b in spans if b > start and a < start + WINDOW]))
    return out


@lru_cache(maxsize=1)
def default_model() -> Model:
    model = Model()
    with np.load(MODEL) as stored:
        model.p = {k: stored[k].astype(np.float32) for k in model.p}
    return model


_ADDRESS = re.compile(r"[0-9]{1,3}(?:[\s.]+[0-9]{1,3}){3}")


def _valid(kind: int, value: str) -> bool:
    """The checks of a kind: the network says where a span lies, these whether its value can be what it says."""
    digits = _SPACES.sub("", value)
    if kind == 0:
        local, _, host = value.partition("@")
        return value.count("@") == 1 and local.strip() != "" and host.strip() != "" and "." in host.strip()[1:-1]
    if kind == 1:
        if ":" in value:
            try:
                return ipaddress.ip_address(value.strip()).version == 6
            except ValueError:
                return False
        return bool(_ADDRESS.fullmatch(value)) and value.count(".") == 3 and all(int(x) <= 255 for x in re.findall("[0-9]+", value))
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and not any(c.isalpha() for c in value) and not (len(digits) == 13 and digits[:3] in ("978", "979"))  # books
    return 9 <= len(digits) <= 15 and not any(c.isalpha() for c in value)


def _may_grow(kind: int, piece: str) -> bool:
    """Whether a span that goes on beyond its window can still pass its kind's check."""
    return len(_SPACES.sub("", piece)) <= 19 if kind in (2, 3) else piece.count("@") <= 1 and len(piece.split()) <= 8


def _reconcile(spans: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (weight, start, end, kind) the disjoint ones of the largest total weight."""
    spans = sorted(set(spans), key=lambda s: (s[2], s[1], s[3]))
    ends, best, take = [s[2] for s in spans], [0.0], []
    for k, (w, a, _, _) in enumerate(spans):
        j = bisect_right(ends, a, 0, k)
        take.append(best[j] + w > best[k])
        best.append(max(best[k], best[j] + w))
    out, k = [], len(spans)
    while k:
        if take[k - 1]:
            _, a, b, kind = spans[k - 1]
            out.append((kind, a, b))
            k = bisect_right(ends, a, 0, k - 1)
        else:
            k -= 1
    return out


def _decoded(tags: np.ndarray, margin: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """(begin, end, kind, summed margin over O) of a window's spans."""
    t, n = 0, len(tags)
    while t < n:
        if tags[t] % 2:  # B
            e = t + 1
            while e < n and tags[e] == tags[t] + 1:
                e += 1
            yield t, e, int(tags[t]) // 2, float(margin[t:e].sum())
            t = e
        else:
            t += 1


def method_spans(texts: list[str], model: Model) -> list[list[tuple[int, int, int]]]:
    """For each text the network's reconciled spans (kind, start, end)."""
    places: list[tuple[int, int]] = []
    for k, text in enumerate(texts):
        starts: set[int] = set()
        for m in _ANCHOR.finditer(text):
            last = m.start() // STRIDE * STRIDE
            starts.update((last, last - STRIDE) if last else (last,))
        places += [(k, s) for s in sorted(starts)]
    found: list[list] = [[] for _ in texts]
    longer: dict[tuple[int, int], tuple[int, int]] = {}

    def take(k: int, start: int, width: int, tags: np.ndarray, margin: np.ndarray) -> None:
        text = texts[k]
        for t, e, kind, weight in _decoded(tags, margin):
            a, b = start + t, start + e
            if t == 0 and a > 0 or e == width and b < len(text):
                # a shorter span lies whole in another window
                if e - t >= STRIDE - 1 and _may_grow(kind, text[a:b]):
                    longer[k, a] = (a, b)
            elif weight > 0:
                value = text[a:b]
                a, b = a + len(value) - len(value.lstrip()), b - len(value) + len(value.rstrip())
                if _valid(kind, text[a:b]) and _ANCHOR.search(text, a, b) and not (text[max(a - 1, 0) : a].isalnum() or text[b : b + 1].isalnum()):
                    found[k].append((weight, a, b, kind))

    for at in range(0, len(places), BLOCK):
        block = places[at : at + BLOCK]
        tags, margin = model.decode(np.stack([_ids(texts[k][s : s + WINDOW]) for k, s in block]))
        for row in np.flatnonzero((tags > 0).any(axis=1)):
            take(*block[row], WINDOW, tags[row], margin[row])
    wide = WINDOW
    while longer:
        again, wide = longer, 2 * wide
        longer = {}
        for (k, _), (a, b) in again.items():
            start = max(0, (a + b) // 2 - wide // 2)
            tags, margin = model.decode(_ids(texts[k][start : start + wide], wide)[None])
            take(k, start, wide, tags[0], margin[0])
    return [_reconcile(f) for f in found]


def find(texts: list[str], model: Model) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, all spans) of each text, by kind and start."""
    out = []
    for text, extra in zip(texts, method_spans(texts, model)):
        base = base_spans(text)
        own = [s for s in extra if all(s[2] <= a or b <= s[1] for _, a, b in base)]
        out.append((base, sorted(base + own)))
    return out


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end), kind by its place in ``KINDS``, sorted."""
    given = model or default_model()
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or b"").decode("utf-8", "replace") for t in pc.cast(batch.column(1), pa.binary()).to_pylist()]
            pairs = find(texts, given)
            as_array = lambda j: pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in p[j]] for p in pairs], span)
            yield pa.RecordBatch.from_arrays([batch.column(0), as_array(0), as_array(1)], names=["doc_id", "base", "spans"])

    kind = "array<struct<kind:int,start:bigint,end:bigint>>"
    return df.select(df[id_col].cast("bigint").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, f"doc_id bigint, base {kind}, spans {kind}")


if __name__ == "__main__":
    made = train(labelled_examples(), batch=128)
    np.savez_compressed(MODEL, **{k: v.astype(np.float16) for k, v in made.p.items()})
