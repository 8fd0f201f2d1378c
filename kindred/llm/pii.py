"""Personal data: a character-level bidirectional LSTM with CRF transitions beside exact base patterns.

Base spans come from patterns for each kind (leftmost, not overlapping, checked, never retried) and always stay. The
network reads characters: each of ASCII by itself, others by a hash of the code point. A text is cut into windows of
WINDOW characters that overlap by WINDOW - STRIDE, more than the usual datum. Every window is decoded by itself (Viterbi
over emissions and transitions); a window whose emissions prove that no path with tags beats "nothing" needs no
recursion for that. Each span found carries its gain, the score by which its path beats "nothing".

Windows are reconciled globally: spans that their windows' edges cut and that meet are joined, one that an edge cuts
yields to a span of its kind that another window sees across the edge, and of all spans of a text the set without
overlaps and with the largest sum of gains is kept. Spans are trimmed of white space and stops
and then checked for what a network can't count: an address of mail has an at-sign, written or spelt; a card's 13 to
19 digits pass Luhn; a phone has 7 to 15 digits; an internet address parses. Those that overlap no base span are added.

Training: windows drawn from anywhere in the whole texts of at most TRAIN_DOCS documents (those with the lowest hashes
of their ids), with generated data of every kind put between their words. Labels are the places where data were put,
which include forms that the base patterns miss (no country code, spelt signs, other separators, hexadecimal
addresses, data that run into each other), and the base spans of the texts.

Defined cases: a null or empty text has no spans; rows that repeat get equal spans; an empty table gives no rows and
trains on generated text alone. Places count code points, ends are exclusive. Columns other than doc_id and text are
kept as they are by ``find_spans`` and ``masked``, whatever their names.
"""

from __future__ import annotations

import bisect
import ipaddress
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from kindred.llm import remembered, textscan
from kindred.llm.training import Adam, softsign

KINDS = ["email", "ip", "card", "phone"]
TAGS = 1 + len(KINDS)
WINDOW, STRIDE = 448, 384
BATCH = 512
HIDDEN = 8
TRAIN_DOCS = 400
ASCII, HASHED = 128, 64
CHARACTERS = ASCII + HASHED

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns by start, then kind. Time is linear in the text: an address is found from its sign @."""
    found: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append(("email", start, match.end()))
            free = match.end()
        else:
            free = at + 1  # no address can begin at or run over this sign
        at = text.find("@", free)
    if _DIGIT.search(text):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.groups())]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def characters(text: str) -> np.ndarray:
    """The network's input for each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < ASCII, points, ASCII + ((points * np.uint32(0x9E3779B1)) >> np.uint32(26))).astype(np.uint8)


def _turned(n: np.ndarray, steps: int) -> np.ndarray:
    """(steps, B) places that turn the first n of each column around and leave the rest."""
    t = np.arange(steps)[:, None]
    return np.where(t < n, n - 1 - t, t)


class Network:
    """Arrays of both directions lie side by side (first axis); the second one reads each window turned around."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        f = lambda *s, scale: r.normal(0, scale, s).astype(np.float32)
        self.p = {
            "in": f(2, CHARACTERS, 4 * HIDDEN, scale=0.5), "u": f(2, HIDDEN, 4 * HIDDEN, scale=0.25), "out": f(2, HIDDEN, TAGS, scale=0.3),
            "bias": np.zeros(TAGS, np.float32), "turn": f(TAGS, TAGS, scale=0.1), "begin": np.zeros(TAGS, np.float32),
        }
        self.p["in"][:, :, HIDDEN : 2 * HIDDEN] += 1.0  # gates that keep the state begin open

    def emissions(self, kinds: np.ndarray, n: np.ndarray, keep: bool = False):
        """kinds: (T, B) inputs of windows of n characters each. (T, B, TAGS) scores of tags; past n they mean nothing."""
        p, h4 = self.p, 4 * HIDDEN
        steps, batch = kinds.shape
        even = not keep and bool((n == steps).all())
        back = None if even else _turned(n, steps)
        way = (kinds, kinds[::-1]) if even else np.stack([kinds, np.take_along_axis(kinds, back, 0)])
        kind = p["in"].dtype
        h, c = np.zeros((2, batch, HIDDEN), kind), np.zeros((2, batch, HIDDEN), kind)
        s, tmp, small = np.empty((2, batch, h4), kind), np.empty((2, batch, h4), kind), np.empty_like(c)
        scores, cache = np.empty((steps, 2, batch, TAGS), kind), []
        for t in range(steps):
            for d in (0, 1):
                np.take(p["in"][d], way[d][t], axis=0, out=s[d], mode="clip")
            np.matmul(h, p["u"], out=tmp)
            s += tmp
            np.abs(s, out=tmp)
            tmp += 1
            s /= tmp  # softsign; a gate is half of 1 + its value
            gates = s[..., : 3 * HIDDEN]
            gates += 1
            before = c.copy() if keep else c
            np.multiply(s[..., :HIDDEN], s[..., 3 * HIDDEN :], out=small)
            c = np.multiply(c, s[..., HIDDEN : 2 * HIDDEN], out=None if keep else c)
            c += small
            c *= 0.5
            np.abs(c, out=small)
            small += 1
            np.divide(c, small, out=small)
            was = h
            h = np.multiply(small, s[..., 2 * HIDDEN : 3 * HIDDEN], out=None if keep else h)
            h *= 0.5
            np.matmul(h, p["out"], out=scores[t])
            if keep:
                cache.append((was, before, s.copy(), c, small.copy(), h))
        e = scores[:, 0] + (scores[::-1, 1] if even else scores[:, 1][back, np.arange(batch)])
        e += p["bias"]
        return (e, way, back, cache) if keep else e

    def _back(self, de: np.ndarray, way: np.ndarray, back: np.ndarray, cache: list) -> dict[str, np.ndarray]:
        p, steps, batch = self.p, de.shape[0], de.shape[1]
        d_out = np.stack([de, np.take_along_axis(de, back[:, :, None], 0)], axis=1)  # (T, 2, B, TAGS)
        grads = {"out": np.zeros_like(p["out"]), "u": np.zeros_like(p["u"])}
        da = np.empty((steps, 2, batch, 4 * HIDDEN), p["in"].dtype)
        dh, dc = np.zeros((2, batch, HIDDEN), da.dtype), np.zeros((2, batch, HIDDEN), da.dtype)
        out_t, u_t = p["out"].transpose(0, 2, 1), p["u"].transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            was, before, s, c, shown, h = cache[t]
            grads["out"] += np.matmul(h.transpose(0, 2, 1), d_out[t])
            dh = dh + np.matmul(d_out[t], out_t)
            i, k, o, g = (s[..., j * HIDDEN : (j + 1) * HIDDEN] for j in range(4))  # i, k, o are twice the gates
            dc = dc + 0.5 * dh * o * (1 - np.abs(shown)) ** 2
            ds = np.concatenate([0.5 * dc * g, 0.5 * dc * before, 0.5 * dh * shown, 0.5 * dc * i], axis=2)
            plain = s.copy()
            plain[..., : 3 * HIDDEN] -= 1
            da[t] = ds * (1 - np.abs(plain)) ** 2
            grads["u"] += np.matmul(was.transpose(0, 2, 1), da[t])
            dh, dc = np.matmul(da[t], u_t), 0.5 * dc * k
        grads["in"] = np.zeros_like(p["in"])
        for d in (0, 1):
            kinds, flat = way[d].reshape(-1), da[:, d].reshape(-1, 4 * HIDDEN)
            order = np.argsort(kinds, kind="stable")
            first = np.flatnonzero(np.diff(kinds[order].astype(np.int64), prepend=-1))
            grads["in"][d][kinds[order][first]] = np.add.reduceat(flat[order], first, axis=0)
        return grads

    def loss_gradients(self, kinds: np.ndarray, n: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log-likelihood of tags (T, B) under the CRF, by the forward-backward recursions."""
        e, way, back, cache = self.emissions(kinds, n, keep=True)
        steps, batch = kinds.shape
        there = (np.arange(steps)[:, None] < n).astype(np.float64)
        turn, begin = self.p["turn"].astype(np.float64), self.p["begin"].astype(np.float64)
        # likelihoods, scaled at every step
        e64 = e.astype(np.float64)
        top = e64.max(2, keepdims=True)
        like, move = np.exp(e64 - top), np.exp(turn)
        a, z = np.empty((steps, batch, TAGS)), np.ones((steps, batch, TAGS))
        scale = np.ones((steps, batch))
        a[0] = np.exp(begin) * like[0]
        scale[0] = a[0].sum(1)
        a[0] /= scale[0][:, None]
        for t in range(1, steps):
            new = (a[t - 1] @ move) * like[t]
            scale[t] = new.sum(1)
            a[t] = np.where(there[t][:, None] > 0, new / scale[t][:, None], a[t - 1])
        for t in range(steps - 2, -1, -1):
            new = ((like[t + 1] * z[t + 1]) @ move.T) / scale[t + 1][:, None]
            z[t] = np.where(there[t + 1][:, None] > 0, new, 1.0)
        total = ((np.log(scale) + top[..., 0]) * there).sum(0)
        one = np.zeros((steps, batch, TAGS))
        np.put_along_axis(one, tags[:, :, None], 1.0, 2)
        one *= there[:, :, None]
        d = (a * z * there[:, :, None] - one) / batch
        pairs = a[:-1, :, :, None] * move * ((like[1:] * z[1:]) * (there[1:] / scale[1:])[:, :, None])[:, :, None, :]
        gold_pairs = one[:-1, :, :, None] * one[1:, :, None, :]
        d_turn = (pairs.sum((0, 1)) - gold_pairs.sum((0, 1))) / batch
        gold = (one * e64).sum((0, 2)) + (gold_pairs * turn).sum((0, 2, 3)) + one[0] @ begin
        d = d.astype(e.dtype)
        grads = {"turn": d_turn.astype(e.dtype), "begin": d[0].sum(0), "bias": d.sum((0, 1))} | self._back(d, way, back, cache)
        return float((total - gold).mean()), grads

    def viterbi(self, e: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The best tags (T, B) of windows of n characters with emissions (T, B, TAGS); 0 past their ends."""
        turn, best = self.p["turn"].T.copy(), self.p["begin"] + e[0]
        steps, batch = e.shape[:2]
        back = np.zeros((steps, batch, TAGS), np.uint8)
        last = np.empty_like(best)  # at each window's end
        for t in range(1, steps):
            last[n == t] = best[n == t]
            come = best[:, None, :] + turn  # (B, to, from)
            back[t] = come.argmax(2)
            best = come.max(2) + e[t]
        last[n == steps] = best[n == steps]
        tags, now, each = np.zeros((steps, batch), np.int64), last.argmax(1), np.arange(batch)
        for t in range(steps - 1, -1, -1):
            inside = t < n
            tags[t] = np.where(inside, now, 0)
            now = np.where(inside, back[t, each, now], now)
        return tags

    def _most(self, margin: np.ndarray) -> np.ndarray:
        """An upper bound of any path's advantage over no tags at all: the best run of tags, at the cheapest transitions.

        margin: (T, B), by how much the best tag's emission beats that of none.
        """
        turn, begin = self.p["turn"] - self.p["turn"][0, 0], self.p["begin"] - self.p["begin"][0]
        within = float(turn[1:, 1:].max())
        run = best = margin[0] + within
        for row in margin[1:]:
            run = np.maximum(run, 0) + row
            run += within
            best = np.maximum(best, run)
        return best - within + max(float(turn[0, 1:].max()), float(begin[1:].max())) + max(float(turn[1:, 0].max()), 0.0)

    def _gain(self, e: np.ndarray, a: int, b: int, k: int) -> float:
        """By how much the score with tag k from a to b beats that without."""
        turn, begin, n = self.p["turn"], self.p["begin"], len(e)
        gain = float((e[a:b, k] - e[a:b, 0]).sum()) + (b - a - 1) * float(turn[k, k] - turn[0, 0])
        gain += float(turn[0, k] - turn[0, 0]) if a else float(begin[k] - begin[0])
        return gain + (float(turn[k, 0] - turn[0, 0]) if b < n else 0.0)

    def spans(self, texts: list[str]) -> list[list[Span]]:
        """Reconciled spans of each text."""
        at = np.cumsum([0, *map(len, texts)])
        kinds = characters("".join(texts))
        n = np.diff(at)
        count = np.where(n > 0, np.maximum(1, -(-(n - (WINDOW - STRIDE)) // STRIDE)), 0)
        row = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        first = at[:-1][row] + k * STRIDE
        size = np.minimum(WINDOW, n[row] - k * STRIDE)
        found: list[list[tuple[int, int, int, float, bool, bool]]] = [[] for _ in texts]
        order = np.argsort(-size, kind="stable")  # windows of like length together
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            t = np.arange(int(size[some].max()))[:, None]
            inside = t < size[some]
            e = self.emissions(kinds[np.where(inside, first[some] + t, 0)], size[some])
            margin = np.maximum(np.maximum(e[:, :, 1], e[:, :, 2]), np.maximum(e[:, :, 3], e[:, :, 4])) - e[:, :, 0]
            able = np.flatnonzero(self._most(np.where(inside, margin, -1e9)) >= 0)
            if not len(able):
                continue
            best = self.viterbi(e[:, able], size[some[able]])
            for c in np.flatnonzero(best.any(0)).tolist():
                w = int(some[able[c]])
                m, start = int(size[w]), int(first[w] - at[row[w]])
                own, tags = e[:m, able[c]], best[:m, c]
                edges = [0, *(np.flatnonzero(np.diff(tags)) + 1).tolist(), m]
                for a, b in zip(edges, edges[1:]):
                    if tags[a]:
                        cut_left, cut_right = a == 0 and start > 0, b == m and start + m < n[row[w]]
                        found[row[w]].append((start + a, start + b, int(tags[a]), self._gain(own, a, b, int(tags[a])), cut_left, cut_right))
        return [[(KINDS[k - 1], a, b) for a, b, k in reconciled(x)] if x else [] for x in found]


def reconciled(found: list[tuple[int, int, int, float, bool, bool]]) -> list[tuple[int, int, int]]:
    """(start, end, tag) of the best spans without overlaps. found: start, end, tag, gain, cut on the left, on the right."""
    joined: list[tuple[int, int, int, float, bool, bool]] = []
    for s in sorted(found):
        for i in range(len(joined) - 1, max(-1, len(joined) - 9), -1):  # what overlaps begins shortly before
            o = joined[i]
            if o[2] != s[2] or not o[0] <= s[0] < o[1]:
                continue
            if s[4] and o[5]:  # one window cuts the end, the next one the beginning: both see one datum
                joined[i] = (o[0], max(o[1], s[1]), o[2], o[3] + s[3], o[4], s[5])
                break
            if s[4]:  # the window before sees past the edge that cuts s
                break
            if o[5]:  # the next window sees past the edge that cuts o
                joined[i] = s
                break
        else:
            joined.append(s)
    joined.sort(key=lambda s: (s[1], s[0]))
    ends = [s[1] for s in joined]
    best = [(0.0, -1, 0)]  # of the first i spans: the sum, the last one taken, how many come before it
    for i, s in enumerate(joined):
        before = bisect.bisect_right(ends, s[0], 0, i)
        take = best[before][0] + s[3]
        best.append((take, i, before) if take > best[i][0] else (best[i][0], -1, i))
    out, i = [], len(joined)
    while i:
        _, taken, i = best[i]
        if taken >= 0:
            out.append(joined[taken][:3])
    return out[::-1]


def generated(r: np.random.Generator) -> tuple[str, str]:
    """A made-up datum: kind and text. About half of them are of forms that the base patterns miss."""
    pick = lambda *options: str(r.choice(options))
    digits = lambda n: "".join(map(str, r.integers(0, 10, n)))
    word = lambda: "".join(chr(97 + c) for c in r.integers(0, 26, int(r.integers(2, 9))))
    shape = lambda form: "".join(digits(1) if c == "#" else c for c in form)
    kind, missed = KINDS[int(r.integers(len(KINDS)))], r.random() < 0.5
    if kind == "email":
        local = word() + (pick(".", "_", "-", "") + (digits(2) if r.random() < 0.5 else word()) if r.random() < 0.8 else "")
        host = f"{word()}{digits(1) if r.random() < 0.4 else ''}.{word() + '.' if r.random() < 0.4 else ''}{pick('com', 'org', 'net', 'de', 'fr')}"
        if missed and r.random() < 0.3:
            host = pick("ü", "ö", "é", "ñ") + host
            return kind, f"{local}@{host}"
        return kind, f"{local}{pick(' (at) ', ' [at] ', '(at)', '[at]', ' @ ') if missed else '@'}{host}"
    if kind == "ip":
        if not missed:
            return kind, ".".join(str(x) for x in r.integers(0, 256, 4))
        part = lambda: f"{int(r.integers(1, 65536)):x}"
        whole = ":".join(part() for _ in range(8))
        return kind, whole if r.random() < 0.5 else ":".join(part() for _ in range(int(r.integers(1, 5)))) + "::" + ":".join(part() for _ in range(int(r.integers(1, 3))))
    if kind == "card":
        body = digits(int(r.choice([14, 15, 15, 15, 18])))
        body += next(c for c in "0123456789" if luhn(body + c))
        between = pick(".", "/", "  ") if missed else pick("", "", " ", "-")
        return kind, between.join(body[i : i + 4] for i in range(0, len(body), 4))
    if missed:
        return kind, shape(pick("(0##) ###-####", "0## #######", "###-###-####", "(###) ###-####", "0###/######", "00## ## #######", "0##-#######"))
    return kind, shape(pick("+1 (###) ###-####", "+## ### #######", "+##.###.###.####", "+1-###-###-####", "+###########"))


def decoy(r: np.random.Generator) -> str:
    """What is no personal datum: hexadecimal and mixed identifiers, numbers, dates, times, versions, addresses of pages."""
    hexadecimal = "".join(r.choice(list("0123456789abcdef"), int(r.integers(6, 45))))
    digits = "".join(map(str, r.integers(0, 10, int(r.integers(1, 12)))))
    return str(r.choice([
        hexadecimal, hexadecimal.upper(), "sk_" + hexadecimal, f'token = "{hexadecimal}"', "key-" + hexadecimal[:12], digits, digits[:2] + "." + digits[2:], f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}",
        f"v{digits[:1]}.{digits[1:2]}.{digits[2:3]}", f"https://www.{hexadecimal[:6]}.com/{digits}", f"{digits[:3]}%", f"({digits[:4]})", f"{digits[:2]}:{digits[2:4]}", f"{digits[:1]}.0.",
        f"({digits[:3]}, {digits[3:6]})", "@" + hexadecimal[:5], "at", "(at)", f"{digits[:2]}:{digits[2:4]}:{digits[4:6]}", f"+{digits[:2]}", f"no. {digits[:5]}", f"{digits[:3]}-{digits[3:6]}",
    ]))


def training_windows(texts: list[str], r: np.random.Generator, windows: int = 3000, length: int = 150) -> list[tuple[np.ndarray, np.ndarray]]:
    """Inputs and tags of windows drawn from anywhere in the texts, with generated data put in between words."""
    out = []
    sizes = np.array([max(1, len(t)) for t in texts], float)
    for i in r.choice(len(texts), windows, p=np.sqrt(sizes) / np.sqrt(sizes).sum()).tolist():
        text = texts[i]
        a = int(r.integers(max(1, len(text) - length)))
        b = min(len(text), a + int(r.integers(20, length)))
        base = [(s, e, k) for k, s, e in base_spans(text[max(0, a - 200) : b + 200])]
        base = [(s - min(a, 200), e - min(a, 200), k) for s, e, k in base]  # places within the window
        plain, known = text[a:b], np.zeros(b - a, np.int64)
        for s, e, k in base:
            known[max(0, s) : max(0, e)] = 1 + KINDS.index(k)
        gaps = [j for j, ch in enumerate(plain) if ch == " " and not known[j]]
        parts, tags, last = [], [], 0
        puts = sorted(r.choice(gaps, min(len(gaps), int(r.integers(0, 4))), replace=False).tolist()) if gaps else []
        for j in puts:
            parts.append(plain[last : j + 1])
            tags.append(known[last : j + 1])
            last = j + 1
            for _ in range(int(r.choice([1, 1, 2]))):
                kind, datum = generated(r) if r.random() < 0.6 else ("", decoy(r))
                shown = datum + str(r.choice([" ", " ", " ", ". ", ", ", "\n", "!! ", " | "]))
                parts.append(shown)
                tags.append(np.where(np.arange(len(shown)) < len(datum), 1 + KINDS.index(kind) if kind else 0, 0))
        parts.append(plain[last:])
        tags.append(known[last:])
        whole = "".join(parts)
        if whole:
            out.append((characters(whole), np.concatenate(tags)))
    return out


def train(texts: list[str], steps: int = 700, batch: int = 64, rate: float = 0.02, seed: int = 1) -> Network:
    r, net = np.random.default_rng(seed), Network(seed)
    letters = lambda: "".join(chr(97 + c) for c in r.integers(0, 26, int(r.integers(1, 12))))
    made = [" ".join([letters() + str(r.choice(["", "", "", "", ",", ".", "!"])) for _ in range(60)]) for _ in range(40)]
    windows = training_windows([*(t for t in texts if t), *made], r)
    windows.sort(key=lambda w: len(w[0]))
    adam = Adam(net.p, rate)
    for k in range(steps):
        adam.rate = rate * min(1.0, 2.0 * (1 - k / steps))
        middle = int(r.integers(len(windows)))
        near = np.unique(np.clip(middle + r.integers(-3 * batch, 3 * batch, batch), 0, len(windows) - 1))  # of like length
        some = [windows[i] for i in near]
        n = np.array([len(w[0]) for w in some])
        kinds, tags = (np.zeros((int(n.max()), len(some)), np.int64) for _ in "kt")
        for j, (a, b) in enumerate(some):
            kinds[: n[j], j], tags[: n[j], j] = a, b
        _, grads = net.loss_gradients(kinds, n, tags)
        adam.step(grads)
    return net


_AT = re.compile(r"@|\(at\)|\[at\]")


def _address(shown: str) -> bool:
    try:
        ipaddress.ip_address(shown)
    except ValueError:
        return False
    return True


_EDGE = " \t\r\n\x0b\x0c.,;:!?|\"'"


def added_spans(found: list[Span], text: str, base: list[Span]) -> list[Span]:
    """The network's spans without white space and stops at their edges, checked, that overlap no base span."""
    out = []
    for kind, a, b in found:
        while a < b and text[a] in _EDGE:
            a += 1
        while a < b and text[b - 1] in _EDGE:
            b -= 1
        if a == b or any(a < e and s < b for _, s, e in base):
            continue
        shown = text[a:b]
        digits = "".join(c for c in shown if c in "0123456789")
        if kind == "email":
            able = _AT.search(shown)
        elif kind == "card":
            able = 13 <= len(digits) <= 19 and luhn(digits)
        elif kind == "phone":
            able = 7 <= len(digits) <= 15
        else:
            able = _address(shown)
        if not able:
            continue
        out.append((kind, a, b))
    return out


def fit(docs: DataFrame, limit: int = TRAIN_DOCS) -> Network:
    """A network trained with the whole texts of at most limit documents."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL AND doc_id IS NOT NULL")
    ids = rows.select("doc_id").distinct().withColumn("h", F.xxhash64("doc_id", F.lit(5))).orderBy("h", "doc_id").limit(limit)  # limit rows
    texts = rows.join(F.broadcast(ids), "doc_id").groupBy("h", "doc_id").agg(F.min("text").alias("text")).collect()
    return train([r["text"] for r in sorted(texts, key=lambda r: (r["h"], r["doc_id"]))])


def _spans_of(network: Network, texts: list[str]) -> Iterator[list[tuple[str, int, int, bool]]]:
    """All spans of each text by start, then kind, and whether they are base spans."""
    for text, found in zip(texts, network.spans(texts)):
        base = base_spans(text)
        spans = [(*s, True) for s in base] + [(*s, False) for s in added_spans(found, text, base)]
        yield sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_spans(docs: DataFrame, name: str = "pii_spans", network: Network | None = None) -> DataFrame:
    """docs and a column: an array of (kind, start, end, base) by start, then kind. A column of that name is replaced."""
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(network or fit(docs))
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered.forget()
        for batch in batches:
            for part in textscan.slices(batch, "text", 2_000_000):
                texts = [t or "" for t in part.column("text").cast(pa.string()).to_pylist()]
                rows = [[dict(zip(("kind", "start", "end", "base"), s)) for s in spans] for spans in _spans_of(shared.value, texts)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, pa.list_(struct))], names=[*part.schema.names, name])

    kind = docs.sparkSession.createDataFrame([], "s array<struct<kind:string,start:bigint,end:bigint,base:boolean>>").schema[0].dataType
    return docs.mapInArrow(find, StructType([*docs.schema.fields, StructField(name, kind)]))


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def digest_columns(found: DataFrame, name: str = "pii_spans") -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and all spans as text."""
    base = F.filter(name, lambda s: s["base"])
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.filter(base, _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col(name)).alias("spans"))


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each span (overlapping ones as one) replaced by the kind of its first in brackets."""
    out, done = [], 0
    i = 0
    while i < len(spans):
        start, end, kind = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][1])
            i += 1
        out += [text[done:start], f"[{kind.upper()}]"]
        done = end
    return "".join([*out, text[done:]])


def masked(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """docs with every span of text masked; a null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(network or fit(docs))

    def hide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered.forget()
        for batch in batches:
            for part in textscan.slices(batch, "text", 2_000_000):
                at = part.schema.get_field_index("text")
                texts = part.column(at).to_pylist()
                found = _spans_of(shared.value, [t or "" for t in texts])
                shown = [t if t is None or not spans else mask(t, [(a, b, kind) for kind, a, b, _ in spans]) for t, spans in zip(texts, found)]
                yield part.set_column(at, part.schema.field(at), pa.array(shown, part.column(at).type))

    return docs.mapInArrow(hide, docs.schema)
