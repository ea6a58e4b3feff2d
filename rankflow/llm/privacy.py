"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The patterns (email, ip, card, phone) are found leftmost and non-overlapping per kind, in time linear in the text. The
network is trained in numpy, on the driver, from made-up sentences whose spans are labelled by construction; they hold
the patterns' own forms, forms that the patterns miss ("name [at] host.org", "12 . 34 . 56 . 78", national phone numbers)
and look-alikes that are nobody's data (dates, prices, versions, keys). It reads windows of 96 characters, two of which
overlap by half, around every character that each labelled form must contain: a digit, an @ or a bracketed "at"; text
without those has nothing the network can label, so leaving it out drops nothing. Each window gets its best tag path and
the marginals of it; windows are then reconciled over the whole text: spans of one kind that window edges cut are joined
to one stretch where they meet, which, unless a whole span lies there, is read again in a window wide enough for it and
what is around it, and wider again while it is still cut. Of overlapping spans the surer stays, spans that touch a
pattern's span are not added, and nothing longer than LONGEST characters is an address or a number.

The weights are kept in the shared folder under a hash of this module's text and settings, so they are trained once.

Defined cases: null text is empty; ids may be null or repeat; every row gives a row; texts of any length are read as a
whole; of equally sure spans the first stays; an empty table gives an empty result; personal_data reads doc_id and text
only, mask keeps all columns whatever they are called.
"""

from __future__ import annotations

import bisect
import hashlib
import inspect
import random
import re
import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankflow.llm.common import new_path, shared_dir

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_AT = re.compile(r"@|[\[(] ?at ?[\])]")
_TRIGGER = re.compile(r"[0-9@]|[\[(] ?at ?[\])]")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """The patterns' spans by kind, then start."""
    out = list(_emails(text))
    if not _DIGIT.search(text):
        return out
    # A number of 4,000 digits can't be read as an int; its length alone says it is over 255.
    small = lambda part: len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


# The network. Tags: 0 is outside, 2k+1 begins kind k, 2k+2 goes on with it.
WINDOW, STRIDE = 96, 48
#: Characters of an added span at most, and those around it that a second reading takes in on each side at least.
LONGEST, MARGIN = 400, 32
TAGS = 1 + 2 * len(KINDS)
_SIGNS = 130  # ASCII, 128 for all else, 129 beyond the text


def signs(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(codes, 128).astype(np.int64)


class Tagger:
    """Embedding, an LSTM each way, a linear layer and CRF transitions."""

    def __init__(self, seed: int = 0, size: int = 10, hidden: int = 16, dtype: type = np.float64):
        r, self.hidden, self.dtype = np.random.default_rng(seed), hidden, dtype
        make = lambda *shape: r.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {"embed": r.normal(0, 0.5, (_SIGNS, size)), "out": make(2 * hidden, TAGS), "bias": np.zeros(TAGS), "move": np.zeros((TAGS, TAGS)), "first": np.zeros(TAGS)}
        for way in ("f", "b"):
            self.p |= {f"x{way}": make(size, 4 * hidden), f"h{way}": make(hidden, 4 * hidden), f"b{way}": np.concatenate((np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)))}
        self.p = {k: v.astype(dtype) for k, v in self.p.items()}

    def _both(self, name: str) -> np.ndarray:
        """Both ways' weights, what comes out first."""
        return np.stack((self.p[name + "f"].T, self.p[name + "b"].T))

    def _lstm(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        """x (time, way, size, batch), the second way from behind -> h, and what the way back needs. Gates: in, forget, out, new."""
        n, (steps, batch) = self.hidden, x.shape[::3]
        wide, moves = self._both("x") @ x, self._both("h")
        wide += self._both("b")[:, :, None]
        # A sigmoid is a tanh of half its argument.
        half = np.concatenate((np.full(3 * n, 0.5), np.ones(n))).astype(self.dtype)[:, None]
        h, c = np.zeros((steps + 1, 2, n, batch), self.dtype), np.zeros((steps + 1, 2, n, batch), self.dtype)
        acts, squashed = np.empty((steps, 2, 4 * n, batch), self.dtype), np.empty((steps, 2, n, batch), self.dtype)
        for t in range(steps):
            a = acts[t]
            np.matmul(moves, h[t], out=a)
            a += wide[t]
            a *= half
            np.tanh(a, out=a)
            gates = a[:, : 3 * n]
            gates *= 0.5
            gates += 0.5
            np.multiply(a[:, n : 2 * n], c[t], out=c[t + 1])
            c[t + 1] += a[:, :n] * a[:, 3 * n :]
            np.tanh(c[t + 1], out=squashed[t])
            np.multiply(a[:, 2 * n : 3 * n], squashed[t], out=h[t + 1])
        return h[1:], (x, h, c, acts, squashed)

    def _lstm_back(self, dh: np.ndarray, kept: tuple, grads: dict) -> np.ndarray:
        x, h, c, acts, squashed = kept
        n, steps = self.hidden, len(x)
        # All that does not depend on what comes from later steps, at once: into the gates in and forget by the cell, and so on.
        i, f, o, new = (acts[:, :, k * n : (k + 1) * n] for k in range(4))
        by = np.concatenate((new * i * (1 - i), c[:-1] * f * (1 - f), squashed * o * (1 - o), i * (1 - new * new)), 2)
        through = o * (1 - squashed * squashed)
        moves = self._both("h").transpose(0, 2, 1)
        dz, carry_h, carry_c = by, np.zeros_like(h[0]), np.zeros_like(c[0])
        for t in range(steps - 1, -1, -1):
            d = dh[t] + carry_h
            dc = d * through[t]
            dc += carry_c
            z = dz[t].reshape(2, 4, n, -1)
            z[:, :2] *= dc[:, None]
            z[:, 2] *= d
            z[:, 3] *= dc
            carry_h, carry_c = moves @ dz[t], dc * f[t]
        for k, way in enumerate("fb"):
            grads[f"x{way}"] = np.tensordot(x[:, k], dz[:, k], ((0, 2), (0, 2)))
            grads[f"h{way}"] = np.tensordot(h[:-1, k], dz[:, k], ((0, 2), (0, 2)))
            grads[f"b{way}"] = dz[:, k].sum((0, 2))
        return self._both("x").transpose(0, 2, 1) @ dz

    def emissions(self, ids: np.ndarray) -> tuple[np.ndarray, tuple]:
        """ids (batch, time) -> scores (time, batch, tags)."""
        x = self.p["embed"][ids.T].transpose(0, 2, 1)
        h, kept = self._lstm(np.stack((x, x[::-1]), 1))
        both = np.concatenate((h[:, 0], h[::-1, 1]), 1).transpose(0, 2, 1)
        return both @ self.p["out"] + self.p["bias"], (both, kept)

    def _chains(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward sums over all paths, each step's forward ones put to one: (alpha, beta, after, log of the whole).

        alpha x beta are the marginals; after is what alpha x exp(move) is multiplied with for those of two neighbours.
        """
        top = u.max(2, keepdims=True)
        e, move = np.exp(u - top), np.exp(self.p["move"])
        alpha, beta, after, scale = np.empty_like(u), np.ones_like(u), np.empty_like(u), np.empty_like(top)
        for t in range(len(u)):
            a = e[t] * (alpha[t - 1] @ move if t else np.exp(self.p["first"]))
            scale[t] = a.sum(1, keepdims=True)
            np.divide(a, scale[t], out=alpha[t])
        for t in range(len(u) - 1, 0, -1):
            np.multiply(e[t], beta[t], out=after[t])
            after[t] /= scale[t]
            np.matmul(after[t], move.T, out=beta[t - 1])
        return alpha, beta, after, (np.log(scale) + top).sum((0, 2))

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        u, (both, kept) = self.emissions(ids)
        alpha, beta, after, whole = self._chains(u)
        steps, batch = u.shape[:2]
        t, b, y = np.arange(steps)[:, None], np.arange(batch)[None, :], tags.T
        gold = u[t, b, y].sum(0) + self.p["first"][y[0]] + self.p["move"][y[:-1], y[1:]].sum(0)
        du = alpha * beta
        grads = {"first": du[0].sum(0) - np.bincount(y[0], minlength=TAGS)}
        pair = np.exp(self.p["move"]) * np.tensordot(alpha[:-1], after[1:], ((0, 1), (0, 1)))
        grads["move"] = pair - np.bincount((y[:-1] * TAGS + y[1:]).ravel(), minlength=TAGS * TAGS).reshape(TAGS, TAGS)
        du[t, b, y] -= 1
        grads["out"], grads["bias"] = np.tensordot(both, du, ((0, 1), (0, 1))), du.sum((0, 1))
        dboth = self.p["out"] @ du.transpose(0, 2, 1)
        dx = self._lstm_back(np.stack((dboth[:, : self.hidden], dboth[::-1, self.hidden :]), 1), kept, grads)
        dx = dx[:, 0] + dx[::-1, 1]
        grads["embed"] = np.stack([np.bincount(ids.T.ravel(), dx[:, k].ravel(), len(self.p["embed"])) for k in range(dx.shape[1])], 1)
        return float((whole - gold).mean()), {k: (g / batch).astype(self.dtype) for k, g in grads.items()}

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids (batch, time) -> the best tags and how sure each is (its marginal)."""
        u, _ = self.emissions(ids)
        alpha, beta, _, _ = self._chains(u)
        best, came = u[0] + self.p["first"], []
        for t in range(1, len(u)):
            options = best[:, :, None] + self.p["move"]
            came.append(options.argmax(1))
            best = u[t] + options.max(1)
        tags = [best.argmax(1)]
        for step in reversed(came):
            tags.append(step[np.arange(len(ids)), tags[-1]])
        path = np.array(tags[::-1])
        return path.T, np.take_along_axis(alpha * beta, path[:, :, None], 2)[:, :, 0].T


def _made_up(r: random.Random) -> tuple[str, str]:
    """A piece of personal data as (kind, text)."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda a, z: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(a, z)))
    kind = r.choice(KINDS)
    if kind == "email" and r.random() < 0.25:  # as long as they come
        name = r.choice(".._-").join(w(1, 12) for _ in range(r.randint(2, 9)))
        host = ".".join(w(2, 12) for _ in range(r.randint(2, 7))) + r.choice((".com", ".org", ".edu", ".de"))
        return kind, name + r.choice(("@", " @ ", " [at] ", "[at]", " (at) ", "(at)", "( at )")) + host
    if kind == "email":
        name = r.choice((w(2, 9), f"{w(2, 7)}.{d(2)}", f"{w(1, 6)}.{w(2, 8)}", f"{w(3, 8)}{d(2)}", f"{w(2, 5)}_{w(2, 6)}"))
        host = f"{w(3, 9)}{r.choice(('', d(1)))}.{r.choice(('example.com', 'com', 'org', 'net', 'de', 'fr', 'es', 'co.uk'))}"
        return kind, name + r.choice(("@", "@", "@", " @ ", " [at] ", "[at]", " (at) ", "(at)", "( at )")) + host
    if kind == "ip":
        return kind, r.choice((".", ".", ".", " . ", "[.]", " .")).join(str(r.randint(0, 255)) for _ in range(4))
    if kind == "card":
        body = r.choice("3456") + d(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        return kind, r.choice(("", "", " ", "-", ".", "  ")).join(body[i : i + 4] for i in range(0, 16, 4))
    a, b, c = d(3), d(3), d(4)
    return kind, r.choice((f"+1 ({a}) {b}-{c}", f"+{d(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1-{a}-{b}-{c}", f"+{d(2)}{a}{b}{c}"))


def _look_alike(r: random.Random) -> str:
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    return r.choice((
        f"20{d(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", f"{d(2)}:{d(2)}:{d(2)}", f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", f"{r.randint(1, 999)}.{d(2)}", d(r.randint(1, 6)), f"{r.randint(1, 9)},{d(3)}",
        "".join(r.choice("0123456789abcdef") for _ in range(r.randint(16, 40))), f"page={r.randint(1, 99)}&id={d(4)}", f"@{r.choice(('home', 'once', 'handle'))}", f"[{r.randint(1, 99)}]", f"({d(4)})", f"#{d(5)}", f"{d(3)}-{d(2)}", f"AKIA{d(8)}",
    ))


def training_windows(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n labelled windows: sign ids and tags."""
    r = random.Random(seed)
    parts = ("an", "the", "er", "tion", "ou", "le", "que", "sch", "ung", "ción", "ó", "é", "st", "re", "ing", "ed", "ß")
    ids, tags = np.full((n, WINDOW), 129), np.zeros((n, WINDOW), np.int64)
    for row in range(n):
        if row % 4 == 0:  # four windows of each text
            text, labels = "", []
            while len(text) < 4 * WINDOW:
                x = r.random()
                piece, kind = ("".join(r.choice(parts) for _ in range(r.randint(1, 4))) + r.choice(("", "", "", ",", ".")), None) if x < 0.75 else (_look_alike(r), None) if x < 0.87 else _made_up(r)[::-1]
                k = KINDS.index(kind) if kind else 0
                labels += [0] * len(piece) if kind is None else [2 * k + 1] + [2 * k + 2] * (len(piece) - 1)
                text += piece
                end = r.choice((" ", " ", " ", "\n", ", ", ". "))
                labels += [0] * len(end)
                text += end
        at = r.randint(0, 3 * WINDOW - 1) if r.random() < 0.8 else 0
        upto = at + (WINDOW if r.random() < 0.9 else r.randint(10, WINDOW))
        piece = signs(text[at:upto])
        ids[row, : len(piece)], tags[row, : len(piece)] = piece, labels[at:upto]
    order = np.random.default_rng(seed).permutation(n)
    return ids[order], tags[order]


#: What decides the weights, besides this module's own text.
TRAINING = {"steps": 160, "batch": 96, "seed": 3, "rate": 0.03}


def weights(spark: SparkSession) -> Tagger:
    """The network, from the shared folder if it was trained before.

    Weights are written under a name of their own and then renamed, so that no session reads what another is writing; of several that
    train at once, whose weights are the same, the first rename counts.
    """
    name = hashlib.md5((inspect.getsource(sys.modules[__name__]) + repr(sorted(TRAINING.items()))).encode()).hexdigest()
    hadoop, path = spark._jvm.org.apache.hadoop.fs, f"{shared_dir(spark)}/privacy-weights-{name}"
    done = hadoop.Path(path)
    files = done.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(done):
        net = Tagger(TRAINING["seed"], dtype=np.float32)
        for r in spark.read.schema("name string, shape array<int>, data binary").parquet(path).collect():  # a few thousand numbers
            net.p[r.name] = np.frombuffer(r.data, np.float64).reshape(r.shape).astype(np.float32)
        return net
    net = trained()
    rows = [(k, list(v.shape), v.astype(np.float64).tobytes()) for k, v in net.p.items()]
    own = new_path(spark, "privacy-weights")
    spark.createDataFrame(rows, "name string, shape array<int>, data binary").coalesce(1).write.mode("overwrite").parquet(own)
    if not files.exists(done):
        files.rename(hadoop.Path(own), done)
    return net


@cache
def trained(steps: int = TRAINING["steps"], batch: int = TRAINING["batch"], seed: int = TRAINING["seed"], rate: float = TRAINING["rate"]) -> Tagger:
    """The network after so many Adam steps over made-up windows; the same weights each time."""
    net = Tagger(seed, dtype=np.float32)  # single precision takes less than two thirds of the time
    mean, square = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}
    ids, tags = training_windows(steps * batch // 2, seed)
    for step in range(1, steps + 1):
        own = np.arange((step - 1) * batch, step * batch) % len(ids)
        _, grads = net.gradients(ids[own], tags[own])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        slow = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = g * min(1.0, 5 / (norm + 1e-9))
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.999 * square[k] + 0.001 * g * g
            net.p[k] -= np.float32(slow) * mean[k] / np.float32(1 - 0.9**step) / (np.sqrt(square[k] / np.float32(1 - 0.999**step)) + np.float32(1e-8))
    return net


def windows(text: str) -> list[int]:
    """Where windows start: on the grid of strides, all that hold a trigger."""
    starts, last = [], -1
    for m in _TRIGGER.finditer(text):
        for k in range(max(last + 1, (m.start() - WINDOW) // STRIDE + 1, 0), m.start() // STRIDE + 1):
            starts.append(k * STRIDE)
            last = k
    return starts


def _plausible(kind: str, piece: str) -> bool:
    digits = _digits(piece)
    if kind == "email":
        return bool(_AT.search(piece)) and "." in piece and 6 <= len(piece) <= LONGEST
    if kind == "ip":
        parts = re.findall("[0-9]+", piece)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def _window_spans(start: int, tags: np.ndarray, sure: np.ndarray, size: int) -> Iterator[tuple[float, bool, Span]]:
    """(how sure, cut by an edge, span) of a window's tags."""
    t, width = 0, len(tags)
    while t < width and start + t < size:
        if tags[t] and (tags[t] % 2 or t == 0):
            kind, z = (int(tags[t]) - 1) // 2, t + 1
            while z < width and tags[z] == 2 * kind + 2:
                z += 1
            cut = (t == 0 and start > 0) or (z == width and start + z < size)
            yield float(sure[t:z].min()), cut, (KINDS[kind], start + t, min(start + z, size))
            t = z
        else:
            t += 1


def stretches(found: list[tuple[float, bool, Span]], least: float = 0.5) -> list[Span]:
    """Cut spans of one kind, joined where they meet, that no whole and sure span of their kind touches."""
    whole: dict[str, list[tuple[int, int]]] = {}
    for sure, cut, (kind, a, z) in found:
        if not cut and sure >= least:
            whole.setdefault(kind, []).append((a, z))
    out: list[Span] = []
    for kind, a, z in sorted(s for _, cut, s in found if cut):
        if out and out[-1][0] == kind and a <= out[-1][2]:
            out[-1] = kind, out[-1][1], max(z, out[-1][2])
        else:
            out.append((kind, a, z))
    for spans in whole.values():
        spans.sort()

    def touched(kind: str, a: int, z: int) -> bool:
        spans = whole.get(kind, [])
        at = bisect.bisect_left(spans, (z, z))
        return any(y > a for _, y in spans[max(0, at - 4) : at])  # spans of a kind overlap only from window to window

    return [s for s in out if not touched(*s)]


def reconciled(found: list[tuple[float, bool, Span]], base: list[Span], text: str, least: float = 0.5) -> list[Span]:
    """Of all windows' spans of a text, those to add: whole, sure, plausible, apart from each other and from the base."""
    taken: list[tuple[int, int]] = []  # apart from each other, in order
    for a, z in sorted((a, z) for _, a, z in base):
        if taken and a < taken[-1][1]:
            taken[-1] = taken[-1][0], max(z, taken[-1][1])
        else:
            taken.append((a, z))
    out = []
    for sure, cut, (kind, a, z) in sorted(found, key=lambda x: (x[1], -x[0], x[2][1], -x[2][2])):
        at = bisect.bisect_left(taken, (a, a))
        near = taken[max(0, at - 1) : at + 1]
        if sure < least or cut or any(a < y and x < z for x, y in near) or not _plausible(kind, text[a:z]):
            continue
        taken.insert(at, (a, z))
        out.append((kind, a, z))
    return out


def _read(texts: list[str], jobs: list[tuple[int, int]], width: int, net: Tagger, at_once: int) -> Iterator[tuple[int, list[tuple[float, bool, Span]]]]:
    """(text, spans) of each window (text, start) of a width, in the order of the jobs."""
    at_once = max(1, at_once * WINDOW // width)
    for lo in range(0, len(jobs), at_once):
        own = jobs[lo : lo + at_once]
        ids = np.full((len(own), width), 129)
        for row, (i, start) in enumerate(own):
            piece = signs(texts[i][start : start + width])
            ids[row, : len(piece)] = piece
        tags, sure = net.decode(ids)
        for row, (i, start) in enumerate(own):
            yield i, list(_window_spans(start, tags[row], sure[row], len(texts[i]))) if tags[row].any() else []


def all_spans(texts: list[str], net: Tagger, at_once: int = 512) -> Iterator[tuple[list[Span], list[Span]]]:
    """(base spans, added spans) of each text."""
    base, found = [base_spans(t) for t in texts], [[] for _ in texts]
    for i, spans in _read(texts, [(i, start) for i, t in enumerate(texts) for start in windows(t)], WINDOW, net, at_once):
        found[i] += spans
    todo = [(i, s) for i in range(len(texts)) if found[i] for s in stretches(found[i])]
    while todo:
        by_width: dict[int, list[tuple[int, Span, int]]] = {}
        for i, (kind, a, z) in todo:
            if z - a <= LONGEST:
                width = -(-(z - a + 2 * MARGIN) // STRIDE) * STRIDE
                by_width.setdefault(width, []).append((i, (kind, a, z), max(0, (a + z - width) // 2)))
        todo = []
        for width, own in by_width.items():
            for (i, (kind, a, z), _), (_, spans) in zip(own, _read(texts, [(i, start) for i, _, start in own], width, net, at_once), strict=True):
                spans = [s for s in spans if s[2][0] == kind and s[2][1] < z and a < s[2][2]]
                found[i] += [s for s in spans if not s[1]]
                if cut := [s[2] for s in spans if s[1]]:  # it goes on beyond a window that was wide enough for what was known of it
                    todo.append((i, (kind, min(a, *(s[1] for s in cut)), max(z, *(s[2] for s in cut)))))
    for i, text in enumerate(texts):
        yield base[i], reconciled(found[i], base[i], text) if found[i] else []


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row: doc_id, n_email, n_ip, n_card, n_phone (of the patterns), base_sha256, spans, n_added."""
    net = weights(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, (base, more) in zip(batch.column(0).to_pylist(), all_spans([t or "" for t in batch.column(1).to_pylist()], net), strict=True):
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((doc, *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(base + more), len(more)))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def masked_text(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, put as [KIND]."""
    out, at, last = [], 0, -1
    for kind, a, z in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < last:
            at = last = max(last, z)
            continue
        out += [text[at:a], f"[{kind.upper()}]"]
        at = last = z
    return "".join([*out, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """The documents with personal data masked; n_chars, where there is one, follows the new text. Null texts stay null."""
    net = weights(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index("text")
            texts = batch.column(i).to_pylist()
            made = [None if t is None else masked_text(t, base + more) if base or more else t for t, (base, more) in zip(texts, all_spans([t or "" for t in texts], net), strict=True)]
            batch = batch.set_column(i, batch.schema.field(i), pa.array(made, batch.schema.field(i).type))
            if (j := batch.schema.get_field_index("n_chars")) >= 0:
                sizes = [n if t is None else len(t) for t, n in zip(made, batch.column(j).to_pylist(), strict=True)]
                batch = batch.set_column(j, batch.schema.field(j), pa.array(sizes, batch.schema.field(j).type))
            yield batch

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))
