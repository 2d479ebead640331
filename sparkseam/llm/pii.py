"""Personal data by fixed patterns and a character-level bidirectional LSTM with CRF transitions.

The patterns give the base spans. The tagger (embedding, one LSTM each way, linear emissions, CRF transitions with
start and end scores, BIO tags of five kinds) is trained in numpy by back-propagation through time from labelled
spans: texts made from a fixed seed that hold personal data and secrets in many notations beside look-alikes (prices,
dates, versions, handles, long numbers). Training takes seconds, happens on the driver once for each process, and the
weights (some 10 kB) travel with the task.

Every text is tagged whole, in windows of WINDOW characters every STRIDE. Each window is decoded by Viterbi: a forward
pass of scores for all, and back pointers for those where the path of O alone isn't the best. Parts of a span that neighbouring windows cut are
joined, and what overlaps is then reconciled over the whole text by weighted interval scheduling on the spans' summed
margins. Spans of the tagger that overlap a base span, or can't be of their kind (`plausible`), are dropped, so base
spans always stay. The kinds are those of the patterns and `secret`, which has no pattern.

Defined results: null counts as empty and has no spans. Repeated rows give repeated results. Ties in the scheduling go
to the spans that end first. Very long texts are tagged window by window. An empty table gives an empty result. Spans
are in code points, end exclusive. Only the named columns are read, so other columns' names can't clash.
"""

from __future__ import annotations

import functools
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseam.llm.batches import parts, small_batches

KINDS = ["email", "ip", "card", "phone", "secret"]
PATTERNED = 4  # kinds that have a base pattern
WINDOW, STRIDE = 160, 128
#: Windows of one block; characters of training windows.
BLOCK, TRAIN_WINDOW = 1024, 96
#: Training: seed, texts, passes, sizes of embedding and of each LSTM.
SEED, TRAIN_TEXTS, PASSES, EMBED, HIDDEN = 7, 2000, 8, 10, 8

_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match that starts inside a run of digits would have started at the run's first digit
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_AT, _DOT = re.compile(r"\s*[\[({<]\s*at\s*[\])}>]\s*", re.IGNORECASE), re.compile(r"\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*", re.IGNORECASE)

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; failing ones are dropped without retries."""
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        s = at
        while s > end and text[s - 1] in _LOCAL:
            s -= 1
        if s < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, s, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if not _DIGIT.search(text):
        return out
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def plausible(kind: int, text: str) -> bool:
    """Whether a span of the tagger can be of its kind at all: address parts, number ranges, checksum, digit counts."""
    digits = "".join(c for c in text if "0" <= c <= "9")
    if kind == 0:
        local, at, domain = _DOT.sub(".", _AT.sub("@", text)).partition("@")
        return bool(at and local.strip() and "." in domain.strip(" .") and "\n" not in text and "@" not in domain)
    if kind == 1:
        parts = re.split(r"\s*\.\s*", _DOT.sub(".", text))
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and re.fullmatch(r"[0-9](?:[ .\-/_]?[0-9])+", text) is not None
    if kind == 3:
        return 9 <= len(digits) <= 15 and re.fullmatch(r"(?:\+|00)?[0-9(][0-9 ().\-/]*[0-9]", text) is not None and len(re.findall(r"[0-9]+", text)) >= 3
    return re.fullmatch(r"[A-Za-z0-9+/=_\-]{12,}", text) is not None and len(digits) >= 3 and sum(c.isalpha() for c in text) >= 3


# ---- the tagger

CHARS = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~"
K = 1 + 2 * len(KINDS)  # O, then B and I of each kind
VOCAB = 8 + len(CHARS)  # 0 pads, 6 is any other character, the last are the letters that hexadecimal numbers have
_TABLE = np.full(128, 6, dtype=np.uint8)
for _c in range(128):
    _ch = chr(_c)
    _TABLE[_c] = 1 if _ch.isdigit() else VOCAB - 1 if _ch in "abcdef" else 2 if _ch.islower() else 3 if _ch.isupper(
        ) else 4 if _ch == "\n" else 5 if _ch.isspace() else 7 + CHARS.index(_ch) if _ch in CHARS else 6
#: BIO order: I follows only B or I of its kind.
ALLOWED = np.array([[j == 0 or j % 2 == 1 or i in (j, j - 1) for j in range(K)] for i in range(K)])


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(points < 128, _TABLE[np.minimum(points, 127)], np.uint8(2))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Weights, and all that runs on them. Windows come as (batch, time) codes."""

    def __init__(self, rng: np.random.Generator):
        def w(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.p = {"embed": w(VOCAB, EMBED), "out": w(2 * HIDDEN, K), "bias": np.zeros(K, np.float32), "trans": np.zeros((K, K), np.float32),
            "first": np.zeros(K, np.float32), "last": np.zeros(K, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": w(EMBED, 4 * HIDDEN), f"h{d}": w(HIDDEN, 4 * HIDDEN), f"c{d}": np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)}

    def lstm(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """x: (time, batch, embed) in reading order. Gates in the order input, forget, output, cell."""
        z = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        out, kept = np.empty((*x.shape[:2], HIDDEN), np.float32), []
        for t in range(len(x)):
            a = z[t] + h @ self.p[f"h{d}"]
            g = _sigmoid(a[:, : 3 * HIDDEN])
            i, f, o, n = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :], np.tanh(a[:, 3 * HIDDEN :])
            was, before = c, h
            c = f * c + i * n
            tc = np.tanh(c)
            h = out[t] = o * tc
            kept.append((i, f, o, n, was, before, tc))
        return out, kept

    def lstm_back(self, x: np.ndarray, d: str, kept: list, dout: np.ndarray, grad: dict) -> np.ndarray:
        dz = np.empty((*x.shape[:2], 4 * HIDDEN), np.float32)
        dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
        for t in range(len(x) - 1, -1, -1):
            i, f, o, n, was, before, tc = kept[t]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz[t] = np.concatenate([dc * n * i * (1 - i), dc * was * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - n * n)], axis=1)
            grad[f"h{d}"] += before.T @ dz[t]
            dh, dc = dz[t] @ self.p[f"h{d}"].T, dc * f
        flat = dz.reshape(-1, 4 * HIDDEN)
        grad[f"x{d}"] += x.reshape(-1, EMBED).T @ flat
        grad[f"c{d}"] += flat.sum(0)
        return dz @ self.p[f"x{d}"].T

    def emissions(self, windows: np.ndarray) -> tuple[np.ndarray, tuple]:
        x = self.p["embed"][windows.T]
        f, kf = self.lstm(x, "f")
        b, kb = self.lstm(x[::-1], "b")
        both = np.concatenate([f, b[::-1]], axis=2)
        return both @ self.p["out"] + self.p["bias"], (x, kf, kb, both)

    def moves(self) -> np.ndarray:
        return np.where(ALLOWED, self.p["trans"], -1e4).astype(np.float32)

    def step(self, windows: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean loss (negative log likelihood of the tag paths) and gradients."""
        e, (x, kf, kb, both) = self.emissions(windows)
        steps, n = e.shape[:2]
        y, moves, rows = tags.T, self.moves(), np.arange(n)
        alpha, beta = np.empty_like(e), np.empty_like(e)
        alpha[0] = self.p["first"] + e[0]
        for t in range(1, steps):
            alpha[t] = _logsumexp(alpha[t - 1][:, :, None] + moves, 1) + e[t]
        beta[-1] = self.p["last"]
        for t in range(steps - 2, -1, -1):
            beta[t] = _logsumexp(moves + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        total = _logsumexp(alpha[-1] + self.p["last"], 1)
        gold = self.p["first"][y[0]] + self.p["last"][y[-1]] + sum(e[t][rows, y[t]] for t in range(steps)) + sum(moves[y[t - 1], y[t]] for t in range(1, steps))
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        at = np.exp(np.clip(alpha + beta - total[None, :, None], -60, 0))
        pair = alpha[:-1, :, :, None] + moves + (e[1:] + beta[1:])[:, :, None, :] - total[None, :, None, None]
        grad["trans"] = np.exp(np.clip(pair, -60, 0)).sum((0, 1))
        np.subtract.at(grad["trans"], (y[:-1].ravel(), y[1:].ravel()), 1)
        grad["trans"] *= ALLOWED
        grad["first"], grad["last"] = at[0].sum(0), at[-1].sum(0)
        np.subtract.at(grad["first"], y[0], 1)
        np.subtract.at(grad["last"], y[-1], 1)
        de = at
        np.put_along_axis(de, y[:, :, None], np.take_along_axis(de, y[:, :, None], 2) - 1, 2)
        grad["out"] = both.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, K)
        grad["bias"] = de.sum((0, 1))
        dboth = de @ self.p["out"].T
        dx = self.lstm_back(x, "f", kf, dboth[:, :, :HIDDEN], grad) + self.lstm_back(x[::-1], "b", kb, dboth[::-1, :, HIDDEN:], grad)[::-1]
        np.add.at(grad["embed"], windows.T, dx)
        return float((total - gold).mean()), {k: v / n for k, v in grad.items()}

    def compiled(self) -> Compiled:
        return Compiled(self)


#: A path must be so much better than that of O alone; rounding of single precision stays below.
LEAST_GAIN = 1e-2


class Compiled:
    """A tagger's weights as inference wants them: the input and recurrent weights of a direction in one matrix, gates by one exponential."""

    def __init__(self, model: Tagger):
        p = model.p
        # sigmoid(x) = 1 / (1 + exp(-x)) and tanh(x) = 1 - 2 / (1 + exp(2 x)), so that one exponential does all four gates
        scale = np.repeat(np.float32([-1, -1, -1, 2]), HIDDEN)
        self.embed = np.ascontiguousarray(p["embed"].T)
        # what is read at a place: the state, the embedding, and 1 for the bias
        self.inner = np.stack([(np.concatenate([p[f"h{d}"], p[f"x{d}"], p[f"c{d}"][None]]) * scale).T for d in "fb"]).astype(np.float32)
        self.out, self.bias = np.ascontiguousarray(p["out"].T), p["bias"][:, None]
        self.moves, self.first, self.last = model.moves(), p["first"], p["last"]

    def hopeful(self, e: np.ndarray) -> np.ndarray:
        """Windows that candidates() can name: the same forward pass with all kinds as one, each score the largest of any kind's.

        Rounded sums keep the order of what is summed, so no score lies below one of candidates().
        """
        begin, inside = np.arange(1, K, 2), np.arange(2, K, 2)
        m, first, last = self.moves, self.first, self.last
        to_o, to_b = (m[begin, 0].max(), m[inside, 0].max()), (m[0, begin].max(), m[np.ix_(begin, begin)].max(), m[np.ix_(inside, begin)].max())
        follow, stay = m[begin, inside].max(), m[inside, inside].max()
        eb, ei = e[:, 1::2].max(1), e[:, 2::2].max(1)
        o, b, i = first[0] + e[0, 0], first[begin].max() + eb[0], first[inside].max() + ei[0]
        none = o.copy()
        for t in range(1, len(e)):
            o, b, i = (np.maximum(np.maximum(o + m[0, 0], b + to_o[0]), i + to_o[1]), np.maximum(np.maximum(o + to_b[0], b + to_b[1]), i + to_b[2]),
                np.maximum(b + follow, i + stay))
            o += e[t, 0]
            b += eb[t]
            i += ei[t]
            none += m[0, 0] + e[t, 0]
        best = np.maximum(np.maximum(o + last[0], b + last[begin].max()), i + last[inside].max())
        return np.flatnonzero(best > none + last[0] + LEAST_GAIN)

    def candidates(self, e: np.ndarray) -> np.ndarray:
        """Windows whose best path is better than that of O alone, from the scores of Viterbi's forward pass."""
        begin, inside = np.arange(1, K, 2), np.arange(2, K, 2)
        open_ = np.append(0, begin)  # O and B follow any tag, I only its own kind's
        moves, follow, stay = self.moves[:, open_, None], self.moves[begin, inside][:, None], self.moves[inside, inside][:, None]
        score = self.first[:, None] + e[0]
        none = score[0].copy()
        for t in range(1, len(e)):
            into = (score[:, None, :] + moves).max(0)
            on = np.maximum(score[begin] + follow, score[inside] + stay)
            score = np.empty_like(score)
            score[open_], score[inside] = into, on
            score += e[t]
            none += self.moves[0, 0] + e[t, 0]
        return np.flatnonzero((score + self.last[:, None]).max(0) > none + self.last[0] + LEAST_GAIN)

    @np.errstate(over="ignore")
    def emissions(self, windows: np.ndarray) -> np.ndarray:
        """(time, tags, batch) of windows (batch, time). An exponential beyond single precision is infinite, and its gate at its end."""
        x = np.ascontiguousarray(windows.T, dtype=np.intp)
        steps, n = x.shape
        read = np.ones((2, HIDDEN + EMBED + 1, n), np.float32)
        h, here = read[:, :HIDDEN], read[:, HIDDEN:-1]
        h[:] = 0
        c, t1, t2 = (np.zeros((2, HIDDEN, n), np.float32) for _ in range(3))
        a = np.empty((2, 4 * HIDDEN, n), np.float32)
        i, f, o, g = (a[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        both = np.empty((steps, 2 * HIDDEN, n), np.float32)
        for t in range(steps):
            np.take(self.embed, x[t], axis=1, out=here[0], mode="clip")
            np.take(self.embed, x[steps - 1 - t], axis=1, out=here[1], mode="clip")
            np.matmul(self.inner, read, out=a)
            np.exp(a, out=a)
            a += 1
            # c = f c + i tanh(g), h = o tanh(c)
            c /= f
            np.divide(2, g, out=t1)
            np.subtract(1, t1, out=t1)
            t1 /= i
            c += t1
            np.add(c, c, out=t2)
            np.exp(t2, out=t2)
            t2 += 1
            np.divide(2, t2, out=t2)
            np.subtract(1, t2, out=t2)
            np.divide(t2, o, out=h)
            both[t, :HIDDEN], both[steps - 1 - t, HIDDEN:] = h[0], h[1]
        return np.matmul(self.out, both) + self.bias

    def decode(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that may hold other tags than O, their Viterbi tags (rows, time), and each place's margin of its tag over O."""
        e = self.emissions(windows)
        rows = self.hopeful(e)
        some, tags, margins = self.paths(e[:, :, rows])
        return rows[some], tags, margins

    def paths(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of emissions."""
        rows = self.candidates(e)
        e = e[:, :, rows].transpose(0, 2, 1)
        steps, n = e.shape[:2]
        back = np.empty((steps, n, K), np.int8)
        score = self.first + e[0]
        for t in range(1, steps):
            all_ = score[:, :, None] + self.moves
            back[t] = all_.argmax(1)
            score = all_.max(1) + e[t]
        tags = np.empty((steps, n), np.int64)
        tags[-1] = (score + self.last).argmax(1)
        at = np.arange(n)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = back[t][at, tags[t]]
        own = np.take_along_axis(e, tags[:, :, None], 2)[:, :, 0]
        return rows, tags.T, (own - e[:, :, 0]).T


# ---- labelled training texts


def _made(rng: np.random.Generator) -> tuple[str, list[Span]]:
    """A text with its labelled spans."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda n: "".join(str(int(rng.integers(10))) for _ in range(n))
    letters = lambda n: "".join(chr(97 + int(rng.integers(26))) for _ in range(n))

    def word() -> str:
        w = "".join(pick(["th", "er", "an", "re", "on", "ti", "é", "ou", "ch", "ü", "st", "ea", "os", "ñ", "la", "de"]) for _ in range(int(rng.integers(1, 5))))
        return pick([w, w, w, w.capitalize(), w + ",", w + ".", w.upper() + "!!", w.upper(), w + "\n"])

    def email() -> str:
        local = pick([letters(5), letters(4) + "." + digits(2), letters(3) + "_" + letters(4), letters(2) + "+" + letters(3), letters(4) + "." + letters(5)])
        host, end = pick(["mail", "post", "corp", letters(6)]) + pick(["", digits(1)]), pick(["example.com", "example.org", "test.net", "org", letters(3)])
        at, dot = pick([("@", "."), ("@", "."), (" @ ", "."), ("@ ", " . "), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("(at)", "."), ("[AT]", "[DOT]")])
        return local + at + (host + "." + end).replace(".", dot)

    def ip() -> str:
        return pick([".", ".", " . ", ". ", "[.]"]).join(str(int(rng.integers(1, 256))) for _ in range(4))

    def card() -> str:
        body = pick(["4", "51", "37", "6011"])
        body += digits(15 - len(body))
        body += next(str(c) for c in range(10) if luhn(body + str(c)))
        sep = pick(["", "", " ", "-", ".", "/"])
        return sep.join(body[k : k + 4] for k in range(0, 16, 4))

    def phone() -> str:
        return pick(["+1 ({}) {}-{}", "+1 {} {} {}", "({}) {}-{}", "{}-{}-{}", "001 {} {} {}", "+44 {} {} {}", "{}.{}.{}", "0049 {} {} {}"]).format(
            digits(3), digits(3), digits(4))

    def secret() -> str:
        drawn = lambda xs, n: "".join(pick(xs) for _ in range(n))
        hexes, both = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        out = pick([drawn(hexes, 40), drawn(hexes, 18), drawn(hexes, 32), drawn(hexes, 64), "AKIA" + drawn(both[:26] + "0123456789", 16),
            drawn(both, 24), drawn(both + "+/", 40), "ghp_" + drawn(both, 36), "sk-" + drawn(both, 32)])
        return out if plausible(4, out) else secret()

    def other() -> str:
        return pick([lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"version {digits(1)}.{digits(1)}.{digits(1)}",
            lambda: f"Version {digits(1)}.{digits(1)}.", lambda: f"${digits(3)}.{digits(2)}", lambda: digits(int(rng.integers(1, 9))),
            lambda: "@" + letters(6), lambda: f"http://www.{letters(6)}.org/LICENSE-2.{digits(1)}", lambda: f"{letters(3)} at {letters(4)}",
            lambda: f"{letters(2)} ({letters(2)}) {letters(5)}", lambda: letters(int(rng.integers(12, 40))), lambda: word() + pick(["###", "$$$",
            "%%%", "&&&", "***"]), lambda: " | ".join(letters(5) for _ in range(3)), lambda: f"{digits(2)}:{digits(2)}:{digits(2)}",
            lambda: f"{letters(4)}_{letters(6)}-{letters(5)}"])()

    def said(kind: int, made: str) -> tuple[str, str]:
        """What stands before and after a span."""
        if kind == 4:
            return pick([('token = "', '"'), ("password=", ""), ("", ""), ("api_key: ", ""), ("secret: '", "'"), ("key=", ";")])
        marks = pick(["###", "$$$", "%%%", "&&&", "***", "!!", "!", "?", ";"])
        return pick([("", ""), ("", ""), ("", marks), ("", "."), ("", ","), ("(", ")"), (letters(4) + ": ", "")]) if made[0] != "(" else ("", "")

    out, spans = "", []
    for _ in range(int(rng.integers(6, 16))):
        kind = int(rng.integers(0, 18))
        makers = [email, ip, card, phone, secret]
        if kind < len(makers):
            made = makers[kind]()
            before, after = said(kind, made)
            spans.append((kind, len(out) + len(before), len(out) + len(before) + len(made)))
            out += before + made + after
        else:
            out += other() if kind < 9 else word()
        out += pick([" ", " ", " ", ", ", ". ", "\n"])
    return out, spans


@functools.cache
def trained(seed: int = SEED, texts: int = TRAIN_TEXTS, passes: int = PASSES) -> Compiled:
    rng = np.random.default_rng(seed)
    windows, tags = [], []
    for _ in range(texts):
        text, spans = _made(rng)
        x = np.zeros(max(TRAIN_WINDOW, len(text)), np.int64)
        y = np.zeros(len(x), np.int64)
        x[: len(text)] = codes(text)
        for k, s, e in spans:
            y[s], y[s + 1 : e] = 1 + 2 * k, 2 + 2 * k
        at = int(rng.integers(0, len(x) - TRAIN_WINDOW + 1))
        windows.append(x[at : at + TRAIN_WINDOW])
        tags.append(y[at : at + TRAIN_WINDOW])
    x, y = np.stack(windows), np.stack(tags)
    y[:, 0] = np.where((y[:, 0] > 0) & (y[:, 0] % 2 == 0), y[:, 0] - 1, y[:, 0])  # a cut span begins with B
    model = Tagger(rng)
    m, v, step = ({k: np.zeros_like(w) for k, w in model.p.items()} for _ in range(2)), None, 0
    m, v = m
    for epoch in range(passes):
        for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 40)):
            _, grad = model.step(x[part], y[part])
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                model.p[k] = (model.p[k] - 0.02 * 0.8**epoch * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model.compiled()


# ---- tagging whole texts


Part = tuple[Span, float, bool, bool]  # span, summed margin, whether its window's inner edge cuts it at the start, at the end


def window_spans(tags: np.ndarray, margins: np.ndarray, start: int, size: int, n: int) -> list[Part]:
    """Spans of one window of a text of n characters, with their summed margins."""
    out = []
    places = np.flatnonzero(tags[:size])
    p = 0
    while p < len(places):
        s = int(places[p])
        kind, e = (int(tags[s]) - 1) // 2, s + 1
        while e < size and tags[e] == 2 + 2 * kind:
            e += 1
        out.append(((kind, start + s, start + e), float(margins[s:e].sum()), s == 0 and start > 0, e == size and start + size < n))
        p = int(np.searchsorted(places, e))
    return out


def joined(parts: list[Part]) -> list[tuple[Span, float]]:
    """Parts of one kind that overlap or adjoin become one span where a window's edge has cut one of them."""
    out: list[list] = []
    for (k, s, e), w, before, after in sorted(parts, key=lambda x: (x[0][0], x[0][1], x[0][2])):
        last = out[-1] if out else None
        if last and last[0] == k and s <= last[2] and (before or last[4]):
            share = max(0, last[2] - s) / (e - s)  # what both windows saw counts once
            last[3] += w * (1 - min(1.0, share))
            last[4] = after if e >= last[2] else last[4]
            last[2] = max(last[2], e)
        else:
            out.append([k, s, e, w, after])
    return [((k, s, e), w) for k, s, e, w, _ in out]


def reconcile(spans: list[tuple[Span, float]]) -> list[Span]:
    """Non-overlapping spans of the largest total margin over the whole text; equal spans count once, with their best."""
    best: dict[Span, float] = {}
    for s, w in spans:
        best[s] = max(best.get(s, 0.0), w)
    items = sorted(((s, w) for s, w in best.items() if w > 0), key=lambda x: (x[0][2], x[0][1], x[0][0]))
    ends = [s[2] for s, _ in items]
    value, take = [0.0], []
    for i, (s, w) in enumerate(items):
        j = bisect_right(ends, s[1], 0, i)
        take.append((value[j] + w > value[-1], j))
        value.append(max(value[-1], value[j] + w))
    out, i = [], len(items)
    while i:
        chosen, j = take[i - 1]
        if chosen:
            out.append(items[i - 1][0])
        i = j if chosen else i - 1
    return out[::-1]


def tagged(texts: list[str], model: Compiled) -> list[list[Span]]:
    """The tagger's spans of each text, reconciled."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    # 0 pads between texts and after the last, so that windows never reach into the next text
    base = np.cumsum(sizes + WINDOW) - sizes - WINDOW
    flat = np.zeros(int((sizes + WINDOW).sum()), np.uint8)
    for t, b in zip(texts, base.tolist(), strict=True):
        flat[b : b + len(t)] = codes(t)
    count = np.where(sizes > 0, np.maximum(0, -(-(sizes - WINDOW) // STRIDE)) + 1, 0)
    owner = np.repeat(np.arange(len(texts)), count)
    start = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    parts: dict[int, list[Part]] = {}
    waiting: list[np.ndarray] = []  # windows that may hold a span, few of most blocks, are decoded together
    scores: list[np.ndarray] = []

    def decoded() -> None:
        which = np.concatenate(waiting)
        for r, t, g in zip(*model.paths(np.concatenate(scores, axis=2)), strict=True):
            if t.any():
                i, s = int(owner[which[r]]), int(start[which[r]])
                n = int(sizes[i])
                parts.setdefault(i, []).extend(window_spans(t, g, s, min(WINDOW, n - s), n))
        waiting.clear()
        scores.clear()

    for at in range(0, len(owner), BLOCK):
        i, s = owner[at : at + BLOCK], start[at : at + BLOCK]
        e = model.emissions(flat[(base[i] + s)[:, None] + np.arange(WINDOW)])
        rows = model.hopeful(e)
        waiting.append(at + rows)
        scores.append(e[:, :, rows])
        if sum(map(len, waiting)) >= BLOCK or at + BLOCK >= len(owner):
            decoded()
    return [reconcile(joined(parts.get(i, []))) for i in range(len(texts))]


def find(texts: list[str | None], model: Compiled) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans and all its spans, by kind and start."""
    out, at = [], 0
    while at < len(texts):  # some millions of characters at once
        end, size = at, 0
        while end < len(texts) and (end == at or size < 4_000_000):
            size += len(texts[end] or "")
            end += 1
        part = [t or "" for t in texts[at:end]]
        for t, found in zip(part, tagged(part, model), strict=True):
            base, extra = sorted(base_spans(t)), []
            for k, s, e in found:
                raw = t[s:e]
                s, e = s + len(raw) - len(raw.lstrip()), e - len(raw) + len(raw.rstrip())
                if s < e and plausible(k, t[s:e]) and all(e <= x[1] or s >= x[2] for x in base):
                    extra.append((k, s, e))
            out.append((base, sorted(base + extra)))
        at = end
    return out


def span_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def mask(text: str, spans: list[Span]) -> str:
    """text with every span replaced by its kind; overlapping spans merge under the first one's kind."""
    out, end = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2], x[0])):
        if s >= end:
            out += [text[end:s], f"[{KINDS[k].upper()}]"]
        end = max(end, e)
    return "".join([*out, text[end:]])


def spans_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Compiled | None = None) -> DataFrame:
    """id_col, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans of every row."""
    small_batches(docs.sparkSession)
    model = model or trained()
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, *[f"n_{k}" for k in KINDS[:PATTERNED]], "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows = find(batch.column(1).to_pylist(), model)
            counts = [pa.array([sum(s[0] == k for s in b) for b, _ in rows], pa.int64()) for k in range(PATTERNED)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([hashlib.sha256(span_text(b).encode()).hexdigest() for b,
                _ in rows]), pa.array([span_text(a) for _, a in rows], pa.string()), pa.array([len(a) - len(b) for b, a in rows], pa.int64())], names=names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, "
        f"base_sha256 string, spans string, n_added long")


def masked(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", model: Compiled | None = None) -> DataFrame:
    """docs with personal data in text_col replaced by the kind, and length_col, if docs has it, set to the new length where it changed."""
    small_batches(docs.sparkSession)
    model = model or trained()
    length_col = length_col if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = batch.column(text_col).to_pylist()
            new = [t if t is None or not s else mask(t, s) for t, (_, s) in zip(texts, find(texts, model), strict=True)]
            at = batch.schema.get_field_index(text_col)
            out = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            if length_col:
                k = batch.schema.get_field_index(length_col)
                sizes = [was if a == b or b is None else len(b) for a, b, was in zip(texts, new, batch.column(k).to_pylist(), strict=True)]
                out = out.set_column(k, batch.schema.field(k), pa.array(sizes, batch.schema.field(k).type))
            yield out

    return docs.mapInArrow(run, docs.schema)


def op2_char_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
