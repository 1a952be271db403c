r"""Personal data: fixed patterns plus a linear-chain conditional random field (operator 8).

Patterns find e-mail addresses, IP addresses, card and phone numbers.  A
linear-chain CRF over word shapes, trained here by gradient descent on a small
labelled table that ``labelled_table`` generates from templates, adds what the
patterns can't tell: phone numbers without a plus, keys and passwords, odd
e-mail addresses.  Its spans never overlap a pattern's.

Every token of a text is scored, and the result is that of one Viterbi pass
over the whole text.  A token whose score for O beats every other label's by
more than any transitions to and from it could make up has O on the best path
for certain; the pass is cut at such tokens and nowhere else.  Viterbi runs over
many stretches between them at once, padded to a common length, in numpy.
Everything happens in the task that reads the
text; nothing is shuffled.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_arrow

KINDS = ["email", "ip", "card", "phone", "secret"]
LABELS = ["O", "email", "ip", "card", "card+", "phone", "phone+", "secret", "secret+"]
DIMS = 1 << 12
SLICE = 1000  # rows that a worker holds as Python objects at once
BLOCK = 1 << 16  # tokens whose scores are held at once, and cells of padded stretches, unless one is longer
LONG = 80  # signs; nothing of longer tokens is remembered
ROWS = 1 << 15  # kinds of tokens whose weights are remembered from one text to the next

# An address starts where a run of its signs does, or where the match before it ended: from any other place in the run it
# would fail or succeed alike.  So a run without an @ is read once, not once for each of its signs.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
_EMAIL_RUN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT, _TOKEN = re.compile(r"[0-9]"), re.compile(r"\S+")
_NAMES = ("pass", "pwd", "secret", "token", "api")
_EDGE_LEFT, _EDGE_RIGHT = "([{<\"'", ".,;:!?)]}>\"'"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _byte(digits: str) -> bool:
    """Whether a number of any length is 255 at most."""
    digits = digits.lstrip("0")
    return len(digits) < 4 and int(digits or "0") <= 255


def _valid_ip(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(p.isascii() and p.isdigit() and _byte(p) for p in parts)


def _emails(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    while m := (at and _EMAIL.match(text, at)) or _EMAIL_RUN.search(text, at):
        out.append(m.span())
        at = m.end()
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what the patterns find; matches that fail their test are dropped without another try."""
    out = []
    if "@" in text:
        out += [(0, *span) for span in _emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def shape(token: str) -> str:
    """Upper to X, lower (and any other letter) to x, digits to d, runs as one, 24 signs at most."""
    if token.isascii() and token.isalpha():  # most words, at a glance
        if token.islower():
            return "x"
        if token.isupper():
            return "X"
        if token[1:].islower():
            return "Xx"
    out: list[str] = []
    for c in token:
        s = "d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        if not out or out[-1] != s:
            if len(out) == 24:
                break
            out.append(s)
    return "".join(out)


def features(token: str) -> tuple[int, ...]:
    """Hashed features of a token without its neighbours; those of short tokens are remembered."""
    return _remembered(token) if len(token) <= LONG else _features(token)


def _features(token: str) -> tuple[int, ...]:
    bare = token.lstrip(_EDGE_LEFT).rstrip(_EDGE_RIGHT)
    n_digits, n = sum(c.isdigit() for c in bare), len(bare)
    upper = sum(c.isupper() for c in bare)
    found = [f"s:{shape(bare)}", f"d:{min(n_digits, 5) if n_digits < 7 else 6 if n_digits < 9 else 7 if n_digits < 13 else 8}", f"n:{min(n.bit_length(), 6)}"]
    if bare[:1] == "+":
        found.append("plus")
    if "@" in bare:
        found.append("at")
    if _valid_ip(bare):
        found.append("ip")
    if bare.isdigit() and 13 <= n <= 19:
        found.append("luhn" if luhn(bare) else "long-number")
    if re.fullmatch(r"\(?\d{3}\)?[-.]?\d{3}[-.]\d{4}", token.rstrip(_EDGE_RIGHT) if "(" not in token else token.rstrip(".,;:!?")):
        found.append("phone-like")
    if re.fullmatch(r"\(\d{3}\)", token):
        found.append("area")
    if re.fullmatch(r"\d{3}-\d{4}", bare):
        found.append("local")
    if n >= 16 and n_digits >= 2 and upper + n_digits == n:
        found.append("key-upper")
    if n >= 16 and n_digits >= 2 and re.fullmatch(r"[A-Za-z0-9_\-+/=.]+", bare) and not bare.isdigit() and "@" not in bare:
        found.append("key-mixed")
    if m := re.match(r"(?i)(password|passwd|pwd|secret|token|api_?key)([=:]?)(.*)", bare):
        found.append(f"name{m[2]}{'v' if len(m[3]) >= 6 else ''}")
    return tuple(hash_feature(f) for f in found)


_remembered = lru_cache(maxsize=1 << 13)(_features)


def hash_feature(name: str) -> int:
    h = 2166136261
    for b in name.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % DIMS


def labelled_table(rows: int = 500, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """Token and label sequences from templates: positives of every kind among look-alikes that are no personal data."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    letters = lambda n, a="abcdefghijklmnopqrstuvwxyz": "".join(rng.choice(a) for _ in range(n))

    def word() -> str:
        w = letters(rng.randrange(1, 10), "abcdefghijklmnopqrstuvwxyzéüñß")
        return rng.choice([w, w, w, w.capitalize(), w + ",", w + ".", w.upper() + "!!", w + "$$$", w + "%%%", "|"])

    def card() -> str:
        body = digits(15)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def positive() -> tuple[list[str], list[str]]:
        kind = rng.randrange(9)
        if kind == 0:
            return [f"{letters(5)}.{digits(2)}@{rng.choice(['mail', 'host', ''])}{letters(3)}{rng.choice(['', '.com', digits(1) + '.example.com'])}"], ["email"]
        if kind == 1:
            return [".".join(str(rng.randrange(256)) for _ in range(4))], ["ip"]
        if kind == 2:
            return [card()], ["card"]
        if kind == 3:
            c = card()
            return [c[:4], c[4:8], c[8:12], c[12:]], ["card", "card+", "card+", "card+"]
        if kind == 4:
            return [f"+{digits(1)}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], ["phone", "phone+", "phone+"]
        if kind == 5:
            return [f"({digits(3)})", f"{digits(3)}-{digits(4)}"], ["phone", "phone+"]
        if kind == 6:
            return [rng.choice([f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"({digits(3)}){digits(3)}-{digits(4)}"])], ["phone"]
        if kind == 7:
            return [rng.choice(["AKIA" + letters(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789234567"), "key_" + letters(10) + digits(10), letters(12, "abcdef0123456789") + digits(6) + letters(14, "abcdef0123456789")])], ["secret"]
        name = rng.choice(["password", "passwd", "token", "secret", "api_key"])
        if rng.random() < 0.7:
            return [f"{name}={letters(6, 'abcdef0123456789')}{digits(2)}{letters(8, 'abcdef0123456789')}"], ["secret"]
        return [f"{name}:", letters(8, "abcdef0123456789") + digits(4)], ["secret", "secret+"]

    def negative() -> list[str]:
        return rng.choice(
            [
                lambda: ["Version", "2.0."], lambda: ["version", f"{digits(1)}."], lambda: [f"{digits(1)}.0."], lambda: [str(rng.randrange(1900, 2030))], lambda: [f"{digits(2)},{digits(3)}"],
                lambda: [f"20{digits(2)}-0{rng.randrange(1, 10)}-{rng.randrange(10, 29)}"], lambda: [f"{rng.randrange(10, 24)}:{rng.randrange(10, 60)}"], lambda: [digits(rng.randrange(1, 13))], lambda: [f"x={digits(1)}"],
                lambda: ["a", "=", "b"], lambda: [f"{letters(3)}{digits(2)}"], lambda: ["#" + digits(3)], lambda: [digits(20)], lambda: [f"{digits(3)}.{digits(3)}"],
                lambda: [f"@{letters(6)}"], lambda: ["password", "is", word()], lambda: ["the", "token", word()], lambda: [f"{digits(4)}", f"{digits(4)}"], lambda: [f"{digits(2)}%"], lambda: [f"${digits(3)}"], lambda: [f"{rng.randrange(300, 999)}.{digits(2)}.{digits(2)}.{digits(2)}"],
            ]
        )()

    out = []
    for _ in range(rows):
        tokens, labels = [], []
        for _ in range(rng.randrange(1, 4)):
            plain = [word() for _ in range(rng.randrange(0, 4))]
            tokens, labels = tokens + plain, labels + ["O"] * len(plain)
            if rng.random() < 0.5:
                t, y = positive()
                if rng.random() < 0.3:
                    t[-1] += rng.choice(".,")
            else:
                t = negative()
                y = ["O"] * len(t)
            tokens, labels = tokens + t, labels + y
            tail = [word() for _ in range(rng.randrange(1, 3))]
            tokens, labels = tokens + tail, labels + ["O"] * len(tail)
        out.append((tokens, labels))
    return out


class Crf:
    """Weights: emission by feature of the token itself, of its predecessor and of its successor; transitions; starts."""

    def __init__(self, own: np.ndarray, before: np.ndarray, after: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.own, self.before, self.after, self.move, self.start = own, before, after, move, start
        self.rows: _Rows | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rows": None}

    def emissions(self, tokens: list[str]) -> np.ndarray:
        feats = [list(features(t)) for t in tokens]
        out = np.stack([self.own[f].sum(0) for f in feats])
        if len(tokens) > 1:
            out[1:] += np.stack([self.before[f].sum(0) for f in feats[:-1]])
            out[:-1] += np.stack([self.after[f].sum(0) for f in feats[1:]])
        return out

    def viterbi(self, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Best labels of padded sequences: scores (sequence, position, label) and their lengths."""
        n, most, k = scores.shape
        best, back = scores[:, 0] + self.start, np.zeros((n, most, k), np.int16)
        final = best.copy()
        for t in range(1, most):
            through = best[:, :, None] + self.move
            back[:, t] = through.argmax(1)
            best = through.max(1) + scores[:, t]
            final = np.where((sizes > t)[:, None], best, final)
        out = np.zeros((n, most), np.int16)
        label = final.argmax(1)
        for t in range(most - 1, -1, -1):
            label = np.where(sizes - 1 == t, final.argmax(1), label)
            out[:, t] = np.where(sizes > t, label, 0)
            label = np.where(sizes > t, back[np.arange(n), t, label], label)
        return out


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def train(table: list[tuple[list[str], list[str]]], steps: int = 80, rate: float = 0.15, decay: float = 2e-4) -> Crf:
    """Maximum likelihood by Adam over the whole table; forward and backward passes run over all sequences at once."""
    k, n, most = len(LABELS), len(table), max(len(t) for t, _ in table)
    seq, pos, feat = [], [], []
    gold, mask = np.zeros((n, most), int), np.zeros((n, most), bool)
    for i, (tokens, labels) in enumerate(table):
        for t, (token, label) in enumerate(zip(tokens, labels, strict=True)):
            mask[i, t], gold[i, t] = True, LABELS.index(label)
            for f in features(token):
                seq.append(i), pos.append(t), feat.append(f)
    seq, pos, feat = map(np.array, (seq, pos, feat))
    sizes = mask.sum(1)
    shifts = [(0, np.ones(len(seq), bool)), (1, pos + 1 < sizes[seq]), (-1, pos > 0)]
    params = [np.zeros((DIMS, k)) for _ in range(3)] + [np.zeros((k, k)), np.zeros(k)]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    hot = np.eye(k)[gold] * mask[:, :, None]
    rows = np.arange(n)
    for step in range(1, steps + 1):
        scores = np.zeros((n, most, k))
        for w, (d, ok) in zip(params[:3], shifts, strict=True):
            np.add.at(scores, (seq[ok], pos[ok] + d), w[feat[ok]])
        move, start = params[3], params[4]
        alpha, beta = np.zeros((n, most, k)), np.zeros((n, most, k))
        alpha[:, 0] = scores[:, 0] + start
        for t in range(1, most):
            alpha[:, t] = np.where(mask[:, t, None], _logsumexp(alpha[:, t - 1, :, None] + move, 1) + scores[:, t], alpha[:, t - 1])
        for t in range(most - 2, -1, -1):
            beta[:, t] = np.where(mask[:, t + 1, None], _logsumexp(move + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
        total = _logsumexp(alpha[rows, sizes - 1], 1)
        chance = np.exp(np.minimum(alpha + beta - total[:, None, None], 0)) * mask[:, :, None]
        slope = hot - chance
        grads = []
        for d, ok in shifts:
            g = np.zeros((DIMS, k))
            np.add.at(g, feat[ok], slope[seq[ok], pos[ok] + d])
            grads.append(g)
        pair = np.exp(np.minimum(alpha[:, :-1, :, None] + move + (scores[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None], 0)) * mask[:, 1:, None, None]
        grads.append(np.einsum("ntk,ntj->kj", hot[:, :-1], hot[:, 1:]) - pair.sum((0, 1)))
        grads.append(slope[:, 0].sum(0))
        for p, g, a, b in zip(params, grads, m1, m2, strict=True):
            g = g / n - decay * p
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Crf(*params)


@lru_cache(maxsize=1)
def model() -> Crf:
    return train(labelled_table())


class _Rows:
    """Weights by kind of token: one row for all tokens with the same features."""

    def __init__(self, crf: Crf):
        self.crf = crf
        self.by_features: dict[tuple[int, ...], int] = {}
        self.by_token: dict[str | tuple[str, int], int] = {}
        self.weights = np.zeros((1024, 3, len(LABELS)))

    def row(self, token: str) -> int:
        bare = token.lstrip(_EDGE_LEFT).rstrip(_EDGE_RIGHT)
        key = token
        if bare.isascii() and bare.isalpha() and not bare.lower().startswith(_NAMES):
            # of words of plain letters, features see the shape and the bits of the length
            key = (shape(bare), min(len(bare).bit_length(), 6))
        found = self.by_token.get(key)
        if found is None:
            feats = features(token)
            found = self.by_features.get(feats)
            if found is None:
                found = self.by_features[feats] = len(self.by_features)
                if found == len(self.weights):
                    self.weights = np.concatenate([self.weights, np.zeros_like(self.weights)])
                f = list(feats)
                self.weights[found] = self.crf.own[f].sum(0), self.crf.before[f].sum(0), self.crf.after[f].sum(0)
            if len(token) <= LONG or key is not token:
                self.by_token[key] = found
        return found

    def rows(self, tokens: list[str]) -> np.ndarray:
        if len(self.by_features) > ROWS or len(self.by_token) > 4 * ROWS:
            self.__init__(self.crf)
        get, row = self.by_token.get, self.row
        return np.array([found if (found := get(t)) is not None else row(t) for t in tokens], np.int32)

    def scores(self, rows: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """``Crf.emissions`` of the tokens from ``lo`` to ``hi`` of a text."""
        out = self.weights[rows[lo:hi], 0]
        first, last = lo == 0, hi == len(rows)
        out[first:] += self.weights[rows[lo - 1 + first : hi - 1], 1]
        out[: len(out) - last] += self.weights[rows[lo + 1 : hi + 1], 2]
        return out


def _unsure(rows: np.ndarray, weights: _Rows, gain: np.ndarray) -> np.ndarray:
    """Places of the tokens that may have another label than O; the first and the last count as such."""
    found = [np.array([0, len(rows) - 1])]
    for lo in range(0, len(rows), BLOCK):
        e = weights.scores(rows, lo, min(lo + BLOCK, len(rows)))
        found.append(lo + np.nonzero((e[:, 1:] + gain[1:] + 1e-6 > e[:, :1]).any(1))[0])
    return np.unique(np.concatenate(found))


def crf_labels(batch: list[str], crf: Crf) -> list[list[tuple[int, np.ndarray]]]:
    """For each text, the first token and the labels of each stretch that has others than O."""
    found: list[list[tuple[int, np.ndarray]]] = [[] for _ in batch]
    # the most that having y instead of O can gain by the transitions on both sides
    gain = (crf.move - crf.move[:, :1]).max(0) + (crf.move - crf.move[:1]).max(1)
    crf.rows = weights = crf.rows or _Rows(crf)  # a task keeps it from batch to batch
    waiting, cells = [], 0

    def decode() -> None:
        waiting.sort(key=lambda w: len(w[2]))
        while waiting:
            most = len(waiting[-1][2])
            part = waiting[-max(BLOCK // most, 1) :]
            del waiting[-len(part) :]
            sizes = np.array([len(w[2]) for w in part])
            padded = np.zeros((len(part), most, len(LABELS)))
            for k, (_, _, e) in enumerate(part):
                padded[k, : len(e)] = e
            labels = crf.viterbi(padded, sizes)
            for k in np.nonzero(labels.any(1))[0]:
                found[part[k][0]].append((part[k][1], labels[k, : sizes[k]]))

    for i, text in enumerate(batch):
        tokens = _TOKEN.findall(text)
        if not tokens:
            continue
        rows = weights.rows(tokens)
        at = _unsure(rows, weights, gain)
        cut = np.nonzero(np.diff(at) > 1)[0] + 1
        for a, b in zip(at[np.concatenate([[0], cut])].tolist(), at[np.concatenate([cut - 1, [len(at) - 1]])].tolist(), strict=True):
            # with the certain tokens on both sides, which can have O only
            lo, hi = max(a - 1, 0), min(b + 2, len(rows))
            e = weights.scores(rows, lo, hi)
            if lo < a:
                e[0, 1:] = -np.inf
            if hi > b + 1:
                e[-1, 1:] = -np.inf
            waiting.append((i, lo, e))
            cells += len(e)
        if cells >= BLOCK:
            decode()
            cells = 0
    decode()
    return found


def crf_spans(batch: list[str], crf: Crf) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) of what the CRF finds in each text."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in batch]
    for text, own, stretches in zip(batch, found, crf_labels(batch, crf), strict=True):
        spans = [m.span() for m in _TOKEN.finditer(text)] if stretches else []
        for first, labels in sorted(stretches, key=lambda s: s[0]):
            last = None
            for (a, b), y in zip(spans[first : first + len(labels)], labels, strict=True):
                name = LABELS[y]
                if name == "O":
                    last = None
                    continue
                kind = KINDS.index(name.rstrip("+"))
                while a < b - 1 and text[a] in "[{<\"'":
                    a += 1
                while b > a + 1 and text[b - 1] in ".,;:!?]}>\"'":
                    b -= 1
                if name.endswith("+") and last == kind:
                    own[-1] = (kind, own[-1][1], b)
                else:
                    own.append((kind, a, b))
                last = kind
    return found


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, text and spans (kind, start, end in code points, base: found by a pattern), ordered by kind as KINDS lists them, then start.

    Null counts as an empty text, which has no spans.  Repeated rows are rows
    of their own.  An empty table gives an empty result; other columns are
    ignored.  Texts of any length are read whole.
    """
    crf = model()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in column(batch, "text")]
        out = []
        for text, more in zip(texts, crf_spans(texts, crf), strict=True):
            base = sorted(base_spans(text))
            taken = sorted((a, b) for _, a, b in base)
            added = [s for s in sorted(set(more)) if not any(a < s[2] and s[1] < b for a, b in taken)]
            merged = sorted([(*s, True) for s in base] + [(*s, False) for s in added])
            out.append([{"kind": KINDS[k], "start": a, "end": b, "base": is_base} for k, a, b, is_base in merged])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], ["doc_id", "text", "spans"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")), step, f"doc_id long, text string, spans {SPANS}", SLICE)


def op8_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:4]), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
