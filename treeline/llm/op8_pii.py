"""Personal data by exact patterns and a character-level BiLSTM with CRF.

The patterns' matches always stay.  The tagger adds spans: it is trained in
numpy on labelled spans of a bounded sample and on made-up spans placed into
sampled text.  Every kind of span holds a digit or an ``@``, so the tagger
reads the stretches of text around those, on to white space; overlapping
windows over a stretch are scored by the network, their scores are averaged,
and the CRF decodes each whole stretch at once (very long ones in parts that
share more than a span's length).
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.llm.common import read
from treeline.llm.registry import register

KINDS = ("email", "ip", "card", "phone")
#: The characters of an address before the @, and the patterns of the other kinds.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT, _TRIGGER, _SPACE = re.compile("[0-9]"), re.compile("[0-9@]+"), re.compile(r"\s")


def luhn(digits: str) -> bool:
    double = [d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2])]
    return (sum(map(int, digits[-1::-2])) + sum(double)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches: a local part reaches back from its @ as far as its characters go."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(end, at + 1))


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all pattern matches, sorted."""
    if not text:
        return []
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(int(p) <= 255 if len(p) < 20 else not p.strip("0") or int(p.lstrip("0")[:4]) <= 255 and len(p.lstrip("0")) <= 3 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- the tagger -------------------------------------------------------------

#: Characters of a window and how far apart windows start; characters kept around a digit or @, at least.
WINDOW, STRIDE, MARGIN = 64, 32, 16
#: Longest stretch that is decoded at once; a longer one is decoded in parts that share OVERLAP characters,
#: more than any kind of span has (an address: 320), and a span is taken from the part that its middle is deeper in.
LONGEST, OVERLAP = 8192, 1024
#: Most sampled windows that a tagger is trained on, and made-up ones.
MAX_WINDOWS, MADE_UP = 2000, 1200
#: Least mean probability of the tags of an added span.
SURE = 0.95
TAGS = 1 + 2 * len(KINDS)


def _near(text: str, spaces: bool = False) -> list[list[int]]:
    """Around each digit or @, joined where they meet; with ``spaces``, on to the next white space."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        if spaces and out and m.end() + MARGIN <= out[-1][1]:
            continue
        s, e = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and s <= out[-1][1]:
            s = out.pop()[0]
        elif spaces:
            floor = out[-1][1] if out else 0
            while s > floor and not text[s - 1].isspace():
                s -= 1
            if out and s == floor:
                s = out.pop()[0]
        if spaces:
            space = _SPACE.search(text, e) if e and not text[e - 1].isspace() else None
            e = space.start() if space else e if text[e - 1].isspace() else len(text)
        out.append([s, e])
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """Where the tagger reads: around each digit or @ and on to white space, joined where they meet, long ones in overlapping parts."""
    return [(k, min(k + LONGEST, e)) for s, e in _near(text, True) for k in range(s, e if e - s <= LONGEST else e - OVERLAP, LONGEST - OVERLAP)]


def _owned(parts: list[tuple[int, int]]) -> list[tuple[float, float]]:
    """For each of a text's stretches, from where to where the middles of its spans are: parts meet halfway in what they share."""
    edges = [(e + s) / 2 if s < e else s for (_, e), (s, _) in zip(parts, parts[1:])]
    return list(zip([-1, *edges], [*edges, float("inf")]))


def codes(text: str) -> np.ndarray:
    """Small numbers for characters: ASCII its own, one for all others; 0 pads."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < 127, c + 1, 128).astype(np.int64)


def tags_of(spans, start: int, end: int) -> np.ndarray:
    """Begin / inside tags of the spans that lie within [start, end)."""
    out = np.zeros(end - start, np.int64)
    for s, kind, e in spans:
        if start <= s and e <= end:
            out[s - start] = 1 + 2 * kind
            out[s - start + 1:e - start] = 2 + 2 * kind
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsum(x, axis):
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Character embedding, one LSTM each way, linear scores, CRF transitions."""

    def __init__(self, embed: int = 12, hidden: int = 24, seed: int = 5):
        rng = np.random.default_rng(seed)

        def w(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"E": w(129, embed) * 3, "out": w(2 * hidden, TAGS), "bias": np.zeros(TAGS, np.float32),
                  "trans": np.zeros((TAGS, TAGS), np.float32), "first": np.zeros(TAGS, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": w(embed, 4 * hidden), f"h{d}": w(hidden, 4 * hidden), f"c{d}": np.zeros(4 * hidden, np.float32)}
        self.hidden = hidden

    def _lstm(self, x: np.ndarray, d: str, keep: bool):
        """x: steps, rows, embed -> hidden states by step, and what the gradient needs."""
        n, rows, H = len(x), x.shape[1], self.hidden
        h, c = np.zeros((rows, H), np.float32), np.zeros((rows, H), np.float32)
        states, saved = np.zeros((n, rows, H), np.float32), []
        given = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            z = given[t] + h @ self.p[f"h{d}"]
            gates, g = _sigmoid(z[:, :3 * H]), np.tanh(z[:, 3 * H:])
            i, f, o = gates[:, :H], gates[:, H:2 * H], gates[:, 2 * H:]
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            if keep:
                saved.append((t, i, f, o, g, before, tc, h))
            h = o * tc
            states[t] = h
        return states, saved

    def scores(self, chars: np.ndarray, keep: bool = False):
        """chars: rows, steps -> rows, steps, tags."""
        x = self.p["E"][chars.T]
        f, sf = self._lstm(x, "f", keep)
        b, sb = self._lstm(x, "b", keep)
        states = np.concatenate([f, b], axis=2)
        s = (states @ self.p["out"] + self.p["bias"]).transpose(1, 0, 2)
        return (s, (x, states, sf, sb)) if keep else s

    def marginals(self, scores: np.ndarray):
        """Log forward and backward sums and log totals of rows, steps, tags."""
        a, b = np.zeros_like(scores), np.zeros_like(scores)
        a[:, 0] = self.p["first"] + scores[:, 0]
        for t in range(1, scores.shape[1]):
            a[:, t] = _logsum(a[:, t - 1][:, :, None] + self.p["trans"], 1) + scores[:, t]
        for t in range(scores.shape[1] - 2, -1, -1):
            b[:, t] = _logsum((b[:, t + 1] + scores[:, t + 1])[:, None, :] + self.p["trans"], 2)
        return a, b, _logsum(a[:, -1], 1)

    def gradient(self, chars: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log likelihood of the tags."""
        s, (x, states, sf, sb) = self.scores(chars, True)
        rows, n = chars.shape
        a, b, z = self.marginals(s)
        true = np.eye(TAGS, dtype=np.float32)[tags]
        ds = ((np.exp(a + b - z[:, None, None]) - true) / rows).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["first"] = ds[:, 0].sum(0)
        for t in range(1, n):
            pair = a[:, t - 1][:, :, None] + self.p["trans"] + (s[:, t] + b[:, t])[:, None, :] - z[:, None, None]
            g["trans"] += np.exp(pair).sum(0) / rows
        np.add.at(g["trans"], (tags[:, :-1].ravel(), tags[:, 1:].ravel()), np.float32(-1 / rows))
        ds = ds.transpose(1, 0, 2)
        g["out"], g["bias"] = np.einsum("trh,trk->hk", states, ds, optimize=True), ds.sum((0, 1))
        dstates = ds @ self.p["out"].T
        dx, H = np.zeros_like(x), self.hidden
        for d, saved, dh_all in (("f", sf, dstates[:, :, :H]), ("b", sb, dstates[:, :, H:])):
            dh, dc, w = np.zeros((rows, H), np.float32), np.zeros((rows, H), np.float32), self.p[f"h{d}"].T
            dz_all = np.zeros((n, rows, 4 * H), np.float32)
            for t, i, f, o, c, before, tc, h in reversed(saved):
                dh = dh + dh_all[t]
                dc = dc + dh * o * (1 - tc * tc)
                dz = dz_all[t]
                dz[:, :H], dz[:, H:2 * H], dz[:, 2 * H:3 * H], dz[:, 3 * H:] = dc * c * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - c * c)
                g[f"h{d}"] += h.T @ dz
                dh, dc = dz @ w, dc * f
            g[f"x{d}"], g[f"c{d}"] = np.einsum("tre,trk->ek", x, dz_all, optimize=True), dz_all.sum((0, 1))
            dx += dz_all @ self.p[f"x{d}"].T
        np.add.at(g["E"], chars.T, dx)
        return g

    def fit(self, chars: np.ndarray, tags: np.ndarray, epochs: int = 8, rows: int = 64, rate: float = 0.01, seed: int = 3) -> Tagger:
        """Adam over shuffled batches; the rate falls to a tenth."""
        rng, m, v, k = np.random.default_rng(seed), {n: 0.0 for n in self.p}, {n: 0.0 for n in self.p}, 0
        total = epochs * -(-len(chars) // rows)
        for _ in range(epochs):
            order = rng.permutation(len(chars))
            for at in range(0, len(order), rows):
                pick, k = order[at:at + rows], k + 1
                g = self.gradient(chars[pick], tags[pick])
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                now = rate * (1 - 0.9 * k / total)
                for n, x in g.items():
                    x = x * min(1.0, 5 / (norm + 1e-6))
                    m[n], v[n] = 0.9 * m[n] + 0.1 * x, 0.99 * v[n] + 0.01 * x * x
                    self.p[n] = (self.p[n] - now * (m[n] / (1 - 0.9 ** k)) / (np.sqrt(v[n] / (1 - 0.99 ** k)) + 1e-8)).astype(np.float32)
        return self

    def read(self, parts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Best tags, and the probability of each, of every stretch (codes):
        windows are scored together, their scores averaged (the middle of a
        window weighs most) and each stretch decoded as a whole."""
        out: list = [None] * len(parts)
        order = sorted(range(len(parts)), key=lambda k: len(parts[k]))
        at = 0
        while at < len(order):  # stretches of like length together, about 2**15 characters at a time
            some, cells = [], 0
            while at < len(order) and (not some or (len(some) + 1) * len(parts[order[at]]) <= 1 << 15):
                some.append(order[at])
                at += 1
            for k, r in zip(some, self._read([parts[k] for k in some])):
                out[k] = r
        return out

    def _read(self, parts: list[np.ndarray]):
        longest = max(map(len, parts))
        place = [(k, s) for k, p in enumerate(parts) for s in range(0, max(1, len(p) - STRIDE), STRIDE)]
        chars = np.zeros((len(place), WINDOW), np.int64)
        for row, (k, s) in zip(chars, place):
            piece = parts[k][s:s + WINDOW]
            row[:len(piece)] = piece
        weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]
        total, weights = np.zeros((len(parts), longest + WINDOW, TAGS), np.float32), np.zeros((len(parts), longest + WINDOW, 1), np.float32)
        for (k, s), x in zip(place, self.scores(chars)):
            total[k, s:s + WINDOW] += x * weight
            weights[k, s:s + WINDOW] += weight
        scores = (total / np.maximum(weights, 1e-6))[:, :longest]
        for k, p in enumerate(parts):  # beyond a stretch there is nothing
            scores[k, len(p):] = -1e4
            scores[k, len(p):, 0] = 0
        a, b, z = self.marginals(scores)
        sure = np.exp(a + b - z[:, None, None])
        best, back = self.p["first"] + scores[:, 0], np.zeros(scores.shape, np.int8)
        for t in range(1, longest):
            step = best[:, :, None] + self.p["trans"]
            back[:, t] = step.argmax(1)
            best = step.max(1) + scores[:, t]
        tag = np.zeros((len(parts), longest), np.int64)
        rows = np.arange(len(parts))
        tag[:, -1] = best.argmax(1)
        for t in range(longest - 1, 0, -1):
            tag[:, t - 1] = back[rows, t, tag[:, t]]
        chosen = np.take_along_axis(sure, tag[:, :, None], 2)[:, :, 0]
        return [(tag[k, :len(p)], chosen[k, :len(p)]) for k, p in enumerate(parts)]


def tagged_spans(tags: np.ndarray, sure: np.ndarray, start: int = 0) -> list[tuple[int, int, int]]:
    """(start, kind, end) of tag runs that begin properly and whose mean probability is at least SURE."""
    out, k = [], 0
    while k < len(tags):
        if tags[k] % 2:
            e = k + 1
            while e < len(tags) and tags[e] == tags[k] + 1:
                e += 1
            if sure[k:e].mean() >= SURE:
                out.append((start + k, int(tags[k]) // 2, start + e))
            k = e
        else:
            k += 1
    return out


_LEAST = {0: re.compile(r"[^@\s]+@[^@\s]+\.[^@\s]+"), 1: re.compile(r"[0-9]+(?:\W[0-9]+){3}"), 2: re.compile(r"(?:[0-9]\W?){11,18}[0-9]"), 3: re.compile(r"\W*(?:[0-9]\W{0,3}){8,14}[0-9]")}


def all_spans(texts: list[str | None], tagger: Tagger) -> list[tuple[list, list]]:
    """For each text its pattern matches, and these with what the tagger adds:
    added spans have a kind's general form and touch no pattern match."""
    base = [base_spans(t) for t in texts]
    where = [(k, s, e, own) for k, t in enumerate(texts) if t for p in (stretches(t),) for (s, e), own in zip(p, _owned(p))]
    found: list[list] = [[] for _ in texts]
    for (k, s, _, (low, high)), (tags, sure) in zip(where, tagger.read([codes(texts[k][s:e]) for k, s, e, _ in where])):
        found[k] += [x for x in tagged_spans(tags, sure, s) if low <= (x[0] + x[2]) / 2 < high]
    out = []
    for t, own, more in zip(texts, base, found):
        added, end = [], 0
        for s, kind, e in sorted(set(more)):
            if s >= end and _LEAST[kind].fullmatch(t[s:e]) and all(e <= x or y <= s for x, _, y in own):
                added.append((s, kind, e))
                end = e
        out.append((own, sorted(own + added) if added else own))
    return out


def digest(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _made_up(rng: random.Random) -> tuple[int, str]:
    def digits(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    def name():
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9)))
    kind = rng.randrange(4)
    if kind == 0:
        local = rng.choice([name(), f"{name()}.{digits(2)}", f"{name()}_{name()}", f"{name()}+{digits(1)}"])
        return kind, f"{local}@{name()}{rng.choice(['', digits(1)])}.{rng.choice(['com', 'org', 'example.com', 'co.uk'])}"
    if kind == 1:
        return kind, ".".join(str(rng.randrange(256)) for _ in range(4))
    if kind == 2:
        body = digits(15)
        d = body + next(c for c in "0123456789" if luhn(body + c))
        return kind, rng.choice([d, " ".join(d[i:i + 4] for i in range(0, 16, 4)), "-".join(d[i:i + 4] for i in range(0, 16, 4))])
    a, b, c = digits(3), digits(3), digits(4)
    return kind, rng.choice([f"+{rng.randrange(1, 99)} ({a}) {b}-{c}", f"+{rng.randrange(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"+{digits(11)}"])


def training_windows(docs: DataFrame, most: int = MAX_WINDOWS) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags of at most ``most`` windows of the corpus, those with
    the smallest hash, labelled by the patterns; and of made-up spans in their place."""
    import xxhash

    def cut(batches):
        for b in batches:
            rows = []
            for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                spans = base_spans(t)
                for s, _ in _near(t or ""):
                    w = t[s:s + WINDOW]
                    tags = tags_of(spans, s, s + len(w))
                    if not any(x < s + len(w) < y for x, _, y in spans):
                        rows.append({"h": xxhash.xxh32_intdigest(f"{d}:{s}"), "w": w, "tags": tags.astype(np.int8).tobytes()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("h", pa.int64()), ("w", pa.string()), ("tags", pa.binary())]))

    # the least hashes of each group; a task sends its own least ones to the groups' tasks, these send theirs to the driver
    found = docs.select("doc_id", "text").mapInArrow(cut, "h long, w string, tags binary").withColumn("group", F.col("h") % SAMPLE_GROUPS)
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy("h", "w", "tags"))).where(F.col("place") <= -(-most // SAMPLE_GROUPS))
    rows = sorted(found.select("h", "w", "tags").collect())[:most]
    rng = random.Random(6)
    texts, tags = [r.w for r in rows], [np.frombuffer(r.tags, np.int8) for r in rows]
    plain = [re.sub("[0-9@]", "", t) for t in texts] or ["the text of a document, "]
    for _ in range(MADE_UP):
        kind, span = _made_up(rng)
        left, right = rng.choice(plain)[:rng.randrange(20)], rng.choice(plain)[:30]
        t = (left + rng.choice([" ", " ", "\n", ": "]) + span + rng.choice([" ", ". ", ", ", "\n"]) + right)[:WINDOW]
        at = t.find(span)
        if at >= 0:
            texts.append(t)
            tags.append(tags_of([(at, kind, at + len(span))], 0, len(t)))
    c, y = np.zeros((len(texts), WINDOW), np.int64), np.zeros((len(texts), WINDOW), np.int64)
    for k, (t, z) in enumerate(zip(texts, tags)):
        c[k, :len(t)], y[k, :len(z)] = codes(t), z
    return c, y


#: Groups that a sample is drawn in, so that the driver gets little more than it keeps.
SAMPLE_GROUPS = 32


def train(docs: DataFrame, most: int = MAX_WINDOWS) -> Tagger:
    """A tagger from a bounded sample of ``docs`` (doc_id, text); without any text, from made-up spans alone."""
    return Tagger().fit(*training_windows(docs, most))


_ARROW = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_())])


def find_personal_data(docs: DataFrame, tagger: Tagger, into: str = "personal") -> DataFrame:
    """``docs`` (text) with ``into``: an array of (kind, start, stop, base) by
    start and kind, in code points, stop exclusive; base: a pattern's match.
    Null and empty texts have none.  Repeated rows and other columns stay."""
    held = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            rows = all_spans(b.to_pylist(), held.value)
            yield pa.array([[{"kind": KINDS[k], "start": s, "stop": e, "base": (s, k, e) in own} for s, k, e in spans] for own, spans in ((set(o), a) for o, a in rows)], pa.list_(_ARROW))
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(into, F.arrow_udf(run, "array<struct<kind: string, start: long, stop: long, base: boolean>>").asNondeterministic()(F.col("text")))


@register("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: personal data by kind, the patterns' spans as a digest, all spans."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_personal_data(docs, train(docs))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    kinds = F.transform("personal", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    base = joined(F.filter("personal", lambda s: s["base"]))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("personal")).alias("spans"))
