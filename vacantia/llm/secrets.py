"""Secret scan: fixed patterns, and a character convolutional network over every candidate.

Candidates are what the patterns match, what they match but drop as too short, and any other unbroken
run of key-like characters with letters and digits; a run that the patterns match in part is split
around their spans, and the long parts between a run's path separators and equals signs are candidates
besides the run, unless it is longer than a path (BLOB). The network reads a candidate in overlapping windows, each with a stretch of context on
either side, and gives a probability; the windows above a threshold, joined where they meet, are added to
the patterns' spans, which always stay and carry their own probability. It is trained on
labelled findings that are made from rules here: secrets of many shapes in the contexts that carry
them, against words, numbers, paths, addresses and hyphenated prose in the same contexts. Probabilities
are calibrated by a temperature on findings kept aside, and the threshold is the highest one that
still recalls RECALL of the secrets among them.

Nulls: a null text is empty and has no spans. Texts are scanned whole. Rows are independent of each
other: repeated rows repeat their result, an empty table gives an empty one, other columns pass by.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm import common

#: Fixed patterns: kind, expression, group that counts, its least length.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
PATTERNS = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))

#: A further candidate: a run of key characters with letters and digits in it.
LEAST = 12
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
PART = re.compile(rf"[^/=]{{{LEAST},}}")
#: A longer run is no path: its windows see all of its parts, which aren't scored once more.
BLOB = 512
#: Windows that are scored at once.
SCORED = 4096

#: Characters of a window, on either side, and from window to window; network sizes; findings; the threshold's constraint.
WIDTH, SIDE, STRIDE = 48, 24, 16
CHANNELS, FILTERS, KERNEL, HIDDEN = 12, 24, 5, 24
FINDINGS, EPOCHS, SEED = 4000, 6, 17
RECALL = 0.99
SHARD_BYTES = 2 << 20

_CLASSES = np.zeros(128, np.int64)
for _i, _group in enumerate(("abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "01234", "56789", "+/", "_-", "=", ":", "\"'`", " ", "\n\t\r", ".,;!?", "()[]{}<>", "#$%&*@^~|\\"), 1):
    for _c in _group:
        _CLASSES[ord(_c)] = _i
#: Class of the rest of ASCII is 0; further ones: other characters, and outside the text.
N_CLASSES, _OTHER, _OUTSIDE = 19, 17, 18


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed patterns' matches, in order."""
    return [(a, kind, b) for a, kind, b, _ in matched(text)[0]]


def matched(text: str) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """The fixed patterns' matches in order, (start, kind's number, end, start of what counts), and where
    values of assignments and access ids stand that are too short to be matches."""
    out, short = [], []
    for kind, (_, pattern, group, least) in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), kind, m.end(), m.start(group)))
            elif pattern is not HEX:
                short.append(m.span(group))
    return sorted(out), short


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Key-like runs, with letters and digits, between the patterns' spans, and such parts of them."""
    spans: list[list[int]] = []
    for a, b in sorted((a, b) for a, _, b in base):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    keyed = lambda run: any(c.isdigit() for c in run) and any(c.isalpha() for c in run)
    out, at = [], 0
    for m in CANDIDATE.finditer(text):
        begin, free = m.start(), []
        while at < len(spans) and spans[at][1] <= m.start():
            at += 1
        for k in range(at, len(spans)):
            if spans[k][0] >= m.end():
                break
            free.append((begin, spans[k][0]))
            begin = spans[k][1]
        for a, b in [*free, (begin, m.end())]:
            if b - a >= LEAST and keyed(text[a:b]):
                out.append((a, b))
                if b - a <= BLOB:
                    parts = [(a + p.start(), a + p.end()) for p in PART.finditer(text[a:b]) if keyed(p.group())]
                    out += [p for p in parts if p != (a, b)]
    return out


def windows(start: int, end: int) -> Iterator[tuple[int, int]]:
    """A candidate, or where it is longer than WIDTH, overlapping windows over all of it, one after the other."""
    if end - start <= WIDTH:
        yield start, end
        return
    for a in range(start, end - WIDTH, STRIDE):
        yield a, a + WIDTH
    yield end - WIDTH, end


def encode(text: str, start: int, end: int) -> np.ndarray:
    """Character classes around a window: context, its characters, context."""
    body = text[start:end]
    left, right = text[max(0, start - SIDE) : start], text[end : end + SIDE]
    codes = np.full(SIDE + WIDTH + SIDE, _OUTSIDE, np.int64)
    for at, part in ((SIDE - len(left), left), (SIDE, body), (SIDE + WIDTH, right)):
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes[at : at + len(part)] = np.where(points < 128, _CLASSES[np.minimum(points, 127)], _OTHER)
    return codes


class Network:
    """Embedding, convolution, ReLU, maximum over each of the three regions, a hidden layer, a logit."""

    def __init__(self, rng: np.random.Generator):
        scale = lambda *s: rng.normal(0, 1 / np.sqrt(np.prod(s[:-1])), s)
        self.p = {"e": rng.normal(0, 0.5, (N_CLASSES, CHANNELS)), "k": scale(KERNEL * CHANNELS, FILTERS), "kb": np.zeros(FILTERS), "h": scale(6 * FILTERS, HIDDEN), "hb": np.zeros(HIDDEN), "o": scale(HIDDEN, 1), "ob": np.zeros(1)}
        self.temperature, self.threshold = 1.0, 0.5

    def forward(self, codes: np.ndarray):
        p, n = self.p, len(codes)
        x = p["e"][codes]
        steps = codes.shape[1] - KERNEL + 1
        cols = np.concatenate([x[:, i : i + steps] for i in range(KERNEL)], axis=2)
        act = np.maximum(cols @ p["k"] + p["kb"], 0)
        cuts = (0, SIDE - KERNEL // 2, SIDE + WIDTH - KERNEL // 2, steps)
        parts = [act[:, a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        top = [q.argmax(1) for q in parts]
        pooled = np.concatenate([*(q.max(1) for q in parts), *(q.mean(1) for q in parts)], axis=1)
        hidden = np.maximum(pooled @ p["h"] + p["hb"], 0)
        return (hidden @ p["o"] + p["ob"])[:, 0], (codes, cols, act, cuts, top, pooled, hidden, n)

    def step(self, codes, labels, rate, state):
        logit, (codes, cols, act, cuts, top, pooled, hidden, n) = self.forward(codes)
        p, g = self.p, {}
        d = ((1 / (1 + np.exp(-logit)) - labels) / n)[:, None]
        g["o"], g["ob"] = hidden.T @ d, d.sum(0)
        dh = (d @ p["o"].T) * (hidden > 0)
        g["h"], g["hb"] = pooled.T @ dh, dh.sum(0)
        dp = dh @ p["h"].T
        da = np.zeros_like(act)
        rows, cols_ = np.arange(n)[:, None], np.arange(FILTERS)[None, :]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            da[rows, a + top[i], cols_] += dp[:, i * FILTERS : (i + 1) * FILTERS]
            da[:, a:b] += dp[:, None, (3 + i) * FILTERS : (4 + i) * FILTERS] / (b - a)
        da *= act > 0
        g["k"], g["kb"] = np.tensordot(cols, da, ((0, 1), (0, 1))), da.sum((0, 1))
        dc = da @ p["k"].T
        g["e"] = np.zeros_like(p["e"])
        steps = act.shape[1]
        for i in range(KERNEL):
            np.add.at(g["e"], codes[:, i : i + steps].ravel(), dc[:, :, i * CHANNELS : (i + 1) * CHANNELS].reshape(-1, CHANNELS))
        state["t"] += 1
        for name, grad in g.items():
            m, v = state.setdefault(name, [0.0, 0.0])
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            state[name] = [m, v]
            p[name] -= rate * (m / (1 - 0.9 ** state["t"])) / (np.sqrt(v / (1 - 0.999 ** state["t"])) + 1e-8)

    def probability(self, codes: np.ndarray) -> np.ndarray:
        out = [1 / (1 + np.exp(-self.forward(codes[i : i + 512])[0] / self.temperature)) for i in range(0, len(codes), 512)]
        return np.concatenate(out) if out else np.zeros(0)


def findings(n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Labelled windows of n findings: key material of several alphabets, alone or within a longer run,
    assigned as the patterns have it, and what merely looks like it. A window that holds less than LEAST
    of a key, or a part of a shorter one, is not used."""
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    draw = lambda alphabet, k: "".join(rng.choice(list(alphabet), k))
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "ment", "tion", "eau", "que", "ch", "ung", "keit", "ver", "los", "ción", "ar", "pa", "vi", "le", "sch"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 6)))
    prose = lambda k: " ".join(word() for _ in range(k))

    def secret() -> str:
        k = int(rng.integers(14, 72))
        kind = rng.integers(6)
        if kind == 0:
            return draw(lower + upper + digits, k)
        if kind == 1:
            return draw(lower + upper + digits + "+/", k) + "=" * int(rng.integers(0, 3))
        if kind == 2:
            return str(rng.choice(["ghp_", "sk-", "sk_live_", "xoxb-", "glpat-", "npm_", "pat-"])) + draw(lower + upper + digits, k)
        if kind == 3:
            return draw(upper + digits, k)
        if kind == 4:
            return draw(lower + digits, k)
        return draw(lower + upper + digits + "_-", k)

    def harmless() -> str:
        kind = rng.integers(8)
        number = lambda k: draw(digits, k)
        if kind == 0:
            return "-".join(word() for _ in range(rng.integers(2, 8))) + "-" + number(int(rng.integers(1, 5)))
        if kind == 1:
            return "/".join(word() for _ in range(rng.integers(3, 8))) + "/" + number(int(rng.integers(1, 6)))
        if kind == 2:
            return "_".join(word() for _ in range(rng.integers(2, 8))) + number(int(rng.integers(1, 5)))
        if kind == 3:
            return "".join(word() for _ in range(rng.integers(2, 9))) + number(int(rng.integers(1, 5)))
        if kind == 4:
            return "".join(word().title() for _ in range(rng.integers(2, 9))) + number(int(rng.integers(1, 4)))
        if kind == 5:
            return f"{number(4)}-{number(2)}-{number(2)}T{number(6)}Z" + (f"-{word()}{word()}" if rng.random() < 0.5 else "")
        if kind == 6:
            return str(rng.choice(["=", "-", "_"])) * int(rng.integers(16, 40)) + number(2) + word() * 2
        return number(int(rng.integers(16, 30))) + word()

    def assigned() -> tuple[str, str, str]:
        """Before, value and after of an assignment, or a bare hexadecimal or access id."""
        kind = rng.integers(4) if label else 3
        if kind == 0:
            return "", draw("0123456789abcdef", int(rng.integers(16, 65))), ""
        if kind == 1:
            return "", "AKIA" + draw(upper + digits, int(rng.integers(8, 22))), ""
        name = str(rng.choice(["password", "Passwd", "secret", "token", "TOKEN", "api_key", "apikey"])) + str(rng.choice([": ", "=", " = ", ":="]))
        mark = str(rng.choice(["", "", '"', "'"]))
        value = draw(lower + upper + digits + "_-.", int(rng.integers(7, 16))) if kind == 2 else draw(str(rng.choice(["0123456789abcdef", lower + upper + digits])), int(rng.integers(12, 48))) if label else str(rng.choice(["-", "_", "."])).join(word() for _ in range(rng.integers(1, 5)))
        return name + mark, value, mark

    codes, labels = [], []
    for _ in range(n):
        label = int(rng.random() < 0.4)
        lead_in = tail = ""
        if of_pattern := rng.random() < 0.25:
            lead_in, body, tail = assigned()
        else:
            body = secret() if label else harmless()
        lead = rng.integers(4)
        before = "" if lead == 0 else str(rng.choice(["key: ", "auth=", "Bearer ", "credential = '", "\"private\": \"", "id=", "see ", "file ", "url /"])) if lead == 1 else prose(3) + " "
        after = str(rng.choice(["", "\n", " ", "'", '",', ". ", ", "])) + (prose(3) if rng.random() < 0.7 else "")
        if label and not of_pattern and rng.random() < 0.4:  # within a longer run
            mark = str(rng.choice(["/", "/", "_", "-", "="]))
            run = lambda: mark.join(word() for _ in range(rng.integers(1, 7)))  # noqa: B023, E731
            lead_in, tail = run() + mark, mark + run()
        text = before + lead_in + body + tail + after
        begin, end = (at := len(before) + len(lead_in)), at + len(body)
        base, short = matched(text)
        for a, b in [*((own, e) for _, _, e, own in base), *short, *candidates(text, [m[:3] for m in base])]:
            for x, y in windows(a, b):
                held = min(y, end) - max(x, begin) if label else 0
                if held <= 0 or held >= min(LEAST, end - begin):
                    codes.append(encode(text, x, y))
                    labels.append(int(held > 0))
    return np.array(codes), np.array(labels, float)


@functools.lru_cache(maxsize=1)
def trained() -> Network:
    """The network, from FINDINGS labelled findings; the last quarter sets temperature and threshold."""
    rng = np.random.default_rng(SEED)
    codes, labels = findings(FINDINGS, rng)
    cut = len(codes) * 3 // 4
    net, state = Network(rng), {"t": 0}
    for epoch in range(EPOCHS):
        order = rng.permutation(cut)
        for i in range(0, cut, 64):
            net.step(codes[order[i : i + 64]], labels[order[i : i + 64]], 0.004 * 0.7**epoch, state)
    logit, truth = net.forward(codes[cut:])[0], labels[cut:]
    loss = lambda t: np.mean(np.logaddexp(0, -(2 * truth - 1) * logit / t))
    net.temperature = float(min(np.geomspace(0.25, 8, 60), key=loss))
    p = net.probability(codes[cut:])
    # The highest threshold that still recalls RECALL of the secrets.
    net.threshold = float(np.quantile(p[truth == 1], 1 - RECALL, method="lower"))
    return net


def _joined(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan(batches: Iterator[pa.RecordBatch], net: Network, keep: list[str], column: int) -> Iterator[pa.RecordBatch]:
    for shard in common.shards(batches, column, SHARD_BYTES):
        texts = [t or "" for t in shard.column(column).to_pylist()]
        found = [matched(t) for t in texts]
        base = [[m[:3] for m in f] for f, _ in found]
        above: list[list] = [[] for _ in texts]
        sure = [[0.0] * len(f) for f in base]

        def places() -> Iterator[tuple[int, int, int, int]]:
            """Windows of the patterns' own matches, by their number, and of the further candidates (-1)."""
            for i, (f, short) in enumerate(found):  # noqa: B023
                yield from ((i, k, x, y) for k, (_, _, b, own) in enumerate(f) for x, y in windows(own, b))
                yield from ((i, -1, x, y) for a, b in (*short, *candidates(texts[i], base[i])) for x, y in windows(a, b))  # noqa: B023

        every = places()
        while part := list(islice(every, SCORED)):
            chance = net.probability(np.array([encode(texts[i], a, b) for i, _, a, b in part]))
            for (i, k, a, b), p in zip(part, chance.tolist(), strict=True):
                if k >= 0:
                    sure[i][k] = max(sure[i][k], p)
                elif p >= net.threshold:
                    # Windows come in order within a candidate, so what meets is joined as it is found.
                    if above[i] and above[i][-1][0] <= a < above[i][-1][1]:
                        above[i][-1] = (above[i][-1][0], max(b, above[i][-1][1]))
                    else:
                        above[i].append((a, b))
        added = [[(a, len(PATTERNS), b) for a, b in _joined(x)] for x in above]
        names = [p[0] for p in PATTERNS] + ["learned"]
        told = lambda spans: ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
        count = lambda kind: [sum(k == kind for _, k, _ in s) for s in base]
        out = {n: shard.column(n) for n in keep} | {f"n_{names[k]}": pa.array(count(k), pa.int64()) for k in range(3)}
        out["base_sha256"] = [hashlib.sha256(told(s).encode()).hexdigest() for s in base]
        out["spans"] = [told(sorted(s + x)) for s, x in zip(base, added, strict=True)]
        out["base_scores"] = [",".join(f"{p:.3f}" for p in s) for s in sure]
        yield from pa.table(out).to_batches()


def scan(docs: DataFrame, text="text", doc_id="doc_id") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined) and base_scores (the
    network's probabilities of the patterns' spans, likewise) of each row."""
    common.bounded_batches(docs.sparkSession)
    net = trained()
    rows = docs.select(F.col(doc_id), F.col(text))
    schema = f"{rows.schema[0].simpleString().split(':')[0]} {rows.schema[0].dataType.simpleString()}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, base_scores string"
    return rows.mapInArrow(lambda batches: _scan(batches, net, [doc_id], 1), schema)


def op9(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document, by the contract of op9."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
