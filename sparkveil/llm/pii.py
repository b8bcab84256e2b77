"""Personal data by a skip-chain conditional random field.

The nodes of a document's graph are its tokens with a digit or an at sign; all other tokens are fixed to
"outside" by the model, so that leaving them out changes no marginal. Neighbouring nodes are linked in a
chain; tokens that are equal or similar (equal but for case and punctuation) are linked across
any distance, each occurrence with the next, and share a potential that favours equal types. Loopy
sum-product passes find marginals, for all documents of a batch at once; the likeliest labels are read as
begin/inside spans.

The weights are trained here by pseudo-likelihood, on sentences made up for it (``SENTENCES`` of them, the
only bound) with e-mail addresses, telephone and card numbers, IP addresses, keys and identity numbers,
beside prices, dates, versions and counts that are none.

Defined cases: null or empty text has no entities; null doc_id is scanned and reported as null; repeated
rows are reported again; a whole text is scanned however long; ties between labels go to the first in
``LABELS``, so to "outside" before others; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import buffer_of, clean_text, pieces, small_batches

TYPES = ["EMAIL", "PHONE", "IP", "CARD", "KEY", "ID"]
LABELS = ["O", *(f"{x}-{t}" for t in TYPES for x in "BI")]
L = len(LABELS)
SENTENCES = 4000
ROUNDS = 10
PIECE = 4_000_000

_DELIMITER = np.zeros(256, bool)
_DELIMITER[[*b" \t\n\r\v\f=\"'<>,;|{}[]`"]] = True
_HIT = np.zeros(256, bool)
_HIT[[*range(48, 58), 64]] = True
_EDGE = "!?#$%&*._-:/\\~^"

_HINTS = {
    "mail": {"email", "mail", "contact", "write", "correo", "courriel"},
    "call": {"phone", "tel", "call", "mobile", "fax", "cell", "dial", "telephone", "telefon", "teléfono"},
    "host": {"ip", "host", "server", "address", "ping", "from"},
    "card": {"card", "visa", "credit", "debit", "mastercard", "payment", "karte", "carte"},
    "key": {"token", "key", "secret", "password", "apikey", "api_key", "access_token", "bearer", "pwd"},
    "id": {"ssn", "iban", "social", "passport", "tax", "identity"},
    "money": {"usd", "eur", "price", "cost", "total", "paid", "$", "euro", "dollars"},
    "count": {"page", "version", "chapter", "section", "figure", "year", "in", "item", "order", "row", "v", "invoice"},
}
_SHAPES = {
    "email": r"[\w.%+-]+@[\w-]+(\.[\w-]+)+",
    "at": r".*@.*",
    "quad": r"(\d{1,3}\.){3}\d{1,3}",
    "bytes": r"((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)",
    "dots": r"\d+(\.\d+)+",
    "int1": r"\d",
    "int2": r"\d{2}",
    "int3": r"\d{3}",
    "int4": r"\d{4}",
    "int5-8": r"\d{5,8}",
    "int9-12": r"\d{9,12}",
    "int13-19": r"\d{13,19}",
    "int20": r"\d{20,}",
    "year": r"(19|20)\d\d",
    "four4": r"\d{4}-\d{4}-\d{4}-\d{4}",
    "plus": r"\+\d{1,3}",
    "plusall": r"\+\d{7,15}",
    "area": r"\(\d{2,4}\)",
    "local": r"\d{3}-\d{4}",
    "full": r"\(?\d{3}\)?[-.]\d{3}[-.]\d{4}",
    "plusfull": r"\+\d{1,3}[-.]\(?\d{2,4}\)?([-.]\d{2,4})+",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "iban": r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}",
    "hex32": r"[0-9a-fA-F]{32,}",
    "hex16": r"[0-9a-fA-F]{16,31}",
    "mixed20": r"(?=.*\d)(?=.*[A-Za-z])[\w/+.-]{20,}",
    "date": r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}",
    "clock": r"\d{1,2}:\d{2}(:\d{2})?",
    "ordinal": r"\d+(st|nd|rd|th)",
    "short": r".{1,6}",
    "wordy": r"[^\W\d_]+\d{1,4}",
}


class Features:
    """Numbers of a token's features; compiled where it is used."""

    names = ["bias", *_SHAPES, "luhn", *(f"{k}{s}" for k in _HINTS for s in ("<", ">")), "quoted", "assigned", "follows", "followed", "other"]

    def __init__(self) -> None:
        self.at = {n: i for i, n in enumerate(self.names)}
        self.shapes = [(self.at[k], re.compile(p)) for k, p in _SHAPES.items()]
        self.hints = {w: k for k, ws in _HINTS.items() for w in ws}

    def of(self, core: str, before: str, after: str, joined: bool, joins: bool) -> list[int]:
        own = [k for k, p in self.shapes if p.fullmatch(core)]
        own = [0, *own] if own else [0, self.at["other"]]
        digits = re.sub(r"[ -]", "", core)
        if digits.isdigit() and digits.isascii() and 13 <= len(digits) <= 19 and luhn(digits):
            own.append(self.at["luhn"])
        for text, side in ((before, "<"), (after, ">")):
            words = re.findall(r"[^\W\d]+|\$", text.lower())
            near = words[-2:] if side == "<" else words[:1]
            own += {self.at[self.hints[w] + side] for w in near if w in self.hints}
        if before[-1:] in "\"'" and before:
            own.append(self.at["quoted"])
        if re.search(r"[=:]\s*[\"']?$", before):
            own.append(self.at["assigned"])
        if joined:
            own.append(self.at["follows"])
        if joins:
            own.append(self.at["followed"])
        return own


def luhn(digits: str) -> bool:
    total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))
    return total % 10 == 0


def tokens(texts: pa.Array) -> Iterator[tuple[int, int, int, str, str, str]]:
    """(row, start, end, core, text before, text after) of the nodes, in order; places are bytes."""
    for lo, hi in pieces(buffer_of(texts)[1], PIECE):
        data, off = buffer_of(texts.slice(lo, hi - lo))
        spaced = np.full(len(data) + hi - lo, 32, np.uint8)
        spaced[np.arange(len(data)) + np.repeat(np.arange(hi - lo), np.diff(off))] = data
        first = off + np.arange(len(off))
        edges = np.concatenate([[-1], np.flatnonzero(_DELIMITER[spaced])])
        k = np.unique(np.searchsorted(edges, np.flatnonzero(_HIT[spaced])))
        if not len(k):
            continue
        starts, ends = edges[k - 1] + 1, edges[k]
        rows = np.searchsorted(first, starts, "right") - 1
        raw = spaced.tobytes()
        for r, s, e in zip(rows.tolist(), starts.tolist(), ends.tolist()):
            own = raw[s:e].decode("utf-8", "replace")
            core = own.strip(_EDGE)
            if core.count("(") != core.count(")"):
                core = core.strip("()") if not re.fullmatch(r"\(\d+\)", core) else core
            if not core:
                continue
            begin = s + len(own[: own.find(core)].encode())
            b, f = int(first[r]), int(first[r + 1]) - 1
            yield lo + r, begin - b, begin - b + len(core.encode()), core, raw[max(b, begin - 48) : begin].decode("utf-8", "ignore"), raw[begin + len(core.encode()) : min(f, e + 32)].decode("utf-8", "ignore")


def graph(nodes: list[tuple[int, int, int, str, str, str]], features: Features) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
    """Features of each node, edges of the chain and edges between alike tokens."""
    chain, skip, last = [], [], {}
    joined = [False] * (len(nodes) + 1)
    for i in range(1, len(nodes)):
        a, b = nodes[i - 1], nodes[i]
        if a[0] == b[0] and 0 <= b[1] - a[2] <= 3 and not re.search(r"\w|\n", b[4][len(b[4]) - (b[1] - a[2]) :] if b[1] > a[2] else ""):
            chain.append((i - 1, i))
            joined[i] = True
    for i, (row, _, _, core, _, _) in enumerate(nodes):
        key = row, re.sub(r"[\W_]", "", core.lower())
        if key in last:
            skip.append((last[key], i))
        last[key] = i
    return [features.of(n[3], n[4], n[5], joined[i], joined[i + 1]) for i, n in enumerate(nodes)], np.array(chain, int).reshape(-1, 2), np.array(skip, int).reshape(-1, 2)


def alike() -> np.ndarray:
    """1 for labels of the same type, begin or inside."""
    kind = np.array([0, *(t + 1 for t in range(len(TYPES)) for _ in "BI")])
    return (kind[:, None] == kind[None, :]).astype(float)


def unary(own: list[list[int]], weights: np.ndarray) -> np.ndarray:
    return np.array([weights[x].sum(0) for x in own]).reshape(-1, L)


def marginals(u: np.ndarray, chain: np.ndarray, skip: np.ndarray, link: np.ndarray, same: float, rounds: int = ROUNDS) -> np.ndarray:
    """Loopy sum-product with damping; exact after enough rounds where the graph has no cycle."""
    soft = lambda x: np.exp(x - x.max(1, keepdims=True))
    p = soft(u)
    edges = np.concatenate([chain, skip])
    if not len(edges):
        return p / p.sum(1, keepdims=True)
    src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    e, c = len(edges), len(chain)
    forth, tie = np.exp(link), np.exp(same * alike())
    msg = np.full((2 * e, L), 1 / L)
    twin = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
    for _ in range(rounds):
        total = u.copy()
        np.add.at(total, dst, np.log(msg))
        out = soft(total[src] - np.log(msg[twin]))
        new = np.empty_like(msg)
        new[:c] = out[:c] @ forth
        new[c:e] = out[c:e] @ tie
        new[e : e + c] = out[e : e + c] @ forth.T
        new[e + c :] = out[e + c :] @ tie
        msg = 0.5 * msg + 0.5 * new / new.sum(1, keepdims=True)
    total = u.copy()
    np.add.at(total, dst, np.log(msg))
    p = soft(total)
    return p / p.sum(1, keepdims=True)


def made_up(n: int, seed: int = 11) -> tuple[list[str], list[list[tuple[int, int, str]]]]:
    """Sentences and the (start, end, type) of their entities, places in characters."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "ma", "li", "do", "ca", "el", "ou", "ti"]) for _ in range(r.randint(1, 4)))

    def card() -> str:
        body = digits(15)
        body = next(body + c for c in "0123456789" if luhn(body + c)) if r.random() < 0.4 else body + digits(1)
        return body if r.random() < 0.8 else "-".join(body[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"+{r.randint(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{r.randint(1, 99)}-{a}-{b}-{c}", f"+{digits(11)}", f"+1 {a}-{b}-{c}", f"{a}.{b}.{c}"])

    def email() -> str:
        return f"{word()}{r.choice(['', '.', '_', '.' + word()])}{r.choice(['', digits(2)])}".rstrip("._") + f"@{word()}{r.choice(['', digits(1)])}.{r.choice(['com', 'example.com', 'org', 'co.uk', 'example.org'])}"

    kinds = {
        "EMAIL": (email, ["", "", "email", "contact", "write to", "mail:"]),
        "PHONE": (phone, ["", "", "call", "phone:", "tel", "mobile"]),
        "IP": (lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), ["", "", "host", "ip", "from", "server"]),
        "CARD": (card, ["", "", "card", "visa", "credit card", "payment"]),
        "KEY": (lambda: "".join(r.choice(r.choice(["0123456789abcdef", "0123456789ABCDEF", "0123456789abcdefghijklmnopqrstuvwxyz"])) for _ in range(r.choice([32, 40, 40, 64]))), ["token = ", 'token = "', "", "key:", "secret =", "password:"]),
        "ID": (lambda: r.choice([f"{digits(3)}-{digits(2)}-{digits(4)}", f"{r.choice(['DE', 'FR', 'ES'])}{digits(2)}{digits(18)}"]), ["", "ssn", "iban", "tax"]),
    }
    harmless = [
        lambda: digits(r.randint(1, 6)), lambda: f"{r.randint(1, 12)}.{r.randint(0, 99)}", lambda: f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}",
        lambda: f"20{digits(2)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{r.randint(0, 23)}:{digits(2)}", lambda: str(r.randint(1900, 2030)), lambda: f"{r.randint(1, 99)}%",
        lambda: f"page {r.randint(1, 999)}", lambda: f"version {r.randint(1, 9)}.{r.randint(0, 9)}", lambda: f"$ {digits(4)}", lambda: f"{r.randint(1, 30)}th", lambda: f"item {digits(8)}",
        lambda: f"{r.randint(1, 12)}/{r.randint(1, 28)}/{r.randint(1990, 2030)}", lambda: f"order {digits(10)}", lambda: f"{word()}{digits(2)}", lambda: f"@{word()}", lambda: f"invoice {digits(9)}", lambda: f"{digits(3)}",
    ]
    texts, spans = [], []
    for _ in range(n):
        text, own, past = "", [], []
        for _ in range(r.randint(2, 9)):
            x = r.random()
            if x < 0.3:
                kind = r.choice(TYPES)
                make, hints = kinds[kind]
                value = r.choice(past)[1] if past and r.random() < 0.3 else None
                kind = next((k for k, v in past if v == value), kind) if value else kind
                value = value or make()
                past.append((kind, value))
                hint = r.choice(hints)
                text += hint + (" " if hint and hint[-1] not in '" ' else "")
                own.append((len(text), len(text) + len(value), kind))
                text += value + ('"' if hint.endswith('"') else r.choice(["", "", "", ".", ",", "!!", "***"]))
            elif x < 0.55:
                text += r.choice(harmless)() + r.choice(["", "", ".", ",", "%%%"])
            else:
                text += " ".join(word() for _ in range(r.randint(1, 6)))
            text += r.choice([" ", " ", " ", "\n"])
        texts.append(text)
        spans.append(own)
    return texts, spans


def labels_of(nodes: list, spans: list[list[tuple[int, int, str]]], texts: list[str]) -> np.ndarray:
    out = np.zeros(len(nodes), int)
    started: set = set()
    for i, (row, s, e, *_) in enumerate(nodes):
        text = texts[row].encode()
        s, e = len(text[:s].decode()), len(text[:e].decode())
        for k, (a, b, kind) in enumerate(spans[row]):
            if s < b and e > a:
                out[i] = LABELS.index(("I-" if (row, k) in started else "B-") + kind)
                started.add((row, k))
    return out


def train(n: int = SENTENCES, seed: int = 11, steps: int = 250, decay: float = 2e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of features, of the chain's links and of equal types, by Adam on the pseudo-likelihood."""
    texts, spans = made_up(n, seed)
    features = Features()
    nodes = list(tokens(pa.array(texts, pa.large_string())))
    own, chain, skip = graph(nodes, features)
    y = labels_of(nodes, spans, texts)
    x = np.zeros((len(own), len(Features.names)))
    for i, f in enumerate(own):
        x[i, f] = 1
    prev, nxt, tied = np.zeros((len(y), L)), np.zeros((len(y), L)), np.zeros((len(y), L))
    eye = np.eye(L)
    prev[chain[:, 1]], nxt[chain[:, 0]] = eye[y[chain[:, 0]]], eye[y[chain[:, 1]]]
    same = alike()
    np.add.at(tied, skip[:, 0], same[y[skip[:, 1]]])
    np.add.at(tied, skip[:, 1], same[y[skip[:, 0]]])
    w = [np.zeros((x.shape[1], L)), np.zeros((L, L)), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for t in range(1, steps + 1):
        z = x @ w[0] + prev @ w[1] + nxt @ w[1].T + w[2] * tied
        p = np.exp(z - z.max(1, keepdims=True))
        p = (p / p.sum(1, keepdims=True) - eye[y]) / len(y)
        grads = [x.T @ p, prev.T @ p + p.T @ nxt, np.array([(tied * p).sum()])]
        for k, g in enumerate(grads):
            g = g + decay * w[k] / 10
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - 0.1 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-9)
    return w[0], w[1], float(max(w[2][0], 0.5))


def decode(nodes: list, model: tuple[np.ndarray, np.ndarray, float], features: Features) -> list[tuple[int, str, int, int]]:
    """(row, type, start, end) in bytes."""
    if not nodes:
        return []
    own, chain, skip = graph(nodes, features)
    best = marginals(unary(own, model[0]), chain, skip, model[1], model[2]).argmax(1)
    linked, out = {b for _, b in chain.tolist()}, []
    for i, (row, s, e, *_) in enumerate(nodes):
        if best[i] == 0:
            continue
        kind = LABELS[best[i]]
        if kind[0] == "I" and i in linked and out and best[i - 1] and LABELS[best[i - 1]][2:] == kind[2:]:
            out[-1] = (*out[-1][:3], e)
        else:
            out.append((row, kind[2:], s, e))
    return out


def find_pii(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float] | None = None) -> DataFrame:
    """(doc_id, type, start, end, value) of each entity; places count characters from 0, end excluded."""
    small_batches(docs.sparkSession)
    model = model or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            texts = clean_text(b.column(1))
            data, off = buffer_of(texts)
            rows = []
            for row, kind, s, e in decode(list(tokens(texts)), model, features):
                raw = data[off[row] : off[row] + e]
                start = int(((raw[:s] & 0xC0) != 0x80).sum())
                value = raw[s:].tobytes().decode("utf-8", "replace")
                rows.append((b.column(0)[row].as_py(), kind, start, start + len(value), value))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "type", "start", "end", "value"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, type string, start long, end long, value string")
