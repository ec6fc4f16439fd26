"""Personal data: fixed patterns, and a skip-chain conditional random field over the document's tokens.

Nodes are the token runs with a digit or @. A linear chain joins neighbours; skip edges join a node with the last node
before it that has the same digits or the same letters-and-digits (repeated mentions), however distant, and with the
last one of the same shape. Edge potentials reward equal labels; loopy message passing spreads what is known of one
mention to the others. Nodes that a fixed pattern covers are evidence where there are any; other nodes that end up with a
label become spans, in documents without evidence too. Weights of features and of edges are learned together by
pseudo-likelihood; features are left out at random there, so that edges learn what they can tell on their own. So that
features can tell without evidence, training also reads the sample with its personal data written in forms that the
fixed patterns miss, some of it mentioned again in another form.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import map_arrow

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
_EMAIL = rf"[{_LOCAL}]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
EMAIL_HERE = re.compile(_EMAIL)
#: Within a run of local-part characters only its first can start a match, which keeps long runs linear.
EMAIL = re.compile(rf"(?<![{_LOCAL}]){_EMAIL}")
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
NODE = re.compile(r"[A-Za-z0-9._%+@()-]*[0-9@][A-Za-z0-9._%+@()-]*(?: [A-Za-z0-9._%+@()-]*[0-9@][A-Za-z0-9._%+@()-]*)*")

LABELS = ("other", *KINDS)
FEATURES = 1 << 11
#: Documents that the field is trained on, about, of those that may have base spans and of the others with digits or @ (the
#: ones with the smallest hash of doc_id and text), and the characters that such a document has at most.
SAMPLE_DOCS, SAMPLE_CHARS = 200, 30_000
#: What texts with base spans have.
LIKELY = r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.[A-Za-z0-9-]|[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]|\+[0-9][\x20().0-9-]{8}|[0-9](?:[\x20-]?[0-9]){13}"
#: Copies of a training text with its personal data in other forms, and the share of features that an update leaves out.
REWRITTEN, DROPPED = 6, 0.3
#: Probability from which a node becomes a span.
SURE = 0.75
ROUNDS, DAMPING = 12, 0.3
EPOCHS, RATE, BATCH = 24, 0.3, 32


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points by start, then kind as listed."""
    found = []
    if "@" in text:
        at = 0
        while m := EMAIL_HERE.match(text, at) or EMAIL.search(text, at):
            found.append(("email", *m.span()))
            at = m.end()
    if _ANY.search(text):
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def at_sign(word: str) -> str:
    """Where a word has its @: none, alone, at its start, end, or inside."""
    return "none" if "@" not in word else "alone" if word == "@" else "start" if word[0] == "@" else "end" if word[-1] == "@" else "inside"


class Document:
    """Nodes, their features, known labels and edges."""

    def __init__(self, text: str, base: list[tuple[str, int, int]]):
        self.spans = [m.span() for m in NODE.finditer(text)]
        self.known = np.zeros(len(self.spans), np.int64)
        k = 0
        for kind, s, e in base:
            while k < len(self.spans) and self.spans[k][1] <= s:
                k += 1
            j = k
            while j < len(self.spans) and self.spans[j][0] < e:
                self.known[j] = LABELS.index(kind)
                j += 1
        self.features, self.edges, self.missing, last = [], [], set(), {}
        for i, (s, e) in enumerate(self.spans):
            word = text[s:e].strip("().,- ")
            shape = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]", "0", word)))[:24]
            digits = re.sub(r"[^0-9]", "", word)
            before, after = text[max(0, s - 24) : s].lower().split()[-1:], text[e : e + 24].lower().split()[:1]
            names = [f"s{shape}", f"S{re.sub(r'0+', '0', shape)}", f"n{min(len(digits), 20)}", f"@{at_sign(word)}{'.' in ''.join(after).strip('.,;:')}", f".{word.count('.')}", f"+{word.startswith('+')}", f"l{luhn(digits) if len(digits) > 9 else 0}", "b" + "".join(before), "a" + "".join(after), "bias"]
            self.features.append([zlib.crc32(x.encode("utf-8", "replace")) % FEATURES for x in names])
            if i:
                self.edges.append((i - 1, i, 0))
            for kind, key in ((1, "d" + digits[-7:] if len(digits) >= 7 else ""), (1, "w" + re.sub(r"[^a-z0-9]", "", word.lower()) if len(word) >= 6 else ""), (2, "s" + shape)):
                if key:
                    if key in last:
                        self.edges.append((last[key], i, kind))
                    last[key] = i


class Field:
    """unary[feature, label] and agree[edge kind]: chain, repeated mention, same shape."""

    def __init__(self, unary: np.ndarray, agree: np.ndarray):
        self.unary, self.agree = unary, agree

    def marginals(self, d: Document) -> np.ndarray:
        """Label probabilities of every node by loopy belief propagation; known labels are evidence."""
        n, k = len(d.spans), len(LABELS)
        score = self.unary[np.array(d.features)].sum(1)
        score = score - score.max(1, keepdims=True)
        score[d.known > 0] -= 12.0
        score[np.flatnonzero(d.known), d.known[d.known > 0]] += 24.0
        if d.edges:
            a, b, kind = np.array(d.edges).T
            src, dst = np.concatenate([a, b]), np.concatenate([b, a])
            back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
            weight = np.exp(self.agree[np.concatenate([kind, kind])])[:, None]
            message = np.zeros((len(src), k))
            for _ in range(ROUNDS):
                total = score.copy()
                np.add.at(total, dst, message)
                cavity = total[src] - message[back]
                p = np.exp(cavity - cavity.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                out = np.log(1 + (weight - 1) * p)
                message = DAMPING * message + (1 - DAMPING) * (out - out.mean(1, keepdims=True))
            np.add.at(score, dst, message)
        p = np.exp(score - score.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def spans(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Nodes free of base spans that have a label for sure, as crf-email and so on."""
        d = Document(text, base)
        if not (d.known == 0).any():
            return []
        p = self.marginals(d)
        best = p.argmax(1)
        return [(f"crf-{LABELS[k]}", *d.spans[i]) for i, k in enumerate(best.tolist()) if k and d.known[i] == 0 and p[i, k] >= SURE]


def rewritten(text: str, base: list[tuple[str, int, int]], r: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its base spans in other forms (no +, other marks between digits, an address cut apart), and where they are then."""
    out, spans, at = [], [], 0
    for kind, s, e in base:
        if s < at:
            continue
        form, mark = text[s:e], r.choice(" .-_")
        if kind == "phone":
            form = re.sub(r"^\+[0-9]{1,3}(?![0-9])[ .-]*|^\+", "", form)
            digits = re.sub(r"[^0-9]", "", form)
            form = r.choice((form, mark.join(re.findall(r"[0-9]+", form)), f"{digits[:-7]}{mark}{digits[-7:-4]}-{digits[-4:]}"))
        elif kind == "card":
            digits = re.sub(r"[^0-9]", "", form)
            form = mark.join(digits[k : k + 4] for k in range(0, len(digits), 4))
        elif kind == "email":
            if r.random() < 0.7:  # other names and hosts than the sample's
                part = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))
                form = f"{part()}{r.choice(('', '.' + part(), '_' + part(), str(r.randint(1, 99))))}@{part()}.{r.choice(('com', 'org', 'net', part()))}"
            form = r.choice((form.split("@")[0] + "@" + form.split("@")[1].split(".")[0], form.replace("@", "@ "), form.replace("@", " @ ")))
        else:
            form = form.replace(".", mark if mark != "." else "-")
        out += [text[at:s], form]
        begin = sum(map(len, out)) - len(form) if not spans else spans[-1][2] + len(out[-2])
        spans.append((kind, begin, begin + len(form)))
        at = e
    return "".join(out) + text[at:], spans


def ordinary(r: random.Random) -> str:
    """A number that is no personal data: a date, time, amount, version, measure, range or order number."""
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    year, month, day = f"{r.choice(('19', '20'))}{n(2)}", f"{r.randint(1, 12):02}", f"{r.randint(1, 31):02}"
    return r.choice((
        f"{year}-{month}-{day}", f"{day}.{month}.{year}", f"{month}/{day}/{year}", f"{r.randint(0, 23)}:{n(2)}", f"${n(2)}.{n(2)}", f"{n(1)},{n(3)},{n(3)}", f"v{n(1)}.{n(2)}.{n(1)}", f"{n(1)}.{n(1)}",
        f"{n(2)}kg", f"{year}-{n(2)}", f"#{n(5)}", f"{n(1)}-{n(1)}-{n(1)}", f"{n(3)}x{n(3)}", year, n(r.randint(1, 6)), f"@{r.choice('abcdefgh')}{n(2)}", f"{n(2)}%", f"ISBN {n(3)}-{n(1)}-{n(4)}-{n(4)}-{n(1)}",
    ))


def mentioned_again(text: str, spans: list[tuple[str, int, int]], r: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with some of its spans once more at its end, with other marks and a few words of the text around them, and
    as many ordinary numbers."""
    out, found, plain = text, list(spans), [w for w in text.split() if w.isalpha()] or ["and"]
    for kind, s, e in spans:
        if r.random() < 0.5:
            form = text[s:e]
            digits = re.sub(r"[^0-9]", "", form)
            if kind != "email" and len(digits) >= 7:
                form = r.choice((digits, re.sub(r"[^0-9A-Za-z]+", r.choice(" .-"), form).strip(" .-")))
            out += " " + " ".join(r.choice(plain) for _ in range(r.randint(1, 4))) + " "
            found.append((kind, len(out), len(out) + len(form)))
            out += form + " " + r.choice(plain)
        out += f" {r.choice(plain)} {ordinary(r)} {r.choice(plain)}"
    return out, found


def train(texts: list[str]) -> Field:
    """Weights of features and edges by pseudo-likelihood: each node's label, given its features and its neighbours' labels.

    A node without a label that repeats a labelled one is no example of `other`: its label counts as missing, for its
    neighbours too. Nothing to learn from leaves all weights 0.
    """
    r, docs = random.Random(7), [d for t in texts if (d := Document(t, base_spans(t))).spans]
    for t in texts:
        if base := base_spans(t):
            docs += [d for _ in range(REWRITTEN) if (d := Document(*mentioned_again(*rewritten(t, base, r), r))).spans]
    unary, agree = np.zeros((FEATURES, len(LABELS))), np.zeros(3)
    features, labels, near = [], [], []
    for d in docs:
        for i, j, kind in d.edges:
            if kind == 1 and (d.known[i] == 0) != (d.known[j] == 0):
                d.missing.add(i if d.known[i] == 0 else j)
        around = np.zeros((len(d.spans), 3, len(LABELS)))
        for i, j, kind in d.edges:
            for one, other in ((i, j), (j, i)):
                if other not in d.missing:
                    around[one, kind, d.known[other]] += 1
        some = [i for i in range(len(d.spans)) if i not in d.missing]
        features += [d.features[i] for i in some]
        labels += d.known[some].tolist()
        near.append(around[some])
    if labels:
        x, y, c = np.array(features), np.array(labels), np.concatenate(near)
        order, step = np.random.default_rng(7), RATE / np.sqrt(x.shape[1])
        for _ in range(EPOCHS):
            for rows in np.array_split(order.permutation(len(y)), max(1, len(y) // BATCH)):
                used = (order.random(x[rows].shape) >= DROPPED) / (1 - DROPPED)
                score = (unary[x[rows]] * used[:, :, None]).sum(1) + np.einsum("k,nky->ny", agree, c[rows])
                p = np.exp(score - score.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(rows)), y[rows]] -= 1
                np.add.at(unary, x[rows], -step * p[:, None, :] * used[:, :, None])
                agree -= step * np.einsum("ny,nky->k", p, c[rows]) / len(rows)
            unary *= 0.999
    return Field(unary, agree)


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def sample(docs: DataFrame) -> list[str]:
    """Texts to train on: about SAMPLE_DOCS of those with LIKELY and as many of the others with a digit or @, by hash."""
    some = docs.where(F.col("text").rlike("[0-9@]") & (F.length("text") <= SAMPLE_CHARS)).select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).alias("place"), F.col("text").rlike(LIKELY).alias("likely"))
    counts = {r["likely"]: r["n"] for r in some.groupBy("likely").agg(F.count("*").alias("n")).collect()}
    limit = {k: int((1 << 40) * min(1.0, SAMPLE_DOCS / max(1, counts.get(k, 0)))) for k in (True, False)}
    rows = some.where(F.col("place") < F.when(F.col("likely"), F.lit(limit[True])).otherwise(F.lit(limit[False])))
    return [r["text"] for r in sorted(rows.collect(), key=lambda r: (r["place"], r["text"]))]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id with n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of docs (doc_id, text).

    Spans are kind:start:end, code points, end exclusive, by start, then kind as in KINDS, joined by commas. The counts
    and base_sha256 are of the fixed patterns' matches; the field's own spans (crf- and the kind) never touch those.
    Null and empty texts have none (counts 0, spans ''; base_sha256 of ''). Texts are read whole. Repeated rows are
    scanned each; other columns are ignored, whatever their names. An empty table gives an empty result. The field is
    trained at each call on a bounded sample of the rows, labelled by the fixed patterns: see SAMPLE_DOCS.
    """
    field = train(sample(docs))
    kinds = (*KINDS, *(f"crf-{k}" for k in KINDS))

    def one(batch):
        n = {k: [] for k in KINDS}
        digests, spans = [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            base = base_spans(text)
            for k, v in n.items():
                v.append(sum(s[0] == k for s in base))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(sorted(base + field.spans(text, base), key=lambda s: (s[1], kinds.index(s[0])))))
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(n[k], pa.int64()) for k in KINDS], pa.array(digests), pa.array(spans)], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), one, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")
