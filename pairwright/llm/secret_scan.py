"""Secret scans: fixed patterns, and strings that a primed zstandard coder finds new.

Candidates are all runs of 12 key characters and more within CONTEXT characters of a sensitive word, before or after it
and on any line, or right after a novel run (the lines of a key). Each is compressed together with the
text around it by a coder whose dictionary holds identifiers and the most frequent words of all texts; the bytes that it
adds to the compressed context, against its length, are its novelty. Identifiers, paths and prose compress, random
strings do not.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import NOT_WORD, bytes_of, give_back, map_arrow, words

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: The maximal runs of [0-9a-f]+ that have 16 characters or more.
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18, "hex": 16}
SENSITIVE = re.compile(r"(?i:pass(?:word|wd|phrase)?|secret|token|api[_ -]?key|auth|bearer|credential|private|signature|access[_ -]?key)", re.ASCII)
RUN = re.compile(r"[A-Za-z0-9+/_-]{12,}(?:={1,2}(?![A-Za-z0-9+/_-]))?")
#: After the name of a value; names are no candidates if they hold a sensitive word.
NAMES = re.compile(r"[\"']?\x20*[:=]")
#: Between a novel run and one that goes on with it.
GAP = re.compile(r"[\s\"'\\,]{1,16}")
#: Hints without which no sensitive word can be there.
_HINT = re.compile(r"(?i:pass|secret|token|key|auth|bearer|credential|private|signature)", re.ASCII)
#: A novel string of letters and digits adds at least so many compressed bytes for each of its characters; one of letters
#: alone has ALPHABETIC characters at least, changes between capitals and small letters as often as CHANGES says (random
#: ones do after every second letter, names after every third or fourth), and adds a little more. Digits alone are never a secret here.
NOVELTY, ALPHABETIC, CHANGES, NOVELTY_ALPHABETIC = 0.62, 16, 0.3, 0.7
CONTEXT = 256
#: Identifiers that programs and configurations are full of: the dictionary's fixed part.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key client_secret client_id authorization bearer credential signature "
    "username user_id session_id request_id configuration environment production development localhost http:// https:// www.example.com "
    "/usr/local/bin /usr/local/lib /var/log /home/user/.config application/json text/plain content_type Content-Type: return_value function "
    "public static private protected final void string integer boolean import from class def self None True False null undefined const let var "
    "export default async await ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789 00000000 11111111 ffffffff deadbeef"
)
#: The dictionary's bytes for frequent words, its words and their length at most, the cells that words are counted in
#: first, how many of the fullest of them are looked into, and how often a word must occur.
DICTIONARY, DICTIONARY_WORDS, WORD_LENGTHS, CELLS, FULLEST, FREQUENT = 48_000, 6_000, (4, 15), 1 << 18, 1 << 13, 8


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points by start, then kind as listed."""
    found = []
    if "=" in text or ":" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def frequent_words(docs: DataFrame) -> list[str]:
    """The most frequent words (runs of letters and digits) of all texts, most frequent first.

    All words are counted in a sketch of fixed size; then those of its fullest cells are counted one by one. Words that
    could be a secret themselves (long or rare ones, and ones with digits) are left out.
    """
    texts = docs.select(F.col("text").cast("binary").alias("text"))

    def sketch(batches):
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            h = words(*bytes_of(b.column(0)), NOT_WORD)[0]
            total += np.bincount((h & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])
        give_back()

    cells = texts.mapInArrow(sketch, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    full = np.zeros(CELLS, bool)
    full[[r["cell"] for r in cells.orderBy(F.desc("n"), "cell").limit(FULLEST).collect()]] = True
    shared = docs.sparkSession.sparkContext.broadcast(full)
    low, high = WORD_LENGTHS

    def count(batch):
        data, at = bytes_of(batch.column(0))
        h, start, end, _ = words(data, at, NOT_WORD)
        some = np.flatnonzero(shared.value[(h & np.uint64(CELLS - 1)).astype(np.int64)] & (end - start >= low) & (end - start <= high))
        _, first, n = np.unique(h[some], return_index=True, return_counts=True)
        found = [data[start[i] : end[i]].tobytes().decode("utf-8", "replace") for i in some[first].tolist()]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(n)], ["word", "n"])

    counted = map_arrow(texts, count, "word string, n long").where(~F.col("word").rlike("[0-9]")).groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in counted.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "word").limit(DICTIONARY_WORDS).collect()]


class Coder:
    """Marginal bytes under a dictionary of identifiers and frequent words (the most frequent last, where they cost least)."""

    def __init__(self, frequent: list[str]):
        text = " ".join(reversed(frequent)).encode("utf-8", "replace")
        primed = zstandard.ZstdCompressionDict(text[-DICTIONARY:] + b" " + IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=12)
        self.coder = zstandard.ZstdCompressor(level=12, dict_data=primed, write_checksum=False, write_content_size=False)
        self.nothing = self.size(b"")

    def size(self, data: bytes) -> int:
        return len(self.coder.compress(data))

    def novelty(self, before: str, candidate: str, after: str) -> float:
        """Compressed bytes that the candidate adds, for each of its characters: the median of what it adds to the text
        around it, to the text before it, and to the dictionary alone. A coder stores few literals as they are and
        codes more of them, so that a single difference can be off by many bytes."""
        pack = lambda *parts: self.size("".join(parts).encode("utf-8", "surrogatepass"))
        added = (pack(before, candidate, after) - pack(before, after), pack(before, candidate) - pack(before), pack(candidate) - self.nothing)
        return sorted(added)[1] / len(candidate)


def case_changes(word: str) -> int:
    return sum(a.islower() != b.islower() for a, b in zip(word, word[1:], strict=False) if a.isalpha() and b.isalpha())


def novel_spans(text: str, coder: Coder, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of kind novel: incompressible candidates in sensitive context that no base span touches."""
    if not _HINT.search(text):
        return []
    found, k, end, last = [], 0, -CONTEXT - 1, -1
    hints, spans = [m.span() for m in SENSITIVE.finditer(text)], sorted((bs, be) for _, bs, be in base)
    i = covered = 0
    for m in RUN.finditer(text):
        s, e = m.span()
        while k < len(hints) and hints[k][0] <= e + CONTEXT:
            end = hints[k][1]
            k += 1
        while i < len(spans) and spans[i][0] < e:
            covered = max(covered, spans[i][1])
            i += 1
        word = m[0]
        if end < s - CONTEXT and not (last >= 0 and GAP.fullmatch(text, last, s)):
            continue
        digits, letters = re.search(r"[0-9]", word), re.search(r"[A-Za-z]", word)
        if covered > s or not letters or not digits and (len(word) < ALPHABETIC or case_changes(word) < CHANGES * (len(word) - 1)):
            continue
        if NAMES.match(text, e) and SENSITIVE.search(word):
            continue
        if coder.novelty(text[max(0, s - CONTEXT) : s], word, text[e : e + CONTEXT]) >= (NOVELTY if digits else NOVELTY_ALPHABETIC):
            found.append(("novel", s, e))
            last = e
    return found


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id with n_assign, n_access, n_hex, base_sha256, spans of every row of docs (doc_id, text).

    Spans are kind:start:end, code points, end exclusive, by start, then kind as in KINDS, joined by commas; base spans
    are the fixed patterns' matches, of which a match below its kind's length is dropped; novel ones are added and
    never touch a base span. Null and empty texts have none (n 0, spans ''; base_sha256 of ''). Texts are read whole.
    Repeated rows are scanned each; other columns are ignored, whatever their names. An empty table gives an empty result.
    The dictionary is made of the most frequent words of all whole texts: equal strings are judged alike in one call, but
    a string may be judged differently in another corpus.
    """
    frequent = frequent_words(docs)
    coder: list[Coder] = []

    def one(batch):
        if not coder:
            coder.append(Coder(frequent))
        n = {k: [] for k in KINDS[:3]}
        digests, spans = [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            base = base_spans(text)
            for k, v in n.items():
                v.append(sum(s[0] == k for s in base))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            every = sorted(base + novel_spans(text, coder[0], base), key=lambda s: (s[1], KINDS.index(s[0])))
            spans.append(joined(every))
        arrays = [batch.column(0), *[pa.array(n[k], pa.int64()) for k in KINDS[:3]], pa.array(digests), pa.array(spans)]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), one, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
