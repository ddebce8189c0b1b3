"""Personal information inside free text (problem 1).

A character-level bidirectional LSTM with CRF transitions, in numpy, marks email
addresses, phone numbers, identity numbers, street addresses and persons' names.
Long pieces of a line are read in overlapping windows; where windows overlap their
scores are mixed by the distance to the window's edge, and one Viterbi pass over
the mixed scores of the whole piece decides. `train_pii` trains the weights in
`pii_model.npz` from labelled spans.

Digits are read as one class, so that equal layouts share their result; each
worker keeps the results of the last `CACHE` different pieces.

Defined results: null and empty texts hold nothing and are returned as they are.
Lines are split at line feeds; a carriage return stays outside of placeholders.
Whole texts are read, however long. Repeated rows are kept, `found` makes its
rows distinct. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.names import GIVEN, TITLES
from ledgerloom.tables import RECORD_TABLES, spread, table

TYPES = ("email", "phone", "id_number", "street_address", "person_name")
TAGS = ["O", *[f"{p}-{t}" for t in TYPES for p in "BI"]]
#: Characters of a window, and how far windows lie apart.
WINDOW, STEP = 96, 64
BATCH = 768
#: Pieces longer than this are read one at a time, so that memory grows with one piece's length only.
VAST = 2048
CACHE = 1 << 17
MODEL = Path(__file__).with_name("pii_model.npz")

ASCII, THAI = 95, 128
VOCABULARY = ASCII + THAI + 2  # others, and the filling behind a text's end
OTHER, FILL = VOCABULARY - 2, VOCABULARY - 1
#: Pieces of a line: it is parted behind full stops that end a sentence, not behind short forms or before legal forms.
PIECES = re.compile(
    r"(?<!\b[Nn]o\.)(?<!\breg\.)(?<!\bTel\.)(?<!\bext\.)(?<!\bEngr\.)(?<!\bref\.)(?:(?<=[A-Za-z0-9)฀-๿]{2}\.)|(?<= \d\.)) (?=[A-Zก-๙])"
    r"(?!(?:[\w'&]+\.? ){0,2}(?:Ltd|Limited|Pte|Private|Sdn|Bhd|Inc|Corp|Corporation|GmbH|Gmbh|GMBH|G\.m|Co|Company|LTD|INC|and)\b)"
)
CODE_OF = np.full(0x2100, OTHER, np.int16)
CODE_OF[32:127] = np.arange(ASCII)
CODE_OF[0xE00:0xE80] = ASCII + np.arange(THAI)
CODE_OF[ord("0") : ord("9") + 1] = CODE_OF[ord("0")]
CODE_OF[0xE50:0xE5A] = CODE_OF[ord("0")]
CODE_OF[0x2010:0x2016] = CODE_OF[ord("-")]
CODE_OF[[0x2018, 0x2019]] = CODE_OF[ord("'")]
CODE_OF[[9, 0xA0]] = CODE_OF[32]
DIGIT = str.maketrans("123456789๐๑๒๓๔๕๖๗๘๙", "0" * 19)
ASCII_DIGIT = bytes.maketrans(b"123456789", b"0" * 9)


def layout(piece: str) -> str:
    """A piece with all its digits as zeros, without a carriage return at its end."""
    piece = piece.rstrip("\r")
    return piece.encode().translate(ASCII_DIGIT).decode() if piece.isascii() else piece.translate(DIGIT)



def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return CODE_OF[np.minimum(points, 0x20FF)].astype(np.int64)


class Tagger:
    """The trained network."""

    def __init__(self, weights: dict[str, np.ndarray]):
        f = {k: v.astype(np.float32) for k, v in weights.items()}
        self.hidden = f["U0"].shape[0]
        self.inputs, self.recurrent = [f["X0"], f["X1"]], [f["U0"], f["U1"]]
        self.out, self.bias, self.moves, self.start = f["W"], f["b"], f["A"], f["s"]

    def run(self, ids: np.ndarray, way: int) -> np.ndarray:
        """Hidden states of one direction: (places, windows, hidden)."""
        n, steps = ids.shape
        k = self.hidden
        h, c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        states = np.empty((steps, n, k), np.float32)
        table_, U = self.inputs[way], self.recurrent[way]
        ragged = way == 1 and bool((ids[:, -1] == FILL).any())
        g, size = np.empty((n, 4 * k), np.float32), np.empty((n, 4 * k), np.float32)
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            np.matmul(h, U, out=g)
            g += table_[ids[:, t]]
            # x / (1 + |x|) stands for the hyperbolic tangent; half of it plus a half is the gate.
            np.abs(g, out=size)
            size += 1.0
            g /= size
            gates = g[:, : 3 * k]
            gates *= 0.5
            gates += 0.5
            c *= g[:, k : 2 * k]
            c += g[:, :k] * g[:, 3 * k :]
            h = states[t]
            np.abs(c, out=h)
            h += 1.0
            np.divide(c, h, out=h)
            h *= g[:, 2 * k : 3 * k]
            if ragged:
                # Behind a text's end there is no state, so that the filling doesn't count.
                filled = ids[:, t] == FILL
                h[filled] = 0.0
                c[filled] = 0.0
        return states

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """Tag scores of windows that are filled up with FILL: (places, windows, tags)."""
        k = self.hidden
        out = self.run(ids, 0) @ self.out[:k]
        out += self.run(ids, 1) @ self.out[k:]
        out += self.bias
        return out

    def mixed(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """Tag scores of texts of any length, mixed where their windows overlap by the distance to the windows' edges."""
        cuts = [(i, start) for i, ids in enumerate(texts) for start in range(0, max(1, len(ids) - (WINDOW - STEP)), STEP)]
        totals = [np.zeros((len(ids), len(TAGS)), np.float32) for ids in texts]
        shares = [np.zeros((len(ids), 1), np.float32) for ids in texts]
        for k in range(0, len(cuts), BATCH):
            part = cuts[k : k + BATCH]
            filled = np.full((len(part), WINDOW), FILL, np.int64)
            for row, (i, start) in enumerate(part):
                window = texts[i][start : start + WINDOW]
                filled[row, : len(window)] = window
            scores = self.scores(filled)
            for row, (i, start) in enumerate(part):
                length = min(WINDOW, len(texts[i]) - start)
                place = np.arange(length, dtype=np.float32)
                left = place + 1 if start else np.full(length, WINDOW, np.float32)
                right = length - place if start + length < len(texts[i]) else np.full(length, WINDOW, np.float32)
                share = np.minimum(left, right)[:, None]
                totals[i][start : start + length] += scores[:length, row] * share
                shares[i][start : start + length] += share
        for t, w in zip(totals, shares, strict=True):
            t /= np.maximum(w, 1e-6, out=w)
        return totals

    def best_path(self, scores: np.ndarray) -> np.ndarray:
        """The best tags of one text of any length; only a byte per place and tag is kept besides its scores (places, tags)."""
        steps, tags = scores.shape
        best = scores[0] + self.start
        back = np.zeros((steps, tags), np.int8)
        every = np.arange(tags)
        for t in range(1, steps):
            ways = best[:, None] + self.moves
            came = ways.argmax(0)
            back[t] = came
            best = ways[came, every] + scores[t]
        out = np.zeros(steps, np.int8)
        tag = int(best.argmax())
        for t in range(steps - 1, -1, -1):
            out[t] = tag
            tag = back[t, tag]
        return out

    def best_paths(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best tags (windows, places) for scores (places, windows, tags); windows stand in order of falling length."""
        steps, n, tags = scores.shape
        live = (lengths[None, :] > np.arange(steps)[:, None]).sum(1)
        best = scores[0] + self.start
        back = np.zeros((steps, n, tags), np.int8)
        for t in range(1, steps):
            m = live[t]
            now = best[:m]
            top = now[:, :1] + self.moves[0]
            came = back[t, :m]
            for k in range(1, tags):
                other = now[:, k : k + 1] + self.moves[k]
                better = other > top
                np.copyto(top, other, where=better)
                came[better] = k
            top += scores[t, :m]
            best[:m] = top
        out = np.zeros((n, steps), np.int8)
        tag = best.argmax(1)
        rows = np.arange(n)
        for t in range(steps - 1, -1, -1):
            m = live[t]
            out[:m, t] = tag[:m]
            tag[:m] = back[t, rows[:m], tag[:m]]
        return out

    def read(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """The spans of each text: short ones in batches of like length, long ones window by window and the longest one by one, each decoded as a whole."""
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: -len(texts[i]))
        vast = sum(len(texts[i]) > VAST for i in order)
        for i in order[:vast]:
            out[i] = spans(self.best_path(self.mixed([codes(texts[i])])[0]))
        long = sum(len(texts[i]) > WINDOW for i in order)
        for k in range(vast, long, BATCH // 4):
            part = order[k : min(long, k + BATCH // 4)]
            mixed = self.mixed([codes(texts[i]) for i in part])
            lengths = np.array([len(m) for m in mixed])
            scores = np.zeros((lengths[0], len(part), len(TAGS)), np.float32)
            for row, m in enumerate(mixed):
                scores[: len(m), row] = m
            paths = self.best_paths(scores, lengths)
            for row, i in enumerate(part):
                out[i] = spans(paths[row, : lengths[row]])
        order = order[long:]
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            lengths = np.array([len(texts[i]) for i in part])
            filled = np.full((len(part), lengths[0]), FILL, np.int64)
            flat = codes("".join(texts[i] for i in part))
            filled[np.arange(lengths[0])[None, :] < lengths[:, None]] = flat
            paths = self.best_paths(self.scores(filled), lengths)
            for row in np.flatnonzero(paths.any(1)):
                out[part[row]] = spans(paths[row, : lengths[row]])
        return out


def spans(path: np.ndarray) -> list[tuple[int, int, str]]:
    """(begin, end, type) of the marked spans of a tag sequence."""
    marked = np.flatnonzero(path)
    found: list[list] = []
    last_at, last = -2, 0
    for at in marked.tolist():
        tag = int(path[at])
        if tag % 2 == 1 or last_at != at - 1 or (tag - 1) // 2 != (last - 1) // 2:
            found.append([at, at + 1, TYPES[(tag - 1) // 2]])
        else:
            found[-1][1] = at + 1
        last_at, last = at, tag
    return [tuple(f) for f in found]


ID_WORD = re.compile(r"(?:SSN|social security|national id|citizen id|id card|identity card|passport|licen[cs]e|บัตรประชาชน)\b\.?[ :#]*(?:no\b\.?|number)?[ :#]*(?:no\b\.?)?[ :#]*$", re.I)
DOCUMENT_WORD = re.compile(r"(?:\b(?:no|ref|reg|serial|quote|account|batch|lot|seal|model|rev|statement|slot|page|tracking|document|order|invoice)\b\.?(?: ?(?:no\b\.?|#|:))*|#)[ ]*(?:[A-Z]{1,4}-?)?$", re.I)
PHONE_WORD = re.compile(r"(?:\b(?:tele)?phone|\btel|\bmobile|\bcell|\bfax|\bhotline|\bwhatsapp|โทร(?:ศัพท์)?)\b\.?[ :#]*(?:no\b\.?|number\b)[ :#]*$", re.I)
HEADING = re.compile(r"^(?:[A-Z][\w ()]{1,18}: ?)?[^:;<|@]*$")
COMPANY = re.compile(r"\b(?:ltd|limited|inc|incorporated|corp|corporation|gmbh|g\.m\.b\.h|sdn|bhd|pte|plc|llc)\b|\bco\b\.?(?=\s*(?:,|$))|^(?:[A-Z][\w ()]{1,18}: ?)?M/s ", re.I)
#: Words that don't stand within a company's name.
BETWEEN = re.compile(r"\b(?:for|to|by|from|with|at|in|on|is|was|has|had|will|your|our|their|about|via|per|attn|contact|please|who|as)\b", re.I)
SMALL = re.compile(r"(?<![\w'])(?!(?:and|the|of)\b)[a-z]")
THAI_TITLE = re.compile("(?<![ก-๙])(?:นาย|นาง|คุณ|ดร\\.)")
MONEY = re.compile(r"^\d+[.,]\d{2}$")


def of_company(piece: str, begin: int, end: int) -> bool:
    """Whether a span belongs to a company's name: a legal form stands in it, or beside it with nothing but parts of a name between.

    Behind a comma or bracket another name begins where the span has a title or a given name in full.
    """
    first = re.findall(r"[\w/]+", piece[max(0, begin - 6) : begin].lower())[-1:] + re.findall(r"[\w/]+", piece[begin:end].lower())[:1]
    named = any(w in TITLES and w not in ("m/s", "messrs") or w in GIVEN for w in first)
    mixed = any(c.isupper() for c in piece[begin:end]) and any(c.islower() for c in piece)
    for m in COMPANY.finditer(piece):
        if m.start() < end and begin < m.end():
            return True
        gap = piece[m.end() : begin] if m.end() <= begin else piece[end : m.start()]
        if not (BETWEEN.search(gap) or mixed and SMALL.search(gap) or named and re.search("[,(]", gap)):
            return True
    return False


def settled(piece: str, begin: int, end: int, kind: str) -> str | None:
    """An exact check of what a span of a type must hold, and of the word before its number; None where it fails."""
    part = piece[begin:end]
    digits = sum(c.isdigit() for c in part)
    if kind in ("phone", "id_number"):
        before = piece[max(0, begin - 40) : begin]
        if ID_WORD.search(before):
            return "id_number" if digits >= 5 else None
        # Without such a word it can only be a phone number: not the rest of a longer number, a document's number or money.
        cut = bool(re.search(r"[\w-]$", before))
        return "phone" if digits >= (6 if kind == "phone" else 8) and not cut and (PHONE_WORD.search(before) or not DOCUMENT_WORD.search(before)) and not MONEY.match(part) else None
    if kind == "email":
        return kind if re.search(r"@|\bat\b", part) else None
    if kind == "street_address":
        return kind if digits >= 1 and sum(c.isalpha() for c in part) >= 3 else None
    if sum(c.isalpha() for c in part) < 2 or HEADING.match(piece) and of_company(piece, begin, end):
        return None
    if len(part) <= 3 and part.isupper() and part.isascii() and part.isalpha():
        return None  # a code
    # A Thai name without a title is a company's.
    thai = bool(re.search("[ก-๙]", part)) and not re.search("[A-Za-z]", part)
    return None if thai and not THAI_TITLE.search(piece[max(0, begin - 8) : end]) else kind


def grown(piece: str, begin: int, end: int, kind: str) -> tuple[int, int]:
    """A span widened to whole words, an email address also over its inner marks, so that no rest of an item stays."""
    inner = "._-+@" if kind == "email" else ""
    while begin > 0 and (piece[begin - 1].isalnum() and piece[begin].isalnum() or piece[begin - 1] in inner and begin > 1 and piece[begin - 2].isalnum()):
        begin -= 1
    while end < len(piece) and (piece[end].isalnum() and piece[end - 1].isalnum() or piece[end] in inner and end + 1 < len(piece) and piece[end + 1].isalnum() or kind == "email" and piece[end].isalnum()):
        end += 1
    return begin, end


class Finder:
    """Finds spans in texts, piece by piece, and remembers pieces of equal layout."""

    def __init__(self, tagger: Tagger):
        self.tagger = tagger
        self.known: dict[str, list[tuple[int, int, str]]] = {}

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, int, str]]]:
        """(line, begin, end, type) of each text's spans; begin and end count within the line."""
        places: list[tuple[int, int, int, str, str]] = []
        for n, text in enumerate(texts):
            if not text:
                continue
            for line_no, line in enumerate(text.split("\n"), 1):
                at = 0
                for piece in PIECES.split(line) if ". " in line else (line,):
                    if piece:
                        places.append((n, line_no, at, piece, layout(piece)))
                    at += len(piece) + 1
        new = {p[4] for p in places if p[4] not in self.known}
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = {p[4] for p in places}
        todo = list(new)
        for piece, found in zip(todo, self.tagger.read(todo), strict=True):
            self.known[piece] = found
        out: list[list[tuple[int, int, int, str]]] = [[] for _ in texts]
        for n, line_no, at, piece, form in places:
            last = 0
            for begin, end, kind in self.known[form]:
                if sure := settled(piece, begin, end, kind):
                    begin, end = grown(piece, begin, end, sure)
                    begin = max(begin, last)
                    if begin < end:
                        out[n].append((line_no, at + begin, at + end, sure))
                        last = end
        return out


@lru_cache(maxsize=2)
def finder(path: str) -> Finder:
    with np.load(path) as f:
        return Finder(Tagger({k: f[k] for k in f.files}))


def redacted(text: str | None, found: list[tuple[int, int, int, str]]) -> str | None:
    """The text with a typed placeholder for each span and all else unchanged."""
    if not text or not found:
        return text
    lines = text.split("\n")
    for line_no, begin, end, kind in sorted(found, reverse=True):
        line = lines[line_no - 1]
        lines[line_no - 1] = f"{line[:begin]}[{kind.upper()}]{line[end:]}"
    return "\n".join(lines)


def shared_finder(frame: DataFrame):
    """A function that gives each worker its finder; the weights, of fixed size, travel by broadcast."""
    with np.load(MODEL) as f:
        weights = frame.sparkSession.sparkContext.broadcast({k: f[k] for k in f.files})

    def get() -> Finder:
        own = _OWN.get("finder")
        if own is None:
            own = _OWN["finder"] = Finder(Tagger(weights.value))
        return own

    return get


_OWN: dict[str, Finder] = {}


def find_pii(frame: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The lines of each text that hold an item: keys, line_no, pii_type."""
    schema = T.StructType([*[frame.schema[k] for k in keys], T.StructField("line_no", T.LongType()), T.StructField("pii_type", T.StringType())])
    get = shared_finder(frame)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = get()
        for batch in batches:
            rows = own.find(batch.column(len(keys)).to_pylist())
            flat = [(n, line, kind) for n, found in enumerate(rows) for line, kind in sorted({(f[0], f[3]) for f in found})]
            at = pa.array([f[0] for f in flat], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(at) for i in range(len(keys))], pa.array([f[1] for f in flat], pa.int64()), pa.array([f[2] for f in flat], pa.string())], names=schema.names)

    return spread(frame.select(*keys, column)).mapInArrow(run, schema)


def redact(frame: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The texts with typed placeholders: keys, redacted."""
    schema = T.StructType([*[frame.schema[k] for k in keys], T.StructField("redacted", T.StringType())])
    get = shared_finder(frame)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = get()
        for batch in batches:
            texts = batch.column(len(keys)).to_pylist()
            done = [redacted(t, f) for t, f in zip(texts, own.find(texts), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keys))], pa.array(done, pa.string())], names=schema.names)

    return spread(frame.select(*keys, column)).mapInArrow(run, schema)


def all_texts(spark: SparkSession, folder: str) -> DataFrame:
    """src, row_id and text of the record pages and of the extraction results."""
    out = table(spark, folder, "extraction_results").select(F.lit("extraction_results").alias("src"), F.col("result_id").alias("row_id"), F.col("full_text").alias("text"))
    for name in RECORD_TABLES:
        out = out.unionByName(table(spark, folder, name).select(F.lit(name).alias("src"), F.col("record_id").alias("row_id"), F.col("input_text").alias("text")))
    return out


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """src, row_id, line_no and pii_type of each line and type that the line holds."""
    return find_pii(all_texts(spark, folder), ["src", "row_id"], "text").distinct()


def p1_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """src, row_id and the text with typed placeholders."""
    return redact(all_texts(spark, folder), ["src", "row_id"], "text").distinct()
