"""Training of the tagger of `pii` from labelled spans: python -m ledgerloom.llm.train_pii TABLES_FOLDER

Spans are labelled by a grammar on a bounded sample of text pieces (`SAMPLE`),
and varied: names are replaced by made-up ones, letters swapped or dropped, and
case changed, so that the network learns layouts and contexts and not the sample.
Pieces that stand often in the texts count more. Sentences of an open vocabulary,
whose names, streets and companies are made of random syllables, are added with the
spans they were made with, so that names needn't be known to be found.
The weights kept are those of eleven epochs, gone on from with `start` in runs of a few epochs
whenever the labels or sentences above were extended, the last two runs averaged 2 to 3 (`mixed_weights`).
The loss is the negative log-likelihood of the CRF, its gradient comes from the
forward-backward marginals and goes through the LSTM in time; Adam updates.
"""

from __future__ import annotations

import random
import re
import sys
import time
from collections import Counter

import numpy as np

from ledgerloom.llm import pii
from ledgerloom.llm.names import GIVEN, NICKNAMES, parse as parse_name
from ledgerloom.llm.addresses import KIND, parse as parse_address

SAMPLE = 45_000
HIDDEN = 24
EPOCHS = 11
SEED = 7
#: Sentences of the open vocabulary per epoch.
OPEN = 9_000

D = r"[0-9๐-๙OoIl]"
N = r"[0-9๐-๙]"
EMAIL = re.compile(r"(?:mailto:)?[\w+-]+(?:(?:\.| ?\[dot\] ?| ?\(dot\) ?)[\w+-]+)*(?: ?@ ?| ?\(at\) ?| ?\[at\] ?)[\w-]+(?:(?:\.| ?\[dot\] ?| ?\(dot\) ?| \. )[A-Za-z][\w-]*)+", re.I)
GAP_ = r"[ \u00a0–./-]"
PHONE = re.compile(
    rf"(?<![\w#/.-])(?:\+ ?{D}{{1,3}}{GAP_}?\(?{D}{{1,3}}\)?(?:{GAP_}?{D}{{1,9}}){{1,4}}|[0Oo๐]{{2}}{D}{{2}}(?:{GAP_}{D}{{2,9}}){{1,4}}|\({D}{{1,3}}\){GAP_}?{D}{{3,4}}{GAP_}{D}{{3,4}}|[0Oo๐]{D}{{1,3}}{GAP_}{D}{{3,7}}(?:{GAP_}{D}{{3,4}})?|[0Oo๐]{D}{{8,11}}|[5๕S]{{3}}\.{D}{{3}}\.{D}{{4}}|\+{D}{{9,13}})(?:\s?(?:ext\.?|x)\s?{D}+)?(?![\w/]|[.-]\d)"
)
ID_WORD = re.compile(r"(?:SSN|social security|national id|citizen id|id card|identity card|passport|driver'?s? licen[cs]e|driving licen[cs]e|เลขบัตรประชาชน|เลขประจำตัวประชาชน)\b\.?(?: ?(?:no\.?|number|#|:))*[ :#]*", re.I)
ID_NUMBER = re.compile(rf"[A-Za-z]{{0,2}}{D}(?:[-. ]?{D}){{4,16}}[A-Za-z]?(?!\w)")
DOCUMENT = re.compile(r"(?:\b(?:no|ref|reg|serial|quote|account|batch|lot|seal|model|rev|statement|slot|day|gate|page)\b\.?(?: ?(?:no\.?|#|:))*|#)[ ]*$", re.I)
KINDS = "|".join(sorted(KIND, key=len, reverse=True))
STREET = re.compile(
    rf"(?:(?:(?:unit|room|rm|suite|ste|u)\b[.\- ]*(?:no\.? ?)?#?{N}+[a-z]?|#{N}+[a-z]?|{N}+(?:st|nd|rd|th) fl(?:oor|r)?\.?)[ ,/]+)?(?:no\.? ?|#)?{N}+(?:/{N}+)?[a-z]?[ ,]+[A-Za-z]{{4,}} (?:{KINDS})\b(?!-)\.?|[A-Za-z]{{4,}} (?:{KINDS})\b\.?,? (?:no\.? ?)?{N}+(?:/{N}+)?[a-z]?(?!\w)|{N}+(?:/{N}+)? ?(?:ถนน|ถ\.) ?[ก-๙]+",
    re.I,
)
TITLE = r"(?:(?:Mr|Mrs|Ms|Dr|Engr|Sr|Sra|Khun|Prof)\b\.? )?"
GIVENS = "|".join(sorted((w for w in GIVEN if len(w) > 1), key=len, reverse=True))
THINGS = r"(?! (?:sponge|desk|side|rain|mirror)\b|-pattern|-series)"
PERSON = [
    re.compile(rf"\b{TITLE}(?:{GIVENS})\b{THINGS}(?: \"\w+\")?(?: [A-Z]\.)?(?: (?!(?:showed|signed|will|at|on|for|c/o|by|from|Tel|and|or|โทร)\b)[A-Za-z0-9]{{4,}})?(?!\w|[.@+_-]\w)", re.I),
    re.compile(rf"\b[A-Za-z]{{4,}}, (?:{GIVENS})\b{THINGS}(?! [a-z]+ (?:mix|chair|boots))", re.I),
    re.compile(rf"{TITLE}(?<![\w.@])[A-Z]\. (?:[A-Z]\. )?[A-Z][a-z]{{3,}}\b(?! (?:{KINDS})\b)"),
    re.compile(r"(?<![ก-๙])(?:นางสาว|นาย|นาง|คุณ|ดร\.)[ก-๙]+(?: (?!โทร)[ก-๙]{4,})?"),
]
PARTY = re.compile(r"^((?:To|Bill To|Ship To|Deliver To|Customer|Buyer|From \(Buyer\)|To \(Supplier\)|Supplier|Vendor|Consignee|Recipient|Sender|Shipper|Sent by|ลูกค้า|ผู้รับ|ผู้ส่ง|ผู้ซื้อ|ผู้ขาย) ?: ?)(.+)$")
ADDRESS = re.compile(r"^(Address ?: ?|ที่อยู่ ?:? ?)?(.+)$")
PERSON_BEFORE = re.compile(r"(?:Attn:|Contact person:|Kind regards,|Approved -|ask for|c/o|Driver|by|cc|;|parcels with|Spoke with|ผู้ติดต่อ:|the relief of|refunds:) $")
ADDRESS_LINE = re.compile(r"^(?:Address|ที่อยู่) ?:|^(?!For refunds|Lives at|Ship the rest)[^:;<|@]*\b(?:US|USA|PH|TH|MY|DE|Thai|Thailand|Germany|Malaysia|Philippines|States|Phils?|Deutschland|Nordmark|Westmere|Lumbaro)\b\.?\s*$|^(?!.*(?:Attn|Contact|regards|Approved|ask for|cc ))[^:;<|@]*\d{5}[^:;<|@]*$", re.I)
# Pieces that never hold personal information but look like it.
PLAIN_LINE = re.compile(r"^(?:\d+\.? |Page |Dimensions |Delivery window|Document no|VAT reg|Tracking no|Serial|Quote|Account|Batch|Order ref|Model|Received in good|Statement #|PO No|DN No|Date:|Total:|Balance Due|Gross Weight)")


def label(piece: str) -> list[tuple[int, int, str]]:
    """The spans of a piece of text, by the grammar."""
    found: list[tuple[int, int, str]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y, _ in found)

    for m in EMAIL.finditer(piece):
        if re.search(r"@|at[)\]]", m[0]):
            found.append((*m.span(), "email"))
    for m in ID_WORD.finditer(piece):
        if (n := ID_NUMBER.match(piece, m.end())) and free(*n.span()):
            found.append((*n.span(), "id_number"))
    party = PARTY.match(piece)
    if party and parse_name(party[2].strip())["kind"] == "person":
        end = len(piece.rstrip())
        return [(party.start(2), end, "person_name")]
    if party:
        return found
    for m in STREET.finditer(piece):
        if free(*m.span()) and not re.search(r"\b(?:window|rework|signed for)\b", piece[: m.start()], re.I):
            found.append((*m.span(), "street_address"))
    if not PLAIN_LINE.match(piece):
        whole = ADDRESS.match(piece)
        if whole and not any(k == "street_address" for _, _, k in found) and len(piece) < 130 and not re.search(r"refused|signed for|marking|-series|-pattern", piece):
            parts = parse_address(whole[2])
            if parts["number"] and parts["street"] and "  " not in piece.strip() and (whole[1] or re.search(r"[,/]|\d", piece)) and not re.search(r"[.:;] |\d{2}:\d|@| (?:to|of|by|for|were|is|at) ", piece):
                found = [f for f in found if f[2] == "email"]
                found.append((whole.start(2), len(piece.rstrip()), "street_address"))
    for m in PHONE.finditer(piece):
        if free(*m.span()) and not DOCUMENT.search(piece[: m.start()]) and sum(c.isdigit() for c in m[0]) >= 7 and not re.match(r"^\d{2}[-/]\d{2}[-/]\d{2,4}$|^\d{4}-\d{2}-\d{2}$", m[0]):
            found.append((*m.span(), "phone"))
    company = parse_name(piece.strip())["kind"] in ("company", "thai company") and len(piece) < 70
    if not company:
        place = bool(ADDRESS_LINE.match(piece)) or any(k == "street_address" and a < 3 for a, _, k in found)
        for pattern in PERSON:
            if place and pattern is PERSON[2]:
                continue
            for m in pattern.finditer(piece):
                alone = " " not in m[0].strip() and pattern is PERSON[0]
                if alone and not (PERSON_BEFORE.search(piece[: m.start()]) or re.match(r" ?<", piece[m.end() :]) or len(piece.strip()) == len(m[0])):
                    continue
                if free(*m.span()):
                    found.append((*m.span(), "person_name"))
    return sorted(found)


SYLLABLES = [c + v for c in "bdfgklmnrstvz" for v in "aeiou"]
ENDINGS = ["s", "x", "l", "r", "n", "th", "ne", ""]


NAMES = [*NICKNAMES, *sorted(w for w in GIVEN if len(w) > 1)]


def made_up(rng: random.Random) -> str:
    return ("".join(rng.choices(SYLLABLES, k=rng.choice((3, 4, 4)))) + rng.choice(ENDINGS)).capitalize()


def like(word: str, other: str) -> str:
    return other.upper() if word.isupper() else other.lower() if word.islower() else other


def another_name(rng: random.Random) -> str:
    """A made-up person's name in one of the ways that people write names."""
    given, family = rng.choice(NAMES).capitalize(), made_up(rng)
    first, middle = rng.choice("ABCDEFGHIJKLMNPRSTVW"), rng.choice("ABCDEFGHIJKLMNPRSTVW")
    title = rng.choice(("", "", "", "Mr. ", "Mrs ", "Ms. ", "Dr. ", "Engr. ", "Khun "))
    name = rng.choice((given, given, f"{first}. {family}", f"{family}, {given}", f"{family}, {first}.{middle}.", f"{title}{given} {family}", f"{title}{first}. {family}", f"{given} {middle}. {family}"))
    roll = rng.random()
    return name.upper() if roll < 0.1 else name.lower() if roll < 0.2 else name


ONSETS = "b br c ch cl d dr f fr g gr h j k kh kl kr l m n p ph pl pr r s sh st t th tr v w y z".split()
VOWELS = "a a a e e e i i o o u ai ee ia ie oo ou".split()
CODAS = ["", "", "", "n", "r", "s", "l", "m", "ng", "ck", "th", "nd", "rt", "ski", "son", "ez"]
# Words that documents use in headings and sentences.
PLAIN_WORDS = (
    "account statement invoice delivery note packing list total net gross order page terms conditions payment due date number summary details amount notice report received goods"
    " customer copy original balance tax quantity price unit item weight carton batch serial model quote office department warehouse bank transfer thank you please check the with for"
    " annual general service standard first class manager project meeting north south final draft version open closed blue green steel paper monday tuesday june march currency usd eur php myr thb gbp foods trading"
).split()
FORMS = "Ltd Limited Inc LLC GmbH Corp PLC Pte".split()
BEFORE = ["Deliver to ", "Meet ", "Attn: ", "Contact ", "Dear ", "Signed by ", "Regards, ", "Ask for ", "Spoke to ", "c/o ", "Received by ", "Approved by ", "Call ", "cc ", "Customer: ", "Mr. ", "Mrs. ", "Dr. "]
AFTER = ["", "", " tomorrow", " at the gate", " before noon", ", thanks", " on Monday", " has signed", ".", " about the order"]


def syllables(rng: random.Random, least: int = 1, most: int = 3) -> str:
    count = rng.randint(least, most)
    word = "".join(rng.choice(ONSETS) + rng.choice(VOWELS) for _ in range(count)) + rng.choice(CODAS)
    if rng.random() < 0.2:
        word = rng.choice("aeiou") + word
    return word.capitalize()


def street_of(rng: random.Random) -> str:
    """A house number with a made-up street in the order of one of several languages."""
    number = f"{rng.randint(1, 999)}{rng.choice(('', '', '', 'A', '/4'))}"
    name = syllables(rng, 1, 3)
    kind = rng.choice(("Street", "St.", "Road", "Rd", "Avenue", "Ave", "Lane", "Drive", "Boulevard", "Way", "Court", "Place", "Terrace"))
    return rng.choice((f"{number} {name} {kind}", f"{number} {name} {kind}", f"{number} {name} {syllables(rng, 1, 2)} {kind}", f"{number} Rue de {name}", f"{number}, rue {name}", f"{name}strasse {number}", f"{name}weg {number}", f"Calle {name} {number}", f"Via {name} {number}", f"No. {number} {name} {kind}"))


def open_sentence(rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A made-up piece of text with its spans."""
    roll = rng.random()
    person = f"{syllables(rng, 1, 3)} {syllables(rng, 1, 3)}" if rng.random() < 0.6 else f"{rng.choice(NAMES).capitalize()} {syllables(rng, 1, 3)}"
    if rng.random() < 0.1:
        person = f"{person[0]}. {person.split()[1]}"
    parts: list[tuple[str, str | None]]
    if roll < 0.35:
        parts = [(rng.choice(BEFORE), None), (person, "person_name"), (rng.choice(AFTER), None)]
    elif roll < 0.47:
        parts = [(rng.choice(BEFORE[:10]), None), (person, "person_name"), (", ", None), (street_of(rng), "street_address"), (rng.choice(("", ", " + syllables(rng, 2, 3))), None)]
    elif roll < 0.6:
        parts = [(rng.choice(("", "", "Address: ", "Ship to ", "Lives at ", "Return it to ")), None), (street_of(rng), "street_address"), (rng.choice(("", ", " + syllables(rng, 2, 3), f", {syllables(rng, 2, 3)} {rng.randint(10000, 99999)}")), None)]
    elif roll < 0.66:
        number = rng.choice(("0{0}-{1}-{2}", "(0{0}) {1} {2}", "+{3} {0} {1} {2}", "0{0} {1}{2}", "0{0}{1}{2}", "+{3}{0}{1}{2}", "0{0}.{1}.{2}")).format(rng.randint(1, 99), rng.randint(100, 999), rng.randint(1000, 9999), rng.randint(20, 99))
        said = rng.choice(("Phone No. ", "Phone no: ", "Tel. No. ", "Telephone number ", "Mobile: ", "Fax No. ", "Call ", "Hotline "))
        if rng.random() < 0.3:
            parts = [(rng.choice(("Account No. ", "Order no: ", "Batch No. ", "Invoice number ", "Serial ")) + number, None)]
        else:
            parts = [(said, None), (number, "phone"), (rng.choice(("", "", ".", " after six")), None)]
    elif roll < 0.78:
        money = f"{rng.randint(1, 99)},{rng.randint(0, 999):03d}.{rng.randint(0, 99):02d}"
        company = f"{syllables(rng, 1, 3)} {rng.choice((syllables(rng, 1, 3), rng.choice(PLAIN_WORDS).capitalize()))} {rng.choice(FORMS)}"
        parts = [(rng.choice((f"Invoice total {money} for ", "Sold by ", "", "Customer: ", "Deliver to ", f"Total {money} due to ", "Our supplier ")) + company + rng.choice(("", ".", " by June")), None)]
    else:
        words = rng.choices(PLAIN_WORDS, k=rng.randint(1, 5))
        text = " ".join(words)
        text = rng.choice((text.title(), text.upper(), text.capitalize(), text))
        parts = [(text + rng.choice(("", "", ":", f" {rng.randint(1, 9999)}", f": {rng.randint(1, 99)},{rng.randint(0, 999):03d}.{rng.randint(0, 99):02d}")), None)]
    out, found = "", []
    for text, kind in parts:
        if kind:
            found.append((len(out), len(out) + len(text), kind))
        out += text
    roll = rng.random()
    return (out.upper() if roll < 0.04 else out.lower() if roll < 0.07 else out), found


TURN = re.compile(r"^((?:no\.? ?|#)?[0-9๐-๙]+(?:/[0-9๐-๙]+)?[a-z]?)[ ,]+([A-Za-z]{4,} [A-Za-z]+\.?)$", re.I)


def turned(piece: str, found: list[tuple[int, int, str]], rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """An address line with its parts in another order: the number behind the street, or the place before it."""
    (begin, end, kind), = found
    head, part, tail = piece[:begin], piece[begin:end], piece[end:]
    if rng.random() < 0.4 and (m := TURN.match(part)):
        part = f"{m[2]} {m[1]}"
    if rng.random() < 0.4 and len(tail) > 4 and re.match(r"[ ,/]+\w", tail) and re.fullmatch(r"(?:Address: )?", head):
        mark = re.match(r"[ ,/]+", tail)[0]
        place = tail[len(mark) :].rstrip()
        return head + place + mark + part, [(len(head + place + mark), len(head + place + mark + part), kind)]
    return head + part + tail, [(begin, begin + len(part), kind)]


def varied(piece: str, found: list[tuple[int, int, str]], rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """The piece with made-up names within its spans and an occasional slip of the pen; spans move along."""
    out, spans_, at = "", [], 0
    if len(found) == 1 and found[0][2] == "street_address" and rng.random() < 0.3:
        piece, found = turned(piece, found, rng)
    for begin, end, kind in [*found, (len(piece), len(piece), "")]:
        out += piece[at:begin]
        part = piece[begin:end]
        if kind == "person_name" and rng.random() < 0.2 and part.isascii():
            part = another_name(rng)
        elif kind in ("person_name", "street_address"):

            def swap(m: re.Match) -> str:
                word = m[0]
                low = word.lower()
                if low in GIVEN:
                    return like(word, rng.choice(NAMES).capitalize()) if rng.random() < 0.5 else word
                if low in KIND or len(word) < 5 or not re.fullmatch(r"(?:[bdfgklmnrstvz][aeiou]){2,}\w{0,3}", low):
                    return word
                return like(word, made_up(rng))

            part = re.sub(r"[A-Za-z]+", swap, part)
        if kind in ("person_name", "street_address") and len(part) > 6 and rng.random() < 0.12:
            k = rng.randrange(1, len(part) - 2)
            if part[k].isalpha() and part[k + 1].isalpha():
                part = part[:k] + rng.choice((part[k + 1] + part[k], part[k + 1], part[k] + rng.choice("aeinorst") + part[k + 1])) + part[k + 2 :]
        if kind:
            spans_.append((len(out), len(out) + len(part), kind))
        out += part
        at = end
    roll = rng.random()
    return (out.upper() if roll < 0.04 and len(out.upper()) == len(out) else out.lower() if roll < 0.08 and len(out.lower()) == len(out) else out), spans_


def tags_of(length: int, found: list[tuple[int, int, str]]) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for begin, end, kind in found:
        tags[begin:end] = 2 + 2 * pii.TYPES.index(kind)
        tags[begin] = 1 + 2 * pii.TYPES.index(kind)
    return tags


def soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), the network's activation; its derivative is (1 - |y|)² of its value y."""
    return x / (1 + np.abs(x))


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Trainer:
    """Forward and backward passes over a batch of windows of equal length."""

    def __init__(self, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        k, tags = 4 * hidden, len(pii.TAGS)
        self.h = hidden
        self.p = {"W": rng.normal(0, 0.2, (2 * hidden, tags)), "b": np.zeros(tags), "A": np.zeros((tags, tags)), "s": np.zeros(tags)}
        for way in "01":
            self.p["X" + way] = rng.normal(0, 0.3, (pii.VOCABULARY, k))
            self.p["U" + way] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, k))
            self.p["X" + way][:, hidden : 2 * hidden] += 1.0
        self.p = {n: v.astype(np.float32) for n, v in self.p.items()}
        self.m = {n: np.zeros_like(v) for n, v in self.p.items()}
        self.v = {n: np.zeros_like(v) for n, v in self.p.items()}
        self.steps = 0

    def lstm(self, ids: np.ndarray, way: str):
        n, steps = ids.shape
        k = self.h
        X, U = self.p["X" + way], self.p["U" + way]
        hs, cs, gs = np.zeros((steps + 1, n, k), np.float32), np.zeros((steps + 1, n, k), np.float32), np.empty((steps, n, 4 * k), np.float32)
        for t in range(steps):
            g = X[ids[:, t]] + hs[t] @ U
            g = soft(g)
            g[:, : 3 * k] = 0.5 * g[:, : 3 * k] + 0.5
            cs[t + 1] = g[:, k : 2 * k] * cs[t] + g[:, :k] * g[:, 3 * k :]
            hs[t + 1] = g[:, 2 * k : 3 * k] * soft(cs[t + 1])
            gs[t] = g
            filled = ids[:, t] == pii.FILL
            hs[t + 1][filled] = 0.0
            cs[t + 1][filled] = 0.0
        return hs, cs, gs

    def lstm_back(self, ids, state, dh_all, way, grads):
        hs, cs, gs = state
        steps, n, _ = gs.shape
        k = self.h
        U = self.p["U" + way]
        dX, dU = np.zeros_like(self.p["X" + way]), np.zeros_like(U)
        dh, dc = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        for t in range(steps - 1, -1, -1):
            g = gs[t]
            dh = dh + dh_all[t]
            filled = ids[:, t] == pii.FILL
            dh[filled] = 0.0
            dc[filled] = 0.0
            tc = soft(cs[t + 1])
            dc = dc + dh * g[:, 2 * k : 3 * k] * (1 - np.abs(tc)) ** 2
            dg = np.concatenate([dc * g[:, 3 * k :], dc * cs[t], dh * tc, dc * g[:, :k]], 1)
            dg[:, : 3 * k] *= 0.5 * (1 - np.abs(2 * g[:, : 3 * k] - 1)) ** 2
            dg[:, 3 * k :] *= (1 - np.abs(g[:, 3 * k :])) ** 2
            np.add.at(dX, ids[:, t], dg)
            dU += hs[t].T @ dg
            dh = dg @ U.T
            dc = dc * g[:, k : 2 * k]
        grads["X" + way], grads["U" + way] = dX, dU

    def step(self, ids: np.ndarray, tags: np.ndarray, lengths: np.ndarray, rate: float) -> float:
        """One update; ids (windows, places), filled with FILL behind `lengths`."""
        n, steps = ids.shape
        k = self.h
        back_ids = ids[:, ::-1]
        forward, backward = self.lstm(ids, "0"), self.lstm(back_ids, "1")
        both = np.concatenate([forward[0][1:], backward[0][1:][::-1]], 2)
        em = both @ self.p["W"] + self.p["b"]
        A, s = self.p["A"], self.p["s"]
        inside = (np.arange(steps)[:, None] < lengths[None, :])
        alpha = np.empty_like(em)
        alpha[0] = em[0] + s
        for t in range(1, steps):
            new = log_sum(alpha[t - 1][:, :, None] + A, 1) + em[t]
            alpha[t] = np.where(inside[t][:, None], new, alpha[t - 1])
        z = log_sum(alpha[-1], 1)
        beta = np.zeros_like(em)
        for t in range(steps - 2, -1, -1):
            new = log_sum(A[None] + (em[t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(inside[t + 1][:, None], new, 0.0)
        rows = np.arange(n)
        gold = em[0, rows, tags[:, 0]] + s[tags[:, 0]]
        dem = np.exp(alpha + beta - z[None, :, None]) * inside[:, :, None]
        dA = np.zeros_like(A)
        ds = dem[0].sum(0)
        np.add.at(ds, tags[:, 0], -1.0)
        for t in range(1, steps):
            live = inside[t]
            if not live.any():
                break
            pair = np.exp(alpha[t - 1][live][:, :, None] + A + (em[t] + beta[t])[live][:, None, :] - z[live][:, None, None])
            dA += pair.sum(0)
            np.add.at(dA, (tags[live, t - 1], tags[live, t]), -1.0)
            gold = gold + np.where(live, em[t, rows, tags[:, t]] + A[tags[:, t - 1], tags[:, t]], 0.0)
        for t in range(steps):
            dem[t, rows, tags[:, t]] -= inside[t]
        dem = (dem / n).astype(np.float32)
        grads = {"A": dA / n, "s": ds / n, "b": dem.sum((0, 1)), "W": np.tensordot(both, dem, ([0, 1], [0, 1]))}
        dboth = dem @ self.p["W"].T
        self.lstm_back(ids, forward, dboth[:, :, :k], "0", grads)
        self.lstm_back(back_ids, backward, dboth[::-1, :, k:], "1", grads)
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        self.steps += 1
        for name, g in grads.items():
            g = g * min(1.0, 5.0 / max(norm, 1e-9))
            self.m[name] = 0.9 * self.m[name] + 0.1 * g
            self.v[name] = 0.999 * self.v[name] + 0.001 * g**2
            self.p[name] = (self.p[name] - rate * self.m[name] / (1 - 0.9**self.steps) / (np.sqrt(self.v[name] / (1 - 0.999**self.steps)) + 1e-8)).astype(np.float32)
        return float((z - gold).mean())


def pieces_of(folder: str, limit: int = SAMPLE, seed: int = SEED) -> list[str]:
    """Different pieces of the texts in the folder's tables, at most `limit` in random order."""
    return [p for p, _ in counted_pieces(folder, limit, seed)]


def counted_pieces(folder: str, limit: int = SAMPLE, seed: int = SEED) -> list[tuple[str, int]]:
    """Different pieces of the texts in the folder's tables with the times they stand there, at most `limit` in random order."""
    import pyarrow.dataset as ds

    counts: Counter = Counter()
    for name, column in (("invoices", "input_text"), ("purchase_orders", "input_text"), ("delivery_notes", "input_text"), ("extraction_results", "full_text")):
        for text in ds.dataset(f"{folder}/{name}.parquet").to_table([column]).column(0).to_pylist():
            for line in (text or "").split("\n"):
                counts.update(pii.PIECES.split(line.rstrip("\r")))
    counts.pop("", None)
    unique: dict[str, tuple[str, int]] = {}
    for p in sorted(counts):
        form = p.translate(pii.DIGIT)
        unique[form] = (p, counts[p] + unique.get(form, ("", 0))[1])
    rows = sorted(unique.values())
    random.Random(seed).shuffle(rows)
    return rows[:limit]


def train(folder: str, start: str | None = None, epochs: int = EPOCHS, hidden: int = HIDDEN, batch: int = 128) -> dict[str, np.ndarray]:
    """Trains on the folder's tables; `start` names weights to go on from."""
    rng = random.Random(SEED)
    pieces = counted_pieces(folder)
    held, pieces = [p for p, _ in pieces[: len(pieces) // 20]], pieces[len(pieces) // 20 :]
    # A piece counts by the logarithm of the times it stands in the texts.
    labelled = [(p, found) for p, n in pieces for found in [label(p)] for _ in range(1 + min(6, int(np.log2(n)) // 2))]
    print(len(labelled), "pieces", flush=True)
    model = Trainer(hidden, SEED)
    if start:
        with np.load(start) as f:
            model.p = {k: f[k].astype(np.float32) for k in f.files}
    for epoch in range(epochs):
        began, losses = time.time(), []
        rows = []
        for piece, found in [*labelled, *(open_sentence(rng) for _ in range(OPEN))]:
            text, own = varied(piece, found, rng) if found else (piece, found)
            ids, tags = pii.codes(text), tags_of(len(text), own)
            start = rng.randrange(0, len(ids) - pii.WINDOW + 1) if len(ids) > pii.WINDOW else 0
            rows.append((ids[start : start + pii.WINDOW], tags[start : start + pii.WINDOW]))
        rng.shuffle(rows)
        rows.sort(key=lambda r: len(r[0]) // 12)
        groups = [rows[k : k + batch] for k in range(0, len(rows), batch)]
        rng.shuffle(groups)
        rate = (0.002 if start else 0.007) * (0.6**epoch)
        for group in groups:
            steps = max(len(r[0]) for r in group)
            ids = np.full((len(group), steps), pii.FILL, np.int64)
            tags = np.zeros((len(group), steps), np.int64)
            for i, (a, b) in enumerate(group):
                ids[i, : len(a)], tags[i, : len(a)] = a, b
            losses.append(model.step(ids, tags, np.array([len(r[0]) for r in group]), rate))
        print(f"epoch {epoch}: loss {np.mean(losses):.4f}, {time.time() - began:.0f} s", flush=True)
        weights = {n: v.astype(np.float16) for n, v in model.p.items()}
        np.savez_compressed(pii.MODEL, **weights)
        report(weights, held)
    return weights


def mixed_weights(first: str, second: str, share: float) -> dict[str, np.ndarray]:
    """The average of two files of weights, `share` of the first."""
    with np.load(first) as a, np.load(second) as b:
        return {k: (share * a[k].astype(np.float32) + (1 - share) * b[k].astype(np.float32)).astype(np.float16) for k in a.files}


def report(weights: dict[str, np.ndarray], held: list[str]) -> dict[str, tuple[int, int, int]]:
    """Per type the pieces found right, missed and found wrongly, on pieces not trained on."""
    own = pii.Finder(pii.Tagger(weights))
    counts = {t: [0, 0, 0] for t in pii.TYPES}
    for piece, found in zip(held, own.find(held), strict=True):
        is_, said = {k for _, _, k in label(piece)}, {f[3] for f in found}
        for t in pii.TYPES:
            counts[t][0] += t in is_ and t in said
            counts[t][1] += t in is_ and t not in said
            counts[t][2] += t not in is_ and t in said
    print(counts, flush=True)
    return counts


if __name__ == "__main__":
    train(*sys.argv[1:3])
