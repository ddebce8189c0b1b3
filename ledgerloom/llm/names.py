"""Variant spellings of persons' and companies' names (problem 4).

A spelling is taken apart into its core tokens, its trade (for companies) and its
given name (for persons, nicknames written out). Spellings with the same parts
fall together at once. The others are blocked by the phonetic codes of their
sorted core tokens; within a block the core tokens are compared by Jaro-Winkler
and edit distance, with short forms (a prefix, or the consonants alone) and the
nickname table, and accepted pairs are closed to connected components. Blocks of any size are cut
into tiles. A spelling with a short form (an initial, a nickname of several names, the
beginning of a longer given name) is linked only if all full spellings that it fits
are one name; short forms that fit no full spelling are linked with each other
(`short_names`). Nicknames come from a table of given names that the caller may pass;
a given name that it doesn't hold stands for itself.

Defined results: null and blank names have no pairs; a name without letters falls
together only with texts equal but for case, blanks and marks. Repeated names
count once; a spelling isn't paired with itself. Extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.addresses import field_values
from ledgerloom.llm.graph import block_pairs, components, pairs_within
from ledgerloom.llm.strings import edits, jaro_winkler
from ledgerloom.tables import checkpoint, spread

# Words of legal forms.
LEGAL = frozenset("co company corp corporation inc incorporated ltd limited llc plc gmbh sdn bhd pte private pvt ag sa".split())
# Trades with their short forms.
TRADES = {
    "international": "international intl int'l",
    "chemicals": "chemicals chemical chem chemic",
    "packaging": "packaging pkg packag",
    "logistics": "logistics logist lgstcs",
    "trading": "trading trdg trad",
    "engineering": "engineering engrg eng'g engg",
    "electronics": "electronics elec electr",
    "services": "services svcs serv",
    "foods": "foods fds food",
    "hardware": "hardware hardw hdwe",
    "supplies": "supplies suppl supp",
    "textiles": "textiles txtls text",
    "industries": "industries indus ind",
    "manufacturing": "manufacturing mfg manuf",
}
TRADE = {w: t for t, words in TRADES.items() for w in words.split()}
# Given names with their nicknames, where no table of them is passed.
NICKNAMES = {
    "alexander": "alex alec sandy xander",
    "anthony": "tony ant",
    "benjamin": "ben benji benny",
    "christopher": "chris kit topher",
    "concepcion": "concha conchita connie",
    "dorothea": "dora thea dot dolly",
    "edward": "ed eddie ted ned eddy",
    "elizabeth": "liz beth betty lizzie eliza lisbeth",
    "francisco": "paco pancho frank kiko cisco",
    "guadalupe": "lupe lupita",
    "harold": "harry hal",
    "henriette": "jette henni etta hettie",
    "ignacio": "nacho iggy",
    "james": "jim jimmy jamie",
    "josephine": "jo josie fina",
    "katherine": "kate kathy katie kit kitty",
    "malivan": "mali van",
    "margaret": "meg peggy maggie marge greta",
    "matilda": "tilda tilly mattie",
    "michael": "mike mick mickey",
    "patricia": "pat trish patty tricia",
    "richard": "rick dick rich ricky",
    "robert": "bob rob bobby robbie bert",
    "somchit": "chit som",
    "susannah": "sue susie anna suzy",
    "theodore": "ted theo teddy",
    "william": "bill will billy liam",
    "wolfgang": "wolf wolfi",
    "abigail": "abby gail",
    "albert": "al bertie",
    "andrew": "andy drew",
    "barbara": "barb babs barbie",
    "catherine": "cathy cate cat",
    "charles": "charlie chuck chas",
    "daniel": "dan danny",
    "david": "dave davey",
    "deborah": "deb debbie",
    "frederick": "fred freddie fritz",
    "gregory": "greg",
    "jacob": "jake",
    "jennifer": "jen jenny",
    "john": "johnny jack",
    "joseph": "joe joey",
    "kenneth": "ken kenny",
    "lawrence": "larry",
    "leonard": "len lenny",
    "nathaniel": "nate",
    "nicholas": "nick nicky",
    "pamela": "pam",
    "peter": "pete",
    "rebecca": "becky",
    "ronald": "ron ronnie",
    "samuel": "sam sammy",
    "stephen": "steve",
    "thomas": "tom tommy",
    "timothy": "tim timmy",
    "virginia": "ginny",
    "walter": "walt wally",
}
GIVEN: dict[str, set[str]] = {}
for _full, _short in NICKNAMES.items():
    for _w in [_full, *_short.split()]:
        GIVEN.setdefault(_w, set()).add(_full)
# Titles before a person's name.
TITLES = frozenset("mr mrs ms miss dr engr prof sir khun sra sr nai nang m/s messrs".split())
THAI_TITLES = re.compile(r"^(?:นางสาว|นาย|นาง|คุณ|ดร\.)\s*")
THAI_LEGAL = re.compile(r"บริษัท|จำกัด|มหาชน|บจก\.?|บมจ\.?|หจก\.?|(?<![ก-๙])บ\.|(?<![ก-๙])จก\.?|[()]")
OCR = str.maketrans("01358|", "olesbl")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z][a-z])")
#: Letters that sound alike, for the phonetic code.
SOUNDS = str.maketrans("bpfvwcgjkqsxzdtmnlr", "1111122222222334456")


@lru_cache(maxsize=100_000)
def phonetic(word: str) -> str:
    """The consonants' sound classes without repeats; of Thai words the first consonants."""
    out = ""
    for c in word.lower():
        code = c.translate(SOUNDS)
        if code.isdigit() and (not out or out[-1] != code):
            out += code
        elif "ก" <= c <= "ฮ":
            out += c
    return out if out[:1].isdigit() else out[:3]


@lru_cache(maxsize=100_000)
def consonants(word: str) -> str:
    return re.sub(r"[aeiouy]", "", word)


@lru_cache(maxsize=50_000)
def trade_of(word: str) -> str | None:
    if word in TRADE:
        return TRADE[word]
    if len(word) >= 4:
        for full in TRADES:
            if abs(len(full) - len(word)) <= 1 and edits(word, full) <= (2 if len(full) >= 8 else 1):
                return full
    return None


class GivenNames:
    """Given names with their nicknames."""

    def __init__(self, nicknames: dict[str, str]):
        self.full = list(nicknames)
        self.known: dict[str, set[str]] = {}
        for name, others in nicknames.items():
            for word in [name, *others.split()]:
                self.known.setdefault(word, set()).add(name)
        self.seen: dict[str, frozenset[str]] = {}

    def of(self, word: str) -> frozenset[str]:
        """The given names that a word may stand for: itself, by nickname, or with one slip."""
        found = self.seen.get(word)
        if found is None:
            if word in self.known:
                found = frozenset(self.known[word])
            elif len(word) >= 4:
                found = frozenset(name for name in self.full if abs(len(name) - len(word)) <= 1 and edits(word, name) <= (2 if len(name) >= 7 else 1))
            else:
                found = frozenset()
            if len(self.seen) >= 50_000:
                self.seen.clear()
            self.seen[word] = found
        return found


DEFAULT = GivenNames(NICKNAMES)


def clean(word: str) -> str:
    """A word without marks, with digits read as the letters they resemble."""
    word = word.translate(OCR) if any(c.isalpha() for c in word) else word
    return re.sub(r"[^\w]|_", "", word)


def parse(text: str, names_: GivenNames = DEFAULT) -> dict:
    """kind, trade, given (sorted, joined), initial and core tokens (sorted) of a spelling; `short` where a token is shortened."""
    text = unicodedata.normalize("NFC", text).strip()
    plain = re.sub(r"[\W_]+", "", text.lower())
    out = {"kind": "other", "trade": "", "given": "", "initial": "", "cores": [plain], "short": False, "plain": plain}
    if re.search("[ก-๙]", text):
        company = bool(THAI_LEGAL.search(text))
        core = re.sub(r"[\W_]+", "", THAI_LEGAL.sub(" ", THAI_TITLES.sub("", text)).lower(), flags=0) or plain
        core = "".join(c for c in THAI_LEGAL.sub("", THAI_TITLES.sub("", text)) if not c.isspace() and c not in ".,-()\"'") or plain
        return out | {"kind": "thai company" if company else "thai", "cores": [core]}
    spaced = CAMEL.sub(" ", text).lower()
    spaced = re.sub(r"g\s*\.\s*m\s*\.\s*b\s*\.\s*h\.?", "gmbh", spaced)
    spaced = re.sub(r"^m/s\.?\s+|^messrs\.?\s+|^the\s+", "m/s ", spaced)
    house = spaced.startswith("m/s ")
    spaced = spaced.removeprefix("m/s ")
    comma = "," in spaced
    quoted = re.findall(r"[\"“”'‘’(]([a-z]{2,})[\"“”'‘’)]", spaced)
    if quoted and not set(quoted) & (LEGAL | set(TRADE)):
        spaced = re.sub(r"[\"“”'‘’(][a-z]{2,}[\"“”'‘’)]", " ", spaced)
    raw = re.findall(r"[^\s,&+/\-()\"“”]+", spaced)
    tokens = []
    for r in raw:
        # Initials may stand together: M.A.
        tokens += [f"{x}." for x in re.findall(r"[a-z]", r)] if re.fullmatch(r"(?:[a-z]\.){2,}", r) else [r]
    legal, trade, rest = False, "", []
    for t in tokens:
        word = clean(t)
        bare = re.sub(r"[^\w']", "", t)
        if word in LEGAL:
            legal = True
        elif t in ("and", "the", "&") or not word:
            continue
        elif not trade and (found := trade_of(bare) or trade_of(word)) and (len(tokens) > 2 or legal):
            trade = found
        else:
            rest.append((word, t.endswith(".")))
    if legal or trade or house:
        cores = [w for w, _ in rest if len(w) > 1] or [plain]
        short = any(dot or not re.search("[aeiou]", w) for w, dot in rest)
        return out | {"kind": "company", "trade": trade, "cores": sorted(cores), "short": short}
    rest = [(w, dot) for w, dot in rest if w not in TITLES]
    if comma and len(rest) >= 2:
        # The family name stands before the comma.
        rest = rest[1:] + rest[:1]
    if not 2 <= len(rest) <= 4:
        return out
    words = [w for w, _ in rest]
    if not comma and len(words[0]) > 2 and not rest[0][1] and not names_.of(words[0]) and names_.of(words[-1]):
        rest, words = rest[1:] + rest[:1], words[1:] + words[:1]
    family = words[-1]
    first, dot = rest[0]
    given = names_.of(first) if len(first) > 1 else frozenset()
    short = False
    if not given:
        # A given name that the table doesn't hold is full unless it is an initial or dotted.
        short = dot or len(first) == 1
        given = frozenset([f"{first}."]) if short else frozenset()
    elif len(given) > 1:
        short = True
    # A word that is no known given name is kept as it is.
    names = sorted(given) or [first]
    return out | {"kind": "person", "given": "|".join(names), "initial": first[0], "cores": [family], "short": short}


FIELDS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("text", "kind", "trade", "given", "initial")]
    + [T.StructField("cores", T.ArrayType(T.StringType())), T.StructField("short", T.BooleanType())]
)
ARROW = pa.schema([(n, pa.string()) for n in ("text", "kind", "trade", "given", "initial")] + [("cores", pa.list_(pa.string())), ("short", pa.bool_())])


def parsed(texts: DataFrame, nicknames: dict[str, str] | None = None) -> DataFrame:
    """The spellings with their parts and an id that equal parts share."""
    shared = texts.sparkSession.sparkContext.broadcast(nicknames) if nicknames is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_ = DEFAULT if shared is None else GivenNames(shared.value)
        for batch in batches:
            rows = [parse(t, names_) | {"text": t} for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pylist([{n: r[n] for n in ARROW.names} for r in rows], schema=ARROW)

    rows = texts.select("text").mapInArrow(run, FIELDS)
    return rows.withColumn("id", F.concat_ws("|", F.regexp_replace("kind", "^thai$", "thai company"), "trade", "given", F.when(F.col("short"), F.col("initial")).otherwise(""), F.concat_ws(" ", "cores"), F.when(F.col("short"), "~").otherwise("")))


def block_keys(kind: str, trade: str, given: str, cores: list[str]) -> set[str]:
    """The blocks of a spelling: each sorted core token's phonetic code, narrowed by what else is known."""
    codes = sorted(phonetic(c) for c in cores)
    if kind == "company":
        return {f"c:{code}:{trade}" for code in codes} | {f"c2:{'.'.join(codes)}", f"j:{phonetic(''.join(cores))}", f"j:{phonetic(''.join(cores[::-1]))}"}
    if kind == "person":
        family = cores[0]
        return {f"p:{codes[0]}:{family[:1]}"} | {f"t:{g}:{part}" for g in given.split("|") for part in (family[:3], "-" + family[-3:])}
    return {f"o:{phonetic(c)}" for c in cores} | {f"r:{c[-4:]}" for c in cores}


def word_like(a: str, b: str) -> bool:
    """Whether two words are one with slips of the pen: near by Jaro-Winkler and one edit, or two in a long word."""
    if a == b:
        return True
    allowed = 2 if min(len(a), len(b)) >= 8 else 1 if min(len(a), len(b)) >= 4 else 0
    return edits(a, b) <= allowed and jaro_winkler(a, b) >= 0.8


def short_of(a: str, b: str) -> bool:
    """Whether `a` is the beginning or the consonants of `b`."""
    return len(a) >= 3 and len(a) < len(b) and (b.startswith(a) or not re.search("[aeiou]", a) and a in (consonants(b), b[0] + consonants(b[1:])))


def cores_like(a: list[str], b: list[str], short: bool) -> bool:
    """Whether the core tokens of two companies pair up."""
    if "".join(a) == "".join(b):
        return True
    if len(a) != len(b):
        return word_like("".join(a), "".join(b)) or len(b) == 2 and word_like("".join(a), b[1] + b[0]) or len(a) == 2 and word_like("".join(b), a[1] + a[0])
    left = list(b)
    slips = 0
    for x in a:
        hit = next((y for y in left if x == y), None)
        if hit is None:
            hit = next((y for y in left if word_like(x, y) or short and (short_of(x, y) or short_of(y, x))), None)
            slips += 1
        if hit is None:
            return False
        left.remove(hit)
    return len(a) > 1 or slips == 0 or len(a[0]) >= 5


def given_like(a: str, b: str) -> str | None:
    """How the given names of two persons fit: equal, or one as the beginning of the other ("a" or "b", the shorter one); None if not."""
    one, two = set(a.split("|")), set(b.split("|"))
    if one & two:
        return "equal"
    for short, full, side in ((one, two, "a"), (two, one, "b")):
        for x in short:
            least = 1 if x.endswith(".") else 3
            stem = x.rstrip(".")
            if len(stem) >= least and any(len(y) > len(stem) and y.startswith(stem) for y in full if not y.endswith(".") or x.endswith(".")):
                return side
    return None


def same_name(a: dict, b: dict) -> str | None:
    """Whether two parsed spellings may denote one person or company, and if so which side is the short form: "a", "b", "both" or "none"."""
    if a["kind"] != b["kind"] and not {a["kind"], b["kind"]} <= {"thai", "thai company"}:
        return None
    short = {(True, True): "both", (True, False): "a", (False, True): "b"}.get((a["short"], b["short"]), "none")
    if a["kind"] == "company":
        if a["trade"] and b["trade"] and a["trade"] != b["trade"]:
            return None
        return short if cores_like(a["cores"], b["cores"], a["short"] or b["short"]) else None
    if a["kind"] == "person":
        fit = given_like(a["given"], b["given"])
        if fit is None or not word_like(a["cores"][0], b["cores"][0]):
            return None
        return fit if short == "none" and fit != "equal" else short
    return short if word_like(a["cores"][0], b["cores"][0]) else None


def links(rows: DataFrame) -> DataFrame:
    """Accepted links (a, b, short) between ids; `short` names the side with a short form, if any."""
    parts = ["kind", "trade", "given", "cores", "short"]
    keyed_schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("block", T.StringType())])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(r["id"], k) for r in batch.to_pylist() for k in block_keys(r["kind"], r["trade"], r["given"], r["cores"])]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], names=["id", "block"])

    pairs = block_pairs(checkpoint(rows.mapInArrow(keys, keyed_schema)))
    one = rows.select(F.col("id").alias("a"), F.struct(*parts).alias("one"))
    two = rows.select(F.col("id").alias("b"), F.struct(*parts).alias("two"))
    compared = pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [same_name(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            at = pa.array([n for n, side in enumerate(sides) if side], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([side for side in sides if side], pa.string())], names=["a", "b", "short"])

    return spread(compared).mapInArrow(run, "a string, b string, short string")


def short_names(forms: DataFrame, found: DataFrame, full: DataFrame) -> DataFrame:
    """node and component of the short forms that fit no full spelling, by the links between them.

    A component is one name if its members have a given name in common and no two
    trades. Else a short form stands between two names ('Ted' between 'T.' and 'E.'),
    and only those with the same given names and trade are linked.
    """
    alone = forms.filter("short").join(full.select(F.col("one").alias("id")), "id", "left_anti").select("id", "given", "trade")
    sides = [alone.select(F.col("id").alias(n), F.col("given").alias(f"given_{n}"), F.col("trade").alias(f"trade_{n}")) for n in ("a", "b")]
    loose = checkpoint(found.filter("short != 'none'").join(sides[0], "a").join(sides[1], "b"))
    wide = components(loose)
    near = components(loose.filter("given_a = given_b and trade_a = trade_b")).select("node", F.col("component").alias("near"))
    members = wide.join(alone.withColumnRenamed("id", "node"), "node")
    trades = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.countDistinct(F.nullif("trade", F.lit(""))).alias("trades")).filter("trades <= 1")
    # Initials must all be the first letter of the name that the others have in common.
    letters = members.filter(F.col("given").endswith(".")).groupBy("component").agg(F.count(F.lit(1)).alias("initials"), F.min("given").alias("letter"), F.max("given").alias("other"))
    shared = members.filter(~F.col("given").endswith(".")).select("component", F.explode(F.split("given", r"\|")).alias("name")).groupBy("component", "name").agg(F.count(F.lit(1)).alias("named"))
    known = trades.join(letters, "component", "left").join(shared, "component", "left")
    one_letter = F.col("letter").isNull() | (F.col("letter") == F.col("other"))
    fits = F.when(F.col("initials") == F.col("size"), True).otherwise((F.coalesce("named", F.lit(0)) + F.coalesce("initials", F.lit(0)) == F.col("size")) & (F.col("letter").isNull() | F.col("name").startswith(F.regexp_replace("letter", r"\.$", ""))))
    whole = known.filter(one_letter & fits).select("component", F.col("component").alias("whole")).distinct()
    return wide.join(whole, "component", "left").join(near, "node", "left").select("node", F.coalesce("whole", "near", "node").alias("component"))


#: Rows of a table of nicknames, at most; it travels to every worker.
NICKNAME_ROWS = 100_000


def nickname_table(nicknames: DataFrame) -> dict[str, str]:
    """A table of given names (name, nickname) as a dict; beyond `NICKNAME_ROWS` rows it is an error."""
    rows = nicknames.select(F.lower("name").alias("name"), F.lower("nickname").alias("nickname")).filter("name is not null").limit(NICKNAME_ROWS + 1).collect()
    if len(rows) > NICKNAME_ROWS:
        raise ValueError(f"a table of nicknames of more than {NICKNAME_ROWS} rows")
    out: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r.name, r.nickname or "")):
        out[r.name] = f"{out.get(r.name, '')} {r.nickname or ''}".strip()
    return out


def same_names(texts: DataFrame, nicknames: DataFrame | None = None) -> DataFrame:
    """The entity (component) of each different spelling: text, entity. `nicknames` (name, nickname) replaces the built-in ones."""
    given = None if nicknames is None else nickname_table(nicknames)
    rows = checkpoint(parsed(spread(texts.select("text").filter(F.col("text").isNotNull()).distinct()), given))
    forms = rows.groupBy("id").agg(*[F.first(c).alias(c) for c in ("kind", "trade", "given", "cores", "short")])
    found = checkpoint(links(forms))
    strong = components(found.filter("short = 'none'").select("a", "b"))
    of = [strong.select(F.col("node").alias(n), F.col("component").alias(f"of_{n}")) for n in ("one", "two")]
    # A short form, with all that is one with it, joins the one entity that all full forms it fits belong to.
    toward = found.filter("short = 'a'").select(F.col("a").alias("one"), F.col("b").alias("two")).unionByName(found.filter("short = 'b'").select(F.col("b").alias("one"), F.col("a").alias("two")))
    ends = toward.join(of[0], "one", "left").join(of[1], "two", "left").select("one", F.coalesce("of_one", "one").alias("from"), F.coalesce("of_two", "two").alias("to")).filter(F.col("from") != F.col("to"))
    ends = checkpoint(ends)
    single = ends.groupBy("from").agg(F.min("to").alias("to"), F.max("to").alias("other")).filter(F.col("to") == F.col("other")).select(F.col("from").alias("a"), F.col("to").alias("b"))
    joined = components(single)
    loose = short_names(forms, found, ends.select("one").distinct())
    known = rows.select("id").distinct().join(strong.select(F.col("node").alias("id"), F.col("component").alias("own")), "id", "left").join(loose.select(F.col("node").alias("id"), F.col("component").alias("loose")), "id", "left")
    named = known.select("id", F.coalesce("loose", "own", "id").alias("own")).join(joined.select(F.col("node").alias("own"), F.col("component").alias("joined")), "own", "left")
    return rows.join(named.select("id", F.coalesce("joined", "own").alias("entity")), "id").select("text", "entity")


NAME_FIELDS = {"invoices": ("vendor_name", "bill_to_name"), "purchase_orders": ("supplier_name", "buyer_name")}


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of different spellings of one person or company: name_a, name_b."""
    entities = same_names(field_values(spark, folder, NAME_FIELDS).filter(~F.col("text").rlike(r"^\s*$")))
    return pairs_within(entities, "entity", "text", "name_a", "name_b")


def p4_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Each different spelling with its entity and the number of other spellings of the entity: name, entity, n_links."""
    entities = same_names(field_values(spark, folder, NAME_FIELDS).filter(~F.col("text").rlike(r"^\s*$")))
    sizes = entities.groupBy("entity").agg((F.count(F.lit(1)) - 1).alias("n_links"))
    return entities.join(sizes, "entity").select(F.col("text").alias("name"), "entity", "n_links")
