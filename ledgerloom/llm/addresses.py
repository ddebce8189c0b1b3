"""Postal addresses that denote the same place (problem 5).

Each address text is taken apart into house number, street, kind of street, unit
and the remaining words (town, province). Texts with the same parts fall together
at once. The others are compared where the strict parts - house number, unit,
floor, kind of street - are equal: in sorted neighbourhoods, several passes of
which order these entries by different components. While no more entries share the
strict parts than a window holds, the passes compare them all; of more entries, each
order's window grows as long as the neighbours share the beginning, the end or the
middle of the street's name. Street names are compared by an edit distance that
counts swapped letters once.

A missing town, postcode or country says nothing, a contradicting one makes another
place; a town and a province don't contradict where an address names both. Links that rest on an equal town or postcode, or between texts that have
neither, are closed to connected components; a text that lacks them joins a place
only where all places that it fits are one. A component with two countries is parted
by them.

Defined results: null, blank and unparsable texts (without house number or
street) are linked only to texts that differ in case, blanks and marks. Repeated
texts count once. A text is never paired with itself. Extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerloom.llm.graph import block_pairs, components, pairs_within
from ledgerloom.llm.strings import edits
from ledgerloom.tables import checkpoint, spread, table

#: Entries with equal strict parts that one window holds.
WINDOW = 12

# Kinds of street and their short forms.
KINDS = {
    "street": "street st str strt",
    "road": "road rd rod",
    "avenue": "avenue ave av aven",
    "drive": "drive dr drv",
    "lane": "lane ln",
    "boulevard": "boulevard blvd bvd boul",
    "highway": "highway hwy hway hgwy",
    "crescent": "crescent cres cresc crs cr",
}
KIND = {w: k for k, words in KINDS.items() for w in words.split()}
# Kinds of unit and their short forms.
UNITS = {"room": "room rm", "suite": "suite ste", "unit": "unit u", "apartment": "apartment apt flat"}
UNIT = {w: k for k, words in UNITS.items() for w in words.split()}
# Countries, with their other names.
COUNTRIES = {
    "us": "united states|usa|us|u s a|u s|united states of america",
    "ph": "philippines|phil|phils|ph",
    "th": "thailand|thai|th|ประเทศไทย|ไทย",
    "my": "malaysia|m sia|my",
    "de": "germany|deutschland|de",
    "sg": "singapore|sg",
    "gb": "united kingdom|uk|gb|great britain",
    "vn": "vietnam|viet nam|vn",
}
COUNTRY = {w: c for c, words in COUNTRIES.items() for w in words.split("|")}

THAI_DIGITS = str.maketrans("๐๑๒๓๔๕๖๗๘๙", "0123456789")
FLOOR = re.compile(r"(?<![\w/])(\d{1,3})\s*(?:st|nd|rd|th)?\s*(?:floor|flr|fl)\b|\b(?:floor|flr|fl)\s*(?:no|#)?\s*(\d{1,3})\b|ชั้น\s*(\d{1,3})")
ROOM = re.compile(rf"\b({'|'.join(UNIT)})\b\s*(?:no\b|#)?\s*#?\s*(\d{{1,5}}[a-z]?)\b|ห้อง\s*(\d{{1,5}})")
HASH = re.compile(r"#\s*(\d{1,5}(?:/\d{1,4})?[a-z]?)\b")
NUMBER = re.compile(r"(?<![\w/])(?:no\s*)?(\d{1,4}(?:/\d{1,4})?[a-z]?)(?![\w/])")
POSTCODE = re.compile(r"(?<!\d)(\d{5})(?!\d)")
THAI_STREET = re.compile(r"(?:ถนน|ถ\s)\s*([ก-๙]+)")
# Words for districts and provinces before their names.
THAI_AREA = re.compile(r"(?:แขวง|เขต|ตำบล|อำเภอ|จังหวัด)\s*(?=[ก-๙])")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[ก-๙]+")


def folded(text: str) -> str:
    """Lower case without accents on Latin letters; marks become blanks except # and the slash of house numbers."""
    text = unicodedata.normalize("NFC", text.translate(THAI_DIGITS)).lower()
    text = text.replace("ü", "ue").replace("ö", "oe").replace("ä", "ae").replace("ß", "ss")
    text = re.sub(r"(?<=\d)/(?=\d)", "\x00", text)
    text = re.sub(r"[^\w\x00#฀-๿'’]|_", " ", text)
    return re.sub(r"\s+", " ", text.replace("\x00", "/")).strip()


@lru_cache(maxsize=4096)
def kind_of(word: str) -> str | None:
    """The kind of street that a word names; a typo is allowed in the longer ones."""
    if word in KIND:
        return KIND[word]
    if len(word) >= 4:
        for full in KINDS:
            if edits(word, full) <= 1:
                return full
    return None


def parse(text: str) -> dict[str, str]:
    """number, street, kind, unit, unit_kind, postcode, country and the other words of an address; empty where missing."""
    rest = folded(text)
    out = dict.fromkeys(("number", "street", "kind", "unit", "unit_kind", "floor", "postcode", "country"), "")
    thai = THAI_STREET.search(rest)
    if thai:
        out["street"], out["kind"] = thai[1], "ถนน"
        rest = rest[: thai.start()] + " " + rest[thai.end() :]
    if m := FLOOR.search(rest):
        out["floor"] = (m[1] or m[2] or m[3]).lstrip("0")
        rest = rest[: m.start()] + " " + rest[m.end() :]
    if m := ROOM.search(rest):
        out["unit_kind"], out["unit"] = UNIT.get(m[1] or "", "room"), m[2] or m[3]
        rest = rest[: m.start()] + " " + rest[m.end() :]
    if m := POSTCODE.search(rest):
        out["postcode"] = m[1]
        rest = rest[: m.start()] + " " + rest[m.end() :]
    numbers = [m for m in NUMBER.finditer(rest.replace("#", " "))]
    hashes = [m for m in HASH.finditer(rest)]
    if hashes and len(numbers) > 1 and not out["unit"]:
        out["unit_kind"], out["unit"] = "#", hashes[0][1]
        rest = rest[: hashes[0].start()] + " " + rest[hashes[0].end() :]
    rest = rest.replace("#", " ")
    words = [(m[0], m.start(), m.end()) for m in WORD.finditer(rest)]
    if not out["street"]:
        for i in range(1, len(words)):
            kind = kind_of(words[i][0])
            before = words[i - 1][0]
            if kind and len(before) > 2 and before not in ("no", "the"):
                # "St" may also begin a name; the last such word after a name is the kind.
                out["street"], out["kind"] = before, kind
                rest = rest[: words[i - 1][1]] + " " * (words[i][2] - words[i - 1][1]) + rest[words[i][2] :]
                break
    if m := NUMBER.search(rest):
        out["number"] = m[1].lstrip("0") or m[1]
        rest = rest[: m.start()] + " " + rest[m.end() :]
    left = " ".join(w for w in THAI_AREA.sub(" ", re.sub(r"['’]", " ", rest)).split() if w != "no")
    for name in sorted(COUNTRY, key=len, reverse=True):
        if re.search(rf"(?:^| ){re.escape(name)}$|^{re.escape(name)}(?: |$)", left) or len(name) > 5 and re.search(rf"\b{re.escape(name)}\b", left):
            out["country"] = COUNTRY[name]
            left = re.sub(rf"\b{re.escape(name)}\b", " ", left, count=1)
            break
    out["others"] = " ".join(sorted(left.split()))
    out["plain"] = re.sub(r"[\W_]+", "", folded(text))
    return out


PARTS = ("number", "street", "kind", "unit", "unit_kind", "floor", "postcode", "country", "others", "plain")


def parsed(texts: DataFrame, column: str = "text") -> DataFrame:
    """The texts with their parts."""
    schema = T.StructType([T.StructField("text", T.StringType()), *[T.StructField(p, T.StringType()) for p in PARTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_pylist()
            rows = [parse(v) for v in values]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), *[pa.array([r[p] for r in rows], pa.string()) for p in PARTS]], names=schema.names)

    return texts.select(column).mapInArrow(run, schema)


def street_like(a: str, b: str) -> bool:
    """Whether two street names are one with a slip: an edit for four letters, at most two."""
    shorter = min(len(a), len(b))
    return a == b or edits(a, b) <= (2 if shorter >= 7 else 1 if shorter >= 4 else 0)


@lru_cache(maxsize=100_000)
def town_like(a: str, b: str) -> bool:
    """Whether the words besides street and number may be of one town: one of them is in both, but for slips and short forms."""
    left, right = a.split(), b.split()
    if "".join(left) == "".join(right):
        return True
    for x in left:
        for y in right:
            short, long = sorted((x, y), key=len)
            if x == y and len(x) > 2 or len(short) >= 4 and edits(x, y) <= (2 if len(short) >= 7 else 1) or len(short) >= 3 and len(long) > 4 and long.startswith(short):
                return True
    return False


def same_place(a: dict, b: dict) -> bool:
    """Strict on house number, unit and floor, tolerant on the street's spelling, and no contradicting postcode or country."""
    if a["number"] != b["number"] or a["unit"] != b["unit"] or a["floor"] != b["floor"] or a["kind"] != b["kind"]:
        return False
    if a["unit_kind"] != b["unit_kind"] and "#" not in (a["unit_kind"], b["unit_kind"]):
        return False
    if a["country"] and b["country"] and a["country"] != b["country"]:
        return False
    if a["postcode"] and b["postcode"] and edits(a["postcode"], b["postcode"]) > 1:
        return False
    return street_like(a["street"], b["street"])


def basis(a: dict, b: dict) -> str:
    """What the link of two texts of one street rests on.

    firm: a town or postcode of both, or neither side has any. loose: nothing that both have. apart: other towns,
    which are one place only if one of the words is a town and the other its province.
    """
    if a["postcode"] and a["postcode"] == b["postcode"]:
        return "firm"  # equal postcodes outweigh the words beside them
    if a["others"] and b["others"]:
        return "firm" if town_like(a["others"], b["others"]) else "apart"
    if a["postcode"] and b["postcode"]:
        return "firm"
    return "loose" if a["postcode"] or a["others"] or b["postcode"] or b["others"] else "firm"


STRICT = ("number", "unit", "floor", "kind")
#: Orders of the components in the passes over entries with equal strict parts.
ORDERS = (("street", "postcode"), ("reversed", "postcode"), ("postcode", "street"))


def neighbours(keys: DataFrame, order: tuple[str, ...], window: int) -> DataFrame:
    """Pairs (a, b) of each entry with the entries up to `window` places before it in one order."""
    before = F.collect_list("id").over(Window.partitionBy("block").orderBy(*order, "id").rowsBetween(-window, -1))
    placed = keys.select(F.col("id").alias("x"), before.alias("before"))
    return placed.select("x", F.explode("before").alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def runs(keys: DataFrame) -> DataFrame:
    """(id, block) of the runs that entries with equal strict parts form in the orders: an equal beginning, end or middle of the street.

    Streets of seven letters and more may differ by two edits, others by one; of beginning, middle and end one stays whole.
    """
    street, long = F.col("street"), F.length("street") >= 7
    size = F.when(long, 3).otherwise(2)
    made = [F.concat(F.lit("p"), F.substring(street, F.lit(1), size)), F.concat(F.lit("s"), F.reverse(F.substring(F.reverse(street), F.lit(1), size)))]
    made += [F.when(long, F.concat(F.lit("m"), F.substring(street, k, 3))) for k in (3, 4, 5)]
    made += [F.when(~long, F.concat(F.lit("e"), F.substring(street, 1, 1), F.reverse(F.substring(F.reverse(street), 1, 1))))]
    return keys.select("id", F.explode(F.array_distinct(F.array_compact(F.array(*made)))).alias("part"), "block").select("id", F.concat_ws("|", "block", "part").alias("block"))


def links(keys: DataFrame, window: int = WINDOW) -> DataFrame:
    """Links (a, b, basis, others of both) between entries with parts, found in all passes."""
    keys = keys.withColumns({"reversed": F.reverse("street"), "block": F.concat_ws("|", *STRICT)})
    sizes = keys.groupBy("block").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    sized = checkpoint(keys.join(sizes, "block"))
    # One pass of a window that holds all entries compares them all.
    small = neighbours(sized.filter(F.col("size") <= window + 1), ORDERS[0], window)
    pairs = small
    for order in ORDERS:
        # Parting the largest sets by the order's first letters keeps each window's rows few.
        large = sized.filter(F.col("size") > window + 1).withColumn("block", F.concat_ws("|", "block", F.substring(order[0], 1, 2)))
        pairs = pairs.unionByName(neighbours(large, order, window))
    pairs = pairs.unionByName(block_pairs(runs(sized.filter(F.col("size") > window + 1)))).distinct()
    parts = F.struct("unit_kind", "postcode", "country", "others", "street", *STRICT)
    one, two = sized.select(F.col("id").alias("a"), parts.alias("one")), sized.select(F.col("id").alias("b"), parts.alias("two"))
    near = pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ones, twos = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = [n for n, (x, y) in enumerate(zip(ones, twos, strict=True)) if same_place(x, y)]
            at = pa.array(good, pa.int64())
            told = [pa.array(v, pa.string()) for v in ([basis(ones[n], twos[n]) for n in good], [ones[n]["others"] for n in good], [twos[n]["others"] for n in good])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *told], names=["a", "b", "basis", "town_a", "town_b"])

    return near.mapInArrow(run, "a string, b string, basis string, town_a string, town_b string")


#: Addresses that must name two words together for one to be the other's province.
TOGETHER = 2


def reconciled(keys: DataFrame, found: DataFrame) -> DataFrame:
    """The links (a, b, firm) with those of other towns left out, unless some address names words of both together."""
    words = keys.select("id", F.array_distinct(F.split("others", " ")).alias("w")).filter(F.size("w") > 1)
    named = words.select("id", F.explode("w").alias("x"), "w").select("id", "x", F.explode("w").alias("y"))
    together = named.filter((F.col("x") < F.col("y")) & (F.length("x") > 2) & (F.length("y") > 2)).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= TOGETHER).select("x", "y")
    apart = found.filter("basis = 'apart'")
    towns = apart.select("town_a", "town_b").distinct().withColumn("p", F.explode(F.split("town_a", " "))).withColumn("q", F.explode(F.split("town_b", " ")))
    fitting = towns.select("town_a", "town_b", F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).join(together, ["x", "y"], "left_semi").select("town_a", "town_b").distinct()
    kept = found.filter("basis != 'apart'").unionByName(apart.join(fitting, ["town_a", "town_b"], "left_semi").select(*found.columns))
    return kept.select("a", "b", (F.col("basis") == "firm").alias("firm"))


def settled_places(keys: DataFrame, found: DataFrame) -> DataFrame:
    """id and place of the entries that links join, by firm links first and loose ones where they leave no choice."""
    firm_ = components(found.filter("firm").select("a", "b"))
    own = keys.join(firm_.withColumnRenamed("node", "id"), "id", "left").select("id", "country", ((F.col("postcode") == "") & (F.col("others") == "")).alias("bare"), F.coalesce("component", "id").alias("component"))
    # Two countries in one component: what has a country stays with its like, what has none stays alone.
    several = own.filter("country != ''").groupBy("component").agg(F.countDistinct("country").alias("n")).filter("n > 1").select("component", F.lit(True).alias("mixed"))
    parted = own.join(several, "component", "left").select("id", "bare", F.when(~F.coalesce("mixed", F.lit(False)), F.col("component")).when(F.col("country") != "", F.concat_ws("@", "component", "country")).otherwise(F.col("id")).alias("component"))
    parted = checkpoint(parted)
    loose = found.filter("not firm").select("a", "b")
    sides = [parted.select(F.col("id").alias(n), F.col("bare").alias(f"bare_{n}"), F.col("component").alias(f"of_{n}")) for n in ("a", "b")]
    between = loose.join(sides[0], "a").join(sides[1], "b").filter("of_a != of_b")
    both = between.select(F.col("of_a").alias("one"), F.col("bare_a").alias("bare"), F.col("of_b").alias("two")).unionByName(between.select(F.col("of_b").alias("one"), F.col("bare_b").alias("bare"), F.col("of_a").alias("two")))
    single = checkpoint(both.groupBy("one").agg(F.min("two").alias("two"), F.max("two").alias("other"), F.max("bare").alias("bare")).filter(F.col("two") == F.col("other")).select("one", "two", "bare"))
    back = single.select(F.col("one").alias("two"), F.col("two").alias("one"))
    # A text without town and postcode follows its only place; others join only where each is the other's only one.
    joined = single.filter("bare").select("one", "two").unionByName(single.filter("not bare").select("one", "two").join(back, ["one", "two"], "left_semi"))
    merged = components(joined.select(F.col("one").alias("a"), F.col("two").alias("b")))
    return parted.join(merged.select(F.col("node").alias("component"), F.col("component").alias("whole")), "component", "left").select("id", F.coalesce("whole", "component").alias("place"))


def same_places(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """The place (component) of each different text: text, place."""
    rows = parsed(spread(texts.select("text").filter(F.col("text").isNotNull()).distinct()))
    whole = (F.col("number") != "") & (F.col("street") != "")
    id_of: Column = F.when(whole, F.concat_ws("|", *PARTS[:9])).otherwise(F.concat(F.lit("~"), "plain"))
    rows = checkpoint(rows.withColumn("id", id_of).select("text", "id", *PARTS[:9]))
    keys = rows.filter(~F.col("id").startswith("~")).select("id", *PARTS[:9]).distinct()
    places = settled_places(keys, checkpoint(reconciled(keys, checkpoint(links(keys, window)))))
    return rows.join(places, "id", "left").select("text", F.coalesce("place", "id").alias("place"))


ADDRESS_FIELDS = {"invoices": ("bill_to_address", "vendor_address"), "purchase_orders": ("supplier_address",), "delivery_notes": ("recipient_address",)}


def field_values(spark: SparkSession, folder: str, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """All values of the named fields of the tables' JSON, as `text`."""
    out = None
    for name, columns in fields.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        rows = table(spark, folder, name, "output").select(F.from_json("output", schema).alias("o"))
        values = rows.select(F.explode(F.array(*[F.col(f"o.{c}") for c in columns])).alias("text")).filter(F.col("text").isNotNull()).distinct()
        out = values if out is None else out.unionByName(values)
    return out


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of different address texts of one place: address_a, address_b."""
    places = same_places(field_values(spark, folder, ADDRESS_FIELDS).filter(~F.col("text").rlike(r"^\s*$")))
    return pairs_within(places, "place", "text", "address_a", "address_b")


def p5_places(spark: SparkSession, folder: str) -> DataFrame:
    """Each different address text with its place and the number of other texts of the place: address, place, n_links."""
    places = same_places(field_values(spark, folder, ADDRESS_FIELDS).filter(~F.col("text").rlike(r"^\s*$")))
    sizes = places.groupBy("place").agg((F.count(F.lit(1)) - 1).alias("n_links"))
    return places.join(sizes, "place").select(F.col("text").alias("address"), "place", "n_links")
