"""Wordings of the entries of a reference list, taken from the list itself and from the data.

An entry's name is a wording of it. Its description may name synonyms behind a
colon or joined by "or"; a synonym of the one party that a name speaks of holds
for all entries of the list that speak of it. Further wordings come from a table
of synonyms that the caller passes, and from the data: a value entered together
with an entry's own description is a wording of that entry, and a document type
that goes with one type of result nearly always is a wording of that type.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Short forms of words in field and document names.
SHORT_FORMS = dict(
    pair.split("=")
    for pair in (
        "addr=address no=number num=number nr=number dt=date amt=amount ttl=total tot=total wt=weight qty=quantity pmt=payment curr=currency ccy=currency"
        " pkg=package pkgs=packages dlvry=delivery dlv=delivery rcpt=recipient req=requested suppl=supplier supp=supplier cust=customer inv=invoice purch=purchase ord=order"
        " decl=declaration stmt=statement tel=telephone phn=phone desc=description"
    ).split()
)

#: Times that a wording must be seen, and the least share (lower bound) that must mean one entry.
SUPPORT, SHARE = 2, 0.6
#: The same for document types, whose meaning shows only by what goes with them.
TYPE_SUPPORT, TYPE_SHARE = 8, 0.65


def described(rows: list[tuple[str, str, str | None, int]]) -> list[tuple[str, str, int]]:
    """(list, phrase, term_id) of the entries (list, name, description, term_id) by their names and descriptions."""
    out = {(kind, name, term) for kind, name, _, term in rows}
    for kind, name, description, term in rows:
        told = re.search(r":\s*(.+)$", description or "")
        words = [w.strip() for w in re.split(r",|\bor\b", told[1])] if told else []
        words += re.findall(r"^(\w+) or (\w+) who\b", description or "")[0] if re.match(r"\w+ or \w+ who\b", description or "") else []
        subject = name.removesuffix("_name") if name.endswith("_name") else None
        for word in filter(None, words):
            out.add((kind, word, term))
            if subject is None:
                continue
            # The synonym names the party; what the list says of the party is said of the synonym too.
            for other_kind, other, _, other_term in rows:
                if other_kind == kind and other.startswith(subject + "_"):
                    out.add((kind, word + " " + other[len(subject) + 1 :].replace("_", " "), other_term))
        if subject is not None:
            out.add((kind, subject.replace("_", " "), term))
        # A sum is also called by what it is a sum of, an address by the party alone it is not.
        if name.endswith("_amount") and told:
            out.update((kind, f"{word} amount", term) for word in words)
    return sorted(out)


def lower_bound(hits, total):
    """The lower end of Wilson's interval of a share, at two standard errors."""
    share = hits / total
    return (share + 2 / total - 2 * F.sqrt(share * (1 - share) / total + 1 / (total * total))) / (1 + 4 / total)


def majority(rows: DataFrame, keys: list[str], support: int, least: float) -> DataFrame:
    """Of `rows` (keys, term_id, one per sighting) the term that a key means nearly always."""
    each = rows.groupBy(*keys, "term_id").agg(F.count(F.lit(1)).alias("hits"))
    sums = each.groupBy(*keys).agg(F.sum("hits").alias("total"), F.max(F.struct("hits", (-F.col("term_id")).alias("other"))).alias("best"))
    good = sums.filter((F.col("best.hits") >= support) & (lower_bound(F.col("best.hits"), F.col("total")) >= least))
    return good.select(*keys, (-F.col("best.other")).alias("term_id"))


def learned_names(suggested: DataFrame, terms: DataFrame, plain) -> DataFrame:
    """list, phrase, term_id of the names that were suggested (name, description) with an entry's own description.

    `plain` brings a name to its words. An entry of several lists with one description gets the wording in each.
    """
    told = suggested.filter("name is not null and description is not null").select(plain(F.col("name")).alias("phrase"), F.lower(F.trim("description")).alias("description"))
    own = terms.filter("description is not null").select("list", "term_id", F.lower(F.trim("description")).alias("description"))
    seen = told.filter("phrase != ''").groupBy("phrase", "description").agg(F.count(F.lit(1)).alias("n"))
    rows = seen.join(own, "description").groupBy("list", "phrase", "term_id").agg(F.sum("n").alias("hits"))
    best = rows.groupBy("list", "phrase").agg(F.sum("hits").alias("total"), F.max(F.struct("hits", (-F.col("term_id")).alias("other"))).alias("best"))
    good = best.filter((F.col("best.hits") >= SUPPORT) & (F.col("best.hits") >= SHARE * F.col("total")))
    return good.select("list", "phrase", (-F.col("best.other")).alias("term_id"))


def learned_types(answers: DataFrame, results: DataFrame, types: DataFrame, plain) -> DataFrame:
    """list, phrase, term_id of the document types of `answers` (result_id, doc_type) that go with one type of `results` (result_id, doc_type)."""
    said = answers.filter("doc_type is not null").select("result_id", plain(F.col("doc_type")).alias("phrase")).filter("phrase != ''").distinct()
    known = results.select("result_id", F.col("doc_type").alias("name")).distinct().join(types.select(F.col("phrase").alias("name"), "term_id"), "name")
    rows = said.join(known.select("result_id", "term_id"), "result_id")
    return majority(rows, ["phrase"], TYPE_SUPPORT, TYPE_SHARE).select(F.lit("").alias("list"), "phrase", "term_id")
