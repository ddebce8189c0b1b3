"""Wordings learned from a catalog and data made up here."""

from ledgerloom.llm import canonical, vocabulary

TERMS = [
    (1, "doc_type", None, "lab_report", "findings about a sample"),
    (2, "doc_type", None, "loan_slip", "record of a borrowed thing"),
    (3, "field", "lab_report", "assayer_name", "party that tests the sample: analyst, chemist"),
    (4, "field", "lab_report", "assayer_address", "place of the testing party"),
    (5, "field", "lab_report", "sample_number", "identifier of the sample"),
    (6, "field", "lab_report", "remarks", "anything else"),
    (7, "field", "loan_slip", "remarks", "anything else"),
    (8, "field", "loan_slip", "return_date", "day to bring it back"),
]


def frames(spark):
    return spark.createDataFrame(TERMS, "term_id bigint, kind string, doc_type string, name string, description string")


def mapped(spark, phrases, cases):
    got = canonical.map_values(spark.createDataFrame(list(cases), "list string, value string"), phrases)
    return {(r.list, r.value): r.term_id for r in got.collect()}


def test_names_descriptions_and_a_synonym_table(spark):
    synonyms = spark.createDataFrame([("loan_slip", "deadline", "return_date"), ("loan_slip", "other", "no such entry")], "list string, phrase string, name string")
    phrases = canonical.catalog_phrases(spark, frames(spark), synonyms)
    cases = {("lab_report", "Analyst"): 3, ("lab_report", "chemist address"): 4, ("lab_report", "address of assayer"): 4, ("lab_report", "SampleNr"): 5, ("lab_report", "smaple-number"): 5, ("loan_slip", "Deadline:"): 8, ("", "Lab Report *"): 1}
    assert mapped(spark, phrases, [*cases, ("lab_report", "deadline"), ("loan_slip", "analyst"), ("loan_slip", "???")]) == cases


def test_wordings_are_learned_from_described_suggestions(spark):
    rows = [("Probenummer", "identifier of the sample")] * 3 + [("probe nummer.", "identifier of the sample"), ("Bemerkung", "anything else"), ("bemerkung", " Anything else"), ("once", "identifier of the sample"), ("mixed", "identifier of the sample"), ("mixed", "day to bring it back"), ("mixed", "place of the testing party"), ("x", None), (None, "anything else"), ("seen", "seen on page")]
    suggested = spark.createDataFrame(rows, "name string, description string")
    got = {tuple(r) for r in vocabulary.learned_names(suggested, canonical.listed_terms(frames(spark)), canonical.plain_words).collect()}
    assert got == {("lab_report", "probenummer", 5), ("lab_report", "bemerkung", 6), ("loan_slip", "bemerkung", 7)}
    assert vocabulary.learned_names(suggested.limit(0), canonical.listed_terms(frames(spark)), canonical.plain_words).count() == 0


def test_types_are_learned_from_what_goes_with_them(spark):
    answers = [(i, "Laborbericht" if i % 2 else "the LABORBERICHT") for i in range(20)] + [(i, "zettel") for i in range(40)] + [(i, "rare") for i in range(5)] + [(50, None), (51, " ")]
    results = [(i, "lab_report") for i in range(20)] + [(i, "loan_slip") for i in range(20, 40)] + [(50, None)]
    types = spark.createDataFrame([("lab_report", 1), ("loan_slip", 2)], "phrase string, term_id bigint")
    got = vocabulary.learned_types(spark.createDataFrame(answers, "result_id bigint, doc_type string"), spark.createDataFrame(results, "result_id bigint, doc_type string"), types, canonical.plain_words)
    assert {tuple(r) for r in got.collect()} == {("", "laborbericht", 1)}
