"""The check behind the tagger: phone words before 'no.', and company words beside a person's name."""

import pytest

from ledgerloom.llm import pii


def settled(piece, part, kind):
    return pii.settled(piece, piece.index(part), piece.index(part) + len(part), kind)


@pytest.mark.parametrize("before", ["Phone No. ", "phone no: ", "Tel. No. ", "Mobile number ", "Fax No. "])
def test_phone_word_outranks_number_word(before):
    assert settled(f"{before}02-123-4567", "02-123-4567", "phone") == "phone"


@pytest.mark.parametrize("before", ["Invoice No. ", "No. ", "Ref no. ", "Phone model no. ", "Serial #"])
def test_document_word_still_counts(before):
    assert settled(f"{before}02-123-4567", "02-123-4567", "phone") is None


@pytest.mark.parametrize("piece", ["Michael Smith signed for the supplies", "Services provided by Michael Smith", "Michael Smith, Tibidu Foods Ltd", "limited offer from Michael Smith", "michael smith asked for the foods"])
def test_person_beside_company_word(piece):
    part = "michael smith" if piece[0] == "m" else "Michael Smith"
    assert settled(piece, part, "person_name") == "person_name"


@pytest.mark.parametrize(("piece", "part"), [("Gabago and Bifagax Manufacturing Corp.", "Gabago and Bifagax"), ("Vendor: M/s Tibidu Gerulir", "Tibidu Gerulir"), ("Tibidu Gerulir, International (Gmbh)", "Tibidu Gerulir"), ("Michael Smith Trading Co.", "Michael Smith")])
def test_company_is_no_person(piece, part):
    assert settled(piece, part, "person_name") is None


def test_phone_no_is_found():
    assert [f[3] for f in pii.finder(str(pii.MODEL)).find(["Phone No. 02-123-4567"])[0]] == ["phone"]
