import numpy as np
import pytest

from ledgerloom.llm import pii, train_pii


@pytest.fixture(scope="module")
def found():
    finder = pii.finder(str(pii.MODEL))
    return lambda text: {(line, kind) for line, _, _, kind in finder.find([text])[0]}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Email: accounts10@tallowmere.test", {(1, "email")}),
        ("Call 085 221 3301 before unloading, ask for Henriette Vosinurel", {(1, "phone"), (1, "person_name")}),
        ("ok\nDriver richard sigumivi showed SSN: 907-54-1124 at the gate", {(2, "person_name"), (2, "id_number")}),
        ("Return unsold wall anchors to 498 Tonimasi Crescent", {(1, "street_address")}),
        ("VAT reg. 6415-156-1527 (company)", set()),
        ("Quote 9814-148-8204 when you pay", set()),
        ("2. Matilda sponge mix -  - gm 946", set()),
        ("Momefo and Vukutan Logistics Inc.", set()),
        ("Deliver to Charles Okonkwo, 45 Elm Street", {(1, "person_name"), (1, "street_address")}),
        ("gabago bifagax foods", set()),
        ("Meet Sarah Connor tomorrow", {(1, "person_name")}),
        ("5 Rue de Rivoli, Paris", {(1, "street_address")}),
        ("Invoice total 1,200.00 for Acme Trading Ltd", set()),
        ("TAX INVOICE\nAccount Statement\nขอบคุณค่ะ\nCurrency: PHP", set()),
        ("Page 8 of 24. Delivery window 3:00 - 8:30. All prices exclude freight.", set()),
    ],
)
def test_examples(found, text, want):
    assert found(text) == want


def test_odd_texts(found):
    assert found("") == set() and found("\n\n\r\n") == set()
    assert pii.finder(str(pii.MODEL)).find([None, ""]) == [[], []]
    filler = "keep dry, handle paper sacks with care, " * 1500
    assert {(1, "phone"), (1, "person_name")} <= found(filler + "Call 085 221 3301 before unloading, ask for Henriette Vosinurel, " + filler)
    found("x" * 50_000)


def test_vast_lines_are_read_one_by_one(found):
    filler = "keep dry, handle paper sacks with care, " * 5_000
    tagger = pii.finder(str(pii.MODEL)).tagger
    text = filler + "Call 085 221 3301 before unloading, ask for Henriette Vosinurel, " + filler
    assert {(1, "phone"), (1, "person_name")} <= found(text)
    rng = np.random.default_rng(2)
    scores = rng.normal(size=(60, 1, len(pii.TAGS))).astype(np.float32)
    assert tagger.best_path(scores[:, 0]).tolist() == tagger.best_paths(scores, np.array([60]))[0].tolist()


def test_placeholders_leave_the_rest():
    text = "a\nEmail: me@x.test and more\r\nb"
    spans = pii.finder(str(pii.MODEL)).find([text])[0]
    out = pii.redacted(text, spans)
    assert out == "a\nEmail: [EMAIL] and more\r\nb"
    assert pii.redacted(None, []) is None


def test_long_and_short_reading_agree():
    """A text within one window gives the same scores by windows as by itself."""
    tagger = pii.finder(str(pii.MODEL)).tagger
    ids = pii.codes("Call 085 221 3301 before unloading, ask for Henriette")
    whole = tagger.scores(ids[None, :])[:, 0]
    assert np.allclose(tagger.mixed([ids])[0], whole, atol=1e-4)


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    tagger = pii.finder(str(pii.MODEL)).tagger
    scores = rng.normal(size=(4, 1, len(pii.TAGS))).astype(np.float32)
    best, top = None, -np.inf
    for path in np.ndindex(*(len(pii.TAGS),) * 4):
        s = tagger.start[path[0]] + sum(scores[t, 0, k] for t, k in enumerate(path)) + sum(tagger.moves[a, b] for a, b in zip(path, path[1:], strict=False))
        if s > top:
            best, top = path, s
    assert tuple(tagger.best_paths(scores, np.array([4]))[0]) == best


def test_gradient_against_differences():
    model = train_pii.Trainer(3, 0)
    ids = np.array([[1, 2, 3, pii.FILL], [4, 5, 6, 7]])
    tags, lengths = np.array([[0, 1, 2, 0], [3, 4, 0, 0]]), np.array([3, 4])
    before = {k: v.copy() for k, v in model.p.items()}
    model.p = {k: v.astype(np.float64) for k, v in before.items()}
    for name in ("W", "A", "U0", "X1"):
        at = (2, 1)
        losses = []
        for d in (1e-2, -1e-2):
            trial = train_pii.Trainer(3, 0)
            trial.p = {k: v.astype(np.float64) for k, v in before.items()}
            trial.p[name][at] += d
            losses.append(trial.step(ids, tags, lengths, 0.0))
        trial = train_pii.Trainer(3, 0)
        trial.p = {k: v.astype(np.float64) for k, v in before.items()}
        trial.step(ids, tags, lengths, 0.0)
        slope = (losses[0] - losses[1]) / 2e-2
        # Adam's first moment is a tenth of the first gradient.
        assert abs(trial.m[name][at] * 10 - slope) < 5e-3 + 0.05 * abs(slope)


def test_frame(spark):
    rows = [(1, "Tel. 0955-937-2303", "z"), (1, "Tel. 0955-937-2303", "z"), (2, None, "z"), (3, "", "z")]
    frame = spark.createDataFrame(rows, "row_id bigint, text string, pii_type string").select("row_id", "text")
    assert [tuple(r) for r in pii.find_pii(frame, ["row_id"], "text").collect()] == [(1, 1, "phone")] * 2
    assert {tuple(r) for r in pii.redact(frame, ["row_id"], "text").collect()} == {(1, "Tel. [PHONE]"), (2, None), (3, "")}
    assert pii.find_pii(frame.limit(0), ["row_id"], "text").count() == 0


def test_held_out_accuracy(tiny):
    """On pieces of other tables than it was trained on, against the labelling grammar."""
    pieces = train_pii.pieces_of(tiny)
    with np.load(pii.MODEL) as f:
        counts = train_pii.report({k: f[k] for k in f.files}, pieces)
    for kind, (right, missed, wrong) in counts.items():
        assert right >= 0.9 * (right + missed), kind
        assert right >= 0.85 * (right + wrong), kind
