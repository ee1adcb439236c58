"""No finding stays in a redacted text: touched values, markup, and texts whose places were shifted by the view."""

from __future__ import annotations

import re

import pytest

from marlgate.llm import pii, spans

TOUCHED = [
    ("手机：010-55502546836860.BJ成交", ("phone", "010-55502546"), "手机：[PHONE]836860.BJ成交"),
    ("手机：100-0439-00562022.09.09的权重", ("phone", "100-0439-0056"), "手机：[PHONE]2022.09.09的权重"),
    ("新邮箱：aldan77@firm.example2021-07-15的权重", ("email", "aldan77@firm.example"), "新邮箱：[EMAIL]2021-07-15的权重"),
    ("手机：+44 20\r\n> > 7946\r\n> >| 014120230420的权重", ("phone", "+44 20 7946 0141"), "手机：[PHONE]20230420的权重"),
]


@pytest.mark.parametrize(("text", "finding", "clean"), TOUCHED)
def test_touched_values_are_replaced(text, finding, clean):
    lexicon, model = pii.training_lexicon(), pii.trained_field()
    assert pii.findings(text, lexicon, model) == [finding]
    assert pii.clean_text(text, lexicon, model) == (clean, 1)


@pytest.mark.parametrize("broken", ["+44 20</p>\r\n<p>7946 0101", "+44 20 79<b>46</b> 0101", "+44 <i>20</i> <i>7946</i> 0101", "+44 20 7946 0101"])
def test_markup_hides_no_finding(broken):
    text = f"Call me on +44 20 7946 0101.\r\n\r\n<html><p>Call me on {broken}.</p></html>\r\n"
    clean, n = pii.clean_text(text, pii.training_lexicon(), pii.trained_field())
    assert n == 1 and clean == "Call me on [PHONE].\r\n\r\n<html><p>Call me on [PHONE].</p></html>\r\n"


def test_longer_numbers_and_words_are_left():
    text = "Call me on 020 7946 0101. Row 020 7946 01015, Xaldan@firm.test and aldan@firm.test"
    assert pii.redacted(text, [("phone", "020 7946 0101"), ("email", "aldan@firm.test")]) == "Call me on [PHONE]. Row 020 7946 01015, Xaldan@firm.test and [EMAIL]"


def test_places_are_those_of_the_original():
    text = "\r\n > Received: from a\r\n b\r\n=?utf-8?Q?x?= <p>Talk to  Molis\r\n> | Wintfield</p>\r\n<br>at 12 Elder Mill Road"
    steps: list = []
    flat = spans.view(text, steps)
    assert flat == spans.view(text)
    for word in ("Molis Wintfield", "12 Elder Mill Road"):
        s = flat.index(word)
        assert re.sub(r"[\s>|]+", " ", text[spans.origin(steps, s) : spans.origin(steps, s + len(word) - 1) + 1]) == word


def test_no_finding_stays_in_the_test_mails(spark, data):
    from marlgate.sources.testbed import table

    documents, names = table(spark, data, "documents"), table(spark, data, "known_names")
    clean = {r["doc_id"]: r["clean_text"] for r in pii.redact_personal(documents, names).collect()}
    found = pii.find_personal(documents, names).collect()
    for drop in ("", " "):
        flat = {k: re.sub(r"[\s>|]+", " ", spans.MARKUP.sub(drop, t)) for k, t in clean.items() if t}
        assert found and not [r for r in found if r["found_text"] in flat[r["doc_id"]]]
