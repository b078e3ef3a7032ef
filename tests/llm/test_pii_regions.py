"""What the field of op1 sees of a text."""

import time

import pytest

from pramana.llm import pii


def test_field_sees_values_without_digits_and_long_ones():
    """Addresses and secrets without a digit, and values that reach far from their digits; ordinary words after a cue stay."""
    w = pii.fit()
    long = "key: " + "ab" * 30 + "7" + "c" * 30 + " end"
    for text, value, kind in (
        ("mail jane (at) mail (dot) com now", "jane (at) mail (dot) com", 0),
        ("write to jane.doe [at] mail [dot] org today", "jane.doe [at] mail [dot] org", 0),
        ("set password=swordfishes and go", "swordfishes", 4),
        ('login token = "abcXYZkjdiQRSa" ok', "abcXYZkjdiQRSa", 4),
        (long, long[5:-4], 4),
    ):
        assert [(text[a:b], k) for a, k, b in pii.spans(text, w)[1]] == [(value, kind)]
    for text in ("the secret of the garden", "a key point: the token was lost", "password: required field", "no value here (at) all"):
        assert not pii.spans(text, w)[1]


def test_regions_lose_nothing(texts):
    """The field over the regions of a text finds what it finds over the whole text."""
    w = pii.fit()
    made = [" ".join(t for t, _ in pii._examples(12, seed=k)) for k in range(8)]
    for t in made + [t for _, t in texts[:25]]:
        assert [s for a, b in pii.regions(t) for s in pii.decode(t, w, a, b)] == pii.decode(t, w)


@pytest.mark.parametrize("blob", ["a1" * 500_000, "deadbeef01" * 100_000, "x" * 1_000_000 + "7", "1 " * 30_000, "é7" * 300_000])
def test_long_tokens_take_time_in_proportion(blob):
    """A blob of a megabyte in one token, beside values that are found as ever."""
    w = pii.fit()
    began = time.process_time()
    base, found = pii.spans(f"mail a.b@c.org {blob} or call +1 202 555 0123 now", w)
    assert [k for _, k, _ in base] == [0, 3] and set(base) <= set(found)
    assert time.process_time() - began < 20


def test_spans_of_the_field_keep_clear_of_overlapping_patterns():
    w = pii.fit()
    for text in ("call +1 4111 1111 1111 1111 now", "ip 1.2.3.4@5.6.7.8 x", "card 4111-1111-1111-1111, a@b.c"):
        base, found = pii.spans(text, w)
        assert set(base) <= set(found)
        assert all(b <= p or a >= q for a, _, b in set(found) - set(base) for p, _, q in base)


def test_memo_is_bounded_and_changes_nothing(monkeypatch):
    w, text = pii.fit(), " and ".join(t for t, _ in pii._examples(40, seed=9))
    want = pii.spans(text, w)
    monkeypatch.setattr(pii, "MEMO", 200)
    memo = pii.Memo()
    assert pii.spans(text, w, memo) == want and memo.held <= 200
