"""Personal data: base spans against the plain patterns, the field against
enumeration, numeric gradients and planted mentions."""

import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabsieve.llm import pii_crf as P

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                    "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append((P.KINDS.index(kind), *m.span()))
    return sorted(out)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from([*"0159+.-@() ", "\n", "é", "٣", "a", "a@b.c", "1.2.3.4", "255.", "4111111111111111", "4111 1111-1111 1111",
                                 "+1 (499) 555-6503", "%", "00"]), max_size=24).map("".join))
def test_base_spans_are_those_of_the_plain_patterns(text):
    assert sorted(P.base_spans(text)[0]) == plain_spans(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "1." * 150_000, "a" * 300_000, "a@" * 150_000, "+1" * 150_000, "+1" + " " * 300_000, "1 " * 150_000, "-" * 300_000 + "1"):
        P.collect([text], [P.base_spans(text)])


def mentions(rng):
    """Documents with numbers of each kind between words and other numbers."""
    def one(kind):
        n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
        if kind == "email":
            return f"{rng.choice(['ann', 'bo', 'cy'])}.{n(2)}@mail{n(1)}.example.com"
        if kind == "ip":
            return ".".join(str(rng.randrange(10, 256)) for _ in range(4))
        if kind == "phone":
            return f"+1 ({rng.randrange(200, 999)}) 555-{n(4)}"
        body = "4" + n(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    out = []
    for _ in range(400):
        words = [rng.choice(["the", "of", "and", "2.", "1999", "v1.2", "x9"]) for _ in range(20)]
        for kind in P.KINDS:
            words[rng.randrange(20)] = one(kind)
        out.append(" and ".join(words))
    return out


@pytest.fixture(scope="module")
def texts():
    return mentions(random.Random(3))


@pytest.fixture(scope="module")
def field(texts):
    return P.learn(P.collect(texts, [P.base_spans(t) for t in texts]))


def added(field, *texts):
    bases = [P.base_spans(t) for t in texts]
    w = P.collect(list(texts), bases)
    return [[(P.KINDS[k], t[i:j]) for k, i, j in spans] for t, spans in zip(texts, P.added_spans(list(texts), w, P.marginals(field, w), bases))]


def test_what_a_failed_match_swallowed_is_found(field):
    found = added(field, "to +1 (269) 555-3296 4524132264652876 and", "so 4451718024887799 27.65.93.18 end")
    assert found[0] == [("card", "4524132264652876"), ("phone", "+1 (269) 555-3296")] or sorted(found[0]) == [
        ("card", "4524132264652876"), ("phone", "+1 (269) 555-3296")]
    assert ("card", "4451718024887799") in found[1] + [(P.KINDS[k], "so 4451718024887799 27.65.93.18 end"[i:j])
                                                       for k, i, j in P.base_spans("so 4451718024887799 27.65.93.18 end")[0]]


def test_repeated_mentions_follow_the_base_span(field):
    text = "call +1 (499) 555-6503 and later, far away, (499) 555-6503 again"
    assert added(field, text) == [[("phone", "(499) 555-6503")]]
    assert added(field, "later, far away, (499) 555-6503 again") == [[]]
    lone = P.Field(field.forms, field.steps, field.again * 0, field.alike * 0)
    seen, free = (P.marginals(f, P.collect([text], [P.base_spans(text)])) for f in (field, lone))
    assert seen[3:, P.LABELS.index("phone+")].min() > free[3:, P.LABELS.index("phone+")].min()


def test_clean_texts_stay_clean(field):
    assert added(field, "", "no number", "in 1999 and 2.0 at v1.2", "4111111111111112 x", "999.1.1.1 and 12.5", "@ a@ @b") == [[]] * 6


def test_held_out_documents(field):
    texts = mentions(random.Random(4))[:100]
    w = P.collect(texts, [P.base_spans(t) for t in texts])
    guess = P.marginals(field, w, observe=False).argmax(1)
    assert (guess == w.label)[w.label > 0].mean() > 0.97 and (guess == w.label)[w.label == 0].mean() > 0.97


def exact(f, w):
    """Marginals by enumeration of all labellings."""
    local, n = f.local(w), len(w.doc)
    total = np.zeros((n, P.N_LABELS))
    for y in itertools.product(range(P.N_LABELS), repeat=n):
        score = sum(local[i, y[i]] for i in range(n)) + sum(pot[y[a], y[b]] for at, to, pot in f.edges(w) for a, b in zip(at, to))
        for i in range(n):
            total[i, y[i]] += np.exp(score)
    return total / total.sum(1, keepdims=True)


@pytest.mark.parametrize("text", ["1 22 a 333", "1 a 22 a 1", "12345 x 123-45", "1 2 3 a 3", "a"])
def test_message_passing_is_exact_without_loops(text):
    rng = np.random.default_rng(5)
    f = P.Field(rng.normal(size=(1 << P.BITS, P.N_LABELS)), rng.normal(size=(P.N_LABELS, P.N_LABELS)), rng.normal(size=P.N_LABELS), rng.normal(size=P.N_LABELS))
    w = P.collect([text], [([], [])])
    assert np.abs(P.marginals(f, w) - (exact(f, w) if len(w.doc) else 0)).max(initial=0) < 1e-3


def test_gradient(texts):
    w = P.collect(texts[:20], [P.base_spans(t) for t in texts[:20]])
    rng = np.random.default_rng(6)
    f = P.Field(rng.normal(size=(1 << P.BITS, P.N_LABELS)), rng.normal(size=(P.N_LABELS, P.N_LABELS)), rng.normal(size=P.N_LABELS), rng.normal(size=P.N_LABELS))
    said = P.neighbours(w, w.label)
    _, g = P.gradient(f, w, said, 0.1)
    for name, at in (("forms", (int(w.forms[0, 1]), 1)), ("steps", (0, 2)), ("steps", (5, 6)), ("again", 0), ("alike", 3)):
        value, e = getattr(f, name), 1e-5
        value[at] += e
        up = P.gradient(f, w, said, 0.1)[0]
        value[at] -= 2 * e
        down = P.gradient(f, w, said, 0.1)[0]
        value[at] += e
        assert (up - down) / (2 * e) == pytest.approx(getattr(g, name)[at], rel=1e-4, abs=1e-4)


def test_table(make_docs, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (5, ""), (5, texts[5]), (900, texts[0] + " x" * 100_000 + " +1 (499) 555-6503")]
    df = make_docs(rows)
    found = {(r.doc_id, r.base): r for r in P.find(df, P.fit(df)).collect()}
    assert len(P.find(df, P.fit(df)).collect()) == len(rows)
    for d, t in rows:
        spans = plain_spans(t or "")
        r = found[d, P.spelt(spans)]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in spans) for i in range(4)]
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
    empty = make_docs([])
    assert P.find(empty, P.fit(empty)).collect() == []
