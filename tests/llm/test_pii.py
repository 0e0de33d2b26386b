import random
import re
import time

from tessera.llm.pii import _examples, _segments, base_matches, find_pii, find_spans, luhn, mask, mask_pii, runs, train


def plain(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]


def test_base_rules_equal_plain_patterns():
    r = random.Random(1)
    for _ in range(5000):
        t = "".join(r.choice("0123456789. -+@a.(b)%é") for _ in range(r.randint(1, 60)))
        assert base_matches(t) == plain(t), t
    assert base_matches("9" * 200_000) == []


def test_long_runs_and_other_digits_are_only_not_matches():
    model = train()
    assert base_matches("0" * 5000 + ".1.1.1") == [("ip", 0, 5006)] and base_matches("1" * 5000 + ".1.1.1") == []
    for t in ("10.20.30.²", "٣٤٥٦.1.1.1", "１２３４ 5678", "+٤٤ 20 7946 0958", "1" * 100_000, "1." * 20_000, "@" * 50_000, "1 2 " * 20_000):
        assert [x[:3] for x in find_spans(t, model) if x[3]] == base_matches(t)
    r = random.Random(8)
    for _ in range(1500):
        t = "".join(r.choice("0123456789.²٣１ -+@a(b)%é\u200d\n") for _ in range(r.randint(1, 60)))
        assert [x[:3] for x in find_spans(t, model) if x[3]] == plain(t), t


def test_many_spans_take_time_in_proportion():
    began = time.time()
    assert len(find_spans("ab.c@de.fg and 555-123-9876, " * 10_000, train())) >= 10_000
    assert time.time() - began < 30


def best_by_enumeration(model, text, run):
    """The best total over all ways to lay candidate segments on the run without overlap, outside tokens in between."""
    bounds, segments = _segments(text, *run)
    n, outside = len(bounds) - 1, model.weights.get(("O", "token"), 0.0)
    scored = model.scores(segments)

    def best(at):
        if at == n:
            return 0.0
        return max([outside + best(at + 1), *(x[3] + best(x[1]) for x in scored if x[0] == at)])

    return best(0), bounds, {(k, bounds[i], bounds[j]): (s, j - i) for i, j, k, s, _ in scored}


def test_decoder_finds_the_best_of_all_segmentations():
    model, seen = train(), 0
    for text, _ in _examples(5, 150):
        for run in runs(text):
            if len(text[run[0] : run[1]]) > 24:
                continue
            want, bounds, scores = best_by_enumeration(model, text, run)
            chosen = model.decode(text, *run)
            total = sum(scores[x][0] for x in chosen) + model.weights["O", "token"] * (len(bounds) - 1 - sum(scores[x][1] for x in chosen))
            assert all(a[2] <= b[1] for a, b in zip(chosen, chosen[1:])) and abs(total - want) < 1e-9
            seen += 1
    assert seen > 50


def test_field_on_held_out_lines():
    model, right, wrong, missed = train(), 0, 0, 0
    for text, gold in _examples(99, 200):
        got = {x for run in runs(text) for x in model.decode(text, *run)}
        right, wrong, missed = right + len(got & gold), wrong + len(got - gold), missed + len(gold - got)
    assert right / (right + wrong) > 0.8 and right / (right + missed) > 0.8


def test_added_spans_leave_base_spans_alone():
    text = "mail a.b@c.de or call (555) 123-4567 and 555-123-9876 from 10.0.0.1 on 2024-10-11"
    spans = find_spans(text, train())
    assert [x[:3] for x in spans if x[3]] == base_matches(text)
    base = [(a, b) for _, a, b, s in spans if s]
    assert all(not (a < e and s < b) for _, a, b, own in spans if not own for s, e in base)
    assert "a.b@c.de" not in mask(text, spans) and "10.0.0.1" not in mask(text, spans)


def test_odd_rows_and_empty_tables(odd_docs, no_docs):
    assert find_pii(odd_docs).count() == 9 and find_pii(no_docs).count() == 0
    masked = mask_pii(odd_docs)
    assert masked.columns == odd_docs.columns and masked.count() == 9
    assert {(r.doc_id, r.text) for r in masked.collect() if r.doc_id in (1, 2)} == {(1, None), (2, "")}
