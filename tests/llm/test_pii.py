"""Personal data: the base patterns against plain expressions, and what the field adds."""

import hashlib
import random
import re

import numpy as np

from brindle.llm.pii import KINDS, LINKS, PRIOR, base_spans, find, fit, graph, joined, luhn, marginals, op1_find_pii

SCHEMA = "doc_id long, text string, lang string, source string, id string, base string, spans int, x int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, None, "i", "b", 1, 2) for i, t in rows], SCHEMA)


def plain_spans(t):
    digits = lambda x: re.sub("[^0-9]", "", x)
    return [
        [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(v) <= 255 for v in m[0].split("."))],
        [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15],
    ]


def test_base_patterns():
    rng = random.Random(4)
    for _ in range(30_000):
        t = "".join(rng.choice("1234567890@.+-() ab%é") for _ in range(rng.randint(0, 40)))
        assert base_spans(t) == plain_spans(t)


def test_long_runs_take_linear_time():
    for t in ("a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+1" * 100_000, "1 " * 100_000, "a@" * 100_000, "." * 200_000 + "@b"):
        base_spans(t)
        graph(t, base_spans(t))


def test_the_field_agrees_across_a_document(spark):
    t = "Call +1 (663) 555-6869 now. Later 663-555-6869, or (663) 555-6869. Unlike 123456789 or 20231011. Cards 4465758382889437 4465758382889437."
    rows = [(1, t), (2, None), (3, ""), (None, "order 2023-10-11 12:33:44, part 123456789, v1.2.3.4567, not a card 2123465659789240"), (1, t)]
    found = find(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    by = {x["id"]: x for x in found}
    spans = [(k, t[int(a) : int(b)]) for k, a, b in (x.split(":") for x in by[1]["spans"].split(","))]
    assert spans == [("card", "4465758382889437")] * 2 + [("phone", "+1 (663) 555-6869"), ("phone", "663-555-6869"), ("phone", "(663) 555-6869")]
    assert by[1]["base"] == "phone:5:22" and by[1]["n_phone"] == 1 and by[1]["n_added"] == 4
    assert [by[i]["spans"] for i in (2, 3, None)] == ["", "", ""]


def test_belief_propagation_is_exact_on_trees():
    rng = np.random.default_rng(1)
    x, links = rng.integers(0, 2, (4, len(PRIOR))).astype(float), np.array([[1, 0, 1], [0, 1, 2], [1, 1, 3]])
    found = marginals(x, np.zeros(4, int), links, PRIOR * 0.3, LINKS, rounds=200)
    own, total = x @ (PRIOR * 0.3), np.zeros((4, 5))
    for labels in np.ndindex(5, 5, 5, 5):
        p = np.exp(sum(own[i, k] for i, k in enumerate(labels)) + sum(LINKS[t, labels[i], labels[j]] for t, i, j in links))
        for i, k in enumerate(labels):
            total[i, k] += p
    assert np.allclose(found, total / total.sum(axis=1, keepdims=True), atol=1e-3)


def people(rng, n):
    """Documents with personal data that the patterns see once and then not, and with other numbers: (id, text, true spans)."""
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card():
        own = rng.choice("345") + digits(14)
        return next(own + c for c in "0123456789" if luhn(own + c))

    rows = []
    for i in range(n):
        text, spans = "", set()

        def say(before, value=None, kind=None):
            nonlocal text
            text += before
            if value:
                if kind:
                    spans.add((kind, len(text), len(text) + len(value)))
                text += value

        phone, mail = (digits(3), digits(3), digits(4)), f"anna{digits(3)}.berg@mail{digits(1)}.example.org"
        say("Call ", f"+1 ({phone[0]}) {phone[1]}-{phone[2]}", "phone")
        for form in rng.sample(["{}-{}-{}", "({}) {}-{}", "{} {} {}", "{}.{}.{}"], rng.randint(0, 3)):
            say(rng.choice([", later ", " or, at night, "]), form.format(*phone), "phone")
        if i % 2:
            say(". Write to ", mail, "email")
            say(" (or ", mail.replace("@", rng.choice([" [at] ", "(at)"])), "email")
            say("), paid with ", card(), "card")
        for _ in range(rng.randint(0, 3)):
            say(rng.choice([", order ", ", on ", ", version ", ", part no "]), rng.choice([digits(8), "2023-10-11 12:33", "1.2.3", digits(12), digits(16), "1234567", digits(22)]))
        rows.append((i, text + ".", spans))
    return rows


def test_added_spans_are_right(spark):
    """Precision and recall of what the field adds to the patterns, on documents whose true spans are known."""
    rows = people(random.Random(7), 400)
    found = {x["id"]: x["spans"] for x in find(documents(spark, [r[:2] for r in rows])).collect()}
    right = wrong = missed = 0
    for i, text, spans in rows:
        base = {(KINDS[k], a, b) for k, own in enumerate(base_spans(text)) for a, b in own}
        added = {(k, int(a), int(b)) for k, a, b in (x.split(":") for x in filter(None, found[i].split(",")))} - base
        true = {s for s in spans if not any(k == s[0] and a < s[2] and b > s[1] for k, a, b in base)}
        right, wrong, missed = right + len(added & true), wrong + len(added - true), missed + len(true - added)
    print(f"precision {right / (right + wrong):.3f}, recall {right / (right + missed):.3f} of {right + missed}")
    assert right + missed > 300 and right > 0.9 * (right + wrong) and right > 0.9 * (right + missed)


def test_documents_dont_depend_on_each_other(spark):
    docs = documents(spark, [r[:2] for r in people(random.Random(9), 150)])
    first = sorted(map(tuple, find(docs).collect()))
    assert first == sorted(map(tuple, find(docs.repartition(5)).collect())) == sorted(map(tuple, find(docs.coalesce(1)).collect()))


def test_addresses_of_any_length(spark):
    name, host = "x" * 500, ".".join(["sub"] * 200) + ".example"
    t = f"mail {name}@{host}. And {name} [at] {host}, then a@ @b @@ (at) x(at)y.z"
    found = find(documents(spark, [(1, t)])).collect()[0]
    spans = [t[int(a) : int(b)] for k, a, b in (x.split(":") for x in found["spans"].split(","))]
    assert f"{name}@{host}" in spans and f"{name} [at] {host}" in spans


def test_fit_without_rows():
    weights, pairs = fit(np.empty((0, len(PRIOR))), np.empty(0, int), np.empty((0, 3), int))
    assert (weights == PRIOR).all() and (pairs == LINKS).all()


def test_empty_table(spark):
    assert find(documents(spark, [])).collect() == []


def test_query(spark, sf_dir):
    docs = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    found = op1_find_pii(spark, sf_dir).collect()
    assert sorted(x["doc_id"] for x in found) == sorted(docs)
    for x in found:
        base = plain_spans(docs[x["doc_id"]])
        assert [x[f"n_{k}"] for k in KINDS] == [len(s) for s in base]
        text = joined((k, a, b) for k, own in enumerate(base) for a, b in own)
        assert x["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(x["spans"].split(","))
