"""Personal data: fixed forms against plain regular expressions, beliefs against a brute-force graph, planted identifiers."""

import hashlib
import math
import random
import re
import time
from collections import defaultdict

import pytest

from trajlens.llm import contextual_pii as pii

SCHEMA = "doc_id long, text string, id int, row int, base string, sights string, n_email int"
FORMS = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def plain_spans(text):
    def holds(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == 1:
            return all(int(part) <= 255 for part in found.split("."))
        if kind == 2:
            doubled = sum(sum(divmod(int(d) * (1 + n % 2), 10)) for n, d in enumerate(digits[::-1]))
            return 12 <= len(digits) <= 19 and doubled % 10 == 0
        return kind == 0 or 9 <= len(digits) <= 15

    return sorted((m.start(), kind, m.end()) for kind, form in enumerate(FORMS) for m in form.finditer(text) if holds(kind, m.group()))


def test_fixed_forms_against_plain_expressions():
    draw = random.Random(4)
    signs = ["1", "0", "7", "255", "300", ".", ".", "@", "a", "é", "+", " ", "-", "(", ")", "x.y", "4111 1111 1111 1111", "@b.c", "+1 (743) 555-3824"]
    found = 0
    for _ in range(20_000):
        text = "".join(draw.choice(signs) for _ in range(draw.randrange(1, 14)))
        assert pii.base_spans(text) == plain_spans(text), text
        found += len(plain_spans(text))
    assert found > 5000


@pytest.mark.parametrize("sign", ["a", "1", "1 ", "1.", "+", "+1 ", "@", "a@", "a@b", "1.2", "(", ":", "1:", "ab1", "1@"])
def test_long_texts_take_linear_time(sign):
    start = time.perf_counter()
    pii.scan_text(sign * (400_000 // len(sign)) + "x")
    assert time.perf_counter() - start < 8


def brute_beliefs(texts, support=3, pattern_trust=0.7, belief=0.9):
    edges = {(s["instance"], s["seed"], tuple(s["kinds"]), p) for text in texts for s in pii.scan_text(text)[1] for p in s["patterns"]}
    known: dict[str, int] = {}
    while True:
        trust = {}
        by_pattern = defaultdict(list)
        for edge in edges:
            by_pattern[edge[3]].append(edge)
        for pattern, group in by_pattern.items():
            for kind in range(4):
                count = sum(seed == kind or (seed is None and known.get(instance) == kind) for instance, seed, _, _ in group)
                if count >= support and count / (len(group) + 1) >= pattern_trust:
                    trust[pattern, kind] = count / (len(group) + 1)
        doubt = defaultdict(float)
        for instance, seed, kinds, pattern in edges:
            for kind in kinds if seed is None else ():
                if (pattern, kind) in trust:
                    doubt[instance, kind] += math.log(1 - trust[pattern, kind])
        found = {}
        for (instance, kind), value in sorted(doubt.items(), key=lambda x: (x[0][0], x[1], x[0][1])):
            if 1 - math.exp(value) >= belief and instance not in found:
                found[instance] = kind
        if len(found) == len(known):
            return found
        known = found


def planted():
    draw = random.Random(9)
    texts = [None, "", "nothing here", " \n", "x" * 3000]
    for n in range(40):
        texts.append(f"Please call me at +1 (743) 555-{1000 + n} before noon, order {10000 + n} is late. é")
        texts.append(f"Server reached from host {draw.randrange(256)}.1.2.{n} today; mail to user{n}@example.com now")
    texts += ["Please call me at 743 555 7777 before noon", "ask Ann: ring home line 743 555 7777 again", "mail to zoë@bücher.example now"]
    texts += ["order 1234567 is late", "in 2024-05-06 11 we met", "built version 10.2.3 on 20240506 with 1234567890"] * 3
    return texts


def test_unseen_identifiers_are_found_and_others_left(spark):
    texts = planted()
    docs = spark.createDataFrame([(n, text, 1, 1, "x", "x", 1) for n, text in enumerate(texts)], SCHEMA)
    rows = {row["doc_id"]: row for row in pii.digests(pii.personal_data(docs)).collect()}
    assert len(rows) == len(texts)
    known = brute_beliefs([text for text in texts if text])
    assert known
    for n, text in enumerate(texts):
        base, sights = pii.scan_text(text)
        spans = plain_spans(text or "")
        added = [(s["start"], known[s["instance"]], s["end"]) for s in sights if s["seed"] is None and s["instance"] in known]
        line = [",".join(f"{pii.KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(group)) for group in (spans, spans + added)]
        row = rows[n]
        assert (row["base_sha256"], row["spans"]) == (hashlib.sha256(line[0].encode()).hexdigest(), line[1])
        assert [row[f"n_{kind}"] for kind in pii.KINDS] == [sum(span[1] == kind for span in spans) for kind in range(4)]
        assert row["n_found"] == len(added)
    at = len(texts) - 12
    # The same number is found again where its context says nothing.
    assert rows[at]["spans"] == "phone:18:30" and rows[at + 1]["spans"] == "phone:24:36" and rows[at + 2]["spans"].startswith("email:8:")
    assert all(rows[n]["spans"] == "" for n in range(at + 3, len(texts)))


def test_repeated_ids_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a@b.c", 1, 1, "x", "x", 1)] * 2 + [(None, None, 1, 1, "x", "x", 1)], SCHEMA)
    rows = [tuple(row)[:5] for row in pii.digests(pii.personal_data(docs)).collect()]
    assert sorted(rows, key=str) == [(1, 1, 0, 0, 0), (1, 1, 0, 0, 0), (None, 0, 0, 0, 0)]
    assert pii.digests(pii.personal_data(docs.limit(0))).count() == 0
