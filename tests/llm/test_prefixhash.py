import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from parlance.llm import prefixhash as P
from parlance.llm.catalog import queries

SHAPE = "doc_id bigint, text string"
POWERS = P.Powers()


def hashed(text):
    return P.PrefixHash(text, POWERS)


def by_hand(span):
    out = 0
    for p, b in zip(P.PRIMES, P.BASES):
        out = out << 31 | sum((ord(c) + 1) * pow(b, i, p) for i, c in enumerate(span)) % p
    return out


def some_text(rnd, n, letters="ab é😀\n"):
    return "".join(rnd.choice(letters) for _ in range(n))


def test_spans_by_hand():
    rnd = random.Random(1)
    for n in (0, 1, 5, 300):
        t = some_text(rnd, n)
        h = hashed(t)
        assert h.whole() == by_hand(t)
        at = np.array([rnd.randrange(n + 1) for _ in range(40)])
        length = np.array([rnd.randrange(n - a + 1) for a in at])
        assert h.spans(at, length).tolist() == [by_hand(t[a:a + k]) for a, k in zip(at, length)]
        if n > 4:
            assert h.every(4, 1, n - 3).tolist() == [by_hand(t[i:i + 4]) for i in range(1, n - 3)]


def test_arrays_beyond_one_run_and_from_a_head():
    rnd = random.Random(2)
    t = some_text(rnd, 3 * P.RUN + 5)
    h = hashed(t)
    for at, k in ((P.RUN - 2, 5), (3 * P.RUN, 5), (7, 40)):
        assert h.spans(np.array([at]), k)[0] == by_hand(t[at:at + k])
    new = t[:P.RUN + 3] + "xyz"
    same = P.PrefixHash(new, POWERS, h, P.RUN + 3)
    assert all((a == b).all() for a, b in zip(same.sums, hashed(new).sums))


def test_common_extensions_by_hand():
    rnd = random.Random(3)
    for _ in range(20):
        a, b = some_text(rnd, 200, "ab"), some_text(rnd, 150, "ab")
        b = b[:40] + a[30:90] + b[40:]
        i, j = np.array([rnd.randrange(201) for _ in range(50)] + [30]), np.array([rnd.randrange(len(b) + 1) for _ in range(50)] + [40])

        def extension(x, y):
            n = 0
            while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                n += 1
            return n

        assert P.common_extension(hashed(a), i, hashed(b), j).tolist() == [extension(x, y) for x, y in zip(i, j)]


def test_extensions_from_none_to_whole_texts():
    a = "ab" * 40
    for n in range(81):
        b = a[:n] + "x" * (80 - n)
        assert P.common_extension(hashed(a), [0, 0], hashed(b), [0, 80]).tolist() == [n, 0]


def test_an_edited_text_hashes_only_its_new_spans(monkeypatch):
    rnd = random.Random(6)
    text, following = some_text(rnd, 3000), some_text(rnd, 900)
    asked, every = [], P.PrefixHash.every
    monkeypatch.setattr(P.PrefixHash, "every", lambda self, k, at, to: asked.append(to - at) or every(self, k, at, to))
    texts = P._Texts()
    own = texts.hashed(text)
    mark = P.fingerprint(own)
    assert sum(asked) == 3000 - P.LONG + 1
    asked.clear()
    assert texts.row(1, text, own, mark, following, mark)[4] == P.fingerprint(hashed(text[:2000] + following))
    # Those that begin in the last LONG - 1 kept code points or later; the rest is what the assertion itself hashes.
    assert sum(asked) == 900 + 2900 - P.LONG + 1


def test_spans_of_a_head_are_those_of_the_text():
    rnd = random.Random(7)
    for n, shared in ((5, 3), (15, 15), (16, 16), (17, 16), (40, 15), (40, 16), (400, 267), (3 * P.RUN, P.RUN + 9)):
        t = some_text(rnd, n)
        new = t[:shared] + some_text(rnd, rnd.randrange(60))
        found = P.PrefixHash(new, POWERS, hashed(t), shared).long_spans
        assert found.tolist() == hashed(new).long_spans.tolist() == P.mixed(hashed(new), P.LONG).tolist()


def test_texts_hashed_together_are_as_alone():
    rnd = random.Random(9)
    texts = [some_text(rnd, n) for n in (0, 1, 15, 16, 17, 0, 255, 256, 3000, 2 * P.RUN + 7, 40)] + ["", "\udc80x"]
    for t, part in zip(texts, P.hashed_together(texts, POWERS), strict=True):
        alone = hashed(t)
        assert P.fingerprint(part) == P.fingerprint(alone) and part.long_spans.tolist() == alone.long_spans.tolist()
        at = np.arange(0, len(t), 97)
        assert part.spans(at, len(t) - at).tolist() == alone.spans(at, len(t) - at).tolist()
        assert P.common_extension(part, [0], alone, [0]).tolist() == [len(t)]
        # A text that continues a part of another.
        new = t[:len(t) // 2] + "new end"
        assert P.fingerprint(P.PrefixHash(new, POWERS, part, len(t) // 2)) == P.fingerprint(hashed(new))
    assert P.hashed_together([], POWERS) == []


def test_many_rows_take_no_more_array_steps_than_one(monkeypatch):
    rnd = random.Random(10)
    texts = [some_text(rnd, 30 + i) for i in range(300)]
    every, asked = P.PrefixHash.every, []
    monkeypatch.setattr(P.PrefixHash, "every", lambda self, *a: asked.append(a[0]) or every(self, *a))
    task = P._Texts()
    known = [(t, own, P.fingerprint(own)) for t, own in zip(texts, P.hashed_together(texts, task.powers))]
    asked.clear()
    rows = task.rows([(i, *known[i], known[i + 1][0], known[i + 1][2]) for i in range(299)])
    # One step for all; small texts need their short spans, too.
    assert asked.count(P.LONG) == 1 and len(asked) < 300
    monkeypatch.undo()
    for i, row in enumerate(rows):
        new, _ = P.edited(texts[i], texts[i + 1])
        marks = [P.fingerprint(hashed(t)) for t in (texts[i], new, texts[i + 1])]
        assert row[3:7] == (*marks[:2], P.likeness(*marks[:2]), P.likeness(*marks[::2]))


def test_least_hashes_where_spans_repeat():
    rnd = random.Random(8)
    for t in ("", "a", "ab" * 5000, "x" * 300, some_text(rnd, 5000), some_text(rnd, 60) * 100):
        spans = P.mixed(hashed(t), P.LONG).tolist()
        assert P._least(P.mixed(hashed(t), P.LONG)) == sorted(set(spans))[:P.KEPT]


def all_spans(text):
    return {text[i:i + P.LONG] for i in range(len(text) - P.LONG + 1)}


def test_likeness_is_the_share_of_common_spans():
    rnd = random.Random(4)
    words = [some_text(rnd, 7, "abcdefghij") for _ in range(3000)]
    gaps = []
    for share in (0.0, 0.3, 0.6, 0.9):
        for _ in range(30):
            a = " ".join(rnd.choices(words, k=300))
            cut = int(len(a) * share)
            b = a[:cut] + " ".join(rnd.choices(words, k=300))[cut:]
            x, y = all_spans(a), all_spans(b)
            true = 2 * len(x & y) / (len(x) + len(y))
            gaps.append(P.likeness(P.fingerprint(hashed(a)), P.fingerprint(hashed(b))) - true)
    assert abs(np.mean(gaps)) < 0.03 and np.abs(gaps).max() < 0.35


def test_likeness_of_small_texts():
    mark = lambda t: P.fingerprint(hashed(t))
    assert P.likeness(mark(""), mark("")) == 1.0 == P.likeness(mark("one two"), mark("one two"))
    assert P.likeness(mark(""), mark("one")) == 0.0
    assert P.likeness(mark("ab"), mark("ac")) == 0.0
    # All spans are listed, so the share is exact: 12 and 11 different ones of 4 code points, 7 in common.
    assert P.likeness(mark("abcdefghijklmno"), mark("abcdefghijXXXXX")) == pytest.approx(2 * 7 / (12 + 11))
    assert 0 < P.likeness(mark("x" * 30 + "abc"), mark("x" * 300)) <= 1


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()), reverse=True)
    texts = [r[1] or "" for r in order]
    marks = {t: P.fingerprint(hashed(t)) for t in texts}
    out = Counter()
    for (doc, _), text, after in zip(order, texts, texts[1:] + texts[:1]):
        m = len(text) // 3
        new = text[:len(text) - m] + after[:m]
        mark = P.fingerprint(hashed(new))
        agree = next((i for i, (x, y) in enumerate(zip(text, new)) if x != y), min(len(text), len(new)))
        out[(doc, len(text), hashlib.sha256(new.encode()).hexdigest(), marks[text], mark,
             P.likeness(marks[text], mark), P.likeness(marks[text], marks[after]), agree)] += 1
    return out


def got(df):
    return Counter(tuple(r[n] for n in P._NAMES) for r in df.collect())


def test_rows_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, some_text(rnd, rnd.randrange(400))) for i in range(300)]
    rows += [(None, None), (None, "two words"), (None, "two words"), (7, "another seven"), (8, ""), (9, None)] + [(10, "same")] * 40
    rows += [(11, some_text(rnd, 300_000))]
    rnd.shuffle(rows)
    assert got(P.edited_fingerprints(spark.createDataFrame(rows, SHAPE).repartition(5))) == expected(rows)


@pytest.mark.parametrize("rows", [[], [(1, "alone here")], [(None, None)], [(1, "a"), (2, "b")]])
def test_few_rows(spark, rows):
    assert got(P.edited_fingerprints(spark.createDataFrame(rows, SHAPE))) == expected(rows)


def test_other_keys_and_clashing_columns(spark):
    df = spark.createDataFrame([("b", "first text", 1), ("a", "second text", 2)], "name string, doc_id string, part int")
    out = {r["doc_id"]: r for r in P.edited_fingerprints(df, "name", "doc_id").collect()}
    assert out["b"]["edited_sha256"] == hashlib.sha256(b"first tsec").hexdigest() and out["a"]["n_chars"] == 11


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = got(queries()["op13_prefix_polynomial_hashes"](spark, sf))
    assert found == expected(rows)
    near = [(r[5], r[6]) for r in found]
    assert np.mean([e > n for e, n in near]) > 0.9
