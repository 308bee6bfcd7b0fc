import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from modesift.llm import op2_pii

BRUTE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def valid(kind, m):
    digits = re.sub(r"[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    return True


def brute(text):
    spans = [(k, m.start(), m.end()) for k, p in BRUTE.items() for m in re.finditer(p, text or "") if valid(k, m.group())]
    spans.sort(key=lambda s: (s[1], list(BRUTE).index(s[0])))
    return spans, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


TEXTS = [
    None, "", "plain", "a@b.c_d@e.f x", "éé a.b@c.d, 1.2.3.4.5.6.7.8 999.1.1.1 0255.0.0.1",
    "4539 1488 0343 6467 and 4539148803436467 4539148803436468", "1-2 3-4 5-6 7-8 9-0 1-2 3-4 5 6",
    "+1 (988) 555-2485 +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 +49.30.1234567890", "😀 x@y.zz 😀 10.0.0.1", "@.@ a@ @b.c a@b a@b. a@b.c.", "9" * 5000, "a" * 20000 + "@b.c", "1" * 14 + "." + "1.1.1",
    "00000000000000 000000000000000000000", "1.1.1.1" * 50,
]


def test_base_spans_match_brute_force(spark):
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS)] + [(1, TEXTS[8], "copy"), (None, TEXTS[8], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, term string")
    out = op2_pii.find(df).select("doc_id", "text", *(f"pii__{k}" for k in BRUTE)).collect()
    assert len(out) == len(rows)
    for r in out:
        got = {(s.kind, s.start, s.end) for k in BRUTE for s in r[f"pii__{k}"]}
        assert got == set(brute(r.text)[0]), r.text


def test_query_on_data(spark):
    out = {r.doc_id: r for r in op2_pii.query(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs:
        spans, digest = brute(d.text)
        assert out[d.doc_id].base_sha256 == digest
        assert out[d.doc_id].n_email == sum(s[0] == "email" for s in spans)


def corpus():
    """'wattle' only occurs beside e-mail addresses; 'fern' beside one address in many copies."""
    rows = []
    for i in range(300):
        mail = f"user{i}@host.org wattle" if i % 10 == 0 else "nothing here"
        rows.append((i, f"common words {mail} tail{'x' * (i % 3)}"))
    rows += [(1000 + i, f"same@host.org fern copy {'y' * i}") for i in range(60)]
    return rows


def test_terms_are_judged_by_entities_not_copies(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    out = {r.doc_id: r for r in op2_pii.find(df, generalise=0.5, remove=0.99).collect()}
    spans = [(s.kind, s.start, s.end) for s in out[0].pii__terms]
    assert [out[0].text[a:b] for _, a, b in spans] == ["wattle"]
    assert not out[1000].pii__terms
    clean = {r.doc_id: r.text for r in op2_pii.sanitise(df, generalise=0.5, remove=0.99).collect()}
    assert clean[0] == "common words [EMAIL] [TERM] tail"
    assert clean[1] == "common words nothing here tailx"
    gone = {r.doc_id: r.text for r in op2_pii.sanitise(df, generalise=0.5, remove=0.5).collect()}
    assert gone[0] == "common words [EMAIL]  tail"


def test_a_term_beside_one_entity(spark):
    """'weaver' always stands beside one person's address, in eight texts of different words."""
    words = [f"{chr(97 + a)}{chr(97 + b)}{chr(97 + c)}" for a in range(12) for b in range(12) for c in range(12)]
    say = lambda k: " ".join(words[(k * 101 + j * 37) % len(words)] for j in range(8))
    rows = [(i, f"plain text to write {say(i)}") for i in range(400)]
    rows += [(1000 + i, f"{say(500 + i)} plain weaver pw@host.org") for i in range(8)]
    rows += [(2000 + i, f"write to other{i}@host.org {say(700 + i)} plain") for i in range(100)]
    rows += [(3000 + i, f"copy@host.org rowan {say(900)} {say(900)[:3]}{'z' * i}") for i in range(40)]
    out = {r.doc_id: r for r in op2_pii.find(spark.createDataFrame(rows, "doc_id long, text string"), remove=0.99).collect()}
    for i in range(8):
        r = out[1000 + i]
        assert [r.text[s.start : s.end] for s in r.pii__terms] == ["weaver"]
    assert [i for i, r in out.items() if r.pii__terms and not 1000 <= i < 1008] == []


def test_a_term_beside_nineteen_addresses(spark):
    rows = [(i, f"common words user{i}@host.org wattle") for i in range(19)] + [(100 + i, "common words") for i in range(300)]
    rows += [(1000 + i, f"common words post{i}@host.org") for i in range(19)]
    out = {r.doc_id: r for r in op2_pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[0].text[s.start : s.end] for s in out[0].pii__terms] == ["wattle"]
    assert not out[1000].pii__terms


def judged(rows, generalise=0.5, chance=0.01, prior=10.0):
    """(term, target) by the formulae, where no two texts are near copies."""
    docs = []
    for text in rows:
        spans = brute(text)[0]
        entities = {f"{k}:{text[a:b]}" for k, a, b in spans}
        rest = list(text)
        for _, a, b in spans:
            rest[a:b] = " " * (b - a)
        docs.append((entities, set(re.findall(r"(?<![^\W])[^\W\d_]{3,}(?!\w)", "".join(rest).lower()))))
    often = Counter(e for entities, _ in docs for e in entities)
    targets = [*BRUTE, *(e for e, n in often.items() if n > 1)]
    every = Counter(t for _, terms in docs for t in terms)
    out = set()
    for target in targets:
        kind = target in BRUTE
        mine = [(min(e for e in es if e.startswith(target + ":")) if kind else i, terms) for i, (es, terms) in enumerate(docs) if any(e.startswith(target + ":") for e in es)] if kind else [(i, terms) for i, (es, terms) in enumerate(docs) if target in es]
        seen, held = defaultdict(set), Counter()
        for evidence, terms in mine:
            for t in terms:
                seen[t].add(evidence)
                held[t] += 1
        found, without = len({e for e, _ in mine}), len(docs) - len(mine)
        if not found or not without:
            continue
        n, p = found + without, found / (found + without)
        for t, evidence in seen.items():
            f, w = len(evidence), every[t] - held[t]
            if f < 2:
                continue
            q = f / (f + w)
            odds = f * math.log(q / p) + (w * math.log((1 - q) / (1 - p)) if w else 0.0)
            if q > p and odds >= 2 * math.log(n) - math.log(chance) and math.log((f + prior * p) / (f + w + prior) / p) / -math.log(p) >= generalise:
                out.add((t, target))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_added_terms_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(900)]
    texts = []
    for i in range(700):
        own = rng.sample(words, 14)
        if i % 7 == 0:
            own += [rng.choice(["", f"m{i}@host.org", f"m{i}@host.org"]), *rng.sample(["wattle", "fern", "oak"], 2)]
        if i % 50 == 1:
            own += ["boss@host.org", "weaver"]
        if i % 60 == 2:
            own += [f"10.0.{i % 256}.7", "router", 'token="ab12cd34ef"']
        if i % 90 == 3:
            own += ["fern", "oak"]
        rng.shuffle(own)
        texts.append(" ".join(own))
    want = judged(texts)
    assert len(want) >= 4 and not any(len(t) < 3 for t, _ in want)
    told = defaultdict(set)
    for term, target in want:
        told[target].add(term)
    out = op2_pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in out:
        entities = {f"{k}:{r.text[a:b]}" for k, a, b in brute(r.text)[0]}
        terms = set().union(*(told[x] for x in entities | {e.split(":")[0] for e in entities}))
        assert {r.text[s.start : s.end] for s in r.pii__terms} == terms & set(re.findall(r"(?<![^\W])[^\W\d_]{3,}(?!\w)", r.text)), r.text


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, None), (1, None)]])
def test_edges(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert op2_pii.find(df).count() == len(rows)
    assert sorted(map(str, op2_pii.sanitise(df).collect())) == sorted(map(str, df.collect()))
