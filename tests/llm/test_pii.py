import math
import random
from collections import Counter

import regex

from brute import pii as plain
from brute import sha
from quire.llm import pii

TEXTS = [
    "mail a.b+c@ex-am.ple.org, A@b.c@d.e x@y", "a@b.c+d@e.f", "ip 10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 0001.002.3.4 1.2.3", "card 4587121519400672 4587 1215 1940 0672 4587-1215-1940-0673 1  2 3",
    "call +1 (255) 555-8013 now, +49.30.1234567 +1 23 + 1 +999999999999999999", "+1 4587121519400672", None, "", "Ünïcode é🙂 1.2.3.4 é a@b.co 🙂", "1 2 3 4 5 6 7 8 9 0 " * 400, "9" * 5000, "a" * 5000 + "@", "+1" * 500,
]


def run(spark, rows, path):
    spark.createDataFrame(rows, "doc_id long, text string, email string").write.parquet(f"{path}/documents.parquet")
    return {r.doc_id: r for r in pii.op3_pii(spark, str(path)).collect()}


def test_base_spans(spark, tmp_path):
    rng = random.Random(2)
    bits = ["1.2.3.4", "a@b.cc", "+1 234 567 8901", "4587121519400672", " ", "7", ".", "@", "-", "+", "é", "x", "(", ")", "25"]
    rows = [(k, t, "clash") for k, t in enumerate(TEXTS + ["".join(rng.choices(bits, k=12)) for _ in range(300)])]
    got = run(spark, rows, tmp_path)
    for k, t, _ in rows:
        counts, said = plain(t)
        r = got[k]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, t
        assert r.base_sha256 == sha(said), t
        assert set(filter(None, said.split(","))) <= set(r.spans.split(",")), t


def test_contexts_find_new_identifiers(spark, tmp_path):
    rows = [(k, f"some words Account: user{k}@mail.com and more", None) for k in range(12)]
    rows += [(100, "here Account: ZX-99812-77 follows", None), (101, "here stands ZX-99812-78 alone", None)]
    got = run(spark, rows, tmp_path)
    assert got[100].spans == "id:14:25" and got[100].n_id == 1
    assert rows[12][1][14:25] == "ZX-99812-77"
    assert got[101].spans == "" and got[101].n_id == 0


def test_every_base_entity_is_a_seed(spark, tmp_path):
    """Phones and cards with spaces, brackets, tabs, accents and quotes teach their contexts."""
    rows = [(k, f"words Ph\u00f6ne\t+1 (017) 555-{7700 + k} end", None) for k in range(12)]
    rows += [(20 + k, f'words Mailto: "user{k}@mail.com" end', None) for k in range(12)]
    rows += [(100, "here Ph\u00f6ne  (017) 555-7713 end", None), (101, "here mailto: [ZX-99812-77] end", None), (102, "here Ph\u00f6ne " + "AB1" * 30 + " end", None)]
    got = run(spark, rows, tmp_path)
    said = lambda k, value: f"id:{rows[k][1].index(value)}:{rows[k][1].index(value) + len(value)}"
    assert got[100].spans == said(24, "(017) 555-7713")
    assert got[101].spans == said(25, "ZX-99812-77")
    assert got[102].spans == said(26, "AB1" * 30)


def plain_ids(rows):
    """Added spans by the same rules in plain Python."""
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    covered, links, totals, seen = {}, Counter(), Counter(), {}
    for k, t in rows:
        spans = [tuple(map(int, s.split(":")[1:])) for s in plain(t)[1].split(",") if s]
        covered[k] = spans
        totals.update(low(m[0]) for m in regex.finditer(pii._WORD, t))
        for a, b in spans:
            m = regex.search(pii._SEED, t[max(0, a - 1024) : a])
            if m:
                links[low(m[1]), t[a:b], True] += 1
        for m in regex.finditer(pii._CANDIDATE, t):
            word = regex.match(r"\p{L}+", m[0])[0]
            at = m.end() - len(regex.sub("^" + r"\p{L}+" + pii._GAP, "", m[0]))
            value = t[at : m.end()]
            if (regex.search("@", m[0]) or len(regex.findall("[0-9]", m[0])) >= 3) and len(value) >= pii.MIN_CHARS and not any(a < m.end() and b > at for a, b in spans):
                links[low(word), value, False] += 1
                seen.setdefault(k, []).append((low(word), at, m.end()))
    certain = {v for _, v, s in links if s}
    score, confidence = {v: float(v in certain) for _, v, _ in links}, Counter()
    for _ in range(50):
        confidence = Counter()
        for (p, v, _), n in links.items():
            confidence[p] += n * score[v] / (totals[p] + 1)
        score = {v: 1.0 if v in certain else 1 - math.prod(1 - min(confidence[p], 0.999) for p, w, _ in links if w == v) for v in score}
    seeds = Counter(p for p, _, s in links if s)
    good = {p for p in confidence if confidence[p] >= pii.MIN_CONFIDENCE and seeds[p] >= pii.MIN_SEEDS}
    return {k: [f"id:{a}:{b}" for p, a, b in found if p in good] for k, found in seen.items()}


def test_added_spans_against_plain_version_and_decoys(spark, tmp_path):
    """Words that mostly stand before something else teach nothing; planted identifiers behind real contexts are found."""
    rng = random.Random(9)
    noise = "the of and river stone cloud lamp paper".split()
    rows = []
    for k in range(240):
        w = rng.choices(noise, k=30)
        kind = k % 8
        if kind < 3:
            w[9:11] = [["mailbox", "contact:", "Hotline"][kind], [f"u{k}@mail.com", f"v{k}@mail.org", f"+1 (255) 555-{8000 + k}"][kind]]
        elif kind == 3:
            w[9:11] = [rng.choice(["mailbox", "contact:"]), f"KX-{k:05d}-B"]
        elif kind == 4:
            w[9:11] = ["the", f"w{k}@mail.com"]
        elif kind == 5:
            w[9:11] = ["the", f"{4587121519400000 + k}"]
        rows.append((k, " ".join(w)))
    spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, email string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("id:")] for r in pii.op3_pii(spark, str(tmp_path)).collect()}
    want = plain_ids(rows)
    assert all(got[k] == want.get(k, []) for k, _ in rows)
    assert {k for k, _ in rows if got[k]} <= {k for k, _ in rows if k % 8 == 3}
    assert sum(map(bool, got.values())) > 20
