import random
import re
import unicodedata
from collections import defaultdict

import pytest
from platlens.llm import leakage, site_lines
from platlens.llm.leakage import leak_report, leaked_passages
from platlens.llm.site_lines import SiteLines
from platlens.llm.words import BatchWords, words

CHUNKS = "chunk_id string, doc_id string, chunk_text string, party string, h int"
MAP = "platform_id string, party string"


def site(seed=1):
    r = random.Random(seed)
    chunks, parties = [], [(f"d{i}", ["Big ", "big"][i % 2] if i < 60 else f"p{i % 4}") for i in range(100)]
    for i in range(100):
        for k in range(4):
            lines = [" ".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(3)]
            if r.random() < 0.4:
                lines.insert(r.randrange(3), ["All rights reserved here!", "ALL RIGHTS, reserved here"][r.randrange(2)])
            if i % 25 == 0:
                lines.append("rare line of words")
            chunks.append((f"d{i}#s{k}", f"d{i}", "\n".join(lines), "x", 1))
    return chunks, parties


def brute(chunks, parties):
    party = {}
    for d, p in parties:
        if p and p.strip():
            party[d] = min(party.get(d, "￿"), p.strip().upper())
    docs, lines, places = defaultdict(set), defaultdict(set), []
    for k, d, t, *_ in chunks:
        if d in party:
            docs[party[d]].add(d)
            for i, line in enumerate(t.split("\n") if t is not None else []):
                w = tuple(words(line))
                if len(w) >= 4:
                    lines[party[d], w].add(d)
                    places.append((k, i, party[d], w))
    return {(k, i) for k, i, p, w in places if len(lines[p, w]) >= 3 and 5 * len(lines[p, w]) >= len(docs[p])}


@pytest.mark.parametrize("counters", [500_000, 20])
def test_lines_equal_brute_force(spark, monkeypatch, counters):
    monkeypatch.setattr(site_lines, "COUNTERS", counters)
    chunks, parties = site()
    chunks += [chunks[0], ("n#s0", "d1", None, "x", 1), ("e#s0", "d1", "", "x", 1), ("u#s0", "unknown", chunks[0][2], "x", 1), ("z#s0", None, "a", "x", 1)]
    s = SiteLines(spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame([*parties, ("d1", None), ("unknown", " ")], MAP))
    want = brute([c for c in chunks if c[1] is not None], parties)
    assert {(r.chunk_id, r.line_no) for r in s.occurrences().collect()} == want and want
    cleaned = {r.chunk_id: r for r in s.cleaned().collect()}
    for k, d, t, *_ in chunks:
        if d is not None and t is not None:
            kept = [x for i, x in enumerate(t.split("\n")) if (k, i) not in want]
            assert cleaned[k].chunk_text == "\n".join(kept)
    assert cleaned["n#s0"].chunk_text is None


def test_lines_of_nothing(spark):
    s = SiteLines(spark.createDataFrame([], CHUNKS), spark.createDataFrame([], MAP))
    assert s.occurrences().count() == 0 and s.cleaned().count() == 0


def folded(text):
    low = unicodedata.normalize("NFD", text.lower())
    return re.findall(r"[^\W_]+", "".join(c for c in low if not unicodedata.combining(c)))


def test_batch_words_agree_with_plain_words():
    texts = ["", "Ação é tudo, x2!", "한국어 état", "İstanbul", "一二三 ok", "_a_b", "word " * 5000 + "x" * 300]
    for fold in (False, True):
        codes, at = BatchWords(fold)(texts)
        for i, t in enumerate(texts):
            own = folded(t) if fold else words(t)
            assert at[i + 1] - at[i] == len(own)
    a, _ = BatchWords(True)(["Ação"])
    b, _ = BatchWords(True)(["acao"])
    assert a.tolist() == b.tolist()


def leaks(docs, items, n=10):
    out = set()
    for d, t in docs:
        w = folded(t or "")
        runs = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for k, x in items:
            v = folded(x or "")
            if any(tuple(v[i : i + n]) in runs for i in range(len(v) - n + 1)):
                out.add((d, k))
    return out


@pytest.mark.parametrize("a_pass", [20_000, 3])
def test_leaks_equal_brute_force(spark, monkeypatch, a_pass):
    monkeypatch.setattr(leakage, "ITEMS_A_PASS", a_pass)
    r = random.Random(2)
    vocabulary = ["água", "rio", "ponte", "the", "of", "lei", "Zonuna", "Pelíco", "câmara", "x1"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(8, 30)))) for i in range(12)] + [(3, "outro texto do item três com palavras bastantes para dez aqui"), (50, None), (51, "short")]
    docs = []
    for d in range(150):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        if d % 3 == 0:
            _, x = items[r.randrange(13)]
            v = x.upper().split()
            i = r.randrange(max(1, len(v) - 9))
            w[len(w) // 2 : len(w) // 2] = [unicodedata.normalize("NFD", q) for q in v[i : i + r.choice([9, 10, 30])]]
        docs.append((d, " ".join(w)))
    docs += [(900, None), (901, ""), (902, "rio " * 100_000), docs[0]]
    out = leaked_passages(spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, d int"), spark.createDataFrame([(*x, "q") for x in items], "item_id bigint, text string, w string"))
    rows = out.collect()
    want = leaks(docs, items)
    assert {(x.doc_id, x.item_id) for x in rows} == want and len(want) > 20
    assert all(x.run_words >= 10 and 0 < x.share <= 1 for x in rows)
    assert {x.item_id for x in leak_report(out).collect()} == {i for _, i in want}


def test_leaks_of_nothing(spark):
    d, i = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert leaked_passages(d, i).count() == 0 and leaked_passages(d.limit(0), i.limit(0)).count() == 0
