"""The registered queries against SQL, brute force, round trips and held-out accuracy."""

from __future__ import annotations

import math
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from regolith.llm import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
MORE = "/root/testdata/sf0.01"
LARGE = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def docs(spark):
    return Q.table(spark, SF, "documents").collect()


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    plain = lambda v: round(v, 12) if isinstance(v, float) and not math.isnan(v) else None if v is None or v != v else str(v)
    df = Q.queries()[name](spark, SF)
    cols = sorted(df.columns)
    res = con.execute(Q.oracle_sql()[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in res.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == want


def words(text):
    return (text or "").encode().split()


def shingles(text, k=5):
    w = words((text or "").encode().lower().decode())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(sets):
    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for d, s in sets.items():
        for e, n in Counter(e for x in s for e in where[x] if e > d).items():
            if 100 * n >= 75 * (len(s) + len(sets[e]) - n):
                a, b = root(d), root(e)
                up[max(a, b)] = min(a, b)
    return {d: root(d) for d in sets}


def test_ngram_join_brute_force(spark):
    rows = Q.table(spark, MORE, "documents").collect()
    sets = {r.doc_id: shingles(r.text) for r in rows}
    want = components(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in Q.op1_ngram_join(spark, MORE).collect()}
    assert got == {d: (len(s), want[d]) for d, s in sets.items()}


def test_packing_round_trip(spark, docs):
    got = Q.op3_best_fit_packing(spark, SF).toPandas()
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in docs:
        ids = [*own.encode(r.text or "", add_special_tokens=False).ids, 0]
        mine = got[got.doc_id == r.doc_id].sort_values("piece")
        assert list(mine.start) == [0, *np.cumsum(mine.length)[:-1]] and mine.length.sum() == len(ids)
        for p in mine.itertuples():
            assert zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1


def test_quality_on_held_out_rows(spark):
    got = Q.op4_quality_classifier(spark, LARGE).toPandas().merge(Q.table(spark, LARGE, "labels").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.98
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad).mean() > 0.995


def test_language_on_held_out_rows(spark):
    got = Q.op5_language_id(spark, MORE).toPandas().merge(Q.table(spark, MORE, "documents").toPandas(), on="doc_id")
    assert (got[got.held_out].lang_pred == got[got.held_out].lang).mean() > 0.97


def plain_trie(texts):
    """log10 probability of a text under counts of orders 0 to 3, escape method C with exclusion, in plain Python."""
    trie = [defaultdict(Counter) for _ in range(4)]
    frame = lambda t: b"\xff\xff\xff" + (t or "").encode() + b"\xff"
    for t in texts:
        b = frame(t)
        for j in range(3, len(b)):
            for k in range(4):
                trie[k][b[j - k : j]][b[j]] += 1

    def log10(text):
        b, out = frame(text), 0.0
        for j in range(3, len(b)):
            gone, p = set(), 1.0
            for k in (3, 2, 1, 0):
                live = {s: n for s, n in trie[k].get(b[j - k : j], {}).items() if s not in gone}
                if not live:
                    continue
                size = sum(live.values()) + len(live)
                if b[j] in live:
                    p *= live[b[j]] / size
                    break
                p *= len(live) / size
                gone |= set(live)
            else:
                p /= 256 - len(gone)
            out += math.log10(p)
        return out

    return log10


def test_lm_scoring_brute_force(spark, docs):
    got = {r.doc_id: r for r in Q.op10_lm_scoring(spark, SF).collect()}
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    tokens = {r.doc_id: [*(r.text or "").encode().lower().split(), None] for r in docs}
    count = Counter(t for d, w in tokens.items() if not held(d) for t in w)
    total, distinct = sum(count.values()), len(count)
    log10 = plain_trie(r.text for r in docs if not held(r.doc_id))
    for r in docs:
        x, w = got[r.doc_id], tokens[r.doc_id]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held(r.doc_id), len(w), sum(count[t] > 0 for t in w), total)
        assert math.isclose(x.base_score, sum(math.log10((count[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in w), rel_tol=1e-9)
    for r in docs[:25] + [r for r in docs if held(r.doc_id)][:5]:
        assert math.isclose(got[r.doc_id].score, log10(r.text), rel_tol=1e-6)


def test_language_brute_force(spark, docs):
    """Every language's trie over all its training texts in plain Python: shortest code and its share."""
    got = {r.doc_id: r for r in Q.op5_language_id(spark, SF).collect()}
    held = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    tries = {x: plain_trie(r.text for r in docs if r.lang == x and not held(r.doc_id) and r.text is not None) for x in sorted({r.lang for r in docs if r.lang and not held(r.doc_id)})}
    short = sorted((r for r in docs if r.text and any(c.isalpha() for c in r.text)), key=lambda r: len(r.text))
    for r in short[:40]:
        lp = {x: f(r.text) for x, f in tries.items()}
        best = max(lp, key=lp.get)
        share = 1 / sum(10 ** max(v - lp[best], -300) for v in lp.values())
        assert got[r.doc_id].held_out == held(r.doc_id) and got[r.doc_id].lang_pred == best
        assert math.isclose(got[r.doc_id].score, share, rel_tol=1e-3)


def test_pipeline_brute_force(spark):
    """Each stage against plain Python on the rows that its predecessor kept."""
    import corpus_pipeline as C
    from regolith.llm.textkit import materialize

    rows = Q.table(spark, MORE, "documents")
    kept = {}
    for name, stage in C.STAGES[:-1]:
        before = {r.doc_id: r for r in rows.collect()}
        rows = materialize(stage(spark, rows, MORE), "test")
        after = {r.doc_id: r for r in rows.collect()}
        assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars"] and set(after) <= set(before)
        kept[name] = (before, after)

    labels = {r.doc_id: r.quality for r in Q.table(spark, MORE, "labels").collect()}
    before, after = kept["quality_classifier"]
    assert sum(d in after for d, q in labels.items() if q == 1) > 0.98 * sum(q == 1 for q in labels.values())
    assert sum(d in after for d, q in labels.items() if q == 0) < 0.35 * sum(q == 0 for q in labels.values())

    before, after = kept["line_dedup"]
    blank = " \t\n\x0b\x0c\r"
    sites, first = defaultdict(set), {}
    for d in sorted(before):
        for x in (before[d].text or "").split("\n"):
            if x.strip(blank):
                sites[x.strip(blank)].add(before[d].source)
                first.setdefault(x.strip(blank), d)
    for d, r in before.items():
        left = "\n".join(x for x in r.text.split("\n") if not x.strip(blank) or len(sites[x.strip(blank)]) < 4 or first[x.strip(blank)] == d)
        assert after[d].text == left and after[d].n_chars == len(left)

    before, after = kept["ngram_join"]
    root = components({d: shingles(r.text) for d, r in before.items()})
    assert set(after) == {d for d in before if root[d] == d}

    before, after = kept["decontamination"]
    items = [" ".join(x.decode() for x in words(r.text.lower())) for r in Q.table(spark, MORE, "benchmark").collect()]
    exact = {d for d, r in before.items() if any(i in " ".join(x.decode() for x in words(r.text.lower())) for i in items)}
    assert exact and not exact & set(after)
    assert all(any(shingles(i) & shingles(before[d].text) for i in items) for d in set(before) - set(after))

    pieces = C.STAGES[-1][1](spark, rows, MORE).toPandas()
    assert set(pieces.doc_id) == set(after)
