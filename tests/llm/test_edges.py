"""Defined results on nulls, blanks, long texts, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from regolith.llm import decontamination, language_id, line_dedup, lm_scoring, ngram_join, packing, quality_classifier, quality_rules, substring_dedup, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk int, TEXT string, w string, h string, rid long, site string, kept string, flags string"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
BASE = " ".join(f"alpha{i}" for i in range(40))
NEAR = BASE.replace("alpha20 ", "")


def documents(spark, rows):
    full = [(i, t, lang, src, 1, 7, "c", "w", "h", 1, "s", "k", "f") for i, t, lang, src in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, BASE, "en", "a"), (2, BASE, "en", "b"), (3, NEAR, "de", None), (4, None, None, "c"), (5, "", "en", "d"), (6, " \n\t ", "fr", "e"),
        (7, "One\x0btwo three", "en", "f"), (8, LONG, "en", "g"), (9, LONG + " tail", "en", "h"), (None, BASE, "en", "i"), (10, "ÄÖ ÜÄ   x", "de", "j"), (11, BASE, "en", "c"), (11, BASE, "en", "c"),
    ]
    return documents(spark, rows).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, []).limit(0)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_ngram_join(odd, none):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(odd).collect()}
    assert got == {1: (36, 1), 2: (36, 1), 3: (35, 1), 4: (0, 4), 5: (0, 5), 6: (0, 6), 7: (1, 7), 8: (59_996, 8), 9: (59_997, 8), 10: (1, 10), 11: (36, 1), None: (36, 1)}
    assert ngram_join.ngram_join(odd).count() == odd.count()
    assert ngram_join.ngram_join(none).collect() == []
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {1, 4, 5, 6, 7, 8, 10}


def test_ngram_threshold_is_exact(spark):
    # 40 shingles each, 35 or 34 shared: 35/45 = 0.777..., 34/46 < 0.75
    a = [f"a{i}" for i in range(44)]
    docs = documents(spark, [(1, " ".join(a), "en", "a"), (2, " ".join([*a[:39], *[f"b{i}" for i in range(5)]]), "en", "a"), (3, " ".join([*a[6:], *[f"c{i}" for i in range(6)]]), "en", "a")])
    assert rows(ngram_join.ngram_join(docs), "doc_id", "component_id") == [(1, 1), (2, 1), (3, 3)]


def test_substring_dedup(odd, none):
    got = rows(substring_dedup.substring_dedup(odd), "doc_id", "n_words", "n_removed")
    assert got == sorted(
        [(1, 40, 0), (2, 40, 40), (3, 39, 39), (4, 0, 0), (5, 0, 0), (6, 0, 0), (7, 3, 0), (8, 60_000, 0), (9, 60_001, 60_000), (10, 4, 0), (11, 40, 40), (11, 40, 40), (None, 40, 40)], key=repr
    )
    assert substring_dedup.substring_dedup(none).collect() == []


def test_quality_rules(odd, none):
    got = {r.doc_id: r for r in quality_rules.quality_rules(odd).collect()}
    assert (got[4].n_words, got[4].kept, got[4].base_failed) == (0, False, True)
    assert (got[6].n_words, got[6].n_lines) == (0, 0)
    assert (got[8].n_words, got[8].n_repeat_words) == (60_000, 0)
    assert got[None].n_words == 40 and got[1].kept
    assert quality_rules.quality_rules(none).collect() == []


def test_quality_rules_counts(spark):
    text = "a b c d e f a b c d e\nx | y | z\nx | y | z\n" + "real words make a longer line of text here. " * 3
    r = quality_rules.quality_rules(documents(spark, [(1, text, "en", "a")])).first()
    assert (r.n_symbols, r.n_dup_lines, r.n_failed_lines) == (4, 1, 2)
    assert "x | y" not in r.cleaned


def test_packing(odd, none):
    got = packing.packing(odd, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), with_ids=True).toPandas()
    assert (got.length <= 2048).all()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]]
    long = got[got.doc_id == 8].sort_values("piece")
    ids = Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(LONG, add_special_tokens=False).ids + [0]
    assert list(np.concatenate([np.frombuffer(x, "<u4") for x in long.ids])) == ids
    assert [zlib.crc32(x) for x in long.ids] == list(long.ids_crc32)
    assert (long.length[1:] == 2048).all()
    assert list(got[got.doc_id == 4].length) == [1]
    assert got.doc_id.isna().sum() == 1
    assert packing.packing(none, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")).collect() == []


@pytest.mark.parametrize("text", ["plain text", "<|endoftext|>", "a\x1cb", "\xa0　x", "中文 тест", "it's we'll DON'T", "  two   spaces\n\n\tx ", "é" * 50, "\U0001f600 ok", "x\r\ny", "1234 ½ ²"])
def test_encoder_equals_the_file(text):
    want = Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert list(packing.encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"))(text)) == want


def test_merging_rounds_reach_few_sequences(spark):
    docs = documents(spark, [(i, "word " * 99, "en", "a") for i in range(400)]).repartition(8)
    got = packing.packing(docs, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), fan_in=3).toPandas()
    assert len(got) == 400
    best = packing.packing(docs, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")).toPandas()
    assert best.sequence_id.nunique() == -(-400 // (2048 // 100))


def test_quality_classifier(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60)], "doc_id long, quality int, toxic int")
    good, bad = "Some plain words stand in this sentence. It goes on.", "BUY!! NOW!! $$$ CHEAP!! %%% WIN!!"
    docs = documents(spark, [(i, (good if i % 2 else bad) + f" n{i}", "en", "a") for i in range(120)])
    model = quality_classifier.fit_quality(docs, labels, F.lit(True))
    got = {r.doc_id: r.score for r in quality_classifier.score_quality(docs, model).collect()}
    assert min(got[i] for i in got if i % 2) > max(got[i] for i in got if not i % 2)
    assert len(quality_classifier.score_quality(odd, model).collect()) == odd.count()
    assert quality_classifier.fit_quality(none, labels, F.lit(True)) is None
    assert {r.score for r in quality_classifier.score_quality(odd, None).collect()} == {0.5}
    assert quality_classifier.score_quality(none, model).collect() == []


def test_language_id(odd, none):
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.language_id(odd, F.lit(True)).collect()}
    assert got[4] == ("und", 0.0) and got[6] == ("und", 0.0)
    assert got[8][0] == "en" and got[10][0] == "de"
    assert {r.lang_pred for r in language_id.language_id(odd, F.lit(False)).collect()} == {"und"}
    assert language_id.language_id(none, F.lit(True)).collect() == []


def test_lm_scoring(odd, none):
    got = {r.doc_id: r for r in lm_scoring.lm_scoring(odd, F.col("doc_id") == 9).collect()}
    assert got[4].n_tokens == 1 and got[9].held_out and got[9].n_known == 60_001
    assert got[8].train_tokens == sum(r.n_tokens for i, r in got.items() if i != 9) + got[11].n_tokens
    assert all(r.score <= 0 and r.base_score <= 0 for r in got.values())
    assert lm_scoring.lm_scoring(none, F.lit(False)).collect() == []
    assert len(lm_scoring.lm_scoring(odd, F.lit(True)).collect()) == odd.count()


def same_scores(score):
    """Costs asked from buckets give the result of tries that hold all strings."""
    get = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.score, r[1]) for r in df.collect())
    whole, asked = get(score()), get(score(max_nodes=50))
    assert [(*x[:2], x[3]) for x in asked] == [(*x[:2], x[3]) for x in whole]
    assert np.allclose([x[2] for x in asked], [x[2] for x in whole], rtol=1e-6)


def test_lm_scoring_loses_no_string(odd):
    same_scores(lambda **x: lm_scoring.lm_scoring(odd, F.col("doc_id") == 9, **x))


def test_language_id_loses_no_string(odd):
    same_scores(lambda **x: language_id.language_id(odd, F.col("doc_id") != 9, **x))


def test_language_id_with_many_labels(spark):
    """Beyond the number of tables a worker holds, costs come from buckets; ties go to the earlier name."""
    rows = [(i, f"lang{i % 20} wort{i % 20} x{i % 20}y " * 5, f"l{i % 20:02d}", "a") for i in range(80)]
    docs = documents(spark, [*rows, (100, "lang3 wort3 x3y", None, "a"), (101, "same words here", "tie1", "a"), (102, "same words here", "tie0", "a")])
    got = {r.doc_id: r.lang_pred for r in language_id.language_id(docs, F.lit(True)).collect()}
    assert got[100] == "l03" and all(got[i] == f"l{i % 20:02d}" for i in range(80)) and got[101] == got[102] == "tie0"


def test_line_dedup(spark, none):
    docs = documents(spark, [(i, f"own line {i}\nShared line here.\n\n", "en", f"s{i % 5}") for i in range(1, 9)] + [(20, None, None, None), (21, "", "en", None), (None, "Shared line here.", "en", "s1")])
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in line_dedup.line_dedup(docs).collect()}
    assert got[1] == (2, 0, "own line 1\nShared line here.\n\n")
    assert got[2] == (2, 1, "own line 2\n\n")
    assert got[20] == (0, 0, None) and got[21] == (0, 0, "") and got[None] == (1, 1, "")
    shuffled = line_dedup.line_dedup(docs, broadcast_limit=0)
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in shuffled.collect()} == got
    cut = line_dedup.without_boilerplate(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert line_dedup.line_dedup(none).collect() == []


def test_decontamination(spark, odd, none):
    bench = spark.createDataFrame([(1, BASE.upper()), (2, None), (3, ""), (4, "one two three"), (5, BASE)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start_word, r.n_words, round(r.similarity, 4)) for r in decontamination.contaminated(odd, bench).collect()}
    assert got[1, 1] == (0, 40, 1.0) and got[1, 5] == (0, 40, 1.0) and got[None, 1] == (0, 40, 1.0)
    assert got[7, 4] == (0, 3, 1.0)
    assert {k[0] for k in got} == {1, 2, 3, 11, None, 7}
    assert {r.doc_id for r in decontamination.decontaminate(odd, bench).collect()} == {4, 5, 6, 8, 9, 10}
    assert decontamination.contaminated(none, bench).collect() == []
    assert decontamination.contaminated(odd, bench.limit(0)).collect() == []


def test_shuffled_benchmark_gives_the_same(odd, spark):
    bench = spark.createDataFrame([(1, BASE)], "item_id long, text string")
    a = rows(decontamination.contaminated(odd, bench), "doc_id", "start_word", "similarity")
    assert a == rows(decontamination.contaminated(odd, bench, broadcast_limit=0), "doc_id", "start_word", "similarity")


def test_decontamination_of_reordered_parts(spark):
    # parts swapped in a longer document: 92 of 96 shingles are left, at two offsets; start 150
    a, b = [f"a{i}" for i in range(50)], [f"b{i}" for i in range(50)]
    other = [f"o{i}" for i in range(400)]
    docs = documents(spark, [(1, " ".join([*other[:150], *b, *a, *other[150:]]), "en", "a"), (2, " ".join(other), "en", "a")])
    bench = spark.createDataFrame([(1, " ".join(a + b))], "item_id long, text string")
    for limit in (decontamination.BROADCAST_LIMIT, 0):
        got = decontamination.contaminated(docs, bench, broadcast_limit=limit).collect()
        assert [tuple(r) for r in got] == [(1, 1, 150, 100, 92 / 100)]
    assert [r.doc_id for r in decontamination.decontaminate(docs, bench).collect()] == [2]


def test_decontamination_tries_every_window(spark):
    """Few words, so that shingles repeat and windows are cut at both ends, against plain Python."""
    rng = np.random.default_rng(5)
    draw = lambda n, v: [f"w{x}" for x in rng.integers(0, v, n)]
    items = {i: draw(int(rng.integers(5, 14)), 2) for i in range(12)}
    texts = {}
    for i in range(60):
        x = list(items[i % 12])
        at = int(rng.integers(0, len(x)))
        x = x[at:] + x[:at] if i % 3 else x[: at + 1]
        texts[i] = draw(int(rng.integers(0, 9)), 2 + i % 4) + x + draw(int(rng.integers(0, 9)), 2 + i % 4)
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    want = {}
    for i, w in texts.items():
        for j, item in items.items():
            mine, ref, found = grams(w), Counter(grams(item)), []
            size = len(item) - 4
            for s in range(1 - size, len(mine)):
                own = mine[max(s, 0) : s + size]
                both = sum((Counter(own) & ref).values())
                found.append((both / (len(own) + size - both), -max(s, 0), len(own) + 4))
            if found and max(found)[0] >= 0.75:
                want[i, j] = max(found)
    docs = documents(spark, [(i, " ".join(w), "en", "a") for i, w in texts.items()])
    bench = spark.createDataFrame([(j, " ".join(w)) for j, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, -r.start_word, r.n_words) for r in decontamination.contaminated(docs, bench).collect()}
    assert len(want) > 20 and got == want


def test_warc(spark, tmp_path):
    page = "<p>" + "x" * 200
    data = [(3, "http://a", page, 1), (1, "http://b c\r\nX: y", page, 1), (5, None, page, 1), (2, "u", "small", 1), (4, "u", "small", 1), (6, "u", None, 1), (None, "u", page, 1)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, digest int")
    bundles = warc.write_warc(pages)
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_warc(bundles).collect()}
    assert got == {1: (203, "response", None), 3: (203, "revisit", 1), 5: (203, "revisit", 1), None: (203, "revisit", 1), 2: (5, "response", None), 4: (5, "response", None), 6: (0, "response", None)}
    for r in bundles.collect():
        for i, f, o, n in zip(r.ids, r.frames, r.offsets, r.lengths, strict=True):
            fields, _ = warc.parse(warc.fetch(r.content, f, o, n))
            assert fields["warc-record-id"] == warc._name(i)
    assert sum(r.bytes for r in warc.export_files(bundles, str(tmp_path)).collect()) == sum(p.stat().st_size for p in tmp_path.glob("*.warc.zst"))
    assert warc.read_warc(warc.write_warc(pages.limit(0))).collect() == []


def test_quality_rules_judge_lines_by_their_words(spark):
    tail = " and then more plain words close the sentence."
    lines = {
        "Buy    now": True, "Buy now": True, "Plain words" + tail: False, "Plain  words" + tail: False,
        "home | news | about": True, "Inicio » Noticias » Aviso": True, "see http://a.b and www.c.d now please.": True,
        "Alle Rechte vorbehalten, siehe unten.": True, "Lire la suite de cet article.": True, "Haga clic aquí para verlo todo.": True,
        "one two three four five six seven eight": False, "one two three four five six seven": True, "One two three four five six seven.": False,
        "### *** now": True, "WIN!!!! now": True,
    }
    docs = documents(spark, [(i, x, "en", "a") for i, x in enumerate(lines)])
    got = {r.doc_id: r.n_failed_lines for r in quality_rules.quality_rules(docs).collect()}
    assert got == {i: int(x) for i, x in enumerate(lines.values())}
    together = documents(spark, [(1, "\n".join(lines), "en", "a")])
    assert quality_rules.quality_rules(together).first().n_failed_lines == sum(lines.values())


def test_ngram_join_rests_on_tiles(spark, monkeypatch):
    """Without hubs the tiles' pairs alone give all links; with them, hubs give some."""
    rng = np.random.default_rng(3)
    base = [[f"w{g}x{i}" for i in range(60)] for g in range(12)]
    rows = []
    for i in range(240):
        x = list(base[i % 12])
        for _ in range(int(rng.integers(0, 4))):
            x[int(rng.integers(0, 60))] = f"z{rng.integers(0, 9)}"
        rows.append((i, " ".join(x), "en", "a"))
    docs = documents(spark, rows)
    want = {r.doc_id: r.component_id for r in ngram_join.ngram_join(docs).collect()}
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(56)} for i, t, *_ in rows}
    up = {i: i for i in sets}

    def root(x):
        return x if up[x] == x else root(up[x])

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    assert want == {i: root(i) for i in sets}
    found = []
    verified = ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *x: found.append(verified(pairs, *x)) or found[-1])
    ngram_join.ngram_join(docs)
    assert found[0].count() > 0
    hubs = ngram_join.hub_pairs
    monkeypatch.setattr(ngram_join, "hub_pairs", lambda *x: hubs(*x).limit(0))
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_join(docs).collect()} == want
    assert found[-1].count() > 0


def test_ngram_join_of_a_thousand_near_misses(spark):
    # all share 30 of 46 shingles: every pair meets in tiles of a thousand, over several blocks, and none links
    shared = [f"s{i}" for i in range(34)]
    docs = documents(spark, [(i, " ".join([*shared, *[f"o{i}x{j}" for j in range(16)]]), "en", "a") for i in range(1000)] + [(5000, " ".join([*shared, *[f"o7x{j}" for j in range(15)], "end"]), "en", "a")])
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(docs).collect()}
    assert got.pop(5000) == 7 and got == {i: i for i in range(1000)}


def test_quality_risk_against_its_definition():
    """Gradient of the non-negative risk by finite differences of the plain formula, bracket open and closed."""
    rng = np.random.default_rng(1)
    pos, unl = rng.normal(1, 1, (40, 3)), rng.normal(0, 1, (60, 3))
    cuts = [np.quantile(unl[:, j], np.linspace(0.1, 0.9, 9)) for j in range(3)]
    for ranking, prior in ((True, 0.3), (False, 0.4), (False, 0.97)):
        m = quality_classifier.PULinear(np.zeros((2, 1)), cuts, ranking)
        m.weight = rng.normal(0, 0.3, len(m.weight))

        def parts(w, m=m, prior=prior, ranking=ranking):
            loss = (lambda z: np.log1p(np.exp(z))) if ranking else (lambda z: 1 / (1 + np.exp(-z)))
            z = lambda x: np.array([sum(w[j * 13 + int((c <= v).sum())] for j, (c, v) in enumerate(zip(m.cuts, r, strict=True))) for r in x]) + w[-1]
            return prior * loss(-z(pos)).mean(), loss(z(unl)).mean() - prior * loss(z(pos)).mean()

        w = np.append(m.weight, m.bias)
        g, bracket = m.gradient(m.bins(pos), m.unlabelled(m.bins(unl)), prior)
        plus, minus = parts(w)
        assert np.allclose(m.risk(m.bins(pos), m.unlabelled(m.bins(unl)), prior), (plus, minus)) and np.isclose(bracket, minus)
        for i in range(len(w)):
            e = np.zeros(len(w))
            e[i] = 1e-5
            up, down = parts(w + e), parts(w - e)
            want = (sum(up) - sum(down)) / 2e-5 if minus >= 0 else (up[0] - down[0]) / 2e-5
            assert abs(g[i] - want) < 1e-6


def test_quality_prior_is_read_from_positives_and_unlabelled():
    rng = np.random.default_rng(2)
    p, u = rng.normal(3, 1, 4000), np.concatenate((rng.normal(3, 1, 7000), rng.normal(-3, 1, 3000)))
    ranks = np.quantile(p, np.linspace(0, 0.99, 100))
    above = lambda z: (z[:, None] >= ranks).sum(axis=0)
    assert abs(quality_classifier.best_bin(above(u), len(u), above(p), len(p)) - 0.7) < 0.02


def test_quality_learns_where_every_text_has_a_label(spark):
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    good, bad = "Some plain words stand in this sentence. It goes on.", "BUY!! NOW!! $$$ CHEAP!! %%% WIN!!"
    docs = documents(spark, [(i, (good if i % 4 else bad) + f" n{i}", "en", "a") for i in range(200)])
    got = {r.doc_id: r.score for r in quality_classifier.score_quality(docs, quality_classifier.fit_quality(docs, labels, F.lit(True))).collect()}
    assert min(got[i] for i in got if i % 4) >= 0.5 > max(got[i] for i in got if not i % 4)


def test_every_pipeline_stage_on_odd_rows(spark, odd, none, tmp_path):
    """Nulls, blanks, long texts, ties, repeats and clashing names pass all stages; so does an empty table."""
    import corpus_pipeline as C

    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one two three four five six seven"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    folder = f"file://{tmp_path}"
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, odd, folder)
        assert out.columns == odd.columns, name
        got = [r.doc_id for r in out.collect()]
        assert {4, 5, 6} <= set(got) or name == "quality_classifier", name
        empty = stage(spark, none, folder)
        assert empty.columns == none.columns and empty.collect() == [], name
    cut = {r.doc_id: (r.text, r.n_chars) for r in C.STAGES[1][1](spark, odd, folder).where("doc_id in (4, 5, 7)").collect()}
    assert cut == {4: (None, 1), 5: ("", 0), 7: ("One\x0btwo three", 13)}
    kept = [r.doc_id for r in C.STAGES[2][1](spark, odd, folder).collect()]
    assert sorted(x for x in kept if x) == [1, 4, 5, 6, 7, 8, 10] and None not in kept
    pieces = C.STAGES[-1][1](spark, odd, folder)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in odd.collect()}
    assert C.STAGES[-1][1](spark, none, folder).collect() == []


def test_a_word_longer_than_a_hash_segment(spark):
    giant = "x" * 300_000
    docs = documents(spark, [(1, f"{giant} a b c d e", "en", "a"), (2, f"{giant} a b c d e", "en", "b"), (3, f"{giant}y a b c d e", "en", "c")])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 3)}
    assert rows(substring_dedup.substring_dedup(docs, k=3), "doc_id", "n_removed") == [(1, 0), (2, 6), (3, 5)]
