"""The training-data operators against brute-force versions, on small frames with every odd case."""

import collections
import hashlib
import math

import duckdb
import numpy as np
import pytest

import __spark_entry__ as E
from sparkprep.llm import (decontaminate, elias_fano, exact_dedup, jaccard, kernels, license_scan, line_dedup, quality,
                           sampling, sentence_pieces, token_count, toxicity)

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n_words string, score string"
LINE = "this line stands in more than five of the documents here"
ODD = [None, "", " ", "\n\n", "a", "A b", "Ünïcode ▁ 日本語 \U0001F600", "x" * 3000, "word " * 700, LINE, LINE.upper() + "\n" + LINE,
       "  CC   BY and cc-by\nALL rights Reserved. general public license", "<|endoftext|> it's"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and extra columns whose names clash with results."""
    rows = [(i, t, None, "7", None) for i, t in enumerate(ODD)]
    rows += [(100 + i, f"{LINE} \n unique {i}", "en", None, "x") for i in range(6)]
    rows += [(3, "\n\n", None, None, None), (None, "null id", "en", None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ["op5_line_dedup", "op7_decontaminate", "op8_exact_dedup", "op10_ngram_jaccard"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, exp = E.queries()[name](spark, SF).toPandas(), con.execute(E.oracle_sql()[name]).df()
    cols = sorted(exp.columns)
    assert sorted(got.columns) == cols
    norm = lambda d: sorted(tuple(map(str, r)) for r in d[cols].itertuples(index=False))
    assert norm(got) == norm(exp)


def test_words_and_grams_match_regex():
    import regex
    texts = [(t or "").encode() for t in ODD]
    for table, pattern in ((kernels.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (kernels.VISIBLE, r"[^\x20\x09-\x0D]+")):
        w = kernels.Words(texts, table)
        for i, t in enumerate(texts):
            want = [x.encode() for x in regex.findall(pattern, t.lower().decode())]
            assert [w.word(j) for j in range(w.first[i], w.first[i + 1])] == want


def test_line_dedup_brute_force(odd, empty):
    data = [(r.doc_id, r.text or "") for r in odd.collect()]
    holders = collections.defaultdict(list)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    for i, t in data:
        for k in {key(x) for x in t.split("\n")}:
            if len(k) >= 40:
                holders[k].append(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    want = []
    for i, t in data:
        lines = t.split("\n")
        kept = [x for x in lines if key(x) not in gone or gone[key(x)] == i]
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    assert rows_of(line_dedup.dedup_lines(odd, batches=5, fan=2)) == sorted(want, key=repr)
    assert gone and line_dedup.dedup_lines(empty).count() == 0


def test_decontaminate_blocks_and_modes(spark, odd, empty):
    bench = spark.createDataFrame([(1, LINE), (2, "cc by"), (None, "rights reserved"), (4, None), (5, "")], "item_id long, text string")
    one = decontaminate.scan(odd, bench, n=4).select("doc_id", "__n_words", "__spans", "__items")
    many = decontaminate.scan(odd, bench, n=4, max_windows=2).select("doc_id", "__n_words", "__spans", "__items")
    assert rows_of(one) == rows_of(many)
    left = decontaminate.decontaminate(odd, bench, n=4)
    assert left.columns == odd.columns and left.count() == sum(not r["__items"] for r in one.collect())
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(odd, bench, n=4, mode="cut").collect()}
    assert cut[11] == "   and \nALL . general public license" and cut[0] is None
    assert decontaminate.scan(empty, bench).count() == 0
    assert decontaminate.decontaminate(odd, bench.limit(0)).count() == odd.count()


def test_exact_dedup_brute_force(spark, odd, empty):
    long = [(1000 + i, "y" * 70_000 + ("z" if i % 2 else "q") + " " * (i % 3), None, None, None) for i in range(6)]
    docs = odd.unionByName(spark.createDataFrame(long, SCHEMA))
    strip = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    groups = collections.defaultdict(list)
    for r in docs.collect():
        groups[strip(r.text)].append((-len(r.text or ""), r.doc_id is None, r.doc_id))
    want = [(m[2], hashlib.sha256(k.encode()).hexdigest(), min(v)[2], len(v)) for k, v in groups.items() for m in v]
    assert rows_of(exact_dedup.classes(docs)) == sorted(want, key=repr)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and len({(r.doc_id, r.text) for r in kept.collect()}) == len(groups)
    assert exact_dedup.classes(empty).count() == 0


def _jaccard_brute(data, k, p, q):
    sets = {}
    for i, t in data:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j:j + min(k, len(w))]) for j in range(len(w) - min(k, len(w)) + 1)} if w else set()
    root = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if sets[a] and sets[b] and q * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return {i: (len(sets[i]), root[i]) for i in ids}


@pytest.mark.parametrize("p,k", [(90, 3), (80, 5)])
def test_jaccard_brute_force_and_large_groups(spark, odd, empty, p, k):
    r = np.random.default_rng(p)
    base, rows = [f"w{r.integers(400)}" for _ in range(80)], []
    for i in range(90):
        words = list(base) if i % 3 else [f"v{r.integers(60)}" for _ in range(int(r.integers(1, 60)))]
        for _ in range(int(r.integers(0, 5))):
            words[int(r.integers(len(words)))] = f"n{r.integers(1000)}"
        rows.append((1000 + i, " ".join(words), None, None, None))
    docs = odd.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(spark.createDataFrame(rows, SCHEMA))
    want = _jaccard_brute([(x.doc_id, x.text) for x in docs.collect()], k, p, 100)
    for options in ({}, {"group_shingles": 500, "block": 4}):
        got = jaccard.jaccard_components(docs, k=k, p=p, **options)
        assert {x.id: (x.n_shingles, x.component_id) for x in got.collect()} == want
    assert jaccard.jaccard_components(empty).count() == 0
    assert jaccard.jaccard_components(odd).count() == odd.count()


def test_token_counts_equal_the_library(odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(((r.doc_id, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids))
                   for r in odd.collect()), key=repr)
    for options in ({}, {"chunk": 64, "overlap": 4}):
        assert rows_of(token_count.token_counts(odd, "byte_bpe_50k.json", **options)) == want
    assert token_count.token_counts(empty, "byte_bpe_50k.json").count() == 0


def test_license_scan_brute_force(odd, empty):
    import regex
    got = {r.id: r for r in license_scan.scan(odd).collect()}
    for r in odd.collect():
        w = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").encode().lower().decode())
        places = sorted((i, label) for p, label in license_scan.BASE.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split())
        assert got[r.doc_id].n_words == len(w)
        assert sorted((x["start"], x["label"]) for x in got[r.doc_id].places if x["base"]) == places
    assert license_scan.scan(empty).count() == 0


def test_license_notice_with_a_changed_word(spark):
    docs = spark.createDataFrame([(1, "x y Redistribution and use in both source and binary forms, with or without modification, are permitted z")],
                                 "doc_id long, text string")
    assert [p["label"] for p in license_scan.scan(docs).first().places] == ["bsd"]


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev, row = row, [0]
        for j, y in enumerate(b):
            row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[j]))
    return row[-1]


def test_license_notices_with_every_admissible_change(spark):
    """Each number of replaced, left out and added words, spread and in one place, against all spans of all notices."""
    r, texts = np.random.default_rng(3), []
    for notice in license_scan.NOTICES:
        w = notice.split()
        n = len(w)
        for m in range(n // 5 + 2):
            for left_out in (False, True):
                for e in range((n - m) // 4 + 2 if left_out or not m else 1):
                    for spread in (False, True):
                        out = list(w)
                        at = r.choice(np.arange(1, n - 1, 2), min(m, (n - 1) // 2), replace=False) if spread else np.arange(1, m + 1)
                        for i in at:
                            out[i] = None if left_out else f"q{i}"
                        for i in r.choice(np.arange(1, n), e, replace=False) if spread else [n // 2] * e:
                            out[i] = f"q z{i} {out[i] or ''}".replace("q z", "z")
                        texts.append(" ".join(["a b c", *[x for x in out if x], "d e f"]))
    texts += ["licensed under the creative commons attribution 3 0 international license", "released under an mit license",
              "released under the mit license and then released under the old mit license"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.id: x.places for x in license_scan.scan(docs).collect()}
    for i, t in enumerate(texts):
        w, best = t.split(), 0
        for notice in license_scan.NOTICES:
            p = notice.split()
            for a in range(len(w)):
                for z in range(a + 1, min(len(w), a + len(p) + len(p) // 4) + 1):
                    best = max(best, _lcs(w[a:z], p) / max(len(p), z - a))
        notices = [x["share"] for x in got[i] if not x["base"]]
        assert max(notices, default=0) == (best if best >= license_scan.SHARE else 0), t
    assert [(x["label"], x["start"], x["end"]) for x in got[len(texts) - 1]] == [("mit", 0, 5), ("mit", 7, 13)]


def test_elias_fano_successor(tmp_path):
    r = np.random.default_rng(3)
    for n, top in ((0, 10), (1, 5), (500, 600), (2000, 1 << 40), (300, (1 << 64) - 1)):
        v = np.unique(r.integers(0, top, n, dtype=np.uint64, endpoint=True))
        path = str(tmp_path / f"{n}")
        elias_fano.write_levels(path, {"v": elias_fano.EliasFano.build(v)}, {"x": np.arange(3)})
        e = elias_fano.map_levels(path)[0]["v"]
        q = np.concatenate([v, r.integers(0, top, 500, dtype=np.uint64, endpoint=True)])
        at, same = e.successor(q)
        assert (same == np.isin(q, v)).all() and (at[same] == np.searchsorted(v, q[same])).all()


def test_sentence_pieces_are_lossless_reproducible_and_drawn_in_proportion(odd, empty):
    name = "piece_bpe_32k.model"
    enc = sentence_pieces.encode(odd, name)
    rows = enc.collect()
    assert all(r.lossless or r.text is None for r in rows)
    back = sentence_pieces.decode(enc, name).collect()
    assert all(r.decoded == r.text for r in back)
    again = {r.doc_id: r.ids for r in sentence_pieces.encode(odd.repartition(3), name).collect()}
    assert all(again[r.doc_id] == r.ids for r in rows)
    m, n = sentence_pieces.model(name), 20_000
    piece = {m.bytes_of[int(i)].decode(): (int(i), w) for _, ids, weights, _ in m.tables.values() for i, w in zip(ids, weights)}

    def all_ways(s):
        return [((), 0.0)] if not s else [((piece[s[:j]][0], *t), piece[s[:j]][1] + w)
                                          for j in range(1, len(s) + 1) if s[:j] in piece for t, w in all_ways(s[j:])]
    ways = all_ways(" then")
    total = sum(math.exp(w) for _, w in ways)
    seen = collections.Counter(tuple(x.tolist()) for x in m.sample(["then"] * n, np.arange(n).astype(np.uint64)))
    assert max(abs(seen[t] / n - math.exp(w) / total) for t, w in ways) < 0.02
    assert sentence_pieces.encode(empty, name).count() == 0


@pytest.mark.parametrize("module,label,name,cut,least", [(toxicity, "toxic", "op6_toxicity", 0.5, 0.9), (quality, "quality", "op1_quality", 0.3, 0.9)])
def test_classifiers(spark, odd, empty, module, label, name, cut, least):
    sf = "/root/testdata/sf0.1"
    got = E.queries()[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r[label] for r in got) >= least * len(got)
    assert all(r.predicted == int(r.score >= cut) and 0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    model = module.fit(odd, none)
    assert all(0 <= r.s <= 1 for r in module.score(odd, model, name="s").collect())
    assert module.score(empty, model, name="s").count() == 0


def test_toxicity_thresholds_at_the_true_class_shares(spark):
    """Half the toxic rows read as a fifth of the clean ones do: likely toxic in a balanced sample, clean in the whole table."""
    clean, mixed, toxic = "the cat and the dog of rain", "the grey moor of the fog", "the vile scum of the slime"
    texts = [mixed if i % 5 == 0 else clean for i in range(2000)] + [mixed if i % 2 else toxic for i in range(200)]
    docs = spark.createDataFrame([(i, f"{t} z{i}") for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 2000)) for i in range(2200)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, per_class=120)
    share = lambda t: (model.scores([f"{t} y{i}".encode() for i in range(100)]) >= 0.5).mean()
    assert share(clean) < 0.05 and share(mixed) < 0.05 and share(toxic) > 0.95


def test_long_and_missing_documents_use_up_no_sample(spark):
    """Nine of ten clean rows are too long for the sample or have no document; the others must fill it."""
    docs = spark.createDataFrame([(i, f"row {i} " + "long " * (300 if i % 10 else 0)) for i in range(600) if i % 10 != 1],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 400)) for i in range(600)], "doc_id long, toxic int")
    got = sampling.labelled_texts(docs, labels, "toxic", 12, 1000)
    assert [sum(y == k for _, y in got) for k in (0, 1)] == [12, 12] and all(len(t) <= 1000 for t, _ in got)


def test_without_a_classifier_no_document_goes(spark, odd):
    for y in (0, 1):
        labels = spark.createDataFrame([(i, y) for i in range(len(ODD))], "doc_id long, toxic int")
        left = toxicity.without_toxic(odd, labels)
        assert left.columns == odd.columns and left.count() == odd.count()


def test_quality_tells_words_apart_in_one_layout():
    """Good and bad rows of equal word lengths and signs, which differ in their words only."""
    r = np.random.default_rng(4)
    vocab = [["".join(chr(97 + c) for c in r.integers(26, size=5)) for _ in range(30)] for _ in (0, 1)]
    make = lambda y, n: [" ".join(r.choice(vocab[y], 20)) + "." for _ in range(n)]
    model = quality.Neighbours([(t, y) for y in (0, 1) for t in make(y, 150)], 0.5)
    good, bad = (model.scores([t.encode() for t in make(y, 50)]) for y in (1, 0))
    assert (good >= 0.5).mean() > 0.95 and (bad < 0.5).mean() > 0.95


def test_pipeline_matches_stagewise_brute_force(spark):
    import corpus_pipeline
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.toxicity(spark, docs, SF).collect()
    best = {}
    for r in kept:
        k = "".join(c for c in r.text if c not in " \t\n\x0b\x0c\r")
        best[k] = min(best.get(k, (1, 0, 0)), (-len(r.text), r.doc_id, r.text))
    data = [(i, t) for _, i, t in best.values()]
    root = _jaccard_brute(data, 5, 80, 100)
    data = [(i, t) for i, t in data if root[i][1] == i]
    import regex
    words = lambda t: regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.encode().lower().decode())
    wins = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        wins |= {tuple(w[i:i + 10]) for i in range(len(w) - 9)} if len(w) >= 10 else {tuple(w)} if w else set()
    sizes = {len(x) for x in wins}
    clean = {i for i, t in data for w in [words(t)] if not any(tuple(w[j:j + n]) in wins for n in sizes for j in range(len(w) - n + 1))}
    assert set(got) == clean and all(r.lossless for r in got.values())


def test_a_part_links_what_it_connects_once(spark):
    """40 documents, neighbours nearly alike: 39 links connect them, however many hashes they share with whom."""
    words = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(i, " ".join(words[2 * i:2 * i + 300])) for i in range(40)], "doc_id long, text string")
    links = jaccard.candidate_links(docs, "doc_id", "text", 3, jaccard.Threshold(80, 100), 1).collect()
    assert len(links) == 39 and {r["a"] for r in links} == {0} and {r["b"] for r in links} == set(range(1, 40))


def test_spanned_links_keep_components():
    rng = np.random.default_rng(3)
    links = np.concatenate([rng.integers(0, 300, (250, 2)), [[900, 900], [7, 7]]])
    root = {int(v): int(v) for v in np.unique(links)}
    for _ in range(300):
        for a, b in links.tolist():
            root[a] = root[b] = min(root[a], root[b])
    want = sorted((r, v) for v, r in root.items() if r != v)
    assert sorted(map(tuple, jaccard.spanned(links).tolist())) == want
    assert jaccard.spanned(np.empty((0, 2), np.int64)).shape == (0, 2)
