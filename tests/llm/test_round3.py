"""Fingerprints, whitening and fill-in-middle against brute force, over odd rows; bounds of the other operators on
repeated rows, broken pages and long runs."""

import base64
import hashlib
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vacantia.llm import fim, html_text, jaccard, minhash, quality, registry, secrets, suffix_dedup, whitening

ODD = [(3, "alpha beta gamma delta epsilon zeta"), (1, None), (2, ""), (None, "a null id with a few words in it"), (5, "tie " * 40), (5, "tie " * 40), (5, "another text of the same id"), (4, "Ünïcode 😀 wörds ÀÉ and a tail"), (7, "<P>marked</P> text"), (9, "x"), (8, "abc"), (6, "long word " * 3000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in ODD], "doc_id long, text string, n string, form int").repartition(3)


def words(t):
    own = re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else set()


def similar(a, b):
    a, b = words(a), words(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def op11(spark, folder, rows, schema="doc_id long, text string"):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return minhash.op11(spark, folder).collect()


def test_fingerprints_of_odd_rows(spark, tmp_path):
    got = op11(spark, str(tmp_path), ODD)
    assert len(got) == len(ODD)
    # Order: null ids first, then ids, equal ids by a hash; so the texts of id 5 may follow each other either way.
    chains = []
    for tail in ([1, 1, 2], [2, 1, 1]):
        five = {1: "tie " * 40, 2: "another text of the same id"}
        chain = [(None, ODD[3][1]), (1, ""), (2, ""), (3, ODD[0][1]), (4, ODD[7][1])] + [(5, five[k]) for k in tail] + [(6, ODD[11][1]), (7, ODD[8][1]), (8, "abc"), (9, "x")]
        chains.append(sorted((i is not None, i or 0, len(t), hashlib.sha256((t[: len(t) - len(t) // 4] + chain[(k + 1) % len(chain)][1][: len(t) // 4]).encode()).hexdigest()) for k, (i, t) in enumerate(chain)))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256) for r in got) in chains
    by = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) == 2 * minhash.PLACES
        by.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
    assert all(len(f) == 1 for f in by.values()) and by[(1, 0)] == by[(2, 0)]
    assert {(r.doc_id, r.n_chars): r.n_links for r in got}[(5, 160)] == 1


def test_fingerprints_tell_likeness(spark, tmp_path):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(150, 400))) for _ in range(60)]
    for k in range(0, 60, 6):  # near copies: a few words differ
        own = texts[k].split()
        own[rng.randrange(len(own))] = "changed"
        texts[k + 3] = " ".join(own)
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in op11(spark, str(tmp_path), rows)}
    for i, t in rows:
        after = texts[(i + 1) % 60]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(got[i].near_edited - similar(t, edited)) < 0.2 and got[i].near_edited > got[i].near_next + 0.2
        assert got[i].component_id == min(k for k in range(60) if similar(t, texts[k]) >= 0.8)
        assert got[i].n_links == sum(similar(t, texts[k]) >= 0.8 for k in range(60) if k != i)


def test_signatures():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:600], rng.integers(0, 1 << 63, 400, dtype=np.uint64)]))
    agree = np.mean(minhash.signature(a) == minhash.signature(b))
    assert abs(agree - 600 / (len(a) + len(b) - 600)) < 0.15
    assert (minhash.signature(a)[:64] == minhash.signature(a, 64)).all()
    assert minhash.fingerprint(minhash.signature(a[:0])) == minhash.EMPTY and minhash.likeness(minhash.EMPTY, minhash.fingerprint(minhash.signature(a))) == 0
    one = minhash.bands(minhash.signature(a))
    assert len(set(one.tolist())) == minhash.BANDS and (one == minhash.bands(minhash.signature(a[::-1]))).all()


def test_neighbours_over_many_ranges(spark, monkeypatch):
    """Ranges of one row, ranges without rows, and the last row's way back to the first."""
    monkeypatch.setattr(minhash, "RANGE_BYTES", 8)
    rows = [(i * i, f"text number {i} of several words") for i in range(17)]
    got = {r.doc_id: bytes(r.edited_sha256).hex() for r in minhash.neighbours(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % 17][1]
        assert got[i] == hashlib.sha256((t[: len(t) - len(t) // 4] + after[: len(t) // 4]).encode()).hexdigest()
    alone = minhash.neighbours(spark.createDataFrame([(1, "only one text")], "doc_id long, text string")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1
    assert minhash.neighbours(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shingles_of_few_words():
    assert [len(s) for s in jaccard.shingles([b"one two", b"", b"three"], 5)] == [1, 0, 1]
    assert [len(s) for s in jaccard.shingles([b"a b c"], 5)] == [1]


def whitened(x, k):
    """By the covariance itself: components, values and figures of the distinct vectors."""
    fit = np.unique(x, axis=0)
    mean = fit.astype(object).sum(0)
    centred = np.array([[float(v) for v in row] for row in (fit.astype(object) * len(fit) - mean) / len(fit)])
    cov = centred.T @ centred / len(fit)
    e, u = np.linalg.eigh(cov)
    return len(fit), mean, e[::-1][:k], u[:, ::-1][:, :k], np.trace(cov)


def check_whitening(spark, vectors, k=16):
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, component int").repartition(3)
    model = whitening.fit(whitening.whole(frame), k)
    rows = whitening.whiten(whitening.whole(frame), model).collect()
    good = [(i, [np.float64(np.float32(c)) for c in v]) for i, v, _ in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in good])
    n, sums, e, u, trace = whitened(x, k)
    keep = e > 1e-11 * max(e[0], 0) if len(e) else []
    assert model.n == n and list(model.sums) == list(sums) and np.allclose(model.values, e[keep], rtol=1e-9)
    assert model.trace == pytest.approx(trace, rel=1e-12) and model.identity_error < 1e-6 and (model.residuals <= 1e-12 * e[0]).all()
    want = Counter()
    for (i, _), row in zip(good, x.tolist(), strict=True):
        want[(i, sum((n * a - int(s)) ** 2 for a, s in zip(row, sums, strict=True)))] += 1
    assert Counter((r.id, r.deviation) for r in rows) == want
    return model, rows, x, (n, sums, e[keep], u[:, keep]), good


def test_whitening_against_the_covariance(spark):
    rng = np.random.default_rng(5)
    basis = rng.normal(size=(40, 40)) * (1.15 ** -np.arange(40))[None, :]
    vectors = [(int(i), [float(c) for c in v], 0) for i, v in enumerate(rng.normal(size=(300, 40)) @ basis.T)]
    vectors += [vectors[0]] * 200 + [(None, vectors[1][1], 0), (9000, None, 0), (9001, [None] * 40, 0), (9002, [float("nan")] * 40, 0), (9003, [float("inf")] * 40, 0), (9004, [1.0, 2.0], 0), (9005, [], 0)]
    good_lengths = [v for v in vectors if v[1] is None or len(v[1]) == 40]
    model, rows, x, (n, sums, e, u), good = check_whitening(spark, good_lengths)
    by = {(r.id, r.deviation): np.array(r.whitened) for r in rows}
    for (i, _), row in zip(good[:50], x[:50].tolist(), strict=True):
        d = sum((n * a - int(s)) ** 2 for a, s in zip(row, sums, strict=True))
        want = np.array([a - int(s) / n for a, s in zip(row, sums, strict=True)]) @ u / np.sqrt(e)
        assert np.allclose(np.abs(by[(i, d)]), np.abs(want), atol=1e-6)
    # Vectors of other lengths take no part.
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, component int")
    again = whitening.fit(whitening.whole(frame))
    assert again.n == model.n and np.allclose(again.values, model.values)


def test_whitening_of_flat_and_poor_spectra(spark):
    rng = np.random.default_rng(6)
    flat = [(i, [float(c) for c in v], 0) for i, v in enumerate(rng.normal(size=(500, 100)))]
    model, *_ = check_whitening(spark, flat, 8)  # hardly a gap: the block has to widen
    assert model.passes < 60
    few = [(i, [float(c) for c in v], 0) for i, v in enumerate(rng.normal(size=(4, 30)))]
    model, *_ = check_whitening(spark, few)
    assert len(model.values) == 3  # four vectors span three directions
    same = spark.createDataFrame([(1, [0.5] * 5), (2, [0.5] * 5)], "vec_id long, embedding array<float>")
    model = whitening.fit(whitening.whole(same))
    assert model.n == 1 and not len(model.values) and whitening.whiten(whitening.whole(same), model).first().deviation == 0
    assert whitening.fit(whitening.whole(same.limit(0))) is None


def test_deviations_beyond_64_bits():
    x = np.array([[1 << 52, -(1 << 52)], [0, 0]])
    sums = np.array([1 << 52, -(1 << 52)], object)
    d = whitening.deviations(x, 1 << 20, sums)
    assert int(d[0, 0]) == (1 << 72) - (1 << 52) and whitening.squares(d)[0] is None
    assert whitening.squares(np.array([[3, 4]])) == [25]


def restored(form, out):
    if form == "plain":
        return out
    pieces = re.split("<[PSM]>", out)
    return pieces[1] + pieces[3] + pieces[2] if form == "psm" else pieces[2] + pieces[3] + pieces[1]


def test_fill_in_middle_of_odd_rows(spark, odd):
    got = fim.transform(odd).withColumn("back", fim.restored()).collect()
    assert Counter((r.doc_id, r.text, r.n, r.form) for r in got) == Counter((i, t, "x", 1) for i, t in ODD)
    for r in got:
        t = r.text or ""
        h = [int(hashlib.sha256(f"1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[k : k + 8], 16) for k in (0, 8, 16, 24)]
        a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
        form = "plain" if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        out = {"plain": t, "psm": f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", "spm": f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"}[form]
        assert (r.__fim_n if hasattr(r, "__fim_n") else r["__fim_n"], r["__fim_form"], r["__fim_output"]) == (len(t), form, out)
        assert (r["__fim_prefix"], r["__fim_middle"]) == ((None, None) if form == "plain" else (a, b - a))
        assert r["back"] == t == restored(r["__fim_form"], r["__fim_output"])


def test_fill_in_middle_of_words(spark):
    """Another unit: words with what follows them; marks that could be read in two ways are refused."""
    rows = [(i, " ".join(f"w{k}" for k in range(i))) for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = fim.transform(frame, unit=r"\S+", transformed=100).withColumn("back", fim.restored()).collect()
    assert all(r["__fim_n"] == r.doc_id and r.back == r.text for r in got)
    for r in got:
        if r["__fim_form"] != "plain":
            cuts = [m.start() for m in re.finditer(r"\S+", r.text)] + [len(r.text)]
            assert r["__fim_prefix"] in cuts and r["__fim_prefix"] + r["__fim_middle"] in cuts
    with pytest.raises(ValueError):
        fim.transform(frame, marks=("<P>", "<P><S>", "<M>"))
    with pytest.raises(ValueError):
        fim.transform(frame, marks=("aba", "S", "M"))
    with pytest.raises(ValueError):
        fim.transform(frame, unit=r"\S*")


def test_two_passes_hold_no_units():
    import tracemalloc

    text = "ab😀 " * 500_000
    unit = re.compile(fim.CODE_POINT)
    tracemalloc.start()
    assert fim.n_units(unit, text) == len(text)
    assert fim.ends(unit, text, 700_000, 1_300_000) == (700_000, 1_300_000)
    assert tracemalloc.get_traced_memory()[1] < 1 << 16
    tracemalloc.stop()
    assert fim.ends(unit, "abc", 3, 3) == (3, 3) and fim.ends(unit, "abc", 0, 3) == (0, 3) and fim.ends(unit, "", 0, 0) == (0, 0)


@pytest.mark.parametrize("name", ["op11_fingerprints", "op12_whitening", "op13_fill_in_middle"])
def test_queries_over_a_whole_small_table(spark, name):
    folder = "/root/testdata/sf0.001"
    rows = registry.queries()[name](spark, folder).collect()
    con = duckdb.connect()
    table, key = ("embeddings", "vec_id") if "12" in name else ("documents", "doc_id")
    ids = Counter(r[0] for r in con.sql(f"SELECT {key} FROM '{folder}/{table}.parquet'").fetchall())
    assert Counter(r[key] for r in rows) == (Counter({i: 16 * n for i, n in ids.items()}) if "12" in name else ids)


@pytest.mark.parametrize("piece", ["<a ", '<p a="', "<!--", "<!-- x>", "<![CDATA[ x>", "<![foo x>", "</a", "<b>", "<p><table><font>", "</b><b></i>"])
def test_broken_pages_are_read_in_linear_time(piece):
    page = "<p>Kept text</p>" + piece * (1_000_000 // len(piece))
    began = time.perf_counter()
    found = html_text.blocks(page)
    assert time.perf_counter() - began < 20 and found[0][2] == "Kept text"


def test_the_labelled_sample_is_bounded_by_rows(spark):
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    docs = docs.union(spark.range(3000).select(F.lit(1).cast("long"), F.lit("the same text"))).union(spark.range(3, 400).select("id", F.lit("alike")))
    labels = spark.range(1, 400).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    for size in (50, 1000):
        sample = quality.labelled_sample(docs, labels, size=size)
        assert 0 < sample.count() <= size and sample.count() == sample.select("place", "mark").distinct().count()


def test_one_row_of_an_owner_is_cut(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    text = " ".join(f"w{rng.randrange(900)}" for _ in range(300))
    near = text[:700] + " changed " + text[700:]
    seen = []
    cut = suffix_dedup.common.cut
    monkeypatch.setattr(suffix_dedup.common, "cut", lambda frame, name, *more: seen.append((name, cut(frame, name, *more))) or seen[-1][1])
    got = suffix_dedup.remove_repeats(spark.createDataFrame([(1, text)] * 400 + [(2, near)], "doc_id long, text string"))
    assert got.count() == 401
    assert dict((n, f.count()) for n, f in seen if n == "held") == {"held": 2}


def test_long_runs_are_scored_within_bounds():
    blob = base64.b64encode(random.Random(5).randbytes(300_000)).decode()
    net = secrets.trained()
    import tracemalloc

    tracemalloc.start()
    (batch,) = secrets._scan(iter(pa.table({"doc_id": [1], "text": ["see " + blob]}).to_batches()), net, ["doc_id"], 1)
    assert tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()
    assert "learned:4:" in batch.column(5)[0].as_py()
    inside = [w for a, b in secrets.candidates(blob, []) for w in secrets.windows(a, b)]
    assert len(inside) < len(blob) / secrets.STRIDE + 2
