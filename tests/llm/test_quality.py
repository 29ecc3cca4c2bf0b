import base64
import collections
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import zstandard
from murmur.llm import compression, importance, language
from pyspark.sql import functions as F


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


def verdict(text, bands):
    """Base verdict and verdict by plain loops: whole ratio, every chunk with the tail, share and run of bad chunks."""
    n_words, _, _, _, again = base(text)
    raw = text.encode()
    packer = zstandard.ZstdCompressor(level=compression.LEVEL, write_content_size=False, write_checksum=False)
    if n_words < 50 or 100 * again > 50 * n_words:
        return True, False
    own = [(low, high) for size, low, high in bands.whole if len(raw) >= size]
    ratio = len(packer.compress(raw)) / len(raw)
    ok = not own or own[-1][0] is None or own[-1][0] <= ratio <= own[-1][1]
    k = compression.CHUNK_BYTES
    parts = [raw[i:i + k] for i in range(0, len(raw), k)]
    if len(parts) > 1 or len(raw) == k:
        parts = [x if len(x) == k else raw[-k:] for x in parts]
    else:
        parts = []
    bad = [not bands.chunk[0] <= len(packer.compress(x)) / k <= bands.chunk[1] for x in parts]
    run = max((len(list(g)) for flag, g in itertools.groupby(bad) if flag), default=0)
    return False, ok and sum(bad) <= compression.CHUNK_SHARE * len(bad) and run < compression.CHUNK_RUN


def brute_bands(texts, good):
    """The outer quantiles of the good texts' ratios, by numpy over lists."""
    packer = zstandard.ZstdCompressor(level=compression.LEVEL, write_content_size=False, write_checksum=False)
    k, by = compression.CHUNK_BYTES, collections.defaultdict(list)
    for d, t in texts:
        raw = t.encode()
        if d not in good or verdict(t, compression.Bands((), (0.0, 9.0)))[0]:
            continue
        kinds = [c for c in compression.CLASSES if len(raw) >= c]
        if kinds:
            by[kinds[-1]].append(len(packer.compress(raw)) / len(raw))
        starts = list(range(0, len(raw) - k + 1, k)) + ([len(raw) - k] if len(raw) > k and len(raw) % k else [])
        by[0] += [len(packer.compress(raw[i:i + k])) / k for i in starts]

    def ends(x):
        q = np.quantile(np.round(np.array(x), 4), [compression.OUTSIDE, 1 - compression.OUTSIDE])
        return q[0] - compression.MARGIN, q[1] + compression.MARGIN

    least = compression.LEAST_RATIOS
    return compression.Bands(tuple((c, *(ends(by[c]) if len(by[c]) >= least else (None, None))) for c in compression.CLASSES),
                             ends(by[0]) if len(by[0]) >= least else (0.0, float("inf")))


def check_rules(df, labels=None, bands=None):
    texts = [(r.doc_id or 0, r.text or "") for r in df.select("doc_id", "text").collect()]
    if bands is None:
        bands = compression.learn_bands(compression.measured(df), labels)
    want = sorted((d, *base(t), *verdict(t, bands)) for d, t in texts)
    got = sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)
                 for r in compression.quality_rules(df, labels).collect())
    assert got == want
    return got


def tables(spark, sf):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")


def test_rules_equal_brute_force(spark):
    for sf in ("sf0.001", "sf0.01"):
        kept = [r[-1] for r in check_rules(*tables(spark, sf))]
        assert any(kept) and not all(kept)


def test_rules_on_edge_rows_and_noise(spark, edge, none):
    wide = compression.Bands(tuple((c, None, None) for c in compression.CLASSES), (0.3, 0.7))
    check_rules(edge)
    rnd = random.Random(1)
    noise = "".join(chr(rnd.randrange(33, 0x2FFF)) + (" " if i % 7 == 0 else "") for i in range(4000))
    repeat = " ".join(f"{i % 3}ab {i}" for i in range(20)) + "\n" + " ".join("same words here" for _ in range(900))
    got = compression.quality_rules(spark.createDataFrame([(1, noise), (2, repeat)], "doc_id long, text string"), bands=wide).collect()
    assert [r.kept for r in got] == [False, False]
    assert compression.quality_rules(none).count() == 0 and compression.quality_rules(none, none.select("doc_id")
        .withColumn("quality", F.lit(1)).withColumn("toxic", F.lit(0))).count() == 0


def test_bands_are_learned_from_the_given_labels(spark):
    docs, labels = tables(spark, "sf0.01")
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic}
    measures = compression.measured(docs)
    for own, ids in ((labels, good), (None, {d for d, _ in texts}), (labels.filter("toxic = 1"), {d for d, _ in texts})):
        got, want = compression.learn_bands(measures, own), brute_bands(texts, ids)
        assert [x[0] for x in got.whole] == [x[0] for x in want.whole]
        for a, b in zip([*(x[1:] for x in got.whole), got.chunk], [*(x[1:] for x in want.whole), want.chunk]):
            assert (a[0] is None) == (b[0] is None) and (a[0] is None or np.allclose(a, b, atol=2e-4))


def test_bands_reject_low_quality_and_keep_good_documents(spark):
    docs, labels = tables(spark, "sf0.1")
    rows = compression.quality_rules(docs, labels).join(labels, "doc_id").filter("not base_failed").select("quality", "toxic", "kept").collect()
    good = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    low = [r.kept for r in rows if r.quality == 0 and r.toxic == 0]
    assert len(good) > 2000 and sum(good) / len(good) > 0.98
    assert len(low) > 200 and low.count(False) / len(low) > 0.5


def test_long_texts_in_pieces_count_alike(spark):
    rnd = random.Random(4)
    lines = [" ".join(rnd.choice(["ab", "c#d", "é\u2003x", "same", "$", "z" * 50]) for _ in range(rnd.randrange(0, 30))) for _ in range(300)]
    for text in ("\n".join(lines + lines[:40]), "word " * 400, "x" * 5000, "\n" * 3000 + "a\n a\na"):
        raw = text.encode()
        whole = compression.base_features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        for step in (64, 700):
            got = compression.long_features(raw, step)
            assert {k: int(v[0]) for k, v in got.items()} == {k: int(v[0]) for k, v in whole.items()}
            df = spark.createDataFrame([(1, text)], "doc_id long, text string")
            row = compression.measured(df, step=step).first()
            assert row.n_words == whole["n_words"][0] and row.n_repeat_words == whole["n_repeat_words"][0]


def test_noise_anywhere_in_a_text_is_found(spark):
    long = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("lang = 'en'").join(
        spark.read.parquet("/root/testdata/sf0.1/labels.parquet").filter("quality = 1 and toxic = 0"), "doc_id", "left_semi")
    prose = " ".join(r.text for r in long.orderBy("doc_id").limit(400).collect())
    assert len(prose) > 450_000
    rnd = random.Random(3)

    def noise(n):
        return base64.b64encode(rnd.randbytes(n)).decode()[:n]

    def mixed(before, bad, after=0):
        return prose[:before] + noise(bad) + prose[before:before + after]

    k = compression.CHUNK_BYTES
    bad = [mixed(900, 3000), mixed(1000, 900), mixed(2100, 1900), mixed(12_000, 8000), mixed(5 * k, 1500), mixed(60_000, 4 * k, 60_000),
           mixed(222_000, 3 * k, 222_000)]
    rows = spark.createDataFrame(list(enumerate([*bad, prose[:1900], prose[:7 * k], prose[:7 * k + 1500]])), "doc_id long, text string")
    bands = compression.learn_bands(compression.measured(tables(spark, "sf0.1")[0]), tables(spark, "sf0.1")[1])
    got = {r.doc_id: r for r in compression.quality_rules(rows.coalesce(1), bands=bands).collect()}
    for i in range(len(bad)):
        assert not got[i].kept, got[i]
    assert [got[i].chunks_in_band for i in (len(bad), len(bad) + 1, len(bad) + 2)] == [True] * 3
    assert [got[i].n_chunks for i in (len(bad), len(bad) + 1, len(bad) + 2)] == [0, 7, 8]
    assert got[4].high_chunks == 1 and got[6].bad_run >= 2 and not got[6].chunks_in_band
    assert got[6].high_chunks + got[6].low_chunks <= compression.CHUNK_SHARE * got[6].n_chunks


# ---------------------------------------------------------------- language
def test_rare_ngrams_of_a_very_long_text_stay_in_the_profile(spark):
    text = "abc" * 800_000 + " xyz"
    got = language.profiles(spark.createDataFrame([(text, "a")], "text string, lang string"), "text", "lang")["a"]
    grams, counts = language.gram_counts([text], language.letter_table())
    exact = (counts[0] / counts[0].sum()) @ language.gram_vectors(grams).astype(float)
    assert counts[0].sum() > 1 << 21 and (counts[0] == 1).any()
    assert np.abs(got / language.WEIGHT - exact).max() < 1e-7


def test_languages_are_told_apart_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 200
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_profile_of_one_text_is_its_sum_of_products():
    letters = language.letter_table()
    grams, counts = language.gram_counts(["Abá cab"], letters)
    stream = " abá cab "
    want = collections.Counter(stream[i:i + 3] for i in range(len(stream) - 2))
    text = {"".join(chr(g >> (21 * j) & 0x1FFFFF) for j in range(3)): int(c) for g, c in zip(grams.tolist(), counts[0].tolist())}
    assert text == dict(want)
    vec = language.gram_vectors(grams)
    one = {c: language.letter_vectors(np.array([ord(c)]))[0].astype(int) for c in set(stream)}
    for g, v in zip(grams.tolist(), vec):
        s = [chr(g >> (21 * j) & 0x1FFFFF) for j in range(3)]
        assert (v == one[s[0]] * np.roll(one[s[1]], 1) * np.roll(one[s[2]], 2)).all()


def plain_grams(text):
    stream = " " + re.sub(r" +", " ", "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")).strip() + " "
    return collections.Counter(stream[i:i + 3] for i in range(len(stream) - 2)) if stream.strip() else collections.Counter()


def test_long_texts_are_counted_by_grams_in_pieces():
    letters, rnd = language.letter_table(), random.Random(9)
    text = "".join(rnd.choice(["ab ", "é", "Σ ", "1 2  ", "日本", "\n", "-", "don't "]) for _ in range(1500))
    for t in (text, "a b c d e f g", " 1 2 3 ", "x" * 40 + " y"):
        for piece in (1, 7, 100, 1 << 20):
            grams, counts = language.slice_gram_counts([t], letters, piece)
            got = {"".join(chr(g >> (21 * j) & 0x1FFFFF) for j in range(3)): int(c) for g, c in zip(grams.tolist(), counts[0].tolist()) if c}
            assert got == dict(plain_grams(t))


def test_predictions_equal_plain_loops(spark):
    """Profiles of several languages, cosines and ties, by loops over letters."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate([
        ("the cat sat on the mat", "en"), ("the dog and the fog", "en"), ("der hund und die katze", "de"), ("das ist der mann", "de"),
        ("le chat est sur la table", "fr"), ("la vie est belle", "fr"), ("same words", "aa"), ("same words", "zz"), ("the end", None), ("hund", None),
        ("chat la", None), ("same words", None), ("123", "en"), (None, "de"), ("", None), ("q", None)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    vec = {}

    def letter(c):
        if c not in vec:
            vec[c] = language.letter_vectors(np.array([ord(c)]))[0].astype(int)
        return vec[c]

    def bundle(grams, weight=lambda n: n):
        return sum((weight(n) * letter(g[0]) * np.roll(letter(g[1]), 1) * np.roll(letter(g[2]), 2) for g, n in grams.items()), np.zeros(language.SIZE, int))

    import zlib

    profile = collections.defaultdict(lambda: np.zeros(language.SIZE))
    for d, t, lang in rows:
        grams = plain_grams(t or "")
        if lang is not None and zlib.crc32(str(d).encode()) % 4 != 2:
            profile[lang] = profile[lang] + bundle(grams, lambda n: round(n * language.WEIGHT / sum(grams.values())))
    got = {r.doc_id: r for r in language.identify(df).collect()}
    for d, t, _ in rows:
        own = bundle(plain_grams(t or ""))
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2)
        if not own.any():
            assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
            continue
        cosine = {x: float(own @ p / np.linalg.norm(own) / (np.linalg.norm(p) or 1)) for x, p in profile.items()}
        best = max(sorted(cosine), key=lambda x: round(cosine[x], 9))
        assert got[d].lang_pred == best and abs(got[d].score - min(1, max(0, cosine[best]))) < 1e-6


def test_many_letters_take_the_sorted_path():
    texts = ["".join(chr(0x4E00 + i) for i in range(400)), "abc"]
    grams, counts = language.gram_counts(texts, language.letter_table())
    assert counts[0].sum() == 400 and counts[1].sum() == 3 and len(grams) == 403


def test_language_edge_rows(spark, edge, none):
    rows = language.identify(edge).collect()
    assert len(rows) == edge.count()
    got = {r.doc_id: r for r in rows}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (2, 3, 4, 13))
    assert got[7].lang_pred == "en" and not got[None].held_out
    assert language.identify(none).count() == 0
    unlabelled = language.identify(edge.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}
    out = language.predict(edge, {"en": np.ones(language.SIZE)})
    assert set(out.columns) == set(edge.columns) | {"lang_pred"}


# --------------------------------------------------------------- importance
M64 = (1 << 64) - 1


def mix(x):
    x = (x + 0x9E3779B97F4A7C15) & M64
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & M64
    return x ^ x >> 31


def plain_buckets(text):
    """Buckets of a text's words and pairs, by plain integer loops."""
    hashes = []
    for token in re.findall(rb"[0-9A-Za-z\x80-\xFF]+|[^\x20\x09-\x0D0-9A-Za-z\x80-\xFF]+", text.encode()):
        h, power = 0, 1
        for byte in token:
            h = (h + mix((byte + 11 * 0x1000003) & M64) * power) & M64
            power = power * (0x9E3779B97F4A7C15 | 1) & M64
        hashes.append(mix(h ^ mix(len(token))))
    pairs = [mix((a * 0xD6E8FEB86659FD93 + b) & M64) for a, b in zip(hashes, hashes[1:])]
    return [h >> 64 - importance.WORD_BITS for h in hashes], [(h >> 64 - importance.PAIR_BITS) + (1 << importance.WORD_BITS) for h in pairs]


def brute_weights(rows, good):
    """Log ratios of two multinomial models by plain loops (every occurrence counts), and the least one of a passage."""
    feats = {d: plain_buckets(t) for d, t in rows}
    raw, target = collections.Counter(), collections.Counter()
    for d, (w, p) in feats.items():
        raw.update(w + p)
        if d in good:
            target.update(w + p)
    cut = 1 << importance.WORD_BITS
    share = [sum(v for b, v in target.items() if (b >= cut) == side) / max(1, sum(v for b, v in raw.items() if (b >= cut) == side))
             for side in (False, True)]
    out = {}
    for d, (w, p) in feats.items():
        own = collections.Counter(w + p)

        def ratio(b):
            a = importance.SMOOTHING
            x = math.log((target[b] - (own[b] if d in good else 0) + a) / ((raw[b] - own[b]) * share[b >= cut] + a))
            return x * (importance.PAIR_WEIGHT if b >= cut else 1)

        x = [ratio(b) + (ratio(p[i]) if i < len(p) else 0) for i, b in enumerate(w)]
        n = importance.PASSAGE
        out[d] = sum(x), min((sum(x[i:i + n]) for i in range(max(1, len(x) - n + 1))), default=0.0)
    return out


def test_weights_and_selection_equal_plain_loops(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and r.toxic == 0}
    want = brute_weights(rows, good)
    for share in (None, 0.6):
        got = importance.importance_sample(docs, labels, share=share).collect()
        assert all(abs(r.log_weight - want[r.doc_id][0]) < 0.01 and abs(r.passage_log_weight - want[r.doc_id][1]) < 0.01 for r in got)
        mine = sorted(r.log_weight for r in got if r.doc_id in good)
        k = 72 if share else sum(r.log_weight >= mine[int(importance.LOSS * len(mine))] for r in got)
        top = sorted((r.sampled_key for r in got), reverse=True)[:k]
        assert sorted((r.sampled_key for r in got if r.sampled), reverse=True) == top
        bar = sorted(r.passage_log_weight for r in got if r.doc_id in good)[int(importance.LOSS * len(mine))]
        assert all(r.passage_ok == (r.passage_log_weight >= bar) and r.kept == (r.sampled and r.passage_ok) for r in got)
    noise = {r.doc_id: r.sampled_key / (1 << 20) - r.log_weight / importance.TEMPERATURE for r in got}
    assert -3 < min(noise.values()) and abs(np.mean(list(noise.values())) - 0.577) < 0.4


def test_seeds_draw_other_samples_in_proportion_to_the_weights(spark):
    """Four kinds of rows, ten of each: their shares among first draws follow exp(log weight), and samples differ by seed."""
    docs = spark.createDataFrame([(i, ["a b", "a c", "a d", "a e"][i % 4]) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i % 4 == 0 else 0, 0) for i in range(0, 12)], "doc_id long, quality int, toxic int")
    rows = importance.flagged(docs, labels, "doc_id")
    raw, target = importance.learn(rows, "text", "_good")
    assert raw.sum() == 40 * 3 and target.sum() == 3 * 3
    kept, weights = [], None
    for seed in range(12):
        got = importance.importance_sample(docs, labels, share=0.25, seed=seed, temperature=1.0).collect()
        weights = {r.doc_id: r.log_weight for r in got}
        kept.append(frozenset(r.doc_id for r in got if r.sampled))
    assert all(len(x) == 10 for x in kept) and len(set(kept)) == 12
    rate = {i: sum(i in x for x in kept) / 12 for i in range(40)}
    heavy = [i for i in weights if weights[i] > np.median(list(weights.values()))]
    assert heavy and np.mean([rate[i] for i in heavy]) > np.mean([rate[i] for i in range(40) if i not in heavy]) + 0.1


def test_bad_documents_go_and_clean_ones_stay(spark):
    """Shares kept on the given tables; README quotes them."""
    for sf, least_good, most_low, most_toxic in (("sf0.01", 0.98, 0.3, 0.9), ("sf0.1", 0.98, 0.2, 0.3)):
        docs, labels = tables(spark, sf)
        got = importance.importance_sample(docs, labels).join(labels, "doc_id").collect()
        clean = [r.kept for r in got if r.quality == 1 and r.toxic == 0]
        low = [r.kept for r in got if r.quality == 0 and r.toxic == 0]
        toxic = [r.kept for r in got if r.toxic == 1]
        shares = [sum(x) / len(x) for x in (clean, low, toxic)]
        print(sf, shares)
        assert shares[0] > least_good and shares[1] < most_low and shares[2] < most_toxic
    # a rerun on other partitions draws the same sample
    docs, labels = tables(spark, "sf0.01")
    a, b = ({r.doc_id for r in importance.importance_sample(x, labels).collect() if r.kept} for x in (docs, docs.repartition(5)))
    assert a == b


def test_long_texts_are_counted_and_weighed_in_pieces():
    rnd = random.Random(8)
    text = "".join(rnd.choice(["ab ", "é,", "\n\n", "x1", "!!", " ", "c\t", "longer-word "]) for _ in range(3000)) + "q" * 500
    ratio = np.random.default_rng(3).integers(-1000, 1000, importance.SIZE)
    for t in (text, "one", "  ", "a b c", "z" * 300):
        want = importance.slice_counts(pa.array([t]), 1 << 30)
        w, p = plain_buckets(t)
        x = [int(ratio[b]) + (int(ratio[p[i]]) if i < len(p) else 0) for i, b in enumerate(w)]
        for step in (1, 50, 1000):
            row, bucket, n = importance.slice_counts(pa.array([t]), step)
            assert (bucket == want[1]).all() and (n == want[2]).all()
            for size in (1, 3, 40):
                least = min(sum(x[i:i + size]) for i in range(max(1, len(x) - size + 1)))
                assert importance.least_passage(ratio, t.encode(), step, size) == least


def test_importance_edge_rows(spark, edge, none):
    labels = spark.createDataFrame([(1, 1, 0), (7, 1, 0), (7, 1, 0), (12, 0, 0), (5, 1, None), (None, 1, 0), (6, None, 1)],
                                   "doc_id long, quality int, toxic int")
    rows = importance.importance_sample(edge, labels).collect()
    assert len(rows) == edge.count() and {r.log_weight for r in rows if r.doc_id in (2, 3, 4)} == {0.0}
    kept = importance.keep_sampled(edge, labels)
    assert kept.columns == edge.columns and kept.count() == sum(r.kept for r in rows)
    assert all(r.kept for r in importance.importance_sample(edge, labels.limit(0)).collect())
    assert importance.importance_sample(none, labels).count() == 0


def test_labelled_rows_are_thinned_by_id_beyond_the_bound(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    n = importance.flagged(docs, labels, "doc_id", limit=1000).filter("_good").count()
    assert 850 < n < 1150 and math.isclose(importance.flagged(docs, labels, "doc_id").filter("_good").count(), 4000)


def test_byte_classes():
    kind = importance.byte_classes()
    assert kind[ord("a")] == kind[0xC3] == kind[ord("7")] == 2 and kind[ord("!")] == 1 and kind[0x20] == 0
