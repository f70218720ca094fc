"""The operators on small rows: brute force, round trips, and the edges that the docstrings define."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, license_scan, maxscore, media_chunks, ngram_join, packing, pii, source_mix, token_codes, toxicity
from tidemark.llm.queries import vocabulary
from tidemark.llm.units import UnitEncoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, part string"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD = [
    (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 1, 9, "x"),
    (2, "The quick brown fox jumps over the lazy dog and runs away", "en", "a", 1, 9, "x"),
    (2, "The quick brown fox jumps over the lazy dog and runs away", "en", "a", 1, 9, "x"),
    (3, None, None, None, None, None, None),
    (4, "", "de", "b", 0, 0, ""),
    (None, "no id  here\n\nand odd\twhite space ,, 1.2.3.4 <|endoftext|>", None, "b", 1, 1, "y"),
    (5, LONG, "en", "b", 1, 1, "z"),
    (6, "short", "fr", "c", 1, 1, "z"),
    (7, "été où ça Übergröße naïve 日本語", "fr", None, 1, 1, "z"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_media(odd, empty):
    found = media_chunks.media_table(odd).collect()
    assert len(found) == len(ODD)
    expected = []
    for i, text, *_ in ODD:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        expected.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert sorted((tuple(r)[:5] for r in found), key=repr) == sorted(expected, key=repr)
    assert media_chunks.media_table(empty).count() == 0


def test_gear_hash_is_rolling():
    data = np.random.default_rng(0).integers(0, 256, 200, np.uint8)
    h = media_chunks.gear_hash(data)
    for i in (0, 5, 31, 32, 150):
        assert int(h[i]) == sum(int(media_chunks.GEAR[data[i - k]]) << k for k in range(min(32, i + 1))) % 2**32
    payload = bytes(np.random.default_rng(1).integers(0, 256, 50_000, np.uint8))
    ends = media_chunks.cuts(payload)
    assert ends[-1] == len(payload) and max(np.diff([0, *ends])) <= media_chunks.MOST
    moved = media_chunks.chunks(b"x" * 7 + payload)[0]
    assert len(set(moved) & set(media_chunks.chunks(payload)[0])) >= len(ends) - 3


def test_chunks_are_shared(spark):
    body = "".join(chr(97 + int(x)) for x in np.random.default_rng(2).integers(0, 26, 40_000))
    docs = spark.createDataFrame([(1, body), (2, "changed " + body), (3, body)], "doc_id long, text string")
    found = {r.doc_id: r for r in media_chunks.media_table(docs).collect()}
    assert found[1].media_sha256 == found[3].media_sha256 != found[2].media_sha256
    assert found[2].payload_sha256 == hashlib.sha256(media_chunks.payloads(pa.array(["changed " + body]))[0]).hexdigest()


def test_toxicity(spark, odd, empty):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdeghn"), 5))
    texts = [" ".join(word() for _ in range(60)) for _ in range(600)]
    labels = np.array([k % 4 == 0 for k in range(600)]).astype(int)
    texts = [t + (" vile scum here" if y else " kind words here") for t, y in zip(texts, labels, strict=True)]
    model = toxicity.fit(texts[:400], labels[:400])
    assert ((model.scores(pa.array(texts[400:])) >= 0.5) == labels[400:]).mean() > 0.97
    found = toxicity.score(odd, model).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    assert {r.doc_id: r.held_out for r in found}[1] == (zlib.crc32(b"1") % 5 == 0)
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.keep_clean(odd, model).columns == odd.columns
    one_class = toxicity.fit(texts[:5], np.zeros(5))
    assert len(set(one_class.scores(pa.array(texts[:3])))) == 1
    assert toxicity.train(odd, spark.createDataFrame([], "doc_id long, toxic int")).out.sum() == 0


def test_toxic_cut_does_not_depend_on_the_sample(spark):
    """Overlapping classes at 1 to 10: the cut fits the counts of the tables, not the balanced sample's."""
    rng, rows = np.random.default_rng(9), []
    for i in range(6600):
        toxic = int(i % 11 == 0)
        words = [f"w{x}" for x in rng.integers(0, 500, 12)] + ["rude"] * (rng.random() < (0.9 if toxic else 0.4)) + ["vile"] * (rng.random() < (0.5 if toxic else 0.05))
        rows.append((i, " ".join(rng.permutation(words)), toxic))
    both = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(both.select("doc_id", "text"), both.select("doc_id", "toxic"), most=300)
    found = toxicity.score(both.select("doc_id", "text"), model).join(both.select("doc_id", "toxic"), "doc_id").where("held_out")
    said, right = found.where("predicted = 1").count(), found.where("predicted = 1 AND toxic = 1").count()
    actual = found.where("toxic = 1").count()
    # "vile" alone gives an F1 of 0.5, "rude" 0.3; at 1 to 1 "rude" would be the better one
    assert said < 2 * actual and 2 * right / (said + actual) > 0.4


def test_pii_base_and_skip_edges(spark, odd, empty):
    text = "call +1 (743) 555-3824 now, later 743 555-3824 again; a.b@c.de @x 1.2.3.4.5 999.1.1.1; 4111 1111 1111 1111"
    base = pii.base_spans(text)
    kinds = [text[a:b] for _, a, b in base]
    assert kinds == ["a.b@c.de", "1.2.3.4", "4111 1111 1111 1111", "+1 (743) 555-3824"]
    found, every = pii.fit([text] * 5).spans([text])
    added = [text[a:b] for k, a, b in every[0] if (k, a, b) not in found[0]]
    assert added == ["743 555-3824"]
    assert "743" not in pii.masked(text, every[0]) and "[PHONE]" in pii.masked(text, every[0])
    out = pii.find(odd, pii.train(odd)).collect()
    assert len(out) == len(ODD) and sum(r.n_ip for r in out) == 1
    assert {r.base_sha256 for r in out if r.doc_id in (3, 4)} == {hashlib.sha256(b"").hexdigest()}
    assert pii.find(empty, pii.fit([])).count() == 0
    assert pii.redact(odd, pii.fit([])).where("text LIKE '%[IP]%'").count() == 1


@pytest.mark.parametrize("seed", range(3))
def test_pii_matches_plain_patterns(seed):
    rng = np.random.default_rng(seed)
    for _ in range(400):
        text = "".join(rng.choice(list("ab1234567890.-+@ ()%é\n"), 40))
        plain = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        plain += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
        plain += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
        plain += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert pii.base_spans(text) == plain


def test_language(odd, empty):
    texts = ["the cat and the dog of the house"] * 20 + ["der hund und die katze aus dem haus"] * 20
    model = langid.fit(texts, ["en"] * 20 + ["de"] * 20)
    names, share = model.label(pa.array(["the house and the dog", "die katze und der hund", "", "123 !!", None]))
    assert names == ["en", "de", "und", "und", "und"] and share[0] > 0.8 and share[2] == 0
    post, first = model.words(pa.array(["the cat and the dog der hund und die katze"]))
    assert (post.argmax(1)[[0, 1]] == model.langs.index("en")).all() and (post.argmax(1)[-2:] == model.langs.index("de")).all()
    score, first = model.emissions(pa.array(["the cat der", "", "hund und die katze haus"]))
    post, _ = model.words(pa.array(["the cat der", "", "hund und die katze haus"]))
    for a, b in ((0, 3), (3, 8)):
        total = np.zeros(post[a:b].shape)
        for path in np.ndindex(*[2] * (b - a)):
            w = np.exp(sum(score[a + t, s] for t, s in enumerate(path)) + sum(model.step[x, y] for x, y in zip(path, path[1:], strict=False)))
            for t, s in enumerate(path):
                total[t, s] += w
        assert np.allclose(total / total.sum(1, keepdims=True), post[a:b])
    found = langid.predict(odd, langid.train(odd)).collect()
    assert len(found) == len(ODD) and {r.lang_pred for r in found if r.doc_id in (3, 4)} == {"und"}
    assert langid.predict(empty, langid.train(empty)).count() == 0


def test_language_without_words():
    """A language of empty texts or digits takes nothing from the others."""
    texts = ["the cat and the dog of the house"] * 20 + ["der hund und die katze aus dem haus"] * 20 + ["", "123 456"]
    model = langid.fit(texts, ["en"] * 20 + ["de"] * 20 + ["und", "aaa"])
    names, share = model.label(pa.array(["the house and the dog", "die katze und der hund", "77"]))
    assert names == ["en", "de", "und"] and share[0] > 0.8


def test_language_of_long_texts_only(spark, monkeypatch):
    monkeypatch.setattr(langid, "LONGEST_FIT", 100)
    rows = [(i, "the cat and the dog of the house " * 2, "en") for i in range(40)] + [(100 + i, "der hund und die katze aus dem haus " * 9, "de") for i in range(40)]
    rows += [(200 + i, "12 !!", "zxx") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.langs == ["de", "en"] and model.label(pa.array(["die katze und der hund"]))[0] == ["de"]


def _sets(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def _components(texts):
    sets = {i: _sets(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("seed", range(2))
def test_join_against_all_pairs(spark, seed):
    """Chains of edits, copies and documents that share long passages."""
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(0, 3000)}"
    texts, n = [], 0
    passage = [word() for _ in range(60)]
    for _ in range(12):
        body = [word() for _ in range(int(rng.integers(4, 120)))]
        if rng.random() < 0.4:
            body += passage
        for _ in range(int(rng.integers(1, 9))):
            texts.append((n, " ".join(body)))
            n += 1
            body = list(body)
            for _ in range(int(rng.integers(0, 3))):
                body[int(rng.integers(0, len(body)))] = word()
    expected = _components(texts)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()}
    assert found == expected
    kept = ngram_join.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in expected.items() if c == i)


def test_join_edges(odd, empty):
    found = ngram_join.near_duplicates(odd).collect()
    assert len(found) == len(ODD)
    by = {r.doc_id: r for r in found}
    assert by[1].component_id == by[2].component_id == 1 and by[3].n_shingles == by[4].n_shingles == 0
    assert by[4].component_id == 4 and by[6].n_shingles == 1
    assert ngram_join.near_duplicates(empty).count() == 0
    assert sorted(r.doc_id for r in ngram_join.keep_one(odd).where("doc_id IS NOT NULL").collect()) == [1, 3, 4, 5, 6, 7]


def _direct(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def test_token_files(odd, empty):
    encode, at, expected = _direct("word_bpe_49k.json"), 0, []
    for i, text, *_ in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = encode(text)
        expected.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    found = token_codes.token_table(odd, vocabulary("word_bpe_49k.json")).collect()
    assert sorted((tuple(r)[:4] for r in found), key=repr) == sorted(expected, key=repr)
    assert token_codes.token_table(empty, vocabulary("word_bpe_49k.json")).count() == 0


def test_codes_read_any_token():
    rng = np.random.default_rng(0)
    ids = np.concatenate([rng.integers(0, 300, 3000), rng.integers(0, 2**32, 500)]).astype(np.uint32)
    rng.shuffle(ids)
    f = token_codes.CodeFile(token_codes.encode_file(np.arange(2), np.array([0, 1000, 3500]), ids))
    places = rng.integers(0, 3500, 60)
    assert (f.tokens(places) == ids[places]).all() and (f.run(0, 3500) == ids).all() and (f.document(1) == ids[1000:]).all()
    for a, b in rng.integers(0, 3501, (40, 2)):
        assert (f.run(min(a, b), max(a, b)) == ids[min(a, b) : max(a, b)]).all()
    with pytest.raises(ValueError, match="token-code"):
        token_codes.CodeFile(b"none")


def test_codes_read_without_other_blocks():
    """Everything of the first level but the document's own bytes and its blocks of the bitmap may be destroyed."""
    ids = np.random.default_rng(1).integers(0, 60_000, 40_000).astype(np.uint32)
    at = np.arange(0, 40_001, 100)
    image = bytearray(token_codes.encode_file(np.arange(400), at, ids))
    codes = 20 + 8 * 400 + 8 * 401 + 8
    first, last = 100 * 200, 100 * 201
    low, high = first // token_codes.STEP * token_codes.STEP // 8, -(-last // token_codes.STEP) * token_codes.STEP // 8
    for begin, end in ((codes, codes + first), (codes + last, codes + 40_000), (codes + 40_000, codes + 40_000 + low), (codes + 40_000 + high, codes + 45_000)):
        image[begin:end] = b"\xaa" * (end - begin)
    f = token_codes.CodeFile(bytes(image))
    assert (f.document(200) == ids[first:last]).all() and (f.tokens(np.array([first + 7, last - 1])) == ids[[first + 7, last - 1]]).all()


def test_files_split_hot_ids(spark):
    """Small files: ids ascend from file to file, one id of very many rows is split, starts are gapless."""
    data = [(7, f"word {i} again") for i in range(300)] + [(None, f"none {i}") for i in range(40)] + [(i, "x " * (i % 9)) for i in range(20)] + [(8, "long " * 5000)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    files = token_codes.write_files(docs, vocabulary("word_bpe_49k.json"), 2, False, 16, 2000).collect()
    seen = [x for f in sorted(files, key=lambda f: (f.part, f.seq)) for x in token_codes.CodeFile(bytes(f.image)).doc_ids.tolist()]
    assert seen == sorted(seen) and len(seen) == len(data) and max(len(token_codes.CodeFile(bytes(f.image)).doc_ids) for f in files) <= 16
    found = sorted((r.start, r.n_tokens, r.doc_id) for r in token_codes.token_table(docs, vocabulary("word_bpe_49k.json")).collect())
    assert [a for a, _, _ in found] == np.cumsum([0, *(n for _, n, _ in found)])[:-1].tolist()
    assert [i for _, _, i in found if i is not None] == sorted(i for i, _ in data if i is not None)


@pytest.mark.parametrize(("name", "blank"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_units_equal_direct_encoding(name, blank):
    from tidemark.llm.units import encoder

    rng, encode = np.random.default_rng(5), _direct(name)
    parts = ["the", "Foo", "é", "ß", "12", " ", " ", " ", "\n", ".", ",", "..", "\n\n", "  ", "\t", "'s", "-", "ΑΣ", "İ", "x́", "́", "|", "<|endoftext|>", "\x02", "\x1c", "日本", "²", "½", "fo.ba", "a,b"]
    for _ in range(300):
        texts = ["".join(rng.choice(parts, int(rng.integers(0, 14)))) for _ in range(4)]
        ids, at = encoder(vocabulary(name), blank).documents(texts, 2)
        assert all((encode(t) == ids[a:b]).all() for t, a, b in zip(texts, at[:-1], at[1:], strict=True))


@pytest.mark.parametrize("name, blank", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_units_with_signs_are_encoded_many_at_a_time(name, blank):
    rng = np.random.default_rng(4)
    signs = ["%%%", "!!", "é?", "'s", "", "<|endoftext|>", "日本", "-", "٣"]
    made = [f"{'xyzé'[k % 4]}{k}{signs[rng.integers(len(signs))]}{rng.integers(99)}" for k in range(900)] + ["", "a  b", "...", "'s", "  "]
    own = UnitEncoder(vocabulary(name), blank)

    class Counted:
        model, calls = own.tokenizer.model, 0

        def __getattr__(self, kind):
            def run(texts, **how):
                Counted.calls += len(texts)
                return getattr(plain, kind)(texts, **how)

            return run

    plain, own.tokenizer = own.tokenizer, Counted()
    texts = [" ".join(made[k : k + 50]) for k in range(0, 900, 50)]
    ids, sizes = own.encode(texts)
    assert Counted.calls <= 40
    whole = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == list(map(len, whole)) and ids.tolist() == sum(whole, [])
    odd = [" ".join(made[k::7]) for k in range(7)]
    ids, sizes = own.encode(odd)
    whole = [plain.encode(t, add_special_tokens=False).ids for t in odd]
    assert sizes.tolist() == list(map(len, whole)) and ids.tolist() == sum(whole, [])


def test_words_are_learned_once_where_blanks_do_not_count():
    own = UnitEncoder(vocabulary("word_bpe_49k.json"), False)
    texts = ["Straße WORD\nWord word, Straße.\nSTRAßE", "word\nstraße word", "É é\nÉ", "ÿ Ÿ\nΣΑΣ İ", " word", "word\n", ",word"]
    ids, sizes = own.encode(texts)
    whole = [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == list(map(len, whole)) and ids.tolist() == sum(whole, [])
    own = UnitEncoder(vocabulary("word_bpe_49k.json"), False)
    own.encode(["Straße WORD\nWord word\nSTRAßE", "word\nstraße"])
    assert sorted(own.units) == ["\x02\n", "straße", "word"]


def test_targets(spark):
    for sizes in ([100] * 7, [1000, 1, 1, 1, 50, 2, 0], [10], [5, 1000, 3], [0, 0]):
        names = [f"s{i:02d}" for i in range(1, len(sizes))] + [None]
        of = dict(zip(names, sizes, strict=True))
        weight, total, held = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}, sum(sizes), set()
        while rest := [n for n in names if n not in held]:
            level = (total - sum(3 * of[n] for n in held)) / sum(weight[n] for n in rest)
            over = {n for n in rest if level * weight[n] > 3 * of[n]}
            if not over:
                break
            held |= over
        found = {r.source: r.target for r in source_mix.targets(spark.createDataFrame(list(of.items()), "source string, source_size long")).collect()}
        assert all(abs(found[n] - (3 * of[n] if n in held else level * weight[n])) < 1e-6 for n in names)


def test_mix(spark, odd, empty):
    docs = spark.createDataFrame([(i, "word " * (1 + i % 17), f"s{i % 4}") for i in range(400)], "doc_id long, text string, source string")
    found = source_mix.mix(docs)
    for r in found.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect():
        assert abs(r.target - r.taken) <= 1  # sizes 1 to 17: some document closes the gap
    assert rows(found) == rows(source_mix.mix(docs)) and found.where("taken > 3 * size").count() == 0
    # a whole epoch precedes a fractional choice: copies of one source differ by one at most
    assert found.groupBy("source").agg((F.max("copies") - F.min("copies")).alias("d")).where("d > 1").count() == 0
    assert source_mix.mix(odd).count() == len(ODD) and source_mix.mix(empty).count() == 0
    assert source_mix.mixed_rows(odd).columns == odd.columns and source_mix.mixed_rows(empty).count() == 0
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_licenses(spark, empty):
    docs = spark.createDataFrame(
        [
            (1, "repo/LICENSE", "Released under the MIT License."), (2, "repo/src/a.py", "code\nprint"), (3, "repo/src/deep/b.py", None), (4, "repo/src/LICENSE.txt", "Licensed under the Apache License, Version 2.0."),
            (5, "other/c.py", "text here. This work is licensed under the GNU General Public License, version 3. more text follows and goes on for long, line after line, so that the notice is less than half of what the file holds in all"), (6, "other/d.py", ""), (7, None, "All rights reserved."), (8, "top.py", "x"),
        ],
        "doc_id long, path string, text string",
    )
    found = {r.doc_id: (r.license, r.how, r.from_dir) for r in license_scan.scan(docs).collect()}
    assert found == {
        1: ("MIT", "own", None), 2: ("Apache-2.0", "inherited", "repo/src"), 3: ("Apache-2.0", "inherited", "repo/src"), 4: ("Apache-2.0", "own", None), 5: ("GPL-3.0", "own", None), 6: (None, None, None), 7: ("Proprietary", "own", None), 8: (None, None, None),
    }
    assert license_scan.scan(empty.select("doc_id", F.col("part").alias("path"), "text")).count() == 0


def test_whole_licenses(spark):
    """License files and headers as a whole, SPDX lines, and rights reserved beside a named license."""
    full = lambda name: (license_scan.BODIES / f"{name}.txt").read_text()
    mine = "Copyright (c) 2020, X. All rights reserved.\n\n"
    comment = "".join(f"# {line}\n" for line in (mine + full("Apache-2.0.header")).splitlines())
    docs = spark.createDataFrame(
        [
            (1, "a/1", mine + full("BSD-3-Clause")), (2, "b/2", mine + full("BSD-2-Clause")), (3, "c/3", mine + full("MIT")), (4, "d/LICENSE", full("GPL-3.0")), (5, "e/5", comment + "import os\n" + "print(os.name)\n" * 400),
            (6, "f/6", "// SPDX-License-Identifier: GPL-3.0-or-later\nint x;\n" * 1 + "int y;\n" * 50), (7, "g/7", "/* " + full("GPL-3.0.header") + " */\nint main;\n" + "int z;\n" * 300), (8, "h/8", mine + "This work is licensed under the GNU General Public License, version 3 as said.\n"), (9, "i/9", mine), (10, "d/x/10", None),
        ],
        "doc_id long, path string, text string",
    )
    found = {r.doc_id: r.license for r in license_scan.scan(docs).collect()}
    assert found == {1: "BSD-3-Clause", 2: "BSD-2-Clause", 3: "MIT", 4: "GPL-3.0", 5: "Apache-2.0", 6: "GPL-3.0", 7: "GPL-3.0", 8: "GPL-3.0", 9: "Proprietary", 10: "GPL-3.0"}


def test_maxscore(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(400, 8)).astype(np.float32)
    v[7] = v[11] = v[13]
    data = [(i, [float(x) for x in r], 1) for i, r in enumerate(v)] + [(900, None, 1), (901, [float("nan")] * 8, 1), (902, [None] * 8, 1), (903, [float("inf")] * 8, 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, extra int")
    q = maxscore.quantised(df)
    whole = np.floor(v.astype(np.float64) * 256).astype(np.int64)
    expected = []
    for i in range(0, 400, 50):
        s = whole @ whole[i]
        best = sorted((-int(s[j]), j) for j in range(400) if j != i)[:5]
        expected += [(i, k + 1, j, -x) for k, (x, j) in enumerate(best)]
    for shard, block, part in ((10_000, 1000, 1024), (64, 3, 16)):
        assert rows(maxscore.top_k(q, q.where("id % 50 = 0"), 5, shard, block, part)) == sorted(expected, key=repr)
    none = q.where("false")
    assert maxscore.top_k(none, none).count() == 0
    few = q.where("id IN (0, 1, 2)")
    assert maxscore.top_k(few, few.where("id = 0")).count() == 2


def test_packing(odd, empty):
    encode = _direct("byte_bpe_50k.json")
    found = packing.pack_documents(odd, vocabulary("byte_bpe_50k.json")).collect()
    expected = []
    for i, text, *_ in ODD:
        ids = encode(text)
        expected += [(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 1024))]
    assert sorted((tuple(r)[:5] for r in found), key=repr) == sorted(expected, key=repr)
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        assert [o for o, _ in sorted(own)] == list(np.cumsum([0, *(n for _, n in sorted(own))])[:-1]) and sum(n for _, n in own) <= 1024
    assert packing.pack_documents(empty, vocabulary("byte_bpe_50k.json")).count() == 0
    assert packing.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)] and packing.cut(2048, 1024) == [(0, 1024), (1024, 1024)] and packing.cut(7, 1024) == [(0, 7)]


def test_place_is_close_to_the_bound():
    lengths = np.sort(np.random.default_rng(8).integers(1, 1024, 5000))[::-1]
    bins, _ = packing.place(lengths, 1024)
    assert bins.max() + 1 <= -(-lengths.sum() // 1024) * 1.02


def test_pipeline(spark):
    """Every stage of the pipeline against a plain version of it."""
    from collections import Counter

    import corpus_pipeline
    import duckdb
    from conftest import SMALL

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "pii", "source_mix", "packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept, steps = docs, []
    for _, stage in corpus_pipeline.STAGES:
        kept = media_chunks.durable(stage(spark, kept, SMALL), "test_stage")
        steps.append(kept)
    given = [tuple(r) for r in docs.select(corpus_pipeline.COLUMNS).collect()]
    model = toxicity.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    clean = [r for r in given if model.scores(pa.array([r[1]], pa.string()))[0] < 0.5]
    assert rows(steps[0]) == sorted(clean, key=repr) and len(clean) < len(given)
    leaders = {i for i, (_, root) in _components([r[:2] for r in clean]).items() if i == root}
    single = [r for r in clean if r[0] in leaders]
    assert rows(steps[1]) == sorted(single, key=repr) and len(single) < len(clean)
    field, masked = pii.train(steps[1]), []
    for i, text, lang, source, _ in single:
        new = pii.masked(text, field.spans([text])[1][0])
        masked.append((i, new, lang, source, len(new)))
    assert rows(steps[2]) == sorted(masked, key=repr) and any(a[1] != b[1] for a, b in zip(sorted(masked), sorted(single), strict=True))
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist([dict(zip(corpus_pipeline.COLUMNS, r, strict=True)) for r in masked]))
    copies = {r[0]: r[5] for r in con.execute(f"SELECT doc_id, size, source_size, target, taken, copies FROM ({source_mix.ORACLE})").fetchall()}
    assert rows(steps[3]) == sorted([r for r in masked for _ in range(copies[r[0]])], key=repr)
    encode, expected = _direct("byte_bpe_50k.json"), Counter()
    for i, text, *_ in masked:
        ids = encode(text)
        for k, (s, n) in enumerate(packing.cut(len(ids), 1024)):
            expected[i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += copies[i]
    assert Counter(tuple(r)[:5] for r in steps[4].collect()) == +expected
    whole = corpus_pipeline.run(spark, SMALL)
    assert Counter(tuple(r)[:5] for r in whole.collect()) == +expected
    fill = whole.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).collect()
    assert all(r.n == r.m <= 1024 for r in fill)



def test_pipeline_holds_little_in_executors(spark, empty):
    import corpus_pipeline
    from conftest import SMALL
    from tidemark.llm import common

    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, docs = spark.conf.get(key), spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.set(key, "10000")
            stage(spark, docs, SMALL)
            seen.append((name, int(spark.conf.get(key))))
    finally:
        spark.conf.set(key, before)
    assert all(n <= 500 for name, n in seen if name != "source_mix"), seen
    common._POWERS.clear()
    data, at = common.text_buffer(pa.array(["some words " * 100_000]))
    made = common.word_hashes(data, *common.word_spans(data, at))
    assert len(set(made.tolist())) == 2 and len(made) == 200_000
    assert sum(x.nbytes for x in common._POWERS) <= 4 << 20


def test_pipeline_stages_begin_with_small_heaps(spark):
    import corpus_pipeline
    from conftest import SMALL

    def whole_collections() -> int:
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        before = whole_collections()
        stage(spark, docs, SMALL)
        # the driver's and, in tasks that are all in its process here, the executors'
        assert whole_collections() >= before + 2, name


def test_keep_one_judges_rows_not_ids(spark):
    """Ids that repeat with different texts, null ids, and extra columns with the names used inside."""
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "ABCDE"}
    near = text["A"].rsplit(" ", 1)[0] + " other"
    data = [(1, "A"), (5, "A"), (5, "B"), (7, "B"), (9, "C"), (9, "D"), (9, "D"), (None, "A"), (None, "E"), (None, "E")]
    made = [(i, text[k], f"x{n}", n) for n, (i, k) in enumerate(data)] + [(3, near, "n", 20), (4, None, "z", 21), (4, None, "z", 21), (None, " ", "z", 22)]
    docs = spark.createDataFrame(made, "doc_id long, text string, gone_id string, `row` int").withColumn("one_of", F.col("doc_id"))
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    found = sorted(((r.doc_id, (r.text or "").split(" ")[0][:1]) for r in kept.collect()), key=repr)
    assert found == sorted([(1, "A"), (5, "B"), (9, "C"), (9, "D"), (None, "E"), (4, ""), (4, ""), (None, "")], key=repr)
    assert kept.where("one_of IS DISTINCT FROM doc_id").count() == 0
    by = {(r.doc_id, r.class_id): r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    assert {c for (i, _), c in by.items() if i in (1, 3)} == {1}


def test_combined_entries_keep_every_survivor():
    """What a slice counts at once, and entries of several slices, give at least the true counts of shared shingles."""
    rng = np.random.default_rng(3)
    sets = {k: np.unique(rng.integers(0, 400, 60).astype(np.uint64) << np.uint64(50)) for k in range(1, 40)}
    holders = {}
    for k, s in sets.items():
        for h in s.tolist():
            holders.setdefault(h, set()).add(k)
    batches = [ngram_join._fragments([(k, sets[k]) for k in part], 3, True) for part in (range(1, 12), range(12, 25), range(25, 40))]
    table, got = pa.Table.from_batches(batches), {}
    for fragment in set(table.column("fragment").to_pylist()):
        group = table.filter(pa.compute.equal(table.column("fragment"), fragment))
        for r in ngram_join._count_shared(group).to_pylist():
            got[r["class_id"]] = got.get(r["class_id"], 0) + r["shared"]
    assert {k: got.get(k, 0) for k in sets} == {k: sum(len(holders[h]) > 1 for h in s.tolist()) for k, s in sets.items()}


def test_join_counts_travel_in_proportion(spark):
    """The first count sends one record a task and range of classes, nothing of classes that share little, and drops no link."""
    rng = np.random.default_rng(11)
    sets = {k: np.unique(rng.integers(0, 2**64 - 1, 60, np.uint64, True)) for k in range(1, 300)}
    for k in range(1, 60, 2):  # near copies
        sets[k + 1] = np.unique(np.append(sets[k][:-6], sets[k + 1][:6]))
    for k in range(100, 300, 2):  # a common passage
        sets[k] = np.unique(np.append(sets[k][:-8], sets[101][:8]))
    holders = {}
    for k, s in sets.items():
        for h in s.tolist():
            holders.setdefault(h, set()).add(k)
    true = {k: sum(len(holders[h]) > 1 for h in s.tolist()) for k, s in sets.items()}
    for slice_ in (50, 300):  # the common passage in several slices, then in one
        made = [ngram_join._fragments([(k, sets[k]) for k in range(a, min(a + slice_, 300))], 64, True) for a in range(1, 300, slice_)]
        rows_ = pa.Table.from_batches(made).sort_by("fragment")
        cut = rows_.column("fragment").to_numpy() % 4
        told = [b for task in range(4) for b in ngram_join._counted(2, 75)(rows_.filter(pa.array(cut == task)).to_batches(7))]
        assert sum(b.num_rows for b in told) <= 4 * 2
        assert sum(len(x) for b in told for x in b.column("keys").to_pylist()) // 8 < 4 * 100
        (found,) = ngram_join._sums(told)
        most = {r["class_id"]: 200 * r["shared"] + 75 * max(0, len(sets[r["class_id"]]) - r["seen"]) for r in found.to_pylist()}
        assert all(most.get(k, 75 * len(sets[k])) >= 200 * true[k] for k in sets)
        kept = {k for k, m in most.items() if m >= 150 * len(sets[k])}
        assert {k for k in sets if 100 * true[k] >= 75 * len(sets[k])} <= kept <= {k for k in sets if 100 * true[k] >= 50 * len(sets[k])}


def test_pii_messages_equal_enumeration():
    """On forests exactly; with a loop, the strongest labels of well-separated nodes."""
    rng = np.random.default_rng(11)
    for edges in ([(0, 1), (1, 2), (1, 3), (4, 5)], [(0, 1), (1, 2), (2, 3), (3, 0), (3, 4)]):
        for _ in range(5):
            local, pots = rng.normal(0, 1.5, (6, 3)), rng.normal(0, 0.7, (len(edges), 3, 3))
            total = np.zeros((6, 3))
            for labels in np.ndindex(*[3] * 6):
                w = np.exp(sum(local[n, k] for n, k in enumerate(labels)) + sum(pots[e, labels[a], labels[b]] for e, (a, b) in enumerate(edges)))
                for n, k in enumerate(labels):
                    total[n, k] += w
            exact = total / total.sum(1, keepdims=True)
            found = pii.sum_product(local, np.array(edges), pots, 500)
            if len(edges) < 5:
                assert np.allclose(found, exact, atol=1e-6)
            else:
                clear = exact.max(1) > 0.8
                assert (found.argmax(1) == exact.argmax(1))[clear].all() and np.abs(found - exact).max() < 0.15


def _planted_pii(n, seed):
    """Texts and their hidden spans: personal data that the patterns miss once, and decoys that nobody owns."""
    rng = np.random.default_rng(seed)
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(rng.choice(list("abcdeilnorst"), 6))

    def card(ok=True):
        while True:
            d = digits(16)
            if d[0] != "0" and pii.luhn(d) == ok:
                return d

    texts, hidden = [], []
    for _ in range(n):
        parts, own = [word() for _ in range(12)], []
        kind = rng.integers(0, 6)
        if kind == 0:  # a card once alone and once glued to another number
            c = card()
            parts += [c, *(word() for _ in range(30)), f"{card(False)} {c}"]
            own = [c]
        elif kind == 1:  # a phone number, later without its country code, several times
            a, b, c = digits(3), "555", digits(4)
            parts += [f"+1 ({a}) {b}-{c}", *(word() for _ in range(30)), *[f"{a} {b} {c}," for _ in range(4)]]
            own = [f"{a} {b} {c}"] * 4
        elif kind == 2:  # an address, later spelt out or by its local part
            name = f"{word()}.{digits(2)}"
            parts += [f"{name}@mail.example.com", *(word() for _ in range(30)), f"{name} (at) mail [dot] example [dot] com", "and", f"{name},"]
            own = [f"{name} (at) mail [dot] example [dot] com", name]
        elif kind == 3:  # decoys
            d = card(False)
            parts += [d, "order", digits(9), word(), d, "at", f"{digits(3)}-{digits(3)}"]
        elif kind == 4:
            parts += [card(), "+1 (" + digits(3) + ") 555-" + digits(4), f"{word()}@example.org", "10.20.30.40"]
        parts += [word() for _ in range(10)]
        texts.append(" ".join(parts))
        hidden.append(own)
    return texts, hidden


def test_pii_field_finds_what_patterns_miss():
    train, _ = _planted_pii(300, 1)
    texts, hidden = _planted_pii(300, 2)
    base, every = pii.fit(train).spans(texts)
    added = [sorted(t[a:b] for k, a, b in e if (k, a, b) not in s) for t, e, s in zip(texts, every, base, strict=True)]
    wanted, given = sum(map(len, hidden)), sum(map(len, added))
    assert wanted > 200 and given > 0
    hit = sum(sum(min(a.count(x), h.count(x)) for x in set(h)) for a, h in zip(added, hidden, strict=True))
    assert hit / wanted > 0.95 and hit / given > 0.95
    assert all(s <= e for s, e in ((set(s), set(e)) for s, e in zip(base, every, strict=True)))


@pytest.mark.parametrize("times", [1, 2, 3, 8])
def test_pii_repeats_do_not_outvote(times):
    """Numbers of that shape are mostly nothing; those that repeat a phone number are one all the same."""
    fits = [f"id {100 + k} 555 01{k % 90 + 10} then" for k in range(200)] + ["+1 (743) 555-3824 and 743 555 3824"]
    text = "call +1 (743) 555-3824 " + "or 743 555 3824 then " * times + "but 812 555 0199"
    base, every = pii.fit(fits).spans([text])
    assert [text[a:b] for k, a, b in every[0] if (k, a, b) not in base[0]] == ["743 555 3824"] * times


def test_pii_takes_linear_time():
    import time

    field = pii.fit(["+1 (743) 555-3824 and 743 555 3824"])
    for piece in ("a" * 1_000_000 + " (at", "1" * 1_000_000, "1 " * 200_000, "a@" * 200_000, "1234 " * 100_000, "(at)" * 200_000, "1." * 200_000, "x (at) " * 100_000, "1234567890123456 " * 10_000):
        began = time.time()
        base, every = field.spans([piece])
        assert len(every) == 1 and time.time() - began < 20, piece[:20]


@pytest.mark.parametrize("scale", [100, 2**24])
def test_maxscore_prunes_and_is_exact(scale):
    """Clustered rows: blocks are passed over, non-essential terms are probed for few pairs, and nothing is lost; also
    where sums leave float64."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(12, 32)) * 3
    c = np.floor((centres[rng.integers(0, 12, 3000)] + 0.3 * rng.normal(size=(3000, 32))) * scale).astype(np.int64)
    ids, told = rng.permutation(3000).astype(np.int64), {}
    qid, q = ids[:40], c[:40]
    row, found, score = maxscore.score_shard(qid, q, maxscore.Postings(ids, c, 128), np.full(40, maxscore.LOWEST), 5, told)
    exact = [[sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for b in c] for a in q] if scale > 100 else (q @ c.T).tolist()
    for n in range(40):
        best = sorted((-s, int(i)) for s, i in zip(exact[n], ids, strict=True) if i != qid[n])[:5]
        assert [(-int(s), int(i)) for s, i in zip(score[row == n], found[row == n], strict=True)] == best
    assert told["passed"] > 0 and told["essential"] < 0.8 * told["terms"] and told["probed"] < 0.7 * told["traversed"]
    with pytest.raises(OverflowError):
        maxscore.score_shard(qid, q << 34, maxscore.Postings(ids, c << 20), np.full(40, maxscore.LOWEST), 5)


def test_maxscore_skips_shards(spark):
    rng = np.random.default_rng(2)
    rows_ = [(i, [int(x) for x in (rng.normal(size=4) * 10 + (1000 if i < 50 else 0))]) for i in range(600)]
    v = spark.createDataFrame(rows_, "id long, v array<long>").withColumn("floor", F.lit(0).cast("long"))
    shards = maxscore._packed(v.withColumn("shard", (F.col("id") >= 50).cast("long")), "shard")
    asked = maxscore._packed(v.where("id < 10").withColumn("floor", F.lit(3_000_000).cast("long")).withColumn("block", F.lit(0).cast("long")), "block")
    assert rows(maxscore._needed(shards, asked)) == [(4, 0, 0)]


def test_media_is_what_is_stored(spark):
    """Null and repeated ids, copies, shared and repeated chunks: the stored form is the recipe and the chunks it names."""
    import zstandard

    rng = np.random.default_rng(5)
    body = "".join(chr(97 + int(x)) for x in rng.integers(0, 26, 30_000))
    data = [(1, body), (None, body), (None, "other " + body), (None, "x"), (2, "y"), (2, body + " end"), (2, "y"), *[(100 + i, body[:9000]) for i in range(150)], (9, "ab" * 40_000)]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("pid", F.lit(b"clash")).withColumn("is_hot", F.lit(1))
    found = media_chunks.media_table(docs).collect()
    squeeze = zstandard.ZstdCompressor(level=media_chunks.LEVEL, write_checksum=False, write_content_size=True).compress
    expected = []
    for i, text in data:
        payload = media_chunks.payloads(pa.array([text]))[0]
        stored, parts = media_chunks.recipe(payload)
        media = stored + b"".join(squeeze(p) for p in dict.fromkeys(parts))
        expected.append((i, hashlib.sha256(payload).hexdigest(), len(media), hashlib.sha256(media).hexdigest()))
    assert sorted(((r.doc_id, r.payload_sha256, r.media_bytes, r.media_sha256) for r in found), key=repr) == sorted(expected, key=repr)


def test_language_segments_and_blocks(spark, monkeypatch):
    """Posteriors are the same in one piece and in segments, emissions in one block and in many."""
    texts = ["the cat and the dog of the house"] * 20 + ["der hund und die katze aus dem haus"] * 20
    model = langid.fit(texts, ["en"] * 20 + ["de"] * 20)
    rng = np.random.default_rng(1)
    words = ["the", "cat", "house", "der", "hund", "katze", "x", "été", "ßü"]
    column = pa.array([" ".join(rng.choice(words, int(k))) for k in rng.integers(0, 300, 30)] + ["", None, "z" * 50_000 + " the"])
    whole, first = model.emissions(column)
    monkeypatch.setattr(langid, "ROOM", 1)
    blocks, _ = model.emissions(column)
    assert np.allclose(whole, blocks)
    restart = np.zeros(len(whole), bool)
    restart[first[:-1][np.diff(first) > 0]] = True
    for size in (1, 7, 1000):
        assert np.allclose(model.posteriors(whole, restart), model.posteriors(whole, restart, size))


def test_language_learns_all_languages_once(spark):
    """Many languages, one id for very many rows, and null ids."""
    rows_ = [(None if i % 3 else 7, f"{'abcdefghij'[k % 10] * 3}{'klmnopqrst'[k // 10]} word{k} " * 3 + str(i % 5), f"l{k:02d}") for k in range(70) for i in range(12)]
    model = langid.train(spark.createDataFrame(rows_, "doc_id long, text string, lang string"))
    assert len(model.langs) == 70
    names, _ = model.label(pa.array([f"{'abcdefghij'[k % 10] * 3}{'klmnopqrst'[k // 10]} word{k}" for k in range(70)]))
    assert sum(a == f"l{k:02d}" for k, a in enumerate(names)) > 60
    held = langid.predict(spark.createDataFrame([(None, "x")], "doc_id long, text string"), model).first().held_out
    assert held is False


def test_toxicity_edges(spark):
    """Several labels for one id, ids that repeat with other texts, null ids, a very long text, clashing extra columns."""
    long = "calm words " * 60_000
    data = [(i, ("vile scum " if i % 3 == 0 else "kind words ") + f"w{i} more text here", 1) for i in range(90)]
    data += [(3, "other text of id three", 2), (None, "vile scum", 3), (500, long, 4), (501, None, 5)]
    docs = spark.createDataFrame(data, "doc_id long, text string, toxic int").withColumn("score", F.lit("mine")).withColumn("lang", F.lit(None).cast("string"))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(3, 0), (3, None), (None, 1), (500, 0), (4, 7)], "doc_id long, toxic int")
    sample = toxicity.labelled_sample(docs, labels).collect()
    assert len(sample) == len({r.doc_id for r in sample}) and {r.doc_id: r.toxic for r in sample}.get(3, 1) == 1
    assert max(len(r.text or "") for r in sample) <= toxicity.LONGEST_FIT + 40
    assert [tuple(r) for r in toxicity.labelled_sample(docs, labels, 5).orderBy("doc_id").collect()] == [tuple(r) for r in toxicity.labelled_sample(docs.repartition(7), labels, 5).orderBy("doc_id").collect()]
    model = toxicity.train(docs, labels)
    found = toxicity.score(docs, model).collect()
    assert len(found) == len(data) and all(r.held_out is not None for r in found)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} == {"mine"}
    plain = toxicity.Classifier.scores(model, pa.array([t for _, t, _ in data], pa.string()))
    assert np.allclose(sorted(r.score for r in found), np.sort(plain), atol=1e-5)


def test_toxicity_features_equal_brute_force():
    """Filters applied word by word to the embeddings, the largest over the document, then the output layer."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["vile", "scum", "kind", "word", "tree", "sky"], int(k))) for k in rng.integers(1, 12, 80)]
    model = toxicity.fit(texts, np.array([int("vile scum" in t) for t in texts]))
    words, first = toxicity._word_ids(pa.array([*texts, "", "vile"]))
    found = model.logits(words, first)
    for row in range(len(texts) + 2):
        own = model.embed[model.slots[words[first[row] : first[row + 1]] % np.uint64(toxicity.BUCKETS)]]
        h = np.zeros(len(toxicity.WIDTHS) * toxicity.FILTERS)
        if len(own):
            padded = np.concatenate([own, np.repeat(model.embed[:1], max(toxicity.WIDTHS) - 1, 0)])
            for i, w in enumerate(toxicity.WIDTHS):
                conv = [sum(padded[t + j] @ model.filters[i][j] for j in range(w)) for t in range(len(own))]
                h[i * toxicity.FILTERS : (i + 1) * toxicity.FILTERS] = np.maximum(np.max(conv, 0) + model.shift[i], 0)
        assert abs(found[row] - (h @ model.out + model.bias)) < 1e-3


def test_mix_closes_gaps_and_keeps_columns(spark):
    """One source of a few documents of very different sizes; clashing names; null and repeated ids with other texts."""
    sizes = [900, 5, 7, 300, 40, 1, 620, 81, 3, 2, 77, 150]
    data = [(None if i % 5 == 0 else 4, "w " * n, "a", n) for i, n in enumerate(sizes)] + [(50 + i, "v " * n, "b", n) for i, n in enumerate(sizes[::-1])] + [(70, None, None, 0), (71, "x " * 4000, "c", 4000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, times int").withColumn("taken_id", F.lit("t")).withColumn("sk", F.lit(1)).withColumn("mix_copy", F.lit(2))
    found = source_mix.mix(docs)
    for r in found.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.count("*").alias("n")).collect():
        assert r.n == {"a": 12, "b": 12, "c": 1}.get(r.source, 1) and (r.source == "c" or abs(r.target - r.taken) <= 0.02 * r.target)
    rows_ = source_mix.mixed_rows(docs)
    assert rows_.columns == docs.columns
    got = {(r.doc_id, r.times): r["count"] for r in rows_.groupBy("doc_id", "times").count().collect()}
    assert got == {(r.doc_id, r.size): r.copies for r in found.collect() if r.copies}
    for few in (2, 3):
        assert rows(source_mix.mix(docs, buckets=few)) == rows(found)
