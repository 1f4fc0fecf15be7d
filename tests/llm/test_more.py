"""Token files, sharding, quality, language, decontamination and pieces against brute force."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrel.llm import decontaminate, language, pieces, quality, sharding, token_files

P = pytest.importorskip("public_tokenizers")
ODD = ["", " ", "  a", "a  b   c ", "\n\n x\ty", "▁▁", "日本語 😀 é é", "a" * 40, "a\x00b", "it's don't I'LL", "<|endoftext|> a", "ΑΣ Σ İ", "a b　c\x1cd\x85e"]


# --- op 1


@pytest.fixture(scope="module")
def word_tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def test_token_files_round_trip(spark, docs, corpus, word_tok):
    files = token_files.write(spark, docs, P.path("word_bpe_49k.json"), sequence=16, batch=4)
    got = sorted(map(tuple, token_files.read(spark, files).collect()), key=lambda r: r[1])
    ids = {r: [*word_tok.encode(r or "", add_special_tokens=False).ids, 1] for r in {x[1] for x in corpus}}
    crc = {r: zlib.crc32(np.array(i, "<u4").tobytes()) for r, i in ids.items()}
    assert sorted((r[0], r[2], r[3]) for r in got if r[0] is not None) == sorted((x[0], len(ids[x[1]]), crc[x[1]]) for x in corpus if x[0] is not None)
    assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])[:-1]]).tolist()
    key = [-1 if r[0] is None else r[0] for r in got]
    assert key == sorted(key)


def test_sequences_are_views(spark, docs):
    files = token_files.write(spark, docs, P.path("word_bpe_49k.json"), sequence=16, batch=4)
    f = token_files.SequenceFile(files.first().path)
    n = files.first().n_tokens
    all_ids = f.ids(0, n)
    for i in range(-(-n // 16)):
        ids, mask = f.sequences(i)
        assert len(ids) == 16 and not ids.flags.owndata
        assert (ids[np.asarray(mask)] == all_ids[16 * i : 16 * i + 16]).all()


def test_words_encode_as_whole_texts(word_tok, corpus):
    texts = ODD + [r[1] or "" for r in corpus]
    ids, n = token_files.WordEncoder(P.path("word_bpe_49k.json")).encode_all(texts)
    want = [word_tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_tokenizer_gives_the_ids_of_the_library(corpus, name):
    from tokenizers import Tokenizer

    enc, tok = token_files.WordEncoder(P.path(name)), Tokenizer.from_file(P.path(name))
    assert enc.by_words == (name == "word_bpe_49k.json")
    texts = ODD + [r[1] or "" for r in corpus]
    ids, n = enc.encode_all(texts)
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert [len(x) for x in enc.encode_all([])] == [0, 0]


def test_very_long_texts_are_encoded_in_slices(word_tok):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    text = " ".join(rng.choice(words) + rng.choice(["", ",", "\n", "  "]) for _ in range(700_000))
    assert len(text) > token_files.SLICE
    ids, n = token_files.WordEncoder(P.path("word_bpe_49k.json")).encode_all(["a", text, "b"])
    want = word_tok.encode(text, add_special_tokens=False).ids
    assert n[1] == len(want) and ids[1:-1].tolist() == want


def test_no_documents_no_files(spark, empty):
    files = token_files.write(spark, empty, P.path("word_bpe_49k.json"))
    assert files.collect() == [] and token_files.read(spark, files).collect() == []


# --- op 4


def test_no_rows(spark, empty):
    assert sharding.assign(spark, empty).collect() == []


def test_shards_as_folders(spark, docs, tmp_path):
    with pytest.raises(ValueError):
        sharding.write(docs, str(tmp_path / "out"))  # a column of that name is there
    sharding.write(docs, str(tmp_path / "out"), weights=[1.0, 1.0, 3.0], name="of")
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and {r.of for r in back.select("of").distinct().collect()} <= {0, 1, 2}
    assert set(back.columns) == {*docs.columns, "of"} and {r.shard for r in back.select("shard").distinct().collect()} == {"x", "y", None}
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("doc_id"), [1.0, 0.0])


def _xxh64(raw, seed):
    import xxhash

    return xxhash.xxh64_intdigest(raw, seed)


def test_shards_are_those_of_plain_rendezvous_hashing(spark, docs):
    weights = [1.0, 2.5, 0.5, 1.0, 4.0]

    def shard(key, w):
        bids = []
        for s, x in enumerate(w):
            h = 42 if key is None else _xxh64(key.to_bytes(8, "little", signed=True), 42)  # a null leaves the seed as it is
            h = _xxh64(b"shard", _xxh64(s.to_bytes(4, "little"), h))
            bids.append((-math.log(((h >> 11) + 0.5) / 2**53) / x, s))
        return min(bids)[1]

    got = sharding.assign(spark, docs, weights=weights, grown_weight=3.0).collect()
    assert [(r.shard, r.grown_shard) for r in got] == [(shard(r.doc_id, weights), shard(r.doc_id, [*weights, 3.0])) for r in got]


def test_shards(spark, docs, corpus):
    got = sharding.assign(spark, docs, shards=7, rows_per_bucket=5).collect()
    assert len(got) == len(corpus)
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 7) for r in got)
    assert any(r.grown_shard == 7 for r in got)
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((x[1] or "").encode()) + 16, zlib.crc32((x[1] or "").encode())) for x in corpus)
    by_id = {}
    for r in got:
        assert by_id.setdefault(r.doc_id, r.shard) == r.shard


def test_weights(spark):
    rows = spark.range(20_000).select(sharding.rendezvous(F.col("id"), [1.0, 2.0, 1.0]).alias("s")).groupBy("s").count().collect()
    share = {r.s: r["count"] / 20_000 for r in rows}
    assert abs(share[1] - 0.5) < 0.02 and abs(share[0] - 0.25) < 0.02


# --- op 6


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark, sf, docs, empty):
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(spark, d, lab)
    s = {r.doc_id: r.score for r in quality.score(spark, d, model).collect()}
    held = [(r.quality, s[r.doc_id]) for r in lab.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(x >= 0.3) == q for q, x in held]) > 0.95
    odd = quality.score(spark, docs, model, carry=("lang",)).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert quality.score(spark, empty, model).collect() == []
    none = quality.train(spark, d, lab.limit(0))
    assert {r.score for r in quality.score(spark, docs, none).collect()} == {0.5}


def test_interaction_is_learned():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x, y)
    assert ((m.score(x) > 0.5) == y).mean() > 0.9
    assert m.pairs[0][:2] == (0, 1)


def plain_scores(cuts, tables, pairs, base, x):
    """Each row by itself: count the edges at or below a value, look its table up, add."""
    at = lambda e, v: sum(c <= v for c in e)
    out = []
    for row in x.tolist():
        z = base + sum(t[at(c, v)] for c, t, v in zip(cuts, tables, row, strict=True))
        z += sum(t[at(ci, row[i])][at(cj, row[j])] for i, j, ci, cj, t in pairs)
        out.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
    return np.array(out)


def plain_features(t):
    raw = t.encode()
    n = max(1, len(raw))
    ws = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    low = [w.lower() for w in ws]
    lines = raw.split(b"\n")
    m = max(1, len(ws))
    kinds = [sum(c in k for c in raw) / n for k in quality._KINDS.values()]
    odd = quality._KINDS["mark"] + quality._KINDS["shout"]
    return kinds + [
        math.log1p(len(raw)), sum(map(len, ws)) / m, sum(len(w) > 20 for w in ws) / m, sum(w[-1] in odd for w in ws) / m, sum(a == b for a, b in itertools.pairwise(low)) / m,
        len(set(low)) / math.sqrt(m) / math.sqrt(max(1, min(m, 400))), len(set(lines)) / len(lines), math.log1p(len(raw) / len(lines)), sum(a == b for a, b in itertools.pairwise(raw)) / n,
    ]


def test_features_and_scores_against_plain_loops(corpus):
    texts = [r[1] or "" for r in corpus] + ["A b! ÄÖ #x\n\nA b!", "x" * 300_000 + " yes"]
    x = quality.features([t.encode() for t in texts])
    for row, t in zip(x, texts, strict=True):
        want = plain_features(t)
        assert row == pytest.approx(want, abs=1e-9)
    assert (quality.features([texts[0].encode(), b"\n\n"])[1] == quality.features([b"\n\n"])[0]).all()
    y = (x[:, 9] > np.median(x[:, 9])).astype(float)
    m = quality.fit(x, y, rounds=20, pair_rounds=5)
    assert m.score(x) == pytest.approx(plain_scores(m.cuts, m.tables, m.pairs, m.base, x), abs=1e-12)


def test_trees_take_the_best_cuts():
    """First cuts against all cuts, one after the other."""
    rng = np.random.default_rng(1)
    g, h = rng.normal(0, 1, (5, 6)), rng.random((5, 6))
    worth = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    best = None
    for axis in (0, 1):
        for cut in range(1, g.shape[axis]):
            low = (np.indices(g.shape)[axis] < cut)
            best = max(best or (-1e9,), (worth(low) + worth(~low), axis, cut, low), key=lambda v: v[0])
    low = best[3]
    want = np.where(low, g[low].sum() / (h[low].sum() + 1), g[~low].sum() / (h[~low].sum() + 1))
    assert quality._grid_tree(g, h, leaves=2) == pytest.approx(want)
    line = quality._grid_tree(g[:1], h[:1], leaves=4)[0]
    assert line == pytest.approx(quality._tree(g[0], h[0], leaves=4))


# --- op 7


def test_languages_on_held_out_rows(spark, sf, docs, empty):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.train(spark, d)
    rows = {r.doc_id: r for r in language.identify(spark, d, model).collect()}
    held = [r for r in d.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.lang]
    assert np.mean([rows[r.doc_id].lang_pred == r.lang for r in held]) > 0.97
    odd = language.identify(spark, docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    lang, score, _ = model.predict([None, "", "12 $ 3", "the"])
    assert lang[:3] == ["und"] * 3 and score[:3].tolist() == [0, 0, 0] and lang[3] != "und"
    assert language.identify(spark, empty, model).collect() == []
    assert {r.lang_pred for r in language.identify(spark, docs, language.train(spark, empty)).collect()} == {"und"}


def test_kneser_ney_sums_to_one():
    k, _ = language.grams(["abracadabra", "the cat sat on the mat"])
    u, n = np.unique(k, return_counts=True)
    chars = np.unique(k & np.uint64(0xFFFF))
    m = language.KneserNey(u, n, len(chars))
    for ctx in (u[3], u[10], np.uint64(0x0078_0079_007A_0000)):
        p = np.exp2(-m.surprise((ctx & ~np.uint64(0xFFFF)) | chars))
        assert abs(p.sum() - 1) < 1e-9


class PlainKneserNey:
    """The same models in dictionaries of strings."""

    def __init__(self, texts, alphabet):
        self.levels, self.alphabet = {}, alphabet
        counts = Counter(g for t in texts for g in self.grams(t))
        for n in (4, 3, 2, 1):
            once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
            total, kinds = Counter(), Counter()
            for g, c in counts.items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            self.levels[n] = (once / (once + 2 * twice) if once and twice else 0.5, counts, total, kinds)
            counts = Counter(g[1:] for g in counts)

    @staticmethod
    def grams(t):
        s = "".join(c.lower()[0] if c.isalpha() else " " for c in t)
        s = re.sub(" +", " ", s).strip(" ")
        s = "   " + s + " " if s else "   "
        return [s[i - 3 : i + 1] for i in range(3, len(s))]

    def bits(self, t):
        out = 0.0
        for g in self.grams(t):
            p = 1 / self.alphabet
            for n in (1, 2, 3, 4):
                d, counts, total, kinds = self.levels[n]
                own, ctx = g[4 - n :], g[4 - n : -1]
                if total[ctx]:
                    p = (max(counts[own] - d, 0) + d * kinds[ctx] * p) / total[ctx]
            out -= math.log2(p)
        return out


def test_models_against_plain_dictionaries(spark):
    rng = random.Random(3)
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))
    letters = {"x": "aabcdé", "y": "abbefß", "z": "cdegh"}
    rows = [(i, make(letters[l], rng.randint(1, 40)) + rng.choice(["", "!", " 12. Öh"]), l) for i, l in enumerate(rng.choices("xyz", k=300))]
    rows += [(None, "no id", "x"), (301, None, "x"), (302, "no language", None), (303, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    model = language.train(spark, df)
    known = [r for r in rows if r[0] is not None and r[2] and zlib.crc32(str(r[0]).encode()) % 3 != 1]
    alphabet = len({g[-1] for r in known for g in PlainKneserNey.grams(r[1] or "")}) + 1
    plain = {l: PlainKneserNey([r[1] or "" for r in known if r[2] == l], alphabet) for l in "xyz"}
    texts = [r[1] for r in rows[:60]] + [make("abcdefgh", 30), "Zz", make("abcde", 60_000)]
    h, n = model.entropies(texts)
    for i, t in enumerate(texts):
        k = len(PlainKneserNey.grams(t))
        assert n[i] == k and h[i] == pytest.approx([plain[l].bits(t) / k for l in "xyz"], rel=1e-4)
    lang, score, _ = model.predict(texts)
    assert lang == ["xyz"[int(np.argmin(x))] for x in h] and (score > 0).all() and (score <= 1).all()


# --- op 3


def edits(a, b):
    """The least edits of a against any stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def whole_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_decontamination(spark, empty):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    items = [" ".join(word() for _ in range(n)) for n in (5, 8, 15, 30, 60)] + [None, "short", "", "not so long"]
    texts = [None, "", "a", "a NOT so long text", "not so longish", "cannot so long", "x cannot so long, not so\nlong."]
    for t in items[:5]:
        for k in (0, 1, len(t) // 20, len(t) // 9, len(t) // 5):
            w = list(t)
            for _ in range(k):
                i = rng.randrange(len(w))
                w[i : i + 1] = rng.choice([[], ["x"], [w[i], "y"]])
            texts.append(" ".join(word() for _ in range(rng.randint(0, 40))) + " " + "".join(w).upper() + " " + " ".join(word() for _ in range(20)))
    texts += [texts[7], " ".join([items[1], word(), items[1]])]  # a repeated row, and two places
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, doc_id int")
    found = decontaminate.find(spark, d, b, max_item_bytes=300).collect()
    got = {(r.doc_id, r.item_id): r.edits for r in found}
    want = {(i, j): e for i, t in enumerate(texts) for j, x in enumerate(items) if t and x and len(x) >= decontaminate.MIN_CHARS and (e := edits(x.lower(), t.lower())) <= decontaminate.budget(len(x))}
    want |= {(3, 8): 0, (6, 8): 0}
    assert got == want and len(want) >= 14 and len(found) == len(got)
    for r in found:  # the alignment is where it is said to be
        assert whole_edits(items[r.item_id].lower(), texts[r.doc_id].lower().replace("\n", " ")[r.begin : r.end]) == r.edits
    assert min(r.begin for r in found if r.doc_id == len(texts) - 1) == 0
    assert {r.item_id for r in decontaminate.too_short(b).collect()} == {6, 7}
    kept = {r.doc_id for r in decontaminate.clean(spark, d, b).collect()}
    assert kept == set(range(len(texts))) - {i for i, _ in want}
    assert decontaminate.clean(spark, d, b).columns == d.columns
    assert decontaminate.find(spark, empty, b).collect() == [] and decontaminate.find(spark, d, b.limit(0)).collect() == []


def test_passage_in_a_very_long_text(spark):
    rng = random.Random(8)
    item = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30))
    head = "".join(rng.choice("abcdefgh ") for _ in range(1_200_000))
    broken = item[:50] + "zz" + item[52:]
    df = spark.createDataFrame([(1, head + " " + broken + " " + head[:5000]), (2, head)], "doc_id long, text string")
    got = decontaminate.find(spark, df, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(1, 5, 2, len(head) + 1, len(head) + 1 + len(item))]


# --- op 9


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


@pytest.mark.parametrize("size", [5, 64, 1000])
def test_chunks_encode_as_the_library(sp, corpus, size):
    m = pieces.Model(P.path("piece_bpe_32k.model"))
    texts = [*ODD, "supercalifragilistic" * 9, *(r[1][:600] for r in corpus[::9] if r[1])]
    for t in texts:
        assert pieces.encode(m, t).tolist() == sp.encode(t)
        assert pieces.encode_giant(m, t, size).tolist() == sp.encode(t)
        assert m.decode(pieces.encode(m, t)).decode() == t.replace("▁", " ")


def test_lattices_of_many_words_are_those_of_one(corpus, sp):
    """Words with and without characters that are pieces, long and short, against the one-by-one path and the library."""
    rng = random.Random(6)
    some = [w for t in [*ODD, *(r[1] for r in corpus if r[1])] for w in pieces.words(t.replace(" ", pieces.SPACE)) if w]
    some += [pieces.SPACE + "".join(rng.choice("etaoinshrdlucmfwypvbgk" * 3 + "EA.,'-0é日😀\n") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    some = sorted(set(some))
    m = pieces.Model(P.path("piece_bpe_32k.model"))
    lattice = pieces.Lattice(m)
    got = lattice.paths(some)
    assert sum(x is not None for x in got) > 2500 and any(x is None for x in got)
    assert all(x is None or x == m.ids(pieces.only_path(m, w)) for w, x in zip(some, got, strict=True))
    sound = [p for p, x in lattice.parts.items()]
    pairs = [(rng.choice(sound), rng.choice(sound)) for _ in range(20_000)] + [(w[:k], w[k:]) for w in some for k in (2, 3) if w[:k] in lattice.parts and w[k:] in lattice.parts]
    assert all(lattice._apart(a, b) == m.open(a, b) for a, b in pairs) and 0.2 < np.mean([lattice._apart(a, b) for a, b in pairs])
    m.learn(some)
    for w in some[::7]:
        assert m.word(w) == m.ids(pieces.only_path(m, w)) == m.ids(m.merged(list(w)))


def test_documents(spark, docs, corpus, empty, sp):
    got = pieces.encode_documents(spark, docs, P.path("piece_bpe_32k.model"), giant=400, chunk=100)
    rows = got.collect()
    assert all(r.round_trip for r in rows)
    assert sorted(((r.doc_id, list(r.ids)) for r in rows), key=str) == sorted(((x[0], sp.encode(x[1] or "")) for x in corpus), key=str)
    d = pieces.digest(got).collect()
    assert sorted((r.n_pieces, r.ids_crc32) for r in d) == sorted((len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in rows)
    assert pieces.encode_documents(spark, empty, P.path("piece_bpe_32k.model")).collect() == []


def test_max_plus_finds_the_best_unigram_path():
    m = pieces.Model.__new__(pieces.Model)
    rng = random.Random(1)
    m.bpe, m.prefix, m.byte, m.unknown, m.words, m.lattice = False, False, {}, 0, {}, None
    m.text = ["?", *sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(20)} | {"a", "b"})]
    m.score = [-20.0, *(-rng.random() * 5 for _ in m.text[1:])]
    m.id = {p: i for i, p in enumerate(m.text) if i}
    m.longest, m.low, m.known = 4, -30.0, pieces.starts(m.id, False)
    for _ in range(20):
        t = "".join(rng.choice("ab") for _ in range(60))
        best = [0.0] + [-1e9] * len(t)
        for i in range(len(t)):
            for n in range(1, 5):
                if t[i : i + n] in m.id and i + n <= len(t):
                    best[i + n] = max(best[i + n], best[i] + m.score[m.id[t[i : i + n]]])
        for size in (4, 7, 100):
            ids = pieces.encode_giant(m, t, size)
            assert "".join(m.text[i] for i in ids) == t
            assert abs(sum(m.score[i] for i in ids) - best[-1]) < 1e-9
