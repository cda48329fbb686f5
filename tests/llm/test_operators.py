"""Each operator against brute force on small tables with nulls, empty and long texts, copies and clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from ledgerlens.llm import (
    jaccard,
    language,
    media,
    packing,
    pii,
    quality_model,
    quality_rules,
    sentence_pieces,
    tokens,
    toxicity,
)
from ledgerlens.llm.common import shared_folder
from ledgerlens.llm.queries import packed_sequences, vocabulary_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(4)
VOCABULARY = ["".join(rng.choice("abcdefgéñß") for _ in range(rng.randint(1, 6))) for _ in range(60)]


def sentence(n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


BASE = sentence(120)
TEXTS = [
    None, "", " \n\t ", "one", "Two words", BASE, BASE, BASE.upper().replace("É", "é"), BASE + " tail", BASE.replace(" ", "\n", 7),
    "x " * 300, "line a\nline a\n\nline a", sentence(5000), sentence(60) + " ### $$", "<|endoftext|> is text", "  two  spaces \n here ",
    *(sentence(rng.randint(3, 90)) for _ in range(12)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "was here", "was here") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, kept string").repartition(3)


def by_id(df) -> pd.DataFrame:
    return df.toPandas().set_index("doc_id").sort_index()


def test_quality_rules(spark, docs):
    trusted = spark.createDataFrame([(5,), (12,)], "doc_id long")
    found = by_id(quality_rules.quality_rules(docs, trusted))
    assert found["score"].eq("was here").all()
    for i, t in enumerate(TEXTS):
        w = WORD.findall(t or "")
        runs = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        covered = {j + k for j, r in enumerate(runs) if runs.count(r) > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert tuple(found.loc[i, list(quality_rules.SIGNALS)]) == expected, i
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert found.base_failed[i] == failed and found.kept[i] == (not failed and found.llr[i] >= quality_rules.MIN_LLR)
    nobody = by_id(quality_rules.quality_rules(docs, trusted.where("doc_id < 0")))
    assert (nobody.llr == 0).all()


def test_quality_rules_llr_against_brute_force(spark, docs):
    import xxhash

    def words(t):
        return WORD.findall(t or "")

    def signed(x):
        return x - (1 << 64) if x >= 1 << 63 else x

    def grams(t):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words(t)]
        two = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(h, h[1:])]
        return [signed(x) & 0xFFFF for x in h + two]

    count = {i: np.bincount(grams(t), minlength=1 << 16) for i, t in enumerate(TEXTS)}
    raw, good = sum(count.values()), count[5] + count[12]
    share = good.sum() / raw.sum()
    trusted = spark.createDataFrame([(5,), (12,)], "doc_id long")
    found = by_id(quality_rules.quality_rules(docs, trusted))
    for i in count:
        own = i in (5, 12)
        prior = quality_rules.SMOOTHING
        ratio = np.log((np.maximum(good - own, 0) + prior) / (np.maximum(raw - 1, 0) * share + prior))
        expected = (count[i] * ratio).sum() / max(1, count[i].sum())
        assert abs(found.llr[i] - expected) < 2e-6, i


def test_quality_rules_with_more_trusted_ids_than_are_broadcast(spark, docs):
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    trusted = spark.createDataFrame([(i,) for i in [*ids[::3], *ids[:4], None, 10**9]], "doc_id long")
    rows = docs.unionByName(spark.createDataFrame([(None, sentence(60)), (ids[0], sentence(60))], "doc_id long, text string"), allowMissingColumns=True)
    order = ["doc_id", "n_words", "word_chars"]
    few = quality_rules.quality_rules(rows, trusted).toPandas().sort_values(order, ignore_index=True)
    many = quality_rules.quality_rules(rows, trusted, broadcast_ids=0)
    assert many.toPandas().sort_values(order, ignore_index=True).equals(few)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "BroadcastNestedLoop" not in plan


def test_quality_rules_filter_passes_all_trusted_ids_and_few_others(spark):
    ids = spark.range(0, 60_000, 3).withColumnRenamed("id", "doc_id")
    passed = spark.range(60_000).withColumnRenamed("id", "doc_id").where(quality_rules._may_be_among(ids, 20_000))
    found = {r.doc_id for r in passed.collect()}
    assert found >= set(range(0, 60_000, 3)) and len(found) < 22_000


def test_language(spark, docs):
    references = {"a": language.normalised(TEXTS[12])[:2000], "b": "the quick brown fox jumps over the lazy dog " * 20}
    found = by_id(language.identify(docs, references))
    assert found.lang_pred[[0, 1, 2]].eq("und").all() and found.lang_pred[5] == "a" and found.score.between(0, 1).all()
    texts = [language.normalised(t) for t in TEXTS]
    pairs = tuple(sorted(references.items()))

    def phrases(t, ref):
        n = i = 0
        while i < len(t):
            k = 1
            while i + k <= len(t) and t[i : i + k] in ref:
                k += 1
            i, n = i + max(1, k - 1), n + 1
        return n

    assert (language.phrase_counts(texts, pairs) == [[phrases(t, r) for _, r in pairs] for t in texts]).all()
    assert by_id(language.identify(docs, {})).lang_pred.eq("und").all()
    labelled = docs.selectExpr("text", "CASE WHEN doc_id % 2 = 0 THEN 'a' END AS lang")
    assert list(language.reference_texts(labelled)) == ["a"]
    assert language.reference_texts(labelled.where("lang = 'none'")) == {}


def jaccard_truth(rows: dict, words: int, percent: int) -> dict:
    upper = bytes(range(65, 91))
    sets = {}
    for i, t in rows.items():
        w = WORD.findall((t or "").encode().translate(bytes.maketrans(upper, upper.lower())).decode())
        sets[i] = {tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set()
    up = {i: i for i in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in rows:
        for j in rows:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(sets[i]), root(i)) for i in rows}


@pytest.mark.parametrize("long_list, block", [(64, 1_000_000), (3, 400)])
def test_jaccard(spark, monkeypatch, long_list, block):
    monkeypatch.setattr(jaccard, "LONG_LIST", long_list)
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", block)
    rows = dict(enumerate(TEXTS))
    for k in range(40):  # a family around the limit, of long and of short texts
        words = BASE.split() if k % 2 else BASE.split()[:30]
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(9)}"
        rows[100 + k] = " ".join(words)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows.items()], "doc_id long, text string, n string").repartition(3)
    found = by_id(jaccard.jaccard_components(df))
    assert {i: (found.n_shingles[i], found.component_id[i]) for i in rows} == jaccard_truth(rows, 3, 90)
    if long_list == 64:
        assert jaccard.jaccard_components(df.where("false")).count() == 0


def test_exact_links_connect_what_links():
    sets = [np.unique(np.array([rng.randrange(60) for _ in range(50)])) for _ in range(80)]
    links = jaccard.exact_links(np.arange(80), sets, 70)
    joined = jaccard._Forest(80)
    for a, b in links:
        joined.up[joined.root(a)] = joined.root(b)
    for i in range(80):
        for j in range(i):
            x, y = set(sets[i]), set(sets[j])
            if 100 * len(x & y) >= 70 * len(x | y):
                assert joined.root(i) == joined.root(j)


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = packed_sequences(docs).toPandas()
    assert 50256 in tokenizer.encode(TEXTS[14], add_special_tokens=False).ids
    for i, pieces in found.sort_values("piece").groupby("doc_id"):
        ids = [*tokenizer.encode(TEXTS[i] or "", add_special_tokens=False).ids, 0]
        assert pieces.start.tolist() == [0, *pieces.length.cumsum()[:-1]] and pieces.length.sum() == len(ids)
        assert (pieces.length[1:] == 2048).all() and len(pieces) == -(-len(ids) // 2048)
        for p in pieces.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    for _, held in found.sort_values("offset").groupby("sequence_id"):
        assert held.offset.tolist() == [0, *held.length.cumsum()[:-1]] and held.length.sum() <= 2048
    assert set(found.doc_id) == set(range(len(TEXTS)))


def test_packing_is_close_to_the_bound():
    lengths = np.random.default_rng(1).lognormal(5.8, 0.9, 8000).astype(int).clip(1, 2048)
    sequence, _, _ = packing.pack_lengths(lengths, 2048)
    assert len(set(sequence)) <= 1.005 * lengths.sum() / 2048 + 2


def test_token_files_of_any_shape(spark):
    import pyarrow.fs as pafs

    folder = shared_folder(spark)
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root)
    files = {"open": [5, 6, 50256, 50256, 7], "closed": [1, 50256], "empty": [], "many": [3, 50256] * 5000}
    for name, ids in files.items():
        with fs.open_output_stream(f"{root}/{name}") as out:
            out.write(np.array(ids, "<u2").tobytes())
    paths = spark.createDataFrame([(f"{root}/{name}",) for name in files], "path string")
    for block in (2, 6, 8 << 20):
        rows = tokens.count_tokens(spark, folder, paths, block_bytes=block).toPandas().sort_values(["path", "ordinal"])
        for name, ids in files.items():
            found = rows[rows.path == f"{root}/{name}"][["ordinal", "start", "n_tokens", "closed"]].values.tolist()
            expected, start = [], 0
            for at, i in enumerate([*ids, None]):
                if i == 50256 or (i is None and at > start):
                    expected.append([len(expected), start, at - start, i == 50256])
                    start = at + 1
            assert found == expected, (name, block)
    with fs.open_output_stream(f"{root}/odd") as out:
        out.write(b"abc")
    for bad in ("odd", "missing"):
        with pytest.raises(Exception):
            tokens.count_tokens(spark, folder, spark.createDataFrame([(f"{root}/{bad}",)], "path string")).count()
    with pytest.raises(ValueError):
        tokens._sixteen_bits(np.array([70_000], "<u4"))


def test_token_files(spark, docs):
    folder = shared_folder(spark)
    held = tokens.write_token_files(docs, folder, vocabulary_path("byte_bpe_50k.tiktoken"))
    cache = tokens.TokenCache(vocabulary_path("byte_bpe_50k.tiktoken"))
    for block in (64, 8 << 20):
        counted = tokens.count_tokens(spark, folder, held, block_bytes=block)
        found = by_id(held.join(counted, ["path", "ordinal"], "left"))
        assert [len(cache.encode(t or "")) // 4 for t in TEXTS] == found.n_tokens.tolist() and found.closed.all()


def test_media(spark, docs):
    folder = shared_folder(spark)
    found = by_id(media.with_payload(media.with_metadata(media.store(docs, folder), folder), folder))
    for i, t in enumerate(TEXTS):
        data = (t or "").encode()
        payload = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
        row = found.loc[i]
        assert (row.n_bytes, row.payload_bytes, row.height) == (len(data), len(payload), len(payload) // 192)
        assert row.payload_sha256 == hashlib.sha256(payload).hexdigest() == row.digest
        assert row.tail_crc32 == zlib.crc32(payload[-16:])
    assert found.media_sha256[5] == found.media_sha256[6] and found.feature[0] == found.feature[1]


def luhn(digits: str) -> bool:
    values = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in values) % 10 == 0


def test_pii(spark):
    texts = [
        "call +1 (974) 555-3436 or 974-555-3436", "at 161.17.88.162. not 999.1.1.1 or 4.0", "4111111111111111 and 4111 1111 1111 1111",
        "4111111111111112 stays", "joé.12@mail7.example.com", "1984-02-29 29/02/1984 not 1983-02-29", None, "", "plain text",
        'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "7536784127813050 4845168114407329 123", "again 4111111111111111",
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pii string")
    found = by_id(pii.pseudonymise(df, "key"))
    out = found.text
    assert out[[3, 7, 8]].tolist() == [texts[i] for i in (3, 7, 8)] and out[6] is None and found.pii.map(len).tolist() == [2, 1, 2, 0, 1, 2, 0, 0, 0, 1, 2, 1]
    assert [re.sub(r"\d", "0", out[i]) for i in (0, 2)] == [re.sub(r"\d", "0", texts[i]) for i in (0, 2)]
    cards = re.findall(r"\d{4} ?\d{4} ?\d{4} ?\d{4}", out[2] + " " + out[11])
    assert len({c.replace(" ", "") for c in cards}) == 1 and all(luhn(c.replace(" ", "")) for c in cards)
    assert len(cards) == 3 and not any(c.startswith("4111111111111111") for c in cards)
    assert out[1].endswith("not 999.1.1.1 or 4.0") and out[1] != texts[1] and out[4].endswith("@mail7.example.com") and out[4] != texts[4]
    iso, eu = out[5].split()[:2]
    assert pd.Timestamp(iso) and int(eu[:2]) > 12 and pd.to_datetime(eu, format="%d/%m/%Y")
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', out[9]) and out[9] != texts[9]
    assert by_id(pii.pseudonymise(df, "other")).text[2] != out[2]


def test_pii_in_any_case_and_grouping(spark):
    def card(digits: str, *groups: int) -> tuple[str, str]:
        digits += next(c for c in "0123456789" if luhn(digits + c))
        ends = np.cumsum(groups or (len(digits),)).tolist()
        return digits, " ".join(digits[a:b] for a, b in zip([0, *ends], ends))

    kinds = {
        'TOKEN = "9233A8EC04DBEBAB91AB85687D33EEAA"': ["secret"], "Password: '04dbebab91ab85687d33eeaaf9ac699e'": ["secret"],
        "at +44 20 7946 0958.": ["phone"], "+49 30 901820": ["phone"], "+442079460958": ["phone"], "(030) 901 820 11": ["phone"], "+12 3": [], "(12) 345": [],
        "1234 5678 9012 974-555-3436": ["phone"], "4111 1111 1111 1111 2024-01-02": ["card", "date"], "4111 1111 1111 1112": [],
    }
    groups = {13: (4, 3, 3, 3), 14: (4, 6, 4), 15: (5, 5, 5), 17: (6, 6, 5), 18: (9, 9), 19: (4, 4, 4, 4, 3)}
    cards = [card("5036871234567890123"[: n - 1], *sizes) for n, sizes in groups.items()]
    kinds |= {f"card {written}": ["card"] for _, written in cards} | {f"card {written.replace(' ', '-')} x": ["card"] for _, written in cards}
    kinds |= {"4111 1111 1111 1111 123": ["card"], "12 4111 1111 1111 1111": ["card"]}
    df = spark.createDataFrame(list(enumerate(kinds)), "doc_id long, text string")
    found = by_id(pii.pseudonymise(df, "key"))
    images: dict[str, set] = {}
    for i, (text, wanted) in enumerate(kinds.items()):
        assert found.pii[i].tolist() == wanted, text
        assert (found.text[i] != text) == bool(wanted) and len(found.text[i]) == len(text)
        if text.startswith("card"):
            number = re.sub(r"\D", "", found.text[i])
            assert luhn(number)
            images.setdefault(re.sub(r"\D", "", text), set()).add(number)
    assert all(len(x) == 1 for x in images.values()) and len(images) == len(groups)
    phones = [found.text[i] for i, t in enumerate(kinds) if "7946" in t or "2079" in t]
    assert len({re.sub(r"\D", "", p) for p in phones}) == 1 and all("+44" in p for p in phones)
    assert found.text[len(kinds) - 2].endswith(" 123") and found.text[len(kinds) - 1].startswith("12 ")


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F

    df = spark.range(17 * 43).select(F.array(F.floor(F.col("id") / 43), F.col("id") % 43).alias("v"))
    image = pii.feistel(F.col("v"), F.array(F.lit(17), F.lit(43)), "k", F.lit("date"))
    rows = {tuple(r[0]) for r in df.select(image).collect()}
    assert len(rows) == 17 * 43 and all(0 <= a < 17 and 0 <= b < 43 for a, b in rows)


def library():
    import sentencepiece

    path = vocabulary_path("piece_bpe_32k.model")
    return sentencepiece.SentencePieceProcessor(model_file=path), sentence_pieces.read_vocabulary(path)


ODD = [
    "“Été” – 12345.67!!!\n\n\tnaïve façade’s…", "Привет, мир 中文字符 🙂🙂 a🙂b", "abcdefgh" * 40, "=" * 300 + "x", "   a    b\r\n  ",
    "a▁b ▁", "x1y2z3", "½²³ ─══─ †", " ", " " * 100, "中文" * 2000, "￿ x", "- - -- --- ---- " * 9,
    "".join(chr(rng.choice([rng.randint(1, 0x17F), rng.randint(0x370, 0x4FF), rng.randint(0x2000, 0x2600)])) for _ in range(3000)),
    *(" ".join("".join(rng.choice("aabcdeeinorstt'-=_▁ ") for _ in range(rng.randint(1, 30))) for _ in range(60)) for _ in range(12)),
]


@pytest.mark.parametrize("sample_docs", [20_000, 1])
def test_sentence_pieces_match_the_library(spark, docs, sample_docs):
    sp, vocabulary = library()
    texts = dict(enumerate(TEXTS)) | {100 + k: t for k, t in enumerate(ODD)}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, ids string").repartition(3)
    blocks = sentence_pieces.encode(df, vocabulary, sample_docs, with_text=True)
    again = sentence_pieces.decode(blocks.drop("text"), vocabulary)
    assert sorted(again.select("doc_id", "place", "text").collect()) == sorted(blocks.select("doc_id", "place", "text").collect())
    whole = by_id(sentence_pieces.together(blocks))
    said = blocks.toPandas().sort_values(["doc_id", "place"]).groupby("doc_id").text.apply("".join)
    for i, t in texts.items():
        assert whole.ids[i].tolist() == sp.encode(t or ""), (i, t and t[:40])
        assert said[i] == (t or "").replace("▁", " "), i


def test_sentence_pieces_of_copies_and_nothing(spark):
    _, vocabulary = library()
    rows = [(1, "one text"), (1, "one text"), (1, "another"), (None, "no id"), (2, None)]
    found = sentence_pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary)
    assert sentence_pieces.together(found).count() == 4 and found.where("doc_id = 2").first()["ids"] == []
    assert sentence_pieces.encode(spark.createDataFrame([], "doc_id long, text string"), vocabulary).count() == 0


def test_sentence_pieces_viterbi_equals_merges(spark):
    sp, vocabulary = library()
    units = {"▁" * rng.randint(0, 3) + "".join(rng.choice("abcdeinrst") for _ in range(rng.randint(1, 40))) for _ in range(300)}
    units |= {"▁" * n for n in range(1, 40)} | {"=" * n for n in range(1, 40)}
    ids_of = {p: i for p, i, _ in vocabulary.pieces}
    for row in sentence_pieces.encode_units(spark.createDataFrame([(u,) for u in units], "unit string"), vocabulary).collect():
        u = row["unit"]
        cuts = sentence_pieces.merge(u, vocabulary.ranks, vocabulary.longest)
        assert row["ids"] == [ids_of[u[a:b]] for a, b in zip(cuts, cuts[1:])], u


def test_sentence_pieces_viterbi_against_brute_force(spark):
    pieces = {"▁": -2.0, "a": -1.5, "b": -1.6, "ab": -2.0, "▁a": -2.2, "ba": -2.9, "aba": -3.1, "bb": -5.0}
    vocabulary = sentence_pieces.Vocabulary(sentence_pieces.UNIGRAM, [(p, i, s) for i, (p, s) in enumerate(pieces.items(), 1)], {}, 0)
    units = ["▁" + "".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(30)]
    unknown = min(pieces.values()) - 10

    def best(u):
        if not u:
            return 0.0
        options = [pieces[u[:k]] + best(u[k:]) for k in range(1, len(u) + 1) if u[:k] in pieces] + [unknown + best(u[1:])]
        return max(options)

    df = spark.createDataFrame([(u,) for u in set(units)], "unit string")
    score = {i: s for i, s in enumerate(pieces.values(), 1)} | {0: unknown}
    for row in sentence_pieces.encode_units(df, vocabulary).collect():
        assert abs(sum(score[i] for i in row["ids"]) - best(row["unit"])) < 1e-9, row


def test_classifiers_learn_and_handle_odd_rows(spark):
    insult = [f"{sentence(20)} idiot {sentence(20)}" for _ in range(60)]
    rows = [(t, 1.0) for t in insult] + [(sentence(40), 0.0) for _ in range(140)]
    train = spark.createDataFrame(rows, "text string, y double")
    model = toxicity.train(train)
    test = spark.createDataFrame([(0, "you IDIOT, " + sentence(30)), (1, sentence(30)), (2, None), (3, "")], "doc_id long, text string")
    found = by_id(toxicity.score(test, model))
    assert found.predicted.tolist() == [1, 0, 0, 0] and found.score[2] == found.score[3]
    rated = train.selectExpr("text", "CAST(2 - 2 * y AS INT) AS grade")
    graded = by_id(quality_model.grade(test, quality_model.train(rated, 3), 1))
    assert graded.expected_grade[0] < graded.expected_grade[1] - 0.5 and graded.tail_probability.between(0, 1).all()
    empty = toxicity.train(train.where("false"))
    assert by_id(toxicity.score(test, empty)).score.eq(0.5).all()


def test_gradients():
    generator = np.random.default_rng(0)
    rows, columns = np.array([0, 0, 1, 2, 2, 2]), np.array([0, 1, 1, 0, 2, 3])
    for loss, size, y in (
        (toxicity._loss, 1 + 4 * (1 + toxicity.FACTORS), np.array([0.0, 1, 1])),
        (quality_model._loss(4), 3 + 4, np.array([0.0, 3, 1])),
    ):
        x = generator.normal(0, 0.5, size)
        _, slope = loss(x, rows, columns, y)
        for k in range(size):
            step = np.eye(size)[k] * 1e-6
            numeric = (loss(x + step, rows, columns, y)[0] - loss(x - step, rows, columns, y)[0]) / 2e-6
            assert abs(numeric - slope[k]) < 1e-4


def test_a_fit_sends_the_driver_one_vector_in_blocks(spark, monkeypatch):
    """The sums over partitions are made by a shuffle: whatever the partitions, one vector a step comes back."""
    from ledgerlens.llm import hashed

    monkeypatch.setattr(hashed, "BLOCK", 7, raising=False)
    sizes, fetched = [], hashed.fetched

    def seen(df):
        found = fetched(df)
        sizes.append((len(found), found["sums"].map(len).sum()))
        return found

    monkeypatch.setattr(hashed, "fetched", seen)
    known, width = np.arange(0, 60, 2), 30
    data = [([k % 60, (7 * k) % 60, 1], float(k % 60 < 20)) for k in range(200)]
    sample = spark.createDataFrame(data, "terms array<long>, y double").repartition(4)
    start, penalty = np.random.default_rng(1).normal(0, 0.1, 1 + width * (1 + toxicity.FACTORS)), np.full(1 + width * (1 + toxicity.FACTORS), 1e-3)
    found = hashed.fit(sample, known, toxicity._loss, start, penalty, 3)
    assert sizes and set(sizes) == {(-(-(len(start) + 1) // 7), 8 * (len(start) + 1))}

    def whole(params):
        r, c = hashed.packed(pd.Series([t for t, _ in data]), known)
        loss, slope = toxicity._loss(params, r, c, np.array([y for _, y in data]))
        return loss / 200 + (penalty * params**2).sum(), slope / 200 + 2 * penalty * params

    assert np.allclose(found, hashed._minimised(whole, start, 3))


def test_toxicity_learns_what_only_a_pair_tells(spark):
    def rows(n):
        for i in range(n):
            a, b = rng.random() < 0.5, rng.random() < 0.5
            words = sentence(25).split() + ["zorbo"] * a + ["quixel"] * b
            rng.shuffle(words)
            yield i, " ".join(words), float(a != b)

    train = spark.createDataFrame(list(rows(1500)), "doc_id long, text string, y double")
    test = spark.createDataFrame(list(rows(300)), "doc_id long, text string, y double")
    model = toxicity.train(train)
    found = toxicity.score(test, model, 0.5).toPandas()
    assert (found.predicted == found.y).mean() > 0.95
    linear = toxicity.Model(model.known, np.where(np.arange(len(model.params)) > len(model.known), 0, model.params))
    assert (toxicity.score(test, linear, 0.5).toPandas().predicted == found.y).mean() < 0.7
    # the score again, by the formula
    width = len(model.known)
    v = model.params[1 + width :].reshape(toxicity.FACTORS, width)
    from ledgerlens.llm.hashed import letter_terms

    for row in test.select("doc_id", letter_terms(test["text"]).alias("t")).limit(20).collect():
        at = [k for k, term in enumerate(model.known) if term in set(row["t"])]
        z = model.params[0] + sum(model.params[1 + k] for k in at) + sum(v[:, i] @ v[:, j] for i in at for j in at if i < j)
        assert abs(found.score[found.doc_id == row["doc_id"]].iloc[0] - 1 / (1 + np.exp(-z))) < 2e-6


def test_quality_grades_by_the_formula(spark):
    from ledgerlens.llm.hashed import word_terms

    model = quality_model.Model(np.arange(1 << 10), np.array([-0.5, 0.7]), np.random.default_rng(3).normal(0, 1, 1 << 10))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, kept string")
    found = by_id(quality_model.grade(df, model, 1))
    for row in df.select("doc_id", word_terms(df["text"]).alias("t")).collect():
        known = [t for t in row["t"] if t < 1 << 10]
        s = sum(model.weights[t] for t in known) / np.sqrt(max(1, len(known)))
        tail = 1 - 1 / (1 + np.exp(-(model.cuts - s)))
        assert abs(found.expected_grade[row["doc_id"]] - tail.sum()) < 2e-6 and found.kept[row["doc_id"]] == (round(tail[0], 6) >= 0.5)


def test_jaccard_uses_both_sides_of_its_boundary(spark):
    """Short texts out of few words have long inverted lists; a few long ones have short lists."""
    few = [f"w{k}" for k in range(12)]
    rows = {k: " ".join(rng.choice(few) for _ in range(rng.randint(12, 16))) for k in range(700)}
    for k in range(700, 740):  # short ones with near copies: a word more at the end
        rows[k] = rows[k - 700] + " " + rng.choice(few)
    rows |= {k: sentence(120) for k in range(740, 900)}
    rows |= {k: rows[k - 160] + " tail" for k in range(900, 920)}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    seen = []
    original = jaccard.boundary_by_cost
    jaccard.boundary_by_cost = lambda *a: seen.append(original(*a)) or seen[-1]
    try:
        found = by_id(jaccard.jaccard_components(df))
    finally:
        jaccard.boundary_by_cost = original
    truth = jaccard_truth(rows, 3, 90)
    assert {i: (found.n_shingles[i], found.component_id[i]) for i in rows} == truth
    assert 0 < seen[0] < 100
    linked = {i for i in rows if truth[i][1] != i}
    assert any(truth[i][0] <= seen[0] for i in linked) and any(truth[i][0] > seen[0] for i in linked)


def test_pii_dates_stay_apart_and_letters_move(spark):
    from pyspark.sql import functions as F

    days = spark.range(0, 73049, 37).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    said = days.select(F.date_format("d", "MM/dd/yyyy").alias("s")).union(days.where("dayofmonth(d) > 12").select(F.date_format("d", "dd/MM/yyyy")))
    found = said.select("s", pii.pseudonym(F.col("s"), "k")["text"].alias("p")).toPandas()
    assert found.p.nunique() == len(found) and found.p.str.fullmatch(r"\d\d/\d\d/\d{4}").all()
    texts = {
        "иван@example.com": "email", "łżź@example.com": "email", "山田@x.jp": "email", "a" * 80 + "@x.org": "email",
        "DE89 3704 0044 0532 0130 00": "iban", "GB82WEST12345698765432": "iban", "GB83WEST12345698765432": None,
    }
    out = by_id(pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k"))
    for i, (text, kind) in enumerate(texts.items()):
        assert out.pii[i].tolist() == ([kind] if kind else []) and len(out.text[i]) == len(text), text
        if kind == "email":
            assert sum(a == b for a, b in zip(text.split("@")[0], out.text[i].split("@")[0])) <= len(text.split("@")[0]) // 2
        if kind == "iban":
            plain = out.text[i].replace(" ", "")
            assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 and plain[:2] == text[:2]


def feistel_back(values, radices, key, kind, rounds=pii.ROUNDS):
    half, v = len(values) // 2, list(values)
    for r in reversed(range(rounds)):
        left = r % 2 == 0
        other = v[half:] if left else v[:half]
        said = "|".join([key, kind, ",".join(map(str, radices)), str(r), ",".join(map(str, other))])
        for i in range(0, half) if left else range(half, len(v)):
            if radices[i] > 1:
                drawn = int(hashlib.sha256(f"{said}|{i}".encode()).hexdigest()[:12], 16)
                v[i] = (v[i] - drawn) % radices[i]
    return v


def test_pii_can_be_undone_with_the_key(spark):
    from pyspark.sql import functions as F

    rows = [([rng.randrange(m) for m in radices], radices) for radices in ([10] * 15, [26, 26, 10, 1, 26], [256] * 4, [17, 4297]) for _ in range(10)]
    df = spark.createDataFrame(rows, "v array<bigint>, m array<bigint>")
    for row in df.select("v", "m", pii.feistel(F.col("v"), F.col("m"), "k", F.lit("card")).alias("w")).collect():
        assert feistel_back(row["w"], row["m"], "k", "card") == row["v"]


def undone(found: str, kind: str, key: str) -> str:
    """What a pseudonym stands for, by the key, written apart from the operator."""

    def back(text: str, hexadecimal: bool = False) -> str:
        # first code point and size of a sign's alphabet; these texts have digits and Latin letters only
        of = [(48, 10) if c.isdigit() else (97, 6 if hexadecimal else 26) if c.islower() else (65, 6 if hexadecimal else 26) if c.isupper() else (ord(c), 1) for c in text]
        values = feistel_back([ord(c) - a for c, (a, _) in zip(text, of)], [m for _, m in of], key, kind)
        return "".join(chr(v + a) for v, (a, _) in zip(values, of))

    def refilled(signs: str) -> str:
        signs = iter(signs)
        return "".join(next(signs) if c.isdigit() else c for c in found)

    digits = re.sub(r"\D", "", found)
    if kind == "email":
        local, domain = found.split("@")
        return "".join(back(local[i : i + pii.CHUNK]) for i in range(0, len(local), pii.CHUNK)) + "@" + domain
    if kind == "ssn":
        digits = back(digits)
        while digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000":
            digits = back(digits)
        return refilled(digits)
    if kind == "card":
        n = len(digits) - 1  # the check digit stands still
        body = "".join(map(str, feistel_back([*map(int, digits[:-1]), 0], [10] * n + [1], key, kind)[:-1]))
        return refilled(body + next(c for c in "0123456789" if luhn(body + c)))
    if kind == "ip":
        return ".".join(map(str, feistel_back(list(map(int, found.split("."))), [256] * 4, key, kind)))
    if kind == "date":
        k = (pd.Timestamp(found) - pd.Timestamp(pii.FIRST_DAY)).days
        a, b = feistel_back([k // 4297, k % 4297], [17, 4297], key, kind)
        return str((pd.Timestamp(pii.FIRST_DAY) + pd.Timedelta(days=a * 4297 + b)).date())
    return refilled(back(digits)) if kind == "phone" else back(found, hexadecimal=True)


def test_pii_of_whole_texts_can_be_undone(spark):
    """Every pseudonym in a text leads back to its value, and a second pass finds as many values of the same kinds."""
    from pyspark.sql import functions as F

    made = {
        "ssn": lambda: f"{rng.choice([*range(1, 666), *range(667, 900)]):03}-{rng.randint(1, 99):02}-{rng.randint(1, 9999):04}",
        "card": lambda: (d := str(rng.randrange(4 * 10**14, 5 * 10**14))) + next(c for c in "0123456789" if luhn(d + c)),
        "email": lambda: "".join(rng.choice("abcXYZ019._") for _ in range(rng.choice([3, 20, 90]))).strip("._") + "q@mail.example.org",
        "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        "date": lambda: f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
        "secret": lambda: "".join(rng.choice("0123456789abcdefABCDEF") for _ in range(rng.choice([32, 40, 64]))),
        "phone": lambda: f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(0, 9999):04}",
        "ipv6": lambda: rng.choice(["2001:db8::{:x}1", "fe80:0:0:0:12:{:x}:9:1", "FE80::12:{:x}9"]).format(rng.randrange(0xFFF)),
    }
    before = {"secret": ['api_key=', '"api_key": "', "Password: '", "token="]}
    values, texts = [], []
    for i in range(150):
        kinds = [rng.choice(list(made)) for _ in range(rng.randint(1, 9))]
        values.append([(k, made[k]()) for k in kinds])
        texts.append((i, "Of " + ", and ".join(rng.choice(before.get(k, ["it is "])) + v for k, v in values[-1]) + " ."))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    once = pii.pseudonymise(docs, "k").withColumnRenamed("pii", "kinds")
    twice = by_id(pii.pseudonymise(once, "k"))
    once = by_id(once)
    for (i, text), said in zip(texts, values):
        assert once.kinds[i].tolist() == twice.pii[i].tolist() == [k for k, _ in said], text
        gaps = re.split("|".join(re.escape(v) for _, v in said), text)
        rest = once.text[i]
        for gap, (kind, value) in zip(gaps, said):
            assert rest.startswith(gap), (text, once.text[i])
            rest = rest[len(gap) :]
            size = len(value) if kind != "ip" else len(re.match(r"[\d.]+", rest)[0].rstrip("."))
            assert undone(rest[:size], kind, "k") == value
            rest = rest[size:]
        assert rest == gaps[-1]
    ssn = [("%03d-%02d-%04d" % (a, b, c),) for a in (1, 665, 899) for b in range(1, 100, 7) for c in (1, 50, 9999)]
    image = spark.createDataFrame(ssn, "s string").select(pii.pseudonym(F.col("s"), "k")["text"].alias("p")).toPandas().p
    assert image.nunique() == len(ssn) and not image.str.contains(r"^(?:000|666|9)|-00-|-0000$").any()


def test_pii_key_is_in_no_plan_and_clear_text_stays(spark):
    texts = ["10:20:30 and std::a1", "a::b", "1:2:3:4:5:6::7:8:9:1", "00:1b:44:11:3a:b7", "AB12" + "C3D4" * 7, "key=" + "0" * 70, "=" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hidden = pii.pseudonymise(docs, "sesame")
    assert by_id(hidden).text.tolist() == texts
    assert "sesame" not in hidden._jdf.queryExecution().toString()


def test_sentence_pieces_are_cut_as_the_vocabulary_says(spark, monkeypatch):
    """Many texts are cut at once, into what a pattern over each text finds; lots of text don't show in the blocks."""
    _, vocabulary = library()
    kinds = sentence_pieces.kinds_of_signs(vocabulary)
    letters, signs = ("".join(re.escape(chr(k)) for k in np.flatnonzero(kinds == kind)) for kind in (sentence_pieces.LETTERS, sentence_pieces.SIGNS))
    pattern = re.compile(f"(?s: *+[{letters}]++| *+[{signs}]++| ++|.)")
    texts = [*TEXTS, None, "", *ODD, "", " ", None]
    units, counts = sentence_pieces.Cutter(vocabulary)(texts)
    wanted = [pattern.findall(" " + t.replace("▁", " ")) if t else [] for t in texts]
    assert counts.tolist() == [len(w) for w in wanted] and units.to_pylist() == sum(wanted, [])
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    whole = sentence_pieces.encode(rows, vocabulary, with_text=True).collect()
    monkeypatch.setattr(sentence_pieces, "TEXT_AT_ONCE", 300)
    assert sorted(sentence_pieces.encode(rows, vocabulary, with_text=True).collect()) == sorted(whole)
    assert {r["doc_id"] for r in whole} == set(range(len(texts)))
