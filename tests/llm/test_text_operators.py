"""BPE, packing, licences and languages against the library, brute force and held-out labels."""

import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sondage.llm import bpe, language, licences, packing
from sondage.llm.arrow_text import ALNUM, LOWER, NOT_SPACE, buffers, shingles, span_hashes, texts_shingles, word_bounds

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "a", "a<|endoftext|>b  <|endoftext|>", "  \x1c\x1d x\x85y　z  \n\n a", "!!'s can't it's''s   b", "日本語テキスト 漢字 😀👨‍👩‍👧", "\x01\x7f", "a" * 5000, "ab12½²③ ٣٤",
    "İıẞ ʼn", "x y " * 3000, "x y", "x y", "réêou " * 50 + "\t\t",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumns({"ids": F.lit(1), "id": F.lit("clash"), "part": F.lit(2)})


def _ids(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_encoder_equals_library(spark, library, odd):
    got = {r["doc_id"]: r for r in bpe.encode_decode(odd, PATH).collect()}
    for i, text in enumerate(ODD):
        want = _ids(library, text)
        assert bytes(got[i]["ids"]) == want.tobytes() and got[i]["n_tokens"] == len(want)
        assert got[i]["decoded"] == library.decode(want.tolist(), skip_special_tokens=False) == (text or "")
    assert bpe.encode_decode(odd.limit(0), PATH).count() == 0


def test_digests(spark, library, odd):
    for r in bpe.digests(odd, PATH).collect():
        want, text = _ids(library, ODD[r["doc_id"]]), ODD[r["doc_id"]] or ""
        assert (r["ids_sha256"], r["decoded_sha256"]) == (hashlib.sha256(want.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_forced_boundaries():
    coder = bpe.Bpe(bpe.read_tokenizer(PATH))
    held = {(a, b) for t in coder.bytes_of.values() for a, b in zip(t, t[1:])}
    assert all(coder.forced[a, b] == ((a, b) not in held) for a in range(256) for b in range(0, 256, 7))
    assert coder.encode_whole("Some text, 12 £") .tobytes() == coder.encode("Some text, 12 £")


@pytest.mark.parametrize("parts", [1, 3])
def test_packing(spark, library, odd, parts):
    pieces = packing.pack(odd.repartition(parts, "doc_id"), PATH, length=64)
    rows = pieces.collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
    for i, text in enumerate(ODD):
        own = sorted(by_doc[i], key=lambda r: r["start"])
        assert np.array_equal(np.concatenate([r["ids"] for r in own]), np.append(_ids(library, text), 0))
        assert [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1]] and {r["doc_tokens"] for r in own} == {sum(r["length"] for r in own)}
    for own in by_seq.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1]]
    assert sorted(by_seq) == list(range(len(by_seq))) and all(sum(r["length"] for r in own) == 64 for s, own in by_seq.items() if s < len(by_seq) - 1)
    whole = packing.sequences(pieces, 64)
    assert whole.count() == len(by_seq) and whole.where(F.size("ids") != 64).count() == 0
    assert packing.pack_layout(odd.limit(0), PATH).count() == 0


def _split(text, table):
    data = np.frombuffer((text or "").encode(), np.uint8)
    out, word = [], b""
    for b in LOWER[data].tolist() if len(data) else []:
        if table[b]:
            word += bytes([b])
        elif word:
            out, word = [*out, word], b""
    return [*out, word] if word else out


def test_words_and_shingles():
    import pyarrow as pa

    texts = [*ODD, "The the THE", "one two", "É é x1y2"]
    for table in (NOT_SPACE, ALNUM):
        data, cut = buffers(pa.array(texts, pa.string()))
        low = LOWER[data]
        s, e, t = word_bounds(low, cut, table)
        assert [bytes(low[a:b]) for a, b in zip(s, e)] == [w for x in texts for w in _split(x, table)]
        h = span_hashes(low, s, e)
        words = [w for x in texts for w in _split(x, table)]
        assert len({(w, int(k)) for w, k in zip(words, h)}) == len(set(words)) == len(set(h.tolist()))
        for _, _, items, ends in texts_shingles(pa.array(texts, pa.string()), table, 3):
            want = [len({tuple(w[i : i + 3]) for i in range(len(w) - 2)}) if len(w) > 2 else int(bool(w)) for w in (_split(x, table) for x in texts)]
            assert np.diff(ends).tolist() == want
    assert shingles(np.zeros(0, np.uint64), np.zeros(0, np.int64), 2, 3)[1].tolist() == [0, 0, 0]


def test_span_hashes_tell_texts_apart():
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    words = [morse, morse.translate(str.maketrans("ab", "ba")), "a" * 8, "a" * 9, "a" * 16, "a" * 7 + "\0", "a" * 5000, "a" * 4999 + "b", "", "\0"]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    h = span_hashes(data, ends - [len(w) for w in words], ends)
    assert len(set(h.tolist())) == len(words)
    shifted = span_hashes(np.concatenate([data[:3], data]), ends - [len(w) for w in words] + 3, ends + 3)
    assert (h == shifted).all()


def test_licences(spark):
    texts = [
        None, "", "Released under the MIT License.", "under the mit license under the MIT  License", "Licensed under the Apache License, Version 2.0.", "x CC-BY-NC 4.0 and under the MIT license",
        "This work is licensed under the GNU General Public License, version 3.", "under the mit", "license under the mit", "words only " * 500, "cc by" + " nc" * 3,
        "permission is hereby granted, free of charge, to any person obtaining a copy of this SOFTWARE and associated documentation files (the software), to deal in the software without restriction",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("labels", F.lit("clash"))
    got = {r["doc_id"]: r for r in licences.scan(df).collect()}
    for i, text in enumerate(texts):
        w = [x.decode() for x in _split(text, ALNUM)]
        found = [(label, j) for p, label in licences.PHRASES for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(found), ",".join(sorted({x for x, _ in found})))
        assert (r["first_word"], r["last_word"]) == (min((j for _, j in found), default=None), max((j for _, j in found), default=None))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[6]["labels"] == "gpl-3" and got[11]["labels"] == "mit" and got[9]["labels"] == ""
    assert licences.scan(df.limit(0)).count() == 0


def test_no_altered_notice_escapes(spark):
    """Every template whose words agree in place to the share that must, however chosen, against brute force."""
    rng = np.random.default_rng(4)
    rows, want = [], []
    for t, template in enumerate(licences.TEMPLATES):
        words = template.text.split()
        free = [i for i in range(len(words)) if not any(words[j : j + len(k.split())] == k.split() and j <= i < j + len(k.split()) for k in template.keys for j in range(len(words)))]
        for changed in range(len(words) - int(np.ceil(licences.MATCHED * len(words))) + 2):
            if changed > len(free):
                break
            x = list(words)
            for i in rng.choice(free, changed, replace=False) if changed else ():
                x[i] = "zzz"
            share = 1 - changed / len(words)
            rows.append(" ".join([*["filler"] * int(rng.integers(0, 5)), *x, *["filler"] * 3]))
            want.append((template.label, share))
    rows += ["filler"] * 500 + ["the " * 50 + "software license terms of use"] * 200
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in licences.scan(df).collect()}
    for i, (label, share) in enumerate(want):
        assert (label in got[i]["labels"].split(",")) >= (share >= licences.MATCHED), (rows[i], share)
    # brute force over all templates and places, words in one run
    for i, row in enumerate(rows[: len(want)]):
        w, labels = row.split(), set()
        for template in licences.TEMPLATES:
            spelled = template.text.split()
            for at in range(-len(spelled), len(w)):
                same = sum(0 <= at + o < len(w) and w[at + o] == x for o, x in enumerate(spelled))
                part = " " + " ".join(w[max(0, at) : at + len(spelled)]) + " "
                if same >= licences.MATCHED * len(spelled) - 1e-9 and all(f" {k} " in part for k in template.keys):
                    labels.add(template.label)
        assert labels <= set(got[i]["labels"].split(","))
    assert all(got[i]["labels"] == "" for i in range(len(want), len(rows)))


def test_notice_with_a_word_added_or_left_out(spark):
    mit = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction".split()
    rows = [" ".join(mit[:14] + ["new"] + mit[14:]), " ".join(mit[:14] + mit[15:]), " ".join(mit[:9]), " ".join(reversed(mit))]
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(list(enumerate(rows)) + [(0, rows[2])], "doc_id long, text string")).where("n_words > 9").collect()}
    assert got[0]["labels"] == "mit" and got[1]["labels"] == "mit" and got[3]["labels"] == ""


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language.fit(docs, ~held)
    out = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held)
    assert out.where("lang_pred = lang").count() / out.count() > 0.97
    odd = spark.createDataFrame([(0, None), (1, ""), (2, "123 !!"), (3, "日本"), (4, "x"), (5, "the " * 100_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.identify(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3 and all(got[i]["lang_pred"] in model.names for i in (3, 4, 5))
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[3]["rejected"] and got[5]["lang_pred"] == "en"
    nothing = language.fit(docs.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in language.identify(odd, nothing).collect()} == {"und"}


def test_long_texts_count_once():
    import pyarrow as pa

    one = "ab cd " * 400_000
    parts = list(language.trigrams(pa.array([one, "ab"], pa.string())))
    total = sum(int(c.sum()) for _, _, c, _ in parts)
    assert total == 6 * 400_000 - 1 + 2 and all(p.all() for *_, p in parts)
