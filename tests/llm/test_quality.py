import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import sentencepiece

from veridoc.llm import quality, registry, vec
from veridoc.llm.common import bpe, vocabulary

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    repeated = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            repeated |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def brute_fertility(text):
    ids = bpe(vocabulary(quality.VOCABULARY)).encode_ordinary(text)
    n = len(ids)
    entropy = -sum(c / n * math.log2(c / n) for c in collections.Counter(ids).values())
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary(quality.FALLBACK_VOCABULARY))
    pieces = [i for w in WORD.findall(text) for i in sp.encode(w)]
    return n, len(text) / max(n, 1), sum(map(sp.is_byte, pieces)) / max(len(pieces), 1), entropy


def test_counts_equal_brute_force():
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "b ", " ", "\n", "é", "#", "|x", "\t", "c d\n", "\x0b", "漢 "]) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for k in range(0, 3000, 500):
        got = quality.repeats(*vec.flat(pa.array(texts[k : k + 500])))
        for i, t in enumerate(texts[k : k + 500]):
            assert tuple(int(x[i]) for x in got) == brute(t), repr(t)


def test_fertility_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = registry.op6_tokeniser_fertility(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        t = docs[r.doc_id].text or ""
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        want = brute_fertility(t)
        assert np.allclose((r.n_tokens, r.chars_per_token, r.fallback_share, r.token_entropy), want)
        b = quality.BANDS.get(docs[r.doc_id].lang) or quality.SCRIPTS.get(r.script, quality.OTHER)
        assert r.kept == (not r.base_failed and b.min_chars_per_token <= want[1] <= b.max_chars_per_token and want[2] <= b.max_fallback_share and want[3] >= b.min_entropy)


def test_clean_documents_stay(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = [r for r in registry.op6_tokeniser_fertility(spark, "/root/testdata/sf0.01").collect() if r.doc_id in labels and not r.base_failed]
    good, bad = [r for r in got if labels[r.doc_id] == 1], [r for r in got if labels[r.doc_id] == 0]
    assert all(r.kept for r in good) and sum(not r.kept for r in bad) > 0.5 * len(bad)


def test_edges(spark):
    rows = [(None, None, None, "k"), (1, "", "en", None), (1, "", "en", "k"), (2, "one two three four five six seven " * 20000, "xx", "k"), (3, "\n\n\t ", "", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    got = quality.assess(df).collect()
    assert len(got) == 5 and all(r.base_failed and r.kept is False for r in got)
    assert got[3].n_words == 140000 and got[3].n_repeat_words == 140000
    assert quality.assess(df.drop("lang", "kept")).count() == 5
    assert quality.filter_quality(df).columns == df.columns and quality.filter_quality(df).count() == 0
    assert quality.assess(df.limit(0)).count() == 0
    clash = df.selectExpr("doc_id", "text", "lang", "'a' AS language", "'b' AS __lang", "'c' AS Script")
    out = quality.assess(clash)
    assert out.columns[:5] == ["doc_id", "text", "lang", "language", "__lang"] and all(r.language == "a" and r.script in ("Latin", "other") for r in out.collect())
    assert quality.filter_quality(clash).columns == clash.columns


ARTICLES = {
    "Cyrillic": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Каждый человек должен обладать всеми правами и всеми свободами, без какого бы то ни было различия, как-то в отношении расы, цвета кожи, пола, языка, религии, политических или иных убеждений. Каждый человек имеет право на жизнь.",
    "Greek": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης. Κάθε άνθρωπος δικαιούται να επικαλείται όλα τα δικαιώματα και όλες τις ελευθερίες, χωρίς καμία απολύτως διάκριση, ειδικότερα ως προς τη φυλή, το χρώμα, το φύλο, τη γλώσσα, τις θρησκείες και τις πολιτικές.",
    "Arabic": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء. لكل إنسان حق التمتع بكافة الحقوق والحريات الواردة في هذا الإعلان، دون أي تمييز، كالتمييز بسبب العنصر أو اللون أو الجنس أو اللغة أو الدين أو الرأي السياسي أو أي رأي آخر، أو الأصل الوطني أو الاجتماعي أو الثروة أو الميلاد.",
    "Hangul": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다. 모든 사람은 인종, 피부색, 성, 언어, 종교, 정치적 또는 기타의 견해, 민족적 또는 사회적 출신, 재산, 출생 또는 기타의 신분과 같은 어떠한 종류의 차별이 없이, 이 선언에 규정된 모든 권리와 자유를 향유할 자격이 있다. 모든 사람은 생명과 신체의 자유를 갖는다.",
    "Latin": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Każdy człowiek posiada wszystkie prawa i wolności zawarte w niniejszej deklaracji bez względu na jakiekolwiek różnice rasy, koloru, płci, języka, wyznania, poglądów politycznych i innych przekonań, narodowości, pochodzenia społecznego, majątku, urodzenia.",
}


def test_scripts_have_bands_of_their_own(spark):
    rows = [(k, t, None) for k, t in ARTICLES.items()] + [(f"{k} loop", " ".join(t.split()[0] + t.split()[1] * 9 + str(i) for i in range(60)), "xx") for k, t in ARTICLES.items()] + [("none", "12 34 " * 40, None)]
    got = {r.doc_id: r for r in quality.assess(spark.createDataFrame(rows, "doc_id string, text string, lang string")).collect()}
    for k in ARTICLES:
        assert got[k].script == k and not got[k].base_failed and got[k].kept, k
        assert got[f"{k} loop"].script == k and not got[f"{k} loop"].kept, k
    assert got["none"].script == "other"
    assert quality.scripts(*vec.flat(pa.array(["", None, "漢字かな", "สวัสดี", "שלום", "नमस्ते", "a漢字"]))) == ["other", "other", "Han", "Thai", "Hebrew", "Indic", "Han"]



FLUENT = [
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, and sell copies of the software, and to permit persons to whom the software is furnished to do so.",
    "The keys of the map are compared by value, and the order of the items is the order in which they were added to the map. If a key is added again, the value of the item is replaced and the place of the item in the order stays the same. To move the item to the end, remove the key and add it again.",
    "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, this license is intended to guarantee your freedom to share and change all versions of a program, to make sure it remains free software for all its users. You can apply it to your programs, too.",
]


def test_short_fluent_texts_stay(spark):
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(FLUENT)], "doc_id long, text string, lang string")
    got = quality.assess(df).collect()
    assert all(50 <= r.n_words <= 70 and r.token_entropy < 5.3 for r in got)
    assert all(r.kept for r in got)
    loops = spark.createDataFrame([(1, " ".join(f"{w} and {w} or" for w in "abcdefghijklmnop"), "en")], df.schema)
    assert [(r.base_failed, r.kept) for r in quality.assess(loops).collect()] == [(False, False)]
