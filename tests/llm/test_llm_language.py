"""Languages: held-out accuracy, a plain counterpart, rejection and odd rows."""

import random
import zlib

import zstandard

from corpusaudit.llm import language, queries

_WORDS = {
    "aa": "tala mira sonu keto lapi vora nesi duma rike pano".split(),
    "bb": "grzt kwarp stolch fümp brandz schrig tolk wurmst pflak dröm".split(),
}


def _text(r, lang, n):
    return " ".join(r.choice(_WORDS[lang]) + r.choice(["", ",", ".", " 12"]) for _ in range(n))


def _rows():
    r = random.Random(1)
    return [(i, _text(r, lang, r.randint(5, 300)), lang, "x", 0.5) for i in range(120) for lang in [r.choice(["aa", "bb"])]]


_SCHEMA = "doc_id long, text string, lang string, lang_pred string, score double"


def test_languages_and_odd_rows(spark):
    rows = _rows()
    odd = [(900, None, "aa", "x", 1.0), (901, "", "bb", "x", 1.0), (902, "12 !! _ 3", "aa", "x", 1.0), (None, rows[0][1], rows[0][2], None, None)]
    odd += [(903, rows[1][1], None, "x", 1.0), rows[2], (904, _text(random.Random(3), "bb", 60_000), "bb", "x", 1.0)]
    docs = spark.createDataFrame(rows + odd, _SCHEMA)
    got = language.classify(docs).collect()
    assert len(got) == len(rows + odd) and all(0 <= r["score"] <= 1 for r in got)
    told = {i: lang for i, _, lang, *_ in rows} | {900: "und", 901: "und", 902: "und", None: rows[0][2], 903: rows[1][2], 904: "bb"}
    assert all(r["lang_pred"] == told[r["doc_id"]] for r in got)
    assert all(r["accepted"] == (r["lang_pred"] != "und") for r in got)
    assert all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows + odd) - 3


def test_equals_plain_compression(spark):
    docs = spark.createDataFrame(_rows(), _SCHEMA)
    dictionaries = language.fit(docs)
    assert sorted(dictionaries) == ["aa", "bb"]
    for r in language.classify(docs).collect()[:20]:
        text = " " + language.letters(next(x[1] for x in _rows() if x[0] == r["doc_id"])) + " "
        words = text.split()
        turns = [" " + " ".join(words[i:] + words[:i]) + " " for i in range(min(16, len(words)))]
        pieces = [text[i : i + 4096].encode() for i in range(0, len(text), 4096)] if len(text.encode()) > 258 else [x.encode() for x in turns]
        sizes = {}
        for name, content in dictionaries.items():
            coder = zstandard.ZstdCompressor(
                level=language.LEVEL, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            )
            sizes[name] = sum(len(coder.compress(x)) for x in pieces)
        assert r["lang_pred"] == min(sizes, key=lambda x: (sizes[x], x))


def test_a_text_between_two_languages_is_rejected():
    r = random.Random(2)
    one, two = _text(r, "aa", 300), _text(r, "bb", 300)
    same = language.Coder({"aa": one.encode(), "bb": one.encode()}).identify(one)
    assert same == ("aa", 0.0, False)
    assert language.Coder({"aa": one.encode(), "bb": two.encode()}).identify(two)[::2] == ("bb", True)
    assert language.Coder({"aa": one.encode()}).identify(one)[::2] == ("aa", True)


def test_held_out_rows_teach_nothing(spark):
    rows = _rows()
    changed = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, x, s) for i, t, lang, x, s in rows]
    one, two = (language.fit(spark.createDataFrame(x, _SCHEMA)) for x in (rows, changed))
    assert one == two


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some words", None, "x", 0.0)], _SCHEMA)
    assert [tuple(r) for r in language.classify(docs).select("lang_pred", "score", "accepted").collect()] == [("und", 0.0, False)]
    assert language.classify(docs.limit(0)).count() == 0


def test_query_accuracy_on_held_out_rows(spark, sf_dir):
    got = queries.QUERIES["op2_language"](spark, sf_dir).where("held_out").join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    rows = got.where("lang IS NOT NULL").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows) > 0


def test_signs_that_are_no_letters(spark):
    """Superscripts, fractions and circled digits are no letters; marks belong to the word that they are in."""
    rows = _rows()
    odd = {901: "½ ² ①", 902: "²", 903: "\u0301 \u0902", 904: "12 ⅔ ٣ ㊂"}
    got = {r["doc_id"]: r for r in language.classify(spark.createDataFrame(rows + [(i, t, "aa", "x", 0.1) for i, t in odd.items()], _SCHEMA)).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and not got[i]["accepted"] for i in odd)
    assert language.letters("Stra\u0301ße² हिन्दी x½y") == "stra\u0301ße हिन्दी x y"


def test_an_id_that_repeats_is_bounded(spark):
    """Many rows of one id don't all come to the driver, and whole texts teach."""
    same = spark.range(30_000).selectExpr("7L AS doc_id", "'tala mira sonu keto' AS text", "'aa' AS lang")
    other = spark.range(30_000).selectExpr("8L AS doc_id", "concat('grzt kwarp ', id) AS text", "'bb' AS lang")
    both = same.unionByName(other)
    assert all(zlib.crc32(str(i).encode()) % 3 != 1 for i in (7, 8))
    found = language.fit(both)
    assert found["aa"] == b"tala mira sonu keto "
    assert found["bb"].count(b"grzt") == 1  # digits aren't letters, so those texts are one
    long = spark.createDataFrame([(7, "tala " * 2000 + "last word", "aa"), (8, "grzt " * 2000, "bb")], "doc_id long, text string, lang string")
    assert language.fit(long)["aa"].endswith(b"last word ")
